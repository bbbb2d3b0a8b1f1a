"""One check of a corpus against its registry: what is new, known, stale, ambiguous, or drift that nobody has collapsed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.functions import columns as X
from driftlens.operators import registry


def union_by_key(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both sides, one a key: the left one's first."""
    both = left.withColumn("__side", F.lit(0)).unionByName(right.withColumn("__side", F.lit(1)))
    columns = [c for c in left.columns if c != "key"]
    return both.groupBy("key").agg(F.min_by(F.struct(*columns), F.struct("__side", "line", "n_lines", "name")).alias("r")).select("key", "r.*").select(*left.columns)


def parse_warning(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """No row, or one with a warning: the registry has content, but no entry was read from it."""
    content = files.select(F.explode(F.split("text", "\n")).alias("t")).select(X.trimmed("t").alias("t")).where("t <> '' and not startswith(t, '#') and not startswith(t, '>')")
    old = F.coalesce(F.max(F.col("t").startswith("- left:") | F.col("t").startswith("- right:")), F.lit(False))
    seen = content.agg(F.count("*").alias("lines"), old.alias("old"))
    entries = parsed.where(F.col("kind").isin("pair", "cluster") & F.col("verdict").isNotNull()).agg(F.count("*").alias("entries"))
    what = F.when(F.col("old"), "the registry has left and right lines of the old format: migrate it").otherwise("the registry has content, but no pair or cluster with a verdict")
    return seen.crossJoin(F.broadcast(entries)).where("lines > 0 and entries = 0").select(what.alias("warning"))  # one row each


def check(candidates: DataFrame, sigs: DataFrame, files: DataFrame, registry_files: DataFrame, extensions: list[str], clusters: DataFrame | None = None) -> dict[str, DataFrame]:
    """candidates (left_key, right_key, ...), clusters (cluster_key, members, ...), sigs (key), files (file) against the registry.

    fresh, known: candidates; fresh_clusters, known_clusters; stale, ambiguous: entries (kind, keys, verdict) of which a source file is gone,
    or a key is not in the corpus; unresolved: drift with both sides live, and how it is to collapse; warnings.
    """
    parsed = registry.entries(registry_files)
    pairs, groups = registry.pairs(parsed), registry.clusters(parsed)
    families = registry.families(parsed).collect()  # written by people
    keyed = candidates.withColumn("pair_key", X.pair_key("left_key", "right_key"))
    fresh = registry.fresh(candidates, pairs, families)
    known = keyed.join(fresh.select(X.pair_key("left_key", "right_key").alias("pair_key")), "pair_key", "left_anti").drop("pair_key")
    out = {"fresh": fresh, "known": known}
    if clusters is not None:
        out["fresh_clusters"] = registry.fresh_clusters(clusters, groups)
        out["known_clusters"] = clusters.join(groups.select("cluster_key"), "cluster_key", "left_semi")
    alive = registry.liveness(pairs, sigs, files, extensions)
    # a cluster lives if each of its neighbouring members does
    ends = groups.select("cluster_key", "keys", "verdict", F.explode("keys").alias("key"))
    of = registry.liveness(ends.select(F.concat("cluster_key", F.lit("\u0000"), "key").alias("pair_key"), F.col("key").alias("key1"), F.col("key").alias("key2"), "cluster_key", "keys", "verdict"), sigs, files, extensions)
    whole = of.groupBy("cluster_key").agg(F.first("keys").alias("keys"), F.first("verdict").alias("verdict"), F.max(F.col("state") == "stale").alias("stale"), F.max(F.col("state") == "ambiguous").alias("ambiguous"))
    states = alive.select(F.lit("pair").alias("kind"), F.array("key1", "key2").alias("keys"), "verdict", "state").unionByName(
        whole.select(F.lit("cluster").alias("kind"), "keys", "verdict", F.when(F.col("stale"), "stale").when(F.col("ambiguous"), "ambiguous").otherwise("live").alias("state"))
    )
    out["stale"], out["ambiguous"] = (states.where(F.col("state") == s).drop("state") for s in ("stale", "ambiguous"))
    advice = (
        F.when(F.col("canonical").isNotNull() & F.col("do_not_resync").isNotNull(), F.concat(F.lit("collapse to "), "canonical", F.lit(", leave "), "do_not_resync"))
        .when(F.col("canonical").isNotNull(), F.concat(F.lit("collapse towards "), "canonical"))
        .when(F.col("do_not_resync").isNotNull(), F.concat(F.lit("collapse "), "do_not_resync", F.lit(" away")))
        .otherwise(F.lit("no direction is recorded"))
    )
    out["unresolved"] = registry.unresolved_drift(alive).select("key1", "key2", "verdict", advice.alias("advice"))
    out["warnings"] = parse_warning(registry_files, parsed)
    return out


def summary(found: dict[str, DataFrame]) -> DataFrame:
    """what, n: how many rows each part of a check has."""
    first, *rest = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("what"), "n") for k, df in found.items()]
    for r in rest:
        first = first.unionByName(r)
    return first


def report(found: dict[str, DataFrame], top: int = 30) -> str:
    """A check as text: the counts, then at most ``top`` rows of each part that asks for something."""
    counts = {r.what: r.n for r in summary(found).collect()}
    lines = [*(f"warning: {r.warning}" for r in found["warnings"].collect()), ", ".join(f"{n} {k.replace('_', ' ')}" for k, n in counts.items() if k != "warnings")]
    for r in found["fresh"].orderBy(F.col("score").desc(), "left_key", "right_key").limit(top).collect():
        lines += [f"new {r.score:.2f} `{r.left_key}` ~ `{r.right_key}`", f"  - pair: {r.left_key} | {r.right_key}"]
    if "fresh_clusters" in found:
        for r in found["fresh_clusters"].orderBy(F.col("score").desc(), "cluster_key").limit(top).collect():
            lines += [f"new {r.score:.2f} cluster of {len(r.members)}: {', '.join(r.shared)}", f"  - cluster: {' | '.join(r.members)}"]
    for r in found["stale"].orderBy("kind", "keys").limit(top).collect():
        lines.append(f"stale {r.kind} {' | '.join(r['keys'])} (was: {r.verdict})")
    for r in found["unresolved"].orderBy("key1", "key2").limit(top).collect():
        lines.append(f"drift `{r.key1}` ~ `{r.key2}`: {r.advice}")
    return "\n".join(lines) + "\n"


def by_channel(proposals: DataFrame, channel: str) -> DataFrame:
    """Role proposals whose predicate asks one channel."""
    return proposals.where(F.regexp_extract("predicate", r"^([^:]*)", 1) == channel)


def signature_coverage(sigs: DataFrame) -> DataFrame:
    """One row: how many rows there are, and how many have a signature."""
    return sigs.agg(F.count("*").alias("n"), F.count_if(F.col("sig") != "").alias("signed"))


def role_difference(implementers: DataFrame, members: DataFrame) -> DataFrame:
    """key, side of the keys that only the predicate (extra) or only the members (missing) have."""
    a, b = implementers.select("key").distinct(), members.select("key").distinct()
    return a.join(b, "key", "left_anti").withColumn("side", F.lit("extra")).unionByName(b.join(a, "key", "left_anti").withColumn("side", F.lit("missing")))
