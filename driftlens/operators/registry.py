"""The registry of verdicts: grammar, gates, roles, staleness, pruning and migration."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftlens.functions import columns as X

OPENERS = "pair cluster family role"


def _lines(files: DataFrame) -> DataFrame:
    """files (file, text) -> file, line_no, kind, rest, entry: entry counts the openers so far in the file."""
    lines = files.select("file", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    found = lines.withColumn("kind", F.regexp_extract(X.trimmed("line"), r"^- ([a-z-]+):", 1)).withColumn("rest", X.trimmed(F.regexp_extract(X.trimmed("line"), r"^- [a-z-]+:(.*)$", 1)))
    opens = F.col("kind").isin(OPENERS.split()).cast("int")
    return found.where("kind <> ''").withColumn("entry", F.sum(opens).over(Window.partitionBy("file").orderBy("line_no")))


def entries(files: DataFrame) -> DataFrame:
    """file, entry, kind, head, keys and attributes of each entry; registry.md first, then the others by name."""
    clean = F.regexp_replace("head", r"[\s`]", "")
    of = lambda k: F.max_by(F.when(F.col("kind") == k, F.col("rest")), F.when(F.col("kind") == k, F.col("line_no")))
    opener = F.col("kind").isin(OPENERS.split())
    grouped = _lines(files).where("entry > 0").groupBy("file", "entry").agg(
        F.max(F.when(opener, F.col("kind"))).alias("kind"), F.max(F.when(opener, F.col("rest"))).alias("head"),
        *[of(k).alias(k.replace("-", "_")) for k in ("verdict", "reviewed", "canonical", "do-not-resync", "predicate", "expected", "baseline")],
    )
    keys = F.filter(F.split(clean, r"\|"), lambda k: k != "")
    first = F.when(F.regexp_extract("file", r"([^/]*)$", 1) == "registry.md", 0).otherwise(1)
    return grouped.withColumns({"keys": keys, "place": F.struct(first.alias("first"), "file", "entry")})


def _first_wins(df: DataFrame, by: Column) -> DataFrame:
    cols = df.columns
    return df.withColumn("_by", by).groupBy("_by").agg(F.min_by(F.struct(*cols), "place").alias("r")).select("r.*")


def pairs(parsed: DataFrame) -> DataFrame:
    ok = parsed.where((F.col("kind") == "pair") & (F.size("keys") == 2) & F.col("verdict").isNotNull())
    key = X.pair_key(F.try_element_at("keys", F.lit(1)), F.try_element_at("keys", F.lit(2)))
    return _first_wins(ok, key).select(F.try_element_at("keys", F.lit(1)).alias("key1"), F.try_element_at("keys", F.lit(2)).alias("key2"), key.alias("pair_key"), "verdict", X.verdict_class("verdict").alias("cls"), "canonical", "do_not_resync")


def clusters(parsed: DataFrame) -> DataFrame:
    ok = parsed.where((F.col("kind") == "cluster") & (F.size("keys") >= 2) & F.col("verdict").isNotNull())
    return _first_wins(ok, X.set_key("keys")).select("keys", X.set_key("keys").alias("cluster_key"), "verdict", X.verdict_class("verdict").alias("cls"))


def families(parsed: DataFrame) -> DataFrame:
    ok = parsed.where((F.col("kind") == "family") & (F.size("keys") == 2) & F.col("verdict").isNotNull())
    part = lambda i, j: F.try_element_at(F.split(F.try_element_at("keys", F.lit(i)), "::"), F.lit(j))
    return ok.select(part(1, 1).alias("glob1"), part(1, 2).alias("name1"), part(2, 1).alias("glob2"), part(2, 2).alias("name2"), "verdict")


def roles(parsed: DataFrame) -> DataFrame:
    ok = parsed.where((F.col("kind") == "role") & (F.col("head") != "") & F.col("predicate").isNotNull())
    baseline = F.filter(F.transform(F.split(F.coalesce("baseline", F.lit("")), ","), lambda k: F.regexp_replace(k, r"[\s`]", "")), lambda k: k != "")
    return _first_wins(ok, F.col("head")).select(F.col("head").alias("role"), "predicate", F.coalesce(F.expr("try_cast(expected as int)"), F.lit(1)).alias("expected"), baseline.alias("baseline"))


def family_condition(families_rows: list, left: str = "left_key", right: str = "right_key") -> Column:
    """Whether a pair of keys belongs to one of the given families, in either order. Families are few and written by people."""
    file, name = (lambda k: F.try_element_at(F.split(F.col(k), "::"), F.lit(1))), (lambda k: F.regexp_extract(F.col(k), r"::(.*)$", 1))
    out = F.lit(False)
    for r in families_rows:
        one = lambda k, g, n: X.match_any(file(k), [g]) & (F.lit(n == "*") | (name(k) == n))
        out = out | (one(left, r["glob1"], r["name1"]) & one(right, r["glob2"], r["name2"])) | (one(right, r["glob1"], r["name1"]) & one(left, r["glob2"], r["name2"]))
    return out


def fresh(candidates: DataFrame, known_pairs: DataFrame, families_rows: list = ()) -> DataFrame:
    """candidates (left_key, right_key, ...) without those that the registry has, directly or by family."""
    keyed = candidates.withColumn("pair_key", X.pair_key("left_key", "right_key")).join(known_pairs.select("pair_key"), "pair_key", "left_anti").drop("pair_key")
    return keyed.where(~family_condition(list(families_rows))) if families_rows else keyed


def fresh_clusters(found: DataFrame, known: DataFrame) -> DataFrame:
    return found.join(known.select("cluster_key"), "cluster_key", "left_anti")


def liveness(registry_pairs: DataFrame, live: DataFrame, files: DataFrame, extensions: list[str]) -> DataFrame:
    """registry pairs with state: stale (a source file is provably gone), ambiguous (a key is not in the corpus) or live."""
    ends = registry_pairs.select("pair_key", F.explode(F.array("key1", "key2")).alias("key"))
    file = F.regexp_extract("key", r"^(.*?)(::.*)?$", 1)
    ends = ends.withColumn("file", file).join(live.select("key", F.lit(True).alias("alive")).distinct(), "key", "left").join(files.select("file", F.lit(True).alias("there")).distinct(), "file", "left")
    ext = F.lower(F.regexp_extract("file", r"(\.[^./]*)$", 1))
    dead = ~F.col("file").rlike(r"[*?\[]") & ext.isin(extensions) & F.col("there").isNull()
    states = ends.groupBy("pair_key").agg(F.max(dead).alias("dead"), F.max(F.col("alive").isNull()).alias("missing"))
    return registry_pairs.join(states, "pair_key").withColumn("state", F.when(F.col("dead"), "stale").when(F.col("missing"), "ambiguous").otherwise("live")).drop("dead", "missing")


def unresolved_drift(alive: DataFrame) -> DataFrame:
    return alive.where("state = 'live' and cls = 'drift'")


# --- roles -----------------------------------------------------------------------

_TERM = re.compile(r"\s*(name|qual):/((?:[^/\\]|\\.)*)/|\s*(file|calls|writes|emits|returns|consts):(\S+)")
_ARRAYS = {"calls": "calls", "writes": "writes", "emits": "strings", "returns": "ret_keys", "consts": "consts"}


def predicate(expression: str) -> Column:
    """AND of name:/re/ qual:/re/ file:glob calls: writes: emits: returns: consts:; anything else is an error."""
    at, out = 0, None
    text = expression.strip()
    while at < len(text):
        m = _TERM.match(text, at)
        if not m:
            raise ValueError(f"unknown term in a predicate: {text[at:]}")
        if m[1]:
            one = F.col("name" if m[1] == "name" else "qualname").rlike(m[2])
        elif m[3] == "file":
            one = X.match_any("file", [m[4]])
        else:
            one = F.array_contains(_ARRAYS[m[3]], m[4])
        out = one if out is None else out & one
        at = m.end()
    if out is None:
        raise ValueError("an empty predicate")
    return out


def implementers(sigs: DataFrame, expression: str) -> DataFrame:
    return sigs.where(predicate(expression) & ~F.col("delegates"))


def cardinality(sigs: DataFrame, declared: list[dict]) -> DataFrame:
    """role, found, expected, vacuous, over, novel for each declared role (few, written by people); one pass over the corpus."""
    marked = sigs.select("key", F.explode(F.array(*[F.when(predicate(r["predicate"]) & ~F.col("delegates"), F.lit(r["role"])) for r in declared])).alias("role")).where("role is not null").distinct()
    spec = sigs.sparkSession.createDataFrame([(r["role"], int(r["expected"]), list(r["baseline"])) for r in declared], "role string, expected int, baseline array<string>")
    novel = marked.join(spec, "role").where(~F.array_contains("baseline", F.col("key"))).groupBy("role").agg(F.count("*").alias("novel"))
    found = marked.groupBy("role").agg(F.count("*").alias("found"))
    out = spec.join(found, "role", "left").join(novel, "role", "left").fillna(0, ["found", "novel"])
    return out.select("role", "found", "expected", ((F.col("found") == 0) & (F.col("expected") >= 1)).alias("vacuous"), (F.col("found") > F.col("expected")).alias("over"), "novel")


# --- rewriting ---------------------------------------------------------------------


def pruned(files: DataFrame, dead: DataFrame) -> DataFrame:
    """files without the entries whose pair_key is in dead: the opening line and the attribute lines right after it."""
    lines = files.select("file", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    attr = X.trimmed("line").rlike(r"^- [a-z-]+:")
    opener = X.trimmed("line").rlike(r"^- (pair|cluster|family|role):")
    by = Window.partitionBy("file").orderBy("no")
    # an entry goes on until a line that is no attribute
    island = F.sum((opener | ~attr).cast("int")).over(by)
    marked = lines.withColumn("island", island)
    keys = F.filter(F.split(F.regexp_replace(F.regexp_extract(X.trimmed("line"), r"^- pair:(.*)$", 1), r"[\s`]", ""), r"\|"), lambda k: k != "")
    heads = marked.where(X.trimmed("line").startswith("- pair:")).select("file", "island", X.pair_key(F.try_element_at(keys, F.lit(1)), F.try_element_at(keys, F.lit(2))).alias("pair_key"))
    gone = heads.join(dead.select("pair_key").distinct(), "pair_key", "left_semi").select("file", "island")
    kept = marked.join(gone, ["file", "island"], "left_anti")
    return kept.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("no", "line"))).alias("l")).select("file", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def migrated(files: DataFrame) -> DataFrame:
    """Old left/right blocks get a pair line; verdicts and dates are normalised; fenced code is left alone."""
    lines = files.select("file", F.posexplode(F.split("text", "\n")).alias("no", "line")).withColumn("t", X.trimmed("line"))
    by = Window.partitionBy("file").orderBy("no")
    fence = F.sum(F.col("t").startswith("```").cast("int")).over(by) % 2 == 1
    m = lines.withColumn("code", fence | F.col("t").startswith("```"))
    rest = X.trimmed(F.regexp_replace("t", r"^- [a-z]+:", ""))
    side_ = F.when(~F.col("code") & F.col("t").startswith("- left:"), F.lit("left")).when(~F.col("code") & F.col("t").startswith("- right:"), F.lit("right"))
    m = m.withColumn("side", side_).withColumn("rest", rest)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("side").isNotNull(), F.struct("side", "rest")), ignorenulls=True).over(before)
    pair = (F.col("side") == "right") & (last["side"] == "left") & (last["rest"] != "") & (F.col("rest") != "")
    new = (
        F.when(F.coalesce(pair, F.lit(False)), F.concat("line", F.lit("\n- pair: "), last["rest"], F.lit(" | "), "rest"))
        .when(~F.col("code") & F.col("t").startswith("- verdict:"), F.concat(F.lit("- verdict: "), X.normalize_verdict("rest")))
        .when(~F.col("code") & F.col("t").startswith("- reviewed:"), F.concat(F.lit("- reviewed: "), X.normalize_reviewed("rest")))
        .otherwise(F.col("line"))
    )
    return m.withColumn("new", new).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("no", "new"))).alias("l")).select("file", F.array_join(F.transform("l", lambda x: x["new"]), "\n").alias("text"))
