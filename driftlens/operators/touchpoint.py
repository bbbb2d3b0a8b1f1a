"""Clusters of rows that touch the same rare symbols (seams), and roles proposed from them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.functions import columns as X
from driftlens.functions import constants as K
from driftlens.operators.components import connected
from driftlens.operators.prepare import not_dunder, size_gate, unique

PRIVATE_BOOST = 1.6


def seams(sigs: DataFrame, *, min_lines: int = 4, min_nodes: int = 0, parts: int | None = None) -> DataFrame:
    """(key, test, symbol, channel) of the seam symbols of each row: calls and constants that the corpus itself defines, strings, writes. parts: tasks among which rows are told apart; as they shrink when moved, their bytes say little of a task's memory."""
    used = ["key", "line", "n_lines", "name", "test", "calls", "s_strings", "writes", "consts"]
    rows = sigs.where(size_gate(min_lines, min_nodes) & not_dunder()).select(*used)
    pool = unique(rows.repartition(parts, "key") if parts else rows)
    defs = sigs.where(F.col("name") != "").select(F.col("name").alias("symbol")).distinct()
    consts = sigs.select(F.explode("decl_consts").alias("symbol")).distinct()
    of = lambda col, ch: pool.select("key", "test", F.explode(col).alias("symbol"), F.lit(ch).alias("channel"))
    calls = of(F.array_distinct("calls"), "calls").where(X.is_seam("symbol"))
    private = calls.where(F.col("symbol").startswith("_"))
    defined = calls.where(~F.col("symbol").startswith("_")).join(defs, "symbol", "left_semi").select("key", "test", "symbol", "channel")
    strings = of("s_strings", "emits").where(X.is_seam("symbol"))
    parts = F.array_distinct(F.flatten(F.transform("writes", lambda w: F.split(w, r"[.\[\]]"))))
    writes = of(parts, "writes").where(X.is_seam("symbol"))
    named = of(F.array_distinct("consts"), "consts").where(X.is_domain_const("symbol") & ~F.col("symbol").isin(K.COMMON_CONSTS)).join(consts, "symbol", "left_semi").select("key", "test", "symbol", "channel")
    return private.unionByName(defined).unionByName(strings).unionByName(writes).unionByName(named)


def seam_groups(sigs: DataFrame, *, min_lines: int = 4, max_fanout: int = 8, parts: int | None = None) -> DataFrame:
    """symbol, fanout, rarity, members, all_test of the symbols that 2 to max_fanout rows touch."""
    touched = seams(sigs, min_lines=min_lines, parts=parts).select("symbol", "key", "test")
    touched = (touched.repartition(parts, "symbol") if parts else touched).distinct()
    fan = touched.groupBy("symbol").agg(F.count("*").alias("fanout")).where(F.col("fanout").between(2, max_fanout))
    few = touched.join(fan, "symbol")  # no group of more than max_fanout rows is gathered
    rarity = F.lit(1.0) / F.col("fanout") * F.when(F.col("symbol").startswith("_"), PRIVATE_BOOST).otherwise(1.0)
    return few.groupBy("symbol", "fanout").agg(F.array_sort(F.collect_list("key")).alias("members"), F.min("test").alias("all_test")).withColumn("rarity", rarity)


def clusters(sigs: DataFrame, *, min_lines: int = 4, min_members: int = 3, max_fanout: int = 8, min_score: float = 0.40, include_tests: bool = False, top: int | None = 30, parts: int | None = None) -> DataFrame:
    """members, shared (symbols, rarest first), score: groups fold into the first larger group that holds all their members.

    Folding only happens between groups with a common member, so each connected component is folded by itself; groups
    that nothing ties to another need no Python.
    """
    groups = seam_groups(sigs, min_lines=min_lines, max_fanout=max_fanout, parts=parts).where(F.lit(True))
    of = connected(groups.select(F.col("symbol").alias("item"), F.explode("members").alias("tie")))
    tied = groups.join(of, F.col("symbol") == F.col("item")).select("component", "symbol", "fanout", "rarity", "members", "all_test")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        found: list[dict] = []
        for g in pdf.sort_values(["fanout", "symbol"], ascending=[False, True]).itertuples():
            members = list(g.members)
            host = next((c for c in found if c["set"].issuperset(members)), None)
            if host is None:
                host = {"set": set(members), "members": members, "all_test": bool(g.all_test), "shared": [], "score": 0.0}
                found.append(host)
            host["shared"].append((g.symbol, g.rarity))
            host["score"] += g.rarity
        rows = [(c["members"], [s for s, _ in sorted(c["shared"], key=lambda x: (-x[1], x[0]))], c["score"], c["all_test"]) for c in found]
        return pd.DataFrame(rows, columns=["members", "shared", "score", "all_test"])

    out = tied.groupBy("component").applyInPandas(fold, "members array<string>, shared array<string>, score double, all_test boolean")
    out = out.where((F.size("members") >= min_members) & (F.col("score") >= min_score))
    if not include_tests:
        out = out.where(~F.col("all_test"))
    out = out.select("members", "shared", "score", X.set_key("members").alias("cluster_key"))
    return out.orderBy(F.col("score").desc(), "cluster_key").limit(top) if top else out


def role_proposals(sigs: DataFrame, *, min_members: int = 3, max_fanout: int = 8, known: DataFrame | None = None, top: int = 30) -> DataFrame:
    """A predicate for each cluster: its rarest seam that all members reach by calls, else constants, else strings; else its best channel, approximate.

    known: cluster_key of clusters and roles that are adjudicated already.
    """
    found = clusters(sigs, min_members=min_members, max_fanout=max_fanout, top=top)
    if known is not None:
        found = found.join(known.select("cluster_key"), "cluster_key", "left_anti")
    member = found.select("cluster_key", "shared", F.size("members").alias("n"), F.explode("members").alias("key"))
    via = member.join(seams(sigs).where("channel <> 'writes'"), "key").where(F.array_contains("shared", F.col("symbol")))
    cover = via.groupBy("cluster_key", "symbol", "channel", "n").agg(F.countDistinct("key").alias("covered"), F.first(F.array_position("shared", F.col("symbol"))).alias("place"))
    priority = F.when(F.col("channel") == "calls", 0).when(F.col("channel") == "consts", 1).otherwise(2)
    best = cover.groupBy("cluster_key", "n").agg(F.min_by(F.struct("symbol", "channel", "covered"), F.struct((F.col("covered") < F.col("n")).alias("partial"), F.when(F.col("covered") < F.col("n"), F.lit(0)).otherwise(priority), "place", -F.col("covered"), "symbol")).alias("b"))
    return best.select("cluster_key", F.concat("b.channel", F.lit(":"), "b.symbol").alias("predicate"), X.kebab(F.regexp_replace("b.symbol", "^_+", "")).alias("name"), (F.col("b.covered") < F.col("n")).alias("approximate"), F.col("n").alias("expected"))
