"""Findings as text: ranked markdown, annotations, summary tables, role blocks. Reports are top-k, so their rows are collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.functions import columns as X


def markdown(suspicions: DataFrame, top: int = 30) -> str:
    rows = suspicions.orderBy(F.col("score").desc(), "left_key", "right_key").limit(top).collect()
    lines = [f"# {len(rows)} suspects", ""]
    for i, r in enumerate(rows, 1):
        shared = ", ".join(f"{c[4:]} {r[c]:.2f}" for c in r.asDict() if c.startswith("sim_") and r[c] > 0)
        hint = f" — {r.hint}?" if "hint" in r and r.hint else ""
        lines += [f"{i}. **{r.score:.2f}** `{r.left_key}` ~ `{r.right_key}`{hint}", f"   {shared}"]
    return "\n".join(lines) + "\n"


def annotations(fresh: DataFrame, sigs: DataFrame, title: str = "possible drift") -> DataFrame:
    """One workflow command for each end of each fresh pair."""
    ends = fresh.select(F.explode(F.array(F.struct(F.col("left_key").alias("key"), F.col("right_key").alias("other")), F.struct(F.col("right_key").alias("key"), F.col("left_key").alias("other")))).alias("e")).select("e.*")
    at = sigs.select("key", "file", "line")
    text = F.concat(F.lit("looks like "), "other")
    return ends.join(at, "key").select(
        "key", F.concat(F.lit("::warning file="), X.escape_property("file"), F.lit(",line="), F.col("line").cast("string"), F.lit(",title="), X.escape_property(F.lit(title)), F.lit("::"), X.escape_data(text)).alias("command")
    )


def summary_table(fresh: DataFrame, top: int = 30) -> str:
    rows = fresh.orderBy(F.col("score").desc(), "left_key", "right_key").limit(top).select(F.round("score", 2).alias("score"), X.md_cell("left_key").alias("l"), X.md_cell("right_key").alias("r")).collect()
    return "\n".join(["| score | left | right |", "|-|-|-|", *[f"| {r.score:.2f} | `{r.l}` | `{r.r}` |" for r in rows]]) + "\n"


def role_blocks(proposals: DataFrame) -> DataFrame:
    """A block for each proposed role, ready for the registry."""
    return proposals.select("name", F.concat(F.lit("- role: "), "name", F.lit("\n- predicate: "), "predicate", F.lit("\n- expected: "), F.col("expected").cast("string"), F.when(F.col("approximate"), "\n(approximate)").otherwise("")).alias("block"))


def exit_code(strict: bool, fresh: DataFrame) -> int:
    return int(strict and fresh.limit(1).count() > 0)
