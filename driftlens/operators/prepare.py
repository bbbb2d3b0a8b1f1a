"""FUNCSIG rows with their derived sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.functions import columns as X
from driftlens.schema import funcsig


def prepared(sigs: DataFrame) -> DataFrame:
    """key, the sets s_*, the stem and the test flag; one row a key, the first by file and line."""
    df = funcsig(sigs)
    sets = {f"s_{n}": F.array_distinct(c) for n, c in (("strings", "strings"), ("writes", "writes"), ("reads", "reads"), ("ret", "ret_keys"), ("calls", "calls"))}
    return df.withColumns({"key": F.concat("file", F.lit("::"), "qualname"), "stem": X.stem_tokens("name"), "test": F.col("test") | X.is_test_path("file")} | sets)


def unique(df: DataFrame) -> DataFrame:
    """Of rows with one key the first by line; an aggregate, so it is summed up before the shuffle."""
    return df.groupBy("key").agg(F.min_by(F.struct(*[c for c in df.columns if c != "key"]), F.struct("line", "n_lines", "name")).alias("r")).select("key", "r.*")


def size_gate(min_lines: int = 4, min_nodes: int = 0) -> Column:
    return (F.col("n_lines") >= min_lines) & (F.col("node_count") >= min_nodes)


def not_dunder() -> Column:
    return ~F.col("name").startswith("__")


def within(globs: str | None) -> Column:
    """Boundary: comma-separated globs; none means all."""
    parts = [g for g in (globs or "").split(",") if g.strip()]
    return X.match_any("file", parts) if parts else F.lit(True)


def side(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])
