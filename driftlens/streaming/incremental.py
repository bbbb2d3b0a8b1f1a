"""The operators over streams of changed files and logs, by micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.operators import rank
from driftlens.operators.prepare import prepared
from driftlens.sources import extract


def nearest_stream(files: DataFrame, corpus: DataFrame, sink: Callable[[DataFrame, int], None], *, checkpoint: str, **how):
    """A query that finds the nearest corpus rows of every function in the files (file, text) of a stream."""

    def batch(df: DataFrame, number: int) -> None:
        sink(rank.nearest(prepared(extract.functions(df)), corpus, **how), number)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def latest_verdicts(tags: DataFrame, late: str = "1 day") -> DataFrame:
    """tags (ts timestamp, id, verdict) -> the last verdict of each id, as a streaming aggregate in complete or update mode."""
    return tags.withWatermark("ts", late).groupBy("id").agg(F.max_by("verdict", "ts").alias("verdict"))
