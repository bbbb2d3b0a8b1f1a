"""Adjudication by an injected judge: parser, cache and label rows. No network client comes with it."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.functions import columns as X

CLASSES = ("drift", "contracted-twin-ok", "false-alarm")


def parse_verdict(answer: str) -> tuple[str, str, str]:
    """class, confidence, reason from the first { to the last } of an answer; an unknown class is a false alarm."""
    at, end = answer.find("{"), answer.rfind("}")
    if at < 0 or end < at:
        raise ValueError("an answer without an object")
    given = json.loads(answer[at : end + 1])
    cls = str(given.get("class", ""))
    return cls if cls in CLASSES else "false-alarm", str(given.get("confidence") or "low"), str(given.get("reason", ""))


def cache_key(left_source: Column, right_source: Column, detector: Column) -> Column:
    return F.sha2(F.concat_ws("\u0000", detector, left_source, right_source).cast("binary"), 256)


def judged(pairs: DataFrame, ask: Callable[[str, str], str], cache: DataFrame | None = None) -> DataFrame:
    """pairs (left_key, right_key, left_source, right_source, detector) with cls, confidence, reason and id.

    Rows that the cache (id, cls, confidence, reason) holds are not asked again; equal contents are asked once a batch. An answer that
    cannot be read gives the class error.
    """

    @F.pandas_udf("cls string, confidence string, reason string")
    def verdict(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for left, right in batches:
            seen: dict[tuple[str, str], tuple[str, str, str]] = {}
            for key in zip(left, right):
                if key not in seen:
                    try:
                        seen[key] = parse_verdict(ask(*key))
                    except ValueError as e:
                        seen[key] = ("error", "", str(e))
            yield pd.DataFrame([seen[k] for k in zip(left, right)], columns=["cls", "confidence", "reason"])

    keyed = pairs.withColumn("id", cache_key(F.col("left_source"), F.col("right_source"), F.col("detector")))
    new = keyed if cache is None else keyed.join(cache.select("id"), "id", "left_anti")
    out = new.withColumn("v", verdict("left_source", "right_source")).select(*keyed.columns, "v.*")
    return out if cache is None else out.unionByName(keyed.join(cache.select("id", "cls", "confidence", "reason"), "id").select(*out.columns))


def labels(verdicts: DataFrame, repo: str, ts: str) -> DataFrame:
    """Rows for the label log; a verdict that failed gives none."""
    file = F.regexp_extract("left_key", r"^(.*?)::", 1)
    return verdicts.where(F.col("cls").isin(*CLASSES)).select(
        F.lit(ts).alias("ts"), F.lit(repo).alias("repo"), "detector", X.lang_of(file).alias("lang"), X.variety_of("sig").alias("variety") if "sig" in verdicts.columns else F.lit("").alias("variety"),
        F.col("left_key").alias("a"), F.col("right_key").alias("b"), F.col("cls").alias("verdict"), "confidence",
    )
