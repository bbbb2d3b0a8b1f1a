"""One query for each operator of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.llm import bpe, dartminhash, htmlcut, langid, media, mixing, passages, records, rpforest, urlrules
from driftlens.llm.common import read, tokenizer_path

END_ID = 2


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(read(spark, sf_dir, "documents"), tokenizer_path())


def op2_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(read(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(read(spark, sf_dir, "documents"))


def op4_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.placed(read(spark, sf_dir, "documents").select("doc_id", "source"))


def op5_html_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlcut.extracted(read(spark, sf_dir, "pages"), ["page_id", "url"])


def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.digests(read(spark, sf_dir, "documents"), tokenizer_path(), END_ID)


def op7_forest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rpforest.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.classes(read(spark, sf_dir, "documents"))


def op9_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.report(read(spark, sf_dir, "documents"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge_urls(read(spark, sf_dir, "pages"), ["page_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (pipeline, op1_bpe_round_trip, op2_progressive_jpeg, op3_language_id, op4_pfair_mix, op5_html_cut, op6_token_records, op7_forest_search, op8_dart_minhash, op9_passage_dedup, op10_url_rules)}
ORACLES: dict[str, str] = {"op9_passage_dedup": passages.oracle_sql(), "op10_url_rules": urlrules.oracle_sql()}
