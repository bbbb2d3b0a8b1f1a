"""Files as tables: source trees, prose, registries, logs, allow-lists."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.functions import columns as X
from driftlens.functions import constants as K


def _tree(spark: SparkSession, root: str) -> DataFrame:
    """path (relative) and content, lazily; the content is only read for rows that are asked for it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.lit(root.rstrip("/") + "/")
    rel = F.element_at(F.split(F.col("path"), F.concat(F.lit("\\Q"), base, F.lit("\\E"))), -1)
    return files.select(rel.alias("file"), "modificationTime", "length", "content")


def kept_path(path: Column, exclude: list[str] = ()) -> Column:
    """Not in a pruned, hidden or excluded folder."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    pruned = F.exists(folders, lambda s: s.isin(K.SKIPPED_DIRS) | (s.startswith(".") & (F.length(s) > 1)))
    return ~pruned & ~X.match_any(path, list(exclude))


def sources(spark: SparkSession, root: str, extensions: list[str], exclude: list[str] = ()) -> DataFrame:
    """file, text, mtime, size of the files with one of the extensions ('.py'); folders are pruned before anything is read."""
    ext = F.lower(F.regexp_extract("file", r"(\.[^./]*)$", 1))
    files = _tree(spark, root).where(kept_path(F.col("file"), exclude) & ext.isin(extensions))
    return files.select("file", F.decode("content", "UTF-8").alias("text"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def prose(spark: SparkSession, root: str, extensions: list[str] = tuple(K.PROSE_EXTENSIONS), exclude: list[str] = ()) -> DataFrame:
    return sources(spark, root, ["." + e.lstrip(".") for e in extensions], exclude).select("file", "text")


def changed(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files that the cache (file, mtime, size, ...) does not have as they are."""
    return files.join(cache.select("file", "mtime", "size").distinct(), ["file", "mtime", "size"], "left_anti")


def cached_scan(files: DataFrame, cache: DataFrame | None, extract: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of extract over files: those of unchanged files come from the cache. Rows carry file, mtime and size."""
    stamp = files.select("file", "mtime", "size")
    if cache is None:
        return extract(files).join(stamp, "file")
    fresh = extract(changed(files, cache)).join(stamp, "file")
    old = cache.join(stamp, ["file", "mtime", "size"], "left_semi")
    return old.unionByName(fresh, allowMissingColumns=True)


def pending(spark: SparkSession, content: str, file: str) -> DataFrame:
    """One file from memory."""
    return spark.createDataFrame([(file, content)], "file string, text string")


def registry_files(spark: SparkSession, root: str) -> DataFrame:
    """registry.md and registry.d/*.md."""
    files = sources(spark, root, [".md"])
    return files.where(F.col("file").isin("registry.md") | F.col("file").rlike(r"^registry\.d/[^/]+\.md$")).select("file", "text")


def jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """Blank and broken lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def allow_list(spark: SparkSession, path: str | None, seed: Callable[[], str] | None = None) -> DataFrame:
    """term: lines without blanks and comments; seed gives more lines, and a failing seed only warns."""
    lines = []
    if seed is not None:
        try:
            lines = seed().splitlines()
        except Exception as e:  # a plug-in of the user's
            import warnings

            warnings.warn(f"the seed failed: {e}", stacklevel=2)
    more = spark.createDataFrame([(x,) for x in lines], "value string")
    text = (spark.read.text(path) if path else spark.createDataFrame([], "value string")).union(more)
    return text.select(X.trimmed("value").alias("term")).where("term <> '' and not startswith(term, '#')").distinct()


def read_weights(path: str) -> dict[str, float] | None:
    """None if there is no file; broken files raise."""
    try:
        with open(path) as f:
            given = json.load(f)
    except FileNotFoundError:
        return None
    return {ch: float(given[ch]) for ch, _ in K.CHANNELS}


def write_weights(path: str, weights: dict[str, float]) -> None:
    with open(path, "w") as f:
        json.dump({ch: round(weights[ch], 4) for ch, _ in K.CHANNELS}, f, indent=2)


def source_slices(sigs: DataFrame, files: DataFrame, most: int = 200) -> DataFrame:
    """sigs with source: the lines of each row's span, at most so many."""
    lines = files.select("file", F.split("text", "\n").alias("__lines"))
    cut = F.array_join(F.slice("__lines", F.greatest(F.col("line"), F.lit(1)), F.least(F.greatest(F.col("n_lines"), F.lit(1)), F.lit(most))), "\n")
    return sigs.drop("source").join(lines, "file", "left").withColumn("source", F.coalesce(cut, F.lit(""))).drop("__lines")
