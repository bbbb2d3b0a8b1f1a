"""Comments that confess a copy: 'mirrors X', 'keep in sync'."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftlens.functions import columns as X
from driftlens.functions import constants as K
from driftlens.operators.prepare import side, unique


def source_lines(files: DataFrame) -> DataFrame:
    """files (file, text) -> file, line, text, doc_start: the first line of the run of comments that ends just above the line."""
    lines = files.select("file", F.posexplode(F.split("text", "\r?\n")).alias("pos", "text")).select("file", (F.col("pos") + 1).alias("line"), "text")
    comment = X.trimmed("text").rlike(r"^(//|#|\*|/\*)")
    by_file = Window.partitionBy("file").orderBy("line")
    # gaps and islands: the last line before this one that is no comment
    plain = F.last(F.when(~comment, F.col("line")), ignorenulls=True).over(by_file.rowsBetween(Window.unboundedPreceding, -1))
    return lines.withColumn("doc_start", F.coalesce(plain, F.lit(0)) + 1)


def confessions(sigs: DataFrame, files: DataFrame) -> DataFrame:
    """key, file, line, phrase, text, register: one row for each function whose span or leading comment holds a phrase."""
    lines = source_lines(files)
    hits = lines.withColumn("phrase", F.lower(X.trimmed(F.regexp_extract("text", K.CONFESSION, 1)))).where("phrase <> ''")
    fns = unique(sigs.where("kind = '' and n_lines > 0")).select("key", "file", F.col("line").alias("first"), (F.col("line") + F.col("n_lines")).alias("end"))
    start = fns.join(lines.select("file", F.col("line").alias("first"), "doc_start"), ["file", "first"]).select("key", "file", "doc_start", "end")
    inside = hits.select("file", "line", "text", "phrase").join(start, "file").where((F.col("line") >= F.col("doc_start")) & (F.col("line") < F.col("end")))
    return inside.select("key", "file", "line", "phrase", X.trimmed("text").alias("text"), X.confession_register("text").alias("register"))


def confession_candidates(confs: DataFrame, sigs: DataFrame, *, include_prose: bool = False) -> DataFrame:
    """left_key, right_key, phrase, register, cross_file: functions that a confession names by an identifier that 1 to 4 entries carry."""
    if not include_prose:
        confs = confs.where("register = 'line'")
    word = F.explode(F.regexp_extract_all(X.strip_comment_leader("text"), F.lit("([A-Za-z_][A-Za-z0-9_]*)"), 1))
    named = confs.select(F.col("key").alias("left_key"), F.col("file").alias("left_file"), "line", "phrase", "register", word.alias("word")).where(X.identifier_like("word"))
    fns = unique(sigs.where("kind = ''"))
    leaf = F.when(F.instr("qualname", ".") > 0, F.element_at(F.split("qualname", r"\."), -1))
    # a method whose leaf is its name is listed twice, and counts twice
    listed = fns.select("key", "file", F.explode(F.array("name", leaf)).alias("n")).where("n is not null and n <> ''").select(F.lower("n").alias("name"), F.col("key").alias("right_key"), F.col("file").alias("right_file"))
    few = listed.groupBy("name").agg(F.count("*").alias("entries")).where("entries <= 4").select("name")
    met = named.join(listed.join(few, "name"), F.lower("word") == F.col("name")).where("left_key <> right_key")
    first = F.struct("left_file", "line", "left_key", "right_key")
    out = met.groupBy(X.pair_key("left_key", "right_key").alias("pair_key")).agg(F.min_by(F.struct("left_key", "right_key", "phrase", "register", (F.col("left_file") != F.col("right_file")).alias("cross_file")), first).alias("r"))
    return out.select("r.*")
