"""Vocabulary of a prose corpus: compounds, content words, stems, synonyms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftlens.functions import columns as X
from driftlens.functions import constants as K
from driftlens.operators.components import connected

SEP = "\u0001"


def term_hits(docs: DataFrame, pattern: str, *, path: Column, text: Column, lower: bool = False) -> DataFrame:
    """path, line, term of each match in the prose of each document. Lines count in the prose, after what is no prose went; no term spans two."""
    found = F.regexp_extract_all("line_text", F.lit(f"{K.ASCII_B}({pattern}){K.ASCII_B}"), 1)
    lines = docs.select(path.alias("path"), F.posexplode(F.split(text, "\n")).alias("no", "line_text"))
    hits = lines.select("path", (F.col("no") + 1).alias("line"), F.explode(found).alias("term"))
    return hits.withColumn("term", F.lower("term")) if lower else hits


def tally(hits: DataFrame, max_locs: int = 3) -> DataFrame:
    """term, count, files, first_path and, unless max_locs is 0, locs: the first max_locs places (path, line), a place for each hit.

    Hits are summed up by file before they move; of a term's places only the first few of each task do, so no list grows with the count.
    """
    counts = hits.groupBy("term", "path").agg(F.count("*").alias("n")).groupBy("term").agg(F.sum("n").alias("count"), F.count("*").alias("files"), F.min("path").alias("first_path"))
    if not max_locs:
        return counts
    first = Window.partitionBy("term").orderBy("path", "line")
    few = hits.withColumn("rk", F.row_number().over(first)).where(F.col("rk") <= max_locs).groupBy("term").agg(F.array_sort(F.collect_list(F.struct("path", "line"))).alias("locs"))
    return counts.join(few, "term").select("term", "count", "files", "first_path", "locs")


def report_filter(terms: DataFrame, least: int = 1, most: int | None = None, everything: bool = False) -> DataFrame:
    """Terms of a report by count, most frequent first, ties by term; ``everything`` lifts both bounds."""
    kept = terms if everything else terms.where((F.col("count") >= least) & (F.col("count") <= most if most else F.lit(True)))
    return kept.orderBy(F.col("count").desc(), "term")


def compounds(docs: DataFrame, *, path: Column, text: Column, max_locs: int = 3) -> DataFrame:
    return tally(term_hits(docs, K.COMPOUND, path=path, text=X.strip_non_prose(text)), max_locs)


def word_counts(docs: DataFrame, *, text: Column) -> DataFrame:
    """term, count of content_words alone: no line and no path is told apart, so hits are summed up before anything moves."""
    # a word holds no line end, and at either end of a line a word ends as well
    found = F.regexp_extract_all(X.strip_non_prose(text), F.lit(f"{K.ASCII_B}({K.CONTENT_WORD}){K.ASCII_B}"), 1)
    words = docs.select(F.explode(found).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return words.groupBy(F.lower("term").alias("term")).agg(F.sum("n").alias("count")).where(~F.col("term").isin(K.SYNONYM_STOP))


def content_words(docs: DataFrame, *, path: Column, text: Column, max_locs: int = 3) -> DataFrame:
    words = term_hits(docs, K.CONTENT_WORD, path=path, text=X.strip_non_prose(text), lower=True)
    return tally(words.where(~F.col("term").isin(K.SYNONYM_STOP)), max_locs)


def violations(terms: DataFrame, allowed: DataFrame, threshold: int = 5) -> DataFrame:
    """Terms that occur often and are not on the allow-list (term)."""
    return terms.where(F.col("count") >= threshold).join(allowed.select("term").distinct(), "term", "left_anti")


def stem_clusters(terms: DataFrame, min_total: int = 3) -> DataFrame:
    """stem, variants, total of stems with two forms or more."""
    groups = terms.groupBy(X.stem_key("term").alias("stem")).agg(F.count("*").alias("variants"), F.sum("count").alias("total"), F.min("term").alias("first_term"))
    return groups.where((F.col("variants") >= 2) & (F.col("total") >= min_total))


def synonym_pairs(vectors: DataFrame, *, threshold: float = 0.78, max_words: int = 1500, skip_morphology: bool = True) -> DataFrame:
    """vectors (term, count, vec) -> left, right, cosine of the most frequent terms (the cap is the report's) whose vectors are near.

    At most max_words rows meet each other: the join's size is fixed, and the small side goes to every task.
    """
    top = vectors.orderBy(F.col("count").desc(), "term").limit(max_words).select("term", F.col("count").alias("n"), X.normalized("vec").alias("v"))
    a = top.select(F.col("term").alias("left"), F.col("n").alias("left_n"), F.col("v").alias("left_v"))
    b = F.broadcast(top.select(F.col("term").alias("right"), F.col("n").alias("right_n"), F.col("v").alias("right_v")))
    pairs = a.join(b, (F.col("left") < F.col("right")) & (X.cosine("left_v", "right_v") >= threshold))
    if skip_morphology:
        pairs = pairs.where(~X.share_word_stem("left", "right"))
    return pairs.select("left", "right", "left_n", "right_n", X.cosine("left_v", "right_v").alias("cosine"))


def synonym_components(pairs: DataFrame) -> DataFrame:
    """component, members, size, total of connected terms, largest total first."""
    edge = F.concat("left", F.lit(SEP), "right")
    ties = pairs.select(F.explode(F.array(F.struct(F.col("left").alias("item"), edge.alias("tie")), F.struct(F.col("right").alias("item"), edge.alias("tie")))).alias("t")).select("t.*")
    counts = pairs.select(F.explode(F.array(F.struct(F.col("left").alias("item"), F.col("left_n").alias("n")), F.struct(F.col("right").alias("item"), F.col("right_n").alias("n")))).alias("t")).select("t.*").distinct()
    return connected(ties).join(counts, "item").groupBy("component").agg(F.count("*").alias("size"), F.sum("n").alias("total"), F.array_join(F.array_sort(F.collect_list("item")), " ").alias("members"))
