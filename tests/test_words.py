"""Counts of words without their places."""

from pyspark.sql import functions as F

from driftlens.operators import prose


def test_counts_are_those_of_the_tally(spark):
    texts = ["Alpha beta-gamma\nalpha\rdelta's x\n", "# Alpha head\nalphaalpha `alpha` Alpha\u00e9 9alpha _alpha beta\r\nBETA", None, "", "alpha\nbeta" * 3]
    docs = spark.createDataFrame([(n % 3, t) for n, t in enumerate(texts)], "id long, text string")
    how = {"path": F.col("id").cast("string"), "text": F.col("text")}
    want = sorted((r.term, r["count"]) for r in prose.content_words(docs, **how).collect())
    counts = prose.word_counts(docs, text=F.col("text"))
    assert sorted((r.term, r["count"]) for r in counts.collect()) == want and dict(want)["beta"] >= 4
    assert "path" not in counts._jdf.queryExecution().optimizedPlan().toString()
