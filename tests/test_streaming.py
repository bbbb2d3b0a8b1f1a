from pyspark.sql import functions as F

from driftlens.streaming.incremental import latest_verdicts, nearest_stream
from tests.rows import sigs


def test_nearest_stream(spark, tmp_path):
    corpus = sigs(spark, {"file": "layout.py", "name": "derive_bounds", "strings": ["bounds"], "writes": ["box.w"], "n_lines": 5})
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("new.py", "def compute_bounds(self):\n    self.box.w = 'bounds'\n")], "file string, text string").write.parquet(str(tmp_path / "in/a"))
    files = spark.readStream.schema("file string, text string").parquet(str(tmp_path / "in/*"))
    found = []
    q = nearest_stream(files, corpus, lambda df, _: found.extend(df.collect()), checkpoint=str(tmp_path / "c"), min_score=0.1)
    q.processAllAvailable()
    q.stop()
    assert [(r.left_key, r.right_key) for r in found] == [("new.py::compute_bounds", "layout.py::derive_bounds")]


def test_latest_verdicts(spark, tmp_path):
    rows = [("2024-01-01", "a", "useful"), ("2024-01-02", "a", "mixed"), ("2024-01-01", "b", "mixed")]
    spark.createDataFrame(rows, "ts string, id string, verdict string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema("ts timestamp, id string, verdict string").parquet(str(tmp_path / "t"))
    q = latest_verdicts(stream).writeStream.outputMode("complete").format("memory").queryName("latest_v").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("latest_v").collect()} == {("a", "mixed"), ("b", "mixed")}
