"""Work on small files of many rows is shared out, and each text is parsed for its own extension only."""

import json

from pyspark.sql import functions as F

from driftlens.plans import code
from driftlens.sources import extract, tables


def test_a_file_of_many_rows_is_shared_out(spark, tmp_path):
    path = str(tmp_path / "part.parquet")
    spark.range(9000).select(F.col("id").alias("p_partkey"), F.lit("Brand#1").alias("p_brand"), F.lit(3).alias("p_size"), F.lit("hot bolt").alias("p_name"), F.lit("SMALL").alias("p_type")).coalesce(1).write.parquet(path)
    files = code._files(spark, str(tmp_path), code.SCHEMA, ".sql")
    sizes = files.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= spark.sparkContext.defaultParallelism and max(r["count"] for r in sizes) <= 4000
    assert tables.spread(spark.range(50), 10).rdd.getNumPartitions() == 5


def test_first_shapes_of_a_batch():
    texts = [(f"d/{n}.json", json.dumps({"id": 1, f"k{n % 2}": None, "items": [{"size": n, "x": 0}, {"size": 2, "x": 1}]})) for n in (3, 1, 2)] + [("d/0.json", "{broken")]
    rows = sorted((r for file, text in texts for r in extract.json_shapes(file, text)), key=lambda r: (r["file"], r["qualname"]))
    want: dict = {}
    for r in rows:
        want.setdefault(tuple(r["ret_keys"]), r)
    got = {tuple(r["ret_keys"]): r for r in extract.first_shapes(texts)}
    assert got == want and len(got) == 3


def test_no_text_is_parsed_for_what_it_cannot_hold(spark):
    files = spark.createDataFrame([("a.py", 'KEYS = {"one": "x"}'), ("b.json", '{"p": 1, "q": 2}'), ("c.sql", "create table t (a int, b int)")], "file string, text string")
    assert sorted((r.file, r.kind) for r in extract.symbols(files).collect()) == [("a.py", "table"), ("b.json", "corpus-field"), ("c.sql", "sql-table")]
    plan = extract.symbols(files)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 3 and plan.count(" IN (.py,.go)") + plan.count(" IN (.go,.py)") == 1


def test_seams_are_told_apart_in_tasks_by_rows(spark):
    """Not one exchange whose tasks Spark may merge by their bytes lies below the seams' groups."""
    from driftlens.operators import touchpoint
    from tests.rows import sigs

    df = sigs(spark, *[{"file": f"{c}.go", "name": f"f{c}", "calls": ["_helper", f"_own_{c}"], "strings": ["shared_word"]} for c in "abc"], n_lines=10)
    want = sorted((r.symbol, r.fanout, *r.members) for r in touchpoint.seam_groups(df).collect())
    found = touchpoint.seam_groups(df, parts=7)
    assert sorted((r.symbol, r.fanout, *r.members) for r in found.collect()) == want and {w[:2] for w in want} == {("_helper", 3), ("shared_word", 3)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(key#" in plan and plan.count("REPARTITION_BY_NUM") >= 2
