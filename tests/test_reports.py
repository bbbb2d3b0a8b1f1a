import pytest
from pyspark.sql import functions as F

from driftlens.operators import judge, rank
from driftlens.sources import report
from tests.test_operators import fixture


def test_judge(spark):
    assert judge.parse_verdict('x {"class": "drift", "confidence": "high", "reason": "r"} y') == ("drift", "high", "r")
    assert judge.parse_verdict('{"class": "odd"}')[0] == "false-alarm"
    with pytest.raises(ValueError):
        judge.parse_verdict("no")
    pairs = spark.createDataFrame([("a.go::A", "b.go::B", "x", "y", "sig"), ("c.py::C", "d.py::D", "p", "q", "sig")], "left_key string, right_key string, left_source string, right_source string, detector string")
    ask = lambda a, b: '{"class": "drift"}' if a == "x" else "?"
    got = judge.judged(pairs, ask)
    assert {r.left_key: r.cls for r in got.collect()} == {"a.go::A": "drift", "c.py::C": "error"}
    cache = got.where("cls = 'drift'").select("id", "cls", "confidence", "reason")
    again = judge.judged(pairs, lambda a, b: '{"class": "false-alarm"}', cache)
    assert {r.left_key: r.cls for r in again.collect()} == {"a.go::A": "drift", "c.py::C": "false-alarm"}
    (label,) = judge.labels(got, "r", "t").collect()
    assert (label.lang, label.verdict, label.a) == ("go", "drift", "a.go::A")


def test_reports(spark):
    df = fixture(spark)
    found = rank.rank(df, df)
    text = report.markdown(found)
    assert text.startswith("# 4 suspects") and "parseConfig" in text
    assert report.annotations(found, df).count() == 8 and report.annotations(found, df).where(F.col("command").startswith("::warning file=")).count() == 8
    assert report.summary_table(found).count("\n") == 6 and report.exit_code(True, found) == 1 and report.exit_code(False, found) == 0
