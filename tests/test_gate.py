"""One check against a registry; the pieces around it."""

from driftlens.operators import gate, prose, registry

REGISTRY = """# title
- pair: `a.go::A` | b.go::B
- verdict: drift — two ways
- canonical: a.go::A
- do-not-resync: b.go::B
- pair: a.go::A | gone.go::C
- verdict: false-alarm
- pair: a.go::A | b.go::Missing
- verdict: drift
- cluster: a.go::A | b.go::B | c.py::D
- verdict: drift
- cluster: c.py::D | gone.go::C
- verdict: false-alarm
- family: src/*::* | lib/*::Same
- verdict: contracted-twin-ok
"""


def _tables(spark, text):
    files = spark.createDataFrame([("registry.md", text)], "file string, text string")
    sigs = spark.createDataFrame([("a.go::A",), ("b.go::B",), ("c.py::D",), ("a.go::A",)], "key string")
    there = spark.createDataFrame([("a.go",), ("b.go",), ("c.py",)], "file string")
    pairs = spark.createDataFrame([("b.go::B", "a.go::A", 0.9), ("a.go::A", "c.py::D", 0.5), ("lib/x.go::Same", "src/y.go::Z", 0.4), ("src/y.go::Z", "lib/x.go::Other", 0.3)], "left_key string, right_key string, score double")
    clusters = spark.createDataFrame([(["a.go::A", "b.go::B", "c.py::D"], ["s"], 1.0), (["a.go::A", "c.py::D"], ["t"], 0.5)], "members array<string>, shared array<string>, score double")
    return pairs, sigs, there, files, clusters.withColumn("cluster_key", registry.X.set_key("members"))


def test_check(spark):
    pairs, sigs, there, files, clusters = _tables(spark, REGISTRY)
    found = gate.check(pairs, sigs, there, files, [".go", ".py"], clusters)
    assert {(r.left_key, r.right_key) for r in found["fresh"].collect()} == {("a.go::A", "c.py::D"), ("src/y.go::Z", "lib/x.go::Other")} and found["known"].count() == 2
    assert [r.members for r in found["fresh_clusters"].collect()] == [["a.go::A", "c.py::D"]] and found["known_clusters"].count() == 1
    assert sorted((r.kind, r["keys"]) for r in found["stale"].collect()) == [("cluster", ["c.py::D", "gone.go::C"]), ("pair", ["a.go::A", "gone.go::C"])]
    assert [r["keys"] for r in found["ambiguous"].collect()] == [["a.go::A", "b.go::Missing"]]
    assert [(r.key1, r.advice) for r in found["unresolved"].collect()] == [("a.go::A", "collapse to a.go::A, leave b.go::B")]
    assert {r.what: r.n for r in gate.summary(found).collect()} == {"fresh": 2, "known": 2, "fresh_clusters": 1, "known_clusters": 1, "stale": 2, "ambiguous": 1, "unresolved": 1, "warnings": 0}
    text = gate.report(found)
    assert "2 fresh, 2 known" in text and "  - pair: a.go::A | c.py::D" in text and "  - cluster: a.go::A | c.py::D" in text and "stale pair a.go::A | gone.go::C (was: false-alarm)" in text and text.count("\nnew ") == 3


def test_warnings(spark):
    for text, n in (("", 0), ("# only\n> notes\n", 0), ("some words\n", 1), ("- left: a\n- right: b\n", 1), (REGISTRY, 0)):
        pairs, sigs, there, files, _ = _tables(spark, text)
        rows = gate.check(pairs, sigs, there, files, [".go"])["warnings"].collect()
        assert len(rows) == n and (not n or ("migrate" in rows[0].warning) == text.startswith("- left"))


def test_pieces(spark):
    a = spark.createDataFrame([("k", 1, 1, "n", "left"), ("l", 1, 1, "n", "left")], "key string, line int, n_lines int, name string, x string")
    b = spark.createDataFrame([("k", 1, 1, "n", "right"), ("m", 1, 1, "n", "right")], a.schema)
    assert {(r.key, r.x) for r in gate.union_by_key(a, b).collect()} == {("k", "left"), ("l", "left"), ("m", "right")}
    assert {(r.key, r.side) for r in gate.role_difference(a, b).collect()} == {("l", "extra"), ("m", "missing")}
    roles = spark.createDataFrame([("calls:_x",), ("consts:A",)], "predicate string")
    assert [r.predicate for r in gate.by_channel(roles, "consts").collect()] == ["consts:A"]
    terms = spark.createDataFrame([("b", 3), ("a", 3), ("c", 9), ("d", 1)], "term string, count long")
    shown = lambda **how: [r.term for r in prose.report_filter(terms, **how).collect()]
    assert shown(least=2, most=5) == ["a", "b"] and shown(least=2) == ["c", "a", "b"] and shown(least=2, everything=True) == ["c", "a", "b", "d"]
