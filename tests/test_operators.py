"""Operators on small fixtures with known results, and against the double loop."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from driftlens.functions import columns as X
from driftlens.operators import calibrate, confess, passes, rank, registry, touchpoint
from driftlens.sources import extract
from tests.rows import sigs

W = {"strings": 0.30, "writes": 0.30, "name": 0.22, "calls": 0.10, "ret": 0.08}


def pairs(df, *extra):
    return sorted((r.left_key.split("::")[-1], r.right_key.split("::")[-1], *[r[c] for c in extra]) for r in df.collect())


def values(spark, expr, rows, cols):
    return [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ["_i", *cols]).orderBy("_i").select(expr).collect()]


def fixture(spark):
    names = [("a", "parseConfig", {}), ("b", "parseConfig", {}), ("c", "alpha", {"strings": ["shared_marker_xyz"]}), ("d", "beta", {"strings": ["shared_marker_xyz"]}), ("e", "gamma", {"writes": ["obj.field_marker"]})]
    names += [("f", "delta", {"writes": ["obj.field_marker"]}), ("g", "epsilon", {"ret_keys": ["status_key"]}), ("h", "zeta", {"ret_keys": ["status_key"]}), ("i", "eta", {"calls": ["_shared_helper"]}), ("j", "theta", {"calls": ["_shared_helper"]})]
    return sigs(spark, *[{"file": f"{f}.go", "name": n, **x} for f, n, x in names], n_lines=10)


def test_rank_scores(spark):
    df = fixture(spark)
    got = {(r.left_key[0], r.right_key[0]): r.score for r in rank.rank(df, df).collect()}
    assert set(got) == {("a", "b"), ("c", "d"), ("e", "f"), ("g", "h")}
    assert math.isclose(got["a", "b"], 1.0) and math.isclose(got["c", "d"], 0.30 / 0.52) and math.isclose(got["e", "f"], 0.30 / 0.52) and math.isclose(got["g", "h"], 0.08 / 0.30)


def _score(a, b):
    j = lambda x, y: len(x & y) / len(x | y) if x | y else 0.0
    sims = {k: j(set(a[k]), set(b[k])) for k in W if k != "name"}
    sims["name"] = (1.0 if a["stem"] and a["stem"] == b["stem"] else j(a["stem"], b["stem"])) * (0.2 if a["delegates"] or b["delegates"] else 1)
    there = {k: bool(a["stem"] or b["stem"]) if k == "name" else bool(set(a[k]) | set(b[k])) for k in W}
    w = sum(W[k] for k in W if there[k])
    anchored = (sims["name"] >= 0.34 and not (a["delegates"] or b["delegates"])) or any(sims[k] > 0 for k in ("strings", "writes", "ret"))
    return sum(W[k] * sims[k] for k in W if there[k]) / (w or 1) if anchored else None


@pytest.mark.parametrize("least", [0.05, 0.18, 0.5])
def test_rank_equals_double_loop(spark, least):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(12)]
    pick = lambda k: sorted(set(rng.choices(words, weights=[2.0 ** -(i / 2) for i in range(12)], k=rng.randint(0, k))))
    raw = [{"file": f"f{i % 5}.go", "qualname": f"q{i}", "name": "_".join(pick(3)) or "x", "strings": pick(6), "writes": pick(3), "calls": pick(4), "ret_keys": pick(2), "delegates": rng.random() < 0.2} for i in range(60)]
    df = sigs(spark, *raw, n_lines=10)
    rows = [dict(r.asDict(), ret=r["s_ret"], stem=set(r["stem"])) for r in df.collect()]
    want = {}
    for a, b in itertools.combinations(sorted(rows, key=lambda r: r["key"]), 2):
        s = _score(a, b)
        if s is not None and s >= least - 1e-12:
            want[a["key"], b["key"]] = s
    got = {(r.left_key, r.right_key): r.score for r in rank.rank(df, df, min_score=least, top=None).collect()}
    assert set(got) == set(want) and all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want)


def test_distance_boost(spark):
    df = sigs(spark, {"file": "a.go", "name": "alpha"}, {"file": "z/y/x/w/b.go", "name": "beta"}, strings=["one_string"], n_lines=10, line=1)
    off, on = rank.rank(df, df).first(), rank.rank(df, df, boost=True).first()
    assert off.dist_boost == 1.0 and math.isclose(on.dist_boost, 1.15) and on.score > off.score
    rows = [("a.go", 10, "a.go", 160), ("a.go", 10, "a.go", 400), ("pkg/a/x.go", 1, "pkg/a/y.go", 1), ("pkg/a/x.go", 1, "pkg/b/y.go", 1), ("pkg/a/x.go", 1, "x/y/z/w/q.go", 1)]
    assert [round(v, 4) for v in values(spark, X.distance_boost("a", "b", "c", "d"), rows, "abcd")] == [1.05, 1.10, 1.0, 1.075, 1.15]
    assert values(spark, X.dir_hops("a", "b"), [("p/x.go", "p/y.go"), ("pkg/a/x", "pkg/b/y"), ("pkg/a/b/x", "x/y/z/w/q")], "ab") == [0, 2, 7]


def test_nearest(spark):
    corpus = sigs(spark, {"file": "layout.go", "name": "deriveBounds", "strings": ["bounds"], "writes": ["box.w", "box.h"], "n_lines": 5}, {"file": "flags.go", "name": "parseFlags", "n_lines": 5}, {"file": "tiny.go", "name": "computeBounds2", "strings": ["bounds"], "n_lines": 2})
    query = sigs(spark, {"file": "new.go", "name": "computeBounds", "strings": ["bounds"], "writes": ["box.w", "box.h"], "n_lines": 1})
    assert pairs(rank.nearest(query, corpus, min_score=0.15)) == [("computeBounds", "deriveBounds")]
    assert rank.nearest(corpus, corpus, min_score=0.15).where("left_key = right_key").count() == 0


def test_signatures(spark):
    good = ["(Task[])=>Promise<Task[]>", "(string)=>WorktreeInfo|null", "(ModelTier)=>ModelTier"]
    bad = ["()=>Promise<string[]>", "(string)=>Promise<boolean>", "(string,number)=>boolean", "()=>?", "", "(Record<string,unknown>)=>void"]
    assert values(spark, X.signature_informative("s"), [(x,) for x in good + bad], ["s"]) == [True] * 3 + [False] * 6
    names = [("insertTask", "updateTask"), ("addItem", "removeItem"), ("taskStart", "taskComplete"), ("getWorktreeForSession", "getWorktreeInfo"), ("findDecisions", "searchDecisions")]
    assert values(spark, X.opposed("a", "b"), names, "ab") == [True, True, True, False, False]
    w, t = "(string)=>WorktreeInfo|null", "(Task)=>void"
    df = sigs(spark, {"file": "a.ts", "name": "getWorktreeForSession", "sig": w}, {"file": "b.ts", "name": "getWorktreeInfo", "sig": w}, {"file": "c.ts", "name": "insertTask", "sig": t}, {"file": "c.ts", "name": "deleteTask", "sig": t}, {"file": "d.ts", "name": "toUpper", "sig": "(string)=>string"}, {"file": "e.ts", "name": "tiny", "sig": t, "n_lines": 2}, **{"n_lines": 10})
    assert pairs(passes.signature_candidates(df), "cross_file") == [("getWorktreeForSession", "getWorktreeInfo", True)]
    many = sigs(spark, *[{"file": f"{i}.ts", "name": f"n{i}", "sig": "(Foo)=>Bar"} for i in range(8)], n_lines=10)
    assert passes.signature_candidates(many).count() == 0
    call = sigs(spark, {"file": "a.ts", "name": "one", "calls": ["two"]}, {"file": "b.ts", "name": "two"}, n_lines=10, sig="(Foo)=>Bar")
    assert passes.signature_candidates(call).count() == 0


def test_name_stem(spark):
    df = sigs(spark, *[{"file": f"{n}.go", "name": n} for n in ("formatRemainingTime", "formatTimeRemaining", "parseConfigFile", "getUser")], n_lines=10)
    assert pairs(passes.name_stem_candidates(df)) == [("formatRemainingTime", "formatTimeRemaining")]
    many = sigs(spark, *[{"file": f"{c}.go", "name": f"thing{c}"} for c in "ABCDEFGHIJ"], n_lines=10)
    assert passes.name_stem_candidates(many).count() == 0


def test_key_sets(spark):
    h = "look go take drop give".split()
    df = sigs(spark, {"file": "engine.py", "name": "HANDLERS", "ret_keys": h}, {"file": "input_agent.py", "name": "_VERB_TEMPLATES", "ret_keys": h[:4]}, {"file": "db.py", "name": "COLUMNS", "ret_keys": ["source_era", "description", "trigger"]}, kind="table")
    assert pairs(passes.key_set_candidates(df), "jaccard", "cross_file") == [("HANDLERS", "_VERB_TEMPLATES", 0.8, True)]


def test_derivations(spark):
    r = ["road.width", "road.pieces", "terrain.height"]
    df = sigs(spark, {"file": "a.go", "name": "buildRoad", "reads": r, "writes": ["x"], "ret_keys": ["k"]}, {"file": "b.go", "name": "renderRibbon", "reads": r, "writes": ["y"], "ret_keys": ["k"]}, {"file": "c.go", "name": "adapt", "reads": r, "ret_keys": ["k"], "delegates": True}, {"file": "d.go", "name": "logWidths", "reads": r}, {"file": "e.go", "name": "unrelated", "reads": ["road.width", "a.b", "c.d"], "ret_keys": ["k"]}, n_lines=10)
    assert pairs(passes.derivation_candidates(df), "cross_file") == [("buildRoad", "renderRibbon", True)]
    flat = sigs(spark, {"file": "a.go", "name": "distanceTo"}, {"file": "b.go", "name": "headingError"}, reads=["x", "z", "hdg"], ret_keys=["v"], n_lines=10)
    assert passes.derivation_candidates(flat).count() == 0 and passes.derivation_candidates(flat, include_structural=True).count() == 1
    tests = sigs(spark, {"file": "a_test.go", "name": "aa"}, {"file": "b_test.go", "name": "bb"}, reads=r, ret_keys=["v"], n_lines=10)
    assert passes.derivation_candidates(tests).count() == 0 and passes.derivation_candidates(tests, include_tests=True).count() == 1
    mut = sigs(spark, {"file": "a.go", "name": "applyDrift"}, {"file": "b.go", "name": "applyTrim"}, reads=r, writes=["v"], n_lines=10)
    assert passes.derivation_candidates(mut).count() == 0 and passes.derivation_candidates(mut, include_mutators=True).count() == 1


def test_op_types(spark):
    df = sigs(spark, *[{"file": "a.go", "name": n, "ret_keys": r, "writes": w} for n, r, w in (("sampleEdge", [], []), ("projectPoint", [], []), ("continuity", [], []), ("buildRibbon", ["k"], []), ("applyThrottle", [], ["w"]), ("frobnicate", [], []))])
    got = {r.name: r.op for r in df.select("name", X.op_type("stem", "s_ret", "s_writes").alias("op")).collect()}
    assert got == {"sampleEdge": "forward-map", "projectPoint": "inverse-search", "continuity": "measure", "buildRibbon": "construct", "applyThrottle": "mutate", "frobnicate": ""}


def test_values_and_context(spark):
    v = sigs(spark, {"file": "a.go", "qualname": "f.maxRetries#value@1.0", "name": "maxRetries"}, {"file": "a.go", "qualname": "g.maxRetries#value@2.0", "name": "maxRetries"}, {"file": "a.go", "qualname": "gridSize#value@3.0", "name": "gridSize"}, kind="value-site", value="3")
    assert passes.value_site_candidates(v).count() == 1 and passes.value_site_candidates(v, min_jaccard=0).count() == 3
    rows = [{"file": "a.go", "name": "alpha", "calls": ["checkLimit"], "call_result_shapes": {"checkLimit": ["ret-nil-checked"]}}, {"file": "b.go", "name": "alpha", "calls": ["verifyQuota"], "call_result_shapes": {"verifyQuota": ["ret-nil-checked"]}}]
    rows += [{"file": "c.go", "name": "beta", "calls": ["otherThing"], "call_result_shapes": {"otherThing": ["ret-compared"]}}, *[{"file": f"{n}.go", "name": n} for n in ("checkLimit", "verifyQuota", "otherThing")]]
    assert pairs(passes.call_context_candidates(sigs(spark, *rows, n_lines=6))) == [("checkLimit", "verifyQuota")]


def test_touchpoint(spark):
    fill = lambda k, i: [f"uniq{k}{i}{x}" for x in range(12)]
    df = sigs(spark, *[{"file": f"{i}.py", "qualname": q, "name": q.split(".")[-1], "calls": ["_parse_cmd", *fill("c", i)], "strings": ["_canon_cache", *fill("s", i)], "writes": ["_canon_cache", *fill("w", i)]} for i, q in enumerate(("Engine.step", "Session.stepWeb", "Engine.run"))], n_lines=40)
    (c,) = touchpoint.clusters(df).collect()
    assert len(c.members) == 3 and set(c.shared) == {"_parse_cmd", "_canon_cache"} and math.isclose(c.score, 2 / 3 * 1.6)
    assert touchpoint.clusters(sigs(spark, *[{"file": f"{i}.py", "name": f"n{i}", "calls": ["_helper"]} for i in range(12)], n_lines=40)).count() == 0
    assert values(spark, X.is_seam("s"), [(s,) for s in ("_parse_cmd", "parseCmd", "Printf", "Step", "__init__", "i")], ["s"]) == [True, True, False, False, False, False]
    assert values(spark, X.is_domain_const("s"), [(s,) for s in "V_BELOW MAX_RETRIES ABC PI vBelow _FOO".split()], ["s"]) == [True, True, True, False, False, False]
    out = sigs(spark, *[{"file": f"{i}.rs", "name": f"fn{i}", "calls": ["geomKernel", "spanMath"]} for i in range(3)], n_lines=10)
    assert touchpoint.clusters(out).count() == 0
    inside = out.unionByName(sigs(spark, {"file": "k.rs", "name": "geomKernel", "n_lines": 1}, {"file": "k.rs", "name": "spanMath", "n_lines": 1}))
    assert touchpoint.clusters(inside).count() == 1
    (p,) = touchpoint.role_proposals(sigs(spark, *[{"file": f"{f}.go", "name": f"{f.upper()}f", "calls": ["_seam"]} for f in "abc"], n_lines=6)).collect()
    assert (p.predicate, p.name, p.approximate, p.expected) == ("calls:_seam", "seam", False, 3)


def test_confessions(spark):
    text = "package p\n\n// computeAudit mirrors classifyThrough exactly — keep in sync.\nfunc computeAudit() {\n}\n\nfunc classifyThrough() {\n}\n"
    files = spark.createDataFrame([("a.go", text)], "file string, text string")
    df = sigs(spark, {"file": "a.go", "name": "computeAudit", "line": 4, "n_lines": 2}, {"file": "a.go", "name": "classifyThrough", "line": 7, "n_lines": 2})
    (c,) = confess.confessions(df, files).collect()
    assert (c.key, c.line, c.phrase, c.register) == ("a.go::computeAudit", 3, "mirrors", "line")
    assert pairs(confess.confession_candidates(confess.confessions(df, files), df)) == [("computeAudit", "classifyThrough")]


REGISTRY = """# notes
- pair: a.go::A | b.go::B
- verdict: drift (2026) see below
- canonical: a.go::A
- pair: b.go::B | a.go::A
- verdict: false-alarm
- pair: c.go::C | d.go::D
- cluster: x::1 | y::2 | z::3
- verdict: contracted-twin-ok
- family: evals/tasks/**::main | evals/tasks/**::main
- verdict: false-alarm
- role: parser
- predicate: name:/Parse/
- baseline: a.go::A.Parse
"""


def test_registry(spark):
    parsed = registry.entries(spark.createDataFrame([("registry.md", REGISTRY)], "file string, text string"))
    (p,) = registry.pairs(parsed).collect()
    assert (p.key1, p.key2, p.cls, p.canonical) == ("a.go::A", "b.go::B", "drift", "a.go::A")
    assert registry.clusters(parsed).count() == 1 and registry.families(parsed).count() == 1
    (r,) = registry.roles(parsed).collect()
    assert (r.role, r.expected, r.baseline) == ("parser", 1, ["a.go::A.Parse"])
    cand = spark.createDataFrame([("b.go::B", "a.go::A"), ("e.go::E", "f.go::F"), ("evals/tasks/x/y.py::main", "evals/tasks/z.py::main")], "left_key string, right_key string")
    fam = [f.asDict() for f in registry.families(parsed).collect()]
    assert pairs(registry.fresh(cand, registry.pairs(parsed), fam)) == [("E", "F")]
    live = spark.createDataFrame([("a.go::A",), ("b.go::B",)], "key string")
    alive = registry.liveness(registry.pairs(parsed), live, spark.createDataFrame([("a.go",), ("b.go",)], "file string"), [".go"])
    assert [r.state for r in alive.collect()] == ["live"] and registry.unresolved_drift(alive).count() == 1
    gone = registry.liveness(registry.pairs(parsed), live, spark.createDataFrame([("a.go",)], "file string"), [".go"])
    assert [r.state for r in gone.collect()] == ["stale"]
    text = registry.pruned(spark.createDataFrame([("registry.md", REGISTRY)], "file string, text string"), registry.pairs(parsed)).first().text
    assert "a.go::A | b.go::B" not in text and "c.go::C" in text and text.startswith("# notes")


def test_roles(spark):
    df = sigs(spark, {"file": "a.go", "qualname": "A.Parse", "name": "Parse"}, {"file": "b.go", "qualname": "B.Parse", "name": "Parse"}, {"file": "c.go", "qualname": "C.Parse", "name": "Parse", "delegates": True})
    (r,) = registry.cardinality(df, [{"role": "p", "predicate": "name:/Parse/", "expected": 1, "baseline": ["a.go::A.Parse"]}]).collect()
    assert (r.found, r.over, r.vacuous, r.novel) == (2, True, False, 1)
    for bad in ("", "shape:x", "name:Parse"):
        with pytest.raises(ValueError):
            registry.predicate(bad)


def test_migration(spark):
    old = "- left: a.go::A\n- right: b.go::B\n- verdict: contracted-twin-ok (collapsed) — was drift\n- reviewed: 2026-06-05 by someone\n```\n- left: x\n- right: y\n```"
    new = registry.migrated(spark.createDataFrame([("r.md", old)], "file string, text string")).first().text
    assert new.split("\n")[1:5] == ["- right: b.go::B", "- pair: a.go::A | b.go::B", "- verdict: contracted-twin-ok", "- reviewed: 2026-06-05"] and new.endswith("- right: y\n```")


def test_calibration(spark):
    s = spark.createDataFrame([(0.1, 0.9, 0.1, 0.1, 0.1, True)] * 20 + [(0.1, 0.0, 0.1, 0.1, 0.1, False)] * 20, "strings double, writes double, name double, calls double, ret double, useful boolean")
    r = calibrate.calibrated(s, prior_strength=5).first()
    assert math.isclose(r["lambda"], 40 / 45) and math.isclose(r.w_writes, 40 / 45 + 5 / 45 * 0.3, abs_tol=1e-9)
    one = calibrate.calibrated(s.where("useful")).first()
    assert math.isclose(one.w_strings, 0.30) and one["lambda"] == 0
    cells = [("d", "go", "x", v) for v in ["drift"] * 2 + ["false-alarm"] * 10] + [("e", "go", "x", v) for v in ["drift"] * 3 + ["contracted-twin-ok"] * 2 + ["false-alarm"] * 2] + [("f", "go", "x", "drift")] * 4
    got = {(r.detector, r.lang, r.variety): r.call for r in calibrate.ablation(spark.createDataFrame(cells, "detector string, lang string, variety string, verdict string")).collect()}
    assert got["d", None, None] == "prune?" and got["e", "go", "x"] == "pulls-weight" and got["f", "go", None] == "insufficient"


def test_test_paths(spark):
    yes = "a/tests/x.go a_test.go x_test.py test_x.py conftest.py a/tests.rs a/test.rs x_test.rs a.test.ts a.spec.js a/__tests__/b.ts testdata/a.go A/Test/b.py".split()
    no = "a.go testing.py contest.py src/latest.rs attest.go protest/a.py spec.py".split()
    assert values(spark, X.is_test_path("p"), [(p,) for p in yes + no], ["p"]) == [True] * len(yes) + [False] * len(no)


def test_globs(spark):
    rows = [("a/b/c.go",), ("c.go",), ("a/c.py",)]
    assert values(spark, X.match_any("p", ["**/*.go"]), rows, ["p"]) == [True, True, False]
    assert values(spark, X.match_any("p", ["*.go"]), rows, ["p"]) == [False, True, False]


PY = '''
V_BELOW = -1.0
HANDLERS = {"look": "aaa", "go": "bbb", "take": 1}
small = {"a": 1}

class Vehicle:
    def derive(self, w: int, h: "Q") -> "Widget":
        """doc of it"""
        w = self.road.compute(); h = self.terrain.height
        self.state.count += 1
        self.cache["k"] = V_BELOW
        return {"w": w, "h": h}

def collect(xs: List[str], b) -> Optional[str]:
    return self._impl.collect(xs)
'''


def test_python_extractor(spark):
    files = spark.createDataFrame([("v.py", PY), ("bad.py", "def ("), ("s.sql", "CREATE TABLE t (a INT, -- x, y\n b DECIMAL(10,2), PRIMARY KEY (a));"), ("j.json", '{"id": 1, "name": "x", "t": [{"a": 1, "b": 2}, {"b": 1, "a": 3}]}')], "file string, text string")
    f = {r.qualname: r for r in extract.functions(files).collect()}
    d = f["Vehicle.derive"]
    assert set(d.reads) == {"road", "terrain", "terrain.height", "state", "state.count", "cache"} and set(d.writes) == {"state.count", "cache[]"} and d.ret_keys == ["h", "w"] and d.calls == ["compute"]
    assert d.consts == ["V_BELOW"] and d.decl_consts == ["HANDLERS", "V_BELOW"] and d.sig == "(int,'Q')=>'Widget'" and f["collect"].delegates and f["collect"].sig == "(List[str],?)=>Optional[str]"
    s = {(r.kind, r.qualname): r.ret_keys for r in extract.symbols(files).collect()}
    assert s == {("table", "HANDLERS"): ["go", "look", "take"], ("corpus-field", "j"): ["id", "name", "t"], ("corpus-field", "j.t"): ["a", "b"], ("sql-table", "t"): ["a", "b"]}
    masked = extract.script_parts("<p>x</p>\n<script lang='ts'>let a=1</script>\n<b>")
    assert masked.split("\n")[1].strip() == "let a=1" and masked.count("\n") == 2


def test_label_helpers(spark):
    assert values(spark, X.fire_id(F.lit("pair"), "k"), [("a",)], ["k"])[0] == __import__("hashlib").sha256(b"pair\x00a").hexdigest()[:10]
    assert values(spark, X.resolve_label("v", "t"), [("drift x", None), (None, "mixed"), (None, None)], "v string, t string".replace(" string", "").split(", ")) == ["useful", "mixed", "untagged"]
    assert values(spark, X.variety_of("s"), [("reads [a/b] {c}",), ("none",)], ["s"]) == ["a/b", ""]
    assert values(spark, X.stem_key("s"), [("slot-testing",), ("abilities",), ("is",)], ["s"]) == ["slot-test", "abilit", "is"]
    assert values(spark, X.escape_property("s"), [("50%: a,b\n",)], ["s"]) == ["50%25%3A a%2Cb%0A"]
