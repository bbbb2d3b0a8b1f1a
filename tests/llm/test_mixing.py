"""The mix against brute force and against its targets as they are before any rounding."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from driftlens.llm import mixing
from tests.llm.test_llm import EXTRA, documents

CLASHES = ["b_s", "b_cut", "s_tier", "p_slot", "mix_slot", "mix_tier", "mix_at", "tier", "rank", "slot", "w", "p", *EXTRA]


def _edf(shares, period):
    """Slots of one period: shares {rank: n}."""
    had, out = dict.fromkeys(shares, 0), []
    for t in range(period):
        _, s = min((-(-(had[s] + 1) * period // n), s) for s, n in shares.items() if had[s] < n and had[s] * period // n <= t)
        out.append((s, had[s]))
        had[s] += 1
    return out


def _off(got, sizes, targets, unit):
    """Largest distance in units of any source from its target, after any slot up to which it has not run out."""
    total, of = sum(targets.values()), {r.mix_slot: r.source for r in got}
    had, worst = collections.Counter(), 0
    for t in range(max(of) + 1):
        if t in of:
            had[of[t]] += 1
        worst = max([worst, *(abs(had[s] - w / total * (t + 1)) for s, w in targets.items() if had[s] < -(-sizes[s] // unit))])
    return worst


def _rows(rng, names, weights, n):
    return [(i, "t", "en", rng.choices(names, weights)[0]) for i in range(n)]


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = _rows(rng, ["hot", "b", "c", None], [6, 3, 2, 1], 9000) + [(1, "t", "en", "b")] * 3 + [(None, None, None, "c")]
    got = mixing.placed(documents(spark, rows), block_docs=3).collect()
    sizes = collections.Counter(r[3] for r in rows)
    order = sorted(sizes, key=lambda s: (s is not None, s))
    w = {s: sizes[s] ** mixing.TEMPER for s in order}
    total, spare, run, cut = sum(w.values()), mixing.UNIT - len(order), 0.0, [0]
    for k, s in enumerate(order, 1):
        run += w[s]
        cut.append(mixing.UNIT if k == len(order) else round(run / total * spare) + k)
    upto = lambda k, t: cut[k] * t // mixing.UNIT
    want, left = {}, dict(sizes)
    for p in range(9):
        a, b = p * mixing.PERIOD, (p + 1) * mixing.PERIOD
        had = [upto(k + 1, a) - upto(k, a) for k in range(len(order))]
        for t, (k, j) in enumerate(_edf({k: upto(k + 1, b) - upto(k, b) - had[k] for k in range(len(order))}, mixing.PERIOD)):
            if had[k] + j < left[order[k]]:
                want[a + t] = order[k]
    assert {r.mix_slot: r.source for r in got} == want and len(got) == len(rows) == len(want)


@pytest.mark.parametrize("block", [3, 16])
def test_targets(spark, block):
    rng = random.Random(2)
    names = ["hot", None, *[f"s{i}" for i in range(18)]]
    rows = _rows(rng, names, [10, *[1] * 19], 20000) + [(1, "t", "en", "hot")] * 3
    sizes = collections.Counter(r[3] for r in rows)
    got = mixing.placed(documents(spark, rows), block_docs=block).collect()
    unit = block // 3
    first = [r for r in got if r.mix_at == 0]
    assert len(got) == len(rows) and {r.mix_tier for r in got} == {0} and collections.Counter((r.mix_slot, r.mix_at) for r in got).most_common(1)[0][1] == 1
    assert len({r.mix_slot for r in got}) == len(first) and all(len({x.source for x in g}) == 1 for g in [[r for r in got if r.mix_slot == s] for s in (0, 1, 2, 77)])
    assert _off(first, sizes, {s: n**mixing.TEMPER for s, n in sizes.items()}, unit) < 2


def test_levels_and_tail(spark):
    """Weights from 1 to a thousandth of a thousandth; a source that is left over long after all others."""
    rng = random.Random(3)
    rows = _rows(rng, ["a", "b"], [2, 1], 15000) + [(20000 + i, "t", "en", f"t{i % 5}") for i in range(25)]
    targets = {"a": 2.0, "b": 1.0, "t0": 1e-3, "t1": 2e-4, "t2": 1e-6, "t3": 5e-7, "t4": 1e-3}
    sizes = collections.Counter(r[3] for r in rows)
    levels = mixing.weighed(spark.createDataFrame(list(sizes.items()), "source string, n long"), targets, 1.0, 1).collect()
    assert {r.source: r.level for r in levels}["a"] == 1 and max(r.level for r in levels) > 1
    got = mixing.placed(documents(spark, rows), targets, block_docs=3).collect()
    assert len(got) == len(rows) and collections.Counter((r.doc_id) for r in got).most_common(1)[0][1] == 1
    near = [r for r in got if r.mix_slot < 30000]
    assert _off([r for r in near if r.source in targets], sizes, targets, 1) < 2.01
    ordered = collections.defaultdict(list)
    for r in got:
        ordered[r.source].append(r.mix_slot)
    assert all(len(set(x)) == len(x) for x in ordered.values())
    late = {s: max(x) for s, x in ordered.items()}
    assert late["t2"] > 1e6 and late["t3"] > 2 * late["t2"] * 0.8  # at their own pace


def test_defined_results(spark):
    rng = random.Random(4)
    rows = _rows(rng, ["hot", "b", "c", None], [6, 3, 2, 1], 900) + [(1, "t", "en", "b")] * 3 + [(None, None, None, "c")]
    docs = documents(spark, rows)
    named = mixing.placed(docs, {"b": 3.0, "hot": 1.0, "gone": 2.0, "c": 0.0}, block_docs=4).collect()
    assert len(named) == len(rows) and all((r.mix_tier == 0) == (r.source in ("b", "hot")) for r in named)
    clash = docs.withColumns({c: F.lit("x") for c in CLASHES})
    out = mixing.mixed(clash, block_docs=3)
    assert out.columns == clash.columns and out.count() == len(rows) and {r.mix_slot for r in out.collect()} == {"x"}
    placed = mixing.placed(clash, block_docs=3)
    assert sorted(placed.columns) == sorted(clash.columns) and {(r.doc_id, r.mix_slot, r.mix_at) for r in placed.collect()} == {(r.doc_id, r.mix_slot, r.mix_at) for r in mixing.placed(docs, block_docs=3).collect()}
    assert mixing.placed(documents(spark, [])).count() == 0 and mixing.mixed(documents(spark, [])).count() == 0
    assert mixing.placed(docs, {}, block_docs=4).count() == len(rows)


def test_order_of_files(spark, tmp_path):
    rng = random.Random(8)
    docs = documents(spark, _rows(rng, ["hot", "b", "c"], [6, 3, 2], 3000))
    at = {r.doc_id: (r.mix_tier, r.mix_slot, r.mix_at) for r in mixing.placed(docs).collect()}
    mixing.mixed(docs).write.parquet(str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out")).select("doc_id", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()
    assert [at[r.doc_id] for r in back] == sorted(at.values())
