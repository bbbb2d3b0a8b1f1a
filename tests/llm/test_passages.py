"""Repeated passages against brute force over every run of words."""

import collections
import hashlib
import random
import re

import duckdb
import pandas as pd
import pytest

from driftlens.llm import passages
from tests.llm.test_llm import documents, words


def test_words_are_hashed_in_numpy(monkeypatch):
    """No call a word, which was most of the time of the pipeline's third stage; words are equal if they are in lower case."""
    calls, blake2b = [], hashlib.blake2b
    monkeypatch.setattr(hashlib, "blake2b", lambda *a, **k: calls.append(a) or blake2b(*a, **k))
    rng = random.Random(4)
    texts = [words(rng, 900, 10**6) for _ in range(3)]
    texts += ["İstanbul ΑΣ Σας ab\0c ab a\0 \0 \0\0 \U0010ffff\U0010ffff \u3000x\x1cX ", "", "y" * 63 + " " + "Y" * 63 + " é" * 60, "y" * 64 + " " + "Y" * 64]
    texts += ["".join(rng.choice("aA bİ\0\nΣ\u3000𝒜") for _ in range(300)) for _ in range(50)]
    joined = "\n".join(texts)
    w, of = passages._Words(texts), collections.defaultdict(set)
    lower = joined.lower().split()
    assert len(calls) == 2 and [joined[s:e] for s, e in zip(w.starts, w.ends)] == joined.split()
    for word, x in zip(lower, w.x.tolist(), strict=True):
        of[word].add(x)
    assert all(len(v) == 1 for v in of.values()) and len(set(w.x.tolist())) == len(of)


def _brute(rows):
    """Spans of each row from every run of PASSAGE words, in the stated order."""
    seen, out, n = {}, collections.defaultdict(list), passages.PASSAGE
    for i, text in sorted({r[:2] for r in rows if r[1]}, key=lambda r: (r[0] is None, r[0] or 0)):
        at = [m.span() for m in re.finditer(r"\S+", text)]
        w = text.lower().split()
        for k in range(len(w) - n + 1):
            start, end = at[k][0], at[k + n - 1][1]
            j, first_start, first_end = seen.setdefault(tuple(w[k : k + n]), (i, start, end))
            if (j, first_start) == (i, start):
                continue
            if j == i:
                start = max(start, first_end)
            mine = out[i, text]
            if mine and start <= mine[-1][1]:
                mine[-1][1] = max(mine[-1][1], end)
            else:
                mine.append([start, end])
    ids = collections.defaultdict(list)
    for (i, _), spans in out.items():
        ids[i] += map(tuple, spans)
    return {k: sorted(v) for k, v in ids.items() if v}


def _corpus():
    rng = random.Random(6)
    p, q = words(rng, 57, 5000), words(rng, 110, 5000)
    wrapped = "\n".join(" ".join(q.split()[k : k + 9]) for k in range(0, 110, 9))
    rows = [
        (1, p, "en", "s"),
        (2, f"{words(rng, 40)} {p.title()} {words(rng, 51)}\nend", "en", "s"),  # inside a longer line
        (3, f"{words(rng, 30)} {q} {words(rng, 30)}", "en", "s"),
        (4, f"top {wrapped}\ntail", "en", "s"),  # over many short lines
        (5, f"x {' '.join(p.split()[:49])} y {' '.join(q.split()[60:])}", "en", "s"),  # one word too short, and just long enough
        (6, "a b c " * 60, "en", "s"),  # periodic
        (7, "b c a " * 40, "en", "s"),
        (8, f"{q} and again {q}", "en", "s"),
        (None, f"é {p}", None, None),
        (9, None, "en", "s"),
        (10, "", "en", "s"),
        (2, f"{words(random.Random(1), 60)}", "en", "s"),
        (3, None, "en", "s"),
    ]
    rows += [rows[3]]
    rows += [(20 + i, rows[1][1], "en", "s") for i in range(5)]  # copies of a text whose passage is kept elsewhere
    rows += [(30 + i, f"  {words(random.Random(2), 70)}\n", "en", "s") for i in (2, 0, 1)] + [(None, f"  {words(random.Random(2), 70)}\n", "en", "s")] * 2
    rows += [(40 + i, "short copies", "en", "s") for i in range(3)]
    rows += [(50, f"{p} {q} " * 300, "en", "s")]  # very long
    return rows, p


@pytest.mark.parametrize("most, least", [(1024, 1000), (10**6, 0), (8, 3)])
def test_passages(spark, monkeypatch, most, least):
    monkeypatch.setattr(passages, "MOST", most)
    monkeypatch.setattr(passages, "LEAST_HOT", least)  # 0: everything that repeats is hot
    rows, p = _corpus()
    got = collections.defaultdict(set)
    found = passages.report(documents(spark, rows, True)).collect()
    for r in found:
        got[r.doc_id].add((r.start_char, r.end_char))
    assert {k: sorted(v) for k, v in got.items()} == _brute(rows)
    assert {2, 4, 5, 6, 7, 8, 50, None, *range(20, 25), 31, 32} == set(got)
    frame = pd.DataFrame([r[:2] for r in rows], columns=["doc_id", "text"]).astype({"doc_id": "Int64"})
    con = duckdb.connect()
    con.register("documents", frame)
    assert sorted(map(tuple, found), key=repr) == sorted(con.sql(passages.oracle_sql()).fetchall(), key=repr)


def test_without_repeats(spark):
    rows, p = _corpus()
    docs, out = documents(spark, rows, True), {}
    cut = passages.without_repeats(docs)
    assert cut.columns == docs.columns
    for r in cut.collect():
        out.setdefault((r.doc_id, r.source), []).append(r.text)
        assert r.text is None or r.n_chars == len(r.text)
    assert sum(map(len, out.values())) == len(rows)
    all_of = " ".join(t or "" for ts in out.values() for t in ts[:1]).lower()
    assert all_of.count(p) == 1 and out[4, "s"] == ["top \ntail"] * 2 and out[8, "s"] == ["and again "] and out[31, "s"] == ["  \n"] and out[41, "s"] == ["short copies"]
    assert passages.report(documents(spark, [])).count() == 0 and passages.without_repeats(documents(spark, [])).count() == 0
