"""Operators of the llm subpackage against brute force, on fixtures with nulls, ties, repeated rows, clashing names and empty tables."""

import collections
import hashlib
import itertools
import json
import math
import os
import random
import re
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftlens.llm import bpe, dartminhash, htmlcut, langid, media, records, rpforest, urlrules
from driftlens.llm.common import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TOK = tokenizer_path()
EXTRA = ["cuts", "units", "row", "key", "node", "bucket", "label", "n", "slot", "host", "evidence"]


def words(rng, n, size=300):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def documents(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, l, s, None if t is None else len(t)) for i, t, l, s in rows], SCHEMA)
    return df.withColumns({c: F.lit("x") for c in EXTRA}) if extra else df


EDGE = [(1, None, None, None), (2, "", "en", "s"), (None, "hello there", "en", None), (3, "a", None, "s"), (3, "a", None, "s"), (4, "<|endoftext|>x", "en", "s"), (5, "é" * 40_000, "fr", "s"), (None, None, None, None)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOK)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text() | st.sampled_from(["<|endoftext|>", "don't we'll", "  \n x", "a" * 300, "''s '"]), max_size=6))
def test_bpe_fuzz(library, parts):
    text = "".join(parts)
    want = library.encode(text, add_special_tokens=False).ids
    got = bpe.load(TOK).encode_bytes(text)
    assert np.frombuffer(got, "<u4").tolist() == want and bpe.load(TOK).decode_bytes(got) == library.decode(want, skip_special_tokens=False)


def test_bpe_cuts():
    b = bpe.load(TOK)
    for f in b.fragments("naïve ☃☃ über".encode()):
        assert all(b.joinable[x << 8 | y] for x, y in zip(f, f[1:]))
    assert b"".join(b.fragments(b"\xff\xfeab")) == b"\xff\xfeab" and b.decode_bytes(struct.pack("<I", b.byte_id[0xFF])) == "�"


def test_bpe_query(spark, library):
    got = sorted(map(tuple, bpe.round_trip_digests(documents(spark, EDGE, True), TOK).collect()), key=repr)
    want = []
    for i, t, _, _ in EDGE:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.round_trip_digests(documents(spark, []), TOK).count() == 0


def test_records(spark, library):
    got = records.digests(documents(spark, EDGE, True), TOK, 2).collect()
    order = sorted(EDGE, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, start = [], 0
    for i, t, _, _ in order:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert records.digests(documents(spark, []), TOK, 2).count() == 0


def test_records_by_index(spark, library):
    rng = random.Random(7)
    rows = [(rng.choice([i, None]), rng.choice(["", None, words(rng, rng.randrange(1, 90)), "é" * 30_000]), "en", "s") for i in range(60)]
    folder = records.new_folder(spark, "records")
    manifest = records.write(documents(spark, rows), folder, TOK, 2)
    want = [(r.key, r.ids) for r in records.read_records(spark, folder, manifest).orderBy("start").collect()]
    places = [(m.part, k) for m in manifest.orderBy("part").collect() for k in range(m.n_records)]
    asked = list(enumerate(places)) * 2
    rng.shuffle(asked)
    got = {(r.part, r.nth): (r.key, r.ids) for r in records.fetch(spark.createDataFrame([p for _, p in asked], "part int, nth long"), folder).collect()}
    assert len(got) == len(rows) == len(want) and all(got[p] == want[i] for i, p in asked)
    starts = [r.start for r in records.fetch(spark.createDataFrame([p for p in places if p[0] == places[0][0]], "part int, nth long"), folder).orderBy("nth").collect()]
    assert starts == [sum(len(x[1]) // 4 for x in want[:i]) for i in range(len(starts))]


def test_broken_records(tmp_path):
    import io

    good = records.frame(b"payload") + records.frame(b"")
    assert list(records._records(io.BytesIO(good))) == [b"payload", b""]
    for bad in (good[:-1], bytes([good[0] ^ 1]) + good[1:], good[:14] + b"X" + good[15:]):
        with pytest.raises(ValueError):
            list(records._records(io.BytesIO(bad)))


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=1, max_size=2000))
def test_media_round_trip(data):
    payload = data + bytes(-len(data) % 64)
    assert b"".join(p.payload() for p in media.pictures(media.store(payload))) == payload


def test_media_parts_and_errors():
    payload = os.urandom(media.PART + 640)
    stored = media.store(payload)
    found = list(media.pictures(stored))
    assert len(found) == 2 and b"".join(p.payload() for p in found) == payload
    for bad in (b"", b"xx", stored[:200]):
        with pytest.raises((ValueError, IndexError, struct.error)):
            media.Picture(bad)


class _Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [(value >> (n - 1 - i)) & 1 for i in range(n)]


def _category(v):
    n = abs(v).bit_length()
    return n, v if v >= 0 else v + (1 << n) - 1


def test_progressive_decoder_general():
    """One grey plane of sparse coefficients, written bit by bit with runs, end-of-band runs and refinement."""
    rng = random.Random(3)
    blocks = [[rng.choice([0, 0, 0, 0, 1, -1, 2, -3, 5, -9]) if k else rng.randrange(-50, 50) for k in range(64)] for _ in range(6)]
    every = [*range(255)]
    lengths = bytes([0] * 7 + [255] + [0] * 8)
    segment = lambda m, b: struct.pack(">BBH", 255, m, len(b) + 2) + b
    out = b"\xff\xd8" + segment(0xDB, bytes([0]) + bytes([1] * 64)) + segment(0xC2, struct.pack(">BHHB", 8, 16, 24, 1) + bytes([1, 0x11, 0]))
    out += segment(0xC4, bytes([0]) + lengths + bytes(every) + bytes([0x10]) + lengths + bytes(every))
    code = lambda w, s: w.put(s, 8)
    scan = lambda a, b, h, l, w: segment(0xDA, bytes([1, 1, 0, a, b, h << 4 | l])) + media._pack(np.array(w.bits))
    w, last = _Writer(), 0
    for b in blocks:
        n, v = _category((b[0] >> 1) - last)
        last = b[0] >> 1
        code(w, n), w.put(v, n)
    out += scan(0, 0, 0, 1, w)
    half = lambda v: int(v / 2)
    w, run = _Writer(), 0
    for b in blocks:
        zero, sent = 0, [(k, half(b[k])) for k in range(1, 64) if half(b[k])]
        if not sent:
            run += 1
            continue
        if run:
            n = run.bit_length() - 1
            code(w, n << 4), w.put(run - (1 << n), n)
            run = 0
        at = 1
        for k, v in sent:
            zero = k - at
            while zero > 15:
                code(w, 0xF0)
                zero -= 16
            n, x = _category(v)
            code(w, zero << 4 | n), w.put(x, n)
            at = k + 1
        if at < 64:
            run += 1
    if run:
        n = run.bit_length() - 1
        code(w, n << 4), w.put(run - (1 << n), n)
    out += scan(1, 63, 0, 1, w)
    w = _Writer()
    for b in blocks:
        w.put(b[0] & 1, 1)
    out += scan(0, 0, 1, 0, w)
    w = _Writer()
    for b in blocks:
        k = 1
        while k < 64:
            new = [i for i in range(k, 64) if abs(b[i]) == 1]
            if not new:
                code(w, 0)
                for i in range(k, 64):
                    if half(b[i]):
                        w.put(abs(b[i]) & 1, 1)
                break
            zeros, pend, i, target = 0, [], k, new[0]
            while True:
                if half(b[i]):
                    pend.append(abs(b[i]) & 1)
                elif i == target:
                    break
                else:
                    zeros += 1
                    if zeros == 16:
                        break
                i += 1
            if zeros == 16:
                code(w, 0xF0)
            else:
                code(w, zeros << 4 | 1), w.put(int(b[i] > 0), 1)
            for x in pend:
                w.put(x, 1)
            k = i + 1
    out += scan(1, 63, 1, 0, w) + b"\xff\xd9"
    p = media.Picture(out)
    assert p.planes[1].reshape(-1, 64).tolist() == blocks
    # the inverse transform against the sum of its definition
    c = lambda u: math.sqrt(0.5) if u == 0 else 1.0
    natural = [0] * 64
    for k, v in enumerate(blocks[0]):
        natural[int(media.ZIGZAG[k])] = v
    x, y = 3, 5
    s = sum(c(u) * c(v) * natural[8 * v + u] * math.cos((2 * x + 1) * u * math.pi / 16) * math.cos((2 * y + 1) * v * math.pi / 16) for u in range(8) for v in range(8)) / 4 + 128
    assert abs(int(p.rgb()[y, x, 0]) - min(255, max(0, round(s)))) <= 1 and p.rgb().shape == (16, 24, 3)


def test_media_query(spark):
    rows = {r.doc_id: r for r in media.digests(documents(spark, [r for r in EDGE if r[0]], True)).collect()}
    for i, t, _, _ in EDGE:
        if i:
            p = media.payload_of(t)
            assert (rows[i].n_bytes, rows[i].payload_bytes, rows[i].payload_sha256, rows[i].tail_crc32) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert rows[1].feature == rows[2].feature and media.digests(documents(spark, [])).count() == 0


def test_media_tensors(spark):
    good = media.store(media.payload_of("some text " * 60))
    df = spark.createDataFrame([(1, good), (2, None), (3, b""), (4, good[:300]), (5, b"GIF89a"), (None, good)], "id long, media binary")
    got = {r.id: r.t for r in df.select("id", media.tensors(F.col("media")).alias("t")).collect()}
    want = media.Picture(good).rgb()
    for i in (1, None):
        assert np.array_equal(np.frombuffer(got[i].rgb, np.uint8).reshape(got[i].height, got[i].width, 3), want) and got[i].error is None
    assert got[2][:2] == got[3][:2] == (0, 0) and not got[2].rgb
    assert all(got[i].rgb is None and got[i].error for i in (4, 5))


def test_media_long_text_and_null_ids(spark):
    long = "a very long text " * 200_000
    docs = documents(spark, [(None, long, "en", "s"), (None, None, None, None), (1, long, "en", "s")])
    got = media.digests(docs).collect()
    assert sorted((r.doc_id is None, r.n_bytes) for r in got) == [(False, len(long)), (True, 0), (True, len(long))]
    assert len({(r.payload_sha256, r.media_sha256, r.feature) for r in got if r.n_bytes}) == 1 and all(r.payload_sha256 == hashlib.sha256(media.payload_of(long)).hexdigest() for r in got if r.n_bytes)


def test_language(spark):
    rng = random.Random(1)
    make = {"en": "the of and tion ing that with er ".split(), "de": "der die und sch ung keit für über ".split()}
    text = lambda l, n: " ".join("".join(rng.choices(make[l], k=2)) for _ in range(n))
    rows = [(i, text(l, 30), l, f"s{i % 3}") for i, l in enumerate(["en", "de"] * 60)]
    rows += [(900, text("de", 60), "en", "s1"), (901, None, "en", "s1"), (902, "", None, None), (903, "x", "zz", ""), (904, " ".join("".join(rng.choices("qxzjkvw", k=9)) for _ in range(80)), None, "s1")]
    got = {r.doc_id: r for r in langid.report(documents(spark, rows, True)).collect()}
    assert len(got) == len(rows) and all(got[i].lang == l and got[i].keep for i, _, l, _ in rows[:120])
    assert got[900].lang == "de" and got[901].keep and got[902].keep and got[903].keep and not got[904].keep
    kept = langid.accepted(documents(spark, rows, True))
    assert kept.columns == documents(spark, rows, True).columns and {r.doc_id for r in kept.collect()} == set(got) - {904}
    assert langid.report(documents(spark, [])).count() == 0
    assert all(r.keep for r in langid.report(documents(spark, [(1, "abc", None, "s")])).collect())


def test_host_evidence(spark):
    pages = spark.createDataFrame([("https://a.x.org/1", '<html lang="DE-at">'), ("x", None), (None, "<p>")], "url string, html string")
    got = [tuple(r) for r in pages.select(langid.host_of(F.col("url")), langid.declared_of(F.col("html"))).collect()]
    assert got == [("a.x.org", "de"), (None, None), (None, None)]


PAGE = """<!doctype html><html><head><title>no</title><style>p{}</style></head><body class="page"><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a><li><a href=/a>About us</a></ul></nav>
<div class="cookie-notice"><p>We use cookies to make this site work as you would like it to.</p></div><main><article><h1>A &amp; B</h1><p>First   <b>bold</b>&nbsp;text
of it.<br>Next line.<script>var x = "</p>";</script><p>Of.</p><div class="share-buttons"><a href=#>Share</a></div><blockquote>Quoted words here.</blockquote><ul><li>one<li>two</ul><form><label>Mail</label><input></form>
<section id="comments"><h2>Comments</h2><p>I liked this article very much, thank you for it.</p></section></article></main><aside><p>Related things that you may want to read as well today.</p></aside><footer>&copy; x</footer><p hidden>no</p><div cla"""


def test_html():
    assert htmlcut.main_text(PAGE) == "A & B\nFirst bold text of it. Next line.\nOf.\nQuoted words here.\none\ntwo"
    assert htmlcut.main_text(None) == htmlcut.main_text("") == htmlcut.main_text("<nav>a</nav>") == ""
    plain = "<body><div><a href=/x>Home</a> <a href=/y>Other</a></div><div><p>" + "A long paragraph of text without any container. " * 4 + "<p>" + "And one more such paragraph, as long. " * 4 + "</div></body>"
    assert htmlcut.main_text(plain).count("\n") == 1 and "Home" not in htmlcut.main_text(plain)


def test_html_inline_and_doubtful():
    body = "Some long text of the article that goes on for quite a while. "
    assert htmlcut.main_text(f"<article><p>{body}<span class='ad'>buy now</p><p>Second.</p>") == f"{body.strip()}\nSecond."
    assert htmlcut.main_text(f"<article><p>One <a class=share href=#>Share it</a> two.<p>{body}") == f"One two.\n{body.strip()}"
    related = f"<article><h1>T</h1><p>{body * 3}<section class='related-work'><p>{body * 5}</p><p>{body * 4}</section></article>"
    assert htmlcut.main_text(related).count("\n") == 3
    assert htmlcut.main_text(f"<article><p>{body * 3}</p><div class=related><ul><li><a href=/x>More</a><li><a href=/y>Other</a></ul></div></article>") == (body * 3).strip()
    assert htmlcut.main_text(f"<article><p>{body}</p><div id=comments><p>{body * 9}</div>") == body.strip()


def test_html_deep_and_long():
    import time

    began = time.time()
    assert htmlcut.main_text("<article><p>x" + "<div>" * 40_000 + "deep words here.") == "x\ndeep words here."
    many = "<article>" + "".join(f"<p>Paragraph {i} of a long page, with some words in it.</p>" for i in range(20_000)) + "</article><nav>" + "<a href=/>x</a><br>" * 20_000
    assert htmlcut.main_text(many).count("\n") == 19_999
    assert htmlcut.main_text("<p><b>" * 20_000 + "</b></p>" * 20_000 + "<p>" + "And the end of the text. " * 4) == ("And the end of the text. " * 4).strip()
    assert time.time() - began < 30


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 7), st.randoms(use_true_random=False))
def test_minimum_cut(n, rng):
    source, sink = [rng.randrange(6) for _ in range(n)], [rng.randrange(6) for _ in range(n)]
    edges = [(a, b, rng.randrange(4)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.6]
    cost = lambda kept: sum(sink[i] if kept[i] else source[i] for i in range(n)) + sum(c for a, b, c in edges if kept[a] != kept[b])
    assert cost(htmlcut.minimum_cut(source, sink, edges)) == min(cost(k) for k in itertools.product([False, True], repeat=n))


def test_html_query(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (None, None, None)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = htmlcut.extracted(pages.drop("text"), ["page_id", "url"]).collect()
    assert [r.n_chars for r in got] == [len(htmlcut.main_text(PAGE))] * 2 + [0]


def test_forest(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((600, 12)).astype(np.float32)
    v[300:500] = v[300]  # a hot group of equal vectors
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(601, None), (602, [0.0] * 12), (603, [float("nan")] + [1.0] * 11), (None, v[0].tolist()), (604, [None] + [1.0] * 11), (605, [1.0, 2.0]), (20, v[20].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit(1), "leaf": F.lit(2)})
    got = collections.defaultdict(list)
    for r in rpforest.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(range(0, 600, 20))
    hits = 0
    for q, found in got.items():
        s = rpforest.exact_scores(np.repeat(v[q : q + 1].astype(float), 600, 0), v.astype(float))
        want = sorted((i for i in range(600) if i != q), key=lambda i: (-s[i], i))[:20]
        assert len(found) == 20 and all(x == s[i] for i, x in found) and found == sorted(found, key=lambda x: (-x[1], x[0])) and q not in [i for i, _ in found]
        hits += len({i for i, _ in found} & set(want))
    assert hits / (20 * len(got)) >= 0.9
    few = rpforest.nearest(df.where("vec_id < 15 or vec_id > 600"), F.col("vec_id") % 5 == 0).collect()
    assert collections.Counter(r.query_id for r in few) == {0: 14, 5: 14, 10: 14}  # all candidates, if fewer than k
    assert rpforest.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_forest_recall():
    rng = np.random.default_rng(4)
    v = rng.standard_normal((20_000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    forest = rpforest.Forest(v[:5000], 1.0)
    leaf, hits = forest.leaves(v), 0
    for q, leaves in zip(range(0, 2000, 20), forest.search(v[:2000:20], rpforest.SHARE * forest.trees)):
        s = v @ v[q]
        s[q] = -9
        hits += np.isin(leaf[np.argsort(-s)[:20]], leaves).any(axis=1).sum()
    assert hits / 2000 >= 0.93


def _shingles(t):
    w = (t or "").lower().split()
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def _similar(a, b):
    x, y = _shingles(a), _shingles(b)
    i = sum((x & y).values())
    u = sum(x.values()) + sum(y.values()) - i
    return i / u if u else 1.0


def near_corpus(seed=0, groups=12, size=12):
    rng, rows, i = random.Random(seed), [], 0
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(500)}" for _ in range(rng.choice([3, 8, 60, 200]))]
        for k in range(rng.randrange(1, size)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
            rows.append((i, " ".join(w), "en", "s"))
            i += 1
    return rows


def large_cluster():
    rng, rows = random.Random(5), []
    base = [f"w{i}" for i in range(120)]
    for i in range(110):
        w = list(base)
        for at in rng.sample(range(5, 115, 3), 1 if i < 30 else 2 + i % 2):
            w[at] = f"x{i}"
        rows.append((i, " ".join(w), "en", "s"))
    return rows


def _classes(rows):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if (rows[a][1] or "") == (rows[b][1] or "") or (_shingles(rows[a][1]) and _similar(rows[a][1], rows[b][1]) >= 0.8):
            parent[find(b)] = find(a)
    ids = collections.defaultdict(list)
    for k, r in enumerate(rows):
        ids[find(k)].append(r[0])
    return [min((x for x in ids[find(k)] if x is not None), default=None) for k in range(len(rows))]


def test_signature_estimates():
    rng = random.Random(9)
    base = [f"w{i}" for i in range(300)]
    for n in (1, 5, 20, 60):
        other = list(base)
        for _ in range(n):
            other[rng.randrange(300)] = f"y{rng.random()}"
        a, b = " ".join(base), " ".join(other)
        s = dartminhash.signatures([a, b])
        assert abs((s[0] == s[1]).mean() - _similar(a, b)) < 0.2 and math.isclose(dartminhash.similarity(a, b), _similar(a, b))
    alone, together = dartminhash.signatures(["a b c d e f g"]), dartminhash.signatures(["x " * 5000, "a b c d e f g", ""])
    assert (alone[0] == together[1]).all() and not together[2].any() and dartminhash.signatures([" ".join(base)])[0].all()


@pytest.mark.parametrize("small", [24, 2])
def test_near_duplicates(spark, monkeypatch, small):
    monkeypatch.setattr(dartminhash, "SMALL", small)
    monkeypatch.setattr(dartminhash, "BLOCK", 4)
    rows = near_corpus(small) + [(None, None, None, None), (990, "", "en", "s"), (991, None, "en", "s"), (0, near_corpus(small)[0][1], "en", "t"), (992, "word", "en", "s"), (993, "WORD ", "en", "s")]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.class_id) for r in dartminhash.classes(documents(spark, rows, True)).collect())
    assert got == sorted((r[0] if r[0] is not None else -1, c) for r, c in zip(rows, _classes(rows)))
    kept = dartminhash.one_of_each(documents(spark, rows, True))
    assert kept.columns == documents(spark, rows, True).columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(_classes(rows)))


@pytest.mark.parametrize("block, held", [(512, 4 << 20), (24, 30_000)])
def test_near_duplicates_of_a_large_cluster(spark, monkeypatch, block, held):
    """Most pairs of the cluster are plausible and no links; they must not become rows, which would grow with its square."""
    rows, tried = large_cluster(), []
    verified = dartminhash._verified
    monkeypatch.setattr(dartminhash, "_verified", lambda pairs, *more: tried.append(pairs.count()) or verified(pairs, *more))
    monkeypatch.setattr(dartminhash, "BLOCK", block)
    monkeypatch.setattr(dartminhash, "HELD", held, raising=False)
    monkeypatch.setattr(dartminhash, "SMALL", 4)
    got = sorted((r.doc_id, r.class_id) for r in dartminhash.classes(documents(spark, rows)).collect())
    assert got == sorted((r[0], c) for r, c in zip(rows, _classes(rows)))
    assert len({c for _, c in got}) > 20
    assert sum(tried[1:]) < len(rows)


def test_near_duplicates_edges(spark):
    assert dartminhash.classes(documents(spark, [])).count() == 0 and dartminhash.one_of_each(documents(spark, [])).count() == 0
    same = documents(spark, [(7, "one and the same", "en", "s")] * 40 + [(None, "other text", "en", "s")] * 3)
    assert dartminhash.one_of_each(same).count() == 2 and {r.class_id for r in dartminhash.classes(same).collect()} == {7, None}


def test_urls(spark, duck):
    urls = [None, "", "nothing", "http://A.Example.COM/en/7x?q#f", "https://example.net/de/81", "https://x.net/de/", "http://com/en/", "http://notcom/en/", "http://x.com.evil/en/", "://h/p", "http://www.spam-farm.example.io/about", "http://www.spam-farm.example.io/en", "http://u@h.org:80/es/?a", "http://x.org?/es/", "http://é.com/en/é", "http://a.io/wp-login.php", "http://ads.x.io/banner1"]
    pages = spark.createDataFrame([(i, u, "host") for i, u in enumerate(urls * 2)], "page_id long, url string, host string")
    got = sorted(map(tuple, urlrules.judge_urls(pages, ["page_id"]).collect()))
    frame = __import__("pandas").DataFrame({"page_id": range(2 * len(urls)), "url": urls * 2})
    duck.register("pages_frame", frame)
    duck.sql("create or replace view pages as select * from pages_frame")
    assert got == sorted(map(tuple, duck.sql(urlrules.oracle_sql()).fetchall()))
    by = {r[0]: r for r in got}
    assert by[3][1:] == ("a.example.com", "/en/7x", "example.com/en/7", "allow") and by[4][3:] == ("example.net/de/8", "block") and by[10][3:] == (None, "allow") and by[11][3:] == (None, "block") and by[0][1:] == ("", "", None, "allow")
    assert urlrules.judge_urls(pages.limit(0), ["page_id"]).count() == 0


def test_rules_of_the_contract(spark):
    """Every rule's word as the contract lists it, whatever the code and its SQL share; a host, a subdomain, and a longer rule inside a shorter one."""
    want = {"http://a.com/en/1": ("com/en/", "block"), "http://example.com/en/71": ("example.com/en/7", "allow"), "http://x.net/de/1": ("net/de/", "allow"), "http://example.net/de/7": ("net/de/", "allow"), "http://www.example.net/de/8": ("example.net/de/8", "block"), "http://b.org/es/": ("org/es/", "block")}
    pages = spark.createDataFrame(list(enumerate(want)), "page_id long, url string")
    assert [(r.rule, r.verdict) for r in urlrules.judge_urls(pages, ["page_id"]).orderBy("page_id").collect()] == list(want.values())
    assert {(r.verdict, r.text) for r in urlrules.PREFIX_RULES} == {("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")}


def test_required_tokens():
    want = {r"(^|\.)spam-farm\.": ("spam", "farm"), r"/wp-login\.php$": ("wp", "login", "php"), r"free-?pills\.": (), r"(^|[./-])casino[./-]": ("casino",), r"casino": (), r"/ads?/": (), r"/(a|b)/shop/": ("shop",), r"/x[0-9]/": (), r"/(?:tag)s/": ("tags",), r"^track\b": (), r"//+img/": ("img",), r"(?m)^x/": (), r"/a*b/": (), r"(?i:/AD/)": (), r"/ad(?=/)": (), r"[^a-z]ad/": ()}
    assert {p: urlrules.required_tokens(p) for p in want} == want


PARTS = ["spam-farm", "spam", "farm", "casino", "wp-login.php", "ads", "ad", "adserver", "free-pills", "freepills", "about", "banner", "www", "x1", ".", "/", "-", "//", "about/", ".com"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=6), st.lists(st.sampled_from(PARTS), max_size=6), st.dictionaries(st.sampled_from(["spam", "farm", "casino", "wp", "login", "php", "about"]), st.integers(1, 9)))
def test_rule_index(hosts, paths, often):
    """Rules found through their rarest token against every rule tried, whichever token is rarest."""
    host, path = "".join(hosts), "/" + "".join(paths)
    text = host + path
    hits = {r.verdict for r in urlrules.PATTERN_RULES if re.search(r.pattern, text)}
    assert urlrules.RuleIndex(urlrules.PREFIX_RULES, urlrules.PATTERN_RULES, often).by_pattern(host, path) == ("allow" if "allow" in hits or not hits else "block")


def test_rules_from_table(spark):
    rows = [("block", "com", "/en/", None), ("allow", None, None, "/ok/"), ("block", None, None, "/(shop|ok)/"), ("block", "com", "/en/", None)]
    prefix, patterns = urlrules.rules_from(spark.createDataFrame(rows, "verdict string, host string, path string, pattern string"))
    assert prefix == (urlrules.PrefixRule("block", "com", "/en/"),) and len(patterns) == 2
    pages = spark.createDataFrame([(1, "http://a.com/en/x", "r"), (1, "http://a.org/shop/", "r"), (2, "http://a.org/ok/", "r"), (3, None, "r")], "page_id long, url string, rule string")
    got = [tuple(r) for r in urlrules.judge_urls(pages, ["page_id"], prefix=prefix, patterns=patterns).collect()]
    assert [(r[0], r[3], r[4]) for r in got] == [(1, "com/en/", "block"), (1, None, "block"), (2, None, "allow"), (3, None, "allow")]
    assert urlrules.token_counts(pages, "url", patterns) == {"ok": 1} and "shop" not in urlrules.required_tokens("/(shop|ok)/")
    with pytest.raises(ValueError):
        urlrules.rules_from(spark.createDataFrame([("maybe", "a", "b", None)], "verdict string, host string, path string, pattern string"))


def test_pipeline(spark):
    import corpus_pipeline

    rng = random.Random(4)
    long = words(rng, 60)
    rows = [(i, f"{words(rng, 90)}\n{long}" if i % 3 else words(rng, 50), "en", f"s{i % 4}") for i in range(60)] + [(100, words(random.Random(5), 60), "en", "s1"), (101, None, None, None), (102, "", "en", "s")]
    docs = documents(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, docs, "")
        assert new.columns == docs.columns, name
        docs = spark.createDataFrame(new.collect(), SCHEMA)
    assert docs.where(F.col("text").contains(long)).count() <= 1
    ids = {r.doc_id for r in docs.collect()}
    assert set(range(60)) <= ids and len(ids & {101, 102}) == 1
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()


def test_pipeline_on_a_large_cluster(spark, monkeypatch):
    """The stages up to the third, with no row for each pair of the cluster."""
    import corpus_pipeline

    rows, tried = large_cluster(), []
    verified = dartminhash._verified
    monkeypatch.setattr(dartminhash, "_verified", lambda pairs, *more: tried.append(pairs.count()) or verified(pairs, *more))
    monkeypatch.setattr(dartminhash, "SMALL", 4)
    kept = corpus_pipeline.near_duplicates(spark, documents(spark, rows), "").localCheckpoint()
    first = set(_classes(rows))
    assert {r.doc_id for r in kept.collect()} == first and sum(tried[1:]) < len(rows)
    cut = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, kept, "").collect()}
    assert set(cut) == first and cut[min(first)] == rows[min(first)][1] and sum(map(len, cut.values())) < sum(len(rows[i][1]) for i in first)


def test_pipeline_edges(spark, tmp_path):
    """Nothing at all, extra columns of any name, and the order of the mix in what comes out."""
    import corpus_pipeline
    from driftlens.llm import mixing

    folder = str(tmp_path)
    documents(spark, []).write.parquet(f"{folder}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0
    rng = random.Random(4)
    rows = [(i, words(rng, 70), "en", f"s{i % 4}") for i in range(80)] + [(100, None, None, None), (101, "", "en", "s"), (None, words(rng, 60), "en", "s0")]
    documents(spark, rows, True).write.parquet(f"{folder}/some/documents.parquet")
    got = corpus_pipeline.run(spark, f"{folder}/some").orderBy("mix_file", "mix_block", "mix_row").collect()
    at = {r.doc_id: (r.mix_tier, r.mix_slot, r.source or "", r.mix_at) for r in mixing.placed(documents(spark, [r for r in rows if r[0] != 101])).collect()}
    assert len(got) == len(rows) - 1 and [at[r.doc_id] for r in got] == sorted(at.values())
