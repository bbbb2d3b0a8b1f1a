"""Substring dedup by hashing runs of words (op 9).

A unit is a run of ``PASSAGE`` words, at every word of a text: normalised (lower case, whatever white space lies between the words), hashed, and
grouped by its digest over the whole corpus. The earliest occurrence (order: document id, null last; digest of the text; offset) stays, every other one is
removed; overlapping ones make one span, so spans are the maximal repeated passages of ``PASSAGE`` words or more, with their offsets in
the original text. What overlaps its own first occurrence (periodic text) is removed from where that occurrence ends, so the first always stays.
Whole lines or paragraphs as units find only passages that happen to fill a line (0.15 of the planted ones, README), so units do not depend on them.

Exact, and without hashing every run: the anchor of a run is the smallest hash among its runs of ``GRAM`` words, so equal runs
have equal anchors, and only runs whose anchor occurs twice are hashed (128 bits) and grouped. Neighbouring runs mostly share
their anchor: there are about two for 27 words. Of equal texts (128 bits of MD5) the first leads and the others go whole.

Defined results: rows that repeat with equal id and text are one document and keep or lose alike; a null or empty text has no units and stays
as it is; a document all of whose text goes stays, with an empty text; ids may be null; a table without rows gives none. Other columns pass through
untouched, whatever their names.

Scale: an anchor with the hash of its document is shuffled once to count, summed up before, and once to join; texts are moved once to meet
their repeated anchors; runs move once. Keys that more than a ``MOST``-th of all rows have are known from the counts, at most ``MOST`` of them: hot texts leave all
copies but one behind before anything moves, and runs of hot anchors are summed up in each task and joined salted, so no task gets a hot group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftlens.llm.common import discard, give_back, ship, through, written

PASSAGE = 50
GRAM = 25
MOST = 1024
LEAST_HOT = 1000  # rows of a key below which it is never hot
SALTS = 16
LONG = 63  # code points up to which words are hashed side by side in numpy, three at a time; longer ones one by one
CHARS = 1 << 18  # of text in hand at once
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)


_SPACE = np.array([chr(c).isspace() for c in range(0x3002)])  # there is none beyond


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _places(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text start and end."""
    space = np.concatenate([[True], _SPACE[np.minimum(codes, len(_SPACE) - 1)], [True]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    return edge[::2], edge[1::2]


def _hashed(text: str, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits of each word."""
    size, h = ends - starts, np.zeros(len(starts), np.uint64)
    code = np.concatenate([codes.astype(np.uint64) + np.uint64(1), np.zeros(2, np.uint64)])
    code[ends] = 0  # so is what ends a word, and what follows that counts as nothing
    live = np.flatnonzero(size <= LONG)
    for at in range(0, LONG, 3):
        live = live[size[live] > at]
        if not len(live):
            break
        i = starts[live] + at
        second = code[i + 1]
        x = h[live] + (code[i] | second << np.uint64(21) | np.where(second != 0, code[i + 2], np.uint64(0)) << np.uint64(42))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(_ODD[0])
        x = (x ^ (x >> np.uint64(27))) * np.uint64(_ODD[1])
        h[live] = x ^ (x >> np.uint64(31))
    for i in np.flatnonzero(size > LONG):
        h[i] = int.from_bytes(hashlib.blake2b(text[starts[i] : ends[i]].encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(_ODD[2])
    return x ^ (x >> np.uint64(29))


def _runs(x: np.ndarray, n: int, odd: int) -> np.ndarray:
    """Hash of each n neighbours, by doubling."""
    h, size = x, 1
    for bit in bin(n)[3:]:
        h = h[:-size] * np.uint64(pow(odd, size, 1 << 64)) + h[size:]
        size *= 2
        if bit == "1":
            h = h[:-1] * np.uint64(odd) + x[size:]
            size += 1
    return _mixed(h)


def _least(x: np.ndarray, n: int, better=np.minimum) -> np.ndarray:
    """Minimum, or what else is better, of each n neighbours."""
    size = 1
    while size * 2 <= n:
        x, size = better(x[:-size], x[size:]), size * 2
    return better(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


class _Words:
    """The words of several texts one after the other: hashes, grams, anchors of the runs, and which runs are in one text."""

    def __init__(self, texts: list[str]):
        joined = "\n".join(texts)
        self.starts, self.ends = _places(_codes(joined))
        lower = joined.lower()
        codes = _codes(lower)
        # a character may become two in lower case, never none: texts of one length have their words at the same places
        x = self.x = _hashed(lower, codes, *((self.starts, self.ends) if len(lower) == len(joined) else _places(codes)))
        self.begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        self.text = np.searchsorted(self.begins, self.starts, "right") - 1
        self.few = len(x) < PASSAGE
        if not self.few:
            self.inside = self.text[: len(x) - PASSAGE + 1] == self.text[PASSAGE - 1 :]
            self.grams = _runs(x, GRAM, _ODD[0])
            self.least = _least(self.grams, PASSAGE - GRAM + 1)

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, place) from the first word to the last of each text of PASSAGE words or more."""
        n = np.bincount(self.text, minlength=len(self.begins))
        text = np.flatnonzero(n >= PASSAGE)
        last = np.cumsum(n)[text] - 1
        start = self.starts[last - n[text] + 1]
        return text, (start - self.begins[text]) << 31 | (self.ends[last] - start)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, gram, whether it is there twice) of each gram that is the anchor of a run, once a text."""
        if self.few:
            return tuple(np.empty(0, np.int64) for _ in range(3))
        # a gram is an anchor if the largest minimum of the runs around it is its own hash
        around = np.zeros(len(self.least) + 2 * (PASSAGE - GRAM), np.uint64)
        around[PASSAGE - GRAM : len(around) - (PASSAGE - GRAM)] = np.where(self.inside, self.least, np.uint64(0))
        most = _least(around, PASSAGE - GRAM + 1, np.maximum)
        at = np.flatnonzero(most == self.grams)
        order = np.lexsort((self.grams[at], self.text[at]))
        text, gram = self.text[at][order], self.grams[at][order]
        new = np.ones(len(at) + 1, dtype=bool)
        new[1:-1] = (text[1:] != text[:-1]) | (gram[1:] != gram[:-1])
        return text[new[:-1]], gram[new[:-1]].view(np.int64), ~new[1:][new[:-1]]

    def runs(self, anchors: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, anchor, hash, other hash, place) of each run whose anchor is among the given."""
        if self.few:
            return tuple(np.empty(0, np.int64) for _ in range(5))
        at = np.flatnonzero(self.inside & np.isin(self.least, anchors.view(np.uint64)))
        a, b = _runs(self.x, PASSAGE, _ODD[0]), _runs(_mixed(self.x), PASSAGE, _ODD[1])
        start, text = self.starts[at], self.text[at]
        return text, self.least[at].view(np.int64), a[at].view(np.int64), b[at].view(np.int64), (start - self.begins[text]) << 31 | (self.ends[at + PASSAGE - 1] - start)


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Batches with their last column's texts, cut at about CHARS; one text at least."""
    for b in batches:
        texts, at = [t or "" for t in b.column(b.num_columns - 1).to_pylist()], 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (size == 0 or size + len(texts[to]) < CHARS):
                size += len(texts[to]) + 1
                to += 1
            yield b.slice(at, to - at), texts[at:to]
            at = to


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text of PASSAGE words or more one row with its place, and one row for each anchor."""
    try:
        for b, texts in _portions(batches):
            w = _Words(texts)
            text, place = w.whole()
            of, anchor, twice = w.anchors()
            who = pa.array(np.concatenate([text, of]))
            fill = lambda x, before, after: pa.concat_arrays([pa.nulls(before, x.type), x, pa.nulls(after, x.type)])
            columns = [b.column(i).take(who) for i in range(3)]
            yield pa.record_batch([*columns, fill(pa.array(place), 0, len(of)), fill(pa.array(anchor), len(text), 0), fill(pa.array(twice), len(text), 0)], ["id", "doc", "check", "place", "anchor", "twice"])
    finally:
        give_back()


def _find_runs(hot: list[int]):
    many = np.array(sorted(hot), np.int64)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for b, texts in _portions(batches):
                # an anchor that repeats is among those of every document that has it, so one set serves all
                text, anchor, *found = _Words(texts).runs(np.unique(b.column(2).flatten().to_numpy()))
                yield pa.record_batch([c.take(pa.array(text)) for c in b.columns[:2]] + [pa.array(np.isin(anchor, many))] + [pa.array(c) for c in found], ["id", "doc", "hot", "a", "b", "place"])
        finally:
            give_back()

    return find


def _salted(large: DataFrame, small: DataFrame, on: list[str], by: list[str]) -> DataFrame:
    """Inner join of a table in which one key may have any number of rows with one that has each key once."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    return large.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).join(small.select("*", salts), [*on, "salt"]).drop("salt")


def _half(text: Column, at: int) -> Column:
    """64 bits of the MD5 of a text, from the first or the 17th digit on."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), at, 16), 16, -10).cast("long")


_start = lambda place: F.shiftright(place, 31)
_end = lambda place: F.shiftright(place, 31) + F.col(place).bitwiseAND(F.lit(2**31 - 1))


def passage_spans(rows: DataFrame) -> DataFrame:
    """rows (id, text) -> doc (half the MD5 of the text), id, start, end, kept_id, kept_start of each maximal span to remove. Written."""
    ship(rows.sparkSession)
    known = rows.select("id", _half(F.col("text"), 1).alias("doc"), _half(F.col("text"), 17).alias("check"), "text")
    found = written(known.mapInArrow(_find_anchors, "id long, doc long, check long, place long, anchor long, twice boolean"), "anchors")
    texts, anchors = found.where("place is not null").select("id", "doc", "check", "place"), found.where("anchor is not null")
    n_texts, n_anchors = found.agg(F.count("place"), F.count("anchor")).first()

    # of equal texts the first leads; the others go whole, so only leaders are looked into
    who = F.struct(F.col("id").isNull().alias("none"), "id")
    same = texts.groupBy("doc", "check").agg(F.min(who).alias("first"), F.max(who).alias("last"), F.min("place").alias("place"), F.count("*").alias("n"))
    leaders = written(same.select("doc", "check", F.col("first.id").alias("lead"), "place", "n", (F.col("first") != F.col("last")).alias("copied")), "leaders")

    shared = anchors.groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.max("twice").alias("twice"), F.count("*").alias("n"))
    repeated = written(shared.where("low <> high or twice").select("anchor", "n"), "repeated")
    hot = [r[0] for r in repeated.where(F.col("n") > max(n_anchors // MOST, LEAST_HOT)).select("anchor").collect()]
    usual = anchors.where(~F.col("anchor").isin(hot)).join(repeated.select("anchor"), "anchor").select("doc", "anchor")
    often = usual.union(anchors.where(F.col("anchor").isin(hot)).select("doc", "anchor"))
    mine = often.groupBy("doc").agg(F.collect_set("anchor").alias("anchors")).join(leaders.select("doc", "check", "lead"), "doc")
    hot_texts = leaders.where(F.col("n") > max(n_texts // MOST, LEAST_HOT)).select("doc", "check", F.struct("lead").alias("first"))
    moved = known.join(F.broadcast(hot_texts), ["doc", "check"], "left").where(F.col("first").isNull() | F.col("id").eqNullSafe(F.col("first.lead"))).select("id", "doc", "check", "text")
    near = moved.join(mine, ["doc", "check"]).where(F.col("id").eqNullSafe(F.col("lead"))).select("id", "doc", "anchors", "text")
    runs = written(near.mapInArrow(_find_runs(hot), "id long, doc long, hot boolean, a long, b long, place long"), "runs")

    spans = written(_merged(runs), "spans")
    discard(runs)
    # a copy's first run is kept where its leader's is
    at = leaders.where("copied").join(spans.withColumnsRenamed({"doc": "of", "id": "of_id"}), (F.col("doc") == F.col("of")) & F.col("lead").eqNullSafe(F.col("of_id")) & (_start("place") == F.col("start")), "left")
    moved_on = F.col("of").isNotNull()
    kept = at.select("doc", "check", "lead", F.when(moved_on, F.col("kept_id")).otherwise(F.col("lead")).alias("kept_id"), F.when(moved_on, F.col("kept_start")).otherwise(_start("place")).alias("kept_start"))
    copies = _salted(texts, kept, ["doc", "check"], ["id"]).where(~F.col("id").eqNullSafe(F.col("lead"))).select("doc", "id", _start("place").alias("start"), _end("place").alias("end"), "kept_id", "kept_start").distinct()
    out = written(spans.unionByName(copies), "passages")
    discard(found, repeated, leaders, spans)
    return out


def _merged(runs: DataFrame) -> DataFrame:
    """runs -> the spans of those that occurred before."""
    names = ("id", "doc", "place")
    cold, warm = (runs.where(F.col("hot") == h).select("id", "doc", "a", "b", "place") for h in (False, True))
    order = Window.partitionBy("a", "b").orderBy(F.col("id").asc_nulls_last(), "doc", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    who = F.struct(F.col("id").isNull().alias("none"), *names)
    firsts = warm.groupBy("a", "b").agg(F.min(who).alias("f"), F.max(who).alias("l")).where("f <> l").select("a", "b", *[F.col(f"f.{c}").alias(f"first_{c}") for c in names])
    placed = cold.withColumns({f"first_{c}": F.first(c).over(order) for c in names}).unionByName(_salted(warm, firsts, ["a", "b"], ["doc", "place"]))
    own = (F.col("doc") == F.col("first_doc")) & F.col("id").eqNullSafe(F.col("first_id"))
    gone = placed.where(~own | (F.col("place") != F.col("first_place")))
    # what overlaps its own first occurrence goes from there on
    start = F.when(own, F.greatest(_start("place"), _end("first_place"))).otherwise(_start("place"))
    gone = gone.select("doc", "id", start.alias("start"), _end("place").alias("end"), F.col("first_id").alias("kept_id"), _start("first_place").alias("kept_start"))
    by = Window.partitionBy("doc", "id").orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    islands = gone.withColumn("new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int")).withColumn("span", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("doc", "id", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min(F.struct("start", "kept_id", "kept_start")).alias("kept"))
    return merged.select("doc", "id", "start", "end", F.col("kept.kept_id").alias("kept_id"), F.col("kept.kept_start").alias("kept_start"))


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The repeated passages of each document; kept_* are where the first run of the passage stays."""
    spans = passage_spans(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")))
    return spans.select(F.col("id").alias(key), F.col("start").alias("start_char"), F.col("end").alias("end_char"), F.col("kept_id").alias(f"kept_{key}"), F.col("kept_start").alias("kept_start_char"))


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the repeated passages cut out of their texts, whole lines with the line feed that followed them; the same columns and rows."""
    spans = passage_spans(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")))
    cuts = spans.groupBy(F.col("doc").alias("__of"), F.col("id").alias("__of_id")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__cuts"))

    @F.pandas_udf("string")
    def cut_out(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, cuts_of in through(batches):
            yield pd.Series([_without(t, c) for t, c in zip(texts, cuts_of)], dtype=object)

    keyed = docs.withColumns({"__doc": _half(F.col(text), 1), "__id": F.col(key).cast("long")})
    joined = keyed.join(cuts, (F.col("__doc") == F.col("__of")) & F.col("__id").eqNullSafe(F.col("__of_id")), "left")
    touched = F.col("__cuts").isNotNull()
    starts_ends = F.transform(F.coalesce(F.col("__cuts"), F.array()), lambda c: F.array(c["start"], c["end"]))
    # only rows with cuts carry their text to Python
    new = F.when(touched, cut_out(F.when(touched, F.col(text)), starts_ends)).otherwise(F.col(text))
    out = joined.withColumn(text, new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(touched, F.length(text).cast("long")).otherwise(F.col("n_chars").cast("long")))
    return out.select(*docs.columns)


def _without(text, cuts):
    if text is None or cuts is None or not len(cuts):
        return text
    spans = []
    for start, end in cuts:  # in order of start
        if spans and start < spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], int(end))
        else:
            spans.append([int(start), int(end)])
    parts, at, lines = [], 0, False
    for start, end in spans:
        parts.append(text[at:start])
        lines = (start == 0 or text[start - 1] == "\n") and (end >= len(text) or text[end] == "\n")
        # whole lines go with their line feed, words with the space after them
        at = end + 1 if lines or (text[end : end + 1].isspace() and text[end] != "\n") else end
    parts.append(text[at:])
    out = "".join(parts)
    return out[:-1] if lines and spans[-1][1] >= len(text) and out.endswith("\n") else out


def oracle_sql() -> str:
    """DuckDB SQL for report() over documents: every run of every text, grouped by itself."""
    space = "[\\x09-\\x0d\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
    return f"""
    WITH docs AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS LAST, text) AS d FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
    cut AS (SELECT doc_id, d, string_split_regex(text, '{space}') AS ps FROM docs),
    pieces AS (SELECT doc_id, d, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM cut),
    placed AS (SELECT doc_id, d, p, CAST(coalesce(sum(length(p) + 1) OVER (PARTITION BY d ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM pieces),
    words AS (SELECT doc_id, d, lower(p) AS w, s, s + length(p) AS e FROM placed WHERE p <> ''),
    runs AS (SELECT doc_id, d, s, lead(e, {PASSAGE - 1}) OVER o AS e, md5(string_agg(w, ' ') OVER (PARTITION BY d ORDER BY s ROWS BETWEEN CURRENT ROW AND {PASSAGE - 1} FOLLOWING)) AS h FROM words WINDOW o AS (PARTITION BY d ORDER BY s)),
    ranked AS (SELECT *, first_value(doc_id) OVER f AS kept_doc_id, first_value(d) OVER f AS fd, first_value(s) OVER f AS fs, first_value(e) OVER f AS fe FROM runs WHERE e IS NOT NULL WINDOW f AS (PARTITION BY h ORDER BY d, s)),
    gone AS (SELECT doc_id, d, CASE WHEN d = fd THEN greatest(s, fe) ELSE s END AS s, e, kept_doc_id, fs FROM ranked WHERE d <> fd OR s <> fs),
    islands AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY d ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM gone),
    numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY d ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM islands)
    SELECT doc_id, min(s) AS start_char, max(e) AS end_char, arg_min(kept_doc_id, s) AS kept_doc_id, arg_min(fs, s) AS kept_start_char FROM numbered GROUP BY doc_id, d, island"""
