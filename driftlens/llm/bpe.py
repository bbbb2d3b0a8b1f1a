"""Byte-level BPE by forced-boundary splitting (op 1).

Every token a merge can produce is a vocabulary entry, so a pair of adjacent bytes that occurs inside no
vocabulary token can never end up inside one token: the border between the two bytes is certain. A piece of
text is cut at all such borders, the fragments are encoded independently (and cached, since they repeat far
more often than whole texts), and the ids are concatenated.

The ids equal those of the ``tokenizers`` library for the same file with ``add_special_tokens=False``.

Defined results: a null text counts as empty (no ids); special tokens that are spelled out in a text become
their own id, as in the library; text of any length is encoded whole (long fragments use a heap, so time is
n log n and memory linear); bytes that do not form UTF-8 decode to U+FFFD, as in the library.
"""

from __future__ import annotations

import heapq
import json
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import ship, through

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WIDEST = 64  # fragments of more bytes than this are merged with a heap, the others side by side in numpy
CACHED = 1 << 18  # different pieces a worker keeps at most (about 40 bytes each)
CHUNK = 1 << 18  # characters of text that are split into pieces at a time
SLOTS = 1 << 18  # of a hash table of merges
LONG = 64  # pieces of more characters are not kept: their sums below would be weaker as keys
MUL = 0x9E3779B97F4A7C15 | 1
NONE = np.int32(2**31 - 1)


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ForcedBoundaryBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        vocab = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.pieces: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.pieces[i] = token
        for token, i in self.special.items():
            self.pieces[i] = token.encode()
        self.byte_id = [vocab[bytes([b])] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = map(raw, m.split(" ") if isinstance(m, str) else m)
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        #: joinable[a << 8 | b]: some token holds the bytes a, b side by side; where not, a cut is certain
        self.joinable = bytearray(1 << 16)
        for token in vocab:
            for a, b in zip(token, token[1:]):
                self.joinable[a << 8 | b] = 1
        self._joinable = np.frombuffer(self.joinable, dtype=np.uint8)
        self._hash_merges()
        self.find = regex.compile(PATTERN).findall
        self.at_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else None
        self.kind = np.zeros(0x110000, dtype=np.uint8)  # of a character: 0 other, 1 letter, 2 number, 3 white space
        everything = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "?" for c in range(0x110000))
        for k, cls in enumerate((r"\p{L}+", r"\p{N}+", r"\s+"), 1):
            for m in regex.finditer(cls, everything):
                self.kind[m.start() : m.end()] = k
        self._forget()

    def _forget(self) -> None:
        """Empty cache: sorted keys of pieces, and where the ids of each lie in one flat array."""
        self._keys, self._at, self._flat = np.zeros(0, dtype=np.uint64), np.zeros((0, 2), dtype=np.int64), np.zeros(0, dtype="<u4")

    def _hash_merges(self) -> None:
        """Two hash tables without chains: keys that share a slot of the first are in the second, or in a third, ..."""
        keys = np.array([a << 20 | b for a, b in self.merges], dtype=np.uint64)
        ranks, news = (np.array([v[i] for v in self.merges.values()], dtype=np.int32) for i in (0, 1))
        self._tables, left, rng = [], np.arange(len(keys)), np.random.default_rng(1)
        while len(left):
            mul = np.uint64(int(rng.integers(1 << 62)) * 2 + 1)
            slot = (keys[left] * mul) >> np.uint64(64 - 18)
            _, first = np.unique(slot, return_index=True)
            table = np.full(SLOTS, 2**63, dtype=np.uint64), np.full(SLOTS, NONE, dtype=np.int32), np.zeros(SLOTS, dtype=np.int32)
            for column, values in zip(table, (keys, ranks, news)):
                column[slot[first]] = values[left[first]]
            self._tables.append((mul, *table))
            left = np.delete(left, first)

    def _look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE if there is no merge) and resulting id of each pair of ids."""
        key = a.astype(np.uint64) << np.uint64(20) | b.astype(np.uint64)
        rank, new = np.full(key.shape, NONE, dtype=np.int32), np.zeros(key.shape, dtype=np.int32)
        for mul, keys, ranks, news in self._tables:
            slot = (key * mul) >> np.uint64(64 - 18)
            hit = np.nonzero(keys[slot] == key)
            at = slot[hit]
            rank[hit], new[hit] = ranks[at], news[at]
        return rank, new

    def _merge_matrix(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge every row of ids (its first n columns) by rank, leftmost first; returns flat ids and each row's count."""
        rows, width = ids.shape
        columns = np.arange(width)
        rank, new = self._look(ids[:, :-1], ids[:, 1:])
        rank[columns[None, 1:] >= n[:, None]] = NONE
        live = np.arange(rows)
        out, count = ids.copy(), n.copy()
        while len(live):
            at = rank.argmin(axis=1)
            row = np.arange(len(at))
            go = rank[row, at] != NONE
            if not go.all():
                done = ~go
                out[live[done]], count[live[done]] = ids[done], n[done]
                live, ids, n, rank, new, at = live[go], ids[go], n[go], rank[go], new[go], at[go]
                row = np.arange(len(at))
                if not len(live):
                    break
            ids[row, at] = new[row, at]
            tail = columns[None, :-1] > at[:, None]
            ids[:, :-1] = np.where(tail, ids[:, 1:], ids[:, :-1])
            rank[:, :-1] = np.where(tail[:, :-1], rank[:, 1:], rank[:, :-1])
            new[:, :-1] = np.where(tail[:, :-1], new[:, 1:], new[:, :-1])
            n = n - 1
            for i in (at - 1, at):
                ok = (i >= 0) & (i < n - 1)
                r, j = row[ok], i[ok]
                rank[r, j], new[r, j] = self._look(ids[r, j], ids[r, j + 1])
            r = row[at == n - 1]
            rank[r, n[r] - 1 if width > 1 else 0] = NONE
            rank[row, np.minimum(n - 1, width - 2)] = NONE
        return out[columns[None, :] < count[:, None]], count

    def fragments(self, data: bytes) -> Iterator[bytes]:
        """data cut wherever its two adjacent bytes are side by side in no token."""
        joinable, start = self.joinable, 0
        for i in range(1, len(data)):
            if not joinable[data[i - 1] << 8 | data[i]]:
                yield data[start:i]
                start = i
        if start < len(data):
            yield data[start:]

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of pieces and where each begins and ends: cut at certain borders, merge the fragments, put together."""
        coded = [p.encode() for p in pieces]
        data = np.frombuffer(b"".join(coded), dtype=np.uint8)
        ends = np.cumsum([len(c) for c in coded])
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[1:-1] = self._joinable[data[:-1].astype(np.int32) << 8 | data[1:]] == 0
        cut[0] = True
        cut[ends] = True
        borders = np.nonzero(cut)[0]
        starts, lengths = borders[:-1], np.diff(borders)
        byte_id = np.array(self.byte_id, dtype=np.int32)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        low = 0
        for width in (1, 2, 4, 6, 8, 12, 16, 24, 32, WIDEST):
            who = np.nonzero((lengths > low) & (lengths <= width))[0]
            low = width
            for block in np.array_split(who, len(who) // 50_000 + 1):
                if not len(block):
                    continue
                at = np.minimum(starts[block][:, None] + np.arange(width), len(data) - 1)
                ids = byte_id[data[at]]
                flat, count = (ids[:, 0], np.ones(len(block), dtype=np.int64)) if width == 1 else self._merge_matrix(ids, lengths[block].copy())
                parts.append((block, flat, count))
        for f in np.nonzero(lengths > WIDEST)[0]:
            ids = self._merge_heap([self.byte_id[b] for b in data[starts[f] : starts[f] + lengths[f]].tobytes()])
            parts.append((np.array([f]), np.array(ids, dtype=np.int32), np.array([len(ids)])))
        counts = np.zeros(len(starts), dtype=np.int64)
        for block, _, count in parts:
            counts[block] = count
        begin = np.concatenate([[0], np.cumsum(counts)])
        whole = np.empty(begin[-1], dtype="<u4")
        for block, flat, count in parts:
            within = np.arange(len(flat)) - np.repeat(np.cumsum(count) - count, count)
            whole[np.repeat(begin[block], count) + within] = flat
        to = begin[np.searchsorted(borders, ends)]
        return whole, np.stack([np.concatenate([[0], to[:-1]]), to], axis=1)

    def _merge_heap(self, ids: list[int]) -> list[int]:
        n, merges = len(ids), self.merges
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merges.get((new, ids[k])):
                    heapq.heappush(heap, (m[0], i, new, ids[k], m[1]))
            if (h := before[i]) >= 0 and (m := merges.get((ids[h], new))):
                heapq.heappush(heap, (m[0], h, ids[h], new, m[1]))
        return [x for x in ids if x >= 0]

    def _starts(self, codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where the pieces of PATTERN begin; codes: the texts' characters one after the other, begins: of each text."""
        kind, n = self.kind[codes], len(codes)
        start = np.empty(n + 1, dtype=bool)
        start[0] = start[n] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:n])
        first = np.zeros(n + 1, dtype=bool)
        first[begins] = first[n] = True
        start |= first
        # white space before something else: its last character stands alone, a blank goes with what follows
        j = 1 + np.nonzero((kind[:-1] == 3) & (kind[1:] != 3) & ~first[1:n])[0]
        start[j - 1] = True
        start[j[codes[j - 1] == 32]] = False
        start[begins] = True
        # contractions: an apostrophe that begins a piece
        p = np.nonzero(codes == 39)[0]
        if len(p):
            before = np.where(p > 0, p - 1, 0)
            p = p[first[p] | (kind[before] == 1) | (kind[before] == 2) | ((kind[before] == 3) & (codes[before] != 32))]
            padded = np.concatenate([codes, [0, 0]])
            one = np.where(first[p + 1], 0, padded[p + 1])
            two = np.where(first[np.minimum(p + 2, n)], 0, padded[p + 2])
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            start[p[short] + 1] = start[p[long] + 1] = start[p[long] + 2] = False
            start[p[short] + 2] = start[p[long] + 3] = True
            start[p[short | long]] = True
        return np.nonzero(start)[0]

    def _encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of texts without special tokens, and where the ids of each text end."""
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        ends = np.cumsum([len(t) for t in texts])
        if not len(codes):
            return np.zeros(0, dtype="<u4"), np.zeros(len(texts), dtype=np.int64)
        begins = ends - [len(t) for t in texts]
        borders = self._starts(codes, np.unique(begins[begins < len(codes)]))
        start, end = borders[:-1], borders[1:]
        if len(codes) >= len(_powers()[0]):
            raise ValueError("text too long for the table of powers")
        powers, inverse = (x[: len(codes)] for x in _powers())
        mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mixed * powers, dtype=np.uint64)])
        keys = (sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        keys ^= keys >> np.uint64(31)
        long = np.nonzero(end - start > LONG)[0]
        keys[long] = np.arange(len(long), dtype=np.uint64)  # each its own; encoded below and not kept
        unique, where, which = np.unique(keys, return_index=True, return_inverse=True)
        if len(unique) + len(self._keys) > CACHED:
            self._forget()
        spot = np.searchsorted(self._keys, unique)
        known = np.zeros(len(unique), dtype=bool)
        inside = spot < len(self._keys)
        known[inside] = self._keys[spot[inside]] == unique[inside]
        is_long = (end - start)[where] > LONG
        known &= ~is_long
        at = np.empty((len(unique), 2), dtype=np.int64)
        at[known] = self._at[spot[known]]
        flat = self._flat
        if not known.all():
            new = np.nonzero(~known)[0]
            ids, spans = self._encode_pieces([joined[a:b] for a, b in zip(start[where[new]].tolist(), end[where[new]].tolist())])
            at[new] = spans + len(flat)
            flat = np.concatenate([flat, ids])
            keep = new[~is_long[new]]
            self._keys = np.insert(self._keys, spot[keep], unique[keep])
            self._at = np.insert(self._at, spot[keep], at[keep], axis=0)
            self._flat = flat
        at = at[which]
        count = at[:, 1] - at[:, 0]
        to = np.cumsum(count)
        ids = flat[np.arange(to[-1]) + np.repeat(at[:, 0] - (to - count), count)]
        last = np.searchsorted(borders, ends) - 1
        return ids, np.where(ends > 0, to[last], 0)

    def encode_many(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each whole text as little-endian unsigned 32-bit integers."""
        held: list[list[str]] = []  # of each text, its parts: plain ones at even places, special tokens at odd ones
        chars = 0
        for text in texts:
            text = text or ""
            if held and chars + len(text) > CHUNK:
                yield from self._encode_parts(held)
                held, chars = [], 0
            held.append(self.at_special(text) if any(s in text for s in self.special) else [text])
            chars += len(text)
        yield from self._encode_parts(held)

    def _encode_parts(self, held: list[list[str]]) -> Iterator[bytes]:
        plain = self._encode_held([part for parts in held for part in parts[::2]])
        for parts in held:
            if len(parts) == 1:
                yield next(plain)
            else:
                yield b"".join(struct.pack("<I", self.special[part]) if k % 2 else next(plain) for k, part in enumerate(parts))

    def _encode_held(self, held: list[str]) -> Iterator[bytes]:
        if sum(map(len, held)) > CHUNK:  # one text beyond CHUNK
            for text in held:
                yield b"".join(self._encode_long(text))
        elif held:
            ids, to = self._encode_plain(held)
            start = 0
            for end in to.tolist():
                yield ids[start:end].tobytes()
                start = end

    def _encode_long(self, text: str) -> Iterator[bytes]:
        """A text beyond CHUNK: piece by piece, in runs of pieces that are short enough."""
        run: list[str] = []
        chars = 0
        for m in regex.finditer(PATTERN, text):
            run.append(m.group())
            chars += len(run[-1])
            if chars > CHUNK // 2:
                yield self._encode_pieces(run)[0].tobytes()
                run, chars = [], 0
        if run:
            yield self._encode_pieces(run)[0].tobytes()

    def encode_bytes(self, text: str | None) -> bytes:
        return next(iter(self.encode_many([text])))

    def decode_bytes(self, ids: bytes | None) -> str:
        """Text of ids as written by encode_bytes."""
        if not ids:
            return ""
        return b"".join(map(self.pieces.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", errors="replace")


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """MUL ** i and its inverse modulo 2 ** 64."""
    back = pow(MUL, -1, 1 << 64)
    return tuple(np.concatenate([np.ones(1, dtype=np.uint64), np.cumprod(np.full(CHUNK + 1, m, dtype=np.uint64))]) for m in (MUL, back))


@lru_cache(maxsize=2)
def load(path: str) -> ForcedBoundaryBPE:
    """One encoder a worker and file."""
    return ForcedBoundaryBPE(path)


def encode(text: Column, tokenizer: str) -> Column:
    """text (string) -> ids (binary: little-endian unsigned 32-bit integers); null text -> no ids."""

    @F.pandas_udf("binary")
    def bpe_encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = load(tokenizer)
        for s in through(batches):
            out: list[bytes] = []
            size = 0
            for ids in bpe.encode_many(s):
                out.append(ids)
                size += len(ids)
                if size > CHUNK * 4:  # ids take more room than text
                    yield pd.Series(out, dtype=object)
                    out, size = [], 0
            yield pd.Series(out, dtype=object)

    return bpe_encode(text)


def decode(ids: Column, tokenizer: str) -> Column:
    """ids (binary, as encode gives them) -> text."""

    @F.pandas_udf("string")
    def bpe_decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = load(tokenizer)
        for s in through(batches):
            yield pd.Series([bpe.decode_bytes(b) for b in s], dtype=object)

    return bpe_decode(ids)


def round_trip_digests(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", more: dict[str, Column] | None = None) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 of each row's whole text, and more columns by name; one row for each row of docs.

    Ids never leave the task that made them, and nothing is shuffled; rows of any key, null or repeated, stay.
    """
    ship(docs.sparkSession)
    more = more or {}
    ids = docs.select(F.col(key), *[c.alias(n) for n, c in more.items()], encode(F.col(text), tokenizer).alias("__ids"))
    both = ids.select(key, *more, "__ids", decode(F.col("__ids"), tokenizer).alias("__decoded"))
    return both.select(
        key,
        (F.octet_length("__ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("__ids", 256).alias("ids_sha256"),
        F.sha2(F.col("__decoded").cast("binary"), 256).alias("decoded_sha256"),
        *more,
    )
