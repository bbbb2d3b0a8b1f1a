"""Media columns as progressive JPEG (op 2).

*Decoding* (any progressive Huffman-coded JPEG of 8 bits with one or three components and no restart markers): every scan
adds to integer coefficient arrays, a band of coefficients (spectral selection) at a bit position (successive
approximation); then numpy undoes the transform, chroma is upsampled to full resolution, and the picture is a tensor of height x width x 3 bytes RGB.

*Storing bytes*: a payload is a positive multiple of 64 bytes, and one 8 x 8 block holds 64 of them, losslessly, since a
JPEG keeps quantised coefficients exactly: coefficient k of a block (in zigzag order) is 256 + byte k. Blocks go to Y, Y, Y, Y, Cb, Cr of 4:2:0
units of 16 x 16 pixels; missing blocks of the last row of units are bytes 0. Scans: DC and two bands of AC without their last bit, then
that bit. Coefficients between 256 and 511 all have one Huffman category, so the bulk of a scan has fixed width and is packed and
unpacked by numpy; other pictures take the general loop. Payloads beyond ``PART`` bytes make several pictures one after the other, so memory is bounded.
The number of blocks stands in a comment.

Defined results: a null or empty text has a payload of 64 bytes 0; equal texts have equal media and features; broken data raises ValueError.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import ship, through

PART = 1 << 20
BATCH = 4 << 20  # bytes of media that go back at a time
UNITS = 64  # 16 x 16 units in a row of a stored picture
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
NATURAL = np.argsort(ZIGZAG)  # where each coefficient of a block, row by row, stands in zigzag order
BANDS = ((1, 5), (6, 63))
#: Huffman tables of stored pictures: class and number, then code lengths, then symbols
DC_TABLE = bytes([0x00, 0, 0, 0, 9, *[0] * 12, *range(9)])
FIRST_TABLE = bytes([0x10, 1, *[0] * 15, 0x08])
REFINE_TABLE = bytes([0x11, 0, 0, 0, 0, 15, *[0] * 11, *(r << 4 for r in range(15))])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _pack(bits: np.ndarray) -> bytes:
    """Bits as entropy-coded bytes: filled up with ones, 0xFF followed by 0."""
    out = np.packbits(bits.astype(np.uint8, copy=False))
    if len(out):
        out[-1] |= (1 << -len(bits) % 8) - 1
    return out.tobytes().replace(b"\xff", b"\xff\x00")


def _dc_bits(diff: np.ndarray) -> np.ndarray:
    """Four bits for the category of each difference, then its bits."""
    size = np.where(diff == 0, 0, np.floor(np.log2(np.maximum(np.abs(diff), 1))).astype(np.int64) + 1)
    value = np.where(diff < 0, diff + (1 << size) - 1, diff)
    word, length = (size << size) | value, 4 + size
    column = np.arange(4 + 11)
    shift = length[:, None] - 1 - column
    return ((word[:, None] >> np.maximum(shift, 0)) & 1)[shift >= 0]


def _refine_bits(last: np.ndarray) -> np.ndarray:
    """One end-of-band run over all blocks (of last bits), with the correction bits of every coefficient."""
    out, at = [], 0
    while at < len(last):
        run = min(len(last) - at, 32767)
        category = run.bit_length() - 1
        head = f"{category:05b}" + (f"{run - (1 << category):0{category}b}" if category else "")
        out += [np.frombuffer(head.encode(), dtype=np.uint8) & 1, last[at : at + run].ravel()]
        at += run
    return np.concatenate(out)


def _scan(components: list[int], first: int, last: int, high: int, low: int, bits: np.ndarray) -> bytes:
    table = 0x01 if high and first else 0x00
    head = bytes([len(components), *(x for c in components for x in (c, table)), first, last, high << 4 | low])
    return _segment(0xDA, head) + _pack(bits)


def _store_part(part: np.ndarray) -> bytes:
    blocks = len(part) // 64
    units = -(-blocks // 6)
    wide = min(units, UNITS)
    tall = -(-units // wide)
    coef = np.zeros((tall * wide * 6, 64), dtype=np.uint8)  # less 256
    coef[:blocks] = part.reshape(-1, 64)
    units6 = coef.reshape(tall, wide, 6, 64)
    y = units6[:, :, :4].reshape(tall, wide, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64)
    planes = {1: y, 2: units6[:, :, 4].reshape(-1, 64), 3: units6[:, :, 5].reshape(-1, 64)}
    dc = (units6[..., 0].astype(np.int64) + 256) >> 1  # unit order
    diff = np.empty_like(dc)
    for a, b in ((0, 4), (4, 5), (5, 6)):
        line = dc[:, :, a:b].ravel()
        diff[:, :, a:b] = np.diff(line, prepend=0).reshape(dc[:, :, a:b].shape)
    out = [b"\xff\xd8", _segment(0xFE, b"blocks " + str(blocks).encode()), _segment(0xDB, bytes([0]) + bytes([1] * 64))]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, 16 * tall, 16 * wide, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    out.append(_segment(0xC4, DC_TABLE + FIRST_TABLE + REFINE_TABLE))
    out.append(_scan([1, 2, 3], 0, 0, 0, 1, _dc_bits(diff.ravel())))
    for c in (1, 2, 3):
        for a, b in BANDS:
            half = (planes[c][:, a : b + 1] >> 1 | 128).reshape(-1, 1)
            bits = np.zeros((len(half), 9), dtype=np.uint8)
            bits[:, 1:] = np.unpackbits(half, axis=1)
            out.append(_scan([c], a, b, 0, 1, bits.ravel()))
    out.append(_scan([1, 2, 3], 0, 0, 1, 0, (units6[..., 0] & 1).ravel()))
    for c in (1, 2, 3):
        out.append(_scan([c], 1, 63, 1, 0, _refine_bits(planes[c][:, 1:] & 1)))
    out.append(b"\xff\xd9")
    return b"".join(out)


def payload_of(text: str | None) -> bytes:
    """The text in UTF-8, filled up with bytes 0 to a positive multiple of 64."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def store(payload: bytes) -> bytes:
    """The payload as one or more progressive JPEG pictures."""
    if not payload or len(payload) % 64:
        raise ValueError("a payload is a positive multiple of 64 bytes")
    data = np.frombuffer(payload, dtype=np.uint8)
    return b"".join(_store_part(data[i : i + PART]) for i in range(0, len(data), PART))


class _Bits:
    """Bits of one scan: as an array, and as a number window by window."""

    def __init__(self, data: bytes):
        self.data = data.replace(b"\xff\x00", b"\xff")
        self.array = np.unpackbits(np.frombuffer(self.data, dtype=np.uint8))
        self.padded = self.data + bytes(8)
        self.at = 0

    def take(self, n: int) -> np.ndarray:
        if self.at + n > len(self.array):
            raise ValueError("a scan ends too early")
        self.at += n
        return self.array[self.at - n : self.at]

    def peek16(self) -> int:
        i = self.at >> 3
        return (int.from_bytes(self.padded[i : i + 3], "big") >> (8 - (self.at & 7))) & 0xFFFF

    def number(self, n: int) -> int:
        if not n:
            return 0
        i = self.at >> 3
        v = (int.from_bytes(self.padded[i : i + 4], "big") >> (32 - n - (self.at & 7))) & ((1 << n) - 1)
        self.at += n
        if self.at > len(self.array) + 16:
            raise ValueError("a scan ends too early")
        return v


@lru_cache(maxsize=64)
def _huffman(lengths: bytes, symbols: bytes) -> tuple[list[int], list[int]]:
    """Symbol and code length for each window of 16 bits (length 0: no code)."""
    symbol, length = [0] * 65536, [0] * 65536
    code = k = 0
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            a, size = code << (16 - n), 1 << (16 - n)
            symbol[a : a + size], length[a : a + size] = [symbols[k]] * size, [n] * size
            code, k = code + 1, k + 1
        code <<= 1
    return symbol, length


class Picture:
    """Coefficient arrays of a progressive JPEG; planes: (rows, columns, 64), in zigzag order."""

    def __init__(self, data: bytes):
        self.tables: dict[int, tuple[bytes, bytes]] = {}
        self.quant: dict[int, np.ndarray] = {}
        self.blocks: int | None = None
        self.planes: dict[int, np.ndarray] = {}
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        at = 2
        while True:
            if data[at : at + 1] != b"\xff":
                raise ValueError("a marker is missing")
            marker = data[at + 1]
            if marker == 0xD9:
                self.end = at + 2
                return
            size = struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                self._quantisation(body)
            elif marker == 0xC4:
                self._tables(body)
            elif marker == 0xC2:
                self._frame(body)
            elif marker == 0xFE and body.startswith(b"blocks "):
                self.blocks = int(body[7:])
            elif marker == 0xDD and struct.unpack(">H", body)[0]:
                raise ValueError("restart markers are not read")
            elif marker == 0xDA:
                m = re.compile(rb"\xff[^\x00]").search(data, at)
                if not m:
                    raise ValueError("a scan has no end")
                self._scan(body, _Bits(data[at : m.start()]))
                at = m.start()
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise ValueError("not a progressive Huffman-coded JPEG")

    def _quantisation(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            wide, number = body[at] >> 4, body[at] & 15
            n = 64 << wide
            self.quant[number] = np.frombuffer(body, dtype=">u2" if wide else np.uint8, count=64, offset=at + 1).astype(np.float64)
            at += 1 + n

    def _tables(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            n = sum(body[at + 1 : at + 17])
            self.tables[body[at]] = body[at + 1 : at + 17], body[at + 17 : at + 17 + n]
            at += 17 + n

    def _frame(self, body: bytes) -> None:
        bits, self.height, self.width, n = struct.unpack_from(">BHHB", body)
        if bits != 8 or n not in (1, 3):
            raise ValueError("only 8 bits with one or three components are read")
        self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        self.h, self.v = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        self.wide, self.tall = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        for c, h, v, _ in self.parts:
            self.planes[c] = np.zeros((self.tall * v, self.wide * h, 64), dtype=np.int32)

    def _scan(self, body: bytes, bits: _Bits) -> None:
        n = body[0]
        chosen = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)]
        first, last, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
        of = {p[0]: p for p in self.parts}
        if first == 0:
            self._dc(chosen, of, high, low, bits)
            return
        c, _, table = chosen[0]
        _, h, v, _ = of[c]
        rows, columns = -(-(-(-self.height * v // self.v)) // 8), -(-(-(-self.width * h // self.h)) // 8)
        band = self.planes[c][:rows, :columns, first : last + 1].reshape(-1, last + 1 - first)
        if high == 0:
            self._ac_first(band, table, low, bits)
        else:
            self._ac_refine(band, table, low, bits)
        self.planes[c][:rows, :columns, first : last + 1] = band.reshape(rows, columns, -1)

    def _dc(self, chosen, of, high: int, low: int, bits: _Bits) -> None:
        """A DC scan; views give each component's values in the order of the scan."""
        if len(chosen) == 1:
            c, table, _ = chosen[0]
            _, h, v, _ = of[c]
            rows, columns = -(-(-(-self.height * v // self.v)) // 8), -(-(-(-self.width * h // self.h)) // 8)
            groups = [(c, table, rows * columns, None)]
            units = 1
        else:
            groups = [(c, table, of[c][1] * of[c][2], of[c]) for c, table, _ in chosen]
            units = self.wide * self.tall
        total = sum(g[2] for g in groups)
        if high:
            values = bits.take(units * total).astype(np.int64).reshape(units, total) << low
        else:
            lookups = [x for _, table, k, _ in groups for x in [_huffman(*self.tables[table])] * k]
            who = [i for i, g in enumerate(groups) for _ in range(g[2])]
            values = np.array(self._differences(units, lookups, bits), dtype=np.int64).reshape(units, total)
            place = np.array(who)
            for i in range(len(groups)):
                mine = values[:, place == i]
                values[:, place == i] = (np.cumsum(mine.ravel()) << low).reshape(mine.shape)
        at = 0
        for c, _, k, part in groups:
            mine = values[:, at : at + k]
            at += k
            if part is None:
                v, h = of[c][2], of[c][1]
                rows, columns = -(-(-(-self.height * v // self.v)) // 8), -(-(-(-self.width * h // self.h)) // 8)
                self.planes[c][:rows, :columns, 0] += mine.reshape(rows, columns)
            else:
                _, h, v, _ = part
                self.planes[c][..., 0] += mine.reshape(self.tall, self.wide, v, h).transpose(0, 2, 1, 3).reshape(self.tall * v, self.wide * h)

    @staticmethod
    def _differences(units: int, lookups, bits: _Bits) -> list[int]:
        out = []
        at, padded, top = bits.at, bits.padded, len(bits.array) + 16
        for _ in range(units):
            for symbol, length in lookups:
                i = at >> 3
                window = int.from_bytes(padded[i : i + 5], "big") << (at & 7) & 0xFFFFFFFFFF
                n = length[window >> 24]
                if not n or at > top:
                    raise ValueError("no such code")
                size = symbol[window >> 24]
                at += n + size
                if size:
                    v = (window >> (40 - n - size)) & ((1 << size) - 1)
                    out.append(v if v >> (size - 1) else v - (1 << size) + 1)
                else:
                    out.append(0)
        bits.at = at
        return out

    def _ac_first(self, band: np.ndarray, table: int, low: int, bits: _Bits) -> None:
        lengths, symbols = self.tables[0x10 | table]
        if len(symbols) == 1 and lengths[0] == 1 and symbols[0] >> 4 == 0 and symbols[0]:
            # one code of one bit: every coefficient has it and as many bits as it says
            size = symbols[0]
            taken = bits.take(band.size * (1 + size)).reshape(-1, 1 + size)
            if taken[:, 0].any():
                raise ValueError("no such code")
            v = np.packbits(taken[:, 1:], axis=1).ravel() if size == 8 else taken[:, 1:].astype(np.int32) @ (1 << np.arange(size - 1, -1, -1, dtype=np.int32))
            v = v.reshape(band.shape).astype(np.int32)
            if v.size and v.min() < 1 << (size - 1):
                v = np.where(v >> (size - 1), v, v - (1 << size) + 1)
            band += v << low
            return
        symbol, length = _huffman(lengths, symbols)
        run = 0
        for block in band:
            if run:
                run -= 1
                continue
            k = 0
            while k < len(block):
                w = bits.peek16()
                if not length[w]:
                    raise ValueError("no such code")
                bits.at += length[w]
                r, s = symbol[w] >> 4, symbol[w] & 15
                if s:
                    k += r
                    v = bits.number(s)
                    block[k] = (v if v >> (s - 1) else v - (1 << s) + 1) * (1 << low)
                    k += 1
                elif r == 15:
                    k += 16
                else:
                    run = (1 << r) + bits.number(r) - 1
                    break

    def _ac_refine(self, band: np.ndarray, table: int, low: int, bits: _Bits) -> None:
        symbol, length = _huffman(*self.tables[0x10 | table])
        bit = 1 << low

        def correct(values: np.ndarray) -> None:
            if values.size and values.min() > 0:
                values += bit * bits.take(values.size).reshape(values.shape).astype(np.int32)
                return
            seen = values != 0
            values[seen] += np.where(values[seen] < 0, -bit, bit) * bits.take(int(seen.sum()))

        at = 0
        while at < len(band):
            block, k = band[at], 0
            while k < len(block):
                w = bits.peek16()
                if not length[w]:
                    raise ValueError("no such code")
                bits.at += length[w]
                r, s = symbol[w] >> 4, symbol[w] & 15
                if not s and r < 15:
                    run = (1 << r) + bits.number(r)
                    correct(block[k:])
                    if run > 1:  # whole blocks: one step
                        correct(band[at + 1 : at + run])
                    at += run - 1
                    break
                new = (bit if bits.number(1) else -bit) if s else 0
                while k < len(block):
                    if block[k]:
                        if bits.number(1):
                            block[k] += bit if block[k] > 0 else -bit
                    elif r == 0:
                        block[k] = new
                        k += 1
                        break
                    else:
                        r -= 1
                    k += 1
            at += 1

    def rgb(self) -> np.ndarray:
        """height x width x 3 bytes. Whole numbers throughout, so that no machine's rounding shows."""
        full = []
        for c, h, v, q in self.parts:
            rows, columns, _ = self.planes[c].shape
            coef = (self.planes[c].reshape(-1, 64) * self.quant[q])[:, NATURAL]
            # both products are exact in double precision: less than 2 ** 53
            half = (coef.reshape(-1, 8) @ _BASIS.T).reshape(-1, 8, 8).transpose(0, 2, 1)
            pixels = (half.reshape(-1, 8) @ _BASIS.T).reshape(rows, columns, 8, 8).transpose(0, 3, 1, 2).reshape(rows * 8, columns * 8)
            plane = np.clip(np.floor(pixels * 2.0**-24 + 128.5), 0, 255).astype(np.int32)
            full.append(plane.repeat(self.v // v, axis=0).repeat(self.h // h, axis=1)[: self.height, : self.width])
        if len(full) == 1:
            return np.repeat(full[0].astype(np.uint8)[..., None], 3, axis=2)
        y, cb, cr = full
        cb, cr = cb - 128, cr - 128
        out = np.empty((*y.shape, 3), dtype=np.uint8)
        for i, x in enumerate((y + (91881 * cr + 32768 >> 16), y - (22554 * cb + 46802 * cr + 32768 >> 16), y + (116130 * cb + 32768 >> 16))):
            out[..., i] = np.clip(x, 0, 255)
        return out

    def payload(self) -> bytes:
        """The bytes that store() put in."""
        if self.blocks is None:
            raise ValueError("not a stored payload")
        y = self.planes[1].reshape(self.tall, 2, self.wide, 2, 64).transpose(0, 2, 1, 3, 4).reshape(self.tall, self.wide, 4, 64)
        units = np.concatenate([y, self.planes[2][:, :, None], self.planes[3][:, :, None]], axis=2).reshape(-1, 64)[: self.blocks] - 256
        if units.min() < 0 or units.max() > 255:
            raise ValueError("not a stored payload")
        return units.astype(np.uint8).tobytes()


_U = np.arange(8)
_BASIS = np.rint(4096 * np.cos((2 * _U[:, None] + 1) * _U[None, :] * np.pi / 16) * np.where(_U == 0, np.sqrt(1 / 8), 0.5)[None, :])


def pictures(media: bytes) -> Iterator[Picture]:
    while media:
        p = Picture(media)
        yield p
        media = media[p.end :]


def feature_of(tensors: list[np.ndarray]) -> str:
    """Size, mean and spread of each colour, and how often each eighth of the brightness occurs."""
    pixels = sum(t.shape[0] * t.shape[1] for t in tensors)
    counts = np.stack([sum(np.bincount(t[..., c].ravel(), minlength=256) for t in tensors) for c in range(3)])
    total, squares, eighths = counts @ np.arange(256), counts @ np.arange(256) ** 2, counts[1].reshape(8, 32).sum(axis=1)
    mean = total / pixels
    spread = np.sqrt(np.maximum(0.0, squares / pixels - mean**2))
    numbers = lambda x: ",".join(f"{v:.3f}" for v in x)
    return f"{pixels}|{numbers(mean)}|{numbers(spread)}|{numbers(eighths / pixels)}"


def stored(text: Column) -> Column:
    """text -> media (binary)."""

    @F.pandas_udf("binary")
    def to_jpeg(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in through(batches):
            out, size = [], 0
            for t in s:
                out.append(store(payload_of(t)))
                size += len(out[-1])
                if size > BATCH:
                    yield pd.Series(out, dtype=object)
                    out, size = [], 0
            yield pd.Series(out, dtype=object)

    return to_jpeg(text)


def tensors(media: Column) -> Column:
    """media (any progressive JPEG, the first picture) -> struct(height, width, rgb: binary of height x width x 3, error).

    Null or empty media have no size; of what cannot be read, error says why and the rest is null.
    """

    @F.pandas_udf("height int, width int, rgb binary, error string")
    def to_rgb(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        frame = lambda rows: pd.DataFrame(rows, columns=["height", "width", "rgb", "error"]).astype({"height": "Int32", "width": "Int32"})
        for s in through(batches):
            rows, size = [], 0
            for m in s:
                try:
                    t = Picture(m).rgb() if m else np.zeros((0, 0, 3), dtype=np.uint8)
                    rows.append((*t.shape[:2], t.tobytes(), None))
                    size += t.size
                except (ValueError, IndexError, KeyError, struct.error) as e:
                    rows.append((None, None, None, f"{type(e).__name__}: {e}"))
                if size > BATCH:
                    yield frame(rows)
                    rows, size = [], 0
            yield frame(rows)

    return to_rgb(media)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store every text, read the stored bytes back: what came back, what was stored, and features of the pictures."""
    ship(docs.sparkSession)

    @F.pandas_udf("payload_bytes long, payload_sha256 string, tail_crc32 long, feature string")
    def read_back(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in through(batches):
            out = []
            for media in s:
                found = list(pictures(media))
                payload = b"".join(p.payload() for p in found)
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), feature_of([p.rgb() for p in found])))
            yield pd.DataFrame(out, columns=["payload_bytes", "payload_sha256", "tail_crc32", "feature"])

    media = docs.select(key, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), stored(F.col(text)).alias("media"))
    back = media.select(key, "n_bytes", "media", read_back("media").alias("b"))
    return back.select(key, "n_bytes", "b.payload_bytes", "b.payload_sha256", "b.tail_crc32", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "b.feature")
