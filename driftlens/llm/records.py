"""Token ids as length-delimited binary records with an offset index (op 6).

A dataset is a folder of pairs of files, in ascending order of key over all files:

- ``part-NNNNNN.rec``: records one after the other, each framed as
  ``length u64 | masked crc32(length) u32 | payload | masked crc32(payload) u32`` (all little-endian; a masked sum is
  turned by 15 bits and moved, so that sums of data that hold sums stay sound). A payload is
  ``key i64 | flags u8 | ids``; flag 1: the key is null, flag 2: ids have four bytes, else two.
- ``part-NNNNNN.idx``: for each record ``offset u64 | ids before it in this part u64``, so that records can be read in any order.
- ``manifest``: a Parquet table with a row a part: its number, records and ids.

Files are written under a name of their own attempt and renamed when complete, so a task that is lost or runs
twice leaves either nothing or the same bytes. Rows with equal keys come in order of their texts; a null key comes
first; a null text counts as empty, its record holds the end id only; an empty table gives no parts.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftlens.llm import bpe
from driftlens.llm.common import filesystem, new_folder, ship

HEAD = "<qB"  # key, flags
FRAME = "<QI"  # length, its masked sum
FRAMED = struct.calcsize(FRAME)
BLOCK = 1 << 22  # bytes that a reader takes at a time


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def _records(stream) -> Iterator[bytes]:
    """Payloads of a .rec file, checked; holds one block or one record at a time."""
    held = b""
    while True:
        at = 0
        while len(held) - at >= FRAMED:
            n, check = struct.unpack_from(FRAME, held, at)
            if masked(held[at : at + 8]) != check:
                raise ValueError("broken length of a record")
            if len(held) - at < FRAMED + n + 4:
                break
            payload = held[at + FRAMED : at + FRAMED + n]
            if masked(payload) != struct.unpack_from("<I", held, at + FRAMED + n)[0]:
                raise ValueError("broken payload of a record")
            yield payload
            at += FRAMED + n + 4
        need = FRAMED if len(held) - at < FRAMED else FRAMED + n + 4
        more = stream.read(max(BLOCK, need - (len(held) - at)))
        if not more:
            if len(held) > at:
                raise ValueError("a file of records ends too early")
            return
        held = held[at:] + more


def _open_payload(payload: bytes) -> tuple[int | None, bytes]:
    key, flags = struct.unpack_from(HEAD, payload)
    ids = payload[struct.calcsize(HEAD) :]
    if not flags & 2:
        ids = np.frombuffer(ids, dtype="<u2").astype("<u4").tobytes()
    return (None if flags & 1 else key), ids


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every text of docs, append end_id, write the dataset; returns the manifest, read back.

    One shuffle: rows are ranged by key, so that the files are in order among themselves.
    """
    spark = docs.sparkSession
    ship(spark)

    def write_part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = filesystem(folder)
        encoder = bpe.load(tokenizer)
        narrow = len(encoder.pieces) <= 1 << 16 and end_id < 1 << 16
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        n = total = at = 0
        names = [f"{base}/part-{part:06d}.{x}" for x in ("rec", "idx")]
        tail = np.array([end_id], dtype="<u4")
        files = None
        for batch in batches:
            if files is None:
                fs.create_dir(base, recursive=True)
                files = [fs.open_output_stream(f"{x}.{attempt}") for x in names]
            for k, ids in zip(batch["key"], encoder.encode_many(batch["text"])):
                ids = np.concatenate([np.frombuffer(ids, dtype="<u4"), tail])
                null = pd.isna(k)
                record = frame(struct.pack(HEAD, 0 if null else int(k), int(null) + 2 * (not narrow)) + (ids.astype("<u2") if narrow else ids).tobytes())
                files[0].write(record)
                files[1].write(struct.pack("<QQ", at, total))
                at, n, total = at + len(record), n + 1, total + len(ids)
        if files is not None:
            for f, x in zip(files, names):
                f.close()
                fs.move(f"{x}.{attempt}", x)
            yield pd.DataFrame({"part": [part], "n_records": [n], "n_ids": [total]})

    rows = docs.select(F.col(key).cast("long").cast("string").alias("key"), F.col(key).cast("long").alias("_order"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(F.col("_order").asc_nulls_first()).sortWithinPartitions(F.col("_order").asc_nulls_first(), "text")
    manifest = f"{folder}/manifest"
    ordered.select("key", "text").mapInPandas(write_part, "part int, n_records long, n_ids long").write.parquet(manifest)
    return spark.read.schema("part int, n_records long, n_ids long").parquet(manifest)


def read_records(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Every record of a dataset from its files: key, start (ids in all records before it), ids (binary, four bytes each)."""
    return _read(manifest, folder, "key long, start long, ids binary", lambda key, start, ids: (key, start, ids))


def _read(manifest: DataFrame, folder: str, schema: str, make) -> DataFrame:
    ship(manifest.sparkSession)
    columns = [c.split()[0] for c in schema.split(", ")]
    whole = [c for c in schema.split(", ") if c.endswith(" long")]

    def read_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = filesystem(folder)
        for batch in batches:
            for part, before in zip(batch["part"], batch["before"]):
                rows, size = [], 0
                with fs.open_input_stream(f"{base}/part-{part:06d}.rec") as f:
                    for payload in _records(f):
                        key, ids = _open_payload(payload)
                        rows.append(make(key, before, ids))
                        before += len(ids) // 4
                        size += len(ids)
                        if len(rows) >= 10_000 or size > BLOCK * 4:
                            yield frame_of(rows)
                            rows, size = [], 0
                if rows:
                    yield frame_of(rows)

    def frame_of(rows):
        out = pd.DataFrame(rows, columns=columns)
        return out.astype({c.split()[0]: "Int64" for c in whole})

    # a row a part: as few rows as files, so that one task can sum them up
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = manifest.select("part", before.alias("before"))
    return parts.repartition(manifest.sparkSession.sparkContext.defaultParallelism * 2, "part").mapInPandas(read_parts, schema)


def fetch(wanted: DataFrame, folder: str) -> DataFrame:
    """wanted (part, nth) -> part, nth, key, start (ids before the record in its part), ids: single records in any order, each by two reads at an offset from the index."""
    ship(wanted.sparkSession)

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = filesystem(folder)
        for batch in batches:
            for part, of_part in batch.groupby("part"):
                rows, size = [], 0
                with fs.open_input_file(f"{base}/part-{part:06d}.idx") as idx, fs.open_input_file(f"{base}/part-{part:06d}.rec") as rec:
                    for nth in of_part["nth"]:
                        offset, before = struct.unpack("<QQ", idx.read_at(16, 16 * nth))
                        n, check = struct.unpack(FRAME, head := rec.read_at(FRAMED, offset))
                        if masked(head[:8]) != check:
                            raise ValueError("broken length of a record")
                        body = rec.read_at(n + 4, offset + FRAMED)
                        if masked(body[:n]) != struct.unpack("<I", body[n:])[0]:
                            raise ValueError("broken payload of a record")
                        key, ids = _open_payload(body[:n])
                        rows.append((part, nth, key, before, ids))
                        size += len(ids)
                        if size > BLOCK * 4:
                            yield pd.DataFrame(rows, columns=["part", "nth", "key", "start", "ids"]).astype({"key": "Int64"})
                            rows, size = [], 0
                yield pd.DataFrame(rows, columns=["part", "nth", "key", "start", "ids"]).astype({"key": "Int64"})

    return wanted.select(F.col("part").cast("int"), F.col("nth").cast("long")).mapInPandas(look_up, "part int, nth long, key long, start long, ids binary")


def digests(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write docs as records, read the files back: doc_id, start, n_tokens, ids_crc32 of each record."""
    spark = docs.sparkSession
    folder = new_folder(spark, "records")
    manifest = write(docs, folder, tokenizer, end_id)
    return _read(manifest, folder, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda key, start, ids: (key, start, len(ids) // 4, zlib.crc32(ids)))
