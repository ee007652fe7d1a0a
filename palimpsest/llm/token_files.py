"""Token-ID files: patched frame-of-reference blocks in ascending document order.

File layout (little-endian): "PFR1", u32 ids per block; then for each block u32 minimum, u8 width, u8 0,
u16 number of exceptions, packed low bits of value - minimum, u16 positions and u32 high bits of the
exceptions; then the footer: u64 block starts, i64 doc_ids, u8 doc_id is null, u64 ids before each document in this file
(and their total), u64 numbers of blocks, documents and ids, "PFR1".  The width of a block is the one with the
least bytes among those that hold given percentiles of its values.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm import bpe
from palimpsest.llm.shared import Workspace, integer_key, read

MAGIC = b"PFR1"
BLOCK = 1024
PERCENTILES = (50, 75, 90, 95, 98, 100)
#: Blocks are packed and unpacked this many at a time.
CHUNK = 256
HEAD = struct.Struct("<IBBH")
TAIL = struct.Struct("<QQQ4s")


def widths(low: np.ndarray) -> np.ndarray:
    """For each row (a block less its minimum): the cheapest of the widths that hold the percentiles."""
    ranked = np.sort(low, axis=1)
    n = low.shape[1]
    best, cost = None, None
    for p in PERCENTILES:
        top = ranked[:, max(0, -(-n * p // 100) - 1)]
        w = np.ceil(np.log2(top.astype(np.float64) + 1)).astype(np.int64)
        over = n - np.array([np.searchsorted(r, x, side="left") for r, x in zip(ranked, np.left_shift(np.uint64(1), w.astype(np.uint64)), strict=True)])
        c = n * w / 8 + 6 * over
        if best is None:
            best, cost = w, c
        else:
            better = c < cost
            best, cost = np.where(better, w, best), np.where(better, c, cost)
    return best


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of unsigned 32-bit values below 2**width as rows of packed bytes."""
    bits = np.unpackbits(np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(*values.shape, 4), axis=-1, bitorder="little")
    return np.packbits(bits[:, :, :width].reshape(len(values), -1), axis=1, bitorder="little")


def unpack_bits(packed: np.ndarray, width: int, n: int) -> np.ndarray:
    bits = np.unpackbits(packed, axis=1, count=n * width, bitorder="little").reshape(-1, n, width)
    full = np.zeros((len(packed), n, 32), np.uint8)
    full[:, :, :width] = bits
    return np.packbits(full, axis=-1, bitorder="little").view("<u4").reshape(-1, n)


def pack_blocks(ids: np.ndarray) -> list[bytes]:
    """ids: (blocks, n) unsigned 32-bit."""
    least = ids.min(axis=1)
    low = ids - least[:, None]
    w = widths(low)
    out: list[bytes] = [b""] * len(ids)
    for width in np.unique(w):
        rows = np.flatnonzero(w == width)
        high = low[rows].astype(np.uint64) >> np.uint64(width)
        packed = pack_bits(low[rows] & np.uint32((1 << int(width)) - 1), int(width))
        for k, row in enumerate(rows):
            at = np.flatnonzero(high[k])
            out[row] = HEAD.pack(int(least[row]), int(width), 0, len(at)) + packed[k].tobytes() + at.astype("<u2").tobytes() + high[k][at].astype("<u4").tobytes()
    return out


def unpack_block(data: bytes | memoryview, at: int, n: int) -> np.ndarray:
    least, width, _, over = HEAD.unpack_from(data, at)
    at += HEAD.size
    size = -(-n * width // 8)
    out = unpack_bits(np.frombuffer(data, np.uint8, size, at)[None], width, n)[0] if width else np.zeros(n, np.uint32)
    at += size
    if over:
        where, high = np.frombuffer(data, "<u2", over, at), np.frombuffer(data, "<u4", over, at + 2 * over)
        out[where] |= (high.astype(np.uint64) << np.uint64(width)).astype(np.uint32)
    return out + np.uint32(least)


class Writer:
    """Appends documents; memory is bounded by a chunk of blocks and 24 bytes a document."""

    def __init__(self, to):
        self.to, self.at, self.starts, self.docs, self.before, self.total = to, 0, [], [], [], 0
        self.held: list[np.ndarray] = []
        self.n_held = 0
        self.put(MAGIC + struct.pack("<I", BLOCK))

    def put(self, data: bytes) -> None:
        self.to.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.before.append(self.total)
        self.total += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK * CHUNK:
            self.flush()

    def flush(self, last: bool = False) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        full = len(ids) // BLOCK * BLOCK
        blocks = pack_blocks(ids[:full].reshape(-1, BLOCK)) if full else []
        if last and len(ids) > full:
            blocks += pack_blocks(ids[None, full:])
        for b in blocks:
            self.starts.append(self.at)
            self.put(b)
        self.held, self.n_held = [ids[full:]], len(ids) - full

    def close(self) -> None:
        self.flush(last=True)
        self.put(np.array(self.starts, "<u8").tobytes() + np.array([d or 0 for d in self.docs], "<i8").tobytes() + np.array([d is None for d in self.docs], np.uint8).tobytes() + np.array([*self.before, self.total], "<u8").tobytes())
        self.put(TAIL.pack(len(self.starts), len(self.docs), self.total, MAGIC))


class Reader:
    """Documents of a file, in order or by position, through the index of block starts."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        n_blocks, n_docs, self.total, magic = TAIL.unpack(source.read_at(TAIL.size, size - TAIL.size))
        if magic != MAGIC or source.read_at(4, 0) != MAGIC:
            raise ValueError("not a token file")
        foot = 8 * n_blocks + 9 * n_docs + 8 * (n_docs + 1)
        self.end = size - TAIL.size - foot
        data = source.read_at(foot, self.end)
        self.starts = np.frombuffer(data, "<u8", n_blocks)
        ids = np.frombuffer(data, "<i8", n_docs, 8 * n_blocks)
        null = np.frombuffer(data, np.uint8, n_docs, 8 * n_blocks + 8 * n_docs)
        self.docs = [None if x else int(d) for d, x in zip(ids, null, strict=True)]
        self.before = np.frombuffer(data, "<u8", n_docs + 1, 8 * n_blocks + 9 * n_docs).astype(np.int64)
        (self.block,) = struct.unpack("<I", source.read_at(4, 4))

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop of this file."""
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        at = int(self.starts[first])
        to = int(self.starts[last + 1]) if last + 1 < len(self.starts) else self.end
        data = self.source.read_at(to - at, at)
        got = [unpack_block(data, int(self.starts[b]) - at, min(self.block, self.total - b * self.block)) for b in range(first, last + 1)]
        return np.concatenate(got)[start - first * self.block : stop - first * self.block]

    def documents(self, span: int = BLOCK * CHUNK) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids before it in this file, its ids), reading about span ids at a time."""
        k = 0
        while k < len(self.docs):
            upto = max(k + 1, int(np.searchsorted(self.before, self.before[k] + span, side="right")) - 1)
            upto = min(upto, len(self.docs))
            base = int(self.before[k])
            ids = self.ids(base, int(self.before[upto]))
            for d in range(k, upto):
                yield self.docs[d], int(self.before[d]), ids[int(self.before[d]) - base : int(self.before[d + 1]) - base]
            k = upto


def opened(uri: str):
    """A file system of Arrow's (local, HDFS, S3, GCS) and the path in it."""
    return fs.FileSystem.from_uri(uri)


def write_files(docs: DataFrame, tokenizer: str, work: Workspace, *, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes docs in ascending key order (integers; nulls first, ties by text) and returns the manifest.

    Manifest: (path, n_docs, n_ids, part), one row a file, itself a written table.  Each task
    attempt writes a file of a fresh name, and only files that a finished task reports are in the
    manifest, so lost or repeated attempts leave no trace in the data.
    """
    integer_key(docs, key)  # the files have room for no others
    at = work.path("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = bpe.load(tokenizer)
        end = np.array([end_id], np.uint32)
        system, folder = opened(at)
        system.create_dir(folder, recursive=True)
        part, name = TaskContext.get().partitionId(), f"{uuid.uuid4().hex}.pfr"
        writer = None
        with system.open_output_stream(f"{folder}/{name}") as to:
            writer = Writer(to)
            for b in batches:
                for doc_id, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    ids = np.frombuffer(encoder.encode(value), encoder.code).astype(np.uint32) if value else end[:0]
                    writer.add(doc_id, np.concatenate([ids, end]))
            writer.close()
        if not writer.docs:
            system.delete_file(f"{folder}/{name}")
            return
        yield pa.RecordBatch.from_pydict({"path": [f"{at}/{name}"], "n_docs": [len(writer.docs)], "n_ids": [writer.total], "part": [part]})

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    ordered = rows.repartitionByRange(F.col("k").asc_nulls_first()).sortWithinPartitions(F.col("k").asc_nulls_first(), "t")
    return work.write(ordered.mapInArrow(run, "path string, n_docs long, n_ids long, part long"), "manifest")


def read_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of a manifest, a written table.

    The running total is over files, one small row each.  Each file is read by a task of its own.
    """
    total = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.withColumn("base", F.coalesce(total, F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                system, where = opened(path)
                out: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                with system.open_input_file(where) as source:
                    for doc_id, before, ids in Reader(source).documents():
                        for name, x in zip(out, (doc_id, base + before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                            out[name].append(x)
                        if len(out["start"]) >= 10_000:
                            yield batch(out)
                            out = {name: [] for name in out}
                yield batch(out)

    def batch(out: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({n: pa.array(x, pa.int64()) for n, x in out.items()})

    spread = files.select("path", "base").repartition(max(1, manifest.count()))  # a given number isn't coalesced
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes documents, writes them in ascending doc_id order and reads the files back.

    A null text counts as empty and gives the end id alone; rows with one doc_id follow each other in
    the order of their texts; an empty table gives no file and no row.
    """
    work = Workspace(spark, "op2")
    return read_files(write_files(read(spark, sf_dir, "documents"), bpe.vocabulary("byte_bpe_50k.json"), work))
