"""Byte-level BPE by a global shuffle of distinct words, and decoding by the token-byte table.

1. Blocks of documents are split into pre-tokens; a block deals its list of words over buckets by their hash.
2. A bucket gathers the words of all blocks and encodes each distinct word once; every block gets
   its words' ids back.
3. Blocks are split again, now into each document's pre-tokens by position, as numbers of the block's list of
   words.  They meet the words' ids; documents are put together by position, and decoded.
Positions and words travel packed: a row holds the words of a block that fall into a bucket, so there are blocks times
buckets of them, and never more than one for each distinct word of a block.  Splitting twice costs less than keeping the positions
on disk from 1 to 3; checksums of the words make sure that both times saw the same blocks.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.shared import Workspace, is_scan, read
from palimpsest.llm.token_counts import parts

#: Characters of a block, beyond which no document is added to it.
BLOCK_CHARS = 24_000_000
#: Characters of text for each bucket of words.
BUCKET_CHARS = 32_000_000


class Ranks:
    """A file of ranks: encodes single pre-tokens, and holds the bytes of each id."""

    _loaded: dict[str, Ranks] = {}

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:  # a file of the library, on every machine
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.find = regex.compile(pattern).findall
        self.piece = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        n = max(ranks.values()) + 1
        table = [b""] * n
        for token, i in ranks.items():
            table[i] = token
        self.bytes = Ragged.of(table)
        self.decimal = Ragged.of([b"%d," % i for i in range(n)])

    @classmethod
    def load(cls, path: str, pattern: str) -> Ranks:
        return cls._loaded.get(path) or cls._loaded.setdefault(path, cls(path, pattern))


class Ragged:
    """Arrays of unequal lengths, laid end to end."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.flat, self.sizes = flat, sizes
        self.starts = np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.int64)

    @classmethod
    def of(cls, items: list[bytes]) -> Ragged:
        return cls(np.frombuffer(b"".join(items), np.uint8), np.array([len(x) for x in items], np.int64))

    def take(self, at: np.ndarray) -> np.ndarray:
        """The items at these places, end to end."""
        n = self.sizes[at]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[at] - ends + n, n) + np.arange(total)]


def squeezed(*arrays: np.ndarray | bytes) -> bytes:
    raw = [a if isinstance(a, bytes) else a.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(struct.pack(f"<I{len(raw)}Q", len(raw), *map(len, raw)) + b"".join(raw))


def spread_out(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    (n,) = struct.unpack_from("<I", raw)
    at, out = 4 + 8 * n, []
    for size in struct.unpack_from(f"<{n}Q", raw, 4):
        out.append(raw[at : at + size])
        at += size
    return out


def planes(values: np.ndarray) -> np.ndarray:
    """The bytes of 32-bit values, all lowest first: they compress better so."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)


def unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


class Block:
    def __init__(self):
        self.words: dict[str, int] = {}
        self.keys, self.sizes, self.chars, self.at = [], [], 0, []

    def add(self, key, text: str, find) -> None:
        n = 0
        for part in parts(text) if text else ():
            words = self.words
            at = [words.setdefault(w, len(words)) for w in find(part)]
            self.at.append(np.array(at, np.uint32))
            n += len(at)
        self.keys.append(key)
        self.sizes.append(n)
        self.chars += len(text)

    def rows(self, block: int, buckets: int, key_type: pa.DataType, *, own: bool) -> list[tuple[int, int, bytes]]:
        """(block, bucket, packed): with own one row of keys and positions, else its words, a row for each bucket."""
        raw = [w.encode("utf-8", "surrogatepass") for w in self.words]
        bucket = np.fromiter((zlib.crc32(w) % buckets for w in raw), np.uint32, len(raw))
        order = np.argsort(bucket, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []
        held = [(int(bucket[g[0]]), [raw[i] for i in g]) for g in groups]
        if not own:
            return [(block, b, squeezed(np.array([len(x) for x in words], "<u4"), b"".join(words))) for b, words in held]
        keys = pa.RecordBatch.from_arrays([pa.array(self.keys, key_type)], names=["k"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, keys.schema) as to:
            to.write_batch(keys)
        at = np.concatenate(self.at) if self.at else np.zeros(0, np.uint32)
        sums = np.array([zlib.crc32(b"".join(words)) for _, words in held], "<u4")
        return [(block, -1, squeezed(sink.getvalue().to_pybytes(), np.array(self.sizes, "<u8"), planes(at), planes(bucket), sums))]


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, key: str = "doc_id", text: str = "text", outputs: str = "digests", work: Workspace | None = None) -> DataFrame:
    """Encodes and decodes each row's whole text.

    outputs "digests": (key, n_tokens, ids_sha256, decoded_sha256); "ids": (key, n_tokens, ids, decoded_sha256).
    A null text counts as empty: no ids.  Null keys and repeated rows come out as they went in; an
    empty table gives an empty result.  Texts are cut at safe places while they are split, which changes no match.
    docs is read twice: what isn't a plain scan of files, whose partitions are the same each time, is written first.
    """
    work = work or Workspace(docs.sparkSession, "bpe")
    back = docs.schema[key].dataType
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("t"))
    if not is_scan(docs):
        rows = work.write(rows, "texts")
    chars = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    buckets = max(32, -(-chars // BUCKET_CHARS))
    key_type = pa.int64() if back.simpleString() == "bigint" else pa.string()
    kind = "long" if key_type == pa.int64() else "string"

    def split(own: bool):
        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            find = Ranks.load(ranks_path, pattern).find
            number, block = TaskContext.get().partitionId() << 32, Block()

            def packed() -> pa.RecordBatch:
                made = block.rows(number, buckets, key_type, own=own)
                return pa.RecordBatch.from_arrays([pa.array([r[k] for r in made], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["block", "bucket", "packed"])

            for b in batches:
                for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    block.add(k, t or "", find)
                    if block.chars >= BLOCK_CHARS:
                        yield packed()
                        number, block = number + 1, Block()
            if block.keys:
                yield packed()

        return rows.select(F.col("key").cast(kind).alias("k"), "t").mapInArrow(blocks, "block long, bucket long, packed binary")

    def distinct(table: pa.Table) -> pa.Table:
        piece, known, out = Ranks.load(ranks_path, pattern).piece, {}, []
        for data in table.column("packed").to_pylist():
            sizes, flat = spread_out(data)
            at, counts, ids = 0, [], []
            for n in np.frombuffer(sizes, "<u4").tolist():
                w = flat[at : at + n]
                at += n
                got = known.get(w)
                if got is None:  # each distinct word once
                    got = known[w] = piece(w)
                counts.append(len(got))
                ids += got
            out.append(squeezed(np.array(counts, "<u4"), planes(np.array(ids, np.uint32)), np.array([zlib.crc32(flat)], "<u4")))
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "packed": pa.array(out, pa.binary())})

    words = split(False).groupBy("bucket").applyInArrow(distinct, "block long, bucket long, packed binary")
    digests = outputs == "digests"

    def assemble(block: pa.Table, words: pa.Table) -> pa.Table:
        ranks = Ranks.load(ranks_path, pattern)
        out: dict[str, list] = {n: [] for n in ("k", "n", "ids", "decoded")}
        for data in block.column("packed").to_pylist():
            keys, sizes, at, bucket, sums = spread_out(data)
            at, bucket = unplanes(at), unplanes(bucket)
            got = {b: spread_out(p) for b, p in zip(words.column("bucket").to_pylist(), words.column("packed").to_pylist(), strict=True)}
            if b"".join(got[b][2] for b in sorted(got)) != sums:
                raise ValueError("docs gave other partitions when it was read again")
            order = np.argsort(bucket, kind="stable")  # a bucket's words are in the order of the block's list
            counts = np.concatenate([np.frombuffer(got[b][0], "<u4") for b in sorted(got)]) if got else np.zeros(0, np.uint32)
            flat = np.concatenate([unplanes(got[b][1]) for b in sorted(got)]) if got else np.zeros(0, np.uint32)
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            table = Ragged(flat, counts.astype(np.int64))
            ends = np.cumsum(np.frombuffer(sizes, "<u8")).astype(np.int64)
            starts = np.concatenate([[0], ends])
            for k, s, e in zip(pa.ipc.open_stream(keys).read_all().column("k").to_pylist(), starts, ends, strict=False):
                ids = table.take(place[at[s:e]])
                decoded = ranks.bytes.take(ids).tobytes()
                out["k"].append(k)
                out["n"].append(len(ids))
                out["ids"].append(hashlib.sha256(ranks.decimal.take(ids).tobytes()[:-1]).hexdigest() if digests else ids.astype(np.int32))
                out["decoded"].append(hashlib.sha256(decoded).hexdigest())
        kinds = (key_type, pa.int64(), pa.string() if digests else pa.list_(pa.int32()), pa.string())
        return pa.table({c: pa.array(x, t) for (c, x), t in zip(out.items(), kinds, strict=True)})

    shape = f"k {kind}, n long, " + ("ids string" if digests else "ids array<int>") + ", decoded string"
    done = split(True).groupBy("block").cogroup(words.groupBy("block")).applyInArrow(assemble, shape)
    names = ("n_tokens", "ids_sha256" if digests else "ids", "decoded_sha256")
    return done.select(F.col("k").cast(back).alias(key), *[F.col(a).alias(b) for a, b in zip(("n", "ids", "decoded"), names, strict=True)])


def op7_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi(read(spark, sf_dir, "documents"))


def multi(docs: DataFrame, **more) -> DataFrame:
    """With the public multilingual ranks."""
    import public_tokenizers

    return encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, **more)
