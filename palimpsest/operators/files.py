"""File versions as recipes of content-defined chunks, stored once each."""

from __future__ import annotations

import lzma
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.values import digest
from palimpsest.operators.integrity import merkle_root_of

LEAST, MOST, CUT_BITS = 2048, 65536, 13


def gears(seed: int = 11) -> np.ndarray:
    """64-bit random values, one a byte."""
    rng = random.Random(seed)
    return np.array([rng.getrandbits(64) for _ in range(256)], np.uint64)


GEARS = gears()


def rolled(data: bytes) -> np.ndarray:
    """At each byte the rolling hash of the last 64 bytes: the sum of their gears, shifted left once for each later byte.

    Doubling spans the window in six steps over the whole array.
    """
    h = GEARS[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16, 32):
        h[k:] = h[k:] + (h[:-k] << np.uint64(k))
    return h


def chunks(data: bytes) -> Iterator[bytes]:
    """Cuts where a rolling hash of the last 64 bytes begins with 13 zeros, between 2 and 64 KiB."""
    marks = np.flatnonzero(rolled(data) >> np.uint64(64 - CUT_BITS) == 0) if len(data) >= LEAST else np.zeros(0, np.int64)
    start = 0
    while len(data) - start >= LEAST:
        k = np.searchsorted(marks, start + LEAST - 1)  # no window of a chunk's 2 KiB or more reaches before it
        end = min(int(marks[k]) + 1 if k < len(marks) else len(data) + 1, start + MOST)
        if end > len(data):
            break
        yield data[start:end]
        start = end
    if start < len(data) or not data:
        yield data[start:]


def pack(data: bytes, tier: str = "warm") -> bytes:
    return lzma.compress(data, preset=9 | lzma.PRESET_EXTREME) if tier == "cold" else zlib.compress(data, 6)


def unpack(data: bytes, tier: str = "warm") -> bytes:
    return lzma.decompress(data) if tier == "cold" else zlib.decompress(data)


def cut(files: DataFrame, tier: str = "warm") -> DataFrame:
    """files (name, version, data) -> (name, version, pos, hash, size, packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, version, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows = [(name, version, k, digest(x), len(x), pack(x, tier)) for k, x in enumerate(chunks(data or b""))]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()))], names=["name", "version", "pos", "hash", "size", "packed"])

    rows = files.select(F.col("name").cast("string"), F.col("version").cast("long"), F.col("data").cast("binary"))
    return rows.mapInArrow(run, "name string, version long, pos long, hash string, size long, packed binary")


def store(pieces: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """(hash, packed) of the chunks that aren't held yet, once each."""
    new = pieces.select("hash", "packed").dropDuplicates(["hash"])
    return new if held is None else new.join(held.select("hash"), "hash", "left_anti")


def recipes(pieces: DataFrame) -> DataFrame:
    """(name, version, recipe, root)."""
    got = pieces.groupBy("name", "version").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "hash"))), lambda x: x["hash"]).alias("recipe"))
    return got.withColumn("root", merkle_root_of("recipe"))


def restore(recipe: DataFrame, held: DataFrame, tier: str = "warm") -> DataFrame:
    """(name, version, data)."""

    @F.udf("binary")
    def joined(parts):
        return b"".join(unpack(bytes(p["packed"]), tier) for p in parts)

    rows = recipe.select("name", "version", F.posexplode("recipe").alias("pos", "hash")).join(held, "hash")
    return rows.groupBy("name", "version").agg(F.array_sort(F.collect_list(F.struct("pos", "packed"))).alias("p")).select("name", "version", joined("p").alias("data"))


def stats(pieces: DataFrame) -> DataFrame:
    one = pieces.groupBy("hash").agg(F.count("*").alias("n"), F.first("size").alias("size"), F.first(F.length("packed")).alias("packed"))
    return one.agg(F.count("*").alias("unique_chunks"), F.sum(F.col("n") - 1).alias("dedup_hits"), F.sum(F.col("n") * F.col("size")).alias("logical_bytes"), F.sum("packed").alias("stored_bytes")).withColumn("ratio", F.col("logical_bytes") / F.col("stored_bytes"))
