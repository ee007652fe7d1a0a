"""Embedding near-dedup: int8 tile products with error bounds; pairs in doubt are recomputed in double precision.

Vectors of one label are dealt into cells along a fixed direction.  Unit vectors whose cosine reaches
the threshold are within sqrt(2 - 2 * threshold) of each other, so cells of that width link only with
themselves and the next.  Cells are cut into blocks, each packed into one row; a task multiplies two blocks and returns
each vector's number of links and a spanning forest of them, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.shared import Workspace, components, integer_key, read

#: Bytes of the vectors of a block, and its rows at most; a tile is the product of two blocks.
BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 4096
#: Rows of a tile that are multiplied at once.
STRIP = 512
#: Columns whose int8 products add up exactly in float32: 1040 * 127 ** 2 < 2 ** 24.
EXACT_COLUMNS = 1040
#: Candidate pairs that are recomputed at once.
AT_ONCE = 1 << 16


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of unit length as int8 values (held in float32, for the matrix product), scales, and the norms of what is lost."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None])
    return q.astype(np.float32), scale, np.linalg.norm(x - q * scale[:, None], axis=1)


def exact_product(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Products of int8 rows without rounding, whatever their length: each run of columns is exact in float32, the sum in float64."""
    out = np.zeros((len(q), len(r)))
    for c in range(0, q.shape[1], EXACT_COLUMNS):
        out += q[:, c : c + EXACT_COLUMNS] @ r[:, c : c + EXACT_COLUMNS].T
    return out


def close_pairs(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of unit length with a product of at least the threshold; i < j where x is y.

    |xy - sx sy qx qy| <= |ex| |y| + |x - ex| |ey| <= |ex| + (1 + |ex|) |ey|; a pair above the
    threshold without its bound, or below even with it, isn't recomputed.
    """
    qx, sx, ex = quantised(x)
    qy, sy, ey = (qx, sx, ex) if same else quantised(y)
    left, right = [], []
    for at in range(0, len(x), STRIP):
        e = ex[at : at + STRIP, None]
        rough = exact_product(qx[at : at + STRIP], qy) * sx[at : at + STRIP, None] * sy[None]
        slack = e + (1 + e) * ey[None] + 1e-9
        i, j = np.nonzero(rough + slack >= threshold)
        if same:
            i, j = i[i + at < j], j[i + at < j]
        sure = (rough - slack)[i, j] >= threshold
        i = i + at
        for s in range(0, len(i), AT_ONCE):
            p = s + np.flatnonzero(~sure[s : s + AT_ONCE])
            sure[p] = np.einsum("ij,ij->i", x[i[p]], y[j[p]]) >= threshold
        left.append(i[sure])
        right.append(j[sure])
    return np.concatenate(left), np.concatenate(right)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For n nodes with links i-j: the least node reachable from each."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of unit length, of rows of any magnitude."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_dedup(vectors: DataFrame, work: Workspace, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98) -> DataFrame:
    """(key, n_links, component_id, kept) for each row; other columns are left out.  Keys are integers.

    Only vectors of equal, non-null labels and equal length are compared.  Null, zero and non-finite vectors
    link with nothing and are kept.  Equal vectors are compared once, as one.  Repeated rows count as
    vectors each; rows with a null key link with nothing.  An empty table gives an empty result.
    """
    kind = integer_key(vectors, key)
    narrow = isinstance(vectors.schema[vector].dataType.elementType, T.FloatType)  # then 4 bytes a component say all
    size, width = ("<f4", 4) if narrow else ("<f8", 8)
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    sound = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).alias("l"), F.col(vector).alias("v"), (sound & F.col(label).isNotNull() & F.col(key).isNotNull()).alias("sound"))
    rows = work.write(rows.withColumns({"h": F.xxhash64("v"), "g": F.xxhash64(F.lit("other"), "v")}), "vectors")
    # a class is a label and 128 bits of hash of the vector; the vector itself travels once
    classes = rows.where("sound").groupBy("l", "h", "g").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v"))
    radius = math.sqrt(2 - 2 * threshold) * (1 + 1e-6) + 1e-6
    # a fixed direction: the hashed signs of the places; components relative to the largest, so that no square is lost
    most = F.array_max(F.transform("v", lambda x: F.abs(x).cast("double")))
    scaled = F.transform("v", lambda x: x.cast("double") / F.col("most"))
    placed = classes.withColumns({"d": F.size("v"), "most": most}).withColumn("w", scaled)
    norm = F.sqrt(F.aggregate("w", F.lit(0.0), lambda a, x: a + x * x))
    along = F.aggregate(F.transform("w", lambda x, i: x * F.when(F.pmod(F.xxhash64(i), F.lit(2)) == 0, 1.0).otherwise(-1.0)), F.lit(0.0), lambda a, x: a + x)
    placed = placed.withColumn("cell", F.floor(along / norm / F.sqrt("d") / radius).cast("long"))
    placed = work.write(placed.drop("most", "w"), "classes")
    rows_each = F.greatest(F.lit(1), F.least(F.lit(BLOCK_ROWS), F.floor(F.lit(BLOCK_BYTES) / (width * F.col("d")))))
    sizes = placed.groupBy("l", "d", "cell").agg(F.ceil(F.count("*") / rows_each).cast("int").alias("blocks"))
    sizes = work.write(sizes, "cells")
    after = sizes.select("l", "d", (F.col("cell") - 1).alias("cell"), F.col("blocks").alias("next"))
    before = sizes.select("l", "d", (F.col("cell") + 1).alias("cell"), F.col("blocks").alias("prev"))
    around = sizes.join(after, ["l", "d", "cell"], "left").join(before, ["l", "d", "cell"], "left").fillna(0, ["next", "prev"])
    around = work.write(around, "around")
    dealt = placed.join(around.drop("next", "prev"), ["l", "d", "cell"]).withColumn("b", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))

    def packed(table: pa.Table) -> pa.Table:
        """A block as one row, in the order of its representatives."""
        order = np.argsort(table.column("rep").to_numpy(), kind="stable")
        x = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(order), -1)
        ids, n = (table.column(c).to_numpy()[order].astype("<i8").tobytes() for c in ("rep", "n"))
        return pa.table({**{c: table.column(c)[:1] for c in ("l", "d", "cell", "b")}, "ids": pa.array([ids], pa.binary()), "n": pa.array([n], pa.binary()), "v": pa.array([x[order].astype(size).tobytes()], pa.binary())})

    of = vectors.schema[label].dataType.simpleString()
    blocks = dealt.select("l", "d", "cell", "b", "rep", "n", "v").groupBy("l", "d", "cell", "b").applyInArrow(packed, f"l {of}, d int, cell long, b int, ids binary, n binary, v binary")
    blocks = work.write(blocks, "blocks").join(around, ["l", "d", "cell"])

    def upto(n: str) -> F.Column:
        return F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))

    def tile(side: F.Column, cell: F.Column, i: F.Column, step: F.Column, j: F.Column) -> F.Column:
        return F.struct(side.alias("side"), cell.alias("cell"), i.alias("i"), step.alias("step"), j.alias("j"))

    b, cell = F.col("b"), F.col("cell")
    zero, one = F.lit(0), F.lit(1)
    inner = F.transform(upto("blocks"), lambda o: tile(F.when(b <= o, zero).otherwise(one), cell, F.least(b, o), zero, F.greatest(b, o)))
    up = F.transform(upto("next"), lambda o: tile(zero, cell, b, one, o))
    down = F.transform(upto("prev"), lambda o: tile(one, cell - 1, o, one, b))
    spread = blocks.withColumn("t", F.explode(F.concat(inner, up, down))).select("l", "d", "t.*", "ids", "n", "v")

    def product(table: pa.Table) -> pa.Table:
        d = table.column("d")[0].as_py()
        rows = sorted(zip(table.column("side").to_pylist(), *(table.column(c).to_pylist() for c in ("ids", "n", "v")), strict=True), key=lambda r: r[0])
        ids, n = (np.concatenate([np.frombuffer(r[k], "<i8") for r in rows]) for k in (1, 2))
        x = [unit(np.frombuffer(r[3], size).astype(np.float64).reshape(-1, d)) for r in rows]
        i, j = close_pairs(x[0], x[-1], threshold, len(rows) == 1)
        if len(rows) > 1:
            j = j + len(x[0])
        links = np.bincount(i, n[j], len(ids)).astype(np.int64) + np.bincount(j, n[i], len(ids)).astype(np.int64)
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        least = ids[order][forest(len(ids), rank[i], rank[j])][rank]
        at = links > 0
        return pa.table({"rep": pa.array(ids[at], pa.int64()), "links": pa.array(links[at], pa.int64()), "least": pa.array(least[at], pa.int64())})

    linked = spread.groupBy("l", "d", "cell", "step", "i", "j").applyInArrow(product, "rep long, links long, least long")
    linked = work.write(linked, "links")
    found = components(linked.where("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b")), work)
    counts = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    known = placed.select("l", "h", "g", "rep", "n").join(counts, "rep", "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    known = work.write(known.select("l", "h", "g", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component")), "known")
    joined = rows.where("sound").select("id", "l", "h", "g").join(known, ["l", "h", "g"]).select("id", "links", "component")
    alone = rows.where("not sound").select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component"))
    return joined.unionByName(alone).select(F.col("id").cast(kind).alias(key), F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read(spark, sf_dir, "embeddings"), Workspace(spark, "op9"))
