"""Relations with time travel, and the causal graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators import resolve


def intervals(events: DataFrame) -> DataFrame:
    """events (seq, op, frm, rel, to), op link or unlink -> (frm, rel, to, added_seq, removed_seq).

    A link while live and an unlink while not change nothing.
    """
    edge = Window.partitionBy("frm", "rel", "to").orderBy("seq")
    before = F.coalesce(F.lag("op").over(edge), F.lit("unlink"))
    kept = events.withColumn("__before", before).where("op <> __before")
    return kept.withColumn("removed_seq", F.lead("seq").over(edge)).where("op = 'link'").select("frm", "rel", "to", F.col("seq").alias("added_seq"), "removed_seq")


def live(edges: DataFrame, seq: int | None = None) -> DataFrame:
    if seq is None:
        return edges.where("removed_seq is null")
    return edges.where((F.col("added_seq") <= seq) & (F.col("removed_seq").isNull() | (F.col("removed_seq") > seq)))


def neighbors(edges: DataFrame, frm, rel: str, seq: int | None = None) -> DataFrame:
    return live(edges, seq).where((F.col("frm") == frm) & (F.col("rel") == rel)).select("to")


def inbound(edges: DataFrame, to, rel: str, seq: int | None = None) -> DataFrame:
    return live(edges, seq).where((F.col("to") == to) & (F.col("rel") == rel)).select("frm")


def traverse(rows: DataFrame, edges: DataFrame, targets: DataFrame, rel: str, seq: int | None = None, key: str = "id") -> DataFrame:
    """The target documents of one hop, each once; targets without a document are dropped."""
    reached = rows.select(F.col(key).alias("frm")).join(live(edges, seq).where(F.col("rel") == rel), "frm").select(F.col("to").alias(key)).distinct()
    return targets.join(reached, key, "left_semi")


def relation_schema(edges: DataFrame, from_coll, to_coll) -> DataFrame:
    return live(edges).select(from_coll.alias("from_coll"), "rel", to_coll.alias("to_coll")).distinct()


def closure(start: DataFrame, steps: DataFrame) -> DataFrame:
    """seqs reached from start (seq) over steps (seq, next), start left out unless reached; safe on cycles.

    Each round is checkpointed to the shared folder, so lineage stays short and lost executors cost a reread.
    """
    frontier = start.select("seq").distinct()
    seen = frontier.limit(0)
    while True:
        found = resolve.checkpointed(frontier.join(steps, "seq").select(F.col("next").alias("seq")).distinct().join(seen, "seq", "left_anti"))
        if found.isEmpty():
            return seen
        seen, frontier = resolve.checkpointed(seen.union(found)), found


def trace(ops: DataFrame, start: DataFrame, reverse: bool = False, include_root: bool = False) -> DataFrame:
    """Causes of the ops with these seqs (or, in reverse, what they caused), each at the version of its own seq.

    ops has seq, op and caused_by (array of seq); only puts are emitted, and only from puts the walk goes on.
    """
    puts = ops.where("op = 'put'")
    steps = puts.select("seq", F.explode("caused_by").alias("next"))
    if reverse:
        steps = steps.select(F.col("next").alias("seq"), F.col("seq").alias("next"))
    reached = closure(start, steps)
    if include_root:
        reached = reached.union(start.select("seq")).distinct()
    return puts.join(reached, "seq", "left_semi")


def trace_each(ops: DataFrame, start: DataFrame, reverse: bool = False, limit: int = 1000) -> DataFrame:
    """(root, seq, depth) for each root apart, the root itself first: at most limit ops of a root, nearest first, ties by seq.

    Roots share nothing, so an op that two of them reach comes twice.
    """
    steps = ops.where("op = 'put'").select("seq", F.explode("caused_by").alias("next"))
    if reverse:
        steps = steps.select(F.col("next").alias("seq"), F.col("seq").alias("next"))
    depth = 0
    frontier = resolve.checkpointed(start.select(F.col("seq").alias("root"), "seq").distinct())
    seen = frontier.withColumn("depth", F.lit(0))
    while not frontier.isEmpty() and depth < limit:
        depth += 1
        found = frontier.join(steps, "seq").select("root", F.col("next").alias("seq")).distinct().join(seen, ["root", "seq"], "left_anti")
        frontier = resolve.checkpointed(found)
        seen = resolve.checkpointed(seen.union(frontier.withColumn("depth", F.lit(depth))))
    place = F.row_number().over(Window.partitionBy("root").orderBy("depth", "seq"))
    return seen.withColumn("n", place).where(F.col("n") <= limit).drop("n")
