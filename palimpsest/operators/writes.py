"""The write path as bulk operators: sequence numbers, replay protection, idempotency, expiry, compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators import resolve


def assign_seq(ops: DataFrame, base: int, order: str) -> DataFrame:
    """Dense numbers from base on, in the batch's order: ranges are sorted apart, then offset by their sizes.

    The ranges are written once: cut a second time, their bounds and sizes could differ.
    """
    parts = ops.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("__m", F.monotonically_increasing_id()).withColumn("__p", F.shiftright("__m", 33))
    parts = resolve.checkpointed(parts)
    sizes = parts.groupBy("__p").agg(F.count("*").alias("__c"))
    before = F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))  # a row a partition
    starts = sizes.withColumn("__b", F.coalesce(before, F.lit(0))).drop("__c")
    return parts.join(F.broadcast(starts), "__p").withColumn("seq", F.lit(base) + F.col("__b") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).drop("__p", "__m", "__b")


def first_per_idem(ops: DataFrame, order: str = "arrival", idem: str = "idem") -> DataFrame:
    """Of ops with one idempotency key the first; ops without a key all stay."""
    first = F.row_number().over(Window.partitionBy(idem).orderBy(order))
    keyed = ops.where(F.col(idem).isNotNull()).withColumn("__n", first).where("__n = 1").drop("__n")
    return keyed.unionByName(ops.where(F.col(idem).isNull()))


def nonce_violations(ops: DataFrame, last: DataFrame | None = None, order: str = "arrival") -> DataFrame:
    """Ops whose nonce isn't above all earlier ones of their client; last: (client, last) stored before."""
    earlier = Window.partitionBy("client").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    seen = ops.join(last, "client", "left") if last is not None else ops.withColumn("last", F.lit(0).cast("long"))
    most = F.greatest(F.coalesce(F.max("nonce").over(earlier), F.lit(0)), F.coalesce("last", F.lit(0)))
    return seen.withColumn("__most", most).where("nonce <= __most").drop("__most", "last")


def unexpired(docs: DataFrame, now, at: str = "expires_at") -> DataFrame:
    return docs.where(F.col(at).isNull() | (F.col(at) >= F.lit(now)))


def sweep(docs: DataFrame, now, key: str = "id", at: str = "expires_at") -> DataFrame:
    """The delete ops of what has expired."""
    return docs.where(F.col(at) < F.lit(now)).select(key, F.lit("delete").alias("op"), F.lit("__ttl__").alias("client"))


def snapshot_plus_delta(snapshot: DataFrame, checkpoint_seq: int, versions: DataFrame, key: str = "id") -> DataFrame:
    """HEAD from a snapshot of HEAD and the ops after it."""
    delta = versions.where(F.col("seq") > checkpoint_seq)
    return resolve.head(snapshot.withColumn("op", F.lit("put")).unionByName(delta), key)


def compact(versions: DataFrame, key: str = "id") -> DataFrame:
    return resolve.head(versions, key).withColumn("op", F.lit("put"))


def compaction_stats(versions: DataFrame, key: str = "id") -> DataFrame:
    newest = Window.partitionBy(key).orderBy(F.desc("seq"))
    kept = (F.col("__n") == 1) & (F.col("op") == "put")
    counted = versions.select(key, "seq", "op").withColumn("__n", F.row_number().over(newest))
    return counted.agg(F.count("*").alias("before"), F.sum(kept.cast("long")).alias("after"), F.sum((~kept).cast("long")).alias("dropped"))


class Advisor:
    """Counts the fields that plans filter and order by, and suggests columns to sort or bucket by."""

    def __init__(self, threshold: int = 3):
        self.threshold, self.uses = threshold, {}

    def saw(self, plan) -> None:
        for name, kind in [(f, "bucket" if op == "=" else "sort") for f, op, _ in plan.where] + ([(plan.order_by[0], "sort")] if plan.order_by else []):
            self.uses[plan.source, name, kind] = self.uses.get((plan.source, name, kind), 0) + 1

    def suggest(self) -> list[tuple[str, str, str, int]]:
        return sorted((*k, n) for k, n in self.uses.items() if n >= self.threshold)
