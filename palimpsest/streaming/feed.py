"""The changefeed, live queries and streaming views of the log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def since(versions: DataFrame, after: int, limit: int = 10_000) -> DataFrame:
    """A page of the log after a sequence number (-1: all), deletes included, ascending."""
    return versions.where(F.col("seq") > after).orderBy("seq").limit(limit or 10_000)


def page(versions: DataFrame, after: int, limit: int = 10_000) -> dict:
    rows = since(versions, after, (limit or 10_000) + 1).collect()  # a page, and one row to see whether more follow
    more, rows = len(rows) > (limit or 10_000), rows[: limit or 10_000]
    head = versions.agg(F.max("seq")).first()[0]
    return {"nodes": rows, "from_seq": rows[0].seq if rows else after, "to_seq": rows[-1].seq if rows else after, "head_seq": head, "has_more": more}


def scan_status(versions: DataFrame) -> DataFrame:
    got = versions.agg(F.min("seq").alias("first_seq"), F.max("seq").alias("tip_seq"), F.count("*").alias("n"))
    return got.withColumn("scan_complete", F.col("n") == F.col("tip_seq") - F.col("first_seq") + 1)


def stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def streaming_head(ops: DataFrame, key: str = "id") -> DataFrame:
    """The newest version of each key, kept up by update mode."""
    fields = [c for c in ops.columns if c != key]
    return ops.groupBy(key).agg(F.max_by(F.struct(*fields), "seq").alias("v")).select(key, "v.*")


def subscribe(ops: DataFrame, rerun: Callable[[], DataFrame], push: Callable[[list], None], checkpoint: str) -> StreamingQuery:
    """Runs a query again after each batch of the log, and pushes its rows when they change."""
    last: list = [None]

    def batch(_: DataFrame, __: int) -> None:
        rows = rerun()
        mark = rows.agg(F.count("*"), F.sum(F.xxhash64(F.to_json(F.struct("*"))).cast("decimal(38,0)"))).first()
        if mark != last[0]:
            last[0] = mark
            push(rows.collect())

    return ops.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow(ops: DataFrame, push: Callable[[DataFrame, int], None], checkpoint: str, live: bool = False) -> StreamingQuery:
    """Hands each batch of new ops and its number to push, from where the checkpoint stands.  It ends when it has caught up, unless live.

    Ops are in order across batches, not within one; a batch can come again after a failure, with the same number.
    """
    trigger = {"processingTime": "1 second"} if live else {"availableNow": True}
    return ops.writeStream.foreachBatch(push).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def idempotent(ops: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First op of each idempotency key within a delay of event time."""
    return ops.withWatermark("at", delay).dropDuplicatesWithinWatermark(["idem"])


def windowed(ops: DataFrame, at: str, size: str, late: str) -> DataFrame:
    return ops.withWatermark(at, late).groupBy(F.window(at, size)).agg(F.count("*").alias("n"))
