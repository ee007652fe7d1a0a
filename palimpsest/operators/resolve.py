"""Versions of documents: what is live now, at a sequence number, or at a valid time.

A collection's versions are a DataFrame with seq, op ('put' or 'delete'), the key column id and the
fields.  All states are views of it, so filters on keys and sequence numbers reach the scan.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def as_of(versions: DataFrame, seq: int | None = None, key: str = "id") -> DataFrame:
    """The newest version of each key, up to seq; deleted ones are out.  Ranking keeps one row a key before the shuffle."""
    seen = versions if seq is None else versions.where(F.col("seq") <= seq)
    newest = Window.partitionBy(key).orderBy(F.desc("seq"))
    return seen.withColumn("__n", F.row_number().over(newest)).where("__n = 1 AND op = 'put'").drop("__n", "op")


def head(versions: DataFrame, key: str = "id") -> DataFrame:
    return as_of(versions, None, key)


def get(versions: DataFrame, value, seq: int | None = None, key: str = "id") -> DataFrame:
    return as_of(versions.where(F.col(key) == value), seq, key)


def valid_at(docs: DataFrame, date: str, start: str = "valid_from", end: str = "valid_to", half_open: bool = False) -> DataFrame:
    """Documents valid at a date; a missing bound is open, the end is inclusive unless half_open."""
    upper = F.col(end) > date if half_open else F.col(end) >= date
    return docs.where((F.col(start).isNull() | (F.col(start) <= date)) & (F.col(end).isNull() | upper))


def history(versions: DataFrame, value=None, key: str = "id") -> DataFrame:
    """All versions, of one key or of all, with the sequence numbers before and after."""
    chain = Window.partitionBy(key).orderBy("seq")
    rows = versions if value is None else versions.where(F.col(key) == value)
    return rows.withColumns({"prev_seq": F.lag("seq").over(chain), "next_seq": F.lead("seq").over(chain)})


def tip(versions: DataFrame, by: str | None = None) -> DataFrame:
    """The version with the greatest sequence number, of all or of each group."""
    if by is None:
        return versions.orderBy(F.desc("seq")).limit(1)
    return versions.groupBy(by).agg(F.max_by(F.struct(*[c for c in versions.columns if c != by]), "seq").alias("t")).select(by, "t.*")


def log(versions: DataFrame, n: int) -> DataFrame:
    return versions.orderBy(F.desc("seq")).limit(n)


def as_of_each(versions: DataFrame, probes: DataFrame, key: str = "id", at: str = "at_seq") -> DataFrame:
    """For each probe (key, at_seq): the newest version up to its own sequence number (an as-of join by one union and window)."""
    fields = [c for c in versions.columns if c != key]
    both = versions.select(key, F.col("seq").alias("__s"), F.struct(*fields).alias("__v"), F.lit(0).alias("__probe")).unionByName(
        probes.select(key, F.col(at).alias("__s"), F.lit(None).cast(versions.select(F.struct(*fields).alias("x")).schema["x"].dataType).alias("__v"), F.lit(1).alias("__probe"))
    )
    upto = Window.partitionBy(key).orderBy("__s", "__probe").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__v", F.last("__v", ignorenulls=True).over(upto)).where("__probe = 1")
    return seen.select(key, F.col("__s").alias(at), "__v.*").where("op = 'put'").drop("op")


def counts(versions: DataFrame, by: str = "coll", key: str = "id") -> DataFrame:
    live = Window.partitionBy(by, key).orderBy(F.desc("seq"))
    return versions.withColumn("__n", F.row_number().over(live)).where("__n = 1 AND op = 'put'").groupBy(by).agg(F.count("*").alias("n"))


def checkpointed(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read from there: what uses it twice sees the same rows and partitions."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a fresh folder on a local master, and an error on a cluster, whose machines share none."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir isn't set: executors need a folder that all of them share")
    return f"file://{tempfile.mkdtemp(prefix='palimpsest-')}"
