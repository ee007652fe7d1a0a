"""Helpers that the training-data operators share: the cluster's shared folder and graph components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of an Arrow batch: batches of long texts must fit in a Python worker beside its caches.
ARROW_BYTES = 8 << 20
ARROW_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bits of the filter of hits for each hit, and its bounds.  Beyond the upper one (32 MB) no filter is broadcast: all rows count as hits.
BITS_A_HIT, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 28
BITMAP_BITS = 1 << 15


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def integer_key(df: DataFrame, key: str) -> T.DataType:
    """The type of an integer key column; others are an error."""
    kind = df.schema[key].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"{key} is {kind.simpleString()}; keys are integers here")
    return kind


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; on a local master, where it may be unset, a fresh one.

    Also bounds Arrow batches by bytes where the session sets no bound: smaller batches change no query's result.
    """
    if not spark.conf.get(ARROW_SETTING, None) or int(spark.conf.get(ARROW_SETTING)) > 1 << 30:
        spark.conf.set(ARROW_SETTING, ARROW_BYTES)
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir isn't set: executors need a folder that all of them share")
        at = f"file://{tempfile.mkdtemp(prefix='palimpsest-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


class Workspace:
    """Written tables of one run.  A written table cuts lineage: a lost executor costs a reread, not a recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        df.write.mode("overwrite").options(**{"compression": "zstd", **options}).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))

    def clear(self) -> None:
        """Deletes all of it.  DataFrames that read from it no longer work."""
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def is_scan(df: DataFrame) -> bool:
    """Whether df is a projection or filter of files, whose partitions are the same each time they are read."""

    def walk(plan) -> bool:
        if plan.getClass().getSimpleName() not in ("Project", "Filter", "LogicalRelation") or not plan.deterministic():
            return False
        below = plan.children()
        return all(walk(below.apply(i)) for i in range(below.size()))

    return walk(df._jdf.queryExecution().optimizedPlan())


def flag_hits(rows: DataFrame, hits: DataFrame, column: str) -> DataFrame:
    """rows with __hit: whether the column's value may be among those of hits, a written table; false is certain.

    A hashed bit set is broadcast, so no row moves.  Its size follows the number of hits; where they are so many that it
    would pass its bound, all rows are flagged.  rows have no columns __map and __bit.
    """
    size = LEAST_BITS
    n = hits.count()
    while size < BITS_A_HIT * n:
        size *= 2
    if size > MOST_BITS:
        return rows.withColumn("__hit", F.lit(True))
    bit = F.pmod(F.xxhash64(column), F.lit(size))
    place = {"__map": F.floor(bit / BITMAP_BITS).cast("int"), "__bit": (bit % BITMAP_BITS).cast("int")}
    maps = hits.withColumns(place).groupBy("__map").agg(F.bitmap_construct_agg(F.col("__bit").cast("long")).alias("__bits"))
    byte = F.conv(F.hex(F.expr("substring(__bits, cast(__bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    found = rows.withColumns(place).join(F.broadcast(maps), "__map", "left")
    hit = F.coalesce(F.getbit(byte, F.pmod("__bit", F.lit(8))) == 1, F.lit(False))
    return found.withColumn("__hit", hit).drop("__map", "__bit", "__bits")


def only_hits(rows: DataFrame, hits: DataFrame, column: str = "digest") -> DataFrame:
    """The rows whose value may be among hits, a written table."""
    return flag_hits(rows, hits, column).where("__hit").drop("__hit")


def components(edges: DataFrame, work: Workspace, name: str = "cc") -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b), for nodes that have an edge.

    Alternating large-star and small-star steps.  Each step writes the nodes' minima and then the
    edges, so that both sides of the join are plain shuffles and a hub with very many edges is
    split by adaptive execution.  Rounds grow with the logarithm of the longest path.
    """
    now = work.write(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-e0")
    old, step = "e0", 0
    while True:
        # large star: larger neighbours of u go to the least of u's neighbourhood
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = work.write(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-m{step}")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        mid = work.write(large, f"{name}-l{step}")
        # small star: smaller neighbours of u, and u, go to the least of them
        low = work.write(mid.groupBy("u").agg(F.min("v").alias("m")), f"{name}-n{step}")
        joined = mid.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        nxt = work.write(small, f"{name}-s{step}")
        total = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        done = total(nxt) == total(now)
        work.drop(f"{name}-{old}", f"{name}-m{step}", f"{name}-l{step}", f"{name}-n{step}")
        now, old, step = nxt, f"s{step}", step + 1
        if done:
            pairs = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return pairs.union(pairs.select("component", "component").distinct())
