"""Exact dedup: a log-structured merge index of text digests, in DataFrame operations only.

Each input partition is a memtable: it is flushed as one run, a file of digests sorted within it and
with Parquet's Bloom filter on the digest in its footer.  Compaction merges all runs of a level into one entry a digest: the
identifier that stays and the size of the group.  Texts whose digest hits that of another row are then
compared byte by byte with the text that stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.shared import Workspace, only_hits, read

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A group of copies is compared in shares of about this many rows.
SHARE = 2000
#: Characters beyond ASCII that lower() may change; planes beyond the first grow with each Unicode version.
OTHER_CAPITALS = r"[\x{80}-\x{FFFF}&&[\p{javaUpperCase}\p{javaTitleCase}]]|[\x{10000}-\x{10FFFF}]"


def normalised(text: Column) -> Column:
    """Lower-cases A-Z only; null counts as empty.

    lower() does that to a text without other capitals, much faster than translate().
    """
    t = F.coalesce(text, F.lit(""))
    return F.when(t.rlike(OTHER_CAPITALS), F.translate(t, UPPER, LOWER)).otherwise(F.lower(t))


class LsmIndex:
    """Runs of (digest, id, n) in the shared folder; keep says which identifier of equal texts stays."""

    def __init__(self, work: Workspace, keep: str = "smallest"):
        self.work, self.pick, self.levels = work, F.max if keep == "largest" else F.min, []
        self.written = 0

    def flush(self, rows: DataFrame) -> None:
        """rows: (digest, id).  Each partition becomes one sorted run; no row leaves its task."""
        self._write(rows.select("digest", "id", F.lit(1).cast("long").alias("n")).sortWithinPartitions("digest"))

    def _write(self, run: DataFrame) -> None:
        self.written += 1
        name = f"run-{self.written}"
        self.work.write(run, name, **{"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.adaptive.enabled": "true"})
        self.levels.append(name)

    def compact(self) -> DataFrame:
        """Merges all runs into one, sorted by digest; the old runs go."""
        old = [*self.levels]
        runs = self.work.spark.read.parquet(*[self.work.path(x) for x in old])
        self._write(runs.groupBy("digest").agg(self.pick("id").alias("id"), F.sum("n").alias("n")).sortWithinPartitions("digest"))
        self.work.drop(*old)
        self.levels = self.levels[-1:]
        return self.entries()

    def entries(self) -> DataFrame:
        return self.work.spark.read.parquet(self.work.path(self.levels[-1]))


def dedup(docs: DataFrame, work: Workspace, *, key: str = "doc_id", text: str = "text", keep: str = "smallest") -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256) for each row; other columns are left out.  Keys are of any ordered type.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty; long ones are hashed and compared whole.  Of equal texts
    the row with the smallest (or largest) key stays.  Repeated rows count each in group_size and share
    the decision of their key.  Null keys stay only where a group has no other.  An empty table gives an empty
    result.
    """
    t = normalised(F.col(text))
    rows = docs.select(F.col(key).alias("id"), t.alias("t")).withColumn("digest", F.unhex(F.sha2("t", 256)))
    index = LsmIndex(work, keep)
    digests = work.write(rows.select("digest", "id"), "digests")
    index.flush(digests)
    entries = index.compact()

    # byte verification of hits: the members of a large group are spread over shares, for each of which the text
    # that stays is repeated
    hits = entries.where("n > 1").select("digest", F.col("id").alias("keep"), F.ceil(F.col("n") / SHARE).cast("int").alias("shares"))
    hits = work.write(hits, "hits")
    found = work.write(only_hits(rows, hits).join(hits, "digest").select("digest", "id", "keep", "shares", "t"), "texts")
    stay = found.where(F.col("id").eqNullSafe(F.col("keep"))).groupBy("digest", "shares").agg(F.min("t").alias("stay"))
    stay = stay.select("digest", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "stay")
    members = found.where(~F.col("id").eqNullSafe(F.col("keep"))).withColumn("share", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int"))
    compared = members.join(work.write(stay, "stay"), ["digest", "share"])
    odd = work.write(compared.where("t <> stay").select("digest", "id", "t"), "odd")
    work.drop("texts", "stay")

    def out(keep_id: Column, n: Column) -> list[Column]:
        return [F.col("id").alias(key), keep_id.alias("keep_id"), n.alias("group_size"), F.col("id").eqNullSafe(keep_id).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")]

    if odd.isEmpty():
        entry = entries.select("digest", F.col("id").alias("keep"), "n")
        return digests.join(entry, "digest").select(*out(F.col("keep"), F.col("n")))
    # unequal texts of one digest: their groups are by text
    both = rows.join(odd.select("digest").distinct(), "digest")
    own = both.groupBy("digest", "t").agg(index.pick("id").alias("keep"), F.count("*").alias("n"))
    apart = both.join(own, ["digest", "t"]).select(*out(F.col("keep"), F.col("n")))
    entry = entries.select("digest", F.col("id").alias("keep"), "n")
    rest = digests.join(odd.select("digest").distinct(), "digest", "left_anti")
    return rest.join(entry, "digest").select(*out(F.col("keep"), F.col("n"))).unionByName(apart)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read(spark, sf_dir, "documents"), Workspace(spark, "op3"), keep="largest")


SQL = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h)
"""
