"""Mixing sources to target weights, in DataFrame operations only.

Targets are shared by weight under each source's cap.  A source whose target exceeds its size is taken whole for
as many complete epochs as fit; what is left of the target is filled by weighted random order
(Efraimidis-Spirakis: the documents with the largest u ** (1 / weight), that is in the order of
exponential keys scaled by weight) until the words add up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.shared import Workspace, only_hits, read

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2.0
#: Rows of a bucket of keys: running totals are within buckets and over the buckets' totals.
BUCKET_ROWS = 5000
SEED = "mix"
#: Weights of documents by the label of their quality; unlabelled ones get the middle.
GOOD, PLAIN, POOR = 2.0, 1.0, 0.5


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the MD5 of the parts, the same in every run and engine."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sizes: (source, source_size), a row a source.  Adds target.

    Raising the share of all uncapped sources until the total is met is the end of capping and
    resharing over and over: source i gets min(cap * size_i, level * weight_i).  The windows run over
    one small row a source.
    """
    order = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("w", F.element_at(cycle, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int") + 1))
    s = s.withColumn("most", F.col("source_size") * F.lit(cap))
    by_ratio = Window.orderBy(F.col("most") / F.col("w"), F.col("source").cast("binary").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
    # level if exactly the sources before this one are capped; it holds for the first that isn't above its cap then,
    # and is less for those after it
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(after))
    s = s.withColumn("fits", F.col("level") * F.col("w") <= F.col("most"))
    s = s.withColumn("level", F.max(F.when(F.col("fits"), F.col("level"))).over(everything))
    got = F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("level") * F.col("w")))
    return s.select("source", "source_size", got.alias("target"))


def mix(docs: DataFrame, work: Workspace, *, key: str = "doc_id", text: str = "text", source: str = "source", weights: DataFrame | None = None, **shares) -> DataFrame:
    """(id, size, source, source_size, target, taken, h) for each row of docs: h is a hash of the text.

    weights: (id, weight), a row an id; absent, null, zero and lower weights count as 1.  Null and empty texts have size 0
    and are taken 0 times.  Null is a source of its own, after all others.  Repeated rows are documents each, in
    an order of their own; an empty table gives an empty result.
    The last document that a source's target reaches is taken in part, so taken words meet the target to
    less than one word.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(source).alias("source"), words(F.col(text)).alias("size"), F.xxhash64(text).alias("h"))
    if weights is not None:  # what is joined holds no texts
        rows = work.write(rows, "mix-sized").join(weights.select("id", F.col("weight").alias("w")), "id", "left")
    else:
        rows = rows.withColumn("w", F.lit(1.0))
    rows = rows.withColumn("w", F.when(F.col("w") > 0, F.col("w")).otherwise(1.0).cast("double"))
    u = uniform(F.lit(SEED), F.coalesce(F.col("id").cast("string"), F.lit("")))
    rows = work.write(rows.withColumn("p", F.pow(u, 1 / F.col("w"))).drop("w"), "mix-rows")
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    by_source = work.write(by_source, "mix-sources")
    goal = targets(by_source.select("source", "source_size"), **shares).join(by_source.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("left", F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + F.lit(1e-6)).cast("long"))
    goal = goal.withColumn("buckets", F.ceil(F.col("n") / BUCKET_ROWS).cast("long"))
    goal = work.write(goal.select(F.coalesce(F.col("source"), F.lit("")).alias("s0"), F.col("source").isNull().alias("s1"), "source_size", "target", "epochs", "left", "buckets"), "mix-goal")
    rows = rows.withColumns({"s0": F.coalesce(F.col("source"), F.lit("")), "s1": F.col("source").isNull()}).join(goal, ["s0", "s1"])
    rows = work.write(rows.withColumn("bucket", F.floor((1 - F.col("p")) * F.col("buckets")).cast("long")), "mix-dealt")
    # running totals: of the buckets of a source, then of the rows of a bucket
    sums = rows.groupBy("s0", "s1", "bucket").agg(F.sum("size").alias("held"))
    ahead = Window.partitionBy("s0", "s1").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = work.write(sums.withColumn("ahead", F.coalesce(F.sum("held").over(ahead), F.lit(0))).drop("held"), "mix-sums")
    within = Window.partitionBy("s0", "s1", "bucket").orderBy(F.desc("p"), "id", "h").rowsBetween(Window.unboundedPreceding, -1)
    dealt = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    dealt = dealt.join(sums, ["s0", "s1", "bucket"])
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("left") - F.col("ahead") - F.col("inner")))
    return dealt.select("id", "size", "source", "source_size", "target", (F.col("epochs") * F.col("size") + part).alias("taken"), "h")


def labelled_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, weight) from the mean quality label of a document."""
    quality = read(spark, sf_dir, "labels").where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.avg("quality").alias("q"))
    return quality.select("id", F.when(F.col("q") >= 0.5, GOOD).when(F.col("q") < 0.5, POOR).otherwise(PLAIN).alias("weight"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents, with weights by their labelled quality."""
    mixed = mix(read(spark, sf_dir, "documents"), Workspace(spark, "op8"), weights=labelled_weights(spark, sf_dir))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def mixed_texts(docs: DataFrame, mixed: DataFrame, work: Workspace, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs as the mix takes them: once for each time taken, always with the whole text.

    What the mix takes in part is taken whole, so a source's words exceed its target by less than one document.  Rows
    that repeat key and text share the times of all of them: each comes as often as all can, and what is left over
    comes from the row that is least by a hash of all its columns.
    """
    times = F.when(F.col("taken") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0)
    m = mixed.groupBy("id", "h").agg(F.sum(times).cast("long").alias("times"), F.count("*").alias("n")).where("times > 0")
    m = m.select("id", "h", F.floor(F.col("times") / F.col("n")).alias("each"), (F.col("times") % F.col("n")).alias("over"))
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    m = work.write(m.withColumnsRenamed({"id": "i", "h": "g"}), "mix-times")
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g"))
    met = rows.join(m.where("each > 0"), same)
    out = met.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("each"))).alias("copy"))
    over = m.where("over > 0")
    if not over.isEmpty():  # only rows that are repeated leave any over
        few = only_hits(rows.withColumn("k", F.xxhash64("id", "h")), over.select(F.xxhash64("i", "g").alias("k")), "k").join(over, same)
        first = few.groupBy("i", "g").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"), F.first("over").alias("over"))
        out = out.union(first.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("over"))).alias("copy")))
    return out.select("row.*")


_W = ", ".join(f"WHEN {i} THEN {float(w)}" for i, w in enumerate(WEIGHTS)).replace(",", "")
SQL = rf"""
WITH l AS (SELECT doc_id, avg(quality) AS q FROM labels GROUP BY doc_id),
d AS (
  SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '{WORD}')), 0)::BIGINT AS size,
         pow((('0x' || substr(md5('{SEED}:' || d.doc_id::VARCHAR), 1, 13))::BIGINT + 0.5::DOUBLE) / {float(1 << 52)}::DOUBLE,
             1 / (CASE WHEN l.q >= 0.5 THEN {GOOD} WHEN l.q < 0.5 THEN {POOR} ELSE {PLAIN} END)::DOUBLE) AS p
  FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
o AS (SELECT *, (CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(WEIGHTS)} {_W} END)::DOUBLE AS w,
             source_size * {CAP}::DOUBLE AS most, sum(source_size) OVER () * {SHARE}::DOUBLE AS total FROM s),
r AS (SELECT *, (total - coalesce(sum(most) OVER (ORDER BY most / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY most / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
v AS (SELECT max(level) AS level FROM r WHERE level * w <= most),
t AS (SELECT source, source_size, CASE WHEN v.level IS NULL THEN most ELSE least(most, v.level * w) END AS target FROM r, v),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
c AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs,
             floor(e.target - e.epochs * e.source_size + 1e-6)::BIGINT AS lft,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.p DESC, d.doc_id
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, lft - ahead)))::BIGINT AS taken FROM c
"""
