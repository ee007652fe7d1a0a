"""Line dedup: repeated runs of lines by prefix doubling over line identifiers, in DataFrame operations only.

Lines become identifiers.  Round k orders the suffixes of the sequence of identifiers by their first
2**(k+1) lines, from the ranks of their first 2**k lines and of the 2**k lines after these; only
suffixes that share their rank with another go on, so the rounds shrink to what repeats.  The interval of suffixes
that have a run's first m lines in common is keyed by two ranks, of its first and of its last 2**k lines
(2**k <= m < 2**(k+1)).  Every maximal repeated run of enough words is the union of the least such runs
that begin, and that end, at its lines; all but the first member of an interval are later copies, whose lines go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.mixing import words
from palimpsest.llm.shared import Workspace, flag_hits, read

#: A repeated run goes from this many words on.
MIN_WORDS = 50


def doc_key(docs: DataFrame, key: str, text: str) -> list[Column]:
    """A document is its key and text: rows that repeat both are one document.  Null keys are least, of any type."""
    if isinstance(docs.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        doc = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    else:
        doc = F.coalesce(F.concat(F.lit("1"), F.col(key).cast("string")), F.lit("0"))
    return [doc.alias("doc"), F.xxhash64(text).alias("h")]


def later_copies(docs: DataFrame, work: Workspace, *, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, h, gone): the positions of the lines of each document that belong to a later copy.

    Documents are in the order of their keys (null first; then a hash of the text), lines in theirs.
    """
    line = F.posexplode(F.split("t", "\n")).alias("pos", "line")
    lines = docs.where(F.col(text).isNotNull()).select(*doc_key(docs, key, text), F.col(text).alias("t")).select("doc", "h", line)
    ids = lines.select("doc", "h", "pos", F.xxhash64("line").alias("a"), F.xxhash64(F.lit("2"), "line").alias("b"), words(F.col("line")).alias("n"))
    ids = work.write(ids.distinct(), "lines")
    # line identifiers: ranks of the lines that occur more than once
    twice = work.write(ids.groupBy("a", "b").agg(F.count("*").alias("c")).where("c > 1").select("a", "b"), "twice")
    ranks = work.write(twice.sort("a", "b").withColumn("rank", F.monotonically_increasing_id()), "ranks-0")
    # least runs of enough words, by a window of one document's lines
    along = Window.partitionBy("doc", "h").orderBy("pos")
    summed = ids.withColumn("upto", F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    flagged = summed.join(ranks, ["a", "b"], "left").select("doc", "h", "pos", "n", "upto", "rank")
    # an unbroken stretch of repeated lines is what a repeated run can be in
    flagged = work.write(flagged, "ranked")
    stretch = F.sum(F.when(F.col("rank").isNull(), 1).otherwise(0)).over(along.rowsBetween(Window.unboundedPreceding, 0))
    live = work.write(flagged.withColumn("stretch", stretch).where("rank is not null"), "live")
    inside = Window.partitionBy("doc", "h", "stretch")
    held = live.withColumn("held", F.sum("n").over(inside)).where(F.col("held") >= min_words).drop("held")
    # the least run that begins at pos ends where the running total first gets to upto - n + min_words
    after = inside.orderBy("upto").rangeBetween(min_words, Window.unboundedFollowing)
    starts = held.withColumn("upto", F.col("upto") - F.col("n")).withColumn("own", F.col("n"))
    # totals before each line: the first line whose total before it is at least min_words more, less one
    closes = F.min("pos").over(after)
    last = F.max("pos").over(inside)
    whole = F.max(F.col("upto") + F.col("own")).over(inside)
    begins = starts.withColumn("end", F.when(closes.isNotNull(), closes - 1).when(whole - F.col("upto") >= min_words, last)).where("end is not null")
    # and the least run that ends at pos begins at the last line whose total before it is at most upto - min_words
    back = inside.orderBy("upto").rangeBetween(Window.unboundedPreceding, -min_words)
    ends = held.withColumn("begin", F.max("pos").over(back) + 1)
    base = F.min(F.col("upto") - F.col("n")).over(inside)
    ends = ends.withColumn("begin", F.when(F.col("begin").isNotNull(), F.col("begin")).when(F.col("upto") - base >= min_words, F.min("pos").over(inside))).where("begin is not null")
    runs = begins.select("doc", "h", "pos", (F.col("end") - F.col("pos") + 1).alias("m")).union(ends.select("doc", "h", "begin", (F.col("pos") - F.col("begin") + 1).alias("m")))
    runs = work.write(runs.distinct(), "runs")
    longest = runs.agg(F.max("m")).first()[0] or 0

    level = work.write(held.select("doc", "h", "pos", "rank"), "level-0")
    copies, k = [], 0
    while 1 << k <= longest:
        size = 1 << k
        due = runs.where((F.col("m") >= size) & (F.col("m") < 2 * size))
        first = due.join(level, ["doc", "h", "pos"]).withColumnRenamed("rank", "r1")
        second = level.select("doc", "h", F.col("pos").alias("tail"), F.col("rank").alias("r2"))
        keyed = first.withColumn("tail", F.col("pos") + F.col("m") - size).join(second, ["doc", "h", "tail"])
        keyed = work.write(keyed.select("doc", "h", "pos", "m", "r1", "r2"), f"keyed-{k}")
        least = work.write(keyed.groupBy("m", "r1", "r2").agg(F.min(F.struct("doc", "h", "pos")).alias("first"), F.count("*").alias("c")).where("c > 1").drop("c"), f"first-{k}")
        later = keyed.join(least, ["m", "r1", "r2"]).where(F.struct("doc", "h", "pos") > F.col("first"))
        copies.append(work.write(later.select("doc", "h", "pos", "m"), f"copies-{k}"))
        if 2 * size > longest:
            break
        # suffixes by their first 2 * size lines
        there = level.select("doc", "h", (F.col("pos") - size).alias("pos"), F.col("rank").alias("r2"))
        pairs = work.write(level.withColumnRenamed("rank", "r1").join(there, ["doc", "h", "pos"]), f"pairs-{k + 1}")
        again = work.write(pairs.groupBy("r1", "r2").agg(F.count("*").alias("c")).where("c > 1").select("r1", "r2"), f"again-{k + 1}")
        order = work.write(again.sort("r1", "r2").withColumn("rank", F.monotonically_increasing_id()), f"ranks-{k + 1}")
        level = work.write(pairs.join(order, ["r1", "r2"]).select("doc", "h", "pos", "rank"), f"level-{k + 1}")
        k += 1
    if not copies:
        return runs.select("doc", "h", F.array("pos").alias("gone")).limit(0)
    found = copies[0]
    for more in copies[1:]:
        found = found.union(more)
    gone = found.select("doc", "h", F.explode(F.sequence("pos", F.col("pos") + F.col("m").cast("int") - 1)).alias("pos"))
    return work.write(gone.groupBy("doc", "h").agg(F.sort_array(F.collect_set("pos")).alias("gone")), "gone")


def without(text: Column, gone: Column) -> Column:
    """text without the lines at the ascending positions gone: what lies between them is cut out in whole stretches."""

    def kept(lines: Column) -> Column:
        n = F.size(lines)
        between = F.zip_with(F.concat(F.array(F.lit(-1)), gone), F.concat(gone, F.array(n)), lambda p, q: F.struct((p + 2).alias("at"), (q - p - 1).alias("n")))
        return F.array_join(F.flatten(F.transform(F.filter(between, lambda s: s["n"] > 0), lambda s: F.slice(lines, s["at"], s["n"]))), "\n")

    return F.transform(F.array(F.split(text, "\n")), kept)[0]  # a lambda's variable is worked out once


def dedup_lines(docs: DataFrame, work: Workspace, *, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with text without its later copies, and __lines, __gone and __left: lines before, lines that went, and whether any is left.

    A run of whole lines goes where it has min_words words ([^ \\t-\\r]+) and occurs before, in the order
    of (key, line); overlapping occurrences count.  A null text stays null with 0 lines, and an empty one has one empty line; both
    are left.  Null keys come first; keys that aren't integers are in the order of their strings.  Rows that repeat key and text
    are one document and change alike.  Columns of docs named as the three are replaced; other names may be any.
    """
    gone = later_copies(docs, work, key=key, text=text, min_words=min_words)
    gone = gone.select(F.col("doc").alias("other"), F.col("h").alias("g"), F.col("gone").alias("at"))
    made = ("__lines", "__gone", "__left")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in made]).alias("row")
    rows = docs.select(row, *doc_key(docs, key, text)).withColumn("k", F.xxhash64("doc", "h"))
    # only documents that may lose lines meet their lines' positions; the others' texts stay where they are
    rows = flag_hits(rows, gone.select(F.xxhash64("other", "g").alias("k")), "k")
    changed = rows.where("__hit").join(gone, (F.col("doc") == F.col("other")) & (F.col("h") == F.col("g")), "left").select("row", "at")
    joined = changed.unionByName(rows.where("not __hit").select("row", F.lit(None).cast("array<int>").alias("at")))
    own = F.col(f"row.`{text}`")
    lines = F.when(own.isNull(), 0).otherwise(F.size(F.split(own, "\n"))).cast("long")
    went = F.greatest(F.coalesce(F.size("at"), F.lit(0)), F.lit(0)).cast("long")
    left = F.when(F.col("at").isNull(), own).otherwise(without(own, F.col("at")))
    out = [left.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in made]
    return joined.select(*out, lines.alias("__lines"), went.alias("__gone"), ((went == 0) | (went < lines)).alias("__left"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    done = dedup_lines(docs, Workspace(spark, "op5"))
    return done.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__gone").alias("n_deleted"), F.col("__left").alias("kept"), "text")


SQL = r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, i, ls, len(regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+')) AS n FROM l, unnest(range(1, len(ls) + 1)) AS t(i)),
u AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM n),
b AS (SELECT x.doc_id, x.i AS i, min(y.i) AS j FROM u x JOIN u y ON x.doc_id = y.doc_id AND y.i >= x.i AND y.upto - x.upto + x.n >= 50 GROUP BY ALL),
e AS (SELECT y.doc_id, max(x.i) AS i, y.i AS j FROM u x JOIN u y ON x.doc_id = y.doc_id AND y.i >= x.i AND y.upto - x.upto + x.n >= 50 GROUP BY ALL),
r AS (SELECT DISTINCT doc_id, i, j FROM (SELECT doc_id, i, j FROM b UNION ALL SELECT doc_id, i, j FROM e)),
s AS (SELECT r.*, array_to_string(list_slice(l.ls, i, j), chr(10)) AS run FROM r JOIN l USING (doc_id)),
c AS (SELECT doc_id, i, j, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS k FROM s),
g AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS i FROM c WHERE k > 1),
a AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(l.ls), 0)::BIGINT AS n_lines, coalesce(len(a.gone), 0)::BIGINT AS n_deleted,
       coalesce(len(a.gone), 0) = 0 OR len(a.gone) < len(l.ls) AS kept,
       CASE WHEN a.gone IS NULL THEN d.text
            ELSE array_to_string([l.ls[i] FOR i IN range(1, len(l.ls) + 1) IF NOT list_contains(a.gone, i)], chr(10)) END AS text
FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id LEFT JOIN a ON d.doc_id = a.doc_id
"""
