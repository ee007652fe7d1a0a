"""Quality classifier: hierarchical empirical Bayes over documents, hosts and paths.

A logistic model of hashed words and of the text's shape gives each document's own evidence.  Hosts, and paths
within hosts, have Beta posteriors of the share of good documents, shrunk toward the global share and the host's
by pseudo-counts that are fitted to how much hosts, and paths, differ.  A document's posterior is
its evidence under its path's share, without itself, in place of the global one.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.shared import Workspace, read, shared_dir

BITS = 16
#: The bound of the training sample: labelled documents with the least hash of their key.
SAMPLE = 6000
EPOCHS = 12
#: Most and least pseudo-counts of a prior.
MOST, LEAST = 1e5, 1.0
#: A word counts when its log-odds are this many standard errors from none.
SURE = 3.0
WORD = re.compile(r"[^\W\d_]+")
#: Words of a long text are looked up a part at a time.
PART = 1 << 16


_HASHES: dict[str, int] = {}


def hashed(word: str) -> int:
    got = _HASHES.get(word)
    if got is None:
        if len(_HASHES) > 500_000:
            _HASHES.clear()
        got = _HASHES[word] = zlib.crc32(word.encode("utf-8", "replace")) & ((1 << BITS) - 1)
    return got


SHAPES = 8


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashed words, shape) of a whole text."""
    lower = text.lower()
    words = WORD.findall(lower)
    distinct = set(words)
    n, size = max(len(words), 1), max(len(text), 1)
    letters = sum(map(len, words))
    upper = sum(1 for a in text[:PART] if a.isupper()) if len(text) <= PART else sum(map(str.isupper, text))
    marks = sum(text.count(c) for c in "*#$%&|!")
    shape = [1 - len(distinct) / n, np.log1p(n) / 8, upper / size, 1 - letters / size, marks / size * 4, text.count("\n") / n, max(map(len, words), default=0) / 40, 1.0 if len(words) < 8 else 0.0]
    return np.fromiter({hashed(w) for w in distinct}, np.int64), np.array(shape)


class Model:
    """A logistic model: presence of hashed words, and a piecewise form of the shape."""

    STEPS = 8

    def __init__(self):
        self.words = np.zeros(1 << BITS)
        self.shape = np.zeros(SHAPES * self.STEPS)
        self.cuts = np.zeros((SHAPES, self.STEPS - 1))
        self.bias = 0.0
        self.trained = False

    def steps(self, shape: np.ndarray) -> np.ndarray:
        """For each shape feature the step of its value."""
        return np.arange(SHAPES) * self.STEPS + (shape[:, None] > self.cuts).sum(axis=1)

    def logit(self, words: np.ndarray, shape: np.ndarray) -> float:
        return float(self.words[words].sum() + self.shape[self.steps(shape)].sum() + self.bias)

    @staticmethod
    def telling(rows: list[tuple[np.ndarray, np.ndarray, float]], y: np.ndarray) -> np.ndarray:
        """Of all hashed words those whose share of good documents differs from the rest beyond chance."""
        words = np.concatenate([w for w, _, _ in rows])
        good = np.bincount(words, np.repeat(y, [len(w) for w, _, _ in rows]), 1 << BITS)
        poor = np.bincount(words, minlength=1 << BITS) - good
        ratio = np.log((good + 0.5) / (y.sum() + 1)) - np.log((poor + 0.5) / (len(y) - y.sum() + 1))
        return np.abs(ratio) / np.sqrt(1 / (good + 0.5) + 1 / (poor + 0.5)) >= SURE

    def train(self, rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = EPOCHS) -> None:
        if len({y for _, _, y in rows}) < 2:
            self.bias = 0.0 if not rows else float(np.clip(np.log((rows[0][2] + 0.01) / (1.01 - rows[0][2])), -4, 4))
            self.trained = bool(rows)
            return
        shapes = np.array([s for _, s, _ in rows])
        self.cuts = np.quantile(shapes, np.linspace(0, 1, self.STEPS + 1)[1:-1], axis=0).T
        y = np.array([r[2] for r in rows])
        used = self.telling(rows, y)
        rows = [(w[used[w]], s, g) for w, s, g in rows]
        rng = np.random.default_rng(3)
        g_words, g_shape = np.full(1 << BITS, 1e-8), np.full(len(self.shape), 1e-8)
        self.bias = float(np.log(y.mean() / (1 - y.mean())))
        for epoch in range(epochs):
            order = rng.permutation(len(rows))
            for s in range(0, len(order), 256):
                at = order[s : s + 256]
                owner = np.repeat(np.arange(len(at)), [len(rows[k][0]) for k in at])
                words = np.concatenate([rows[k][0] for k in at])
                steps = np.array([self.steps(shapes[k]) for k in at])
                z = np.bincount(owner, self.words[words], len(at)) + self.shape[steps].sum(axis=1) + self.bias
                d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[at]) / len(at)
                gw = np.bincount(words, d[owner], 1 << BITS) + 1e-5 * self.words
                gs = np.bincount(steps.ravel(), np.repeat(d, SHAPES), len(self.shape)) + 1e-4 * self.shape
                g_words += gw**2
                g_shape += gs**2
                self.words -= 0.4 * gw / np.sqrt(g_words)
                self.shape -= 0.3 * gs / np.sqrt(g_shape)
        self.trained = True


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    """labels: (key, good) with good 0 or 1; rows with nulls don't train, repeated labels are averaged and rounded (a tie is good).

    Of rows that repeat a labelled key the one with the least text trains.  Without labels the model gives even odds to all.
    """
    known = labels.where(F.col(key).isNotNull() & F.col("good").isNotNull()).groupBy(F.col(key).alias("__id")).agg(F.floor(F.avg("good") + 0.5).cast("double").alias("__good"))
    picked = known.orderBy(F.xxhash64(F.lit("quality"), "__id"), "__id").limit(sample)  # fixed size: can be broadcast
    found = docs.select(F.col(key).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(picked), "__id").where("__text is not null")
    found = found.groupBy("__id").agg(F.min("__text").alias("__text"), F.first("__good").alias("__good"))  # sample rows at most, whatever repeats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([w.astype("<u2").tobytes() for w, _ in got], pa.binary()), pa.array([s.tolist() for _, s in got], pa.list_(pa.float64()))], names=["id", "good", "words", "shape"])

    kind = docs.schema[key].dataType.simpleString()
    rows = found.select("__id", "__text", "__good").mapInArrow(run, f"id {kind}, good double, words binary, shape array<double>").collect()
    rows.sort(key=lambda r: (r["id"], bytes(r["words"])))
    model = Model()
    model.train([(np.frombuffer(r["words"], "<u2").astype(np.int64), np.array(r["shape"]), r["good"]) for r in rows])
    return model


def posteriors(docs: DataFrame, model: Model, work: Workspace, *, key: str = "doc_id", text: str = "text", host: str = "host", path: str = "path") -> DataFrame:
    """(key, evidence, host_rate, path_rate, score, kept) for each row.

    score is the posterior that a document is good, kept is score >= 0.5 (a tie is kept).  A null or empty text has the
    evidence of an empty one; long texts are read whole.  Null hosts and paths are a host, and a path, of their own.  Null keys and
    repeated rows come out as they went in; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    shipped = spark.sparkContext.broadcast(model)  # half a megabyte, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for b in batches:
            z = [m.logit(*features(t or "")) if m.trained else 0.0 for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())], names=["id", "host", "path", "p"])

    kinds = {c: docs.schema[c].dataType.simpleString() for c in (key, host, path)}
    rows = docs.select(F.col(key).alias("id"), F.col(host).alias("host"), F.col(path).alias("path"), F.col(text).alias("t"))
    scored = work.write(rows.mapInArrow(run, f"id {kinds[key]}, host {kinds[host]}, path {kinds[path]}, p double"), "evidence")
    paths = work.write(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "paths")
    hosts = work.write(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "hosts")
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    base = min(max((whole["s"] or 0.0) / (whole["n"] or 1), 1e-4), 1 - 1e-4)

    def pseudo(groups: DataFrame, around: F.Column) -> float:
        """Pseudo-counts by moments: what groups differ by beyond chance, against the variance of one document."""
        chance = around * (1 - around)
        m = groups.agg(F.sum(F.pow(F.col("s") - F.col("n") * around, 2) / F.col("n") - chance).alias("over"), F.sum("n").alias("n"), F.count("*").alias("k"), F.avg(chance).alias("chance")).first()
        if not m["k"]:
            return MOST
        between = max(m["over"], 0.0) / max(m["n"] - m["k"], 1)
        return float(min(MOST, max(LEAST, m["chance"] / between if between > 0 else MOST)))

    k_host = pseudo(hosts, F.lit(base))
    hosts = hosts.select(F.col("host").alias("h"), ((F.col("s") + k_host * base) / (F.col("n") + k_host)).alias("host_rate"))
    paths = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    k_path = pseudo(paths, F.col("host_rate"))
    paths = work.write(paths.select(F.col("host").alias("h"), F.col("path").alias("q"), "n", "s", "host_rate"), "rates")
    joined = scored.join(paths, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
    rate = (F.col("s") - F.col("p") + k_path * F.col("host_rate")) / (F.col("n") - 1 + k_path)
    rate = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), rate))
    odds = F.log(F.col("p") / (1 - F.col("p"))) + F.log(F.col("rate") / (1 - F.col("rate"))) - F.lit(float(np.log(base / (1 - base))))
    out = joined.withColumn("rate", rate).withColumn("score", 1 / (1 + F.exp(-odds)))
    return out.select(F.col("id").alias(key), F.col("p").alias("evidence"), "host_rate", F.col("rate").alias("path_rate"), "score", (F.col("score") >= 0.5).alias("kept"))


def sites(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with host and path from a URL: the host without www, and the first part of the path; null where a URL has none.

    Columns of these names are replaced.
    """
    host = F.regexp_replace(F.lower(F.try_parse_url(F.col(url), F.lit("HOST"))), r"^www\.", "")
    first = F.regexp_extract(F.try_parse_url(F.col(url), F.lit("PATH")), r"^/[^/]*", 0)
    return pages.withColumns({"host": host, "path": F.when(first != "", first)})


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good is a quality label of 1 and no toxic one; hosts are the sources of documents, paths their languages."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("host"), F.col("lang").alias("path"))
    labels = read(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int").alias("good"))
    return posteriors(docs, fit(docs, labels), Workspace(spark, "op10"))
