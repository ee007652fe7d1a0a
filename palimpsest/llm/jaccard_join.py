"""N-gram Jaccard join, size-aware: subsets of small sets are enumerated, large sets scan inverted lists.

A document's set are its distinct word n-grams, as 64-bit hashes.  Equal sets are one class and compared
once.  Small classes emit a key for each subset of the least overlap that a partner's size asks for: sharing a key is
linking.  Large classes emit postings for a prefix of their set, rarest n-grams first; sets that link share
an n-gram of their prefixes.  The size up to which sets are small is the one of least cost.

Lists aren't expanded into pairs.  First each class meets the head of the lists that it has most in common with; what
links, becomes components.  Only between components that still share a list are pairs formed.  Pairs
pass a bound on their difference (parity bits) before their whole sets are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.shared import Workspace, components, only_hits, read, shared_dir
from palimpsest.llm.word_bpe import planes, spread_out, squeezed, unplanes

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
MIX = np.uint64(0x9E3779B97F4A7C15)
#: The most frequent n-grams whose order is broadcast: at most this many, with counts from this one on.
HEAVY, HEAVY_FROM = 1 << 17, 32
#: N-grams that a task counts, and postings that it emits, at once.
FLUSH, EMIT = 2_000_000, 200_000
#: N-grams of all documents for each range of hashes that is summed in one group.
RANGE = 8_000_000
#: Classes of a list that meet in one cell when pairs are formed.
CELL = 256
#: Sets beyond this size are never small: their subsets are too many.
MOST_SMALL = 12
#: The side of what isn't a subset's key but a posting.
LIST = 3
#: What a posting costs against a subset's key: it is packed, sorted, and may lead to pairs.
POSTING_COST = 4.0


def final(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """The distinct n-grams of a whole text, hashed and sorted; of fewer words the sequence as one; of none, none."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(n, len(h))
    acc = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        acc = acc * MIX + h[k : len(h) - size + 1 + k]
    return np.unique(final(acc))


def node_of(s: np.ndarray, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes(), seed) - (1 << 63)


def parity(s: np.ndarray) -> bytes:
    bits = 1 << max(6, math.ceil(math.log2(2 * len(s))))
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def difference(a: bytes, b: bytes) -> int:
    """At most the size of the symmetric difference of the sets of these parity bits."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        half = len(x) // 2
        x = x[:half] ^ x[half:]
    return int(np.bitwise_count(x ^ y).sum())


def overlap(n: int, m: int, percent: int) -> int:
    """The least intersection with percent * union <= 100 * intersection."""
    return -(-percent * (n + m) // (100 + percent))


def subset_keys(s: np.ndarray, small: int, percent: int) -> list[tuple[int, int]]:
    """(key, side) for each subset that a link with a small set must contain.

    A key is of a pair of sizes: side is 0 if they are equal, 1 if this set is the smaller one, else 2.
    """
    n, out = len(s), []
    for m in range(-(-percent * n // 100), min(small, 100 * n // percent) + 1):
        sizes, side = (min(n, m), max(n, m)), (n < m) + 2 * (n > m)
        for c in combinations(range(n), overlap(n, m, percent)):
            out.append((xxhash.xxh3_64_intdigest(np.array([*sizes, *s[list(c)]], np.uint64).tobytes()), side))
    return out


def n_keys(n: int, small: int, percent: int) -> int:
    return sum(math.comb(n, overlap(n, m, percent)) for m in range(-(-percent * n // 100), min(small, 100 * n // percent) + 1) if overlap(n, m, percent) <= n)


def boundary(histogram: dict[int, int], percent: int) -> int:
    """The size up to which sets are small: of the least total cost of keys and postings."""

    def cost(x: int) -> float:
        keys = sum(c * n_keys(n, x, percent) for n, c in histogram.items() if n <= x)
        return keys + POSTING_COST * sum(c * (n - -(-percent * n // 100) + 1) for n, c in histogram.items() if n >= first_large(x, percent))

    return min(range(MOST_SMALL + 1), key=cost)


def first_large(small: int, percent: int) -> int:
    """The least size of a set that can link with a set that isn't small."""
    return -(-percent * (small + 1) // 100)


class Joiner:
    def __init__(self, docs: DataFrame, work: Workspace, *, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 75, small: int | None = None):
        self.spark, self.work, self.words, self.percent, self.small = docs.sparkSession, work, words, percent, small
        shared_dir(self.spark)
        self.kind = docs.schema[key].dataType.simpleString()
        self.docs = docs.select(F.col(key).alias("doc"), F.col(text).alias("t"))
        self.seed = 0

    # the order of n-grams

    def heavy(self) -> tuple[np.ndarray, np.ndarray]:
        """The most frequent n-grams by the upper halves of their hashes (sorted), and their ranks: 1 is the rarest of them.

        Counts are exact and over all documents.  A task adds up FLUSH n-grams at a time and packs the counts by ranges of hashes, a row
        a range; the rows of a range are summed in one group.  Ranges are as many as the n-grams of all documents ask for, so that a
        group is of bounded size: a frequent n-gram is in it once for each time that a task adds up.
        Any total order gives right results; this one keeps frequent n-grams out of prefixes.
        """
        words = self.words
        ranges = max(32, -(-(self.info.agg(F.sum("n")).first()[0] or 0) // RANGE))
        bounds = ((np.arange(1, ranges, dtype=np.uint64) << np.uint64(32)) // np.uint64(ranges)).astype(np.uint32)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0

            def flushed() -> pa.RecordBatch:
                x, c = np.unique(np.concatenate(held), return_counts=True)
                cuts = np.searchsorted(x, bounds)
                rows = [(k, y, m) for k, (y, m) in enumerate(zip(np.split(x, cuts), np.split(c, cuts), strict=True)) if len(y)]
                more = [np.flatnonzero(m > 1) for _, _, m in rows]
                packed = [squeezed(planes(np.diff(y, prepend=np.uint32(0))), planes(i), planes(m[i])) for (_, y, m), i in zip(rows, more, strict=True)]
                return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(packed, pa.binary())], names=["range", "packed"])

            for b in batches:
                for t in b.column(0).to_pylist():
                    if len(s := shingles(t, words)):
                        held.append((s >> np.uint64(32)).astype(np.uint32))
                        n += len(s)
                    if n >= FLUSH:
                        yield flushed()
                        held, n = [], 0
            if held:
                yield flushed()

        def summed(table: pa.Table) -> pa.Table:
            seen, again, more = [], [], []
            for data in table.column("packed").to_pylist():
                steps, at, c = map(unplanes, spread_out(data))
                seen.append(np.cumsum(steps, dtype=np.uint32))
                again.append(seen[-1][at])
                more.append(c.astype(np.int64) - 1)
            x, c = np.unique(np.concatenate(seen), return_counts=True)
            np.add.at(c, np.searchsorted(x, np.concatenate(again)), np.concatenate(more))
            often = c >= HEAVY_FROM
            return pa.table({"x": pa.array(x[often].astype(np.int64)), "c": pa.array(c[often].astype(np.int64))})

        found = self.docs.select("t").mapInArrow(count, "range long, packed binary").groupBy("range").applyInArrow(summed, "x long, c long")
        found = self.work.write(found, "frequent")
        step = F.floor(F.log2("c") * 16)
        least, n = 0, 0
        for r in sorted(found.groupBy(step.alias("s")).count().collect(), key=lambda r: -r[0]):  # some hundred rows
            n += r[1]
            if n > HEAVY:
                break
            least = r[0]
        rows = sorted((r.c, r.x) for r in found.where(step >= least).collect())  # HEAVY at most
        x = np.array([x for _, x in rows], np.uint64)
        order = np.argsort(x)
        return x[order], (order + 1).astype(np.int64)

    # classes of equal sets

    def classes(self) -> None:
        words = self.words

        def make(seed: int):
            def info(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    sets = [shingles(t, words) for t in b.column(1).to_pylist()]
                    node = [node_of(s, seed) if len(s) else None for s in sets]
                    check = [xxhash.xxh3_64_intdigest(s.tobytes(), seed + 1000) - (1 << 63) if len(s) else None for s in sets]
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.int64()), pa.array(check, pa.int64()), pa.array([parity(s) if len(s) else None for s in sets], pa.binary())], names=["doc", "n", "node", "other", "sig"])

            return info

        while True:
            self.info = self.work.write(self.docs.mapInArrow(make(self.seed), f"doc {self.kind}, n long, node long, other long, sig binary"), f"info-{self.seed}")
            grouped = self.info.where("node is not null").groupBy("node", "n")
            self.nodes = self.work.write(grouped.agg(F.min("doc").alias("rep"), F.min("sig").alias("sig"), F.min("other").alias("o"), F.max("other").alias("p")), f"nodes-{self.seed}")
            if self.nodes.where("o <> p").isEmpty():  # else two sets share 64 bits: hash them anew
                return
            self.seed += 1

    # keys and postings

    def postings(self) -> tuple[DataFrame, DataFrame]:
        """(h, node, n, pos) of prefixes, of n-grams that more than one class may have; (h, node, side) of subsets' keys."""
        histogram = {r[0]: r[1] for r in self.nodes.groupBy(F.least("n", F.lit(4 * MOST_SMALL)).alias("n")).count().collect()}
        small = boundary(histogram, self.percent) if self.small is None else self.small
        large, percent, seed, words = first_large(small, self.percent), self.percent, self.seed, self.words
        shipped = self.spark.sparkContext.broadcast(self.heavy())

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fps, ranks = shipped.value
            seen: set[int] = set()
            held: list[np.ndarray] = []
            n = 0

            def flushed() -> Iterator[pa.RecordBatch]:
                x = np.concatenate(held, axis=1)
                columns = (pa.array(x[0].view(np.int64)), pa.array(x[1].view(np.int64)), pa.array(x[2].astype(np.int32)), pa.array(x[3].astype(np.int32)), pa.array(x[4].astype(np.int32)))
                yield from pa.Table.from_arrays(list(columns), names=["h", "node", "n", "pos", "side"]).to_batches(20_000)

            def add(h: np.ndarray, node: int, size: int, pos: np.ndarray, side: np.ndarray) -> None:
                rows = np.empty((5, len(h)), np.uint64)
                rows[0], rows[1], rows[2], rows[3], rows[4] = h, np.int64(node).view(np.uint64), size, pos, side
                held.append(rows)

            for b in batches:
                for t in b.column(0).to_pylist():
                    s = shingles(t, words)
                    if not len(s) or (node := node_of(s, seed)) in seen:
                        continue
                    seen.add(node)
                    if len(s) <= small:
                        k = np.array(subset_keys(s, small, percent), np.uint64).reshape(-1, 2)
                        add(k[:, 0], node, len(s), np.zeros(len(k)), k[:, 1])
                        n += len(k)
                    if len(s) >= large:
                        p = len(s) - -(-percent * len(s) // 100) + 1
                        fp = s >> np.uint64(32)
                        at = np.minimum(np.searchsorted(fps, fp), max(len(fps) - 1, 0))
                        rank = np.where(fps[at] == fp, ranks[at], 0) if len(fps) else np.zeros(len(s), np.int64)
                        order = np.argsort(rank, kind="stable")[:p]  # s is sorted: ties by hash
                        add(s[order], node, len(s), np.arange(p), np.full(p, LIST))
                        n += p
                    if n >= EMIT:
                        yield from flushed()
                        held, n = [], 0
            if held:
                yield from flushed()

        all_ = self.work.write(self.docs.select("t").mapInArrow(emit, "h long, node long, n int, pos int, side int"), "postings")
        listed = all_.where(F.col("side") == LIST)
        # counted where they are before they travel; what only one task's class has goes no further
        more = self.work.write(listed.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "repeated")
        lists = only_hits(listed, more, "h").join(more, "h").groupBy("h", "node").agg(F.max("n").alias("n"), F.min("pos").alias("pos"))
        lists = self.work.write(lists, "lists")
        keys = self.work.write(all_.where(F.col("side") != LIST).select("h", "node", "side").distinct(), "keys")
        self.work.drop("postings", "repeated")
        return lists, keys

    def possible(self, n: Column, pos: Column, m: Column, at: Column) -> Column:
        """Sizes that can link, with enough n-grams from this one on if it is the first in common."""
        need = F.ceil((n + m) * F.lit(self.percent) / F.lit(100 + self.percent))
        return (F.least(n, m) * 100 >= F.greatest(n, m) * self.percent) & (F.least(n - pos, m - at) >= need)

    # verification

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """pairs (a, b) of classes, those that link."""
        percent, words, seed = self.percent, self.words, self.seed
        side = self.nodes.select("node", "n", "sig")
        a, b = (side.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}")) for x in "ab")

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r in batches:
                c = [x.to_pylist() for x in r.columns]
                ok = [difference(x, y) <= n + m - 2 * overlap(n, m, percent) for n, m, x, y in zip(*c[2:], strict=True)]
                yield pa.RecordBatch.from_arrays([r.column(0), r.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

        joined = pairs.join(a, "a").join(b, "b").select("a", "b", "n_a", "n_b", "sig_a", "sig_b")
        pairs = self.work.write(joined.mapInArrow(near, "a long, b long"), f"{name}-near")
        asked = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "node")
        asked = asked.join(self.nodes.select("node", "rep"), "node").select(F.col("rep").alias("doc"), "node")
        asked = self.work.write(asked.where("doc is not null"), f"{name}-asked")

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r in batches:
                found = [shingles(t, words) for t in r.column(1).to_pylist()]
                right = [bool(len(s)) and node_of(s, seed) == n for s, n in zip(found, r.column(0).to_pylist(), strict=True)]  # repeated ids may have other texts
                yield pa.RecordBatch.from_arrays([r.column(0), pa.array([s.tobytes() for s in found], pa.binary())], names=["node", "s"]).filter(pa.array(right, pa.bool_()))

        texts = only_hits(self.docs, asked.select("doc"), "doc").join(asked, "doc").select("node", "t")
        held = self.work.write(texts.mapInArrow(sets, "node long, s binary").dropDuplicates(["node"]), f"{name}-sets")

        def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r in batches:
                ok = []
                for x, y in zip(r.column(2).to_pylist(), r.column(3).to_pylist(), strict=True):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([r.column(0), r.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

        one, two = held.select(F.col("node").alias("a"), F.col("s").alias("s_a")), held.select(F.col("node").alias("b"), F.col("s").alias("s_b"))
        out = self.work.write(pairs.join(one, "a").join(two, "b").select("a", "b", "s_a", "s_b").mapInArrow(linked, "a long, b long"), f"{name}-linked")
        self.work.drop(f"{name}-sets", f"{name}-near", f"{name}-asked")
        return out

    def run(self) -> DataFrame:
        self.classes()
        lists, keys = self.postings()
        # subsets: all classes of a key of equal sizes link with its least; of unequal sizes, each class links
        # with all of the other size, but not always with those of its own
        least = [F.min(F.when(F.col("side") == k, F.col("node"))).alias(f"a{k}") for k in range(3)]
        heads = keys.groupBy("h").agg(*least, F.count("*").alias("c")).where("c > 1 and (a0 is not null or a1 is not null and a2 is not null)")
        heads = self.work.write(heads.drop("c"), "key-heads")
        other = F.when(F.col("side") == 0, F.col("a0")).when(F.col("side") == 1, F.col("a2")).otherwise(F.col("a1"))
        stars = keys.join(heads, "h").withColumn("a", other).where("node <> a")
        stars = stars.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"))
        # lists: each class with the head that it meets in most lists
        # the head of a list is its class with the most company in all its lists: of near copies, what they were copied from
        counts = self.work.write(lists.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "counts")
        degree = self.work.write(lists.join(counts, "h").groupBy("node").agg(F.sum("c").alias("degree")), "degree")
        ranked = self.work.write(lists.join(degree, "node"), "ranked")
        first = ranked.groupBy("h").agg(F.max(F.struct("degree", "node", "n", "pos")).alias("top"), F.count("*").alias("c")).where("c > 1")
        first = self.work.write(first.select("h", F.col("top.node").alias("a"), F.col("top.n").alias("m"), F.col("top.pos").alias("at")), "heads")
        self.work.drop("ranked")
        met = lists.join(first, "h").where((F.col("node") != F.col("a")) & self.possible(F.col("n"), F.col("pos"), F.col("m"), F.col("at")))
        met = met.groupBy("node", "a").count().groupBy("node").agg(F.max_by("a", F.struct("count", "a")).alias("a"))
        tried = self.work.write(stars.union(met.select("a", F.col("node").alias("b"))).distinct(), "tried")
        links = self.verified(tried, "first")
        joined = self.work.write(components(links, self.work, "near"), "near-components")
        # between components that share a list
        placed = self.work.write(lists.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")
        mixed = placed.groupBy("h").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("h")
        left = self.work.write(placed.join(mixed, "h"), "left")
        self.work.drop("placed", "lists")
        # a long list is cut into cells of its classes on both sides
        long_ = self.work.write(left.groupBy("h").agg(F.ceil(F.count("*") / CELL).cast("int").alias("cells")), "long")
        left = left.join(long_, "h").withColumn("own", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
        sides = {"a": ["h", F.col("own").alias("i"), other.alias("j")], "b": ["h", other.alias("i"), F.col("own").alias("j")]}
        a, b = (left.select(*sides[x], *[F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "pos", "component")]) for x in "ab")
        across = (F.col("component_a") < F.col("component_b")) & self.possible(F.col("n_a"), F.col("pos_a"), F.col("n_b"), F.col("pos_b"))
        pairs = a.join(b, ["h", "i", "j"]).where(across).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
        pairs = self.work.write(pairs.join(tried, ["a", "b"], "left_anti").join(tried.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti"), "pairs")
        links = links.union(self.verified(pairs, "second"))
        # components by documents' ids
        reps = self.nodes.select("node", "rep")
        edges = links.join(reps.withColumnsRenamed({"node": "a", "rep": "ra"}), "a").join(reps.withColumnsRenamed({"node": "b", "rep": "rb"}), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        found = components(edges.where("a is not null and b is not null"), self.work, "docs")
        known = self.work.write(reps.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("node", F.coalesce("component", "rep").alias("component")), "known")
        out = self.info.where("node is not null").select("doc", "n", "node").join(known, "node").select("doc", "n", "component")
        return out.union(self.info.where("node is null").select("doc", "n", F.col("doc").alias("component")))


def jaccard_components(docs: DataFrame, work: Workspace, *, key: str = "doc_id", **more) -> DataFrame:
    """(key, n_shingles, component_id) for each row of docs; other columns are left out.  Keys are of any ordered type.

    Texts without words, and null ones, have empty sets and link with nothing; long ones are read whole.  Rows that repeat a key
    are documents each.  Null keys have no part in a component's id, and texts that only null keys have link with no others:
    their component_id is null.  An empty table gives an empty result.  small: the size up to which sets are small, in place of
    the one of least cost.
    """
    j = Joiner(docs, work, key=key, **more)
    return j.run().select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"), Workspace(spark, "op4"))
