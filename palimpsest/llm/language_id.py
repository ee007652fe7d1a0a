"""Language ID: a byte convolutional network over fixed-length windows, trained and applied in numpy.

Bytes are embedded; filters of several widths run over each window of a text; their maxima over the
window feed a softmax.  A text's score for a language is the mean of its windows' probabilities,
weighted by the bytes they hold, so every byte of every text counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.shared import read, shared_dir

WINDOW = 256
EMBED = 8
WIDTHS = (2, 3, 4)
FILTERS = 12
WIDEST = max(WIDTHS)
#: Windows that go through the network at once: their activations stay in the cache.
CHUNK = 128
#: The bound of the training sample: this many windows of each language, out of all windows of all its texts.
SAMPLE = 4500
#: Every so manyth training window is cut short, for short texts.
SHORT = 3
EPOCHS = 8
UNKNOWN = "und"


class ByteNet:
    """Parameters of the network; filters narrower than the widest are padded with fixed zeros."""

    def __init__(self, n_classes: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        n = FILTERS * len(WIDTHS)
        self.mask = np.zeros((WIDEST, EMBED, n), np.float32)
        for k, w in enumerate(WIDTHS):
            self.mask[:w, :, k * FILTERS : (k + 1) * FILTERS] = 1
        self.mask = self.mask.reshape(-1, n)
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.filters = rng.normal(0, 0.3, (WIDEST * EMBED, n)).astype(np.float32) * self.mask
        self.bias = np.zeros(n, np.float32)
        self.out = rng.normal(0, 0.2, (n, n_classes)).astype(np.float32)
        self.out_bias = np.zeros(n_classes, np.float32)

    def pooled(self, windows: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """(windows, filters): each filter's maximum, and where it is.

        The positions r, r + widest, ... of a window are one matrix product over its own memory,
        for each r below the widest: no windows are copied.
        """
        n = len(windows)
        x = np.take(self.embed, windows.ravel(), axis=0).reshape(-1)
        step = WIDEST * EMBED
        best, at = None, None
        for r in range(WIDEST):
            rows = n * WINDOW // WIDEST - (r > 0)
            y = x[r * EMBED : r * EMBED + rows * step].reshape(rows, step) @ self.filters
            if r:
                y = np.concatenate([y, np.full((1, y.shape[1]), -np.inf, np.float32)])
            y = y.reshape(n, WINDOW // WIDEST, -1)
            if r:
                y = y[:, :-1]  # the last would reach into the next window
            top = y.max(axis=1)
            if places:
                where = y.argmax(axis=1) * WIDEST + r
                at = where if at is None else np.where(top > best, where, at)
            best = top if best is None else np.maximum(best, top)
        return best + self.bias, at

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        h, _ = self.pooled(windows)
        z = np.maximum(h, 0) @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def train(self, windows: np.ndarray, classes: np.ndarray, weights: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 4e-3, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        names = ("embed", "filters", "bias", "out", "out_bias")
        m = {k: np.zeros_like(getattr(self, k)) for k in names}
        v = {k: np.zeros_like(getattr(self, k)) for k in names}
        step, total = 0, epochs * -(-len(windows) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for s in range(0, len(order), batch):
                rows = order[s : s + batch]
                g = self.gradients(windows[rows], classes[rows], weights[rows])
                step += 1
                lr = rate * (1 - step / (total + 1))
                for k in names:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    p = getattr(self, k)
                    p -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)

    def gradients(self, w: np.ndarray, classes: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
        h, at = self.pooled(w, places=True)
        a = np.maximum(h, 0)
        z = a @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        d = z / z.sum(axis=1, keepdims=True)
        d[np.arange(len(w)), classes] -= 1
        d *= (weights / weights.sum())[:, None]
        dh = (d @ self.out.T) * (h > 0)
        byte = w[np.arange(len(w))[:, None, None], at[:, :, None] + np.arange(WIDEST)]  # windows, filters, widest
        seen = self.embed[byte].reshape(len(w), -1, WIDEST * EMBED)
        d_filters = np.einsum("nfk,nf->kf", seen, dh) * self.mask
        d_embed = np.zeros_like(self.embed)
        np.add.at(d_embed, byte.reshape(-1), (dh[:, :, None] * self.filters.T[None]).reshape(-1, EMBED))
        return {"embed": d_embed, "filters": d_filters.astype(np.float32), "bias": dh.sum(0), "out": a.T @ d, "out_bias": d.sum(0)}


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts (padded with zeros), each window's text, and the bytes it holds."""
    sizes = np.array([len(t) for t in texts])
    n = -(-sizes // WINDOW)
    flat = np.zeros(int(n.sum()) * WINDOW, np.uint8)
    starts = np.concatenate([[0], np.cumsum(n)])
    for t, s in zip(texts, starts, strict=False):
        flat[s * WINDOW : s * WINDOW + len(t)] = np.frombuffer(t, np.uint8)
    owner = np.repeat(np.arange(len(texts)), n)
    k = np.arange(len(owner)) - starts[owner]
    return flat.reshape(-1, WINDOW), owner, np.minimum(WINDOW, sizes[owner] - k * WINDOW)


class Model:
    def __init__(self, languages: list[str], net: ByteNet | None):
        self.languages, self.net = languages, net

    def predict(self, texts: list[str | None], lettered: list[bool | None]) -> tuple[list[str], list[float]]:
        """Languages and scores; "und" where a text has no letter."""
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        rows = [i for i, has in enumerate(lettered) if has] if self.net else []
        held, size = [], 0
        for i in rows:
            held.append(i)
            size += len(texts[i])
            if size >= 1 << 20 or i == rows[-1]:  # batches balanced by length
                w, owner, weight = windows_of([texts[j].encode("utf-8", "replace") for j in held])
                p = np.concatenate([self.net.probabilities(w[s : s + CHUNK]) for s in range(0, len(w), CHUNK)])
                total = np.zeros((len(held), p.shape[1]))
                for c in range(p.shape[1]):
                    total[:, c] = np.bincount(owner, p[:, c] * weight, len(held))
                total /= total.sum(axis=1, keepdims=True)
                for j, q in zip(held, total, strict=True):
                    names[j], scores[j] = self.languages[int(q.argmax())], float(min(1.0, q.max()))
                held, size = [], 0
        return names, scores


def lettered(text: F.Column) -> F.Column:
    """Whether a text has a letter (Unicode's categories L): training and prediction go by the same test."""
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(labelled: DataFrame, *, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Trains on at most `sample` windows of each language, those with the least hash of text and place.

    A window of any place of any text can be taken; equal windows of equal texts count once.  Rows with a null text or
    language, or without a letter, don't train.  Without a row, or with languages of one value only, the model still works:
    the first answers "und" for all, the second that value.
    """
    rows = labelled.where(F.col(lang).isNotNull() & lettered(F.col(text))).select(F.col(lang).alias("l"), F.col(text).alias("t"))
    n = F.ceil(F.length("t") / WINDOW).cast("int")
    counts = {r[0]: r[1] for r in rows.groupBy("l").agg(F.sum(n)).collect()}  # a row a language
    if not counts:
        return Model([], None)
    part = F.create_map(*[x for k, c in counts.items() for x in (F.lit(k), F.lit(min(1.0, 1.5 * sample / c)))])
    h = F.xxhash64(F.lit("lang"), "t")
    uniform = lambda k: F.pmod(F.xxhash64("h", k), F.lit(1 << 30)) / F.lit(float(1 << 30))
    hashed = rows.select("l", "t", h.alias("h"), part[F.col("l")].alias("p"))
    taken = hashed.select("l", "t", "h", F.explode(F.filter(F.sequence(F.lit(0), n - 1), lambda k: uniform(k) < F.col("p"))).alias("k"))
    cut = F.substring("t", F.col("k") * WINDOW + 1, F.lit(WINDOW))
    got = taken.select("l", uniform(F.col("k")).alias("u"), cut.alias("w")).distinct().collect()  # some 1.5 * sample a language
    languages, texts, classes, seen = sorted(counts), [], [], dict.fromkeys(counts, 0)
    rng = np.random.default_rng(7)
    for r in sorted(got, key=lambda r: (r["u"], r["l"], r["w"])):
        seen[r["l"]] += 1
        if seen[r["l"]] <= sample:
            piece = r["w"].encode("utf-8", "replace")[:WINDOW]
            if seen[r["l"]] % SHORT == 0:
                piece = piece[: int(rng.integers(12, WINDOW))]
            texts.append(piece)
            classes.append(languages.index(r["l"]))
    w, owner, _ = windows_of(texts)
    y = np.array(classes)
    share = np.bincount(y, minlength=len(languages))
    net = ByteNet(len(languages))
    net.train(w, y[owner], (1 / np.maximum(share, 1))[y[owner]].astype(np.float32))
    return Model(languages, net)


def identify(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carry..., lang_pred, score) for each row.

    "und" with score 0 where the text is null, empty or has no letter.  Long texts are cut into windows, all of which count.
    Null keys and repeated rows come out as they went in; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    shipped = spark.sparkContext.broadcast(model)  # some 20 kB, whatever the input
    columns = [key, *carry]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = shipped.value.predict(b.column(0).to_pylist(), b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*columns, "lang_pred", "score"])

    rows = docs.select(F.col(text), lettered(F.col(text)), *[F.col(c) for c in columns])
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model, least: float, *, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose language is known with at least this score."""
    spark = docs.sparkSession
    shared_dir(spark)
    shipped = spark.sparkContext.broadcast(model)
    place = docs.columns.index(text)
    names_out = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = shipped.value.predict(b.column(place).to_pylist(), b.column(b.num_columns - 1).to_pylist())
            kept = pa.RecordBatch.from_arrays(b.columns[:-1], names=names_out)
            yield kept.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return docs.select("*", lettered(F.col(text))).mapInArrow(run, docs.schema)


def held_out(key: str = "doc_id") -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those that aren't held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out().alias("held_out"))
    model = fit(docs.where(~F.col("held_out")))
    return identify(docs, model, carry=("held_out",))
