"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe
from palimpsest.llm.shared import read, shared_dir

#: A long text is cut into parts of about this many characters, at the next safe place.
PART_CHARS = 1 << 16
#: Parts are encoded in batches of about this many bytes.
BATCH_BYTES = 1 << 20


def parts(text: str, most: int = PART_CHARS) -> Iterator[str]:
    """Cuts before spaces between two non-space characters; each part after the first begins with its space.

    A text without such a place stays whole.
    """
    at = 0
    while len(text) - at > most:
        found = bpe.SAFE.search(text, at + most)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def n_bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def balanced(texts: list[str], cut: bool = True, most: int = BATCH_BYTES) -> Iterator[list[tuple[int, str]]]:
    """Batches of (row, part) with about as many bytes each, whatever the rows' lengths; without cut a part is a whole text."""
    batch, held = [], 0
    for row, text in enumerate(texts):
        for part in parts(text) if cut else (text,):
            batch.append((row, part))
            held += n_bytes(part)
            if held >= most:
                yield batch
                batch, held = [], 0
    if batch:
        yield batch


def counted(encoder: bpe.Bpe | bpe.Pieces, texts: list[str]) -> list[int]:
    """One batch call of the library for each balanced batch (two where texts have runs of white space)."""
    out = [0] * len(texts)
    for batch in balanced(texts, getattr(encoder, "plain", False)):
        for (row, _), n in zip(batch, encoder.counts([part for _, part in batch]), strict=True):
            out[row] += n
    return out


def count_tokens(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for each row of docs; other columns are left out.

    A null text counts as empty: 0 bytes, 0 tokens.  Null keys and repeated rows come out as they went
    in; an empty table gives an empty result.  Long texts are cut at safe places where the file's splitter has any, so counts
    are those of whole texts.  tokenizer is the path of a tokenizers (.json) or sentencepiece (.model) file, which every worker can read.
    """
    shared_dir(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.load(tokenizer, counting=True)
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            n = counted(encoder, texts)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[key, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key), F.col(text), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"), bpe.vocabulary("byte_bpe_50k.json"))
