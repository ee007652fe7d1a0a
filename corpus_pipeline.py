"""The corpus pipeline: language ID, line dedup, n-gram Jaccard join, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before it returned, and works on all
of it.  All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import jaccard_join, language_id, line_dedup, mixing, word_bpe
from palimpsest.llm.shared import Workspace, read

#: A document stays when the network gives its language this score; "und" goes.
LEAST_SCORE = 0.4


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those whose language the network can't tell.

    The network learns from the documents that have a language.
    """
    return language_id.keep_known(docs, language_id.fit(docs), LEAST_SCORE)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated runs of lines; a document of which nothing is left goes."""
    done = line_dedup.dedup_lines(docs, Workspace(spark, "stage5")).where("__left")
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("__gone") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the least doc_id."""
    found = jaccard_join.jaccard_components(docs, Workspace(spark, "stage4"))
    others = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a row for each time."""
    mixed = mixing.mix(docs, work := Workspace(spark, "stage8"), weights=mixing.labelled_weights(spark, sf_dir))
    return mixing.mixed_texts(docs, work.write(mixed, "mixed"), work)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of each row."""
    return word_bpe.multi(docs, outputs="ids")


STAGES = [
    ("language_id", identify_languages),
    ("line_dedup", dedup_lines),
    ("jaccard_join", join_near_copies),
    ("mixing", mix_sources),
    ("word_bpe", encode_texts),
]

#: SQL has neither the network nor the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, work = read(spark, sf_dir, "documents"), Workspace(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = work.write(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            work.drop(f"{k - 1}-{STAGES[k - 1][0]}")  # read for the last time
    return docs
