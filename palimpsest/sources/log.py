"""The log on disk: JSON lines in, Parquet in and out, exports, databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPS = "seq LONG, client STRING, nonce LONG, op STRING, coll STRING, id STRING, doc STRING, frm STRING, rel STRING, `to` STRING, ts DOUBLE, idem STRING, caused_by ARRAY<LONG>, evidence STRING, confidence DOUBLE, valid_from STRING, valid_to STRING, prev_hash STRING, hash STRING"


def read_json(spark: SparkSession, path: str, schema: str = OPS) -> DataFrame:
    """Replays a log of JSON lines up to its first corrupt line; what follows it can't be trusted.  Files follow by name."""
    full = T._parse_datatype_string(schema).add("__bad", T.StringType())
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    lines = spark.read.text(path).select("value", place.alias("__at")).where("trim(value) <> ''")
    rows = lines.select("__at", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("__r")).select("__at", "__r.*")
    bad = rows.where("__bad is not null").agg(F.min("__at").alias("__stop"))  # one row
    return rows.join(F.broadcast(bad)).where("__stop is null or __at < __stop").drop("__bad", "__at", "__stop")


def append(ops: DataFrame, path: str) -> None:
    """One commit: Parquet's own protocol makes all of it visible, or none."""
    ops.write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def export_json(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").json(path)


def write_snapshot(head: DataFrame, seq: int, path: str) -> None:
    head.withColumn("checkpoint_seq", F.lit(seq)).write.mode("overwrite").parquet(path)


def field_types(docs: DataFrame) -> DataFrame:
    """(field, type) in the words boolean, number, string and json."""
    word = lambda t: "boolean" if isinstance(t, T.BooleanType) else "string" if isinstance(t, (T.StringType, T.TimestampType, T.TimestampNTZType, T.DateType)) else "number" if isinstance(t, T.NumericType) else "json"
    return docs.sparkSession.createDataFrame([(f.name, word(f.dataType)) for f in docs.schema], "field string, type string")


def json_field_types(docs: DataFrame, column: str = "doc") -> DataFrame:
    """(field, type, n) over all documents of JSON text: the fields' types, "mixed" where they differ, nulls aside; all null is json."""
    parsed = F.try_parse_json(column)
    docs = docs.select(parsed.alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    each = docs.lateralJoin(docs.sparkSession.tvf.variant_explode(F.col("v").outer())).select(F.col("key").alias("field"), F.schema_of_variant("value").alias("t"))
    word = F.when(F.col("t") == "BOOLEAN", "boolean").when(F.col("t") == "STRING", "string").when(F.col("t").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), "number").when(F.col("t") != "VOID", "json")
    got = each.groupBy("field").agg(F.min(word).alias("least"), F.max(word).alias("most"), F.count("*").alias("n"))
    return got.select("field", F.when(F.col("least") != F.col("most"), "mixed").otherwise(F.coalesce("least", F.lit("json"))).alias("type"), "n")
