"""Imports of logs and objects in other layouts: lines with payloads, an object a file, objects in packs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.values import canonical, digest
from palimpsest.operators.integrity import GENESIS, cut_digest
from palimpsest.sources import log

LINE = "seq LONG, client STRING, nonce LONG, op STRING, payload STRING, ts DOUBLE, idem STRING, caused_by ARRAY<LONG>, evidence STRING, confidence DOUBLE, valid_from STRING, valid_to STRING, prev_hash STRING, hash STRING"
PAYLOAD = "coll STRING, id STRING, doc STRING, frm STRING, rel STRING, `to` STRING"
NODE = "id STRING, coll STRING, seq LONG, data STRING, caused_by ARRAY<STRING>, ts DOUBLE, valid_from STRING, valid_to STRING"
#: Fixed: the fields of a line that are always hashed, and those that are where they aren't null.
HASHED, HASHED_IF_SET = ("seq", "client", "nonce", "op", "payload", "ts", "idem"), ("caused_by", "evidence", "confidence", "valid_from", "valid_to")
#: Records of a pack that are handed on at once, by number and by bytes.
BATCH, BATCH_BYTES = 1000, 8 << 20


def op_lines(spark: SparkSession, path: str) -> DataFrame:
    """A log of JSON lines whose ops have a payload, as ops of this engine, up to its first corrupt line.  Deletes and links are ops too."""
    rows = log.read_json(spark, path, LINE).withColumn("p", F.from_json("payload", PAYLOAD))
    names = [f.name for f in T._parse_datatype_string(log.OPS)]
    inner = {f.name for f in T._parse_datatype_string(PAYLOAD)}
    return rows.select(*[F.col(f"p.{c}").alias(c) if c in inner else F.col(c) for c in names])


@F.pandas_udf(T.StructType([T.StructField("seq", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("prev_hash", "hash", "again")]]))
def _hashed(lines: pd.Series) -> pd.DataFrame:
    out = []
    for line in lines:
        try:
            op = json.loads(line)
            body = {c: op.get(c) for c in HASHED} | {c: op[c] for c in HASHED_IF_SET if op.get(c) is not None}
            out.append((op["seq"], op["prev_hash"], op["hash"], digest(op["prev_hash"].encode() + canonical(body))))
        except (ValueError, KeyError, TypeError, AttributeError):
            out.append((None, None, None, None))
    return pd.DataFrame(out, columns=["seq", "prev_hash", "hash", "again"]).astype({"seq": "Int64"})


def verify_lines(spark: SparkSession, path: str) -> DataFrame:
    """(seq, ok) of each line: its hash is that of its canonical JSON, and it names the hash before it.  A corrupt line has no number."""
    rows = spark.read.text(path).where("trim(value) <> ''").select(_hashed("value").alias("r")).select("r.*")
    before = rows.select((F.col("seq") + 1).alias("seq"), F.col("hash").alias("before"))
    ok = (F.col("again") == F.col("hash")) & (F.col("prev_hash") == F.coalesce("before", F.when(F.col("seq") == 0, F.lit(GENESIS))))
    return rows.join(before, "seq", "left").select("seq", F.coalesce(ok, F.lit(False)).alias("ok"))


def objects(spark: SparkSession, root: str) -> DataFrame:
    """(hash, ok, content) of objects in files of their own, <two digits of the hash>/<the others>; ok: the content has that hash."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    digits = r"/([0-9a-f]{2})/([0-9a-f]{62})$"
    named = found.select(F.concat(F.regexp_extract("path", digits, 1), F.regexp_extract("path", digits, 2)).alias("hash"), "content").where("hash <> ''")
    return named.select("hash", (cut_digest(F.col("content")) == F.col("hash")).alias("ok"), "content")


def packs(spark: SparkSession, root: str) -> DataFrame:
    """(hash, content) of objects in packs: records of a length (4 bytes, little-endian) and as many bytes.  A torn last record is left out.

    A pack is read whole by one task; its side files (.idx) only say where records are, and aren't read.
    """

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for data in rows["content"]:
                at, held, size = 0, [], 0
                while at + 4 <= len(data):
                    n = int.from_bytes(data[at : at + 4], "little")
                    if at + 4 + n > len(data):
                        break
                    held.append(bytes(data[at + 4 : at + 4 + n]))
                    at, size = at + 4 + n, size + n
                    if len(held) >= BATCH or size >= BATCH_BYTES:
                        yield _named(held)
                        held, size = [], 0
                yield _named(held)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where("path not like '%.idx' and path not like '%.tmp'")
    return files.select("content").mapInPandas(records, "hash string, content binary")


def _named(records: list[bytes]) -> pd.DataFrame:
    return pd.DataFrame({"hash": [hashlib.blake2b(r).hexdigest()[:64] for r in records], "content": records}, columns=["hash", "content"])


def node_ops(found: DataFrame) -> DataFrame:
    """Objects (hash, content) as ops of this engine, each hash once.  Causes, which are hashes there, become numbers; unknown ones go.

    What isn't a JSON object with an id is left out.
    """
    parsed = found.dropDuplicates(["hash"]).select("hash", F.from_json(F.col("content").cast("string"), NODE).alias("n"))
    nodes = parsed.where("n.id is not null").select("hash", "n.*")
    numbers = nodes.select(F.col("hash").alias("cause"), F.col("seq").alias("number"))
    caused = nodes.select("hash", F.explode("caused_by").alias("cause")).join(numbers, "cause")
    caused = caused.groupBy("hash").agg(F.sort_array(F.collect_set("number")).alias("caused_by"))  # as many as a node names
    rows = nodes.drop("caused_by").join(caused, "hash", "left")
    gone = F.get_json_object("data", "$._deleted")  # a tombstone names the document in its data
    filled = {c: F.col(c) for c in rows.columns} | {"op": F.when(gone.isNotNull(), "delete").otherwise("put"), "id": F.coalesce(gone, "id"), "doc": F.when(gone.isNull(), F.col("data"))}
    return rows.select(*[filled.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(log.OPS)])
