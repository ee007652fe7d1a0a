"""Comparison, ordering and text rules of the query languages, as column expressions."""

from __future__ import annotations

import fnmatch
import hashlib
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def alike(kind: T.DataType, value) -> bool:
    """Whether a literal is of a column's kind; others never compare (no coercion)."""
    if isinstance(value, bool):
        return isinstance(kind, T.BooleanType)
    if isinstance(value, (int, float)):
        return isinstance(kind, NUMBERS)
    return isinstance(kind, T.StringType) if isinstance(value, str) else True


def compare(column: Column | None, kind: T.DataType | None, op: str, value) -> Column:
    """field op literal: = and != are null-safe (a missing field is null), orders are false on nulls and other kinds."""
    if column is None:
        column, kind = F.lit(None), None
    if value is not None and kind is not None and not alike(kind, value):
        return F.lit(op == "!=")
    if op == "=":
        return column.eqNullSafe(F.lit(value))
    if op == "!=":
        return ~column.eqNullSafe(F.lit(value))
    if value is None or kind is None:
        return F.lit(False)
    found = {"<": column < value, "<=": column <= value, ">": column > value, ">=": column >= value}[op]
    return F.coalesce(found, F.lit(False))


def ordered(column: Column, descending: bool) -> Column:
    """Nulls are greatest: last ascending, first descending."""
    return column.desc_nulls_first() if descending else column.asc_nulls_last()


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)))


def query_tokens(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall("[a-z0-9]+", text.lower())))


def glob(column: Column, pattern: str) -> Column:
    return column.rlike("^" + fnmatch.translate(pattern).replace("(?s:", "(?:").replace("\\Z", "").replace("\\z", "") + "$")


def canonical(value) -> bytes:
    """JSON with sorted keys, no spaces, ASCII only: the bytes that are hashed."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), default=str).encode()


def digest(data: bytes) -> str:
    return hashlib.blake2b(data, digest_size=32).hexdigest()


@F.pandas_udf(T.StringType())
def blake2b(data: pd.Series) -> pd.Series:
    """BLAKE2b-256 of binary values, in hexadecimal; Spark has no built-in one."""
    return data.map(lambda x: None if x is None else digest(bytes(x)))


def id_part(key: Column) -> Column:
    return F.substring_index(key, ":", -1)
