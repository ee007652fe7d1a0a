"""Plans to DataFrames: binding, and the order of the stages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import values
from palimpsest.operators import graph, resolve
from palimpsest.plans.plan import Plan
from palimpsest.plans.text import Change, parse, parse_sql


@dataclass
class Store:
    """Collections by name, as versions (seq, op, id, fields); edges as intervals; indexed search fields.

    current: collections of which each key has one version, a put: their rows are HEAD, and filters reach the scan.
    ops: all ops (seq, op, coll, id, caused_by, …) for TRACE, and typed, which gives such rows their fields.  Without ops a walk
    is over the collections that have caused_by.  json_search: SEARCH looks in the whole document as JSON, names too.
    """

    collections: dict[str, DataFrame]
    edges: DataFrame | Callable[[], DataFrame] | None = None
    targets: dict[str, str] = field(default_factory=dict)
    search_fields: dict[str, list[str]] = field(default_factory=dict)
    current: frozenset[str] = frozenset()
    ops: DataFrame | None = None
    typed: Callable[[DataFrame], DataFrame] = lambda rows: rows
    json_search: bool = False

    def state(self, name: str, seq: int | None = None) -> DataFrame:
        versions = self.collections[name]
        if name not in self.current:
            return resolve.as_of(versions, seq)
        return (versions if seq is None else versions.where(F.col("seq") <= seq)).drop("op")

    def causal(self) -> DataFrame:
        if self.ops is not None:
            return self.ops
        parts = [v.withColumn("coll", F.lit(n)) for n, v in self.collections.items() if "caused_by" in v.columns]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def query(self, text: str) -> DataFrame:
        return run(parse(text), self)

    def sql(self, text: str) -> DataFrame | Change:
        got = parse_sql(text)
        return got if isinstance(got, Change) else run(got, self)


ALIASES = {"_id": "id", "_seq": "seq", "_caused_by": "caused_by", "_evidence": "evidence", "_confidence": "confidence", "_valid_from": "valid_from", "_valid_to": "valid_to", "_expires_at": "expires_at", "_hash": "hash", "_coll": "coll"}


def run(plan: Plan, store: Store) -> DataFrame:
    """candidates, WHERE, SEARCH, VALID AS OF, ORDER BY, TRAVERSE, TRACE, LIMIT, GROUP BY; an unknown collection is an error."""
    docs = store.state(plan.source, plan.as_of)

    def column(name: str):
        name = name if name in docs.columns else ALIASES.get(name, name)
        return (F.col(name), docs.schema[name].dataType) if name in docs.columns else (None, None)

    for name, op, value in plan.where:
        docs = docs.where(values.compare(*column(name), op, value))
    for name, pattern, _ in plan.like:
        c, kind = column(name)  # an absent field is like nothing
        docs = docs.where(c.like(pattern) if isinstance(kind, T.StringType) else F.lit(False))
    for name, null in plan.nulls:
        c, _ = column(name)
        docs = docs.where((c.isNull() if null else c.isNotNull()) if c is not None else F.lit(null))
    if plan.search is not None:
        docs = docs.where(search(docs, plan.search, store.search_fields.get(plan.source), store.json_search))
    if plan.valid_as_of is not None:
        docs = resolve.valid_at(docs, plan.valid_as_of)
    order = []
    if plan.order_by:
        c, _ = column(plan.order_by[0])
        order = [*([values.ordered(c, plan.order_by[1])] if c is not None else []), F.col("id")]
        docs = docs.orderBy(*order)
    if plan.traverse:
        docs = graph.traverse(docs, store.edges() if callable(store.edges) else store.edges, store.state(store.targets[plan.traverse], plan.as_of), plan.traverse, plan.as_of)
        order = []
    if plan.trace:
        # the walk goes through the puts of all collections; what it reaches may be of any
        ops = store.causal()
        ops = ops if plan.as_of is None else ops.where(F.col("seq") <= plan.as_of)
        found = graph.trace(ops, docs.select("seq"), plan.trace_reverse)
        if plan.trace_reverse:
            states = ops.where(F.col("op").isin("put", "delete")).withColumn("__key", F.struct("coll", "id"))
            found = resolve.as_of(states, None, "__key").drop("__key").join(found.select("coll", "id").distinct(), ["coll", "id"], "left_semi")
        else:
            found = found.drop("op")
        docs = store.typed(found)
        order = []
    if plan.limit is not None or plan.offset:
        docs = docs if order else docs.orderBy("id")  # a stable page
        docs = docs.offset(plan.offset) if plan.offset else docs
        docs = docs.limit(plan.limit) if plan.limit is not None else docs
    if plan.group_by:
        docs = grouped(docs, plan.group_by, column, *(plan.aggregate or ("COUNT", None)))
    if plan.columns:
        docs = docs.select(*[column(c)[0].alias(c) if column(c)[0] is not None else F.lit(None).alias(c) for c in plan.columns])
    return docs


def search(docs: DataFrame, text: str, fields: list[str] | None, whole_json: bool = False):
    """With indexed fields: every token equals one of theirs.  Without: every token is in the text of all values; or the text in the JSON."""
    if whole_json:
        own = [c for c in docs.columns if c not in ("seq", "hash")]
        return F.lower(F.to_json(F.struct(*own))).contains(text.lower())
    asked = values.query_tokens(text)
    if not asked:
        return F.lit(False)
    if fields:
        held = F.array_union(F.array().cast("array<string>"), F.flatten(F.array(*[F.coalesce(values.tokens(F.col(f)), F.array().cast("array<string>")) for f in fields])))
        return F.forall(F.array(*map(F.lit, asked)), lambda x: F.array_contains(held, x))
    own = [F.col(f.name).cast("string") for f in docs.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) and f.name != "seq"]
    whole = F.lower(F.concat_ws(" ", *own))
    found = F.lit(True)
    for token in asked:
        found = found & whole.contains(token)
    return found


def grouped(docs: DataFrame, by: str, column: Callable, function: str, of: str | None) -> DataFrame:
    """(by, count[, function_of]): numbers only; an empty SUM is 0, other empty ones are null; an absent field is one null group."""
    out = [F.count("*").alias("count")]
    if function != "COUNT":
        c, kind = column(of)
        number = c if isinstance(kind, values.NUMBERS) else F.lit(None).cast("double")
        made = {"SUM": F.coalesce(F.sum(number), F.lit(0)), "AVG": F.avg(number), "MIN": F.min(number), "MAX": F.max(number)}[function]
        out.append(made.alias(f"{function.lower()}_{of}"))
    key, _ = column(by)
    return docs.groupBy((key if key is not None else F.lit(None).cast("string")).alias(by)).agg(*out)
