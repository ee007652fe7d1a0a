"""The document dialect: filters, aggregation pipelines, projections and updates given as dictionaries.

Filters are two-valued: a predicate on a missing field is false, never null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.values import NUMBERS, alike


class DialectError(ValueError):
    """An operator, or a mix of them, that the dialect doesn't have."""


def kind_of(schema: T.StructType, path: str) -> T.DataType | None:
    kind: T.DataType = schema
    for part in path.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return None
        kind = kind[part].dataType
    return kind


def _any(column: Column, kind: T.DataType, test) -> Column:
    """A test of a value, or of any element of an array."""
    if isinstance(kind, T.ArrayType):
        return F.exists(column, lambda x: F.coalesce(test(x), F.lit(False)))
    return test(column)


def _equal(column: Column | None, kind: T.DataType | None, value) -> Column:
    if kind is None:
        return F.lit(value is None)
    if value is None:
        return column.isNull()
    if isinstance(value, list):
        return column.eqNullSafe(F.array(*map(F.lit, value)))
    inner = kind.elementType if isinstance(kind, T.ArrayType) else kind
    if not alike(inner, value):
        return F.lit(False)
    return F.array_contains(column, value) if isinstance(kind, T.ArrayType) else column == value


def operator(schema: T.StructType, path: str, op: str, value, beside: dict) -> Column:
    kind = kind_of(schema, path)
    c = F.col(path) if kind is not None else None
    inner = kind.elementType if isinstance(kind, T.ArrayType) else kind
    if op == "$eq":
        return _equal(c, kind, value)
    if op == "$ne":
        return ~F.coalesce(_equal(c, kind, value), F.lit(False))
    if op in ("$gt", "$gte", "$lt", "$lte"):
        if kind is None or value is None or not alike(inner, value):
            return F.lit(False)
        return _any(c, kind, {"$gt": lambda x: x > value, "$gte": lambda x: x >= value, "$lt": lambda x: x < value, "$lte": lambda x: x <= value}[op])
    if op in ("$in", "$nin"):
        found = reduce(lambda a, b: a | b, [F.coalesce(_equal(c, kind, v), F.lit(False)) for v in value], F.lit(False))
        return found if op == "$in" else ~found
    if op == "$exists":
        here = c.isNotNull() if c is not None else F.lit(False)
        return here if value else ~here
    if op == "$regex":
        flags = "".join(x for x in beside.get("$options", "") if x in "ims")
        return c.rlike((f"(?{flags})" if flags else "") + value) if isinstance(kind, T.StringType) else F.lit(False)
    if op == "$options":
        return F.lit(True)
    if op == "$not":
        return ~F.coalesce(field(schema, path, value), F.lit(False))
    if op == "$size":
        return F.size(c) == value if isinstance(kind, T.ArrayType) else F.lit(False)
    if op == "$all":
        return F.size(F.array_except(F.array(*map(F.lit, value)), c)) == 0 if isinstance(kind, T.ArrayType) else F.lit(False)
    if op == "$elemMatch":
        if not isinstance(kind, T.ArrayType):
            return F.lit(False)
        tests = {"$gt": lambda x, v: x > v, "$gte": lambda x, v: x >= v, "$lt": lambda x, v: x < v, "$lte": lambda x, v: x <= v, "$eq": lambda x, v: x == v, "$ne": lambda x, v: x != v}
        if isinstance(inner, T.StructType):
            return F.exists(c, lambda x: reduce(lambda a, b: a & b, [x[k] == v if not isinstance(v, dict) else reduce(lambda a, b: a & b, [tests[o](x[k], w) for o, w in v.items()]) for k, v in value.items()]))
        return F.exists(c, lambda x: reduce(lambda a, b: a & b, [tests[o](x, v) for o, v in value.items()]))
    if op == "$mod":
        d, r = (int(v) for v in value)
        rest = c.cast("bigint") % F.lit(d)  # of the dividend's sign; the dialect's is of the divisor's
        return F.when((rest != 0) & ((rest < 0) != F.lit(d < 0)), rest + d).otherwise(rest) == r if isinstance(kind, NUMBERS) else F.lit(False)
    raise DialectError(op)


def field(schema: T.StructType, path: str, value) -> Column:
    if isinstance(value, dict) and any(str(k).startswith("$") for k in value):
        return reduce(lambda a, b: a & b, [F.coalesce(operator(schema, path, op, v, value), F.lit(False)) for op, v in value.items()])
    kind = kind_of(schema, path)
    return F.coalesce(_equal(F.col(path) if kind is not None else None, kind, value), F.lit(False))


def named(schema: T.StructType, path: str, key: str = "id") -> str:
    """A path, with _id as the key's other name."""
    return key if path == "_id" and "_id" not in schema.names else path


def match(schema: T.StructType, query: dict) -> Column:
    """The filter of a query document."""
    found = F.lit(True)
    for k, v in query.items():
        if k in ("$and", "$or", "$nor"):
            parts = [match(schema, q) for q in v]
            whole = reduce(lambda a, b: a & b, parts) if k == "$and" else reduce(lambda a, b: a | b, parts)
            found = found & (~whole if k == "$nor" else whole)
        elif k == "$not":
            found = found & ~match(schema, v)
        elif k.startswith("$"):
            raise DialectError(k)
        else:
            found = found & field(schema, named(schema, k), v)
    return found


def project(docs: DataFrame, projection: dict, key: str = "id") -> DataFrame:
    asked = {key if k == "_id" else k: bool(v) for k, v in projection.items()}
    modes = {v for k, v in asked.items() if k != key} or set(asked.values())
    if len(modes) > 1:
        raise DialectError("a projection includes or excludes, not both")
    if modes == {True}:
        return docs.select(*[c for c in docs.columns if asked.get(c) or (c == key and asked.get(key, True))])
    return docs.drop(*[k for k, v in asked.items() if not v])


def sort_columns(sort: list[tuple[str, int]], key: str) -> list[Column]:
    """Missing is least: first ascending, last descending; ties by key."""
    sort = [(key if f == "_id" and key else f, d) for f, d in sort]
    return [F.col(f).asc_nulls_first() if d > 0 else F.col(f).desc_nulls_last() for f, d in sort] + ([F.col(key)] if key else [])


def find(docs: DataFrame, query: dict | None = None, projection: dict | None = None, sort=None, skip: int = 0, limit: int | None = None, key: str = "id") -> DataFrame:
    out = docs.where(match(docs.schema, query or {}))
    if sort or skip or limit is not None:
        out = out.orderBy(*sort_columns(sort or [], key))
        out = out.offset(skip) if skip else out
        out = out.limit(limit) if limit is not None else out
    return project(out, projection, key) if projection else out


def distinct(docs: DataFrame, path: str, query: dict | None = None) -> DataFrame:
    docs, path = docs.where(match(docs.schema, query or {})), named(docs.schema, path)
    c = F.explode(path) if isinstance(kind_of(docs.schema, path), T.ArrayType) else F.col(path)
    return docs.select(c.alias("value")).distinct()


def _value(schema: T.StructType, spec) -> tuple[Column, T.DataType | None]:
    if isinstance(spec, str) and spec.startswith("$"):
        path = named(schema, spec[1:])
        kind = kind_of(schema, path)
        return (F.col(path) if kind is not None else F.lit(None)), kind
    return F.lit(spec), None


def accumulator(schema: T.StructType, op: str, spec, order: Column) -> Column:
    c, kind = _value(schema, spec)
    number = c if kind is None or isinstance(kind, NUMBERS) else F.lit(None).cast("double")
    if op == "$sum":
        return F.coalesce(F.sum(number), F.lit(0))
    if op in ("$avg", "$min", "$max"):
        return {"$avg": F.avg, "$min": F.min, "$max": F.max}[op](number)
    if op in ("$first", "$last"):
        pick = (F.min_by if op == "$first" else F.max_by)(F.struct(c.alias("v")), order)  # a struct: null values count
        return pick["v"]
    if op == "$push":
        return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), c.alias("v")))), lambda x: x["v"])
    if op == "$addToSet":
        return F.array_sort(F.collect_set(c))
    raise DialectError(op)


def group_key(schema: T.StructType, key) -> Column:
    """null (one group), a constant, "$path", or a composite of paths."""
    if isinstance(key, dict):
        return F.struct(*[_value(schema, v)[0].alias(k) for k, v in key.items()])
    return _value(schema, key)[0] if key is not None else F.lit(None).cast("string")


def group(docs: DataFrame, spec: dict, order: Column) -> DataFrame:
    by = group_key(docs.schema, spec["_id"])
    made = [accumulator(docs.schema, *next(iter(v.items())), order).alias(k) for k, v in spec.items() if k != "_id"]
    return docs.groupBy(by.alias("_id")).agg(*made)


def aggregate(docs: DataFrame, pipeline: list[dict], key: str = "id") -> DataFrame:
    """Stages in order.  Order-dependent accumulators follow the last $sort before them, else the key."""
    sort: list[tuple[str, int]] = []
    for stage in pipeline:
        (name, spec), *more = stage.items()
        if more:
            raise DialectError("a stage has one operator")
        if name == "$match":
            docs = docs.where(match(docs.schema, spec))
        elif name == "$sort":
            sort = list(spec.items())
            docs = docs.orderBy(*sort_columns(sort, key if key in docs.columns else ""))
        elif name == "$skip":
            docs = docs.offset(spec)
        elif name == "$limit":
            docs = docs.limit(spec)
        elif name == "$project":
            docs = project(docs, spec, "_id" if "_id" in docs.columns else key)
        elif name == "$count":
            docs = docs.agg(F.count("*").alias(spec))
        elif name == "$unwind":
            path = (spec if isinstance(spec, str) else spec["path"])[1:]
            docs = docs.withColumn(path, F.explode(path))
        elif name == "$group":
            ordered = any(op in ("$first", "$last", "$push") for k, v in spec.items() if k != "_id" for op in v)
            if ordered and all(d > 0 for _, d in sort):
                order = F.struct(*[F.col(f) for f, _ in sort], F.col(key))
            elif ordered:
                # a struct has no descending parts: rows are numbered within their group
                by = group_key(docs.schema, spec["_id"])
                docs = docs.withColumn("__place", F.row_number().over(Window.partitionBy(by).orderBy(*sort_columns(sort, key))))
                order = F.col("__place")
            else:
                order = F.lit(0)
            docs, sort, key = group(docs, spec, order), [], "_id"
        else:
            raise DialectError(name)
    return docs


def at_path(column: Column, kind: T.DataType | None, parts: list[str]) -> tuple[Column | None, T.DataType | None]:
    for part in parts:
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return None, None
        column, kind = column.getField(part), kind[part].dataType
    return column, kind


def with_path(column: Column | None, kind: T.DataType | None, parts: list[str], new: Column) -> Column:
    """A column with a value at a path within it; parents that aren't there, or aren't objects, are made."""
    if not parts:
        return new
    names = kind.names if isinstance(kind, T.StructType) else []
    fields = [(with_path(column.getField(n), kind[n].dataType, parts[1:], new) if n == parts[0] else column.getField(n)).alias(n) for n in names]
    if parts[0] not in names:
        fields.append(with_path(None, None, parts[1:], new).alias(parts[0]))
    return F.struct(*fields)


def update(docs: DataFrame, query: dict, change: dict, key: str = "id") -> DataFrame:
    """The new versions of the matched documents that a change alters, by one projection: nothing is shuffled.

    Dotted paths reach into objects.  A field that $unset takes away is null in the result, nested, and no column of it, at the top.
    """
    hit = docs.where(match(docs.schema, query))
    operators = [k for k in change if k.startswith("$")]
    if operators and len(operators) < len(change):
        raise DialectError("a change has operators, or is a document, not both")
    if not operators:
        return replace(docs, query, change, key)
    own = {f.name: (F.col(f"`{f.name}`"), f.dataType) for f in docs.schema}
    made: dict[str, tuple[Column, T.DataType | None]] = dict(own)

    def kind(column: Column) -> T.DataType:
        return hit.select(column.alias("x")).schema["x"].dataType

    def put(path: str, new: Column) -> None:
        top, *rest = path.split(".")
        column, held = made.get(top, (None, None))
        new = with_path(column, held, rest, new)
        made[top] = (new, kind(new))

    for op, fields in change.items():
        for path, v in fields.items():
            top, *rest = path.split(".")
            if top in (key, "_id"):
                raise DialectError("the id doesn't change")
            old, held = at_path(*made[top], rest) if top in made else (None, None)
            old = old if old is not None else F.lit(None)
            number = F.coalesce(old, F.lit(0)) if isinstance(held, NUMBERS) else F.lit(0)
            items = F.array(*map(F.lit, v["$each"] if isinstance(v, dict) and "$each" in v else [v])) if not isinstance(v, dict) or "$each" in v else None
            array = old if isinstance(held, T.ArrayType) else F.lit(None)
            if op == "$set":
                put(path, F.lit(v))
            elif op == "$setOnInsert":
                pass
            elif op == "$unset":
                if not rest:
                    made.pop(top, None)
                elif held is not None:
                    parent, shape = made[top]
                    made[top] = (F.when(parent.isNotNull(), with_path(parent, shape, rest, F.lit(None).cast(held))), shape)
            elif op in ("$inc", "$mul"):
                put(path, number + v if op == "$inc" else number * v)
            elif op in ("$min", "$max"):
                put(path, (F.least if op == "$min" else F.greatest)(old, F.lit(v)))
            elif op == "$rename":
                if held is not None:
                    if not rest:
                        made.pop(top)
                    else:
                        parent, shape = made[top]
                        made[top] = (F.when(parent.isNotNull(), with_path(parent, shape, rest, F.lit(None).cast(held))), shape)
                    put(v, old)
            elif op == "$push":
                put(path, F.concat(F.coalesce(array, F.array()), items))
            elif op == "$addToSet":
                put(path, F.concat(F.coalesce(array, F.array()), F.array_except(items, F.coalesce(array, F.array()))))
            elif op == "$pull":
                if isinstance(held, T.ArrayType):
                    put(path, F.filter(old, lambda x: ~F.coalesce(pulled(x, v), F.lit(False))))
            elif op == "$pop":
                if isinstance(held, T.ArrayType):
                    n = F.greatest(F.size(old) - 1, F.lit(0))
                    put(path, F.slice(old, 1, n) if v > 0 else F.slice(old, 2, n))
            else:
                raise DialectError(op)

    def changed(name: str) -> Column:
        if name not in made:
            return own[name][0].isNotNull()
        if name not in own:
            return made[name][0].isNotNull()
        (a, x), (b, y) = own[name], made[name]
        same = y is not None and x.simpleString() == y.simpleString()  # whether nulls are allowed doesn't matter
        return ~a.eqNullSafe(b) if same or isinstance(x, NUMBERS) and isinstance(y, NUMBERS) else F.lit(True)

    touched = [n for n in {**own, **made} if own.get(n) is not made.get(n)]
    out = hit.where(reduce(lambda a, b: a | b, map(changed, touched), F.lit(False)))
    return out.select(*[c.alias(n) for n, (c, _) in made.items()])


def pulled(x: Column, v) -> Column:
    """Whether an element goes: it equals a value, or meets all operators."""
    if not isinstance(v, dict):
        return x == v
    tests = {"$gt": lambda w: x > w, "$gte": lambda w: x >= w, "$lt": lambda w: x < w, "$lte": lambda w: x <= w, "$eq": lambda w: x == w, "$ne": lambda w: x != w, "$in": lambda w: x.isin(w), "$nin": lambda w: ~x.isin(w)}
    if set(v) - set(tests):
        raise DialectError(str(sorted(set(v) - set(tests))))
    return reduce(lambda a, b: a & b, [tests[o](w) for o, w in v.items()])


def replace(docs: DataFrame, query: dict, doc: dict, key: str = "id") -> DataFrame:
    """The matched documents with other fields in place of all of theirs."""
    if any(k.startswith("$") for k in doc):
        raise DialectError("a replacement has no operators")
    return docs.where(match(docs.schema, query)).select(key, *[F.lit(v).alias(k) for k, v in doc.items() if k not in (key, "_id")])


def upsert(docs: DataFrame, query: dict, change: dict, new_id, key: str = "id") -> DataFrame:
    """update(), or where nothing matches one new document from the query's equalities and the change."""
    changed = update(docs, query, change, key)
    seed = {k: v for k, v in query.items() if not k.startswith("$") and not isinstance(v, dict)} | change.get("$set", {}) | change.get("$setOnInsert", {}) | {k: v for k, v in change.get("$inc", {}).items()}
    seed[key] = seed.get(key, new_id)
    kinds = {f.name: f.dataType for f in docs.schema}
    one = docs.sparkSession.range(1).select(*[F.lit(seed.get(c)).cast(kinds[c]).alias(c) for c in docs.columns])
    none = docs.where(match(docs.schema, query)).limit(1).agg(F.count("*").alias("__n")).where("__n = 0")
    return changed.unionByName(one.join(F.broadcast(none.drop("__n").withColumn("__x", F.lit(1))), F.lit(True), "left_semi"), allowMissingColumns=True)
