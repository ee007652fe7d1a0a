"""Every registered query of the document engine, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import values
from palimpsest.operators import documents, files, graph, integrity, keyvalue, resolve, writes
from palimpsest.plans.lower import Store
from palimpsest.plans.plan import Query
from palimpsest.sources import log
from palimpsest.streaming import feed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def sessions(spark, d) -> DataFrame:
    """A log of versions: users' states by event, deleted on an error."""
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"), F.col("user_id").alias("id"), "event_type", "value")


def keyed(df: DataFrame, key: str) -> DataFrame:
    return df.withColumns({"seq": F.col(key), "op": F.lit("put")}).withColumnRenamed(key, "id")


def policies(spark, d) -> DataFrame:
    nxt = F.lead("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    o = table(spark, d, "orders").withColumn("n", nxt)
    return o.select(F.col("o_orderkey").alias("seq"), F.lit("put").alias("op"), F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("valid_from"), F.date_format("n", "yyyy-MM-dd").alias("valid_to"), "o_totalprice")


def churn(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "unlink").otherwise("link").alias("op"), F.col("user_id").alias("frm"), F.lit("near").alias("rel"), (k % 5).alias("to"))


def turns(spark, d) -> DataFrame:
    """A causal log: each turn is caused by the one before in its conversation.  Numbers are unique without a global sort."""
    c = table(spark, d, "conversations")
    seq = F.col("conv_id") * 1000 + F.col("turn")
    before = F.lag(seq).over(Window.partitionBy("conv_id").orderBy("turn"))
    cause = F.when(before.isNull(), F.array().cast("array<bigint>")).otherwise(F.array(before))
    return c.select(seq.alias("seq"), F.lit("put").alias("op"), seq.alias("id"), cause.alias("caused_by"), "conv_id", "turn", "role")


def places(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("frm"), F.lit("places").alias("rel"), F.col("o_orderkey").alias("to"), F.col("o_orderkey").alias("added_seq"), F.lit(None).cast("long").alias("removed_seq"))


class Tables(dict):
    """Collections by name, each opened when it is asked for: opening a table reads its files' footers."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]):
        super().__init__()
        self.makers = makers

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.makers[name]()
        return self[name]


def store(spark, d) -> Store:
    makers = {"sessions": lambda: sessions(spark, d), "policies": lambda: policies(spark, d)}
    for name, key in (("customer", "c_custkey"), ("orders", "o_orderkey"), ("part", "p_partkey"), ("documents", "doc_id")):
        makers[name] = lambda name=name, key=key: keyed(table(spark, d, name), key)
    current = frozenset(makers) - {"sessions"}  # tables of one row a key
    return Store(Tables(makers), lambda: places(spark, d), {"places": "orders"}, {"part": ["p_name", "p_type"]}, current)


HEAD = "SELECT user_id AS id, event_id AS seq, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events {where}) WHERE n = 1 AND event_type <> 'error'"
OUT = ("id", "seq", "event_type", "value")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir).query("FROM sessions WHERE value >= 50 ORDER BY value DESC LIMIT 10")


@query(HEAD.format(where=""))
def head_scan(s, d):
    return resolve.head(sessions(s, d)).select(*OUT)


@query(HEAD.format(where="WHERE event_id <= 5000"))
def as_of_scan(s, d):
    return store(s, d).query("FROM sessions AS OF 5000").select(*OUT)


@query(f"SELECT id FROM ({HEAD.format(where='WHERE event_id <= (SELECT max(event_id) // 2 FROM events)')}) WHERE id NOT IN (SELECT id FROM ({HEAD.format(where='')}))")
def as_of_deleted_visible(s, d):
    v = sessions(s, d)
    mid = v.agg(F.floor(F.max("seq") / 2)).first()[0]
    return resolve.as_of(v, mid).join(resolve.head(v), "id", "left_anti").select("id")


@query(HEAD.format(where="WHERE user_id = 7"))
def point_lookup(s, d):
    return resolve.get(sessions(s, d), 7).select(*OUT)


@query("SELECT user_id AS id, event_id AS seq, lag(event_id) OVER w AS prev_seq, lead(event_id) OVER w AS next_seq FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def version_history(s, d):
    return resolve.history(sessions(s, d)).select("id", "seq", "prev_seq", "next_seq")


@query("SELECT user_id AS id, event_id AS seq, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS diff FROM events")
def version_diff(s, d):
    w = Window.partitionBy("id").orderBy("seq")
    return sessions(s, d).select("id", "seq", F.round(F.col("value") - F.lag("value").over(w), 6).alias("diff"))


@query("SELECT max(event_id) AS seq, arg_max(user_id, event_id) AS id FROM events")
def tip_global(s, d):
    return resolve.tip(sessions(s, d)).select("seq", "id")


@query("SELECT event_type, max(event_id) AS seq, arg_max(user_id, event_id) AS id FROM events GROUP BY 1")
def tip_per_collection(s, d):
    return resolve.tip(sessions(s, d).select("event_type", "seq", "id"), "event_type")


@query("SELECT event_id AS seq, user_id AS id FROM events ORDER BY event_id DESC LIMIT 20")
def log_tail(s, d):
    return resolve.log(sessions(s, d), 20).select("seq", "id")


@query("SELECT 'sessions-' || (user_id % 3)::VARCHAR AS coll, count(*) AS n FROM (" + HEAD.format(where="").replace("user_id AS id", "user_id") + ") GROUP BY 1")
def collection_counts(s, d):
    v = sessions(s, d)
    return resolve.counts(v.withColumn("coll", F.concat(F.lit("sessions-"), (F.col("id") % 3).cast("string"))))


VALID = "SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS valid_from, strftime(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), '%Y-%m-%d') AS valid_to FROM orders"


@query(f"SELECT * FROM ({VALID}) WHERE valid_from <= '1996-06-15' AND (valid_to IS NULL OR valid_to >= '1996-06-15')")
def valid_as_of(s, d):
    return store(s, d).query("FROM policies VALID AS OF '1996-06-15'").select("id", "valid_from", "valid_to")


@query(f"SELECT * FROM ({VALID}) WHERE id <= 900 AND valid_from <= '1996-06-15' AND (valid_to IS NULL OR valid_to >= '1996-06-15')")
def bitemporal(s, d):
    return store(s, d).query("FROM policies AS OF 900 VALID AS OF '1996-06-15'").select("id", "valid_from", "valid_to")


@query("SELECT p.at_seq, p.user_id AS id, arg_max(e.event_id, e.event_id) AS seq FROM (SELECT DISTINCT user_id, event_id + 3 AS at_seq FROM events WHERE event_type = 'purchase') p JOIN events e ON e.user_id = p.user_id AND e.event_id <= p.at_seq GROUP BY ALL HAVING arg_max(e.event_type, e.event_id) <> 'error'")
def as_of_each(s, d):
    v = sessions(s, d)
    probes = v.where("event_type = 'purchase'").select("id", (F.col("seq") + 3).alias("at_seq"))
    return resolve.as_of_each(v, probes).select("id", "at_seq", "seq")


def _customers(where: str) -> str:
    return f"SELECT c_custkey AS id, c_mktsegment, c_acctbal FROM customer WHERE {where}"


@query(_customers("c_mktsegment = 'BUILDING'"))
def where_eq(s, d):
    return store(s, d).query("FROM customer WHERE c_mktsegment = 'BUILDING'").select("id", "c_mktsegment", "c_acctbal")


@query(_customers("c_mktsegment IS DISTINCT FROM 'BUILDING'"))
def where_ne(s, d):
    return store(s, d).query("FROM customer WHERE c_mktsegment != 'BUILDING'").select("id", "c_mktsegment", "c_acctbal")


@query(_customers("c_acctbal >= 100 AND c_acctbal < 5000 AND c_nationkey = 7"))
def where_and(s, d):
    return store(s, d).query("FROM customer WHERE c_acctbal >= 100 AND c_acctbal < 5000 AND c_nationkey = 7").select("id", "c_mktsegment", "c_acctbal")


@query("SELECT c_custkey AS id FROM customer WHERE false")
def where_cross_type(s, d):
    return store(s, d).query("FROM customer WHERE c_mktsegment > 3").select("id")


@query("SELECT doc_id AS id FROM documents WHERE contains(lower(concat_ws(' ', doc_id, text, lang, source, n_chars)), 'licensed') AND contains(lower(concat_ws(' ', doc_id, text, lang, source, n_chars)), 'under')")
def search_scan(s, d):
    return store(s, d).query("FROM documents SEARCH 'Licensed under'").select("id")


@query("SELECT p_partkey AS id FROM part WHERE list_contains(list_concat(regexp_extract_all(lower(p_name), '[a-z0-9]+'), regexp_extract_all(lower(p_type), '[a-z0-9]+')), 'promo') AND list_contains(regexp_extract_all(lower(p_name), '[a-z0-9]+'), 'widget')")
def search_tokens(s, d):
    return store(s, d).query("FROM part SEARCH 'Widget promo'").select("id")


@query("SELECT c_custkey AS id, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
def order_limit(s, d):
    return Query("customer").order_by("c_acctbal", desc=True).limit(25).run(store(s, d)).select("id", "c_acctbal")


@query(f"SELECT id, value FROM ({HEAD.format(where='')}) WHERE value >= 50 ORDER BY value DESC, id LIMIT 10")
def topk(s, d):
    return flagship(s, d).select("id", "value")


@query("SELECT c_mktsegment, count(*) AS count FROM customer GROUP BY 1")
def group_count(s, d):
    return store(s, d).query("FROM customer GROUP BY c_mktsegment COUNT")


for _f in ("sum", "avg", "min", "max"):

    def _grouped(s, d, f=_f):
        out = store(s, d).query(f"FROM orders GROUP BY o_orderstatus {f.upper()} o_totalprice")
        return out.select("o_orderstatus", "count", F.round(f"{f}_o_totalprice", 2).alias(f"{f}_o_totalprice"))

    QUERIES[f"group_{_f}"] = _grouped
    SQL[f"group_{_f}"] = f"SELECT o_orderstatus, count(*) AS count, round({_f}(o_totalprice), 2) AS {_f}_o_totalprice FROM orders GROUP BY 1"


@query("SELECT c_mktsegment, count(*) AS count FROM (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50) GROUP BY 1")
def group_after_limit(s, d):
    return store(s, d).query("FROM customer ORDER BY c_acctbal DESC LIMIT 50 GROUP BY c_mktsegment")


EDGES = """WITH ev AS (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'unlink' ELSE 'link' END AS op, user_id AS frm, 'near' AS rel, (props->>'$.k')::BIGINT % 5 AS "to" FROM events),
b AS (SELECT *, coalesce(lag(op) OVER (PARTITION BY frm, rel, "to" ORDER BY seq), 'unlink') AS p FROM ev),
k AS (SELECT *, lead(seq) OVER (PARTITION BY frm, rel, "to" ORDER BY seq) AS removed_seq FROM b WHERE op <> p),
edges AS (SELECT frm, rel, "to", seq AS added_seq, removed_seq FROM k WHERE op = 'link') """


@query(EDGES + "SELECT * FROM edges")
def link_intervals(s, d):
    return graph.intervals(churn(s, d))


@query(EDGES + 'SELECT "to" FROM edges WHERE frm = 7 AND removed_seq IS NULL')
def neighbors(s, d):
    return graph.neighbors(graph.intervals(churn(s, d)), 7, "near")


@query(EDGES + 'SELECT "to" FROM edges WHERE frm = 7 AND added_seq <= 3000 AND (removed_seq IS NULL OR removed_seq > 3000)')
def neighbors_as_of(s, d):
    return graph.neighbors(graph.intervals(churn(s, d)), 7, "near", 3000)


@query(EDGES + 'SELECT frm FROM edges WHERE "to" = 2 AND removed_seq IS NULL')
def inbound(s, d):
    return graph.inbound(graph.intervals(churn(s, d)), 2, "near")


@query(EDGES + """SELECT DISTINCT 'users-' || (frm % 2)::VARCHAR AS from_coll, rel, 'buckets' AS to_coll FROM edges WHERE removed_seq IS NULL""")
def relation_schema(s, d):
    return graph.relation_schema(graph.intervals(churn(s, d)), F.concat(F.lit("users-"), (F.col("frm") % 2).cast("string")), F.lit("buckets"))


@query("SELECT o_orderkey AS id, o_orderstatus FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def traverse_one_hop(s, d):
    return store(s, d).query("FROM customer WHERE c_mktsegment = 'BUILDING' TRAVERSE places").select("id", "o_orderstatus")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey <= 700 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey <= 700 AND c_mktsegment = 'BUILDING')")
def traverse_as_of(s, d):
    return store(s, d).query("FROM customer AS OF 700 WHERE c_mktsegment = 'BUILDING' TRAVERSE places").select("id")


@query("SELECT s_suppkey AS id FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')")
def traverse_two_hop(s, d):
    n, sup = table(s, d, "nation"), table(s, d, "supplier")
    edge = lambda f, t, r, df: df.select(F.col(f).alias("frm"), F.lit(r).alias("rel"), F.col(t).alias("to"), F.lit(0).alias("added_seq"), F.lit(None).cast("long").alias("removed_seq"))
    start = table(s, d, "region").where("r_name = 'ASIA'").withColumnRenamed("r_regionkey", "id")
    nations = graph.traverse(start, edge("n_regionkey", "n_nationkey", "has", n), n.withColumnRenamed("n_nationkey", "id"), "has")
    return graph.traverse(nations, edge("s_nationkey", "s_suppkey", "holds", sup), sup.withColumnRenamed("s_suppkey", "id"), "holds").select("id")


TURNS = "WITH RECURSIVE t AS (SELECT conv_id, turn, conv_id * 1000 + turn AS seq, lag(conv_id * 1000 + turn) OVER (PARTITION BY conv_id ORDER BY turn) AS cause FROM conversations), "


@query(TURNS + "r AS (SELECT cause AS seq FROM t WHERE turn = 4 AND cause IS NOT NULL UNION SELECT t.cause FROM r JOIN t ON t.seq = r.seq WHERE t.cause IS NOT NULL) SELECT t.seq, t.conv_id FROM r JOIN t ON t.seq = r.seq")
def trace_backward(s, d):
    ops = turns(s, d)
    return graph.trace(ops, ops.where("turn = 4").select("seq")).select("seq", "conv_id")


@query(TURNS + "r AS (SELECT x.seq FROM t JOIN t x ON x.cause = t.seq WHERE t.turn = 1 UNION SELECT t.seq FROM r JOIN t ON t.cause = r.seq) SELECT t.seq, t.conv_id FROM r JOIN t ON t.seq = r.seq")
def trace_forward(s, d):
    ops = turns(s, d)
    return graph.trace(ops, ops.where("turn = 1").select("seq"), reverse=True).select("seq", "conv_id")


def _orders(s, d) -> DataFrame:
    return table(s, d, "orders").withColumnRenamed("o_orderkey", "id")


MATCHES = {
    "mongo_match_ops": ({"o_totalprice": {"$gte": 1000, "$lt": 200000}, "o_orderstatus": {"$ne": "F"}}, "o_totalprice >= 1000 AND o_totalprice < 200000 AND o_orderstatus <> 'F'"),
    "mongo_or_nor": ({"$or": [{"o_orderstatus": "F"}, {"o_totalprice": {"$gt": 300000}}], "$nor": [{"o_orderpriority": "1-URGENT"}]}, "(o_orderstatus = 'F' OR o_totalprice > 300000) AND NOT o_orderpriority = '1-URGENT'"),
    "mongo_in": ({"o_orderstatus": {"$in": ["F", "P"]}, "o_orderpriority": {"$nin": ["2-HIGH"]}}, "o_orderstatus IN ('F', 'P') AND o_orderpriority NOT IN ('2-HIGH')"),
    "mongo_regex": ({"o_orderpriority": {"$regex": "^[12]-.*h$", "$options": "i"}}, "regexp_matches(o_orderpriority, '(?i)^[12]-.*h$')"),
    "mongo_mod": ({"o_custkey": {"$mod": [7, 3]}}, "o_custkey % 7 = 3"),
    "mongo_exists_not": ({"o_orderstatus": {"$exists": True, "$not": {"$eq": "O"}}, "nowhere": {"$exists": False}}, "o_orderstatus <> 'O'"),
}
for _name, (_q, _sql) in MATCHES.items():
    QUERIES[_name] = lambda s, d, q=_q: documents.find(_orders(s, d), q).select("id")
    SQL[_name] = f"SELECT o_orderkey AS id FROM orders WHERE {_sql}"


def _tagged(s, d) -> DataFrame:
    e = table(s, d, "events")
    return e.select(F.col("event_id").alias("id"), F.array("event_type", F.concat(F.lit("u"), (F.col("user_id") % 4).cast("string"))).alias("tags"), F.struct(F.get_json_object("props", "$.k").cast("long").alias("k")).alias("props"))


@query("SELECT event_id AS id FROM events WHERE event_type = 'click' AND user_id % 4 = 1")
def mongo_array(s, d):
    return documents.find(_tagged(s, d), {"tags": {"$all": ["click", "u1"], "$size": 2}, "$and": [{"tags": "click"}]}).select("id")


@query("SELECT event_id AS id FROM events WHERE (props->>'$.k')::BIGINT >= 50")
def mongo_path(s, d):
    return documents.find(_tagged(s, d), {"props.k": {"$gte": 50}}).select("id")


@query("SELECT DISTINCT unnest([event_type, 'u' || (user_id % 4)::VARCHAR]) AS value FROM events")
def mongo_distinct(s, d):
    return documents.distinct(_tagged(s, d), "tags")


@query("SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 2) AS mean FROM orders WHERE o_totalprice > 500 GROUP BY 1")
def mongo_group_multi(s, d):
    out = documents.aggregate(_orders(s, d), [{"$match": {"o_totalprice": {"$gt": 500}}}, {"$group": {"_id": "$o_orderstatus", "n": {"$sum": 1}, "total": {"$sum": "$o_totalprice"}, "mean": {"$avg": "$o_totalprice"}}}])
    return out.select(F.col("_id").alias("status"), F.col("n").cast("long").alias("n"), F.round("total", 2).alias("total"), F.round("mean", 2).alias("mean"))


@query("SELECT o_custkey AS cust, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY 1")
def mongo_first_last(s, d):
    out = documents.aggregate(_orders(s, d), [{"$sort": {"o_orderdate": 1}}, {"$group": {"_id": "$o_custkey", "first_order": {"$first": "$id"}, "last_order": {"$last": "$id"}}}])
    return out.select(F.col("_id").alias("cust"), "first_order", "last_order")


@query("SELECT o_custkey AS cust, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS pushed, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS states FROM orders GROUP BY 1")
def mongo_push_set(s, d):
    out = documents.aggregate(_orders(s, d), [{"$group": {"_id": "$o_custkey", "p": {"$push": "$id"}, "t": {"$addToSet": "$o_orderstatus"}}}])
    return out.select(F.col("_id").alias("cust"), F.array_join(F.col("p").cast("array<string>"), ",").alias("pushed"), F.array_join("t", ",").alias("states"))


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def mongo_count(s, d):
    return documents.aggregate(_orders(s, d), [{"$match": {"o_orderstatus": "F"}}, {"$count": "n"}])


@query("SELECT o_orderkey AS id, o_totalprice FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey LIMIT 15 OFFSET 10")
def mongo_sort_skip_limit(s, d):
    return documents.find(_orders(s, d), {}, {"o_totalprice": 1}, [("o_orderstatus", 1), ("o_totalprice", -1)], 10, 15)


@query("SELECT o_orderkey AS id, o_orderdate::VARCHAR AS day FROM orders")
def mongo_project(s, d):
    out = documents.find(_orders(s, d), {}, {"o_custkey": 0, "o_orderstatus": 0, "o_totalprice": 0, "o_orderpriority": 0})
    return out.select("id", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("day"))


@query("SELECT o_orderkey AS id, o_custkey + 5 AS o_custkey, 'late' AS o_orderstatus FROM orders WHERE o_orderpriority = '5-LOW'")
def mongo_update(s, d):
    return documents.update(_orders(s, d), {"o_orderpriority": "5-LOW"}, {"$inc": {"o_custkey": 5}, "$set": {"o_orderstatus": "late"}}).select("id", "o_custkey", "o_orderstatus")


@query("SELECT -1::BIGINT AS id, 'X' AS o_orderstatus, 3::BIGINT AS o_custkey")
def mongo_upsert(s, d):
    return documents.upsert(_orders(s, d), {"o_orderstatus": "X"}, {"$set": {"o_custkey": 3}}, -1).select("id", "o_orderstatus", "o_custkey")


@query("SELECT c_name, c_acctbal FROM customer WHERE c_nationkey = 3 AND c_acctbal > 0 ORDER BY c_acctbal, c_custkey LIMIT 20")
def sql_select(s, d):
    return store(s, d).sql("SELECT c_name, c_acctbal FROM customer WHERE c_nationkey = 3 AND c_acctbal > 0 ORDER BY c_acctbal LIMIT 20")


@query("SELECT p_partkey AS id FROM part WHERE p_type LIKE '%ONOM%'")
def sql_like(s, d):
    return store(s, d).sql("SELECT id FROM part WHERE p_type LIKE '%ONOM%'")


@query(f"SELECT id FROM ({VALID}) WHERE valid_to IS NULL")
def sql_is_null(s, d):
    return store(s, d).sql("SELECT id FROM policies WHERE valid_to IS NULL")


def _deltas(s, d) -> DataFrame:
    return table(s, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("id"), F.when(F.col("event_type") != "error", F.get_json_object("props", "$.k").cast("long")).alias("delta"))


@query("WITH r AS (SELECT user_id, max(event_id) AS m FROM events WHERE event_type = 'error' GROUP BY 1) SELECT e.user_id AS id, sum((props->>'$.k')::BIGINT)::BIGINT AS value FROM events e LEFT JOIN r ON e.user_id = r.user_id WHERE r.m IS NULL OR e.event_id > r.m GROUP BY 1")
def kv_counter(s, d):
    return keyvalue.counters(_deltas(s, d))


@query("SELECT coll, id, value FROM (SELECT user_id AS coll, event_type AS id, value, event_type AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND t <> 'error'")
def kv_hgetall(s, d):
    v = sessions(s, d)
    return keyvalue.hashes(v.select("seq", "op", F.col("id").alias("coll"), F.col("event_type").alias("id"), "value"))


@query("SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'click' THEN -event_id - 1 ELSE event_id END) - 1 AS pos, event_id AS value FROM events")
def kv_lrange(s, d):
    v = sessions(s, d)
    return keyvalue.lists(v.select("id", F.when(F.col("event_type") == "click", "L").otherwise("R").alias("side"), "seq", F.col("seq").alias("value")))


@query("SELECT user_id AS id FROM (" + HEAD.format(where="").replace("user_id AS id", "user_id") + ") WHERE regexp_matches(user_id::VARCHAR, '^1.*$')")
def kv_keys(s, d):
    return keyvalue.keys(keyvalue.strings(sessions(s, d)), "1*")


for _op, _sql in (("union", "UNION"), ("inter", "INTERSECT"), ("diff", "EXCEPT")):

    def _sets(s, d, op=_op):
        e = churn(s, d)
        by = lambda k: graph.live(graph.intervals(e)).where(F.col("to") == k).select(F.col("frm").alias("member"))
        return getattr(keyvalue, op)(by(1), by(2))

    QUERIES[f"set_{_op}"] = _sets
    SQL[f"set_{_op}"] = EDGES + f'SELECT frm AS member FROM edges WHERE "to" = 1 AND removed_seq IS NULL {_sql} SELECT frm FROM edges WHERE "to" = 2 AND removed_seq IS NULL'


def _arrivals(s, d) -> DataFrame:
    e = table(s, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(F.col("event_id").alias("arrival"), F.col("user_id").alias("client"), (F.col("event_id") - (k % 7) * 40).alias("nonce"), F.when(k % 3 == 0, F.concat_ws("-", "user_id", k)).alias("idem"))


ARRIVALS = "WITH a AS (SELECT event_id AS arrival, user_id AS client, event_id - ((props->>'$.k')::BIGINT % 7) * 40 AS nonce, CASE WHEN (props->>'$.k')::BIGINT % 3 = 0 THEN user_id::VARCHAR || '-' || (props->>'$.k') END AS idem FROM events) "


@query(ARRIVALS + "SELECT arrival FROM (SELECT *, row_number() OVER (PARTITION BY idem ORDER BY arrival) AS n FROM a) WHERE idem IS NULL OR n = 1")
def idem_dedup(s, d):
    return writes.first_per_idem(_arrivals(s, d)).select("arrival")


@query(ARRIVALS + "SELECT arrival FROM (SELECT *, max(nonce) OVER (PARTITION BY client ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM a) WHERE nonce <= greatest(coalesce(m, 0), 0)")
def nonce_violations(s, d):
    return writes.nonce_violations(_arrivals(s, d)).select("arrival")


@query("SELECT o_orderkey AS id, 100 + row_number() OVER (ORDER BY o_orderkey) - 1 AS seq FROM orders")
def assign_seq(s, d):
    return writes.assign_seq(_orders(s, d), 100, "id").select("id", "seq")


@query("SELECT event_id AS seq, user_id AS id FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 100")
def since_page(s, d):
    return feed.since(sessions(s, d), 500, 100).select("seq", "id")


@query("SELECT min(event_id) AS first_seq, max(event_id) AS tip_seq, count(*) AS n, true AS scan_complete FROM events")
def scan_status(s, d):
    return feed.scan_status(sessions(s, d))


@query("SELECT event_id AS id FROM events WHERE event_id + 100 * (user_id % 5) >= 400")
def ttl_live(s, d):
    e = table(s, d, "events").select(F.col("event_id").alias("id"), (F.col("event_id") + 100 * (F.col("user_id") % 5)).alias("expires_at"))
    return writes.unexpired(e, 400).select("id")


@query(HEAD.format(where=""))
def snapshot_plus_delta(s, d):
    v = sessions(s, d)
    return writes.snapshot_plus_delta(resolve.as_of(v, 400), 400, v).select(*OUT)


@query("SELECT count(*) AS before, count(*) FILTER (n = 1 AND event_type <> 'error') AS after, count(*) FILTER (NOT (n = 1 AND event_type <> 'error')) AS dropped FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events)")
def compaction_stats(s, d):
    return writes.compaction_stats(sessions(s, d))


@query("SELECT event_id AS seq, true AS ok FROM events")
def chain_verify(s, d):
    body = F.to_json(F.struct("event_type", "props", "ts", "user_id", "value"))
    return integrity.verify_commits(*integrity.seal_commits(table(s, d, "events").select(F.col("event_id").alias("seq"), body.alias("body"))))


@query("SELECT event_id AS seq FROM events WHERE event_id % 700 = 13 AND value > 50")
def tamper_localised(s, d):
    """Bodies that are changed after sealing: just they are found."""
    body = F.to_json(F.struct("event_type", "user_id", "value"))
    sealed, heads = integrity.seal_commits(table(s, d, "events").select(F.col("event_id").alias("seq"), body.alias("body")))
    hit = (F.col("seq") % 700 == 13) & (F.get_json_object("body", "$.value").cast("double") > 50)
    changed = sealed.withColumn("body", F.when(hit, F.concat("body", F.lit(" "))).otherwise(F.col("body")))
    return integrity.verify_commits(changed, heads).where("not ok").select("seq")


def _pieces(s, d) -> DataFrame:
    return files.cut(table(s, d, "pages").select(F.col("url").alias("name"), F.col("page_id").alias("version"), F.col("html").alias("data")))


@query()
def merkle_root(s, d):
    return files.recipes(_pieces(s, d)).select("name", "version", "root")


@query("SELECT url AS name, page_id AS version, sum(octet_length(encode(html)))::BIGINT AS size FROM pages GROUP BY ALL")
def chunk_sizes(s, d):
    """Pieces of a file add up to it, are within their bounds, and are in unbroken order."""
    p = _pieces(s, d)
    bounds = F.max("size") <= files.MOST
    whole = F.max("pos") + 1 == F.count("*")
    return p.groupBy("name", "version").agg(F.sum("size").alias("size"), (bounds & whole).alias("sound")).where("sound").drop("sound")


@query()
def chunk_stats(s, d):
    return files.stats(_pieces(s, d))


@query("SELECT url AS name, page_id AS version, octet_length(encode(html)) AS n, sha256(html) AS content FROM pages")
def file_restore(s, d):
    p = _pieces(s, d)
    return files.restore(files.recipes(p), files.store(p)).select("name", "version", F.octet_length("data").alias("n"), F.sha2("data", 256).alias("content"))


@query("SELECT DISTINCT p_partkey AS id, unnest(regexp_extract_all(lower(p_name || ' ' || p_type || ' ' || p_name), '[a-z0-9]+')) AS token FROM part")
def tokenise(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), F.explode(values.tokens(F.concat_ws(" ", "p_name", "p_type", "p_name"))).alias("token"))


@query("SELECT n_nationkey AS id FROM nation WHERE contains(lower(to_json({'id': n_nationkey, 'n_name': n_name, 'n_regionkey': n_regionkey})), lower('NATION_1'))")
def search_json(s, d):
    nations = Store({"nation": keyed(table(s, d, "nation"), "n_nationkey")}, current=frozenset(["nation"]), json_search=True)
    return nations.query("FROM nation SEARCH 'NATION_1'").select("id")


@query("SELECT NULL::VARCHAR AS nowhere, count(*) AS count FROM customer")
def group_absent(s, d):
    return store(s, d).query("FROM customer GROUP BY nowhere COUNT")


@query("SELECT c_custkey AS _id, count(*) AS count FROM customer GROUP BY 1")
def group_by_id(s, d):
    return store(s, d).query("FROM customer GROUP BY _id COUNT")


@query("SELECT c_custkey AS id FROM customer WHERE false")
def sql_like_absent(s, d):
    return store(s, d).sql("SELECT id FROM customer WHERE nowhere LIKE '%a%'")


@query(f"SELECT id FROM ({VALID}) WHERE valid_from >= '1997-01-01' AND id >= 100")
def pseudo_fields(s, d):
    return store(s, d).query("FROM policies WHERE _valid_from >= '1997-01-01' AND _seq >= 100").select("id")


#: A causal log of two collections: prompts, and the answers that they cause.
LAYERS = TURNS + """c AS (SELECT seq, cause, conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'prompts' ELSE 'answers' END AS coll FROM t), """


def _layers(s, d) -> Store:
    t = turns(s, d)
    return Store({"prompts": t.where("turn % 2 = 0"), "answers": t.where("turn % 2 = 1")})


@query(LAYERS + "r AS (SELECT cause AS seq FROM c WHERE turn = 3 AND cause IS NOT NULL UNION SELECT c.cause FROM r JOIN c ON c.seq = r.seq WHERE c.cause IS NOT NULL) SELECT c.seq, c.coll FROM r JOIN c ON c.seq = r.seq")
def trace_collections(s, d):
    return _layers(s, d).query("FROM answers WHERE turn = 3 TRACE caused_by").select("seq", "coll")


@query(LAYERS + "r AS (SELECT x.seq FROM c JOIN c x ON x.cause = c.seq WHERE c.turn = 0 AND c.seq <= 60000 AND x.seq <= 60000 UNION SELECT c.seq FROM r JOIN c ON c.cause = r.seq WHERE c.seq <= 60000) SELECT c.seq, c.coll FROM r JOIN c ON c.seq = r.seq")
def trace_collections_forward_as_of(s, d):
    return _layers(s, d).query("FROM prompts AS OF 60000 WHERE turn = 0 TRACE caused_by REVERSE").select("seq", "coll")


@query(TURNS + "r AS (SELECT seq AS root, seq, 0 AS depth FROM t WHERE turn = 5 UNION ALL SELECT r.root, t.cause, r.depth + 1 FROM r JOIN t ON t.seq = r.seq WHERE t.cause IS NOT NULL AND r.depth < 2) SELECT root, seq, depth::INTEGER AS depth FROM r")
def trace_with_root(s, d):
    ops = turns(s, d)
    return graph.trace_each(ops, ops.where("turn = 5").select("seq"), limit=3)


def _profiles(s, d) -> DataFrame:
    """Documents with an object and an array."""
    c = table(s, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")).alias("o"), F.array(F.col("c_nationkey"), F.col("c_nationkey") + 1, F.lit(7)).alias("tags"), "c_acctbal", "c_mktsegment")


#: Updates of profiles: the change, and SQL for (id, value) of what it alters.
UPDATES = {
    "update_set_nested": ({"c_mktsegment": "BUILDING"}, {"$set": {"o.nation": 99}}, "concat_ws('|', o.name, o.nation)", "SELECT c_custkey AS id, concat_ws('|', c_name, 99) AS value FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "update_set_parents": ({"id": {"$lt": 20}}, {"$set": {"new.deep": "x"}}, "new.deep", "SELECT c_custkey AS id, 'x' AS value FROM customer WHERE c_custkey < 20"),
    "update_set_on_insert": ({}, {"$setOnInsert": {"o.nation": 1}}, "o.name", "SELECT c_custkey AS id, c_name AS value FROM customer WHERE false"),
    "update_unset": ({"o.nation": 3}, {"$unset": {"o.name": 1}}, "coalesce(o.name, '-')", "SELECT c_custkey AS id, '-' AS value FROM customer WHERE c_nationkey = 3"),
    "update_mul": ({"c_acctbal": {"$gt": 0}}, {"$mul": {"o.nation": 3}, "$inc": {"c_acctbal": 1}}, "cast(o.nation as string)", "SELECT c_custkey AS id, (c_nationkey * 3)::VARCHAR AS value FROM customer WHERE c_acctbal > 0"),
    "update_min_max": ({}, {"$min": {"o.nation": 12}}, "cast(o.nation as string)", "SELECT c_custkey AS id, '12' AS value FROM customer WHERE c_nationkey > 12"),
    "update_rename": ({"id": {"$lte": 50}}, {"$rename": {"c_mktsegment": "segment"}}, "segment", "SELECT c_custkey AS id, c_mktsegment AS value FROM customer WHERE c_custkey <= 50"),
    "update_push": ({"tags": 3}, {"$push": {"tags": {"$each": [100, 3]}}}, "array_join(tags, ',')", "SELECT c_custkey AS id, concat_ws(',', c_nationkey, c_nationkey + 1, 7, 100, 3) AS value FROM customer WHERE c_nationkey IN (2, 3)"),
    "update_add_to_set": ({}, {"$addToSet": {"tags": 5}}, "array_join(tags, ',')", "SELECT c_custkey AS id, concat_ws(',', c_nationkey, c_nationkey + 1, 7, 5) AS value FROM customer WHERE c_nationkey NOT IN (4, 5)"),
    "update_pull": ({}, {"$pull": {"tags": {"$gte": 8}}}, "array_join(tags, ',')", "SELECT c_custkey AS id, array_to_string([x FOR x IN [c_nationkey, c_nationkey + 1, 7] IF x < 8], ',') AS value FROM customer WHERE c_nationkey >= 7"),
    "update_pop": ({"id": {"$mod": [-5, -2]}}, {"$pop": {"tags": -1}}, "array_join(tags, ',')", "SELECT c_custkey AS id, concat_ws(',', c_nationkey + 1, 7) AS value FROM customer WHERE c_custkey % 5 = 3"),
}
for _name, (_q, _change, _value, _sql) in UPDATES.items():
    QUERIES[_name] = lambda s, d, q=_q, c=_change, v=_value: documents.update(_profiles(s, d), q, c).selectExpr("id", f"{v} AS value")
    SQL[_name] = _sql


@query("SELECT c_custkey AS id, 'gone' AS note FROM customer WHERE c_nationkey = 4")
def replace_documents(s, d):
    return documents.replace(_profiles(s, d), {"o.nation": 4}, {"note": "gone"})


@query("SELECT c_custkey AS id FROM customer WHERE c_nationkey BETWEEN 8 AND 11 OR c_nationkey + 1 BETWEEN 8 AND 11")
def mongo_elem_match(s, d):
    return documents.find(_profiles(s, d), {"tags": {"$elemMatch": {"$gte": 8, "$lte": 11}}}).select("id")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey IN (3, 5, 8)")
def mongo_find_by_id(s, d):
    return documents.find(_profiles(s, d), {"_id": {"$in": [3, 5, 8]}}).select("id")


@query("SELECT o_orderstatus AS status, year(o_orderdate)::INTEGER AS y, count(*) AS n FROM orders GROUP BY ALL")
def mongo_group_composite(s, d):
    o = _orders(s, d).withColumn("y", F.year("o_orderdate"))
    out = documents.aggregate(o, [{"$group": {"_id": {"status": "$o_orderstatus", "y": "$y"}, "n": {"$sum": 1}}}])
    return out.select("_id.status", "_id.y", F.col("n").cast("long").alias("n"))


@query("SELECT count(*) AS n, round(min(o_totalprice), 2) AS least, round(max(o_totalprice), 2) AS most FROM orders")
def mongo_group_all(s, d):
    out = documents.aggregate(_orders(s, d), [{"$group": {"_id": None, "n": {"$sum": 1}, "least": {"$min": "$o_totalprice"}, "most": {"$max": "$o_totalprice"}}}])
    return out.select(F.col("n").cast("long").alias("n"), F.round("least", 2).alias("least"), F.round("most", 2).alias("most"))


@query("SELECT o_custkey AS cust, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS dearest, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_totalprice DESC, o_orderkey) AS ranked FROM orders GROUP BY 1")
def mongo_first_descending(s, d):
    out = documents.aggregate(_orders(s, d), [{"$sort": {"o_totalprice": -1}}, {"$group": {"_id": "$o_custkey", "dearest": {"$first": "$id"}, "ranked": {"$push": "$id"}}}])
    return out.select(F.col("_id").alias("cust"), "dearest", F.array_join(F.col("ranked").cast("array<string>"), ",").alias("ranked"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice, o_orderkey LIMIT 30 OFFSET 5")
def mongo_stages(s, d):
    return documents.aggregate(_orders(s, d), [{"$match": {"o_orderstatus": "F"}}, {"$sort": {"o_totalprice": 1}}, {"$skip": 5}, {"$limit": 30}, {"$project": {"id": 1}}])


@query("SELECT count(*) AS n FROM orders WHERE o_totalprice > 100000")
def mongo_count_documents(s, d):
    return documents.find(_orders(s, d), {"o_totalprice": {"$gt": 100000}}).agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS id FROM customer ORDER BY c_custkey LIMIT 12")
def limit_only(s, d):
    return store(s, d).query("FROM customer LIMIT 12").select("id")


@query("SELECT * FROM (VALUES ('c_acctbal', 'number'), ('c_custkey', 'number'), ('c_mktsegment', 'string'), ('c_name', 'string'), ('c_nationkey', 'number')) AS t(field, type)")
def field_types(s, d):
    return log.field_types(table(s, d, "customer"))


@query("SELECT 'k' AS field, 'number' AS type, count(*) AS n FROM events UNION ALL SELECT 'who', CASE WHEN count(DISTINCT user_id % 2) = 2 THEN 'mixed' ELSE 'string' END, count(*) FROM events UNION ALL SELECT 'at', 'json', count(*) FROM events WHERE event_type = 'click'")
def json_field_types(s, d):
    k = F.get_json_object("props", "$.k").cast("long").alias("k")
    who = F.when(F.col("user_id") % 2 == 0, F.to_json(F.struct(k, F.col("user_id").alias("who")))).otherwise(F.to_json(F.struct(k, F.col("event_type").alias("who"))))
    at = F.when(F.col("event_type") == "click", F.regexp_replace(who, r"\}$", ',"at":{"x":1}}')).otherwise(who)
    return log.json_field_types(table(s, d, "events").select(at.alias("doc")))


@query("SELECT 'turns' AS coll, turn::VARCHAR AS id, CASE WHEN role = 'user' THEN '{\"r\":1}' ELSE '{\"_v\":\"' || role || '\"}' END AS doc FROM conversations WHERE conv_id % 10 = 3")
def register_keys(s, d):
    value = F.when(F.col("role") == "user", F.lit('{"r":1}')).otherwise(F.col("role"))
    pairs = table(s, d, "conversations").select(F.concat_ws(":", F.lit("turn"), "conv_id", "turn").alias("key"), value.alias("value"))
    return keyvalue.register(pairs, "turn:*3:*", "turns")


@query("SELECT user_id AS id, max(event_id) AS seq, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def folded_head(s, d):
    """What the streaming HEAD holds, as a batch."""
    return feed.streaming_head(sessions(s, d)).select("id", "seq", "event_type")


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, count(*) AS n FROM events GROUP BY 1")
def windowed_counts(s, d):
    got = feed.windowed(table(s, d, "events").withColumn("at", F.col("ts").cast("timestamp")), "at", "1 day", "1 hour")
    return got.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT user_id AS coll, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS fields FROM (SELECT user_id, event_type, max(event_id)::VARCHAR AS n FROM events WHERE event_type <> 'error' GROUP BY ALL) GROUP BY 1")
def hash_maps(s, d):
    ops = sessions(s, d).where("op = 'put'").select("seq", "op", F.col("id").alias("coll"), F.col("event_type").alias("id"), F.col("seq").cast("string").alias("value"))
    return keyvalue.hash_maps(ops).select("coll", F.array_join(F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("fields"))


@query(EDGES + 'SELECT "to" AS member FROM edges WHERE frm = 7 AND removed_seq IS NULL')
def set_members(s, d):
    return keyvalue.members(churn(s, d), 7)


@query("SELECT count(*) = 0 AS same FROM events WHERE false")
def rebuild_is_live(s, d):
    """The state folded from the log is the one kept from a snapshot."""
    v = sessions(s, d)
    kept = writes.snapshot_plus_delta(resolve.as_of(v, 400), 400, v)
    live = resolve.head(v).select(kept.columns)
    return kept.exceptAll(live).union(live.exceptAll(kept)).agg((F.count("*") == 0).alias("same"))
