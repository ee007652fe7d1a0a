import json

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import documents, files, graph, integrity, resolve, writes
from palimpsest.plans import text
from palimpsest.plans.lower import Store
from palimpsest.plans.plan import Query
from palimpsest.sources import log
from palimpsest.streaming import feed


@pytest.fixture(scope="module")
def users(spark):
    rows = [(0, "put", "alice", "Alice", 31, "active", "rust db"), (1, "put", "bob", "Bob", 24, "active", "python data"), (2, "put", "carol", "Carol", 41, "inactive", "rust systems"), (3, "put", "dan", "Dan", None, None, None), (4, "delete", "bob", None, None, None, None)]
    return spark.createDataFrame(rows, "seq long, op string, id string, name string, age int, status string, bio string")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_states(users):
    assert ids(resolve.head(users)) == ["alice", "carol", "dan"]
    assert ids(resolve.as_of(users, 3)) == ["alice", "bob", "carol", "dan"]
    assert ids(resolve.as_of(users, users.agg(F.max("seq")).first()[0])) == ids(resolve.head(users))


def test_missing_values(users):
    s = Store({"users": users})
    assert ids(s.query("FROM users WHERE age != 31")) == ["carol", "dan"]
    assert ids(s.query("FROM users WHERE age = null")) == ["dan"]
    assert ids(s.query("FROM users WHERE age < 40")) == ["alice"]
    assert [r.id for r in s.query("FROM users ORDER BY age").collect()] == ["alice", "carol", "dan"]
    assert [r.id for r in s.query("FROM users ORDER BY age DESC").collect()] == ["dan", "carol", "alice"]
    assert ids(s.query('FROM users WHERE nowhere = null SEARCH "rust"')) == ["alice", "carol"]


def test_text_is_strict():
    assert text.parse("FROM a LIMIT 3 WHERE x = 'y' AS OF 4") == text.parse("FROM a AS OF 4 WHERE x = \"y\" LIMIT 3")
    for bad in ("FROM a LIMIT 1 LIMIT 2", "FROM a TRACE other", "FROM a nonsense", "SELECT"):
        with pytest.raises(ValueError):
            text.parse(bad)
    for bad in ("SELECT a FROM t WHERE x = 1 OR y = 2", "SELECT a FROM t WHERE x IN (1)", "SELECT a FROM t JOIN u"):
        with pytest.raises(ValueError):
            text.parse_sql(bad)
    assert text.parse_sql("UPDATE t SET a = 1 WHERE id = 'k'").fields == {"a": 1}


def test_builder_is_text():
    assert Query("a").where("x", ">", 1).order_by("x").limit(2).plan == text.parse("FROM a WHERE x > 1 ORDER BY x LIMIT 2")


def test_relink(spark):
    ev = spark.createDataFrame([(1, "link"), (2, "link"), (3, "unlink"), (4, "unlink"), (5, "link")], "seq long, op string").select("seq", "op", F.lit("a").alias("frm"), F.lit("r").alias("rel"), F.lit("b").alias("to"))
    assert sorted(((r.added_seq, r.removed_seq) for r in graph.intervals(ev).collect()), key=str) == [(1, 3), (5, None)]
    e = graph.intervals(ev)
    assert graph.live(e, 2).count() == 1 and graph.live(e, 3).count() == 0 and graph.live(e).count() == 1


def test_trace_survives_cycles(spark):
    ops = spark.createDataFrame([(0, "put", [2]), (1, "put", [0]), (2, "put", [1]), (3, "put", [])], "seq long, op string, caused_by array<long>")
    assert sorted(r.seq for r in graph.trace(ops, ops.where("seq = 2").select("seq")).collect()) == [0, 1, 2]
    back = {r.seq for r in graph.trace(ops, ops.where("seq = 1").select("seq")).collect()}
    assert back == {0, 1, 2}


def test_tampering_shows(spark):
    ops = spark.createDataFrame([(i, json.dumps({"v": i})) for i in range(5)], "seq long, body string")
    sealed = integrity.seal(ops)
    assert integrity.tampered(sealed).isEmpty()
    bad = sealed.withColumn("body", F.when(F.col("seq") == 2, '{"v":9}').otherwise(F.col("body")))
    assert [r.seq for r in integrity.tampered(bad).collect()] == [2]
    proof = integrity.inclusion_proof(sealed, 2)
    head = integrity.head_hash(sealed).first().head
    assert integrity.proof_holds(proof, head)
    assert not integrity.proof_holds(proof | {"body": "x"}, head)


def test_tampering_with_commits_shows(spark):
    def bad(sealed, heads):
        return sorted(r.seq for r in integrity.verify_commits(sealed, heads, 4).where("not ok").collect())

    def sealed(change=None):
        return integrity.seal_commits(spark.createDataFrame([(i, "x" if i == change else json.dumps({"v": i})) for i in range(10)], "seq long, body string"), 4)

    ops, heads = sealed()
    assert bad(ops, heads) == []
    assert bad(ops.withColumn("body", F.when(F.col("seq") == 5, "x").otherwise(F.col("body"))), heads) == [5]
    assert bad(sealed(5)[0], heads) == [4, 5, 6, 7]  # a commit that was sealed anew
    assert bad(ops.where("seq <> 7"), heads) == [4, 5, 6] and bad(ops.where("commit <> 1"), heads) == [4]


def test_chain_verify_is_over_the_events(spark):
    from palimpsest import catalog

    d = "/root/testdata/sf0.001"
    got = catalog.chain_verify(spark, d)
    assert got.where("ok").count() == got.count() == spark.read.parquet(f"{d}/events.parquet").count()


def test_merkle():
    leaves = [integrity.digest(bytes([i])) for i in range(5)]
    root = integrity.merkle_root(leaves)
    for i, leaf in enumerate(leaves):
        assert integrity.merkle_verify(leaf, integrity.merkle_proof(leaves, i), root)
    assert not integrity.merkle_verify(leaves[0], integrity.merkle_proof(leaves, 1), root)


def test_files(spark):
    data = b"".join(b"row %06d payload\n" % i for i in range(8000))
    edited = data[:60000] + b"edit" + data[60000:]
    pieces = files.cut(spark.createDataFrame([("f", 1, data), ("f", 2, edited)], "name string, version long, data binary"))
    assert files.stats(pieces).first().dedup_hits > 0
    back = {r.version: bytes(r.data) for r in files.restore(files.recipes(pieces), files.store(pieces)).collect()}
    assert back == {1: data, 2: edited}


def test_encryption(spark):
    df = spark.createDataFrame([("x",)], "v string")
    key = integrity.derived_key(b"secret", b"salt", b"docs")
    assert integrity.decrypted(integrity.encrypted(df, "v", key, "tag"), "v", key, "tag").first().v == "x"


def test_document_dialect(spark):
    docs = spark.createDataFrame([(1, "a", ["x", "y"], 2), (2, "b", ["z"], None), (3, None, None, 5)], "id long, s string, tags array<string>, n int")
    f = lambda q: ids(documents.find(docs, q))
    assert f({"tags": "x"}) == [1]
    assert f({"s": None}) == [3]
    assert f({"n": {"$gt": "5"}}) == []
    assert f({"n": {"$not": {"$gt": 3}}}) == [1, 2]
    assert f({"tags": {"$elemMatch": {"$gte": "z"}}}) == [2]
    assert f({"s": {"$in": [None, "a"]}}) == [1, 3]
    with pytest.raises(documents.DialectError):
        f({"$where": "1"})
    up = documents.update(docs, {"id": 1}, {"$push": {"tags": "w"}, "$inc": {"n": 3}}).first()
    assert up.tags == ["x", "y", "w"] and up.n == 5
    assert documents.update(docs, {"id": 1}, {"$set": {"s": "a"}}).isEmpty()
    assert documents.update(docs, {"id": 1}, {"$pull": {"tags": "x"}}).first().tags == ["y"]


def test_log_stops_at_corruption(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"seq":0,"op":"put"}\n{"seq":1,"op":"put"}\nbroken\n{"seq":3,"op":"put"}\n')
    assert sorted(r.seq for r in log.read_json(spark, str(tmp_path / "log.jsonl")).collect()) == [0, 1]
    (tmp_path / "two").mkdir()
    for name, lines in (("a", '{"seq":0}\n\n{"seq":1}\n'), ("b", '{"seq":2}\n{"seq":\n' + '{"seq":9}\n' * 500), ("c", '{"seq":3}\n' * 5)):
        (tmp_path / "two" / f"{name}.jsonl").write_text(lines)
    assert sorted(r.seq for r in log.read_json(spark, str(tmp_path / "two")).collect()) == [0, 1, 2]


def test_feed(spark, users, tmp_path):
    page = feed.page(users, 1, 2)
    assert [r.seq for r in page["nodes"]] == [2, 3] and page["has_more"] and page["head_seq"] == 4
    log.append(users, str(tmp_path / "ops"))
    seen = []
    ops = feed.stream(spark, str(tmp_path / "ops"), users.schema)
    q = feed.subscribe(ops, lambda: resolve.head(log.read(spark, str(tmp_path / "ops"))), seen.append, str(tmp_path / "c"))
    q.awaitTermination(60)
    assert len(seen) == 1 and len(seen[0]) == 3


def test_compaction(users):
    assert writes.compaction_stats(users).first().asDict() == {"before": 5, "after": 3, "dropped": 2}
    assert ids(resolve.head(writes.compact(users))) == ids(resolve.head(users))


def test_numbers_are_dense_over_many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows = spark.range(200_000).select(F.xxhash64("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))
        got = writes.assign_seq(rows, 100, "k").select("k", "seq", "payload")
        n, distinct, least, most = got.agg(F.count("*"), F.countDistinct("seq"), F.min("seq"), F.max("seq")).first()
        assert (n, distinct, least, most) == (200_000, 200_000, 100, 200_099)
        assert got.join(got.select((F.col("seq") + 1).alias("seq"), F.col("k").alias("before")), "seq").where("k < before").isEmpty()
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
