import json

import pytest
from pyspark.sql import functions as F

from palimpsest.__main__ import main
from palimpsest.commands import CommandError, Commands, escaped, unescaped
from palimpsest.database import Database, Replay, create, databases, drop_database
from palimpsest.operators import documents, integrity
from palimpsest.operators.keyvalue import Refused
from palimpsest.operators.writes import Advisor


def ids(df):
    return sorted(r.id for r in df.collect())


@pytest.fixture(scope="module")
def db(spark, tmp_path_factory):
    d = Database(spark, str(tmp_path_factory.mktemp("db") / "one"), advisor=Advisor(2))
    d.commit(
        [
            {"op": "put", "coll": "users", "id": "alice", "doc": {"name": "Alice", "age": 31, "score": 1.5}},
            {"op": "put", "coll": "users", "id": "bob", "doc": {"name": "Bob", "age": 24, "seq": "own"}},
            {"op": "put", "coll": "posts", "id": "p1", "doc": {"title": "On logs"}, "caused_by": [0]},
            {"op": "link", "frm": "users:alice", "rel": "wrote", "to": "posts:p1"},
            {"op": "put", "coll": "users", "id": "alice", "doc": {"name": "Alice", "age": 32}, "caused_by": [2]},
            {"op": "delete", "coll": "users", "id": "bob"},
        ]
    )
    return d


def test_reads(db):
    assert db.get("users", "alice") == {"name": "Alice", "age": 32}
    assert db.get("users", "alice", as_of=3)["age"] == 31
    assert db.get("users", "bob") is None and db.get("users", "bob", as_of=4)["name"] == "Bob"
    assert ids(db.query("FROM users")) == ["alice"] and ids(db.query("FROM users AS OF 4 WHERE age < 30")) == ["bob"]
    assert ids(db.query("FROM users WHERE age = 32")) == ["alice"]
    assert ids(db.query("FROM users TRAVERSE wrote")) == ["p1"]
    assert db.neighbors("users:alice", "wrote") == ["posts:p1"] and db.inbound("posts:p1", "wrote") == ["users:alice"]
    assert {r.coll: r.n for r in db.collections().collect()} == {"users": 1, "posts": 1}
    assert [r.seq for r in db.history("users", "alice").orderBy("seq").collect()] == [0, 4]
    assert "field_seq" in db.versions("users").columns and dict(db.versions("users").dtypes)["score"] == "double"
    assert db.by_hash(db.head).first().seq == db.tip().seq
    assert db.advisor.suggest() == []
    db.query("FROM users WHERE age = 31")
    assert db.advisor.suggest() == [("users", "age", "bucket", 2)]


def test_empty(spark, tmp_path):
    d = Database(spark, str(tmp_path / "none"))
    assert d.seq == -1 and d.tip() is None and d.get("a", "b") is None and d.query("FROM a").count() == 0
    assert d.verify().count() == 0 and d.sweep() == 0 and d.commit([]) == []


def test_idempotency_and_replay(spark, tmp_path):
    d = Database(spark, str(tmp_path / "x"))
    assert d.commit([{"op": "put", "coll": "a", "id": "1", "doc": {}, "idem": "k"}, {"op": "put", "coll": "a", "id": "2", "doc": {}, "idem": "k"}]) == [0, 0]
    assert d.put("a", "3", {}, idem="k") == 0 and d.seq == 0
    assert d.put("a", "1", {"v": 1}, client="c", nonce=5) == 1
    with pytest.raises(Replay):
        d.put("a", "1", {"v": 2}, client="c", nonce=5)
    assert d.get("a", "1") == {"v": 1} and d.put("a", "1", {"v": 3}, client="c") == 2


def test_ttl(spark, tmp_path):
    d = Database(spark, str(tmp_path / "x"))
    d.put("a", "1", {"v": 1}, ttl=-5)
    d.put("a", "2", {"v": 2}, ttl=900)
    assert d.get("a", "1") is None and ids(d.query("FROM a")) == ["1", "2"]
    assert d.expire("a", "1", 5) is False and d.sweep() == 1
    assert ids(d.query("FROM a")) == ["2"] and d.tip().client == "__ttl__"


def test_load_and_verify(spark, tmp_path):
    d = Database(spark, str(tmp_path / "x"))
    d.put("a", "first", {"n": -1})
    d.load(spark.range(500).select(F.col("id"), (F.col("id") * 2).alias("n")), "a")
    d.put("a", "last", {"n": -2})
    assert d.seq == 501 and ids(d.query("FROM a WHERE n = 400")) == ["200"]
    assert d.verify().where("ok").count() == 502
    # a changed document, and a missing one
    for name, damaged, n in (("y", d.ops().withColumn("doc", F.when(F.col("seq") == 7, F.lit("{}")).otherwise(F.col("doc"))), 1), ("z", d.ops().where("seq <> 9"), 1)):
        damaged.write.parquet(str(tmp_path / name / "ops"))
        assert Database(spark, str(tmp_path / name)).verify().where("not ok").count() == n
    with pytest.raises(ValueError):
        Database(spark, str(tmp_path / "y")).heal(str(tmp_path / "h"))
    healed = d.heal(str(tmp_path / "g"))
    assert healed.verify().where("ok").count() == 502 and healed.ops().where("prev_hash is null").isEmpty()


def test_sql_and_dialect(spark, tmp_path):
    d = Database(spark, str(tmp_path / "x"))
    assert d.sql("INSERT INTO t (id, a, b) VALUES ('k', 1, 'x')") == 0
    assert d.sql("UPDATE t SET a = 2 WHERE id = 'k'") == 1 and d.get("t", "k") == {"a": 2, "b": "x"}
    assert d.sql("DELETE FROM t WHERE id = 'none'") is None
    made = d.insert_many("t", [{"_id": "m", "a": 5, "b": "y"}, {"a": 6, "b": "z"}])
    assert made[0] == "m" and len(made[1]) == 24
    with pytest.raises(documents.DialectError):
        d.insert_many("t", [{"_id": "m"}])
    d.update_many("t", {"a": {"$gte": 5}}, {"$inc": {"a": 10}})
    assert sorted(r.a for r in d.find("t", {}).collect()) == [2, 15, 16]
    assert d.delete_many("t", {"a": {"$gt": 15}}) == 1 and d.aggregate("t", [{"$count": "n"}]).first().n == 2
    assert d.sql("DELETE FROM t WHERE id = 'k'") is not None and ids(d.find("t", {})) == ["m"]


def test_checkpoint_and_command_line(db, spark, tmp_path, capsys):
    db.checkpoint()
    db.put("posts", "p2", {"title": "Later"})
    assert sorted((r.coll, r.id) for r in db.head_from_snapshot().collect()) == [("posts", "p1"), ("posts", "p2"), ("users", "alice")]
    assert main([db.path, "verify"], spark) == 0
    assert json.loads(capsys.readouterr().out)["ok"] is True
    assert main([db.path, "get", "users", "alice"], spark) == 0
    assert json.loads(capsys.readouterr().out)["age"] == 32
    db.export(str(tmp_path / "out"), "posts")
    assert ids(spark.read.json(str(tmp_path / "out"))) == ["p1", "p2"]
    assert main([db.path, "nonsense"], spark) == 2


def test_traverse_into_several_collections(spark, tmp_path):
    d = Database(spark, str(tmp_path / "x"))
    d.commit([{"op": "put", "coll": c, "id": "1", "doc": {"v": c}} for c in ("a", "b", "c")] + [{"op": "link", "frm": "a:1", "rel": "r", "to": f"{c}:1"} for c in ("b", "c")])
    assert ids(d.query("FROM a TRAVERSE r")) == ["b:1", "c:1"]


def test_trace_goes_through_all_collections(spark, tmp_path):
    d = Database(spark, str(tmp_path / "x"))
    d.commit(
        [
            {"op": "put", "coll": "notes", "id": "n1", "doc": {"text": "screens hurt"}},
            {"op": "put", "coll": "notes", "id": "n2", "doc": {"text": "headaches"}},
            {"op": "put", "coll": "facts", "id": "light", "doc": {"claim": "light-sensitive"}, "caused_by": [0, 1], "confidence": 0.9},
            {"op": "put", "coll": "prefs", "id": "dark", "doc": {"enabled": True}, "caused_by": [2]},
            {"op": "link", "frm": "notes:n1", "rel": "about", "to": "facts:light"},
            {"op": "put", "coll": "facts", "id": "light", "doc": {"claim": "very light-sensitive"}},
        ]
    )
    assert ids(d.query("FROM prefs WHERE _id = 'dark' TRACE caused_by")) == ["light", "n1", "n2"]
    assert ids(d.query("FROM notes WHERE _id = 'n1' TRACE caused_by REVERSE")) == ["dark", "light"]
    assert ids(d.query("FROM notes AS OF 2 WHERE _id = 'n1' TRACE caused_by REVERSE")) == ["light"]
    assert [r.claim for r in d.query("FROM notes WHERE _id = 'n1' TRACE caused_by REVERSE").collect() if r.id == "light"] == ["very light-sensitive"]
    assert ids(d.query("FROM notes AS OF 4 WHERE _id = 'n1' TRAVERSE about TRACE caused_by")) == ["n1", "n2"]
    assert ids(d.query("FROM facts WHERE _confidence = 0.9")) == [] and ids(d.query("FROM facts AS OF 3 WHERE _confidence = 0.9")) == ["light"]
    assert d.hash_of(0) == d.ops().where("seq = 0").first().hash and d.hash_of(99) is None


def test_document_writes(spark, tmp_path):
    d = Database(spark, str(tmp_path / "x"))
    d.insert_many("t", [{"_id": "a", "o": {"x": 1, "y": "u"}, "n": 1}, {"_id": "b", "o": {"x": 2, "y": "v"}, "n": 2}])
    assert ids(d.find("t", {"_id": "a"})) == ["a"] and ids(d.find("t", {"_id": {"$in": ["b", "c"]}})) == ["b"]
    d.update_many("t", {"_id": "a"}, {"$set": {"o.x": 7, "p.q": "new"}, "$inc": {"n": 1}})
    assert d.get("t", "a") == {"o": {"x": 7, "y": "u"}, "n": 2, "p": {"q": "new"}}
    before = d.seq
    d.update_many("t", {}, {"$max": {"n": 1}})
    assert d.seq == before  # nothing changed
    assert d.update_one("t", {"n": 2}, {"$mul": {"n": 5}}) == "a" and d.get("t", "a")["n"] == 10
    assert d.update_one("t", {"n": 99}, {"$set": {"k": 1}}) is None
    assert d.update_one("t", {"n": 99, "_id": "z"}, {"$set": {"k.l": 1}}, upsert=True) == "z" and d.get("t", "z") == {"n": 99, "k": {"l": 1}}
    assert d.replace_one("t", {"_id": "b"}, {"n": 3}) == "b" and d.find_one("t", {"n": 3}) == {"_id": "b", "n": 3}
    with pytest.raises(documents.DialectError):
        d.replace_one("t", {"_id": "b"}, {"$set": {"n": 1}})
    assert d.count_documents("t") == 3 and d.delete_one("t", {"n": 3}) == 1 and d.drop("t") == 2 and d.count_documents("t") == 0


def test_files_of_a_database(spark, tmp_path):
    d = Database(spark, str(tmp_path / "x"))
    data = b"".join(b"line %05d\n" % i for i in range(9000))
    d.put_file("f", data)
    root = d.put_file("f", data[:40000] + b"edit" + data[40000:])
    assert d.get_file("f", 1) == data and len(d.get_file("f")) == len(data) + 4 and d.get_file("none") is None
    p = d.file_proof("f", 2, 1)
    assert p["root"] == root and integrity.merkle_verify(p["leaf"], p["proof"], root) and d.verify().where("not ok").isEmpty()


def test_compaction_and_folders_of_databases(spark, tmp_path):
    d = create(spark, str(tmp_path), "one", {"seed": {"a": {"1": {"v": 1}, "2": {"v": 2}}}, "links": [("a:1", "r", "a:2")]})
    d.put("a", "1", {"v": 9})
    d.delete("a", "2")
    assert d.compact(str(tmp_path / "two")) == {"before": 5, "after": 2, "dropped": 3}
    two = Database(spark, str(tmp_path / "two"))
    assert two.get("a", "1") == {"v": 9} and two.neighbors("a:1", "r") == ["a:2"] and two.verify().where("ok").count() == 2
    assert databases(spark, str(tmp_path)) == ["one", "two"]
    with pytest.raises(ValueError):
        create(spark, str(tmp_path), "one")
    assert drop_database(spark, str(tmp_path), "two") and not drop_database(spark, str(tmp_path), "two")


def test_commands(spark, tmp_path):
    c = Commands(Database(spark, str(tmp_path / "x")))
    do = c.execute
    assert do("PING") == "PONG" and do("set", "k", "5") == "OK" and do("SET", "k", 1, "NX") is None and do("INCRBY", "k", 3) == 8 and do("GET", "k") == "8"
    assert do("MSET", "a", 1, "b", 2) == "OK" and do("MGET", "a", "x", "b") == ["1", None, "2"] and do("APPEND", "a", "z") == 2
    assert do("HSET", "user:1", "name", "Ann", "age", 3) == 2 and do("HGETALL", "user:1") == {"name": "Ann", "age": "3"} and do("HINCRBY", "user:1", "age", 2) == 5
    assert do("SADD", "s", "x", "y") == 2 and do("SADD", "t", "y") == 1 and do("SDIFF", "s", "t") == {"x"} and do("SREM", "s", "x") == 1 and do("SCARD", "s") == 1
    assert do("RPUSH", "l", "a", "b") == 2 and do("LPUSH", "l", "c", "d") == 4 and do("LRANGE", "l", 0, -1) == ["d", "c", "a", "b"]
    assert do("LPOP", "l") == "d" and do("RPOP", "l") == "b" and do("LSET", "l", 0, "q") == "OK" and do("LINDEX", "l", 0) == "q" and do("LLEN", "l") == 2
    assert do("KEYS", "*") == ["a", "b", "k", "l", "s", "t", "user:1"] and [do("TYPE", x) for x in ("a", "l", "s", "user:1", "no")] == ["string", "list", "set", "hash", "none"]
    assert do("DEL", "a", "l", "s", "no") == 3 and do("EXISTS", "a", "b") == 1
    with pytest.raises(Refused):
        do("EXPIRE", "k", 1)
    with pytest.raises(CommandError):
        do("INCR", "user:1", 1)
    c.register("driver:*", "drivers")
    c.shadow("SET", "driver:7", '{"name": "Bo"}')
    c.shadow("SET", "other", "1")
    assert c.db.get("drivers", "7") == {"name": "Bo"} and json.loads(c.query("FROM drivers")[0])["name"] == "Bo" and c.db.count_documents("__shadow__") == 1
    assert unescaped(escaped("a:b c")) == "a:b c"
