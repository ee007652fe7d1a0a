import hashlib
import json
import time

import pytest
from pyspark.sql import functions as F

from palimpsest.database import SCHEMA, Database
from palimpsest.functions.values import canonical, digest
from palimpsest.operators import integrity
from palimpsest.sources import imports
from palimpsest.streaming import feed


def lines(ops):
    """Chained lines of a log: (op, payload, more)."""
    out, last = [], integrity.GENESIS
    for seq, (op, payload, more) in enumerate(ops):
        body = {"seq": seq, "client": "c", "nonce": seq + 1, "op": op, "payload": payload, "ts": 1.5, "idem": None} | more
        h = digest(last.encode() + canonical(body))
        out.append(json.dumps(body | {"prev_hash": last, "hash": h}))
        last = h
    return out


LINES = lines(
    [
        ("put", {"coll": "rivers", "id": "elbe", "doc": {"km": 1094, "é": [1, None]}}, {}),
        ("put", {"coll": "rivers", "id": "oder", "doc": {"km": 866}}, {"caused_by": [0], "confidence": 0.5}),
        ("link", {"frm": "rivers:elbe", "rel": "near", "to": "rivers:oder"}, {}),
        ("delete", {"coll": "rivers", "id": "oder"}, {"valid_to": "2020-01-01"}),
    ]
)


def test_lines_with_payloads(spark, tmp_path):
    (tmp_path / "log").write_text("\n".join(LINES))
    got = imports.op_lines(spark, str(tmp_path / "log"))
    assert got.columns == SCHEMA.names
    rows = {r.seq: r for r in got.collect()}
    assert [rows[k].op for k in range(4)] == ["put", "put", "link", "delete"] and json.loads(rows[0].doc) == {"km": 1094, "é": [1, None]}
    assert rows[1].caused_by == [0] and (rows[2].frm, rows[2].rel, rows[2].to) == ("rivers:elbe", "near", "rivers:oder") and rows[3].id == "oder"
    assert {tuple(r) for r in imports.verify_lines(spark, str(tmp_path / "log")).collect()} == {(k, True) for k in range(4)}


def test_changed_and_corrupt_lines(spark, tmp_path):
    (tmp_path / "log").write_text("\n".join([LINES[0], LINES[1].replace("866", "867"), *LINES[2:], "{broken"]))
    assert {tuple(r) for r in imports.verify_lines(spark, str(tmp_path / "log")).collect()} == {(0, True), (1, False), (2, True), (3, True), (None, False)}
    assert imports.op_lines(spark, str(tmp_path / "log")).count() == 4
    (tmp_path / "none").write_text("")
    assert imports.op_lines(spark, str(tmp_path / "none")).count() == 0 and imports.verify_lines(spark, str(tmp_path / "none")).count() == 0


def node(seq, id, data, causes=()):
    body = json.dumps({"id": id, "coll": "rivers", "seq": seq, "data": data, "prev": None, "caused_by": list(causes), "ts": 2.0, "valid_from": None, "valid_to": None}).encode()
    return hashlib.blake2b(body).hexdigest()[:64], body


def test_objects_and_packs(spark, tmp_path):
    h0, first = node(3, "elbe", {"km": 1094})
    h1, second = node(4, "oder", {"km": 866}, [h0, "f" * 64])
    for h, body in ((h0, first), (h1, second), ("0" * 64, b"changed")):
        (tmp_path / "loose" / h[:2]).mkdir(parents=True, exist_ok=True)
        (tmp_path / "loose" / h[:2] / h[2:]).write_bytes(body)
    (tmp_path / "loose" / h0[:2] / "x.tmp").write_bytes(b"half")
    loose = imports.objects(spark, str(tmp_path / "loose"))
    assert {(r.hash, r.ok) for r in loose.collect()} == {(h0, True), (h1, True), ("0" * 64, False)}
    h2, third = node(5, "_del_oder", {"_deleted": "oder", "_prev": h1})
    assert [(r.seq, r.op, r.id, r.doc) for r in imports.node_ops(spark.createDataFrame([(h2, bytearray(third))], "hash string, content binary")).collect()] == [(5, "delete", "oder", None)]
    (tmp_path / "packs").mkdir()
    pack = b"".join(len(b).to_bytes(4, "little") + b for b in (first, second, first))
    (tmp_path / "packs" / "1.seg").write_bytes(pack + (9999).to_bytes(4, "little") + b"torn")
    (tmp_path / "packs" / "1.idx").write_bytes(b"other")
    (tmp_path / "packs" / "2.seg").write_bytes(b"")
    packed = imports.packs(spark, str(tmp_path / "packs"))
    assert sorted(r.hash for r in packed.collect()) == sorted([h0, h1, h0])
    for found in (loose.where("ok").drop("ok"), packed):
        ops = imports.node_ops(found)
        assert ops.columns == SCHEMA.names
        rows = {r.id: r for r in ops.collect()}
        assert len(rows) == 2 and json.loads(rows["oder"].doc) == {"km": 866} and rows["oder"].caused_by == [3] and rows["elbe"].caused_by is None


def test_wrapped_keys(spark):
    key, a, b = bytes(range(32)), integrity.derived_key(b"a", b"s", b"i"), integrity.derived_key(b"b", b"s", b"i")
    held = integrity.wrap_key(spark, key, a, "for keys")
    assert held.keys() == {"v", "alg", "n", "ct"} and len(held["ct"]) == 96 and integrity.unwrap_key(spark, held, a, "for keys") == key
    again = integrity.rewrap_key(spark, held, a, b, "for keys")
    assert integrity.unwrap_key(spark, again, b, "for keys") == key
    with pytest.raises(Exception):  # noqa: B017
        integrity.unwrap_key(spark, again, a, "for keys")


def test_running_head(spark):
    ops = spark.range(50).select(F.col("id").alias("seq"), F.sha2(F.col("id").cast("string"), 256).alias("hash")).repartition(4)
    last = ""
    for k in range(50):
        last = hashlib.blake2b(last.encode() + k.to_bytes(8, "little") + hashlib.sha256(str(k).encode()).hexdigest().encode()).hexdigest()[:64]
    assert [tuple(r) for r in integrity.running_head(ops).collect()] == [(49, last)]
    assert integrity.running_head(ops.where("seq < 0")).count() == 0


def test_follow_and_due_checkpoints(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    db.put("rivers", "elbe", {"km": 1094})
    seen = []

    def drain():
        feed.follow(feed.stream(spark, f"{db.path}/ops", SCHEMA), lambda rows, _: seen.extend(r.seq for r in rows.collect()), str(tmp_path / "at")).awaitTermination()

    drain()
    db.put("rivers", "oder", {"km": 866})
    drain()
    assert seen == [0, 1]
    assert db.checkpoint_if_due(10) == 2 and db.checkpoint_if_due(10, time.time() - 601) is None and db.checkpoint_if_due(10, time.time() + 601) == 3
