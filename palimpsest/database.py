"""A database on one log: writes append ops, reads are views of them.

A commit is one Parquet append.  commit() takes a batch of ops that fits the driver (a group commit) and chains
their hashes; load() takes a DataFrame of any size, numbers it in parallel and hashes each op for itself.
One writer at a time.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.values import blake2b
from palimpsest.operators import documents, files, graph, integrity, resolve, writes
from palimpsest.plans import lower
from palimpsest.plans.lower import Store
from palimpsest.plans.plan import Plan
from palimpsest.plans.text import Change, parse, parse_sql
from palimpsest.sources import log
from palimpsest.streaming import feed

WORDS = {"LONG": T.LongType(), "DOUBLE": T.DoubleType(), "STRING": T.StringType(), "ARRAY<LONG>": T.ArrayType(T.LongType())}
SCHEMA = T.StructType([T.StructField(name.strip("`"), WORDS[kind]) for name, kind in (c.strip().split(" ") for c in log.OPS.split(","))])
#: What is hashed of an op.
SEALED = [c for c in SCHEMA.names if c not in ("prev_hash", "hash")]
#: Columns of a version besides the document's own fields.
META = ["seq", "op", "coll", "id", "caused_by", "evidence", "confidence", "valid_from", "valid_to", "hash"]


class Replay(ValueError):
    """A nonce that isn't above its client's last one."""


def typed(versions: DataFrame) -> DataFrame:
    """Versions with the fields of their JSON documents as columns, typed by all of them.

    Numbers with a fraction are doubles, fields of mixed types strings.  A field named as one of META
    is read as field_<name>.
    """
    kinds = versions.where("doc is not null").select(F.schema_of_variant_agg(F.parse_json("doc"))).first()[0]
    meta = [F.col(c) for c in META if c in versions.columns]
    if not kinds.startswith("OBJECT<"):
        return versions.select(*meta)
    kinds = re.sub(r"DECIMAL\(\d+,\s*\d+\)", "DOUBLE", kinds).replace("OBJECT<", "STRUCT<")
    kinds = re.sub(r"\b(VARIANT|VOID)\b(?=[,>])", "STRING", kinds).replace("OBJECT", "STRING")
    struct = T._parse_datatype_string(kinds)
    doc = F.from_json("doc", struct.json())
    return versions.withColumn("__d", doc).select(*meta, *[F.col("__d").getField(f).alias(f"field_{f}" if f in META else f) for f in struct.names])


def nested(fields: dict) -> dict:
    """Dotted names as objects."""
    out: dict = {}
    for path, v in fields.items():
        at, (*above, last) = out, path.split(".")
        for part in above:
            at = at.setdefault(part, {})
        at[last] = v
    return out


def create(spark: SparkSession, root: str, name: str, init: dict | None = None) -> Database:
    """A new database, named in [A-Za-z0-9_-]; init: {"search": {coll: fields}, "seed": {coll: {id: document}}, "links": [(frm, rel, to)]}."""
    init = init or {}
    if not re.fullmatch(r"[A-Za-z0-9_-]+", name):
        raise ValueError(f"not a name: {name!r}")
    if name in databases(spark, root):
        raise ValueError(f"{name} is there already")
    db = Database(spark, f"{root.rstrip('/')}/{name}", init.get("search"))
    puts = [{"op": "put", "coll": c, "id": i, "doc": d} for c, docs in init.get("seed", {}).items() for i, d in docs.items()]
    db.commit(puts + [{"op": "link", "frm": f, "rel": r, "to": t} for f, r, t in init.get("links", [])])
    return db


def databases(spark: SparkSession, root: str) -> list[str]:
    """The names of the databases in a folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    ops = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return sorted(s.getPath().getName() for s in system.listStatus(path) if system.exists(ops(s.getPath().toString() + "/ops")))


def drop_database(spark: SparkSession, root: str, name: str) -> bool:
    """Deletes a database and its history; whether it was there."""
    if name not in databases(spark, root):
        return False
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))


class Database:
    def __init__(self, spark: SparkSession, path: str | None = None, search_fields: dict[str, list[str]] | None = None, advisor: writes.Advisor | None = None):
        """Opens or creates the log at path.  Without one the database is ephemeral: a fresh folder in spark.checkpoint.dir."""
        if path is None:
            path = f"{resolve.shared_folder(spark)}/database-{uuid.uuid4().hex}"
        self.spark, self.path, self.search_fields, self.advisor = spark, path.rstrip("/"), search_fields or {}, advisor
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/ops")
        if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            spark.createDataFrame([], SCHEMA).write.parquet(f"{self.path}/ops")

    # the log

    def ops(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/ops")

    def tip(self, coll: str | None = None):
        """The newest op, of all or of a collection; None of an empty log."""
        return resolve.tip(self.ops() if coll is None else self.ops().where(F.col("coll") == coll)).first()

    @property
    def seq(self) -> int:
        """The number of the newest op; -1 of an empty log."""
        last = self.ops().agg(F.max("seq")).first()[0]
        return -1 if last is None else last

    @property
    def head(self) -> str:
        t = self.tip()
        return t.hash if t else integrity.GENESIS

    def sealed(self, ops: DataFrame) -> DataFrame:
        return ops.withColumn("body", F.to_json(F.struct(*SEALED)))

    def commit(self, batch: list[dict[str, Any]]) -> list[int]:
        """Appends ops (op, coll, id, doc, …) as one commit; the numbers they have.

        An op whose idempotency key is known has the number of the op that came first.  A missing nonce is the
        client's last plus one; one that isn't above it raises Replay, and nothing is written.
        """
        idems = [o["idem"] for o in batch if o.get("idem") is not None]
        known = {r.idem: r.seq for r in self.ops().where(F.col("idem").isin(idems)).groupBy("idem").agg(F.min("seq").alias("seq")).collect()} if idems else {}
        clients = list({o.get("client") or "local" for o in batch})
        last = {r.client: r.n for r in self.ops().where(F.col("client").isin(clients)).groupBy("client").agg(F.max("nonce").alias("n")).collect()}
        seq, rows, out = self.seq + 1, [], []
        for o in batch:
            if o.get("idem") in known and o["idem"] is not None:
                out.append(known[o["idem"]])
                continue
            client = o.get("client") or "local"
            before = last.get(client) or 0
            nonce = o.get("nonce") if o.get("nonce") is not None else before + 1
            if nonce <= before:
                raise Replay(f"{client}: {nonce} after {before}")
            last[client] = nonce
            doc = o.get("doc")
            made = o | {"seq": seq, "client": client, "nonce": nonce, "ts": o.get("ts") or time.time(), "doc": json.dumps(doc) if isinstance(doc, dict) else doc}
            rows.append(tuple(made.get(c) for c in SCHEMA.names))
            if o.get("idem") is not None:
                known[o["idem"]] = seq
            out.append(seq)
            seq += 1
        if rows:
            ops = self.sealed(self.spark.createDataFrame(rows, SCHEMA).coalesce(1))
            chained = integrity.seal(ops, self.head).select("seq", "prev_hash", "hash")
            log.append(ops.drop("body", "prev_hash", "hash").join(F.broadcast(chained), "seq").select(*SCHEMA.names), f"{self.path}/ops")
        return out

    def load(self, docs: DataFrame, coll: str, key: str = "id") -> None:
        """Puts every row of docs, numbered in the order of key, without the driver.

        Each op is hashed for itself, without the hash before it: verify() checks its content and that no number is missing.
        """
        fields = [c for c in docs.columns if c != key]
        made = docs.select(F.lit("put").alias("op"), F.lit(coll).alias("coll"), F.col(key).alias("__key"), F.to_json(F.struct(*fields)).alias("doc"))
        self._bulk(made, "__load__")

    def _bulk(self, made: DataFrame, client: str) -> None:
        """Appends ops (op, coll, __key, doc), numbered in the order of their keys; no row passes the driver."""
        numbered = writes.assign_seq(made, self.seq + 1, "__key")
        filled = {"client": F.lit(client), "op": F.col("op"), "coll": F.col("coll"), "id": F.col("__key").cast("string"), "ts": F.lit(time.time()), "seq": F.col("seq").cast("long"), "doc": F.col("doc")}
        ops = numbered.select(*[filled.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMA])
        log.append(self.sealed(ops).withColumn("hash", blake2b(F.col("body").cast("binary"))).select(*SCHEMA.names), f"{self.path}/ops")

    def _bulk_delete(self, keys: DataFrame, client: str) -> int:
        """Deletes (coll, id) of any number; how many."""
        before = self.seq
        self._bulk(keys.select(F.lit("delete").alias("op"), "coll", F.col("id").alias("__key"), F.lit(None).cast("string").alias("doc")), client)
        return self.seq - before

    def verify(self) -> DataFrame:
        """(seq, ok): content matches its hash, the op before is there, and chained ops name its hash."""
        rows = self.sealed(self.ops()).withColumn("again", blake2b(F.concat(F.coalesce("prev_hash", F.lit("")).cast("binary"), F.col("body").cast("binary"))))
        before = self.ops().select((F.col("seq") + 1).alias("seq"), F.col("hash").alias("before"))
        first = F.when(F.col("seq") == 0, F.lit(integrity.GENESIS))
        ok = (F.col("again") == F.col("hash")) & F.coalesce("before", first).isNotNull() & (F.col("prev_hash").isNull() | (F.col("prev_hash") == F.coalesce("before", first)))
        return rows.join(before, "seq", "left").select("seq", F.coalesce(ok, F.lit(False)).alias("ok"))

    def since(self, after: int, limit: int = 10_000) -> dict:
        return feed.page(self.ops(), after, limit)

    def log(self, n: int) -> DataFrame:
        return resolve.log(self.ops(), n)

    def by_hash(self, digest: str) -> DataFrame:
        return self.ops().where(F.col("hash") == digest)

    def hash_of(self, seq: int) -> str | None:
        row = self.ops().where(F.col("seq") == seq).select("hash").first()
        return row.hash if row else None

    # writes

    def put(self, coll: str, id: str, doc: dict, *, ttl: float | None = None, **more) -> int:
        """more: client, nonce, idem, caused_by (numbers of ops), evidence, confidence, valid_from, valid_to."""
        doc = doc | ({"_expires_at": time.time() + ttl} if ttl is not None else {})
        return self.commit([{"op": "put", "coll": coll, "id": id, "doc": doc, **more}])[0]

    def put_many(self, coll: str, docs: dict[str, dict]) -> list[int]:
        return self.commit([{"op": "put", "coll": coll, "id": k, "doc": d} for k, d in docs.items()])

    def delete(self, coll: str, id: str, **more) -> int:
        return self.commit([{"op": "delete", "coll": coll, "id": id, **more}])[0]

    def link(self, frm: str, rel: str, to: str, **more) -> int:
        """frm and to are collection:id."""
        return self.commit([{"op": "link", "frm": frm, "rel": rel, "to": to, **more}])[0]

    def unlink(self, frm: str, rel: str, to: str, **more) -> int:
        return self.commit([{"op": "unlink", "frm": frm, "rel": rel, "to": to, **more}])[0]

    def expire(self, coll: str, id: str, ttl: float) -> bool:
        doc = self.get(coll, id)
        if doc is None:
            return False
        self.put(coll, id, doc, ttl=ttl)
        return True

    def sweep(self, now: float | None = None) -> int:
        """Deletes what has expired, by client __ttl__; how many documents."""
        live = resolve.as_of(self._keyed(), key="__key").withColumn("at", F.get_json_object("doc", "$._expires_at").cast("double"))
        return self._bulk_delete(live.where(F.col("at") < F.lit(now if now is not None else time.time())), "__ttl__")

    # reads

    def _keyed(self) -> DataFrame:
        return self.ops().where(F.col("op").isin("put", "delete")).withColumn("__key", F.struct("coll", "id"))

    def _versions(self, coll: str) -> DataFrame:
        return self.ops().where((F.col("coll") == coll) & F.col("op").isin("put", "delete"))

    def versions(self, coll: str) -> DataFrame:
        return typed(self._versions(coll))

    def get(self, coll: str, id: str, as_of: int | None = None, now: float | None = None) -> dict | None:
        """The document, or None; at HEAD an expired one is None as well."""
        row = resolve.get(self._versions(coll).select("seq", "op", "id", "doc"), id, as_of).first()
        doc = json.loads(row.doc) if row else None
        if doc and as_of is None and doc.get("_expires_at") is not None and doc["_expires_at"] < (now if now is not None else time.time()):
            return None
        return doc

    def history(self, coll: str, id: str) -> DataFrame:
        return resolve.history(self._versions(coll), id)

    def collections(self) -> DataFrame:
        """(coll, n): live documents of each."""
        return resolve.counts(self.ops().where(F.col("op").isin("put", "delete")))

    def edges(self) -> DataFrame:
        return graph.intervals(self.ops().where(F.col("op").isin("link", "unlink")).select("seq", "op", "frm", "rel", "to"))

    def neighbors(self, frm: str, rel: str, as_of: int | None = None) -> list[str]:
        return sorted(r[0] for r in graph.neighbors(self.edges(), frm, rel, as_of).collect())

    def inbound(self, to: str, rel: str, as_of: int | None = None) -> list[str]:
        return sorted(r[0] for r in graph.inbound(self.edges(), to, rel, as_of).collect())

    def _run(self, plan: Plan) -> DataFrame:
        if self.advisor:
            self.advisor.saw(plan)
        found = {plan.source: self.versions(plan.source)}
        edges, targets = None, {}
        if plan.traverse:
            # documents of any collection can be the target; their ids are told apart by the collection
            edges = self.edges().where((F.col("rel") == plan.traverse) & (F.substring_index("frm", ":", 1) == plan.source))
            edges = edges.withColumn("frm", F.expr("substring(frm, instr(frm, ':') + 1)"))
            reached = [r[0] for r in edges.select(F.substring_index("to", ":", 1)).distinct().collect()]  # names of collections
            if len(reached) == 1:
                edges, targets = edges.withColumn("to", F.expr("substring(to, instr(to, ':') + 1)")), {plan.traverse: reached[0]}
                found[reached[0]] = self.versions(reached[0])
            else:
                both = typed(self.ops().where(F.col("coll").isin(reached) & F.col("op").isin("put", "delete")))
                found["\0"] = both.withColumn("id", F.concat_ws(":", "coll", "id"))
                targets = {plan.traverse: "\0"}
        ops = self.ops().where(F.col("op").isin("put", "delete")) if plan.trace else None
        return lower.run(plan, Store(found, edges, targets, self.search_fields, ops=ops, typed=typed))

    def query(self, text: str) -> DataFrame:
        """A query text; after a TRAVERSE into several collections ids are collection:id."""
        return self._run(parse(text))

    def sql(self, text: str) -> DataFrame | int | None:
        """A SELECT as a DataFrame; an INSERT, UPDATE or DELETE is committed and gives the op's number.

        An UPDATE merges into the document, or makes it; a DELETE of none gives None.
        """
        got = parse_sql(text)
        if not isinstance(got, Change):
            return self._run(got)
        key, old = str(got.id), self.get(got.source, str(got.id))
        if got.kind == "delete":
            return self.delete(got.source, key) if old is not None else None
        return self.put(got.source, key, got.fields if got.kind == "insert" else (old or {}) | got.fields)

    # the document dialect

    def find(self, coll: str, query: dict | None = None, *more, **named) -> DataFrame:
        return documents.find(resolve.head(self.versions(coll)), query, *more, **named)

    def aggregate(self, coll: str, pipeline: list[dict]) -> DataFrame:
        return documents.aggregate(resolve.head(self.versions(coll)), pipeline)

    def insert_many(self, coll: str, docs: list[dict]) -> list[str]:
        """Ids are those of _id or made; one that is there already is an error, and nothing is written."""
        ids = [str(d["_id"]) if "_id" in d else uuid.uuid4().hex[:24] for d in docs]
        held = resolve.head(self._versions(coll).where(F.col("id").isin(ids)).select("seq", "op", "id")).select("id")
        if len(set(ids)) < len(ids) or not held.isEmpty():
            raise documents.DialectError("duplicate id")
        self.put_many(coll, {i: {k: v for k, v in d.items() if k != "_id"} for i, d in zip(ids, docs, strict=True)})
        return ids

    def update_many(self, coll: str, query: dict, change: dict) -> None:
        """Appends a version of each matched document that the change alters, without the driver."""
        live = resolve.head(self.versions(coll))
        changed = documents.update(live, query, change)
        self.load(changed.select("id", *[c for c in changed.columns if c not in META]), coll)

    def update_one(self, coll: str, query: dict, change: dict, upsert: bool = False) -> str | None:
        """Changes the matched document of the least id, or with upsert makes one; its id, None where none matches."""
        live = resolve.head(self.versions(coll))
        first = documents.find(live, query, sort=[("id", 1)], limit=1).select("id").first()
        if first:
            for row in documents.update(live.drop(*[c for c in META if c in live.columns and c != "id"]), {"id": first.id}, change).toJSON().collect():  # one at most
                doc = json.loads(row)
                self.put(coll, doc.pop("id"), doc)
            return first.id
        if not upsert:
            return None
        new = {k: v for k, v in query.items() if not k.startswith("$") and not isinstance(v, dict)}
        for op in ("$set", "$setOnInsert", "$inc", "$min", "$max"):
            new |= change.get(op, {})
        new |= {k: v if isinstance(v, list) else [v] for k, v in change.get("$push", {}).items()}
        new |= {k: 0 for k in change.get("$mul", {})} | {k: v for k, v in change.items() if not k.startswith("$")}
        key = str(new.pop("_id", uuid.uuid4().hex[:24]))
        self.put(coll, key, nested(new))
        return key

    def replace_one(self, coll: str, query: dict, doc: dict, upsert: bool = False) -> str | None:
        if any(k.startswith("$") for k in doc):
            raise documents.DialectError("a replacement has no operators")
        first = self.find_one(coll, query)
        if first is None and not upsert:
            return None
        key = first["_id"] if first else str(doc.get("_id", query.get("_id", uuid.uuid4().hex[:24])))
        self.put(coll, key, {k: v for k, v in doc.items() if k != "_id"})
        return key

    def find_one(self, coll: str, query: dict | None = None) -> dict | None:
        """The matched document of the least id, with it as _id."""
        row = self.find(coll, query, sort=[("id", 1)], limit=1).select("id").first()
        return {"_id": row.id} | self.get(coll, row.id) if row else None

    def count_documents(self, coll: str, query: dict | None = None) -> int:
        return self.find(coll, query).count()

    def delete_one(self, coll: str, query: dict) -> int:
        row = self.find(coll, query, sort=[("id", 1)], limit=1).select("id").first()
        if row:
            self.delete(coll, row.id)
        return int(row is not None)

    def delete_many(self, coll: str, query: dict) -> int:
        return self._bulk_delete(self.find(coll, query).select(F.lit(coll).alias("coll"), "id"), "__bulk__")

    def drop(self, coll: str) -> int:
        """Deletes every document of a collection; its history stays."""
        return self.delete_many(coll, {})

    # files

    def put_file(self, name: str, data: bytes, tier: str = "warm") -> str:
        """Stores a new version of a file as chunks, each once, and logs its root; the root."""
        version = 1 + (self.file_versions(name).agg(F.max("version")).first()[0] or 0)
        pieces = files.cut(self.spark.createDataFrame([(name, version, bytearray(data))], "name string, version long, data binary"), tier)
        pieces = resolve.checkpointed(pieces)
        held = self._table("chunks", "hash string, packed binary")
        files.store(pieces, held.select("hash")).write.mode("append").parquet(f"{self.path}/chunks")
        made = files.recipes(pieces).withColumn("tier", F.lit(tier))
        made.write.mode("append").parquet(f"{self.path}/recipes")
        root = made.first().root
        self.commit([{"op": "put_file", "coll": "__files__", "id": name, "doc": {"version": version, "root": root, "size": len(data)}}])
        return root

    def _table(self, name: str, schema: str) -> DataFrame:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if there else self.spark.createDataFrame([], schema)

    def file_versions(self, name: str) -> DataFrame:
        return self._table("recipes", "name string, version long, recipe array<string>, root string, tier string").where(F.col("name") == name)

    def get_file(self, name: str, version: int | None = None) -> bytes | None:
        rows = self.file_versions(name)
        row = (rows if version is None else rows.where(F.col("version") == version)).orderBy(F.desc("version")).first()
        if row is None:
            return None
        recipe = self.spark.createDataFrame([(name, row.version, row.recipe)], "name string, version long, recipe array<string>")
        got = files.restore(recipe, self._table("chunks", "hash string, packed binary"), row.tier).first()
        return bytes(got.data) if got else None

    def file_proof(self, name: str, version: int, chunk: int) -> dict:
        """What shows that a chunk is in a version: its hash, its siblings, and the root."""
        row = self.file_versions(name).where(F.col("version") == version).first()
        return {"leaf": row.recipe[chunk], "proof": integrity.merkle_proof(list(row.recipe), chunk), "root": row.root}

    # upkeep

    def checkpoint(self) -> int:
        """Logs a checkpoint and writes HEAD beside the log; the checkpoint's number."""
        at = self.commit([{"op": "checkpoint"}])[0]
        log.write_snapshot(resolve.as_of(self._keyed(), at, "__key").drop("__key"), at, f"{self.path}/snapshot")
        return at

    def checkpoint_if_due(self, minutes: int, now: float | None = None) -> int | None:
        """A checkpoint, unless one was made since the clock last passed a multiple of so many minutes; its number, or None."""
        last = self.ops().where("op = 'checkpoint'").agg(F.max("ts")).first()[0]
        now = now if now is not None else time.time()
        return self.checkpoint() if last is None or last // (60 * minutes) < now // (60 * minutes) else None

    def head_from_snapshot(self) -> DataFrame:
        """HEAD of all collections from the last checkpoint and the ops after it."""
        held = self.spark.read.parquet(f"{self.path}/snapshot")
        at = held.agg(F.max("checkpoint_seq")).first()[0]
        if at is None:
            return resolve.as_of(self._keyed(), key="__key").drop("__key")
        held = held.drop("checkpoint_seq").withColumn("__key", F.struct("coll", "id"))
        return writes.snapshot_plus_delta(held, at, self._keyed(), "__key").drop("__key")

    def export(self, path: str, coll: str | None = None) -> None:
        """Live documents as JSON lines."""
        live = resolve.as_of(self._keyed() if coll is None else self._keyed().where(F.col("coll") == coll), key="__key")
        log.export_json(live.select("coll", "id", "seq", "doc"), path)

    def compact(self, path: str) -> dict:
        """A database at path with the live documents and links only, numbered anew; how many ops there were and are."""
        new = Database(self.spark, path, self.search_fields, self.advisor)
        live = resolve.as_of(self._keyed(), key="__key").select(F.lit("put").alias("op"), "coll", F.col("id").alias("__key"), "doc")
        new._bulk(live, "__compact__")
        links = graph.live(self.edges()).select("frm", "rel", "to")
        n = new.seq + 1
        numbered = writes.assign_seq(links.withColumn("k", F.concat_ws("|", "frm", "rel", "to")), n, "k")
        filled = {"client": F.lit("__compact__"), "op": F.lit("link"), "ts": F.lit(time.time()), **{c: F.col(c) for c in ("seq", "frm", "rel", "to")}}
        ops = numbered.select(*[filled.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMA])
        log.append(self.sealed(ops).withColumn("hash", blake2b(F.col("body").cast("binary"))).select(*SCHEMA.names), f"{new.path}/ops")
        before, after = self.seq + 1, new.seq + 1
        return {"before": before, "after": after, "dropped": before - after}

    def heal(self, path: str) -> Database:
        """A database at path with the same ops, chained anew, if each op's content is whole; else an error.

        Chaining is one ordered task: a job for a log whose links broke, not for every day.
        """
        ops = self.sealed(self.ops())
        whole = blake2b(F.concat(F.coalesce("prev_hash", F.lit("")).cast("binary"), F.col("body").cast("binary"))) == F.col("hash")
        if not ops.select(whole.alias("ok")).where("not coalesce(ok, false)").isEmpty():
            raise ValueError("an op's content doesn't match its hash")
        healed = Database(self.spark, path, self.search_fields, self.advisor)
        chained = integrity.seal(ops).select("seq", "prev_hash", "hash")
        log.append(self.ops().drop("prev_hash", "hash").join(chained, "seq").select(*SCHEMA.names), f"{healed.path}/ops")
        return healed
