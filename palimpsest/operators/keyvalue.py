"""The key-value dialect as views of a log of commands: strings, counters, hashes, sets and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.values import glob, id_part
from palimpsest.operators import graph, resolve

#: Fixed: the commands that the dialect refuses.
REFUSED = frozenset(
    """EXPIRE EXPIREAT EXPIRETIME PEXPIRE PEXPIREAT TTL PTTL PERSIST SUBSCRIBE UNSUBSCRIBE PSUBSCRIBE PUNSUBSCRIBE PUBLISH PUBSUB
    MULTI EXEC DISCARD WATCH UNWATCH WAIT OBJECT DEBUG MONITOR SLOWLOG CLUSTER REPLICAOF SLAVEOF BGSAVE BGREWRITEAOF LASTSAVE SAVE
    RESTORE DUMP MIGRATE MOVE SORT EVAL EVALSHA SCRIPT GEORADIUSBYMEMBER GEOADD GEODIST GEOPOS XADD XREAD XLEN XRANGE BF.ADD CF.ADD""".split()
)


class Refused(ValueError):
    """A command that a log of documents doesn't have."""


def check(command: str) -> str:
    if command.upper() in REFUSED:
        raise Refused(command.upper())
    return command.upper()


def strings(ops: DataFrame) -> DataFrame:
    """ops (seq, op, id, value) -> live keys (GET, MGET, EXISTS, DBSIZE are filters and counts of it)."""
    return resolve.head(ops)


def keys(live: DataFrame, pattern: str) -> DataFrame:
    return live.where(glob(F.col("id"), pattern)).select("id")


def counters(ops: DataFrame) -> DataFrame:
    """INCRBY and DECRBY as a fold: (id, value) from ops (seq, id, delta), a null delta resets to 0."""
    resets = ops.where("delta is null").groupBy("id").agg(F.max("seq").alias("since"))
    live = ops.join(resets, "id", "left").where(F.col("since").isNull() | (F.col("seq") > F.col("since")))
    return live.groupBy("id").agg(F.sum("delta").alias("value"))


def hashes(ops: DataFrame) -> DataFrame:
    """HGETALL as rows: ops (seq, op, coll, id, value) with the hash's key in coll and the field in id."""
    newest = Window.partitionBy("coll", "id").orderBy(F.desc("seq"))
    return ops.withColumn("__n", F.row_number().over(newest)).where("__n = 1 AND op = 'put'").select("coll", "id", "value")


def hash_maps(ops: DataFrame) -> DataFrame:
    return hashes(ops).groupBy("coll").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", "value")))).alias("fields"))


def members(events: DataFrame, key) -> DataFrame:
    """SMEMBERS: events (seq, op link/unlink, frm, rel, to)."""
    return graph.live(graph.intervals(events)).where(F.col("frm") == key).select(F.col("to").alias("member"))


def union(*sets: DataFrame) -> DataFrame:
    out = sets[0]
    for s in sets[1:]:
        out = out.union(s)
    return out.distinct()


def inter(*sets: DataFrame) -> DataFrame:
    out = sets[0]
    for s in sets[1:]:
        out = out.intersect(s)
    return out


def diff(*sets: DataFrame) -> DataFrame:
    out = sets[0]
    for s in sets[1:]:
        out = out.subtract(s)
    return out


def lists(pushes: DataFrame) -> DataFrame:
    """LRANGE: pushes (id, side L or R, seq, value) -> (id, pos, value); a later LPUSH stands further left."""
    place = F.when(F.col("side") == "L", -F.col("seq") - 1).otherwise(F.col("seq"))
    return pushes.withColumn("pos", F.row_number().over(Window.partitionBy("id").orderBy(place)) - 1).select("id", "pos", "value")


def register(pairs: DataFrame, pattern: str, coll: str) -> DataFrame:
    """Existing (key, value) pairs as documents: ids are what follows the last colon, values JSON objects or {"_v": value}."""
    value = F.when(F.try_parse_json("value").isNotNull() & F.col("value").rlike(r"^\s*\{"), F.col("value")).otherwise(F.to_json(F.struct(F.col("value").alias("_v"))))
    return pairs.where(glob(F.col("key"), pattern)).select(F.lit(coll).alias("coll"), id_part(F.col("key")).alias("id"), value.alias("doc"))
