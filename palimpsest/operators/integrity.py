"""Hash chains, Merkle roots and inclusion proofs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.values import blake2b, digest

GENESIS = "0" * 64
#: Ops of a commit, at most.
COMMIT_OPS = 512


def seal(ops: DataFrame, prev: str = GENESIS) -> DataFrame:
    """ops (seq, body) of one commit -> with prev_hash and hash.  Each hash needs the one before: one ordered task.

    Commits are batches of bounded size; a bulk load seals its files apart and chains their roots.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = prev
        for rows in batches:
            prevs, hashes = [], []
            for body in rows["body"]:
                prevs.append(last)
                last = digest(last.encode() + body.encode())
                hashes.append(last)
            yield rows.assign(prev_hash=prevs, hash=hashes)

    return ops.select("seq", "body").orderBy("seq").coalesce(1).mapInPandas(fold, "seq long, body string, prev_hash string, hash string")


def verify(sealed: DataFrame) -> DataFrame:
    """(seq, ok) of each op, in parallel: its own hash, and that it names the hash before it."""
    own = F.concat(F.col("prev_hash").cast("binary"), F.col("body").cast("binary"))
    rows = sealed.select("seq", "prev_hash", "hash", blake2b(own).alias("again"))
    before = sealed.select((F.col("seq") + 1).alias("seq"), F.col("hash").alias("before"))
    joined = rows.join(before, "seq", "left")
    ok = (F.col("again") == F.col("hash")) & (F.col("prev_hash") == F.coalesce("before", F.lit(GENESIS)))
    return joined.select("seq", F.coalesce(ok, F.lit(False)).alias("ok"))


def seal_commits(ops: DataFrame, size: int = COMMIT_OPS) -> tuple[DataFrame, DataFrame]:
    """ops (seq, body) in commits of size numbers, sealed side by side; and the commits' last hashes, sealed as a chain."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows, last = rows.sort_values("seq"), GENESIS
        prevs, hashes = [], []
        for body in rows["body"]:
            prevs.append(last)
            last = digest(last.encode() + body.encode())
            hashes.append(last)
        return rows.assign(prev_hash=prevs, hash=hashes)

    own = ops.select(F.floor(F.col("seq") / size).cast("long").alias("commit"), "seq", "body")
    sealed = own.groupBy("commit").applyInPandas(fold, "commit long, seq long, body string, prev_hash string, hash string")
    return sealed, seal(sealed.groupBy("commit").agg(F.max_by("hash", "seq").alias("body")).withColumnRenamed("commit", "seq"))


def verify_commits(sealed: DataFrame, heads: DataFrame, size: int = COMMIT_OPS) -> DataFrame:
    """(seq, ok) of each op: in its commit's chain, which ends as the chain of commits says.  A commit without ops is one row, not ok."""
    own = F.concat(F.col("prev_hash").cast("binary"), F.col("body").cast("binary"))
    rows = sealed.select("commit", "seq", "prev_hash", "hash", blake2b(own).alias("again"))
    before = sealed.select("commit", (F.col("seq") + 1).alias("seq"), F.col("hash").alias("before"))
    linked = (F.col("again") == F.col("hash")) & (F.col("prev_hash") == F.coalesce("before", F.lit(GENESIS)))
    rows = rows.join(before, ["commit", "seq"], "left").select("commit", "seq", linked.alias("linked"))
    ends = sealed.groupBy("commit").agg(F.max_by("hash", "seq").alias("end"))
    named = heads.join(verify(heads), "seq").select(F.col("seq").alias("commit"), F.col("body").alias("root"), F.col("ok").alias("chained"))
    commits = named.join(ends, "commit", "full").select("commit", (F.col("chained") & (F.col("root") == F.col("end"))).alias("whole"))
    joined = rows.join(commits, "commit", "right")
    return joined.select(F.coalesce("seq", F.col("commit") * size).alias("seq"), F.coalesce(F.col("linked") & F.col("whole"), F.lit(False)).alias("ok"))


def tampered(sealed: DataFrame) -> DataFrame:
    return verify(sealed).where("not ok").select("seq")


def head_hash(sealed: DataFrame) -> DataFrame:
    return sealed.agg(F.max_by("hash", "seq").alias("head"), F.max("seq").alias("seq"))


def same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two states hold the same rows."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def pair(a: str, b: str) -> str:
    return digest(bytes.fromhex(a) + bytes.fromhex(b))


def merkle_levels(leaves: list[str]) -> list[list[str]]:
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        row = levels[-1]
        row = row + row[-1:] * (len(row) % 2)  # an odd leaf pairs with itself
        levels.append([pair(row[i], row[i + 1]) for i in range(0, len(row), 2)])
    return levels


def merkle_root(leaves: list[str]) -> str:
    return merkle_levels(leaves)[-1][0] if leaves else digest(b"")


def merkle_proof(leaves: list[str], at: int) -> list[tuple[str, str]]:
    """(side, sibling) from leaf to root."""
    out = []
    for row in merkle_levels(leaves)[:-1]:
        row = row + row[-1:] * (len(row) % 2)
        out.append(("L" if at % 2 else "R", row[at ^ 1]))
        at //= 2
    return out


def merkle_verify(leaf: str, proof: list[tuple[str, str]], root: str) -> bool:
    for side, other in proof:
        leaf = pair(other, leaf) if side == "L" else pair(leaf, other)
    return leaf == root


@F.pandas_udf(T.StringType())
def merkle_root_of(recipes: pd.Series) -> pd.Series:
    return recipes.map(lambda r: None if r is None else merkle_root(list(r)))


def inclusion_proof(sealed: DataFrame, seq: int) -> dict:
    """What shows that an op is in the chain: its body, the hash before it, and the later bodies' fold to the head."""
    row = sealed.where(F.col("seq") == seq).first()
    later = [r.body for r in sealed.where(F.col("seq") > seq).orderBy("seq").select("body").toLocalIterator()]
    return {"seq": seq, "body": row.body, "prev_hash": row.prev_hash, "later": later}


def proof_holds(proof: dict, head: str) -> bool:
    last = digest(proof["prev_hash"].encode() + proof["body"].encode())
    for body in proof["later"]:
        last = digest(last.encode() + body.encode())
    return last == head


def derived_key(secret: bytes, salt: bytes, info: bytes, size: int = 32) -> bytes:
    """HKDF with SHA-256."""
    import hmac

    step = hmac.new(salt or b"\0" * 32, secret, hashlib.sha256).digest()
    out, block, n = b"", b"", 1
    while len(out) < size:
        block = hmac.new(step, block + info + bytes([n]), hashlib.sha256).digest()
        out, n = out + block, n + 1
    return out[:size]


def wrap_key(spark: SparkSession, key: bytes, master: bytes, aad: str = "") -> dict:
    """A data key under a master key (AES-256-GCM): nonce, and ciphertext with its tag, in hexadecimal."""
    sealed = encrypted(spark.createDataFrame([(bytearray(key),)], "k binary"), "k", master, aad).first().k
    return {"v": 1, "alg": "AES-256-GCM", "n": bytes(sealed[:12]).hex(), "ct": bytes(sealed[12:]).hex()}


def unwrap_key(spark: SparkSession, wrapped: dict, master: bytes, aad: str = "") -> bytes:
    """The data key; another master key, or a changed one, is an error."""
    sealed = bytearray.fromhex(wrapped["n"] + wrapped["ct"])
    k = F.unhex(F.lit(master.hex()))
    opened = F.aes_decrypt("k", k, F.lit("GCM"), F.lit("DEFAULT"), F.lit(aad))
    return bytes(spark.createDataFrame([(sealed,)], "k binary").select(opened.alias("k")).first().k)


def rewrap_key(spark: SparkSession, wrapped: dict, old: bytes, new: bytes, aad: str = "") -> dict:
    """The same data key under another master key: no data changes."""
    return wrap_key(spark, unwrap_key(spark, wrapped, old, aad), new, aad)


@F.pandas_udf(T.StringType())
def cut_digest(data: pd.Series) -> pd.Series:
    """The first 32 bytes of BLAKE2b-512, in hexadecimal; not the same as BLAKE2b-256."""
    return data.map(lambda x: None if x is None else hashlib.blake2b(bytes(x)).hexdigest()[:64])


def running_head(ops: DataFrame, head: str = "") -> DataFrame:
    """The head (seq, head) after ops (seq, hash) in their order: the cut digest of head, number (8 bytes, little-endian) and hash.

    Each step needs the one before: one ordered task, of a number and a hash an op.  No row for no ops.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, seq = head, None
        for rows in batches:
            for seq, h in zip(rows["seq"], rows["hash"], strict=True):
                last = hashlib.blake2b(last.encode() + int(seq).to_bytes(8, "little") + h.encode()).hexdigest()[:64]
        if seq is not None:
            yield pd.DataFrame({"seq": [seq], "head": [last]})

    return ops.select("seq", "hash").orderBy("seq").coalesce(1).mapInPandas(fold, "seq long, head string")


def encrypted(docs: DataFrame, column: str, key: bytes, aad: str = "") -> DataFrame:
    k = F.unhex(F.lit(key.hex()))
    return docs.withColumn(column, F.aes_encrypt(F.col(column).cast("binary"), k, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), F.lit(aad)))


def decrypted(docs: DataFrame, column: str, key: bytes, aad: str = "") -> DataFrame:
    k = F.unhex(F.lit(key.hex()))
    return docs.withColumn(column, F.aes_decrypt(F.col(column), k, F.lit("GCM"), F.lit("DEFAULT"), F.lit(aad)).cast("string"))
