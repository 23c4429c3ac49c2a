"""Rows over their life: creation, updates, access, codecs, documents, signatures, registries, vectors, throttles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_BYTES = 51200
#: Fixed value: the greatest access count.
MOST_ACCESSES = 2**32 - 1


def created(rows: DataFrame, now: int, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """New memory rows with an id, times and counters, and the rows that are too large."""
    fits = F.octet_length("content") <= max_bytes
    empty = F.array().cast("array<string>")
    made = rows.where(fits).withColumns({
        "id": F.expr("uuid()"), "superseded_by": F.lit(None).cast("string"), "contradicts": empty, "parent_id": F.lit(None).cast("string"), "caused_by": empty, "enables": empty,
        "created_at": F.lit(now), "updated_at": F.lit(now), "access_count": F.lit(0).cast("long"), "last_accessed_at": F.lit(None).cast("int"),
    })
    return made, rows.where(~fits)


def updated(rows: DataFrame, new: DataFrame, now: int, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Rows with the new contents (id, content) that are not too large, and their time."""
    fresh = new.where(F.octet_length("content") <= max_bytes).select("id", F.col("content").alias("_new"))
    hit = F.col("_new").isNotNull()
    return rows.join(fresh, "id", "left").withColumns({"content": F.coalesce("_new", "content"), "updated_at": F.when(hit, F.lit(now)).otherwise(F.col("updated_at"))}).drop("_new")


def accessed(rows: DataFrame, reads: DataFrame, now: int) -> DataFrame:
    """Rows with their reads (id, once for each read) counted, up to MOST_ACCESSES, and the time of the last."""
    n = reads.groupBy("id").agg(F.count("*").alias("_n"))
    count = F.least(F.col("access_count") + F.coalesce("_n", F.lit(0)), F.lit(MOST_ACCESSES))
    return rows.join(n, "id", "left").withColumns({"access_count": count, "last_accessed_at": F.when(F.col("_n").isNotNull(), F.lit(now)).otherwise(F.col("last_accessed_at"))}).drop("_n")


def compressed(rows: DataFrame, level: int = 3) -> DataFrame:
    """(id, data, size, ratio): each row's JSON as one Zstandard frame."""
    import zstandard

    def run(parts):
        codec = zstandard.ZstdCompressor(level=level)
        for pdf in parts:
            raw = [x.encode() for x in pdf["json"]]
            data = [codec.compress(x) for x in raw]
            yield pd.DataFrame({"id": pdf["id"], "data": data, "size": [len(x) for x in raw], "ratio": [len(a) / len(b) for a, b in zip(raw, data)]})

    return rows.select("id", F.to_json(F.struct("*")).alias("json")).mapInPandas(run, "id string, data binary, size long, ratio double")


def decompressed(rows: DataFrame, schema: str) -> DataFrame:
    """The rows of compressed()."""
    import zstandard

    def run(parts):
        codec = zstandard.ZstdDecompressor()
        for pdf in parts:
            yield pd.DataFrame({"json": [codec.decompress(bytes(x)).decode() for x in pdf["data"]]})

    return rows.select("data").mapInPandas(run, "json string").select(F.from_json("json", schema).alias("r")).select("r.*")


def export_documents(rows: DataFrame, group: str, version: str = "1") -> DataFrame:
    """One JSON document for each group (of a size that a row holds): its version and its rows' content by id."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", "content"))))
    return rows.groupBy(group).agg(F.to_json(F.struct(F.lit(version).alias("version"), entries.alias("entries"))).alias("document"))


def import_documents(documents: DataFrame) -> DataFrame:
    """(id, content) of documents that have a version and a body; others give nothing."""
    doc = F.from_json("document", "version string, entries map<string, string>")
    return documents.select(doc.alias("d")).where("d.version is not null and d.entries is not null").select(F.explode("d.entries").alias("id", "content"))


def pulled(primary: DataFrame, cache: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """The primary table after it took over what the cache has newer or alone, and one row of counts."""
    both = primary.withColumn("_s", F.lit(0)).unionByName(cache.withColumn("_s", F.lit(1)))
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), "_s"))
    won = both.withColumn("_r", first).where("_r = 1").drop("_r")
    return won.drop("_s"), won.agg(F.count("*").alias("rows"), F.count_if(F.col("_s") == 1).alias("pulled"))


def pushed(primary: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """The cache after all rows of the primary table were put into it: they replace those of equal keys, whatever is newer
    there, and what only the cache has stays. Of the primary's rows with one key any may be taken, as keys are unique there."""
    return cache.join(primary.select(*keys), keys, "left_anti").unionByName(primary)


def written_through(primary: DataFrame, cache: DataFrame, writes: DataFrame, keys: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """Both tables after writes, each of which replaces the row of its keys in both; of several writes to one key the last by
    order holds. Nulls are no keys: such writes are left out."""
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    new = writes.dropna(subset=keys).withColumn("_r", last).where("_r = 1").drop("_r", order)
    return pushed(new, primary, keys), pushed(new, cache, keys)


def registry(log: DataFrame) -> DataFrame:
    """By user the registered workspaces, sorted, and the active one after a log of register, unregister and activate
    (user, seq, op, workspace): the first becomes active while none is; an unregistered one is active no more."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        known, active = set(), None
        for op, w in pdf.sort_values("seq", kind="stable")[["op", "workspace"]].itertuples(index=False):
            if op == "register":
                known.add(w)
                active = active or w
            elif op == "unregister":
                known.discard(w)
                active = None if active == w else active
            elif w in known:
                active = w
        return pd.DataFrame({"user": [pdf["user"].iloc[0]], "workspaces": [",".join(sorted(known))], "active": [active]})

    return log.groupBy("user").applyInPandas(fold, "user long, workspaces string, active string")


def checkpoint(rows: DataFrame, store: DataFrame, name: str) -> DataFrame:
    """The store of checkpoints (name, key, value) with the rows (key, value) as that of this name."""
    return store.where(F.col("name") != name).unionByName(rows.select(F.lit(name).alias("name"), "key", "value"))


def restore(rows: DataFrame, store: DataFrame, name: str) -> DataFrame:
    """The rows of a checkpoint over those that are there; without one, these."""
    saved = store.where(F.col("name") == name).select("key", F.col("value").alias("_v"))
    return rows.join(saved, "key", "full_outer").select("key", F.coalesce("_v", "value").alias("value"))


# --- signatures and sealed payloads ----------------------------------------------------------------------------


def _block(key: bytes, pad: int) -> bytes:
    import hashlib

    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    return bytes(b ^ pad for b in key.ljust(64, b"\0"))


def signed(message: Column, key: bytes) -> Column:
    """HMAC-SHA-256 as lower-case hex: two hashes, each over a block of the key and what is inside."""
    inner = F.sha2(F.concat(F.lit(_block(key, 0x36)), message.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(_block(key, 0x5C)), F.unhex(inner)), 256)


def verified(message: Column, signature: Column, key: bytes) -> Column:
    return signed(message, key) == signature


def sealed(message: Column, secret: str) -> Column:
    """Authenticated encryption under the secret's SHA-256, a random nonce before each payload, as base64."""
    return F.base64(F.aes_encrypt(message, F.unhex(F.sha2(F.lit(secret), 256)), F.lit("GCM")))


def opened(payload: Column, secret: str) -> Column:
    """The message of a payload; null where it was changed."""
    return F.try_aes_decrypt(F.unbase64(payload), F.unhex(F.sha2(F.lit(secret), 256)), F.lit("GCM")).cast("string")


def fingerprints(content: Column, prefix: int = 16) -> dict[str, Column]:
    """A 64-bit hash, a SHA-256, and the latter's prefix for ids."""
    full = F.sha2(content, 256)
    return {"hash64": F.xxhash64(content), "sha256": full, "short": F.left(full, F.lit(prefix))}


# --- vectors ---------------------------------------------------------------------------------------------------


def upsert_vectors(vectors: DataFrame, new: DataFrame, dimension: int) -> DataFrame:
    """Vectors (id, vector, hash) with the new ones of the right dimension in place of those of their ids."""
    good = new.where(F.size("vector") == dimension)
    return vectors.join(good.select("id"), "id", "left_anti").unionByName(good)


def remove_vectors(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    return vectors.join(ids.select("id").distinct(), "id", "left_anti")


def stand_in_vector(text: Column, dimension: int) -> Column:
    """A unit vector that depends on the text alone, for rows without a model's: digits of its hash, centred."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.conv(F.substring(F.sha2(F.concat(text, F.lit(":"), i.cast("string")), 256), 1, 4), 16, 10).cast("double") / 32767.5 - 1)
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(raw, lambda x: x / norm)


# --- throttles and caches --------------------------------------------------------------------------------------


def throttled(writes: DataFrame, window: int) -> DataFrame:
    """Of each key's writes (key, sec, ...) those that a throttle of so many seconds lets through: one if the last that
    went through is at least that long ago."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, keep, last = pdf.sort_values(["sec", "seq"], kind="stable"), [], None
        for t in pdf["sec"]:
            keep.append(last is None or t - last >= window)
            last = t if keep[-1] else last
        return pdf[keep]

    return writes.groupBy("key").applyInPandas(fold, writes.schema)


def cached_reads(reads: DataFrame, ttl: int) -> DataFrame:
    """Reads (key, sec, seq) with whether a cache serves them: the last fill is less than ttl seconds ago."""
    fills = throttled(reads, ttl).select("key", "seq", F.lit(False).alias("_hit"))
    return reads.join(fills, ["key", "seq"], "left").withColumn("hit", F.coalesce("_hit", F.lit(True))).drop("_hit")


