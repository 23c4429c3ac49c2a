"""Memory rows: lookups, upserts, validation, relations, merges and rule scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What secrets look like.
SECRETS = (
    r"""(?i)(api[_-]?key|secret[_-]?key|access[_-]?token)["']?\s*[:=]\s*["']?[a-zA-Z0-9_\-]{20,}""",
    r"""(?i)password\s*[:=]\s*["'][^"']+""",
    r"""(?i)(private[_-]?key|PRIVATE[_-]?KEY)["']?\s*[:=]\s*""",
    r"-----BEGIN\s+(RSA\s+)?PRIVATE\s+KEY-----",
    r"ghp_[a-zA-Z0-9]{36}",
    r"sk-[a-zA-Z0-9]{48}",
    r"sq0csp-[a-zA-Z0-9\-]{43}",
    r"sk_live_[a-zA-Z0-9]{24,}",
)

#: Security rules as (id, pattern, severity).
SECURITY = (
    ("hardcoded-secret", r"""(?i)(api[_-]?key|secret|token|password)\s*[:=]\s*['"][A-Za-z0-9_\-]{8,}['"]""", "critical"),
    ("unsafe-eval", r"\beval\s*\(|\bexec\s*\(", "critical"),
    ("sql-concatenation", r"""(?i)(select|insert|update|delete).*(\\+|format!\(|f\")""", "warning"),
    ("env-exposure", r"process\.env\.[A-Z0-9_]+|std::env::var\(", "info"),
)


def has_secret(content: Column) -> Column:
    return reduce(lambda e, p: e | content.rlike(p), SECRETS, F.lit(False))


def redact(content: Column) -> Column:
    return reduce(lambda e, p: F.regexp_replace(e, p, "[REDACTED]"), SECRETS, content)


def validated(rows: DataFrame, max_bytes: int = 51200, max_tags: int = 20) -> DataFrame:
    """Rows with the first reason why they are invalid, null where none is."""
    reason = (
        F.when(F.coalesce(F.length("content"), F.lit(0)) == 0, "empty").when(F.octet_length("content") > max_bytes, "too large").when(F.size("tags") > max_tags, "too many tags").when(has_secret(F.col("content")), "secret")
    )
    return rows.withColumn("reason", reason)


def valid_project(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z0-9_.-]{1,100}$")


def newest(rows: DataFrame, limit: int | None = None) -> DataFrame:
    out = rows.orderBy(F.desc("updated_h"), "id")
    return out.limit(limit) if limit else out


def search(rows: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Case-blind LIKE over content or id; wildcards of the query count."""
    like = f"%{query.lower()}%"
    return newest(rows.where(F.lower("content").like(like) | F.lower("id").like(like)), limit)


def upsert(rows: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Both tables with the last row of each key by order; of ties the new one."""
    both = rows.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("_new")))
    return both.withColumn("_r", last).where("_r = 1").drop("_r", "_new")


def evict(rows: DataFrame, group: str, capacity: int) -> DataFrame:
    """The rows of each group that a capacity keeps: the newest."""
    r = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("updated_h"), "id"))
    return rows.withColumn("_r", r).where(F.col("_r") <= capacity).drop("_r")


def delete(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select("id").distinct(), "id", "left_anti")


def delete_prefix(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.where(~F.col("id").startswith(prefix))


def apply_batch(rows: DataFrame, upserts: DataFrame, deletes: DataFrame, order: str = "updated_h") -> tuple[DataFrame, DataFrame]:
    """The table after a batch, and its acknowledgement: accepted, rejected, deleted."""
    checked = validated(upserts)
    good = checked.where("reason is null").drop("reason")
    gone = rows.join(deletes.select("id").distinct(), "id", "left_semi")
    ack = checked.agg(F.count_if(F.col("reason").isNull()).alias("accepted"), F.count_if(F.col("reason").isNotNull()).alias("rejected")).join(gone.agg(F.count("*").alias("deleted")))
    return upsert(delete(rows, deletes), good, ["id"], order), ack


def prune_warnings(rows: DataFrame, prefix: str, keep: int, oldest: int) -> DataFrame:
    """Rows without those of a prefix that are beyond keep or older than oldest."""
    mine = rows.where(F.col("id").startswith(prefix))
    kept = mine.orderBy(F.desc("created_h"), "id").limit(keep).where(F.col("created_h") >= oldest)
    return rows.where(~F.col("id").startswith(prefix)).unionByName(kept)


def relation_edges(rows: DataFrame) -> DataFrame:
    """(src, dst, relation) of all relation columns; both ends must be there."""
    one = rows.where("superseded_by is not null").select(F.col("id").alias("src"), F.col("superseded_by").alias("dst"), F.lit("superseded_by").alias("relation"))
    parent = rows.where("parent_id is not null").select(F.col("id").alias("src"), F.col("parent_id").alias("dst"), F.lit("parent").alias("relation"))
    out = one.unionAll(parent)
    for c in ("contradicts", "caused_by", "enables"):
        out = out.unionAll(rows.select(F.col("id").alias("src"), F.explode(c).alias("dst"), F.lit(c).alias("relation")))
    ids = rows.select("id")
    return out.distinct().join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "relation")


def findings(rows: DataFrame, rules=SECURITY) -> DataFrame:
    """Each match of each rule: id, rule, severity, snippet. Rules are expressions of one scan, not a join."""
    found = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(s).alias("severity"), F.regexp_extract_all("content", F.lit(p), F.lit(0)).alias("m")) for i, p, s in rules])
    return rows.select("id", F.explode(found).alias("f")).select("id", F.col("f.rule").alias("rule"), F.col("f.severity").alias("severity"), F.explode("f.m").alias("snippet"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, change): added, removed or modified by body."""
    o, n = old.select("key", F.col("body").alias("a")), new.select("key", F.col("body").alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "modified")
    return o.join(n, "key", "full_outer").select("key", change.alias("change")).where("change is not null")


def breaking(old: DataFrame, new: DataFrame) -> DataFrame:
    """Keys whose signature head changed by more than visibility or async words."""
    head = lambda c: F.trim(F.regexp_replace(F.get(F.split(F.col(c), " "), F.lit(0)), r"^(pub|export|async)\s+", ""))
    both = old.select("key", F.col("body").alias("a")).join(new.select("key", F.col("body").alias("b")), "key").where("a <> b and length(a) > 0 and length(b) > 0")
    return both.select("key", head("a").alias("old_head"), F.concat(head("b"), F.when(F.col("b").endswith("!"), F.lit("!")).otherwise(F.lit(""))).alias("new_head")).where("old_head <> new_head")


def merge_remote(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(key, side, conflict): the newer version wins, of equal versions the remote; unequal bodies of equal or
    older remote versions are conflicts."""
    a = local.select("key", F.col("body").alias("a"), F.col("version").alias("va"))
    b = remote.select("key", F.col("body").alias("b"), F.col("version").alias("vb"))
    side = F.when(F.col("va").isNull() | (F.col("vb") >= F.col("va")), "remote").otherwise("local")
    conflict = F.coalesce((F.col("a") != F.col("b")) & (F.col("vb") <= F.col("va")), F.lit(False))
    return a.join(b, "key", "full_outer").select("key", side.alias("side"), conflict.alias("conflict"))


def publishable(rows: DataFrame, published: DataFrame) -> DataFrame:
    """Rows whose fingerprint (over their sorted normal form) was not published."""
    mark = F.sha2(F.concat_ws("\x1f", F.col("key").cast("string"), "name", "body"), 256)
    return rows.withColumn("fingerprint", mark).join(published.select(mark.alias("fingerprint")), "fingerprint", "left_anti").select("key")


def new_dependencies(old: DataFrame, new: DataFrame) -> DataFrame:
    """Names that are new or of another version."""
    before = old.select("key", F.col("version").alias("v"))
    return new.join(before, "key", "left").where("v is null or v <> version").select("key", "version")
