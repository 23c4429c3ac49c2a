"""Replicated operation logs and registers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def publish(rows: DataFrame, published: DataFrame, last_seq: int, keep: int = 5000) -> DataFrame:
    """New operations: rows whose fingerprint was not published, numbered on from last_seq, of which the last keep
    stay. Numbers come from a sort over partitions: counts before a partition, then ranks inside."""
    mark = F.sha2(F.concat_ws("\x1f", F.col("key").cast("string"), "body"), 256)
    new = rows.select("key", "body", mark.alias("fingerprint")).join(published.select(mark.alias("fingerprint")), "fingerprint", "left_anti")
    last = new.orderBy(F.desc("key")).limit(keep)
    n = new.agg(F.count("*").alias("n"))
    first = Window.orderBy(F.desc("key"))  # at most keep rows
    return last.withColumn("r", F.row_number().over(first)).join(F.broadcast(n)).select("key", (F.lit(last_seq) + F.col("n") - F.col("r") + 1).cast("long").alias("seq"))


def pull_start(cursor: Column, current: Column, length: Column) -> tuple[Column, Column]:
    """Where to read the log from, and whether operations were lost between cursor and what is kept."""
    oldest = current - length
    return F.greatest(cursor - oldest, F.lit(0)).cast("long"), (length > 0) & (cursor < oldest)


def pull(ops: DataFrame, me: str, cursor: int) -> DataFrame:
    """One row: applied and own operations after a cursor, and the new cursor."""
    new = ops.where(F.col("seq") > cursor)
    return new.agg(F.count_if(F.col("actor") != me).alias("applied"), F.count_if(F.col("actor") == me).alias("own"), F.coalesce(F.max("seq"), F.lit(cursor)).alias("cursor"))


def registers(ops: DataFrame) -> DataFrame:
    """Multi-value registers: for each key the values of each actor's last operation, sorted."""
    last = ops.groupBy("key", "actor").agg(F.max_by("value", "seq").alias("value"))
    return last.groupBy("key").agg(F.array_sort(F.collect_set("value")).alias("values"))


def undominated(writes: DataFrame) -> DataFrame:
    """Writes that no other write of the key covers: none has both clocks at least as great and one greater.
    writes: key, value, a, b (clocks of two actors)."""
    o = writes.select("key", F.col("a").alias("a2"), F.col("b").alias("b2"))
    covered = writes.join(o, (writes["key"] == o["key"]) & (F.col("a2") >= F.col("a")) & (F.col("b2") >= F.col("b")) & ((F.col("a2") > F.col("a")) | (F.col("b2") > F.col("b"))), "left_anti")
    return covered.distinct()


def project_conflicts(rows: DataFrame, values: DataFrame) -> DataFrame:
    """(key, content, conflict): one value is taken; of several the own one if among them, else the smallest."""
    v = F.col("values")
    content = F.when(F.array_contains(v, F.col("content")), F.col("content")).otherwise(F.get(v, F.lit(0)))
    return rows.join(values.where("size(values) > 0"), "key").select("key", content.alias("content"), (F.size("values") > 1).alias("conflict"))
