"""Event-log analytics: session counts, slices, bounded rings, cooldowns and compaction.

Order is (sec, event_id). Ranks over a whole log are bounded top-n sorts, never a window in one task; ranks
inside a key are windows on that key.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def session_analytics(log: DataFrame) -> DataFrame:
    """One row: counts by kind, distinct files, severity, span in seconds, events a minute."""
    is_ = lambda k: F.count_if(F.col("kind") == k)
    span = F.when(F.count("*") >= 2, F.max("sec") - F.min("sec")).otherwise(F.lit(0))
    row = log.agg(
        F.count("*").alias("events"), is_("mutation").alias("mutations"), is_("memory").alias("memory_reads"), is_("intent").alias("intents"), is_("penalty").alias("penalties"),
        F.count_distinct("file").alias("files"), F.coalesce(F.sum("severity"), F.lit(0)).alias("severity"), span.alias("span_secs"),
    )
    return row.withColumn("events_per_minute", F.round(F.when(F.col("span_secs") > 0, F.col("events") * 60.0 / F.col("span_secs")).otherwise(F.lit(0.0)), 6))


def histogram(log: DataFrame, column: str) -> DataFrame:
    """Counts of a column's values, nulls left out."""
    return log.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def hottest_files(log: DataFrame, limit: int = 10) -> DataFrame:
    return histogram(log.where("kind = 'mutation'"), "file").orderBy(F.desc("n"), "file").limit(limit)


def ring(log: DataFrame, capacity: int) -> DataFrame:
    """The last rows that a bounded buffer still holds."""
    return log.orderBy(F.desc("sec"), F.desc("event_id")).limit(capacity)


def since(log: DataFrame, start: int) -> DataFrame:
    return log.where(F.col("sec") >= start)


def session_slice(log: DataFrame, start: int, limit: int) -> DataFrame:
    """Rows from start on, and of these the last limit."""
    return ring(since(log, start), limit)


def latest_changes(log: DataFrame, limit: int = 25) -> DataFrame:
    return ring(log.where("kind = 'mutation'"), limit)


def token_counters(log: DataFrame) -> DataFrame:
    """Calls, their sum, last, largest, smallest and whole average of tokens, by project."""
    calls = log.where("kind = 'ai_call'")
    return calls.groupBy("project").agg(
        F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.max_by("tokens", F.struct("sec", "event_id")).alias("last"), F.max("tokens").alias("largest"),
        F.min("tokens").alias("smallest"), F.floor(F.sum("tokens") / F.count("*")).cast("long").alias("average"),
    )


def compaction(log: DataFrame, keep: int = 4) -> DataFrame:
    """By project: of all but the last keep events the mutations, distinct intents and distinct files."""
    last = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("sec"), F.desc("event_id")))
    old = log.withColumn("r", last).where(F.col("r") > keep)
    return old.groupBy("project").agg(
        F.count_if(F.col("kind") == "mutation").alias("mutations"), F.array_join(F.array_sort(F.collect_set("intent")), ",").alias("intents"), F.count_distinct("file").alias("files")
    )


def last_values(log: DataFrame) -> DataFrame:
    """For each mutated file its last value and the change against the one before."""
    w = Window.partitionBy("file").orderBy("sec", "event_id")
    rows = log.where("kind = 'mutation'").select("file", "sec", "event_id", "value", F.lag("value").over(w).alias("before"))
    return rows.groupBy("file").agg(F.max_by(F.struct("value", "before"), F.struct("sec", "event_id")).alias("x")).select("file", F.col("x.value").alias("value"), F.round(F.col("x.value") - F.col("x.before"), 6).alias("change"))


def cooldown(log: DataFrame, key: str, seconds: int) -> DataFrame:
    """Events that a greedy cooldown lets pass: seconds since the last one that passed. An ordered fold by key."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["sec", "event_id"])
        last, ok = None, []
        for s in pdf["sec"]:
            passed = last is None or s - last >= seconds
            last = s if passed else last
            ok.append(passed)
        return pdf[ok]

    return log.select(key, "sec", "event_id").groupBy(key).applyInPandas(fold, log.select(key, "sec", "event_id").schema)


def fresh(log: DataFrame, now: Column, ttl: int) -> DataFrame:
    """Rows younger than a time to live."""
    return log.where(now - F.col("sec") < ttl)


def latest_intent(log: DataFrame) -> DataFrame:
    """By project its latest intent."""
    return log.where("kind = 'intent'").groupBy("project").agg(F.max_by("intent", F.struct("sec", "event_id")).alias("intent"), F.count("*").alias("n"))
