"""Upkeep of memory rows: relations between them, and migrations that can be run again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The row that tells to which version rows were rewritten.
MARKER = "migration::version"


def related(rows: DataFrame, links: DataFrame, now: int) -> DataFrame:
    """Rows (id, superseded_by, contradicts, updated_h) after links (id, seq, action, other) in order of seq: supersede sets what a
    row is superseded by, contradict adds to a set, resolve takes out of it. Each link bumps its row's time; links of unknown ids
    and empty names do nothing. Of the links of one pair the last counts, so a row's history is two small aggregates."""
    use = links.where("other is not null and trim(other) <> ''").withColumn("other", F.trim("other"))
    last = use.where("action <> 'supersede'").groupBy("id", "other").agg(F.max_by("action", "seq").alias("action"), F.min_by("seq", "seq").alias("first"))
    of = lambda a: F.array_compact(F.collect_list(F.when(F.col("action") == a, F.struct("first", "other"))))
    sets = last.groupBy("id").agg(F.sort_array(of("contradict")).alias("_in"), of("resolve").alias("_out"))
    over = use.where("action = 'supersede'").groupBy("id").agg(F.max_by("other", "seq").alias("_over"))
    touched = use.groupBy("id").agg(F.count("*").alias("_n"))
    names = lambda c: F.coalesce(F.transform(c, lambda x: x["other"]), F.array().cast("array<string>"))
    out = rows.join(touched, "id", "left").join(sets, "id", "left").join(over, "id", "left")
    contradicts = F.array_except(F.array_union(F.coalesce("contradicts", F.array().cast("array<string>")), names(F.col("_in"))), names(F.col("_out")))
    changed = {"superseded_by": F.coalesce("_over", "superseded_by"), "contradicts": contradicts, "updated_h": F.when(F.col("_n") > 0, F.lit(now)).otherwise(F.col("updated_h"))}
    return out.withColumns(changed).select(*rows.columns)


def migrated(rows: DataFrame, version: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, kind, content, tags) rewritten to one form (kind in lower case, content without blanks at its ends, tags sorted and once
    each), with the marker; and one row (rewritten, version). If the marker is there with this version or a later one, rows stay as
    they are and nothing counts."""
    done = F.coalesce(F.max(F.when(F.col("id") == MARKER, F.col("content").try_cast("int"))), F.lit(-1)) >= version
    flag = rows.agg(done.alias("_done"))  # one row
    own = rows.where(F.col("id") != MARKER).crossJoin(F.broadcast(flag))
    new = lambda c, made: F.when(F.col("_done"), F.col(c)).otherwise(made).alias(c)
    tags = F.array_sort(F.array_distinct(F.coalesce("tags", F.array().cast("array<string>"))))
    out = own.select("id", new("kind", F.lower("kind")), new("content", F.trim("content")), new("tags", tags))
    mark = rows.agg(F.max(F.when(F.col("id") == MARKER, F.col("content").try_cast("int"))).alias("v")).select(F.lit(MARKER).alias("id"), F.lit("marker").alias("kind"), F.greatest("v", F.lit(version)).cast("string").alias("content"), F.array().cast("array<string>").alias("tags"))
    report = own.agg(F.count_if(~F.col("_done")).alias("rewritten")).withColumn("version", F.lit(version))
    return out.unionByName(mark), report


def ordered_patterns(patterns: DataFrame) -> DataFrame:
    """Patterns by tier, occurrences falling, confidence falling, then id."""
    return patterns.orderBy("tier", F.desc("occurrences"), F.desc("confidence"), "id")


def triggered(saves: DataFrame, agents: DataFrame) -> DataFrame:
    """(agent, event_id, sec) of saves (event_id, sec, breaking, modified: counts) that start an agent (agent, trigger): one of
    file_save by any, one of signature_change by those that break or modify something, others by none. A cooldown by agent follows."""
    all_ = agents.where("trigger in ('file_save', 'signature_change')").agg(F.collect_list(F.struct("agent", "trigger")).alias("all"))  # one row: a workspace's configuration
    changed = (F.col("breaking") > 0) | (F.col("modified") > 0)
    fits = F.filter("all", lambda a: (a["trigger"] == "file_save") | changed)
    return saves.crossJoin(F.broadcast(all_)).select(F.explode(fits).alias("a"), "event_id", "sec").select("a.agent", "event_id", "sec")


def predicted_questions(degrees: DataFrame, changes: DataFrame) -> DataFrame:
    """(node, context, priority): a question on dependents for files that have some (high over five), and one on recent changes for
    files that were changed. degrees: node, fan_in. changes: file."""
    ahead = degrees.where("fan_in > 0").select("node", F.lit("dependency_warning").alias("context"), F.when(F.col("fan_in") > 5, "high").otherwise("medium").alias("priority"))
    return ahead.unionByName(changes.select(F.col("file").alias("node")).distinct().select("node", F.lit("recent_changes").alias("context"), F.lit("low").alias("priority")))
