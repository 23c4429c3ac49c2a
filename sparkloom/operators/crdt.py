"""Replicated sets, registers, maps and counters: causal merges that are linear by key, and pulls of an operation log.

A replica's state is its dots (who made an entry, and as which one of theirs) and its clock (up to which dot of each actor it has
seen things). A dot that some replica has stays unless one that has seen it no longer has it. That holds for elements of an
observed-remove set, values of a multi-value register and entries of a map alike: they differ in what a dot carries. How many
replicas have a dot and how many have seen it are two counts by (key, actor), so no entry is compared with another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of the columns of a dot: actor and that actor's number.
DOT = ["actor", "counter"]


def merge_clocks(clocks: DataFrame) -> DataFrame:
    """(key, actor, clock): the greatest of all replicas. clocks: replica, key, actor, clock."""
    return clocks.groupBy("key", "actor").agg(F.max("clock").alias("clock"))


def merge_dots(dots: DataFrame, clocks: DataFrame, *carried: str) -> DataFrame:
    """(key, carried.., actor, counter) of the merged state of all replicas. dots: replica, key, carried.., actor, counter; clocks:
    replica, key, actor, clock. A replica has seen every dot that it has, whatever its clock says."""
    own = ["key", *DOT]
    have = dots.groupBy(*own).agg(F.count_distinct("replica").alias("have"), F.collect_set("replica").alias("by"), F.first(F.struct(*carried)).alias("c"))
    seen = clocks.groupBy("key", "actor").agg(F.collect_set(F.struct("replica", "clock")).alias("seen"))  # one of each replica
    gone = F.exists("seen", lambda s: (s["clock"] >= F.col("counter")) & ~F.array_contains("by", s["replica"]))
    return have.join(seen, ["key", "actor"], "left").where(~F.coalesce(gone, F.lit(False))).select("key", *[F.col(f"c.{c}").alias(c) for c in carried], *DOT)


def elements(merged: DataFrame, carried: str = "element") -> DataFrame:
    """(key, elements): what a set holds, sorted."""
    return merged.groupBy("key").agg(F.array_sort(F.collect_set(carried)).alias("elements"))


def undominated_writes(writes: DataFrame) -> DataFrame:
    """Writes (key, value, actor, counter, clock as map of actor to number) that no other write has seen, for any number of actors. A
    write has been seen where another's clock holds its dot: by the greatest clock of an actor in a key, and how many have it."""
    w = writes.dropDuplicates(["key", *DOT])
    each = w.select("key", F.explode("clock").alias("actor", "at"))
    count = each.groupBy("key", "actor", "at").agg(F.count("*").alias("n"))
    top = count.groupBy("key", "actor").agg(F.max(F.struct("at", "n")).alias("top"))
    own = F.element_at("clock", F.col("actor"))
    others = F.col("top.n") - F.when(own == F.col("top.at"), 1).otherwise(0)
    seen = (F.col("top.at") > F.col("counter")) & ((F.col("top.n") > 1) | own.isNull() | (own < F.col("top.at"))) | ((F.col("top.at") == F.col("counter")) & (others > 0))
    return w.join(top, ["key", "actor"], "left").where(~F.coalesce(seen, F.lit(False))).select(*writes.columns)


def merge_counters(counts: DataFrame) -> DataFrame:
    """(key, value): the greatest of all replicas."""
    return counts.groupBy("key").agg(F.max("value").alias("value"))


def pull_start(cursor: Column, current: Column, length: Column) -> tuple[Column, Column]:
    """From which place in the kept log to read, and whether operations after the cursor are no longer kept."""
    none = (current <= 0) | (length <= 0)
    earliest = F.greatest(current - length + 1, F.lit(1))
    gap = cursor + 1 < earliest
    return F.when(none | gap, 0).otherwise(F.greatest(cursor - earliest + 1, F.lit(0))).cast("long"), ~none & gap


def pulls(log: DataFrame, readers: DataFrame) -> DataFrame:
    """What each reader's pull does: (space, reader, gap, start, applied, own, invalid, cursor). log: space, seq, actor, valid (signature and
    content hold, and the envelope names this space), as far as it is kept; readers: space, reader, cursor. After a gap nothing is
    applied and the cursor goes to the end; the state is then taken from a snapshot."""
    kept = log.groupBy("space").agg(F.max("seq").alias("current"), F.count("*").alias("length"))
    start, gap = pull_start(F.col("cursor"), F.col("current"), F.col("length"))
    at = readers.join(kept, "space", "left").fillna(0, ["current", "length"]).select("space", "reader", "cursor", "current", start.alias("start"), gap.alias("gap"))
    # Readers of a space are few; their cursors go to the log's rows as one array, and counts come back.
    wants = at.groupBy("space").agg(F.collect_list(F.struct("reader", "cursor", "gap")).alias("wants"))
    each = log.join(wants, "space").select("space", "seq", "actor", "valid", F.explode(F.filter("wants", lambda w: ~w["gap"] & (F.col("seq") > w["cursor"]))).alias("w"))
    mine = F.col("actor") == F.col("w.reader")
    done = each.groupBy("space", F.col("w.reader").alias("reader")).agg(
        F.count_if(F.col("valid") & ~mine).alias("applied"), F.count_if(F.col("valid") & mine).alias("own"), F.count_if(~F.col("valid")).alias("invalid"), F.max("seq").alias("last")
    )
    out = at.join(done, ["space", "reader"], "left").fillna(0, ["applied", "own", "invalid"])
    cursor = F.when(F.col("gap"), F.col("current")).otherwise(F.coalesce("last", "cursor"))
    return out.select("space", "reader", "gap", "start", "applied", "own", "invalid", cursor.alias("cursor"))


def pulled(log: DataFrame, readers: DataFrame) -> DataFrame:
    """The operations (space, reader, seq, actor, key, value) that readers' pulls apply, in no order."""
    kept = log.groupBy("space").agg(F.max("seq").alias("current"), F.count("*").alias("length"))
    _, gap = pull_start(F.col("cursor"), F.col("current"), F.col("length"))
    wants = readers.join(kept, "space").where(~gap).groupBy("space").agg(F.collect_list(F.struct("reader", "cursor")).alias("wants"))
    each = log.where("valid").join(wants, "space").select("space", "seq", "actor", "key", "value", F.explode(F.filter("wants", lambda w: (F.col("seq") > w["cursor"]) & (F.col("actor") != w["reader"]))).alias("w"))
    return each.select("space", F.col("w.reader").alias("reader"), "seq", "actor", "key", "value")
