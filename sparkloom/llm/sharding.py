"""Shards of equal bytes by Karmarkar-Karp differencing over indivisible groups (rows of equal text).

A partial partition is one sum for each shard. The two of largest spread are combined, the larger sums of one
with the smaller of the other, until one is left. Groups are dealt over chunks by a hash of their digest; each
chunk is differenced on its own in a task, which leaves one partial partition for a chunk, and those are
differenced in turn in tasks of FAN partial partitions each, level by level, until one is left. Nothing comes to the driver
but counts. Over more than one chunk the spread is that of the last differencing: a few groups of a chunk, which is
a smaller part of a shard the larger the table is.

Slots are gapless in each shard: rows are counted in buckets of a hash, and a bucket's first slot is the count
of those before it, so no task ranks a whole shard.

Defined cases: a null text has size 1 and forms a group with other nulls, apart from empty texts; rows of a null
doc_id are rows like others; equal rows
are rows of their group, each with a slot of its own; a group larger than a shard's share stays whole; ties
go to the smaller chunk and digest; a text of any length is only measured and digested, in its row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .base import materialize, table

SHARDS = 16
CHUNK_GROUPS = 40_000
#: Partial partitions that one task combines.
FAN = 2_000
BUCKET_ROWS = 100_000


def difference(partials: list[list[int]]) -> list[list[int]]:
    """Karmarkar-Karp: for each partial partition, which final shard each of its sums goes to. The final
    shards are numbered by falling sum."""
    if not partials:
        return []
    k = len(partials[0])
    heap, tree = [], []  # tree: children and the order of their combined sums
    for i, sums in enumerate(partials):
        order = sorted(range(k), key=lambda j: -sums[j])
        tree.append((order,))
        heap.append((sums[order[-1]] - sums[order[0]], i, [sums[j] for j in order]))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heap[0]
        new = [p + q for p, q in zip(x, reversed(y))]
        order = sorted(range(k), key=new.__getitem__, reverse=True)
        tree.append((order, a, b))
        heapq.heapreplace(heap, (new[order[-1]] - new[order[0]], len(tree) - 1, [new[j] for j in order]))
    out: list[list[int]] = [[]] * len(partials)
    todo = [(len(tree) - 1, list(range(k)))]
    while todo:
        node, shard = todo.pop()
        order = tree[node][0]
        own = [0] * k
        for j, place in enumerate(order):
            own[place] = shard[j]
        if len(tree[node]) == 1:
            out[node] = own
        else:
            todo.append((tree[node][1], own))
            todo.append((tree[node][2], own[::-1]))
    return out


def shard_groups(groups: DataFrame, shards: int = SHARDS, chunk_groups: int = CHUNK_GROUPS) -> DataFrame:
    """digest and shard for each row (digest, bytes) of groups."""
    n = groups.count()
    chunks = max(1, -(-n // chunk_groups))
    dealt = groups.select("digest", "bytes", F.pmod(F.xxhash64("digest"), F.lit(chunks)).cast("int").alias("chunk"))

    def run(t):
        t = t.sort_by([("bytes", "descending"), ("digest", "ascending")])
        alone = [0] * (shards - 1)
        bins = [x[0] for x in difference([[b, *alone] for b in t.column("bytes").to_pylist()])]
        return pa.table({"digest": t.column("digest"), "bytes": t.column("bytes"), "chunk": t.column("chunk"), "bin": pa.array(bins, pa.int32())})

    placed = materialize(dealt.groupBy("chunk").applyInArrow(run, "digest string, bytes long, chunk int, bin int"), "shard")
    sums = F.array(*[F.coalesce(F.sum(F.when(F.col("bin") == i, F.col("bytes"))), F.lit(0)) for i in range(shards)])
    final = combined(placed.groupBy(F.col("chunk").cast("long").alias("id")).agg(sums.alias("sums")))
    return placed.join(final.withColumnRenamed("id", "chunk"), "chunk").select("digest", F.get("place", F.col("bin")).alias("shard"))


def combined(parts: DataFrame) -> DataFrame:
    """(id, place): for each partial partition (id, sums), which final shard each of its sums goes to."""
    groups = max(1, -(-parts.count() // FAN))

    def run(t):
        t = t.sort_by("id")
        sums = t.column("sums").to_pylist()
        places = difference(sums)
        total = [0] * len(sums[0])
        for own, place in zip(sums, places):
            for b, shard in zip(own, place):
                total[shard] += b
        return pa.table({"id": t.column("id"), "g": t.column("g"), "place": pa.array(places, pa.list_(pa.int32())), "total": pa.array([total] * len(sums), pa.list_(pa.int64()))})

    dealt = parts.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(groups)))
    out = materialize(dealt.groupBy("g").applyInArrow(run, "id long, g long, place array<int>, total array<long>"), "level")
    if groups == 1:
        return out.select("id", "place")
    upper = combined(out.groupBy("g").agg(F.first("total").alias("sums")).withColumnRenamed("g", "id"))
    joined = out.join(upper.select(F.col("id").alias("g"), F.col("place").alias("up")), "g")
    return joined.select("id", F.transform("place", lambda x: F.get("up", x)).alias("place"))


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot for every row."""
    facts = materialize(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
            F.coalesce(F.sha2("text", 256), F.lit("null")).alias("digest"),
        ),
        "facts",
    )
    groups = facts.groupBy("digest").agg(F.sum("size").alias("bytes"))
    rows = facts.join(shard_groups(groups, shards), "digest")
    buckets = max(1, -(-facts.count() // BUCKET_ROWS))
    rows = materialize(rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(buckets)).cast("int")), "rows")
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("first"))
    own = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "digest"))
    return rows.withColumn("own", own).join(counts, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("own") - 1).cast("long").alias("slot"))


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    rows = assign(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
