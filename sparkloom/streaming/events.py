"""Streaming forms of the event-log operators, over a file source; batch and stream give the same results."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def file_stream(spark: SparkSession, path: str, schema, max_files: int = 10, kind: str = "parquet") -> DataFrame:
    """A stream of a folder's files, at most max_files a batch: each file is read once per version."""
    return spark.readStream.schema(schema).format(kind).option("maxFilesPerTrigger", max_files).load(path)


def running_counters(stream: DataFrame) -> DataFrame:
    return stream.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def windowed(stream: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Extension: counts by event time, with a bound on lateness."""
    return stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).groupBy(F.window("at", size), "event_type").agg(F.count("*").alias("n"))


def latest_values(stream: DataFrame) -> DataFrame:
    """The last value of each user, by time and id."""
    return stream.groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


def cooldown_stream(stream: DataFrame, seconds: int) -> DataFrame:
    """Events that a greedy cooldown by user lets pass; the state is the time of the last one that passed."""

    def fold(key, parts, state):
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values(["sec", "event_id"])
        keep = []
        for s in rows["sec"]:
            ok = last is None or s - last >= seconds
            last = int(s) if ok else last
            keep.append(ok)
        state.update((last,))
        yield rows[keep][["user_id", "event_id", "sec"]]

    rows = stream.select("user_id", "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("sec"))
    return rows.groupBy("user_id").applyInPandasWithState(fold, "user_id long, event_id long, sec long", "last long", "append", "NoTimeout")


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> None:
    """Runs what a stream has now into an in-memory table (for tests and small results)."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def upsert_batches(stream: DataFrame, path: str, keys: list[str], order: str, checkpoint: str, buckets: int = 32) -> None:
    """Keeps a table of the last row of each key (upserted() reads it). Rows lie in buckets by key; a micro-batch writes a new
    version of the buckets that it touches and no others, then one small file that names each of its buckets. A batch that runs twice
    starts from the versions before it and changes nothing; versions that no reader needs are older than a bucket's last."""
    from ..operators.memory import upsert

    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def fold(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("bucket", bucket).persist()
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most `buckets`
        if touched:
            old = _versions(spark, path, batch.schema, epoch, touched)
            rows = upsert(old.select(*batch.columns), new.select(*batch.columns), keys, order)
            dealt = rows.withColumn("bucket", bucket).withColumn("epoch", F.lit(epoch)).repartition(len(touched), "bucket")
            dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch", "bucket").parquet(f"{path}/rows")
            spark.createDataFrame([(b,) for b in touched], "bucket int").withColumn("epoch", F.lit(epoch)).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(f"{path}/versions")
        new.unpersist()

    stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _versions(spark: SparkSession, path: str, schema: StructType, before: int | None = None, only: list[int] | None = None) -> DataFrame:
    """The last version of each bucket before an epoch: a scan of those folders alone."""
    empty = spark.createDataFrame([], schema)
    try:
        known = spark.read.schema("bucket int, epoch int").parquet(f"{path}/versions")
    except AnalysisException:  # nothing was written yet
        return empty
    if before is not None:
        known = known.where(F.col("epoch") < before)
    last = [tuple(r) for r in known.groupBy("bucket").agg(F.max("epoch")).collect() if only is None or r["bucket"] in only]
    if not last:
        return empty
    rows = spark.read.schema(StructType([*schema, StructField("epoch", IntegerType()), StructField("bucket", IntegerType())])).parquet(f"{path}/rows")
    return rows.where(reduce(lambda a, b: a | b, [(F.col("epoch") == e) & (F.col("bucket") == b) for b, e in last])).select(*schema.names)


def upserted(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table that upsert_batches() keeps."""
    return _versions(spark, path, schema)
