"""Tables, the shared folder for cut lineage, and a spread of text over tasks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir, or in local mode and tests, where that is unset,
    one of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="sparkloom-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return f"file://{_LOCAL[0]}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to a table in the shared folder and reads it again. Lineage ends there, so a lost executor
    costs a read and not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path  # for discard()
    return out


def discard(df: DataFrame) -> None:
    """Removes a materialized table that nothing will read again."""
    path, name = getattr(df, "scratch_path", None), getattr(df, "scratch_table", None)
    if name:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def bucketed(df: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """df in a table of the shared folder, bucketed by keys, so that joins on them don't move its rows again."""
    n = task_count(df)
    return save_bucketed(df.repartition(n, *keys), n, keys, tag)


def save_bucketed(df: DataFrame, n: int, keys: list[str], tag: str) -> DataFrame:
    """The same for rows that are dealt over n tasks by a hash of keys already."""
    spark = df.sparkSession
    name = f"{tag}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.write.option("compression", "zstd").option("path", path).bucketBy(n, *keys).format("parquet").saveAsTable(name)
    out = spark.table(name)
    out.scratch_path, out.scratch_table, out.n_buckets = path, name, n
    return out


#: Bytes of scanned files for a task of spread().
TASK_BYTES = 64 << 20


def scanned_bytes(df: DataFrame) -> int:
    """Bytes of the tables that df reads, by the planner's statistics; what it does not know counts as 0."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 55)


def task_count(df: DataFrame) -> int:
    """spark.sql.shuffle.partitions, or more where TASK_BYTES for each task ask for more."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-scanned_bytes(df) // TASK_BYTES))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deals rows over task_count() tasks by a hash of keys. Parquet files with few large row groups otherwise
    give as few tasks; and a retried task gets the same rows."""
    return df.repartition(task_count(df), *keys)
