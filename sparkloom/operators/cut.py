"""Cut lineage: a table in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, local mode uses a folder of this machine, which is removed at
    exit; a cluster must set it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "local")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="sparkloom-cut-"))
            atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
        root = f"file://{_LOCAL[0]}"
    return root.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """df written under shared_folder() and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
