"""A large batch of texts is never all Python objects at once."""

from __future__ import annotations

import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from sparkloom.functions.batches import SLICE, mapped
from sparkloom.functions.tokens import count_tokens
from sparkloom.operators.codefilter import applied


def peak(batch: pa.Array) -> int:
    tracemalloc.start()
    got = mapped(lambda x: -1 if x is None else len(x), pa.int64(), batch)
    used = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist()[:3] == [5000, -1, 0] and len(got) == len(batch)
    return used


def test_memory_is_bounded():
    texts = pa.array(["x" * 5000, None, "", *["y" * 5000] * 6000, "z" * (2 * SLICE)])
    assert peak(texts) < 8 * SLICE < texts.nbytes
    assert len(mapped(len, pa.int64(), pa.array([], pa.string()))) == 0


def test_filters_take_batches_as_arrow(spark):
    df = spark.createDataFrame([(1, "// a\nb"), (2, None), (3, "")], "id int, text string").coalesce(1)
    out = df.select("id", applied(F.col("text"), F.lit("typescript")).alias("t"), count_tokens(F.col("text"), "/opt/tokenizers/byte_bpe_50k.tiktoken").alias("n"))
    assert "ArrowEvalPython" in out._jdf.queryExecution().toString() and "PANDAS" not in str(applied(F.col("text"), F.lit("go"))._jc)
    rows = {r["id"]: r for r in out.collect()}
    assert rows[1]["t"] == "b" and rows[2]["t"] is None and rows[3]["t"] == "" and rows[1]["n"] > 1 and rows[2]["n"] == rows[3]["n"] == 0
