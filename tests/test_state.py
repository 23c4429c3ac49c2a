"""Streams with state: equal to their batch forms, with state that goes; and changes of a folder over restarts."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import events
from sparkloom.sources import changes
from sparkloom.streaming import events as streams
from sparkloom.streaming import state

ROWS = "key string, event_id long, sec long, file string, intent string, value double"


@pytest.fixture()
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, state.ROCKSDB)
    yield spark
    spark.conf.set(name, old)


def made(seed: int, n: int) -> list:
    rng, sec, out = random.Random(seed), 1_000_000, []
    for i in range(n):
        sec += rng.choice([0, 1, 5, 40, 200])
        intent = f"i{rng.randrange(3)}" if rng.random() < 0.4 else None
        out.append((f"k{rng.randrange(3)}", i, sec, f"f{rng.randrange(4)}", intent, rng.random()))
    return out


def fed(spark, rows, folder, batches=4):
    """A stream of the rows, a file for each of some batches in order."""
    size = -(-len(rows) // batches)
    for k in range(batches):
        spark.createDataFrame(rows[k * size : (k + 1) * size], ROWS).coalesce(1).write.mode("append").parquet(str(folder))
    return streams.file_stream(spark, str(folder), ROWS, 1)


def test_cooldown(rocks, tmp_path):
    rows = made(1, 120)
    stream = fed(rocks, rows, tmp_path / "in")
    streams.run_to_table(state.cooldown_stream(stream, 90), "cooled", str(tmp_path / "c"), "append")
    got = sorted(map(tuple, rocks.table("cooled").collect()))
    want = events.cooldown(rocks.createDataFrame(rows, ROWS), "key", 90).select("key", "event_id", "sec")
    assert got == sorted(map(tuple, want.collect())) and 3 < len(got) < 120


def test_last_values(rocks, tmp_path):
    rows = made(2, 60)
    stream = fed(rocks, rows, tmp_path / "in", 3)
    streams.run_to_table(state.last_value_stream(stream), "lasts", str(tmp_path / "c"), "update")
    log = rocks.createDataFrame(rows, ROWS).select(F.col("key").alias("file"), "event_id", "sec", "value", F.lit("mutation").alias("kind"))
    want = {r["file"]: (r["value"], r["change"]) for r in events.last_values(log).collect()}
    got = {}
    for r in rocks.table("lasts").collect():  # rows of later batches come later
        got.setdefault(r["key"], []).append((r["value"], r["change"]))
    assert got.keys() == want.keys() and all(want[k] in got[k] for k in want)


def test_predictions(rocks, tmp_path):
    rows = made(3, 150)
    stream = fed(rocks, rows, tmp_path / "in", 5)
    streams.run_to_table(state.prediction_stream(stream, 300), "asked", str(tmp_path / "c"), "append")
    got = sorted(map(str, rocks.table("asked").collect()))
    want = state.predictions(rocks.createDataFrame(rows, ROWS), 300)
    assert got == sorted(map(str, want.collect()))
    assert {r["source"] for r in want.collect()} == {"current", "cache-hit", None}


def test_state_expires(rocks, tmp_path):
    """Keys whose time is over have no state left once a watermark passed it."""
    rows = [(f"k{i}", i, 1000 + i, "f", "x", 0.0) for i in range(20)] + [("end", 100, 90_000, "f", "x", 0.0), ("end", 101, 99_000, "f", "x", 0.0), ("end", 102, 99_500, "f", "x", 0.0)]
    for k, part in enumerate((rows[:20], rows[20:21], rows[21:22], rows[22:])):
        rocks.createDataFrame(part, ROWS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = streams.file_stream(rocks, str(tmp_path / "in"), ROWS, 1)
        q = state.cooldown_stream(stream, 60).writeStream.format("noop").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    left = rocks.read.format("statestore").option("stateVarName", "last").load(str(tmp_path / "c")).count()
    assert left == 1


def drained(spark, root, kept, checkpoint, **options):
    spark.dataSource.register(changes.FolderChanges)
    reader = spark.readStream.format("folder_changes").option("state", str(kept))
    for k, v in options.items():
        reader = reader.option(k, v)
    got = []
    q = reader.load(str(root)).writeStream.foreachBatch(lambda df, n: got.extend(df.collect())).option("checkpointLocation", str(checkpoint)).start()
    q.processAllAvailable()
    q.stop()
    return sorted((r["path"], r["kind"], bytes(r["content"]).decode() if r["content"] is not None else None) for r in got)


def test_folder_changes(spark, tmp_path):
    root, kept, ck = tmp_path / "w", tmp_path / "kept", tmp_path / "ck"
    (root / "src/deep").mkdir(parents=True)
    (root / "node_modules/x").mkdir(parents=True)
    (root / "src/a.ts").write_text("one")
    (root / "src/deep/b.ts").write_text("two")
    (root / "node_modules/x/c.ts").write_text("noise")
    first = drained(spark, root, kept, ck)
    assert first == [("src/a.ts", "created", "one"), ("src/deep/b.ts", "created", "two")]
    batch = spark.read.format("folder_changes").load(str(root)).collect()
    assert sorted((r["path"], r["kind"], bytes(r["content"]).decode()) for r in batch) == first
    assert drained(spark, root, kept, ck) == []  # started again: each version once
    (root / "src/a.ts").write_text("one!")
    (root / "src/deep/b.ts").unlink()
    (root / "src/new.md").write_text("")
    assert drained(spark, root, kept, ck) == [("src/a.ts", "modified", "one!"), ("src/deep/b.ts", "removed", None), ("src/new.md", "created", "")]
    (root / "src/deep/b.ts").write_text("again")
    assert drained(spark, root, kept, ck, files_per_task="1") == [("src/deep/b.ts", "created", "again")]


def test_only_newer_versions(spark, tmp_path):
    root, kept, ck = tmp_path / "w", tmp_path / "kept", tmp_path / "ck"
    root.mkdir()
    (root / "pending.json").write_text("[1]")
    (root / "other.txt").write_text("x")
    options = {"newer_only": "true", "suffixes": "pending.json"}
    assert drained(spark, root, kept, ck, **options) == [("pending.json", "created", "[1]")]
    (root / "pending.json").write_text("[2]")
    os.utime(root / "pending.json", (5, 5))
    assert drained(spark, root, kept, ck, **options) == []
    (root / "pending.json").write_text("[3]")
    assert drained(spark, root, kept, ck, **options) == [("pending.json", "modified", "[3]")]
