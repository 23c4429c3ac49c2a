"""Keyed state with timers: cooldowns, last values, and hot predictions that go stale. Each has a batch form with equal rows.

Time is the events' own (a watermark says how far it is), so that a stream that is run again gives the same rows. State of a key
goes by a timer once it can change nothing any more: a cooldown that is over, a prediction past its time to live. These need the
RocksDB state store: spark.sql.streaming.stateStore.providerClass.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ordered(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(parts)).sort_values(["sec", "event_id"])


class _Cooldown(StatefulProcessor):
    """Lets a row pass if the last one that did is `seconds` older or gone."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "sec long")

    def handleInputRows(self, key, rows, timerValues):
        rows = _ordered(rows)
        before = last = self.last.get()[0] if self.last.exists() else None
        passed = []
        for sec in rows["sec"]:
            ok = last is None or sec - last >= self.seconds
            last = int(sec) if ok else last
            passed.append(ok)
        if last != before:
            self.last.update((last,))
            self.handle.registerTimer((last + self.seconds) * 1000)
        yield rows[passed][["key", "event_id", "sec"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.last.exists() and (self.last.get()[0] + self.seconds) * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        yield pd.DataFrame({"key": [], "event_id": [], "sec": []}).astype({"key": str, "event_id": "int64", "sec": "int64"})

    def close(self) -> None:
        pass


class _LastValues(StatefulProcessor):
    """The last value of a key and its change against the one before, whenever it changes."""

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "sec long, event_id long, value double, before double")

    def handleInputRows(self, key, rows, timerValues):
        now = self.seen.get() if self.seen.exists() else None
        for sec, event, value in _ordered(rows)[["sec", "event_id", "value"]].itertuples(index=False):
            if now is None or (sec, event) > (now[0], now[1]):
                now = (int(sec), int(event), float(value), None if now is None else now[2])
        self.seen.update(tuple(now))
        change = None if now[3] is None else round(now[2] - now[3], 6)
        yield pd.DataFrame({"key": [key[0]], "value": [now[2]], "change": pd.array([change], "Float64")})

    def close(self) -> None:
        pass


class _Predictions(StatefulProcessor):
    """Rows with an intent preload a file's context; rows without one ask for it. What answers is the key's current intent if it is of that
    file, else what the file's last preload left, if that is younger than `ttl` seconds."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle) -> None:
        self.handle = handle
        self.current = handle.getValueState("current", "file string, intent string")
        self.hot = handle.getMapState("hot", "file string", "intent string, sec long")

    def handleInputRows(self, key, rows, timerValues):
        out = []
        for event, sec, file, intent in _ordered(rows)[["event_id", "sec", "file", "intent"]].itertuples(index=False):
            if isinstance(intent, str):
                self.current.update((file, intent))
                self.hot.updateValue((file,), (intent, int(sec)))
                self.handle.registerTimer((int(sec) + self.ttl) * 1000)
                continue
            now = self.current.get() if self.current.exists() else None
            if now is not None and now[0] == file:
                out.append((key[0], event, now[1], "current"))
            elif self.hot.containsKey((file,)) and sec - (kept := self.hot.getValue((file,)))[1] < self.ttl:
                out.append((key[0], event, kept[0], "cache-hit"))
            else:
                out.append((key[0], event, None, None))
        yield pd.DataFrame(out, columns=["key", "event_id", "intent", "source"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        until = expiredTimerInfo.getExpiryTimeInMs()
        for file in [f for f, (_, sec) in self.hot.iterator() if (sec + self.ttl) * 1000 <= until]:
            self.hot.removeKey(file)
        yield pd.DataFrame([], columns=["key", "event_id", "intent", "source"])

    def close(self) -> None:
        pass


def _keyed(stream: DataFrame, late: str):
    return stream.withColumn("at", F.timestamp_seconds("sec")).withWatermark("at", late).groupBy("key")


def cooldown_stream(stream: DataFrame, seconds: int, late: str = "0 seconds") -> DataFrame:
    """(key, event_id, sec) of rows that a greedy cooldown by key lets pass."""
    return _keyed(stream, late).transformWithStateInPandas(_Cooldown(seconds), "key string, event_id long, sec long", "Append", "EventTime")


def last_value_stream(stream: DataFrame) -> DataFrame:
    """(key, value, change) of every key that a batch changes."""
    return stream.groupBy("key").transformWithStateInPandas(_LastValues(), "key string, value double, change double", "Update", "None")


def prediction_stream(stream: DataFrame, ttl: int, late: str = "0 seconds") -> DataFrame:
    """(key, event_id, intent, source) for every row that asks."""
    return _keyed(stream, late).transformWithStateInPandas(_Predictions(ttl), "key string, event_id long, intent string, source string", "Append", "EventTime")


def predictions(rows: DataFrame, ttl: int) -> DataFrame:
    """The same for a whole table (key, sec, event_id, file, intent)."""
    order = ["sec", "event_id"]
    past = Window.partitionBy("key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("key", "file").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    preload = F.when(F.col("intent").isNotNull(), F.struct("file", "intent", "sec"))
    seen = rows.withColumns({"_now": F.last(preload, ignorenulls=True).over(past), "_own": F.last(preload, ignorenulls=True).over(own)}).where("intent is null")
    current = F.col("_now.file") == F.col("file")
    kept = F.col("sec") - F.col("_own.sec") < ttl
    return seen.select(
        "key",
        "event_id",
        F.when(current, F.col("_now.intent")).when(kept, F.col("_own.intent")).alias("intent"),
        F.when(current, "current").when(kept, "cache-hit").alias("source"),
    )


def hot_predictions(rows: DataFrame, now: int, ttl: int) -> DataFrame:
    """(key, file, intent): what is still hot at a time: each file's last preload, if it is younger than ttl."""
    last = rows.where("intent is not null").groupBy("key", "file").agg(F.max_by("intent", F.struct("sec", "event_id")).alias("intent"), F.max("sec").alias("sec"))
    return last.where(now - F.col("sec") < ttl).select("key", "file", "intent", "sec")
