"""Connected components of a table of links, by alternating large and small stars.

Minima come from partial aggregation and a join, so a hub of any degree is no one task's burden. Each round
is written to the shared folder. Rounds end when a round changes nothing, or when at most FEW links are left:
a task holds these whatever they are (a bound, checked by a count), and finishes them at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import discard, materialize

#: Links that one task finishes: 16 bytes each.
FEW = 1_000_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def least_members(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every id of the links with the least id of its component."""
    ids, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(ids))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        # A label's own row takes the smaller one too, then every row jumps to the label of its label.
        np.minimum.at(new, label, new)
        new = new[new]
        if np.array_equal(new, label):
            return ids, ids[label]
        label = new


def _finish(edges: DataFrame) -> DataFrame:
    def run(batches):
        parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
        if parts:
            ids, least = least_members(*(np.concatenate(x) for x in zip(*parts)))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(least)], ["id", "component"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, "id long, component long")


def connected_components(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """Rows (id, component) for every id in a link; component is the smallest id that is reachable."""
    edges = materialize(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "cc")
    mark = (edges.count(), None)
    for _ in range(max_rounds):
        if mark[0] <= FEW:
            return _finish(edges)
        new = materialize(_star(_star(edges, True), False), "cc")
        got = _mark(new)
        discard(edges)
        edges = new
        if got == mark:
            break
        mark = got
    else:
        raise RuntimeError("components did not settle")
    pairs = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    return pairs.unionAll(pairs.select(F.col("component").alias("id"), "component")).groupBy("id").agg(F.min("component").alias("component"))
