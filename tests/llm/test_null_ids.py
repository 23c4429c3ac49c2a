"""Rows with a null doc_id: none is dropped, and their windows count."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest
from sparkloom.llm import bwt_dedup, lsh_forest
from test_documents import brute_removal

SCHEMA = "doc_id long, text string"


def say(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


@pytest.mark.parametrize("most", [1 << 20, 1])
def test_windows_of_rows_without_id(spark, most, monkeypatch):
    monkeypatch.setattr(bwt_dedup, "MOST_BYTES", most)  # 1: every minimizer is cut again, down to single windows
    core = say(1, 60)
    docs = [(None, say(2, 20) + core + say(3, 9)), (5, say(4, 11) + core + say(5, 30)), (0, say(6, 25) + core), (None, say(7, 80)), (8, None), (None, None), (None, core + say(9, 40))]
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in bwt_dedup.dedup(spark.createDataFrame(docs, SCHEMA)).collect()]
    want = [(i, *x) for (i, _), x in zip(docs, brute_removal([t for _, t in docs]))]
    assert sorted(got, key=lambda r: (r[0] is None, r[0] or 0, r[1:])) == sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def test_near_dedup_keeps_rows_without_id(spark):
    text = say(1, 60)
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, say(2, 60)), (None, text), (None, say(3, 60)), (None, None)], SCHEMA)
    assert sorted((r["doc_id"] or 0, r["kept"]) for r in lsh_forest.near_duplicates(docs).collect()) == [(0, True)] * 3 + [(1, True), (2, False), (3, True)]
    assert sorted(r["doc_id"] or 0 for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [0, 0, 0, 1, 3]
