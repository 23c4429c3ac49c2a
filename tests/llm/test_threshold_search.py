"""Threshold search against scoring every document, whatever the shards, tasks and blocks."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from sparkloom.llm import threshold_search as S
from sparkloom.llm import vectext as V

DOC, ITEM = "doc_id long, text string, score long, rank int", "item_id long, text string, query long"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n_docs, n_all = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in held:
            m = 25 + 75 * sum(c.values()) * n_docs // n_all
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scored)[:k])]
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: f"W{int(rng.paretovariate(0.7)) % 300}"
    docs = [(i, " ".join(word() for _ in range(rng.randrange(1, 60)))) for i in range(n)]
    docs += [(n + i, "w1 copy of one text w7 w9") for i in range(60)]  # ties
    docs += [(5, "w3 w3 repeated id"), (None, "w2 w3 no id"), (None, "w1 copy of one text w7 w9"), (900, None), (901, ""), (902, "!? --"), (903, "w2 ÉW3 w3w " * 20_000)]
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 25)))) for i in range(25)]
    items += [(100, None), (101, ""), (102, "..."), (103, "unknown words"), (104, "copy copy w7 w9 w1"), (104, "text"), (None, "w2 w3 w3")]
    return docs, items


key = lambda r: tuple((x is None, x or 0) for x in r)


@pytest.mark.parametrize("shard,block", [(S.SHARD_BYTES, S.BLOCK_BYTES), (500, S.BLOCK_BYTES), (2000, 300)])
def test_equals_scoring_all(spark, monkeypatch, shard, block):
    monkeypatch.setattr(S, "SHARD_BYTES", shard)
    docs, items = corpus(shard, 400)
    got = S.search(spark.createDataFrame([(*d, 0, 0) for d in docs], DOC), spark.createDataFrame([(*i, 0) for i in items], ITEM), block_bytes=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(docs, items), key=key)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a", 0, 0)], DOC), spark.createDataFrame([(1, "a", 0)], ITEM)
    assert S.search(docs.limit(0), items).collect() == S.search(docs, items.limit(0)).collect() == []


def test_stops_before_the_lists_end():
    """A query of a rare and a common term reads few postings, and the result is that of reading all."""
    rng = np.random.default_rng(2)
    texts = ["common " * int(rng.integers(1, 9)) + "filler " * int(rng.integers(1, 200)) for _ in range(20_000)]
    for i in range(0, 20_000, 900):
        texts[i] = "rare common"
    queries = S.Queries(["rare common"])
    data, offs = V.buffer_of(pa.array(texts, pa.large_string()))
    shard = S.Shard(data, offs, queries.terms)
    shard.index(np.array([3000 if c == 23 else 100 for c in shard.holders()]), 20_000, int(shard.lengths.sum()))
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    names = np.arange(20_000)
    (scores, found), n_read = shard.search(*queries.of[0], none, names, 10)
    wanted = np.bincount(queries.of[0][0], queries.of[0][1], shard.n_terms).astype(np.int64)
    everything = shard.scores(names, wanted)
    order = np.lexsort((names, -everything))[:10]
    assert scores.tolist() == everything[order].tolist() and found.tolist() == order.tolist()
    assert n_read < 2000
