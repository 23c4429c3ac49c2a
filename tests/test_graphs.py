"""Betweenness, searches for many requests and condensation depth on random graphs, against plain versions."""

from __future__ import annotations

import random

import pytest

from sparkloom.operators import graph


def made(seed, n, m):
    rng = random.Random(seed)
    return sorted({(f"v{rng.randrange(n):02d}", f"v{rng.randrange(n):02d}") for _ in range(m)})


def plain_betweenness(pairs):
    names = sorted({x for p in pairs for x in p})
    adj = {v: sorted(b for a, b in set(pairs) if a == v) for v in names}
    total = dict.fromkeys(names, 0.0)
    for s in names:
        paths, far, before, order = {s: 1}, {s: 0}, {s: []}, [s]
        for v in order:
            for w in adj[v]:
                if w not in far:
                    far[w], before[w], paths[w] = far[v] + 1, [], 0
                    order.append(w)
                if far[w] == far[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        delta = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in before[w]:
                delta[v] += paths[v] / paths[w] * (1 + delta[w])
            if w != s:
                total[w] += delta[w]
    top = max(total.values())
    return {v: round(b / top, 6) if top else 0.0 for v, b in total.items()}


@pytest.mark.parametrize("seed,n,m,rows", [(1, 12, 30, 10**9), (2, 16, 32, 200)])
def test_betweenness(spark, seed, n, m, rows):
    pairs = made(seed, n, m)  # with self-edges, cycles and parts
    got = {r["node"]: r["betweenness"] for r in graph.betweenness(spark.createDataFrame(pairs + pairs[:3], "src string, dst string"), rows).collect()}
    want = plain_betweenness(pairs)
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 2e-6 for v in want)


def test_betweenness_without_paths(spark):
    assert {r["betweenness"] for r in graph.betweenness(spark.createDataFrame([("a", "b")], "src string, dst string")).collect()} == {0.0}
    assert graph.betweenness(spark.createDataFrame([], "src string, dst string")).collect() == []


@pytest.mark.parametrize("undirected", [False, True])
def test_many_searches_equal_single_ones(spark, undirected):
    pairs = spark.createDataFrame(made(5, 15, 25), "src string, dst string")
    starts = [(1, "v01"), (2, "v02"), (2, "v03"), (3, "v99")]
    rows = graph.reach_many(pairs, spark.createDataFrame(starts, "request int, node string"), 3, undirected).collect()
    for request in (1, 2, 3):
        one = graph.reach(pairs, spark.createDataFrame([(n,) for r, n in starts if r == request], "node string"), 3, undirected).collect()
        mine = [r for r in rows if r["request"] == request]
        assert {(r["node"], r["depth"], r["via"]) for r in mine} == {(r["node"], r["depth"], r["via"]) for r in one}
        assert all(len(r["path"]) == r["depth"] + 1 and r["path"][-1] == r["node"] and (r["depth"] == 0 or r["path"][-2] == r["via"]) for r in mine)


def plain_depth(pairs):
    names = sorted({x for p in pairs for x in p})
    reach = {v: {v} for v in names}
    for _ in names:
        for a, b in pairs:
            reach[a] |= reach[b]
    comp = {v: min(w for w in names if w in reach[v] and v in reach[w]) for v in names}
    dag = {(comp[a], comp[b]) for a, b in pairs if comp[a] != comp[b]}
    far = dict.fromkeys(names, 0)
    for _ in names:
        for a, b in dag:
            far[b] = max(far[b], far[a] + 1)
    return max(far.values(), default=0)


@pytest.mark.parametrize("seed,n,m", [(1, 14, 20), (3, 6, 20)])
def test_condensed_depth(spark, seed, n, m):
    pairs = made(seed, n, m)
    assert graph.condensed_depth(spark.createDataFrame(pairs, "src string, dst string")).first()["depth"] == plain_depth(pairs)


def test_depth_behind_a_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("d", "e")], "src string, dst string")
    assert (graph.max_depth(e).first()["depth"], graph.condensed_depth(e).first()["depth"]) == (0, 3)


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """Chains behind and between cycles, a ring, and a tree: rounds grow with the logarithm of a chain, not with its length."""
    chain = lambda name, n: [(f"{name}{i:03d}", f"{name}{i + 1:03d}") for i in range(n)]
    pairs = chain("a", 150) + [("a010", "a003"), ("a150", "a148")] + chain("b", 90) + [("b090", "b000"), ("b030", "a000")] + chain("c", 40) + [("c040", "c039")]
    taken = []
    one = graph._removable
    monkeypatch.setattr(graph, "_removable", lambda e, turn: taken.append(turn) or one(e, turn))
    e = spark.createDataFrame(pairs, "src string, dst string")
    assert graph.condensed_depth(e).first()["depth"] == plain_depth(pairs)
    assert len(taken) < 60
    got = {r["node"]: r["component"] for r in graph.strong_components(e).collect()}
    want = {**{f"a{i:03d}": "a003" for i in range(3, 11)}, **{f"a{i:03d}": "a148" for i in range(148, 151)}, **{f"b{i:03d}": "b000" for i in range(91)}, "c039": "c039", "c040": "c039"}
    assert got == want


@pytest.mark.parametrize("seed,n,m", [(11, 20, 22), (12, 25, 30), (13, 9, 12)])
def test_strong_components_of_sparse_graphs(spark, seed, n, m):
    pairs = made(seed, n, m)
    names = sorted({x for p in pairs for x in p})
    reach = {v: {v} for v in names}
    for _ in names:
        for a, b in pairs:
            reach[a] |= reach[b]
    same = {v: [w for w in names if w in reach[v] and v in reach[w]] for v in names}
    e = spark.createDataFrame(pairs, "src string, dst string")
    assert {r["node"]: r["component"] for r in graph.strong_components(e).collect()} == {v: min(c) for v, c in same.items() if len(c) > 1}
    assert graph.condensed_depth(e).first()["depth"] == plain_depth(pairs)
