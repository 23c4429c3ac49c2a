"""Components against union-find, by rounds of stars and by the last task."""

from __future__ import annotations

import random

import pytest

from sparkloom.llm import components


@pytest.mark.parametrize("few", [0, 10, 1_000_000])
def test_components(spark, few, monkeypatch):
    monkeypatch.setattr(components, "FEW", few)
    rng = random.Random(6)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 240)] + [(5, 5)]
    root = {x: x for pair in links for x in pair}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["id"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    none = spark.createDataFrame([], "a long, b long")
    assert components.connected_components(none, "a", "b").count() == 0
