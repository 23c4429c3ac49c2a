"""The knapsack of requests with more sections than can be chosen, against one fold over all of them."""

from __future__ import annotations

import random

from sparkloom.operators import context


def test_sections_that_cannot_be_chosen_change_nothing(spark):
    rng = random.Random(4)
    rows = [(f"r{r}", i, rng.choice((0, 10, 10, 50, 90, -1)), rng.choice((0, 1, 1, 2, 3, 5, 9, 30))) for r in range(12) for i in range(rng.choice((0, 1, 5, 60)))]
    rows += [("r1", 3, 50, 1), (None, 0, 5, 2), (None, 1, 5, 2)]
    for budget in (0, 1, 7, 20):
        want = []
        for request in {r[0] for r in rows}:
            own = sorted((r for r in rows if r[0] == request), key=lambda r: (-r[2], r[3], r[1]))
            want += [own[i] for i in context.knapsack_of([r[3] for r in own], [r[2] for r in own], budget)]
        got = [tuple(r) for r in context.knapsack(spark.createDataFrame(rows, "request string, ordinal int, priority int, tokens int"), budget).collect()]
        assert sorted(got, key=str) == sorted(want, key=str), budget


def test_best_value_of_small_requests():
    rng = random.Random(5)
    for _ in range(200):
        n, budget = rng.randrange(9), rng.randrange(12)
        tokens, priorities = [rng.randrange(6) for _ in range(n)], [rng.randrange(4) for _ in range(n)]
        sums = [(sum(tokens[i] for i in range(n) if m >> i & 1), sum(100 * priorities[i] + 1 for i in range(n) if m >> i & 1)) for m in range(2**n)]
        chosen = context.knapsack_of(tokens, priorities, budget)
        assert sum(tokens[i] for i in chosen) <= budget
        assert sum(100 * priorities[i] + 1 for i in chosen) == max(v for t, v in sums if t <= budget)
