"""Merges of replicas: any order gives one state, equal to a replay of sets with observed removes; pulls by hand."""

from __future__ import annotations

import itertools
import random

import pytest

from sparkloom.operators import crdt

DOTS, CLOCKS = "replica string, key string, element string, actor string, counter long", "replica string, key string, actor string, clock long"


class Replica:
    """A plain observed-remove set of one key."""

    def __init__(self, name):
        self.name, self.dots, self.clock = name, set(), {}

    def add(self, element):
        n = self.clock[self.name] = self.clock.get(self.name, 0) + 1
        self.dots.add((element, self.name, n))

    def remove(self, element):
        self.dots = {d for d in self.dots if d[0] != element}

    def take(self, other):
        keep = self.dots & other.dots
        keep |= {d for d in self.dots if d[2] > other.clock.get(d[1], 0)} | {d for d in other.dots if d[2] > self.clock.get(d[1], 0)}
        self.dots = keep
        self.clock = {a: max(self.clock.get(a, 0), other.clock.get(a, 0)) for a in self.clock | other.clock}


def history(seed):
    rng, replicas = random.Random(seed), [Replica(x) for x in "abcd"]
    for _ in range(60):
        r = rng.choice(replicas)
        kind = rng.random()
        if kind < 0.5:
            r.add(rng.choice("uvwx"))
        elif kind < 0.75:
            r.remove(rng.choice("uvwx"))
        else:
            r.take(rng.choice(replicas))
    return replicas


def frames(spark, replicas, key="k"):
    dots = [(r.name, key, *d) for r in replicas for d in sorted(r.dots)]
    return spark.createDataFrame(dots, DOTS), spark.createDataFrame([(r.name, key, a, n) for r in replicas for a, n in r.clock.items()], CLOCKS)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_gives_one_state(spark, seed):
    replicas = history(seed)
    got = {(r["element"], r["actor"], r["counter"]) for r in crdt.merge_dots(*frames(spark, replicas), "element").collect()}
    clocks = {r["actor"]: r["clock"] for r in crdt.merge_clocks(frames(spark, replicas)[1]).collect()}
    for order in itertools.permutations(range(4)):
        all_ = Replica("z")
        for i in order:
            all_.take(replicas[i])
        assert (all_.dots, all_.clock) == (got, clocks)


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (3, 1, 0, 2), (2, 3, 1, 0)])
def test_merging_one_by_one(spark, order):
    """Merging merged states gives what merging all at once does, and merging a state with itself changes nothing."""
    replicas = history(5)
    dots, clocks = frames(spark, replicas)
    once = {tuple(r) for r in crdt.merge_dots(dots, clocks, "element").collect()}
    now = Replica("m")
    for i in (*order, order[0]):
        d, c = frames(spark, [now, replicas[i]])
        merged, seen = crdt.merge_dots(d, c, "element").collect(), crdt.merge_clocks(c).collect()
        now.dots, now.clock = {(r["element"], r["actor"], r["counter"]) for r in merged}, {r["actor"]: r["clock"] for r in seen}
    assert {("k", *d) for d in now.dots} == once


def test_registers_of_any_actors(spark):
    rng, writes, clock_of = random.Random(9), [], {}
    for i in range(40):  # each write has seen some writes of its key, and what these had seen
        key, actor = rng.choice("pq"), rng.choice("abcde")
        clock = {}
        for w in rng.sample([w for w in writes if w[0] == key], k=min(3, sum(w[0] == key for w in writes))):
            clock = {a: max(clock.get(a, 0), w[4].get(a, 0)) for a in clock | w[4]}
        n = clock_of[key, actor] = clock_of.get((key, actor), 0) + 1
        for w in writes:  # an actor has seen its own writes
            if w[0] == key and w[2] == actor:
                clock = {a: max(clock.get(a, 0), w[4].get(a, 0)) for a in clock | w[4]}
        writes.append((key, f"v{i}", actor, n, clock | {actor: n}))
    frame = spark.createDataFrame([*writes, writes[0], writes[-1]], "key string, value string, actor string, counter long, clock map<string, long>")
    got = sorted(r["value"] for r in crdt.undominated_writes(frame).collect())
    assert got == sorted(w[1] for w in writes if not any(o[0] == w[0] and o != w and o[4].get(w[2], 0) >= w[3] for o in writes))


def test_pulls(spark):
    log = [("s", i, "ab"[i % 2], i != 7, f"k{i}", f"v{i}") for i in range(4, 11)] + [("t", 1, "a", True, "k", "v")]
    log = spark.createDataFrame(log, "space string, seq long, actor string, valid boolean, key string, value string")
    readers = spark.createDataFrame([("s", "a", 5), ("s", "b", 3), ("s", "c", 2), ("s", "d", 10), ("t", "a", 0), ("none", "a", 4)], "space string, reader string, cursor long")
    got = {(r["space"], r["reader"]): tuple(r)[2:] for r in crdt.pulls(log, readers).collect()}
    assert got == {
        ("s", "a"): (False, 2, 1, 3, 1, 10), ("s", "b"): (False, 0, 4, 2, 1, 10), ("s", "c"): (True, 0, 0, 0, 0, 10),
        ("s", "d"): (False, 7, 0, 0, 0, 10), ("t", "a"): (False, 0, 0, 1, 0, 1), ("none", "a"): (False, 0, 0, 0, 0, 4),
    }
    assert {(r["reader"], r["seq"]) for r in crdt.pulled(log, readers).collect()} == {("a", 9), ("b", 4), ("b", 6), ("b", 8), ("b", 10)}
