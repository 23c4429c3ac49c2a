"""Merges of JSON documents and contexts of layers against plain folds."""

from __future__ import annotations

import json
import random

from sparkloom.operators import context, layers


def flat(value, path=""):
    if isinstance(value, dict) and value:
        for k, v in value.items():
            name = k.replace("~", "~0").replace("/", "~1")
            yield from flat(v, f"{path}/{name}" if path else name)
    else:
        yield path, json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def some(rng, depth=0):
    kind = rng.random()
    if depth < 3 and kind < (0.9 if depth == 0 else 0.45):
        return {rng.choice(["a", "b", "c/d", "~"]): some(rng, depth + 1) for _ in range(rng.randrange(4))}
    if kind < 0.7:
        return [rng.choice([1, 2, "x", [1], {"k": 1}, None]) for _ in range(rng.randrange(4))]
    return rng.choice([1, "text", True, None, "é\n\""])


def test_documents(spark):
    rng = random.Random(7)
    rows = [(f"d{i}", o, json.dumps(some(rng)) if rng.random() > 0.08 else "no { json") for i in range(60) for o in range(rng.randrange(1, 6))]
    got = {}
    for r in layers.merge_documents(spark.createDataFrame([*rows, ("d0", 9, None)], "id string, ordinal int, content string")).collect():
        got.setdefault(r["id"], set()).add((r["path"], r["value"]))
    want = {}
    for i in {r[0] for r in rows}:
        values = [context.parse_or_text(c) for _, _, c in sorted((r for r in rows if r[0] == i), key=lambda r: -r[1])]
        out = values[0]
        for v in values[1:]:
            out = context.merge_values(out, v)
        want[i] = set(flat(out))
    assert got == want


def test_golden(spark):
    rows = [("x", 2, '{"a": {"k": 1, "l": [1, 1, 2]}, "b": 5}'), ("x", 1, '{"a": {"l": [2, 3]}, "b": {"n": {}}}'), ("x", 0, '{"c": "top"}')]
    assert {(r["path"], r["value"]) for r in layers.merge_documents(spark.createDataFrame(rows, "id string, ordinal int, content string")).collect()} == {("a/k", "1"), ("a/l", "[1,1,2,3]"), ("b/n", "{}"), ("c", '"top"')}
    assert layers.merge_documents(spark.createDataFrame([], "id string, ordinal int, content string")).collect() == []


def test_contexts(spark):
    rng = random.Random(3)
    words = lambda: [rng.choice("pqrstu") for _ in range(rng.randrange(4))]
    rows = []
    for i in range(14):
        rows.append({"name": f"l{i:02d}", "priority": i // 2 if i % 3 else i, "path": rng.choice(["", "src", "src/", "src/a", "lib", "src/a/b"]), "mode": rng.choice(["merge", "merge", "extend", "override"]), "patterns": words(), "decisions": words(), "rules": words(), "issues": words(), "file_map": {k: f"{k}{i}" for k in words()}})
    table = spark.createDataFrame([tuple(r.values()) for r in rows], "name string, priority int, path string, mode string, patterns array<string>, decisions array<string>, rules array<string>, issues array<string>, file_map map<string, string>")
    for some_rows in (table, table.where("mode <> 'override'")):
        names = {r["name"] for r in some_rows.select("name").collect()}
        paths = ["src/a/b/c.ts", "src/a", "sr", "lib/x", "", "docs"]
        got = {r["path"]: r for r in layers.resolve_contexts(some_rows, spark.createDataFrame([(p,) for p in [*paths, "src/a"]], "path string")).collect()}
        for p in paths:
            want = context.resolve_layers(sorted((r for r in rows if r["name"] in names), key=lambda r: r["name"]), p)
            if not want["layers"]:
                assert p not in got
                continue
            assert {k: got[p][k] for k in want} == want, p
