"""Rule files, agents and exports by hand."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from sparkloom.sources import configs

FILES = "workspace string, path string, text string"
GOOD = '[[rules]]\nid = "{0}"\npattern = "{0}+"\nseverity = "info"\n[[rules]]\nid = "{0}2"\npattern = "b"\n'


def test_first_usable_candidate(spark):
    rows = [
        ("a", "r.toml", GOOD.format("x")), ("a", ".d/r.toml", GOOD.format("y")),
        ("b", "r.toml", "[[rules"), ("b", ".d/r.toml", GOOD.format("y")),
        ("c", "r.toml", "rules = []"), ("c", ".d/r.toml", '[[rules]]\nid = "z"\n'),
        ("d", "other", GOOD.format("x")), ("e", "r.toml", None), ("e", ".d/r.toml", "rules = 3"), (None, "r.toml", GOOD.format("x")),
        ("f", ".d/r.toml", GOOD.format("y")), ("f", ".d/r.toml", GOOD.format("w")),
    ]
    files = spark.createDataFrame(rows, FILES)
    take = lambda **kw: sorted((r["workspace"], r["source"], r["ordinal"], r["id"], r["severity"]) for r in configs.security_rules(files, ("r.toml", ".d/r.toml"), (("own", "o", "critical"),), **kw).collect())
    made = lambda w, source, x: [(w, source, 0, x, "info"), (w, source, 1, x + "2", "warning")]
    none = [(w, "builtin", 0, "own", "critical") for w in "cde"]
    want = made("a", "r.toml", "x") + made("b", ".d/r.toml", "y") + made("f", ".d/r.toml", "w")
    assert take() == sorted(want + none)
    assert take(append=True) == sorted(want + none + [(w, "builtin", 2, "own", "critical") for w in "abf"])
    assert configs.security_rules(files.limit(0), ("r.toml",)).count() == 0


def test_agents(spark):
    text = (
        "# x\nkey: no\n  ## Agent: One \r\ntext\n```yaml\ntrigger: file-save\r\naction: |\n  do: a\n\tthen b\nscope : file: x\n\nplain\ncooldown: 2s\ntrigger: push\n```\nscope: out\n"
        "## Agent: Two\nno block\n## Agent: Three\n```yaml\n```\n## Agent: FOUR\n```yaml\n\n```\n## Agent: Five\n```yaml\naction: |\noutput: o"
    )
    got = configs.agents(spark.createDataFrame([("w", "a.md", text), ("w", "b.md", None), ("w", "c.md", "")], FILES)).orderBy("ordinal").collect()
    assert [tuple(r)[2:] for r in got] == [
        (1, "One", "push", "file: x", "do: a\nthen b", "brain:{project}:one", 2000),
        (4, "FOUR", "manual", "workspace", "", "brain:{project}:four", 0),
        (5, "Five", "manual", "workspace", "", "o", 0),
    ]
    long = "## Agent: L\n```yaml\naction: |\n" + "  line\n" * 60_000 + "scope: s\n```\n"
    row = configs.agents(spark.createDataFrame([("w", "a.md", long)], FILES)).first()
    assert row["scope"] == "s" and row["action"] == "\n".join(["line"] * 60_000)


def test_telemetry(spark):
    rows = spark.createDataFrame([("p", 3, ["a", "b"], None)], "project string, files int, zones array<string>, name string")
    got = json.loads(configs.telemetry(rows, "project", {"files": F.col("files"), "name": F.col("name")}, {"zones": ("zone", F.col("zones")), "none": ("x", F.lit(None).cast("array<string>"))}).first()["document"])
    assert got["resource_attributes"] == [{"key": "project.files", "value": "3"}, {"key": "project.name", "value": ""}]
    assert got["events"] == [{"name": "project.zones", "attributes": [{"key": "zone.1", "value": "a"}, {"key": "zone.2", "value": "b"}]}, {"name": "project.none", "attributes": []}]


def test_writes_to_two_stores(spark):
    from sparkloom.operators import lifecycle as lc

    row = "key string, body string"
    primary, cache = spark.createDataFrame([("a", "1"), ("b", "1")], row), spark.createDataFrame([("b", "9"), ("c", "9")], row)
    assert sorted(map(tuple, lc.pushed(primary, cache, ["key"]).collect())) == [("a", "1"), ("b", "1"), ("c", "9")]
    writes = spark.createDataFrame([("a", "2", 1), ("a", "3", 2), ("d", "4", 3), (None, "5", 4)], row + ", seq int")
    one, two = lc.written_through(primary, cache, writes, ["key"], "seq")
    assert sorted(map(tuple, one.collect())) == [("a", "3"), ("b", "1"), ("d", "4")]
    assert sorted(map(tuple, two.collect())) == [("a", "3"), ("b", "9"), ("c", "9"), ("d", "4")]
    assert sorted(map(tuple, lc.written_through(primary, cache, writes.limit(0), ["key"], "seq")[0].collect())) == [("a", "1"), ("b", "1")]
