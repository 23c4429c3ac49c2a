"""Relations, migrations, mirrors, filters and exports by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import context, textfilter, upkeep


def test_relations(spark):
    rows = spark.createDataFrame([("a", None, ["x"], 1), ("b", "q", None, 2), ("c", None, [], 3)], "id string, superseded_by string, contradicts array<string>, updated_h int")
    links = [("a", 1, "contradict", "y"), ("a", 2, "contradict", "y"), ("a", 3, "resolve", "x"), ("a", 4, "contradict", " z "), ("a", 5, "resolve", "z"), ("a", 6, "contradict", "z"), ("b", 1, "supersede", "r"), ("b", 2, "supersede", "s"), ("c", 1, "contradict", " "), ("zz", 1, "supersede", "a")]
    got = {r["id"]: tuple(r)[1:] for r in upkeep.related(rows, spark.createDataFrame(links, "id string, seq int, action string, other string"), 9).collect()}
    assert got == {"a": (None, ["y", "z"], 9), "b": ("s", [], 9), "c": (None, [], 3)}


def test_migrations(spark):
    rows = spark.createDataFrame([("a", "FACT", " x ", ["b", "a", "b"]), ("b", "Rule", None, None)], "id string, kind string, content string, tags array<string>")
    once, first = upkeep.migrated(rows, 2)
    twice, second = upkeep.migrated(once, 2)
    want = {("a", "fact", "x", ("a", "b")), ("b", "rule", None, ()), (upkeep.MARKER, "marker", "2", ())}
    for out in (once, twice):
        assert {(r["id"], r["kind"], r["content"], tuple(r["tags"])) for r in out.collect()} == want
    assert (tuple(first.first()), tuple(second.first())) == ((2, 2), (0, 2))
    assert upkeep.migrated(twice, 3)[1].first()["rewritten"] == 2 and upkeep.migrated(rows.limit(0), 1)[0].count() == 1


def test_filters_of_all_tools(spark):
    rows = [("cargo test --all", "running 2 tests\n\nFAILED x\ntest result: bad\n"), ("git push", "a\n" * 40), ("npm ci", "added 3\n"), ("none", "a\n\n\n"), ("pytest", "\x1b[1mtest session starts\x1b[0m\n===\nE  x\n")]
    got = [r[0] for r in spark.createDataFrame(rows, "command string, text string").coalesce(1).select(textfilter.filtered(F.col("command"), F.col("text"))).collect()]
    assert got == ["FAILED x", "\n".join("a" * 10), "npm install: ok", "a\n\n\n", "E  x"]


def test_exports(spark):
    parts = ["abcd", "efghij", "", "kl", "mnopqrstuv", "w"]
    rows = spark.createDataFrame([("r", i, p) for i, p in enumerate(parts)] + [("s", 0, None)], "request string, ordinal int, content string")
    for budget in range(26):
        got = context.exported(rows, budget).collect()
        assert len(got) == 1 and got[0]["text"] == "\n".join(context.char_budget(parts, budget)), budget
        assert got[0]["used"] == sum(map(len, context.char_budget(parts, budget)))


def test_patterns_in_order(spark):
    rows = [("known", 3, 0.5, "a"), ("emergent", 1, 0.5, "b"), ("emergent", 2, 0.1, "c"), ("emergent", 2, 0.9, "d"), ("framework", 9, 0.9, "e")]
    assert [r["id"] for r in upkeep.ordered_patterns(spark.createDataFrame(rows, "tier string, occurrences int, confidence double, id string")).collect()] == ["d", "c", "b", "e", "a"]
