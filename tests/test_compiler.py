"""The context compiler on a small project."""

from __future__ import annotations

from sparkloom.operators import graph
from sparkloom.plans import compiler


def test_compile(spark):
    edges = spark.createDataFrame([("a.ts", "b.ts"), ("b.ts", "c.ts"), ("c.ts", "d.ts"), ("x.ts", "y.ts")], "src string, dst string")
    symbols = spark.createDataFrame([(f, f"fn{i}", "function", i, 1) for f in ("a.ts", "b.ts", "c.ts", "d.ts", "x.ts") for i in range(6)], "file string, name string, kind string, start int, complexity int")
    memory = spark.createDataFrame([("see b.ts",), ("b.ts again",), ("b.ts thrice",), ("nothing",)], "content string")
    log = spark.createDataFrame([(i, i, "mutation", f"f{i}", None, "p") for i in range(9)], "event_id int, sec int, kind string, file string, intent string, project string")
    rules = spark.createDataFrame([("r.md", "a warning\nother\nFind fn3 here"), ("q.md", "nothing fits")], "file string, text string")
    scores = graph.importance(edges)
    got = {r["id"]: r for r in compiler.sections("a.ts", edges, symbols, memory, log, rules, scores, "bug_fix", "fn3 find").collect()}
    assert set(got) == {"active:file", "code:a.ts", "code:b.ts", "code:c.ts", "history:p", "rules:r.md"}
    assert got["code:b.ts"]["content"].count("\n") == 3 and got["code:c.ts"]["content"].count("\n") == 6
    assert got["rules:r.md"]["content"] == "a warning\nFind fn3 here" and got["code:c.ts"]["priority"] > 72
    rows = compiler.sections("a.ts", edges, symbols, memory, log, rules, scores, "bug_fix", "fn3 find")
    chosen, metrics = compiler.compile_context(rows, 60)
    m = metrics.first()
    assert m["considered"] == 6 and 0 < m["tokens"] <= 60 and chosen.count() == m["selected"]
    assert compiler.compile_context(rows, 0)[1].first()["selected"] == 0


def test_all_requests_in_one_plan(spark):
    """Each request's sections are those of sections() for it alone, and its budget is filled apart from others."""
    edges = spark.createDataFrame([("a.ts", "b.ts"), ("b.ts", "c.ts"), ("c.ts", "d.ts"), ("x.ts", "y.ts")], "src string, dst string")
    symbols = spark.createDataFrame([(f, f"fn{i}", "function", i, 1) for f in ("a.ts", "b.ts", "c.ts", "d.ts", "x.ts") for i in range(6)], "file string, name string, kind string, start int, complexity int")
    memory = spark.createDataFrame([("see b.ts",), ("b.ts again",), ("b.ts again",), ("x.ts",), (None,)], "content string")
    log = spark.createDataFrame([(i, i, "mutation", f"f{i}", None, "p") for i in range(9)] + [(20, 20, "mutation", "f", None, "q")], "event_id int, sec int, kind string, file string, intent string, project string")
    rules = spark.createDataFrame([("r.md", "a warning\nother\nFind fn3 here"), ("q.md", "nothing fits")], "file string, text string")
    scores = spark.createDataFrame([("b.ts", 1.0, 0.5), ("c.ts", 0.4, 1.0)], "node string, betweenness double, pagerank double")
    requests = spark.createDataFrame([(1, "a.ts", "p"), (2, "x.ts", "q"), (3, "d.ts", "p")], "request long, active string, project string")
    rows = compiler.sections_of_all(requests, edges, symbols, memory, log, rules, scores, "bug_fix", "fn3 find")
    got = rows.collect()
    for request, active, project in ((1, "a.ts", "p"), (2, "x.ts", "q"), (3, "d.ts", "p")):
        own = compiler.sections(active, edges, symbols, memory, log.where(f"project = '{project}'"), rules, scores, "bug_fix", "fn3 find").collect()
        plain = lambda rs: {(r["id"], r["kind"], r["priority"], r["content"], r["tokens"]) for r in rs}
        assert plain(r for r in got if r["request"] == request) == plain(own)
    chosen, metrics = compiler.compile_all(rows, 60)
    taken = chosen.collect()
    for m in metrics.collect():
        mine, all_ = [r for r in taken if r["request"] == m["request"]], [r for r in got if r["request"] == m["request"]]
        assert (m["considered"], m["selected"], m["tokens"]) == (len(all_), len(mine), sum(r["tokens"] for r in mine)) and m["tokens"] <= 60
        best = {0: 0}
        for r in all_:  # the greatest value by tokens, by plain enumeration
            for t, v in sorted(best.items(), reverse=True):
                if t + r["tokens"] <= 60:
                    best[t + r["tokens"]] = max(best.get(t + r["tokens"], 0), v + 100 * r["priority"] + 1)
        assert m["value"] == max(best.values())
