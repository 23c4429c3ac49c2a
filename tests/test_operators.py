"""Goldens and properties of operators on small hand-made inputs."""

from __future__ import annotations

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import scalars as fn
from sparkloom.operators import codefilter, context, events, extraction, graph, memory, replication, rules, scoring, search, stats, textfilter
from sparkloom.sources import files
from sparkloom.streaming import events as streams


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def table(df, *cols):
    return {r[cols[0]]: (r[cols[1]] if len(cols) == 2 else tuple(r[c] for c in cols[1:])) for r in df.collect()}


def test_betweenness_and_rank(spark):
    chain = table(graph.betweenness(edges(spark, ("A", "B"), ("B", "C"), ("C", "D"))), "node", "betweenness")
    assert chain == {"A": 0.0, "B": 1.0, "C": 1.0, "D": 0.0}
    star = table(graph.pagerank(edges(spark, ("D", "B"), ("E", "B"), ("F", "B"), ("B", "A"))), "node", "pagerank")
    assert star["B"] > star["D"] and max(star.values()) == 1.0
    hub = graph.importance(edges(spark, ("A", "B"), ("C", "B"), ("D", "B"), ("B", "E"), ("B", "F"))).orderBy(F.desc("score")).first()
    assert hub["node"] == "B"


def test_components_and_order(spark):
    cycle = edges(spark, ("A", "B"), ("B", "C"), ("C", "A"), ("C", "D"), ("E", "F"), ("F", "E"), ("X", "X"))
    assert table(graph.strong_components(cycle), "node", "component") == {"A": "A", "B": "A", "C": "A", "E": "E", "F": "E"}
    assert graph.topological_order(cycle).count() == 0
    assert table(graph.topological_order(edges(spark, ("A", "B"), ("B", "C"), ("A", "C"))), "node", "level") == {"A": 0, "B": 1, "C": 2}


def test_blast_radius(spark):
    e = edges(spark, ("A", "B"), ("B", "C"))
    b = graph.blast_radius(e, "C")
    assert table(b, "node", "depth", "via") == {"B": (1, "C"), "A": (2, "B")}
    targets = spark.createDataFrame([("C",), ("B",), ("A",)], "node string")
    many = graph.blast_radii(edges(spark, ("A", "B"), ("B", "C"), ("D", "C")), targets)
    assert {(r["request"], r["node"], r["depth"], r["via"], tuple(r["path"])) for r in many.collect()} == {("C", "B", 1, "C", ("C", "B")), ("C", "D", 1, "C", ("C", "D")), ("C", "A", 2, "B", ("C", "B", "A")), ("B", "A", 1, "B", ("B", "A"))}
    assert table(graph.critical_paths(many), "request", "path") == {"C": ["C", "B", "A"], "B": ["B", "A"]}
    assert [r["node"] for r in graph.blast_radius(edges(spark, ("A", "B"), ("B", "C"), ("C", "D")), "D", 1).collect()] == ["C"]
    none = edges(spark).limit(0)
    assert graph.blast_radius(none, "C").count() == 0 and graph.pagerank(none).count() == 0


def test_knapsack_is_optimal():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randrange(0, 8)
        tokens, prio = [rng.randrange(0, 12) for _ in range(n)], [rng.choice((72, 85, 100)) for _ in range(n)]
        budget = rng.randrange(0, 30)
        got = context.knapsack_of(tokens, prio, budget)
        value = lambda xs: sum(100 * prio[i] + 1 for i in xs)  # noqa: E731, B023
        best = max(value(xs) for k in range(n + 1) for xs in itertools.combinations(range(n), k) if sum(tokens[i] for i in xs) <= budget)
        assert sum(tokens[i] for i in got) <= budget and value(got) == best


def test_greedy_skips_and_goes_on(spark):
    rows = spark.createDataFrame([(1, 0, 50, "a"), (1, 1, 60, "b"), (1, 2, 40, "a"), (1, 3, 50, "c")], "request int, ordinal int, tokens int, body string")
    assert sorted(r["ordinal"] for r in context.greedy(rows, 100, ["ordinal"]).collect()) == [0, 2]
    assert sorted(r["ordinal"] for r in context.greedy(rows, 100, ["ordinal"], distinct="body").collect()) == [0, 3]
    assert context.char_budget(["abcd", "efghijklmn", "x"], 10) == ["abcd", "efg..."]


def test_layers(spark):
    base = {"patterns": [], "decisions": [], "rules": [], "issues": [], "file_map": {}}
    layers = [
        base | {"name": "a", "path": "", "priority": 3, "mode": "merge", "patterns": ["x"], "rules": ["r1"]},
        base | {"name": "b", "path": "src", "priority": 2, "mode": "merge", "patterns": ["x", "y"]},
        base | {"name": "c", "path": "src/z", "priority": 1, "mode": "extend", "patterns": ["w"], "rules": ["r0"]},
        base | {"name": "d", "path": "lib", "priority": 9, "mode": "override", "patterns": ["q"]},
    ]
    got = context.resolve_layers(layers, "src/z/f.ts")
    assert (got["patterns"], got["rules"], got["conflicts"], got["layers"]) == (["w", "x", "y"], ["r0", "r1"], 1, ["a", "b", "c"])
    rows = spark.createDataFrame([("k", 0, '{"a": [1, 2], "b": 1}'), ("k", 1, '{"a": [2, 3], "c": {"d": 1}}'), ("j", 0, "plain")], "id string, ordinal int, content string")
    merged = table(context.merged_layers(rows), "id", "content")
    assert json.loads(merged["k"]) == {"a": [2, 3, 1], "b": 1, "c": {"d": 1}} and json.loads(merged["j"]) == "plain"


@pytest.mark.parametrize(
    ("file", "a", "r", "m", "want"),
    [("src/x.rs", 5, 0, 0, "scaffolding"), ("src/api/route.ts", 2, 0, 1, "api_design"), ("src/a.test.ts", 3, 0, 1, "testing"), ("src/x.rs", 0, 0, 2, "bug_fixing"), ("src/x.rs", 1, 4, 2, "refactoring"), ("src/x.rs", 0, 0, 0, "exploration")],
)
def test_intents(spark, file, a, r, m, want):
    got = scoring.intents(spark.createDataFrame([(file, a, r, m, ["tests"] if want == "testing" else [])], "file string, added int, removed int, modified int, tags array<string>")).first()
    assert got["intent"] == want and 0.25 <= got["confidence"] <= 0.95


def test_dominance_and_feedback(spark):
    rows = spark.createDataFrame(
        [("p", "a", "known", 0.9, ["f1", "f2"]), ("p", "b", "emergent", 0.5, ["f1", "f2"]), ("p", "a", "emergent", 0.99, ["f9"]), ("p", "c", "framework", 0.95, ["f1"]), ("p", "d", "emergent", 0.4, ["f3"])],
        "project string, id string, tier string, confidence double, evidence array<string>",
    )
    assert sorted(r["id"] for r in scoring.dominance(rows).collect()) == ["a", "c", "d"]
    fb = spark.createDataFrame([("r", i, "useful") for i in range(12)] + [("r", 12, "incorrect"), ("s", 0, "odd")], "rule string, seq int, feedback string")
    assert table(scoring.confidence_feedback(fb), "rule", "confidence") == {"r": 0.9, "s": 0.5}


def test_memory_rows(spark):
    rows = spark.createDataFrame(
        [("a", 'api_key = "abcdefghijklmnopqrstuv"', [], 1), ("b", "plain", [], 1), ("c", "", [], 1), ("d", "x", ["t"] * 21, 1), ("e", 'password: "hunter2"', [], 1)], "id string, content string, tags array<string>, updated_h int"
    )
    assert table(memory.validated(rows), "id", "reason") == {"a": "secret", "b": None, "c": "empty", "d": "too many tags", "e": "secret"}
    assert rows.select(memory.redact(F.col("content")).alias("x")).where("x like '%[REDACTED]%'").count() == 2
    new = spark.createDataFrame([("b", "newer", [], 2), ("z", "new", [], 1)], rows.schema)
    after, ack = memory.apply_batch(rows, new, rows.where("id = 'a'"))
    assert table(after, "id", "content")["b"] == "newer" and "a" not in table(after, "id", "content") and "z" in table(after, "id", "content")
    assert tuple(ack.first()) == (2, 0, 1)


def test_text_filters(spark):
    one = spark.range(1)
    run = lambda f, text: one.select(textfilter.applied(f, F.lit(text)).alias("x")).first()["x"]
    assert run(textfilter.Filter("f", "^f", ("^$",), head=3), "line1\n\nline2\n\nline3\nline4") == "line1\nline2\nline3"
    assert run(textfilter.Filter("f", "^f"), "\x1b[31mHello\x1b[0m World") == "Hello World"
    assert run(textfilter.Filter("f", "^f", ("^x",), on_empty="none"), "x\nxy\n") == "none"
    assert run(textfilter.Filter("f", "^f", replace=(("b+", "-"),)), "abbcb\nzz") == "a-cb\nzz"
    assert run(textfilter.Filter("f", "^f", short=("all ok", "fine", "but")), "all ok") == "fine"
    assert run(textfilter.Filter("f", "^f", tail=2), "1\n2\n3\n") == "2\n3"
    assert len(textfilter.BUILTIN) == 42 and run(textfilter.Filter("f", "^f", ("a",), keep=("b",)), "a\nb\nc") == "b\nc"


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    assert get(fn.file_id(F.lit("./src/main.rs"))) == "fsi::src/main.rs" and get(fn.symbol_id(F.lit("src\\main.rs"), F.lit("Foo::bar"), F.lit("fn"))) == "fusi::src/main.rs::Foo_bar::fn"
    assert get(fn.truncated(F.lit("日本語テキスト"), 5)) == "日本..." and get(fn.format_tokens(F.lit(59234))) == "59.2K" and get(fn.human_bytes(F.lit(1536))) == "1.5 KB"
    assert get(fn.format_usd(F.lit(0.0096))) == "$0.0096" and get(fn.cooldown_ms(F.lit("every 5 minutes"))) == 300_000
    assert get(fn.signature_head(F.lit("  fn a(b) { x }\n}"))) == "fn a(b)" and get(fn.line_count(F.lit("a\nb\n"))) == 2
    assert fn.terms("Fix the (API)! é ok") == ["fix", "the", "api"]


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, [1.0]), (5, [1.0, 0.0])], "vec_id int, embedding array<float>")
    assert [(r["vec_id"], r["score"]) for r in search.vector_topk(v, [1.0, 0.0], 3).collect()] == [(1, 1.0), (5, 1.0), (2, 0.0)]
    assert search.vector_topk(v, [0.0, 0.0], 3).count() == 0


def test_replication(spark):
    vals = spark.createDataFrame([("k", "b"), ("l", "z")], "key string, content string")
    got = replication.project_conflicts(vals, spark.createDataFrame([("k", ["a", "b"]), ("l", ["a", "b"]), ("m", [])], "key string, values array<string>"))
    assert table(got, "key", "content", "conflict") == {"k": ("b", True), "l": ("a", True)}
    rows = spark.createDataFrame([(6, 12, 5), (7, 12, 5), (10, 12, 5), (0, 0, 0)], "c int, s int, n int")
    start, gap = replication.pull_start(F.col("c"), F.col("s"), F.col("n"))
    assert [(r[0], r[1]) for r in rows.select(start, gap).collect()] == [(0, True), (0, False), (3, False), (0, False)]


def test_rules(spark):
    rows = [("src/api/route.ts", "GET", "function", "typescript", "b", 3, True, [], 0), ("src/x_service/service/a.py", "OrderService", "class", "python", "b", 2, True, [], 0), ("lib\\u.rs", "f", "function", "rust", "b", 1, False, [], 0), ("m.rs", "g", "function", "rust", "b", 1, False, [], 0)]
    s = spark.createDataFrame(rows, "file string, name string, kind string, language string, body string, complexity int, exported boolean, tags array<string>, start int")
    custom = rules.load_rules('[[file_category_rules]]\nid = "c"\nclassify_as = "feature"\npath_patterns = ["(^|/)m.rs"]\n[[file_category_rules]]\nid = "bad"\nclassify_as = "odd"\npath_patterns = ["(unclosed"]\n', "file_category_rules", "classify_as")
    got = table(rules.categorized(rules.files_of(s), custom + rules.CATEGORIES), "file", "category")
    assert got == {"src/api/route.ts": "api-surface", "src/x_service/service/a.py": "domain-services", "lib\\u.rs": "shared-library", "m.rs": "feature"}
    d = spark.createDataFrame([(1, "dependency", "added", "redis")], "signal int, kind string, trigger string, subject string")
    assert [r["title"] for r in rules.decisions(d, [rules.Decision("a", "dependency", "added", "^red", "Use {name}"), rules.Decision("b", "dependency", "added", "(", "any")]).collect()] == ["Use redis", "any"]


def test_extraction(spark):
    py = "import os\n\ndef test_a(x):\n    if x and y:\n        return os.path.join(x)\n\nclass B:\n    def _m(self):\n        pass\n"
    got = extraction.extract(spark.createDataFrame([("a.py", py), ("b.ts", "export function useX() {\n  if (a && b) { run(1) }\n}\nclass Z {}\n"), ("c.txt", "x"), ("d.py", "def ("), ("e.py", None)], "file string, text string")).collect()
    assert [(r["name"], r["kind"], r["complexity"], r["exported"]) for r in got if r["file"] == "a.py"] == [("test_a", "function", 3, True), ("B", "class", 1, True), ("_m", "function", 1, False)]
    assert [(r["name"], r["exported"], r["calls"]) for r in got if r["file"] == "b.ts"] == [("useX", True, ["run"]), ("Z", False, [])]
    assert len(got) == 5
    lines = [("py", "from a.b import c\nimport d\nx = 1"), ("js", "import x from 'y'\r\nimport z"), ("rs", "use a::b;\npub use c;"), ("go", "import x from 'y'"), ("ts", None)]
    names = spark.createDataFrame(lines, "ext string, text string").select(extraction.imports(F.col("ext"), F.col("text")).alias("n")).collect()
    assert [r["n"] for r in names] == [["a.b", "d"], ["y"], ["a::b"], [], None]


def test_code_filters():
    assert codefilter.without_comments('{"a/*": 1, "b//": 2}', "json") == '{"a/*": 1, "b//": 2}'
    assert codefilter.without_comments("// c\nlet a = 1;\n/* x\ny */\nlet b;", "rust") == "let a = 1;\nlet b;"
    long = "\n".join(["fn a() {"] + [f"x{i}" for i in range(199)])
    out = codefilter.smart_truncate(long, 20).split("\n")
    kept = [x for x in out if "omitted" not in x]
    assert len(kept) + sum(int(x.split()[1]) for x in out if "omitted" in x) == 200 and kept[0] == "fn a() {"
    assert codefilter.skeleton("use x;\nfn a() {\n  let_it_be();\n}\n", "rust") == "use x;\nfn a() {\n}"


def test_event_operators(spark):
    rows = [(i, 100 * i, "mutation" if i % 2 else "intent", f"f{i % 3}", None, None, None, "p", float(i)) for i in range(6)]
    log = spark.createDataFrame(rows, "event_id int, sec int, kind string, file string, intent string, severity int, tokens int, project string, value double")
    assert sorted(r["event_id"] for r in events.ring(log, 3).collect()) == [3, 4, 5]
    assert sorted(r["sec"] for r in events.cooldown(log, "project", 150).collect()) == [0, 200, 400]
    assert events.session_analytics(log).first()["events_per_minute"] == 0.72
    assert events.session_analytics(log.limit(0)).first()["span_secs"] == 0
    snaps = spark.createDataFrame([(1, 1, 5), (1, 2, 9), (1, 3, 12)], "session int, seq int, total int")
    assert stats.lifetime(snaps).first()["total"] == 12


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i:02d}:00", i % 3, ("click", "view")[i % 2], float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    for k in range(3):
        df.where(f"event_id between {10 * k} and {10 * k + 9}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: streams.file_stream(spark, str(tmp_path / "in"), df.schema, 1)
    streams.run_to_table(streams.running_counters(stream()), "counters", str(tmp_path / "c1"))
    assert sorted(map(tuple, spark.table("counters").collect())) == sorted(map(tuple, df.groupBy("event_type").agg(F.count("*"), F.sum("value")).collect()))
    streams.run_to_table(streams.cooldown_stream(stream(), 400), "cool", str(tmp_path / "c2"), "append")
    log = df.select("event_id", F.unix_timestamp("ts").alias("sec"), "user_id")
    assert {r["event_id"] for r in spark.table("cool").collect()} == {r["event_id"] for r in events.cooldown(log, "user_id", 400).collect()}
    streams.upsert_batches(stream(), str(tmp_path / "out"), ["user_id"], "event_id", str(tmp_path / "c3"))
    last = streams.upserted(spark, str(tmp_path / "out"), df.schema)
    assert table(last, "user_id", "event_id") == {0: 27, 1: 28, 2: 29}
    df.where("event_id = 3").withColumn("event_id", F.lit(40).cast("long")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    streams.upsert_batches(stream(), str(tmp_path / "out"), ["user_id"], "event_id", str(tmp_path / "c3"))
    assert table(streams.upserted(spark, str(tmp_path / "out"), df.schema), "user_id", "event_id") == {0: 40, 1: 28, 2: 29}
    assert len(list((tmp_path / "out/rows/epoch=3").glob("bucket=*"))) == 1  # the bucket of the one key alone


def test_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1")
    (tmp_path / "node_modules/b.py").write_text("y")
    (tmp_path / "src/c.txt").write_text("z")
    assert [r["text"] for r in files.workspace(spark, str(tmp_path)).collect()] == ["x = 1"]
    mirror = tmp_path / "mirror"
    mirror.mkdir()
    (mirror / "one.json").write_text(json.dumps({"id": "a", "project_id": "p", "content": "c"}))
    (mirror / "two.json").write_text("{ broken")
    (mirror / "pending.json").write_text(json.dumps({"id": "b", "project_id": "p"}))
    (mirror / "other.json").write_text(json.dumps({"id": "c", "project_id": "q"}))
    got = files.import_mirror(spark, str(mirror), "p")
    assert [r["id"] for r in got.collect()] == ["a"]
    files.export_mirror(got, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    deps = files.dependencies(spark.createDataFrame([('{"dependencies": {"b": "1", "a": "2"}, "devDependencies": {"c": "1"}}',)], "text string"))
    assert [r["name"] for r in deps.collect()] == ["a", "b", "c"]
    spec = files.agent_specs("# x\n## Agent: One\n```yaml\ntrigger: file-save\nprompt: |\n  a\n  b\n```\n## Agent: Two\nno block\n")
    assert spec == [{"name": "One", "trigger": "file-save", "prompt": "a\nb"}]
    assert files.otel_export({"k": 1}, ["e"])["events"][0]["attributes"][0]["value"] == 1
