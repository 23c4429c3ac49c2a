"""Queries of budgeted selection, scoring and replication."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context as c
from ..operators import graph
from ..operators import replication as rp
from ..operators import scoring as sc
from ..sources import tables as t
from ..sources.tables import with_adapters as sql
from .graphs import IMPORTANCE
from .graphs import zones

BUDGET = 300


def _sections(s, d):
    pr = F.when(F.col("role") == "system", 100).when(F.col("role") == "user", 85).otherwise(72)
    return t.table(s, d, "conversations").select(F.col("conv_id").alias("request"), F.col("turn").alias("ordinal"), pr.alias("priority"), F.floor(F.octet_length("text") / 4).cast("long").alias("tokens"), F.col("role"))


SEC = "sec AS (SELECT conv_id AS request, turn AS ordinal, CASE role WHEN 'system' THEN 100 WHEN 'user' THEN 85 ELSE 72 END AS priority, strlen(text) // 4 AS tokens, role FROM conversations)"

GREEDY = (
    f"WITH RECURSIVE {SEC}, o AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY role, ordinal) AS r FROM sec), "
    f"f AS (SELECT request, r, ordinal, tokens <= {BUDGET} AS ok, CASE WHEN tokens <= {BUDGET} THEN {BUDGET} - tokens ELSE {BUDGET} END AS rest FROM o WHERE r = 1 "
    "UNION ALL SELECT o.request, o.r, o.ordinal, o.tokens <= f.rest, CASE WHEN o.tokens <= f.rest THEN f.rest - o.tokens ELSE f.rest END FROM f JOIN o ON o.request = f.request AND o.r = f.r + 1) "
    "SELECT request, ordinal FROM f WHERE ok"
)


def _diffs(s, d):
    names = F.array(*[F.lit(x) for x in ("src/api/route.ts", "src/x.test.ts", "app/config.toml", "db/migration/1.sql", "src/main.rs")])
    e = t.table(s, d, "events")
    n = F.col("event_id")
    return e.select("event_id", F.concat(F.get(names, (n % 5).cast("int")), F.lit("#"), n).alias("file"), (n % 6).alias("added"), F.floor(n / 6).cast("long").alias("k")).select("file", "added", (F.col("k") % 4).alias("removed"), (F.floor(F.col("k") / 4).cast("long") % 3).alias("modified"), F.when(F.col("k") % 7 == 0, F.array(F.lit("tests"))).otherwise(F.array().cast("array<string>")).alias("tags"))


def _vote(x):
    return f"(CASE WHEN {x[1]} THEN {x[0]} ELSE 0 END)"


VOTES = {
    "api_design": [(0.30, "contains(p, '/api/') OR contains(p, 'route.') OR contains(p, '/routes/') OR contains(p, 'handler') OR contains(p, 'endpoint')")],
    "bug_fixing": [(0.35, "m > 0 AND m > a AND m > r"), (0.15, "t <= 2 AND m > 0 AND a = 0 AND r = 0")],
    "configuration": [(0.30, "contains(p, 'config') OR contains(p, '.env') OR contains(p, 'settings') OR contains(p, 'toml') OR contains(p, 'yaml') OR contains(p, '.yml')")],
    "refactoring": [(0.35, "r > 0 AND m > 0 AND a <= r"), (0.15, "r >= 3 AND a = 0")],
    "scaffolding": [(0.25, "contains(p, 'migration') OR contains(p, 'seed')"), (0.35, "a > 0 AND r = 0 AND m = 0"), (0.25, "a > 0.6 * t AND a >= 3")],
    "testing": [(0.35, "contains(p, '/test') OR contains(p, '.test.') OR contains(p, '.spec.') OR contains(p, '_test.') OR contains(p, '/spec/')"), (0.20, "tagged")],
}
INTENT_SQL = (
    "WITH d AS (SELECT ['src/api/route.ts', 'src/x.test.ts', 'app/config.toml', 'db/migration/1.sql', 'src/main.rs'][event_id % 5 + 1] || '#' || event_id AS file, event_id % 6 AS a, event_id // 6 % 4 AS r, event_id // 24 % 3 AS m, event_id // 6 % 7 = 0 AS tagged FROM events), "
    "x AS (SELECT *, lower(file) AS p, a + r + m AS t FROM d), v AS (SELECT file, t, " + ", ".join("round(" + " + ".join(map(_vote, vs)) + f", 6) AS {i}" for i, vs in VOTES.items()) + " FROM x), "
    "b AS (SELECT *, greatest(" + ", ".join(VOTES) + ") AS best FROM v) SELECT file, CASE WHEN t = 0 OR best = 0 THEN 'exploration' "
    + " ".join(f"WHEN {i} = best THEN '{i}'" for i in VOTES)
    + " END AS intent, (CASE WHEN t = 0 OR best = 0 THEN 0.25 ELSE least(greatest(best, 0.25), 0.95) END)::DOUBLE AS confidence FROM b"
)


def _risk_files(s, d):
    return zones(s, d).select("file", F.col("fan_in").alias("dependents"), (F.col("changes") % 6).alias("breaks"), (F.col("cx") % 5).alias("issues"), (F.col("fan_out") > 4).alias("stable"), (F.col("changes") > 100).alias("hot"), (F.col("cx") % 2 == 0).alias("breakage"), "changes", (F.col("fan_in") > 6).alias("core"))


ZONES = """z AS (SELECT f.file, coalesce(c.n, 0) AS changes, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out, f.cx FROM (SELECT format('n{:02d}', n_nationkey) AS file, length(n_name) * 3 AS cx FROM nation) f
  LEFT JOIN (SELECT dst, count(*) AS n FROM edges GROUP BY dst) i ON i.dst = f.file LEFT JOIN (SELECT src, count(*) AS n FROM edges GROUP BY src) o ON o.src = f.file
  LEFT JOIN (SELECT format('n{:02d}', user_id % 25) AS file, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1) c ON c.file = f.file)"""


def _commands(s, d):
    return t.table(s, d, "orders").select(F.col("o_orderpriority").alias("command"), F.concat(F.lit("--"), F.col("o_custkey") % 13).alias("arg"))


def _feedback(s, d):
    fb = F.when(F.col("quality") == 1, "useful").when(F.col("toxic") == 1, "incorrect").otherwise("dismissed")
    return t.table(s, d, "labels").select((F.col("doc_id") % 20).alias("rule"), F.col("doc_id").alias("seq"), fb.alias("feedback"))


def _functions(s, d):
    l = t.table(s, d, "lineitem")  # noqa: E741
    flags = F.array_compact(F.array(F.when(F.col("l_returnflag") == "A", F.lit("A")), F.when(F.col("l_linestatus") == "F", F.lit("G")), F.when(F.col("l_quantity") > 25, F.lit("T"))))
    return l.select(flags.alias("flags"), F.col("l_linenumber").alias("params"), F.array(F.col("l_returnflag"), F.col("l_linestatus")).alias("prefix"))


def _ops(s, d):
    e = t.table(s, d, "events")
    return e.select(F.concat(F.lit("k"), F.col("user_id") % 40).alias("key"), F.concat(F.lit("a"), F.col("event_id") % 3).alias("actor"), F.col("event_id").alias("seq"), F.concat(F.lit("v"), F.floor("value").cast("long") % 5).alias("value"))


OPS = "ops AS (SELECT 'k' || (user_id % 40) AS key, 'a' || (event_id % 3) AS actor, event_id AS seq, 'v' || (floor(value)::BIGINT % 5) AS value FROM events)"


def _writes(s, d):
    e = t.table(s, d, "events")
    return e.select((F.col("user_id") % 50).alias("key"), F.col("event_type").alias("value"), (F.col("event_id") % 37).alias("a"), (F.col("event_id") % 41).alias("b"))


def _layers(s, d):
    return t.table(s, d, "supplier").select(F.concat(F.lit("n"), F.col("s_nationkey")).alias("id"), F.col("s_suppkey").alias("ordinal"), F.col("s_name").alias("content"))


def _verbs(s, d):
    return t.table(s, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.concat("l_returnflag", "l_linestatus").alias("item"))


PLANS = {
    "cx3_knapsack": (
        lambda s, d: c.knapsack(_sections(s, d), BUDGET).groupBy("request").agg(F.sum(100 * F.col("priority") + 1).alias("value")),
        f"""WITH RECURSIVE {SEC}, o AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY ordinal) AS r FROM sec),
          f AS (SELECT request, 0::BIGINT AS r, 0::BIGINT AS tk, 0::BIGINT AS v FROM (SELECT DISTINCT request FROM sec) UNION ALL SELECT f.request, o.r, f.tk + k * o.tokens, f.v + k * (100 * priority + 1) FROM f JOIN o ON o.request = f.request AND o.r = f.r + 1, (VALUES (0), (1)) AS x(k) WHERE f.tk + k * o.tokens <= {BUDGET})
          SELECT request, max(v) AS value FROM f GROUP BY request HAVING max(v) > 0""",
    ),
    "cx5_greedy_by_kind": (lambda s, d: c.greedy(_sections(s, d), BUDGET, ["role", "ordinal"]).select("request", "ordinal"), GREEDY),
    "tk7_context_ranking": (
        lambda s, d: c.ranked(_sections(s, d)).select("request", "ordinal", "priority"),
        f"WITH {SEC} SELECT request, ordinal, priority FROM sec ORDER BY request, priority DESC, tokens, ordinal",
    ),
    "cx2_graph_boosts": (
        lambda s, d: graph.importance(t.nation_edges(s, d)).select("node", c.boosted(c.base_priority(F.lit("code-skeleton"), F.col("node") == "n03"), F.col("betweenness"), F.col("pagerank")).alias("priority")),
        sql(IMPORTANCE + ", q AS (SELECT node, CASE WHEN node = 'n03' THEN 95 ELSE 72 END AS p, round(15 * (0.7 * betweenness + 0.3 * pagerank))::INT AS u FROM im) SELECT node, CASE WHEN u > 0 THEN least(p + u, 100) ELSE p END AS priority FROM q", "edges"),
    ),
    "cx9_first_layer": (lambda s, d: c.first_hit(_layers(s, d)), "SELECT 'n' || s_nationkey AS id, arg_min(s_name, s_suppkey) AS content FROM supplier GROUP BY 1"),
    "cl1_intents": (lambda s, d: sc.intents(_diffs(s, d)), INTENT_SQL),
    "cl2_proactive_risk": (
        lambda s, d: sc.proactive_risk(_risk_files(s, d)),
        sql(ZONES + """ SELECT file, risk, CASE WHEN risk >= 0.75 THEN 'checkpoint' WHEN risk >= 0.55 THEN 'review dependents' ELSE 'caution' END AS advice FROM (
          SELECT file, round(least(least(fan_in, 25) / 25 * 0.35 + least(changes % 6, 5) / 5 * 0.3 + least(cx % 5, 5) / 5 * 0.2 + CASE WHEN fan_out > 4 THEN 0.1 ELSE 0 END + CASE WHEN changes > 100 THEN 0.1 ELSE 0 END, 1.0), 6) AS risk FROM z) WHERE risk >= 0.35""", "edges"),
    ),
    "cl3_additive_risk": (
        lambda s, d: sc.additive_risk(_risk_files(s, d)),
        sql(ZONES + """ SELECT file, score, CASE WHEN score <= 20 THEN 'low' WHEN score <= 40 THEN 'medium' WHEN score <= 70 THEN 'high' ELSE 'critical' END AS level, greatest(100 - score, 0) AS stability FROM (
          SELECT file, CASE WHEN fan_in > 20 THEN 30 WHEN fan_in > 10 THEN 15 ELSE 0 END + CASE WHEN cx % 2 = 0 THEN 25 ELSE 0 END + CASE WHEN changes > 10 THEN 15 ELSE 0 END + CASE WHEN fan_in > 6 THEN 20 ELSE 0 END + CASE WHEN cx % 5 > 0 THEN 10 ELSE 0 END AS score FROM z)""", "edges"),
    ),
    "cl11_command_patterns": (
        lambda s, d: sc.command_patterns(_commands(s, d)),
        """WITH c AS (SELECT o_orderpriority AS command, '--' || (o_custkey % 13) AS arg FROM orders), k AS (SELECT command, count(*) AS total FROM c GROUP BY 1)
          SELECT command, arg, frequency, round(0.6 * least(frequency / total, 1.0) + 0.4 * least(frequency / 100, 1.0), 6) AS confidence FROM (SELECT command, arg, count(*) AS frequency FROM c GROUP BY 1, 2 HAVING count(*) >= 3) JOIN k USING (command) ORDER BY confidence DESC, frequency DESC, command, arg LIMIT 50""",
    ),
    "cl12_filter_suggestions": (
        lambda s, d: sc.filter_suggestions(sc.command_patterns(_commands(s, d)).withColumn("confidence", F.col("confidence") + 0.1)),
        """WITH c AS (SELECT o_orderpriority AS command, '--' || (o_custkey % 13) AS arg FROM orders), k AS (SELECT command, count(*) AS total FROM c GROUP BY 1),
          p AS (SELECT command, arg, frequency, round(0.6 * least(frequency / total, 1.0) + 0.4 * least(frequency / 100, 1.0), 6) AS confidence FROM (SELECT command, arg, count(*) AS frequency FROM c GROUP BY 1, 2 HAVING count(*) >= 3) JOIN k USING (command) ORDER BY confidence DESC, frequency DESC, command, arg LIMIT 50)
          SELECT command, '^' || command || ' .*' || arg AS definition FROM p WHERE confidence + 0.1 >= 0.5 AND frequency >= 5""",
    ),
    "cl14_rule_confidence": (
        lambda s, d: sc.confidence_feedback(_feedback(s, d)),
        """WITH RECURSIVE o AS (SELECT doc_id % 20 AS rule, row_number() OVER (PARTITION BY doc_id % 20 ORDER BY doc_id) AS r, CASE WHEN quality = 1 THEN 0.05 WHEN toxic = 1 THEN -0.10 ELSE -0.02 END::DOUBLE AS d FROM labels),
          f AS (SELECT DISTINCT rule, 0::BIGINT AS r, 0.5::DOUBLE AS c FROM o UNION ALL SELECT o.rule, o.r, round(least(greatest(f.c + o.d, 0), 1), 6) FROM f JOIN o ON o.rule = f.rule AND o.r = f.r + 1)
          SELECT rule, arg_max(c, r) AS confidence FROM f GROUP BY rule""",
    ),
    "cl4_shape_clusters": (
        lambda s, d: sc.shape_clusters(_functions(s, d)),
        """WITH s AS (SELECT array_to_string(list_filter([CASE WHEN l_returnflag = 'A' THEN 'A' END, CASE WHEN l_linestatus = 'F' THEN 'G' END, CASE WHEN l_quantity > 25 THEN 'T' END], lambda x: x IS NOT NULL) || [CASE WHEN l_linenumber >= 4 THEN 'p4+' ELSE 'p' || l_linenumber END, l_returnflag, l_linestatus], '|') AS signature FROM lineitem)
          SELECT signature, size, round(least(size / (SELECT count(*) FROM s) * 0.3 + ln(size) / 10 * 0.4 + least(c, 5) / 5 * 0.3, 0.95), 2) AS confidence FROM (SELECT signature, count(*) AS size, len(string_split(signature, '|')) - 1 AS c FROM s GROUP BY 1) WHERE size >= 3 AND c >= 2""",
    ),
    "cl5_constellations": (
        lambda s, d: sc.constellations(_verbs(s, d)),
        """SELECT items, count(*) AS files FROM (SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_returnflag || l_linestatus)), ',') AS items FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag || l_linestatus) >= 2) GROUP BY 1 HAVING count(*) >= 3""",
    ),
    "cl6_sequences": (
        lambda s, d: t.table(s, d, "events").groupBy("user_id").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), 1, 3), lambda x: x["event_type"]), ">").alias("q")).groupBy("q").agg(F.count("*").alias("n")).where("n >= 2"),
        """SELECT q, count(*) AS n FROM (SELECT user_id, string_agg(event_type, '>' ORDER BY ts, event_id) AS q FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r <= 3 GROUP BY user_id) GROUP BY q HAVING count(*) >= 2""",
    ),
    "ag26_error_style": (
        lambda s, d: sc.error_style(t.table(s, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("tries"), F.count_if(F.col("l_linestatus") == "F").alias("results"), F.count("*").alias("functions"))),
        """SELECT CASE WHEN t > 0.3 AND t > r THEN 'try-catch' WHEN r > 0.15 AND t > 0.1 THEN 'mixed' WHEN r > 0.15 THEN 'result' ELSE 'none' END AS style, round(t, 6) AS try_share, round(r, 6) AS result_share FROM (SELECT count(*) FILTER (l_returnflag = 'R') / count(*) AS t, count(*) FILTER (l_linestatus = 'F') / count(*) AS r FROM lineitem)""",
    ),
    "sy1_publish": (
        lambda s, d: rp.publish(t.snapshots(s, d)[1].select("key", "body"), t.snapshots(s, d)[0].select("key", "body"), 1000, 300),
        sql("SELECT key, seq FROM (SELECT key, 1000 + row_number() OVER (ORDER BY key) AS seq, row_number() OVER (ORDER BY key DESC) AS r FROM news n WHERE NOT EXISTS (SELECT 1 FROM olds o WHERE o.key = n.key AND o.body = n.body)) WHERE r <= 300", "snap"),
    ),
    "sy2_pull": (
        lambda s, d: rp.pull(_ops(s, d), "a1", 4000),
        f"WITH {OPS} SELECT count(*) FILTER (actor <> 'a1') AS applied, count(*) FILTER (actor = 'a1') AS own, coalesce(max(seq), 4000) AS cursor FROM ops WHERE seq > 4000",
    ),
    "sy3_registers": (
        lambda s, d: rp.registers(_ops(s, d)).select("key", F.array_join("values", ",").alias("values")),
        f"WITH {OPS} SELECT key, array_to_string(list_sort(list(DISTINCT value)), ',') AS values FROM (SELECT key, actor, arg_max(value, seq) AS value FROM ops GROUP BY 1, 2) GROUP BY key",
    ),
    "sy3_undominated_writes": (
        lambda s, d: rp.undominated(_writes(s, d)),
        """WITH w AS (SELECT DISTINCT user_id % 50 AS key, event_type AS value, event_id % 37 AS a, event_id % 41 AS b FROM events)
          SELECT * FROM w x WHERE NOT EXISTS (SELECT 1 FROM w y WHERE y.key = x.key AND y.a >= x.a AND y.b >= x.b AND (y.a > x.a OR y.b > x.b))""",
    ),
    "sy4_conflict_projection": (
        lambda s, d: rp.project_conflicts(_ops(s, d).groupBy("key").agg(F.min_by("value", "seq").alias("content")), rp.registers(_ops(s, d))),
        f"""WITH {OPS}, v AS (SELECT key, list_sort(list(DISTINCT value)) AS vs FROM (SELECT key, actor, arg_max(value, seq) AS value FROM ops GROUP BY 1, 2) GROUP BY key), r AS (SELECT key, arg_min(value, seq) AS content FROM ops GROUP BY key)
          SELECT key, CASE WHEN list_contains(vs, content) THEN content ELSE vs[1] END AS content, len(vs) > 1 AS conflict FROM r JOIN v USING (key)""",
    ),
    "sy5_snapshot": (
        lambda s, d: _ops(s, d).groupBy("actor").agg(F.array_join(F.sort_array(F.collect_set("key")), ",").alias("keys"), F.max("seq").alias("counter")),
        f"WITH {OPS} SELECT actor, array_to_string(list_sort(list(DISTINCT key)), ',') AS keys, max(seq) AS counter FROM ops GROUP BY actor",
    ),
}
