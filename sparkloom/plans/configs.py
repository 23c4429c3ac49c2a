"""Queries of workspaces' settings, exports of summaries, and writes to two stores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import lifecycle as lc
from ..operators.memory import SECURITY
from ..sources import configs
from ..sources import tables as t
from ..sources.tables import with_adapters as sql

CANDIDATES = ("security.toml", ".settings/security.toml")


def _rule_files(s, d):
    """Files of customers' workspaces by account: every second has one at the root, of which every third does not parse or is
    without rules; two of three have one in the settings folder; some have neither."""
    c = t.table(s, d, "customer")
    n = F.col("c_custkey")
    rule = lambda k, p: F.concat(F.lit('[[rules]]\nid = "'), F.lit(k), n, F.lit('"\npattern = \''), p, F.lit("'\n"))
    root = F.when(n % 6 == 0, F.lit("[[rules")).when(n % 6 == 2, F.lit("rules = []")).otherwise(F.concat(rule("r", F.col("c_mktsegment")), F.lit('severity = "info"\n'), rule("q", F.lit("\\d+"))))
    files = F.array_compact(F.array(
        F.when(n % 2 == 0, F.struct(F.lit(CANDIDATES[0]).alias("path"), root.alias("text"))), F.when(n % 3 != 1, F.struct(F.lit(CANDIDATES[1]).alias("path"), rule("s", F.lit("a b")).alias("text"))),
        F.struct(F.lit("readme.md").alias("path"), F.lit("[[rules]]").alias("text")),
    ))
    return c.select(F.concat(F.lit("w"), n).alias("workspace"), F.explode(files).alias("f")).select("workspace", "f.path", "f.text")


def _rules(s, d, append):
    return configs.security_rules(_rule_files(s, d), CANDIDATES, append=append).select("workspace", "source", "ordinal", "id", "severity")


_BUILTIN = ", ".join(f"({i}, '{a}', '{c}')" for i, (a, _, c) in enumerate(SECURITY))
RULES_SQL = f"""WITH o AS (SELECT c_custkey AS n, 'security.toml' AS source, 0::BIGINT AS ordinal, 'r' || c_custkey AS id, 'info' AS severity FROM customer WHERE c_custkey % 6 = 4
    UNION ALL SELECT c_custkey, 'security.toml', 1, 'q' || c_custkey, 'warning' FROM customer WHERE c_custkey % 6 = 4
    UNION ALL SELECT c_custkey, '.settings/security.toml', 0, 's' || c_custkey, 'warning' FROM customer WHERE c_custkey % 3 <> 1),
  k AS (SELECT c_custkey AS n, CASE WHEN c_custkey % 6 = 4 THEN 2 WHEN c_custkey % 3 <> 1 THEN 1 ELSE 0 END AS k FROM customer), b(i, id, severity) AS (VALUES {_BUILTIN})
  SELECT 'w' || n AS workspace, source, ordinal, id, severity FROM o UNION ALL SELECT 'w' || n, 'builtin', (k + i)::BIGINT, id, severity FROM k CROSS JOIN b WHERE """


def _agent_files(s, d):
    """Parts as agents, whose files are of a brand, a type and a thousand keys: every fifth has no block, others leave out a field or have an action of lines."""
    n = F.col("p_partkey")
    line = lambda k, c, when: F.when(when, F.concat(F.lit(k + ": "), c, F.lit("\n"))).otherwise(F.lit(""))
    block = F.concat(F.lit("```yaml\n"), line("trigger", F.lit("file-save"), n % 2 == 0), line("cooldown", F.concat((n % 9).cast("string"), F.lit("s")), n % 3 == 0), line("scope", F.col("p_type"), n % 7 != 0),
                     F.lit("action: |\n  "), F.col("p_name"), F.lit("\n  at: "), F.col("p_brand"), F.lit("\nnote\n"), line("output", F.lit("o"), n % 4 == 0), F.lit("```\nscope: no\n"))
    section = F.concat(F.lit("## Agent: "), F.col("p_name"), F.lit(" "), n, F.lit("\nwhat it does\n"), F.when(n % 5 == 0, "").otherwise(block))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(n.alias("n"), section.alias("x")))), lambda x: x["x"]), "\n")
    return t.table(s, d, "part").groupBy(F.col("p_brand").alias("workspace"), F.concat("p_type", F.lit("/"), F.floor(n / 1000)).alias("path")).agg(F.concat(F.lit("# Agents\n\n"), text).alias("text"))


AGENTS_SQL = """WITH p AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type, p_partkey // 1000 ORDER BY p_partkey) AS r, p_partkey AS n FROM part)
  SELECT p_brand AS workspace, p_type || '/' || (n // 1000) AS path, r AS ordinal, p_name || ' ' || n AS name, CASE WHEN n % 2 = 0 THEN 'file-save' ELSE 'manual' END AS trigger, CASE WHEN n % 7 <> 0 THEN p_type ELSE 'workspace' END AS scope,
    p_name || chr(10) || 'at: ' || p_brand AS action, CASE WHEN n % 4 = 0 THEN 'o' ELSE 'brain:{project}:' || lower(p_name) || ' ' || n END AS output, CASE WHEN n % 3 = 0 THEN n % 9 * 1000 ELSE 0 END::BIGINT AS cooldown_ms FROM p WHERE n % 5 <> 0"""


def _telemetry(s, d):
    """A summary of each brand's parts: its five largest ones in order as zones, itself as risk where it has an even number."""
    p = t.table(s, d, "part")
    r = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_size"), "p_partkey"))
    first = p.select("p_brand", "p_partkey", "p_size", r.alias("r")).where("r <= 5").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("r", "p_partkey"))).alias("z"))
    zones = F.transform("z", lambda x: F.concat(F.lit("part"), x["p_partkey"]))
    own = p.groupBy("p_brand").agg(F.count("*").alias("files"), F.format_string("%.4f", F.count_if(F.col("p_size") > 25) / F.count("*")).alias("large")).join(first, "p_brand")
    out = configs.telemetry(own, "p_brand", {"indexed_files": F.col("files"), "large_share": F.col("large")}, {"hot_zones": ("zone", zones), "circular_risks": ("risk", F.when(F.col("files") % 2 == 0, F.array("p_brand")))})
    return out.select("p_brand", F.md5("document").alias("digest"), F.length("document").alias("length"))


TELEMETRY_SQL = """WITH p AS (SELECT p_brand, p_partkey AS n, p_size AS z, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS r FROM part),
  g AS (SELECT p_brand, '{"resource_attributes":[{"key":"project.indexed_files","value":"' || count(*) || '"},{"key":"project.large_share","value":"' || printf('%.4f', count(*) FILTER (z > 25) / count(*)) || '"}],"events":[{"name":"project.hot_zones","attributes":['
    || string_agg('{"key":"zone.' || r || '","value":"part' || n || '"}', ',' ORDER BY r) FILTER (r <= 5) || ']},{"name":"project.circular_risks","attributes":[' || CASE WHEN count(*) % 2 = 0 THEN '{"key":"risk.1","value":"' || p_brand || '"}' ELSE '' END || ']}]}' AS x FROM p GROUP BY p_brand)
  SELECT p_brand, md5(x) AS digest, length(x)::INT AS length FROM g"""


def _writes(s, d):
    """Two writes to every third key, of which the later holds, and one to keys that no store has."""
    p = t.table(s, d, "part").where("p_partkey % 3 = 0")
    row = lambda i, key: F.struct(key.alias("key"), F.col("p_name").alias("name"), F.concat(F.lit(f"w{i} "), "p_brand").alias("body"), (F.col("p_size") + i).alias("version"), F.lit(i).alias("seq"))
    return p.select(F.explode(F.array(row(1, F.col("p_partkey")), row(2, F.col("p_partkey")), row(3, -1 - F.col("p_partkey")))).alias("x")).select("x.*")


def _written(s, d):
    both = lc.written_through(*t.snapshots(s, d), _writes(s, d), ["key"], "seq")
    return both[0].withColumn("store", F.lit("primary")).unionByName(both[1].withColumn("store", F.lit("cache"))).select("store", "key", "body", "version")


_W = "(SELECT p_partkey AS key, 'w2 ' || p_brand AS body, p_size + 2 AS version FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT -1 - p_partkey, 'w3 ' || p_brand, p_size + 3 FROM part WHERE p_partkey % 3 = 0) w"
WRITTEN_SQL = " UNION ALL ".join(f"SELECT '{store}' AS store, key, coalesce(w.body, {own}.body) AS body, coalesce(w.version, {own}.version) AS version FROM {own} FULL JOIN {_W} USING (key)" for store, own in (("primary", "olds"), ("cache", "news")))

PLANS = {
    "sc12_workspace_rules": (lambda s, d: _rules(s, d, False), RULES_SQL + "k = 0"),
    "sc12_appended_rules": (lambda s, d: _rules(s, d, True), RULES_SQL + "true"),
    "sc13_agents": (lambda s, d: configs.agents(_agent_files(s, d)), AGENTS_SQL),
    "sk9_telemetry": (_telemetry, TELEMETRY_SQL),
    "sk7_pushed": (
        lambda s, d: lc.pushed(*t.snapshots(s, d), ["key"]).select("key", "body", "version"),
        sql("SELECT key, coalesce(o.body, n.body) AS body, coalesce(o.version, n.version) AS version FROM olds o FULL JOIN news n USING (key)", "snap"),
    ),
    "sk7_written_through": (_written, sql(WRITTEN_SQL, "snap")),
}
