"""Queries over memory rows and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from ..operators import memory as m
from ..operators import textfilter as tf
from ..sources import tables as t
from ..sources.tables import with_adapters as sql


def _relations(s, d):
    mem = t.memory_rows(s, d).withColumn("row", F.col("n"))
    name = lambda c: F.concat(F.lit("m"), c)
    return mem.select(
        "id", "superseded_by", F.when(F.col("n") > 0, name(F.expr("n div 3"))).alias("parent_id"),
        F.when(F.col("n") % 4 == 0, F.array(name(F.col("n") + 7))).otherwise(F.array().cast("array<string>")).alias("contradicts"),
        F.when(F.col("n") % 5 == 0, F.array(name(F.col("n") - 1), F.concat(F.lit("gone"), "n"))).otherwise(F.array().cast("array<string>")).alias("caused_by"),
        F.when(F.col("n") % 6 == 0, F.array(name(F.col("n") + 2))).otherwise(F.array().cast("array<string>")).alias("enables"),
    )


REL = """rel AS (SELECT 'm' || n AS src, superseded_by AS dst, 'superseded_by' AS relation FROM mem WHERE superseded_by IS NOT NULL UNION SELECT 'm' || n, 'm' || (n // 3), 'parent' FROM mem WHERE n > 0
  UNION SELECT 'm' || n, 'm' || (n + 7), 'contradicts' FROM mem WHERE n % 4 = 0 UNION SELECT 'm' || n, 'm' || (n - 1), 'caused_by' FROM mem WHERE n % 5 = 0
  UNION SELECT 'm' || n, 'm' || (n + 2), 'enables' FROM mem WHERE n % 6 = 0),
  redge AS (SELECT * FROM rel WHERE dst IN (SELECT id FROM mem))"""


def _snap(s, d):
    return t.snapshots(s, d)


SECRET_SQL = " OR ".join("regexp_matches(content, '" + p.replace("'", "''") + "')" for p in m.SECRETS)
COMMANDS = ("git status", "sudo git log -3", "ls | wc", "rm -rf / ", "git push --force", "cargo test --all", "RUST_LOG=1 cargo build", "foo bar", "docker ps", "vim x", "kubectl get pods", "npm ci", "")


def _commands(s, d):
    names = F.array(*[F.lit(c) for c in COMMANDS])
    return t.table(s, d, "orders").select(F.col("o_orderkey").alias("n"), F.get(names, F.pmod("o_orderkey", F.lit(len(COMMANDS))).cast("int")).alias("command"))


def _case(pairs, otherwise):
    return "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, v in pairs) + f" ELSE {otherwise} END"


def _rx(col, patterns):
    return "(" + " OR ".join(f"regexp_matches({col}, '" + p.replace("'", "''") + "')" for p in patterns) + ")"


CLASSIFY = (
    "WITH c AS (SELECT o_orderkey AS n, [" + ", ".join(f"'{c}'" for c in COMMANDS) + f"][(o_orderkey % {len(COMMANDS)})::BIGINT + 1] AS command FROM orders), "
    f"k AS (SELECT *, trim(regexp_replace(trim(command), '{tf.ENV_PREFIX}', '')) AS clean FROM c) SELECT n, "
    + _case([("trim(command) = ''", "ignored"), (_rx("trim(command)", tf.IGNORED), "ignored"), (_rx("trim(command)", tf.DENIED), "denied"), (_rx("trim(command)", tf.ASK), "ask"), (_rx("clean", [f.command for f in tf.BUILTIN]), "supported")], "'unsupported'")
    + " AS class, "
    + _case([("string_split(clean, ' ')[1] IN (" + ", ".join(f"'{w}'" for w in ws) + ")", k) for k, ws in tf.CATEGORIES.items()], "'Other'")
    + " AS category FROM k"
)

PLANS = {
    "sc1_memory_scan": (lambda s, d: m.newest(t.memory_rows(s, d).where("project_id = 'src3'")).select("id", "kind", "updated_h"), sql("SELECT id, kind, updated_h FROM mem WHERE project_id = 'src3'", "mem")),
    "sc2_point_lookup": (lambda s, d: t.memory_rows(s, d).where("id = 'm17'").select("id", "kind", F.octet_length("content").alias("bytes")), sql("SELECT id, kind, strlen(content)::INTEGER AS bytes FROM mem WHERE id = 'm17'", "mem")),
    "sc5_vector_load": (lambda s, d: t.table(s, d, "embeddings").where("size(embedding) = 64").select("vec_id", "label"), "SELECT vec_id, label FROM embeddings WHERE len(embedding) = 64"),
    "pf1_search": (lambda s, d: m.search(t.memory_rows(s, d), "the an").select("id"), sql("SELECT id FROM mem WHERE lower(content) LIKE '%the an%' OR lower(id) LIKE '%the an%' ORDER BY updated_h DESC, id LIMIT 50", "mem")),
    "pf5_active_decisions": (lambda s, d: t.memory_rows(s, d).where("kind = 'decision' and superseded_by is null").select("id"), sql("SELECT id FROM mem WHERE kind = 'decision' AND superseded_by IS NULL", "mem")),
    "pf6_validation": (
        lambda s, d: m.validated(t.memory_rows(s, d).withColumn("content", F.when(F.col("n") % 50 == 0, F.concat("content", F.lit('\npassword = "hunter22"'))).when(F.col("n") % 51 == 0, F.lit("")).otherwise(F.col("content")))).groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n")),
        sql(f"""mc AS (SELECT tags, CASE WHEN n % 50 = 0 THEN content || chr(10) || 'password = "hunter22"' WHEN n % 51 = 0 THEN '' ELSE content END AS content FROM mem)
          SELECT CASE WHEN content = '' THEN 'empty' WHEN strlen(content) > 51200 THEN 'too large' WHEN len(tags) > 20 THEN 'too many tags' WHEN {SECRET_SQL} THEN 'secret' ELSE 'ok' END AS reason, count(*) AS n FROM mc GROUP BY 1""", "mem"),
    ),
    "pf7_redaction": (
        lambda s, d: t.memory_rows(s, d).select("id", F.md5(m.redact(F.concat("content", F.lit(' api_key="abcdefghij0123456789" x')))).alias("digest")),
        sql("""SELECT id, md5(regexp_replace(content || ' api_key="abcdefghij0123456789" x', 'api_key="[a-z0-9]{20}', '[REDACTED]')) AS digest FROM mem""", "mem"),
    ),
    "pf8_project_names": (
        lambda s, d: t.table(s, d, "pages").select("page_id", m.valid_project(F.regexp_replace("url", "https?://", "")).alias("valid")),
        "SELECT page_id, regexp_matches(regexp_replace(url, 'https?://', ''), '^[A-Za-z0-9_.-]{1,100}$') AS valid FROM pages",
    ),
    "pf10_security_findings": (
        lambda s, d: m.findings(t.memory_rows(s, d), m.SECURITY).groupBy("id", "rule", "severity").agg(F.count("*").alias("n"), F.min("snippet").alias("first")),
        sql("SELECT id, rule, severity, count(*) AS n, min(snippet) AS first FROM (" + " UNION ALL ".join(f"SELECT id, '{i}' AS rule, '{v}' AS severity, unnest(regexp_extract_all(content, '" + p.replace("'", "''") + "')) AS snippet FROM mem" for i, p, v in m.SECURITY) + ") GROUP BY ALL", "mem"),
    ),
    "pf16_command_classes": (lambda s, d: _commands(s, d).select("n", *[c.alias(a) for c, a in zip(tf.classified(F.col("command")), ("class", "category"))]), CLASSIFY),
    "pf17_known_issues": (
        lambda s, d: t.memory_rows(s, d).where("kind = 'warning'").where(F.lower("content").contains("los") & F.exists("tags", lambda x: x.contains("t1"))).select("id"),
        sql("SELECT id FROM mem WHERE kind = 'warning' AND contains(lower(content), 'los') AND len(list_filter(tags, lambda x: contains(x, 't1'))) > 0", "mem"),
    ),
    "pf20_projects": (lambda s, d: t.memory_rows(s, d).select("project_id").distinct(), sql("SELECT DISTINCT project_id FROM mem", "mem")),
    "sk1_upsert": (
        lambda s, d: m.upsert(*_snap(s, d), ["key"], "version").select("key", "body", "version"),
        sql("SELECT key, body, version FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY version DESC, x DESC) AS r FROM (SELECT *, 0 AS x FROM olds UNION ALL SELECT *, 1 FROM news)) WHERE r = 1", "snap"),
    ),
    "sk2_eviction": (lambda s, d: m.evict(t.memory_rows(s, d), "project_id", 20).select("id"), sql("SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY project_id ORDER BY updated_h DESC, id) AS r FROM mem) WHERE r <= 20", "mem")),
    "sk3_delete": (
        lambda s, d: m.delete(t.memory_rows(s, d), t.memory_rows(s, d).where("n % 3 = 0")).select("id"),
        sql("SELECT id FROM mem WHERE n % 3 <> 0", "mem"),
    ),
    "sk4_delete_prefix": (lambda s, d: m.delete_prefix(t.memory_rows(s, d), "m1").select("id"), sql("SELECT id FROM mem WHERE NOT starts_with(id, 'm1')", "mem")),
    "sk5_batch_ack": (
        lambda s, d: m.apply_batch(t.memory_rows(s, d).where("n % 2 = 0"), t.memory_rows(s, d).where("n % 3 = 0"), t.memory_rows(s, d).where("n % 5 = 0"))[1],
        sql(f"SELECT count(*) FILTER (NOT bad) AS accepted, count(*) FILTER (bad) AS rejected, (SELECT count(*) FROM mem WHERE n % 2 = 0 AND n % 5 = 0) AS deleted FROM (SELECT content = '' OR strlen(content) > 51200 OR {SECRET_SQL} AS bad FROM mem WHERE n % 3 = 0)", "mem"),
    ),
    "sk11_warning_pruning": (
        lambda s, d: m.prune_warnings(t.memory_rows(s, d), "m9", 10, 500).select("id"),
        sql("SELECT id FROM mem WHERE NOT starts_with(id, 'm9') UNION ALL SELECT id FROM (SELECT * FROM mem WHERE starts_with(id, 'm9') ORDER BY created_h DESC, id LIMIT 10) WHERE created_h >= 500", "mem"),
    ),
    "sk12_contradictions": (
        lambda s, d: _relations(s, d).select("id", F.array_join(F.array_sort(F.array_union("contradicts", F.array(F.lit("m1")))), ",").alias("contradicts")),
        sql("SELECT id, CASE WHEN n % 4 <> 0 OR n + 7 = 1 THEN 'm1' ELSE 'm1,m' || (n + 7) END AS contradicts FROM mem", "mem"),
    ),
    "sk13_migration_report": (
        lambda s, d: t.memory_rows(s, d).select(F.lower("kind").alias("kind")).agg(F.count("*").alias("rewritten"), F.lit(1).alias("version")),
        sql("SELECT count(*) AS rewritten, 1 AS version FROM mem", "mem"),
    ),
    "sk15_append_once": (
        lambda s, d: t.memory_rows(s, d).select("id", F.array_join(F.array_union("tags", F.array(F.lit("en"), F.lit("new"))), ",").alias("tags")),
        sql("SELECT id, array_to_string(tags, ',') || CASE WHEN NOT list_contains(tags, 'en') THEN ',en' ELSE '' END || ',new' AS tags FROM mem", "mem"),
    ),
    "sc3_lenient_json": (
        lambda s, d: t.table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).where("k is not null"),
        "SELECT event_id, (props::JSON->>'$.k')::BIGINT AS k FROM events WHERE (props::JSON->>'$.k') IS NOT NULL",
    ),
    "jn8_relation_edges": (lambda s, d: m.relation_edges(_relations(s, d)), sql(REL + " SELECT src, dst, relation FROM redge", "mem")),
    "jn9_contradicted": (
        lambda s, d: m.relation_edges(_relations(s, d)).where("relation = 'contradicts'").groupBy("dst").agg(F.count("*").alias("n")),
        sql(REL + " SELECT dst, count(*) AS n FROM redge WHERE relation = 'contradicts' GROUP BY dst", "mem"),
    ),
    "gr10_reasoning_chain": (
        lambda s, d: graph.reach(m.relation_edges(_relations(s, d)), s.createDataFrame([("m9",)], "node string"), 4, undirected=True).select("node", "depth"),
        sql(REL + """, ru AS (SELECT src, dst FROM redge UNION SELECT dst, src FROM redge), f AS (SELECT 'm9' AS node, 0 AS depth UNION SELECT ru.dst, depth + 1 FROM f JOIN ru ON ru.src = f.node WHERE depth < 4)
          SELECT node, min(depth) AS depth FROM f GROUP BY node""", "mem"),
    ),
    "jn4_snapshot_diff": (
        lambda s, d: m.diff(*_snap(s, d)),
        sql("SELECT * FROM (SELECT key, CASE WHEN o.body IS NULL THEN 'added' WHEN n.body IS NULL THEN 'removed' WHEN o.body <> n.body THEN 'modified' END AS change FROM olds o FULL JOIN news n USING (key)) WHERE change IS NOT NULL", "snap"),
    ),
    "se2_symbol_difference": (
        lambda s, d: _snap(s, d)[1].select("key", "body").exceptAll(_snap(s, d)[0].select("key", "body")),
        sql("SELECT key, body FROM news EXCEPT ALL SELECT key, body FROM olds", "snap"),
    ),
    "jn5_breaking_heads": (
        lambda s, d: m.breaking(*_snap(s, d)),
        sql("SELECT key, string_split(o.body, ' ')[1] AS old_head, string_split(n.body, ' ')[1] || '!' AS new_head FROM olds o JOIN news n USING (key) WHERE o.body <> n.body", "snap"),
    ),
    "jn12_remote_merge": (
        lambda s, d: m.merge_remote(*_snap(s, d)),
        sql("SELECT key, CASE WHEN o.version IS NULL OR n.version >= o.version THEN 'remote' ELSE 'local' END AS side, coalesce(o.body <> n.body AND n.version <= o.version, false) AS conflict FROM olds o FULL JOIN news n USING (key)", "snap"),
    ),
    "jn13_publishable": (
        lambda s, d: m.publishable(_snap(s, d)[1], _snap(s, d)[0]),
        sql("SELECT key FROM news n WHERE NOT EXISTS (SELECT 1 FROM olds o WHERE o.key = n.key AND o.name = n.name AND o.body = n.body)", "snap"),
    ),
    "jn14_new_dependencies": (
        lambda s, d: m.new_dependencies(*_snap(s, d)),
        sql("SELECT n.key, n.version FROM news n LEFT JOIN olds o USING (key) WHERE o.version IS NULL OR o.version <> n.version", "snap"),
    ),
    "jn15_stale_vectors": (
        lambda s, d: _snap(s, d)[1].select("key", F.xxhash64("body").alias("h")).join(_snap(s, d)[0].select("key", F.xxhash64("body").alias("h")), ["key", "h"], "left_anti").select("key"),
        sql("SELECT key FROM news n WHERE NOT EXISTS (SELECT 1 FROM olds o WHERE o.key = n.key AND o.body = n.body)", "snap"),
    ),
    "se3_normal_lists": (
        lambda s, d: t.memory_rows(s, d).groupBy("kind").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))), ",").alias("tags")),
        sql("SELECT kind, array_to_string(list_sort(list(DISTINCT tag)), ',') AS tags FROM (SELECT kind, unnest(tags) AS tag FROM mem) GROUP BY kind", "mem"),
    ),
    "sf22_stale_rows": (lambda s, d: t.memory_rows(s, d).where(F.lit(1100) - F.col("updated_h") > 72).agg(F.count("*").alias("n")), sql("SELECT count(*) AS n FROM mem WHERE 1100 - updated_h > 72", "mem")),
}
