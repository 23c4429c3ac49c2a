"""Queries over events and fact tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as ev
from ..operators import stats as st
from ..sources import tables as t
from ..sources.tables import with_adapters as sql

NOW = 1_800_000_000


def _prompt_runs(spark, sf):
    o, c = t.table(spark, sf, "orders"), t.table(spark, sf, "customer")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    outcome = F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "O", "rejected").otherwise("clarified")
    return rows.select(F.col("o_orderkey").alias("run"), F.col("o_orderpriority").alias("model"), F.col("c_mktsegment").alias("task"), outcome.alias("outcome"), F.floor("o_totalprice").cast("long").alias("tokens"))


def _prompt_sections(spark, sf):
    """Sections of a run: a goal; of each line its flags; of the second line of a run that failed a retry."""
    line, runs = t.table(spark, sf, "lineitem"), _prompt_runs(spark, sf)
    flags = F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber") % 2)
    more = F.when((F.col("l_linenumber") == 2) & (F.col("outcome") != "accepted"), "retry")
    own = line.join(runs, F.col("l_orderkey") == F.col("run")).select("task", "outcome", F.explode(F.array_compact(F.array(flags, more))).alias("section"))
    return own.unionAll(runs.select("task", "outcome", F.lit("goal")))


RUNS = """runs AS (SELECT o_orderkey AS run, o_orderpriority AS model, c_mktsegment AS task, CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'rejected' ELSE 'clarified' END AS outcome,
  floor(o_totalprice)::BIGINT AS tokens FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _items(spark, sf):
    line, supp, part = t.table(spark, sf, "lineitem"), t.table(spark, sf, "supplier"), t.table(spark, sf, "part")
    rows = line.select("l_suppkey", "l_partkey").distinct().join(supp, F.col("l_suppkey") == F.col("s_suppkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.col("s_nationkey").alias("project"), F.concat_ws("/", "p_brand", "p_type").alias("item"))


def _snapshots(spark, sf):
    return t.table(spark, sf, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), F.length("text").cast("long").alias("total"))


FOLD_SQL = """SELECT project, sec, event_id FROM (
  WITH RECURSIVE o AS (SELECT project, sec, event_id, row_number() OVER (PARTITION BY project ORDER BY sec, event_id) AS r FROM log),
  f AS (SELECT project, sec, event_id, r, sec AS last, true AS ok FROM o WHERE r = 1
    UNION ALL SELECT o.project, o.sec, o.event_id, o.r, CASE WHEN o.sec - f.last >= 3600 THEN o.sec ELSE f.last END, o.sec - f.last >= 3600 FROM f JOIN o ON o.project = f.project AND o.r = f.r + 1)
  SELECT * FROM f WHERE ok)"""

PLANS = {
    "ag1_session_analytics": (
        lambda s, d: ev.session_analytics(t.event_log(s, d)),
        sql("""SELECT *, round(CASE WHEN span_secs > 0 THEN events * 60.0 / span_secs ELSE 0 END, 6)::DOUBLE AS events_per_minute FROM (SELECT count(*) AS events, count(*) FILTER (kind = 'mutation') AS mutations,
          count(*) FILTER (kind = 'memory') AS memory_reads, count(*) FILTER (kind = 'intent') AS intents, count(*) FILTER (kind = 'penalty') AS penalties, count(DISTINCT file) AS files,
          coalesce(sum(severity), 0)::BIGINT AS severity, CASE WHEN count(*) >= 2 THEN max(sec) - min(sec) ELSE 0 END AS span_secs FROM log)""", "log"),
    ),
    "ag1_intent_histogram": (lambda s, d: ev.histogram(t.event_log(s, d), "intent"), sql("SELECT intent, count(*) AS n FROM log WHERE intent IS NOT NULL GROUP BY intent", "log")),
    "tk4_hottest_files": (lambda s, d: ev.hottest_files(t.event_log(s, d)), sql("SELECT file, count(*) AS n FROM log WHERE kind = 'mutation' GROUP BY file ORDER BY n DESC, file LIMIT 10", "log")),
    "st1_event_ring": (lambda s, d: ev.ring(t.event_log(s, d), 2000).select("event_id", "kind"), sql("SELECT event_id, kind FROM log ORDER BY sec DESC, event_id DESC LIMIT 2000", "log")),
    "st2_running_counters": (lambda s, d: ev.histogram(t.event_log(s, d), "kind"), sql("SELECT kind, count(*) AS n FROM log GROUP BY kind", "log")),
    "st3_last_values": (
        lambda s, d: ev.last_values(t.event_log(s, d)),
        sql("""SELECT file, value, round(value - b, 6) AS change FROM (SELECT file, value, lag(value) OVER w AS b, row_number() OVER (PARTITION BY file ORDER BY sec DESC, event_id DESC) AS r
          FROM log WHERE kind = 'mutation' WINDOW w AS (PARTITION BY file ORDER BY sec, event_id)) WHERE r = 1""", "log"),
    ),
    "st5_cooldown": (lambda s, d: ev.cooldown(t.event_log(s, d), "project", 3600), sql(FOLD_SQL, "log")),
    "st6_fresh_rows": (
        lambda s, d: ev.fresh(t.event_log(s, d), F.lit(1_704_672_000), 86400).select("event_id"),
        sql("SELECT event_id FROM log WHERE 1704672000 - sec < 86400", "log"),
    ),
    "st10_latest_intent": (
        lambda s, d: ev.latest_intent(t.event_log(s, d)),
        sql("SELECT project, arg_max(intent, (sec, event_id)) AS intent, count(*) AS n FROM log WHERE kind = 'intent' GROUP BY project", "log"),
    ),
    "pf2_session_slice": (
        lambda s, d: ev.session_slice(t.event_log(s, d), 1_704_153_600, 500).select("event_id", "sec"),
        sql("SELECT event_id, sec FROM log WHERE sec >= 1704153600 ORDER BY sec DESC, event_id DESC LIMIT 500", "log"),
    ),
    "pf3_events_since": (lambda s, d: ev.since(t.event_log(s, d), 1_704_153_600).where("kind = 'penalty'").select("event_id", "severity"), sql("SELECT event_id, severity FROM log WHERE sec >= 1704153600 AND kind = 'penalty'", "log")),
    "pf4_latest_changes": (lambda s, d: ev.latest_changes(t.event_log(s, d)).select("event_id", "file"), sql("SELECT event_id, file FROM log WHERE kind = 'mutation' ORDER BY sec DESC, event_id DESC LIMIT 25", "log")),
    "ag17_token_counters": (
        lambda s, d: ev.token_counters(t.event_log(s, d)),
        sql("""SELECT project, count(*) AS calls, sum(tokens)::BIGINT AS tokens, arg_max(tokens, (sec, event_id)) AS last, max(tokens) AS largest, min(tokens) AS smallest, (sum(tokens) // count(*))::BIGINT AS average
          FROM log WHERE kind = 'ai_call' GROUP BY project""", "log"),
    ),
    "ag20_history_compaction": (
        lambda s, d: ev.compaction(t.event_log(s, d)),
        sql("""SELECT project, count(*) FILTER (kind = 'mutation') AS mutations, coalesce(array_to_string(list_sort(list(DISTINCT intent) FILTER (intent IS NOT NULL)), ','), '') AS intents, count(DISTINCT file) AS files
          FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY sec DESC, event_id DESC) AS r FROM log) WHERE r > 4 GROUP BY project""", "log"),
    ),
    "ag2_token_stats": (
        lambda s, d: st.token_stats(t.token_facts(s, d)),
        sql("""SELECT project, sum(input)::BIGINT AS input, sum(output)::BIGINT AS output, sum(total)::BIGINT AS total, round(sum(cost), 2) AS cost, count(*) FILTER (cached) AS hits, count(*) AS requests, min(sec) AS first, max(sec) AS last,
          round(count(*) FILTER (cached) / count(*), 6) AS hit_rate, round(sum(total) / greatest((max(sec) - min(sec)) // 86400, 1), 6) AS per_day FROM tok GROUP BY project""", "tok"),
    ),
    "ag3_top_projects": (
        lambda s, d: st.token_stats(t.token_facts(s, d)).select("project", "total").orderBy(F.desc("total"), "project"),
        sql("SELECT project, sum(total)::BIGINT AS total FROM tok GROUP BY project ORDER BY total DESC, project", "tok"),
    ),
    "ag19_cache_efficiency": (
        lambda s, d: st.cache_efficiency(t.token_facts(s, d)),
        sql("SELECT project, round(100 * count(*) FILTER (cached) / count(*), 6) AS efficiency, round(sum(input) / sum(output), 6) AS compression FROM tok GROUP BY project", "tok"),
    ),
    "sk10_retention": (
        lambda s, d: t.token_facts(s, d).where(F.col("sec") >= 912_000_000 - 90 * 86400).groupBy("project").agg(F.count("*").alias("kept")),
        sql("SELECT project, count(*) AS kept FROM tok WHERE sec >= 912000000 - 90 * 86400 GROUP BY project", "tok"),
    ),
    "ag4_command_stats": (
        lambda s, d: st.command_stats(t.command_facts(s, d), 1000),
        sql("""SELECT *, round(raw / executions, 6) AS avg_raw, round(filtered / executions, 6) AS avg_filtered, raw - filtered AS saved, round((raw - filtered) * 100 / raw, 6) AS savings_percent FROM (
          SELECT command, count(*) AS executions, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed, sum(raw)::BIGINT AS raw, sum(filtered)::BIGINT AS filtered, min(sec) AS first, max(sec) AS last
          FROM (SELECT * FROM cmd ORDER BY sec DESC, n DESC LIMIT 1000) GROUP BY command)""", "cmd"),
    ),
    "ag5_command_frequencies": (lambda s, d: st.frequencies(t.command_facts(s, d), "command"), sql("SELECT command, count(*) AS n FROM cmd GROUP BY command", "cmd")),
    "ag6_filter_metrics": (
        lambda s, d: st.filter_metrics(t.command_facts(s, d)),
        sql("""SELECT *, round(saved * 100 / raw, 6) AS savings_percent, CASE WHEN feedback = 0 THEN 1.0 ELSE round(useful / feedback, 6) END::DOUBLE AS satisfaction FROM (
          SELECT command, count(*) AS applications, sum(greatest(raw - filtered, 0))::BIGINT AS saved, sum(raw)::BIGINT AS raw, count(*) FILTER (useful) AS useful, count(useful) AS feedback, max(sec) AS last_used FROM cmd GROUP BY command)""", "cmd"),
    ),
    "tk6_filter_ranking": (
        lambda s, d: st.filter_ranking(st.filter_metrics(t.command_facts(s, d)), 3).select("command", "saved"),
        sql("SELECT command, sum(greatest(raw - filtered, 0))::BIGINT AS saved FROM cmd GROUP BY command ORDER BY saved DESC, command LIMIT 3", "cmd"),
    ),
    "cl13_filter_improvements": (
        lambda s, d: st.filter_improvements(st.filter_metrics(t.command_facts(s, d)), NOW),
        sql("""SELECT command, a AS advice FROM (SELECT command, unnest(['high:satisfaction', 'medium:savings', 'low:unused']) AS a, unnest([sat < 0.7 AND n >= 5, sav < 20 AND n >= 5, 1800000000 - u > 2592000]) AS ok FROM (
          SELECT command, count(*) AS n, sum(greatest(raw - filtered, 0)) * 100 / sum(raw) AS sav, coalesce(count(*) FILTER (useful) / nullif(count(useful), 0), 1) AS sat, max(sec) AS u FROM cmd GROUP BY command)) WHERE ok""", "cmd"),
    ),
    "ag7_model_performance": (
        lambda s, d: st.model_performance(_prompt_runs(s, d)),
        f"WITH {RUNS} SELECT model, task, count(*) AS runs, round(count(*) FILTER (outcome = 'accepted') / count(*), 6) AS first_try_rate, (sum(tokens) // count(*))::BIGINT AS avg_tokens FROM runs GROUP BY model, task",
    ),
    "ag8_prompt_suggestion": (
        lambda s, d: st.prompt_suggestion(_prompt_runs(s, d), _prompt_sections(s, d)),
        f"""WITH {RUNS}, ln AS (SELECT * FROM lineitem JOIN runs ON l_orderkey = run), sec AS (SELECT task, outcome, l_returnflag || l_linestatus || (l_linenumber % 2) AS section FROM ln UNION ALL SELECT task, outcome, 'goal' FROM runs UNION ALL SELECT task, outcome, 'retry' FROM ln WHERE l_linenumber = 2 AND outcome <> 'accepted'),
          k AS (SELECT task, count(*) FILTER (outcome = 'accepted') AS successes FROM runs GROUP BY task),
          g AS (SELECT task, section, count(*) FILTER (outcome = 'accepted') AS ok, count(*) FILTER (outcome <> 'accepted') AS bad FROM sec GROUP BY task, section)
          SELECT * FROM (SELECT task, section, CASE WHEN successes > 0 AND ok = successes THEN 'always' WHEN ok = 0 AND bad > 0 THEN 'only_failures' END AS verdict FROM g JOIN k USING (task)) WHERE verdict IS NOT NULL""",
    ),
    "ag8_recommended_budgets": (
        lambda s, d: st.recommended_budget(_prompt_runs(s, d)),
        f"WITH {RUNS} SELECT task, coalesce(sum(tokens) FILTER (outcome = 'accepted') // nullif(count(*) FILTER (outcome = 'accepted'), 0), 0)::BIGINT AS budget FROM runs GROUP BY task",
    ),
    "ag9_developer_profile": (
        lambda s, d: st.shared_items(_items(s, d), 0.6),
        """WITH i AS (SELECT DISTINCT s_nationkey AS project, p_brand || '/' || p_type AS item FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)
          SELECT item, count(*) AS n, round(count(*) / (SELECT count(DISTINCT project) FROM i), 6) AS share FROM i GROUP BY item HAVING count(*) >= 0.6 * (SELECT count(DISTINCT project) FROM i)""",
    ),
    "ag15_file_churn": (
        lambda s, d: st.churn(*t.commits(s, d)),
        sql("""SELECT file, count(*) AS churn, max(sec) AS last_sec, arg_max(commit_id, (sec, commit_id)) AS last_commit, array_to_string(list_sort(list(DISTINCT author))[1:5], ',') AS authors
          FROM commit_files JOIN commits USING (commit_id) GROUP BY file""", "commits"),
    ),
    "ag15_hot_and_stable": (
        lambda s, d: st.hot_and_stable(st.churn(*t.commits(s, d)).select("file", "churn")),
        sql("""SELECT * FROM (SELECT file, count(*) AS churn, 'hot' AS zone FROM commit_files JOIN commits USING (commit_id) GROUP BY file ORDER BY churn DESC, file LIMIT 5)
          UNION ALL SELECT * FROM (SELECT file, count(*) AS churn, 'stable' AS zone FROM commit_files JOIN commits USING (commit_id) GROUP BY file ORDER BY churn, file LIMIT 5)""", "commits"),
    ),
    "ag14_active_areas": (
        lambda s, d: st.active_areas(t.event_log(s, d).where("kind = 'mutation'").select(F.regexp_replace("file", "f([0-9])", "Mod$1/f").alias("path"))),
        sql("""SELECT area, count(*) AS n FROM (SELECT lower(array_to_string(string_split(regexp_replace(file, 'f([0-9])', 'Mod\\1/f'), '/')[-2:], '/')) AS area FROM log WHERE kind = 'mutation') GROUP BY area ORDER BY n DESC, area LIMIT 4""", "log"),
    ),
    "ag18_lifetime_totals": (
        lambda s, d: st.lifetime(_snapshots(s, d)),
        """SELECT session, sum(greatest(total - b, 0))::BIGINT AS total, count(*) AS flushes FROM (SELECT conv_id AS session, length(text) AS total, coalesce(lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS b FROM conversations) GROUP BY session""",
    ),
    "ag23_size_report": (
        lambda s, d: st.sizes(t.memory_rows(s, d).select(F.col("kind").alias("key"), "content")),
        sql("SELECT kind AS key, sum(strlen(content))::BIGINT AS bytes, count(*) AS n FROM mem GROUP BY kind", "mem"),
    ),
    "ag24_health_report": (
        lambda s, d: st.health(t.memory_rows(s, d).select(F.col("kind").alias("key"), "content", "updated_h"), ["fact", "decision", "identity"], 2000),
        sql("""SELECT missing, age_h, bytes, CASE WHEN missing > 0 THEN 'critical' WHEN age_h > 72 OR bytes > 0.9 * 51200 THEN 'warning' ELSE 'healthy' END AS status FROM (
          SELECT (SELECT count(*) FROM unnest(['fact', 'decision', 'identity']) AS r(k) WHERE k NOT IN (SELECT kind FROM mem)) AS missing, max(2000 - updated_h)::BIGINT AS age_h, sum(strlen(content))::BIGINT AS bytes FROM mem)""", "mem"),
    ),
    "ag25_conflicts": (
        lambda s, d: st.conflicts(t.event_log(s, d).where("file is not null").select(F.concat(F.lit("fn"), F.pmod("event_id", F.lit(997))).alias("name"), "file")),
        sql("SELECT 'fn' || (event_id % 997) AS name, count(*) AS changes, count(DISTINCT file) AS files FROM log WHERE file IS NOT NULL GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT file) > 1", "log"),
    ),
}
