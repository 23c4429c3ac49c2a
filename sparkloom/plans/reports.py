"""Queries of reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import entity_kind, token_estimate, token_ratio
from ..operators import reports as rp
from ..sources import tables as t
from ..sources.tables import with_adapters as sql
from .code import SYM, symbols
from .graphs import zones
from .selection import ZONES


def _functions(s, d):
    p = t.table(s, d, "part")
    n = F.col("p_partkey")
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (n % len(xs) + 1).cast("int"))
    flags = F.array_compact(F.array(F.when(n % 7 == 0, F.lit("guard")), F.when(n % 5 == 0, F.lit("async")), F.when(n % 3 == 0, F.lit("result")), F.when(n % 11 == 0, F.lit("validation"))))
    return p.select(F.col("p_brand").alias("file"), F.concat(pick("createUser", "withAuth", "db", "getInstance", "deleteAll", "xHandler", "plain"), F.lit("")).alias("name"), (n % 2 == 0).alias("exported"), flags.alias("flags"),
                    F.when(n % 13 == 0, F.array(F.lit("req"), F.lit("res"))).when(n % 17 == 0, F.array(F.lit("a"), F.lit("next"))).otherwise(F.array(F.lit("a"))).alias("params"), F.array(pick("on", "emit", "foo")).alias("calls"))


KNOWN = """WITH f AS (SELECT p_brand AS file, lower(['createUser', 'withAuth', 'db', 'getInstance', 'deleteAll', 'xHandler', 'plain'][p_partkey % 7 + 1]) AS name, p_partkey % 2 = 0 AS ex, p_partkey AS n, ['on', 'emit', 'foo'][p_partkey % 3 + 1] AS call FROM part),
  g AS (SELECT file, bool_or(contains(name, 'getinstance')) OR bool_or(ex AND name = 'db') AS singleton, count(*) FILTER (ex) AS exports, count(*) AS n, count(*) FILTER (ex AND regexp_matches(name, 'create|find|get|update|delete|remove|list|upsert|save|destroy')) AS crud,
    bool_or(contains(name, 'handler')) AS handler, count(DISTINCT call) FILTER (call IN ('on', 'emit')) AS ps FROM f GROUP BY file),
  r AS (SELECT 'factory' AS id, 0.82 AS confidence, count(*) FILTER (regexp_matches(name, '^(create|build|make|new|generate|produce)') AND ex AND n % 3 = 0) AS occurrences, 2 AS k FROM f
    UNION ALL SELECT 'guard-clause', 0.95, count(*) FILTER (n % 7 = 0), 3 FROM f UNION ALL SELECT 'async-await', 0.98, count(*) FILTER (n % 5 = 0), 3 FROM f UNION ALL SELECT 'result-type', 0.75, count(*) FILTER (n % 3 = 0), 3 FROM f
    UNION ALL SELECT 'middleware', 0.87, count(*) FILTER (n % 13 = 0 OR n % 17 = 0), 3 FROM f UNION ALL SELECT 'decorator-hoc', 0.78, count(*) FILTER (regexp_matches(name, '^(with|enhance|wrap|connect)') AND ex), 3 FROM f
    UNION ALL SELECT 'input-validation', 0.92, count(*) FILTER (n % 11 = 0), 3 FROM f UNION ALL SELECT 'singleton', 0.88, count(*) FILTER (singleton), 1 FROM g UNION ALL SELECT 'repository', 0.90, count(*) FILTER (exports >= 2 AND crud >= 2), 1 FROM g
    UNION ALL SELECT 'observer', 0.85, count(*) FILTER (ps >= 2), 1 FROM g UNION ALL SELECT 'strategy', 0.70, count(*) FILTER (handler OR (exports >= 3 AND n >= 3)), 3 FROM g)
  SELECT id, confidence::DOUBLE AS confidence, occurrences FROM r WHERE occurrences >= k"""


def _changes(s, d):
    e = F.col("event_id")
    return t.table(s, d, "events").select(
        F.concat(F.lit("f"), e).alias("file"), (e % 4).alias("added"), (F.floor(e / 4).cast("long") % 3).alias("removed"), (F.floor(e / 12).cast("long") % 3).alias("modified"), (e % 5 == 0).cast("int").alias("breaking"), (e % 17).alias("complexity"),
        (e % 19 == 0).cast("int").alias("findings"), (e % 7 == 0).cast("int").alias("tests"), ((e % 10) / 10).alias("confidence"), (e % 2).alias("exported"), (e % 3).alias("dependents"),
    )


CH = "ch AS (SELECT 'f' || event_id AS file, event_id AS e, event_id % 4 AS a, event_id // 4 % 3 AS r, event_id // 12 % 3 AS m, event_id % 3 AS d FROM events)"


def _values(s, d):
    key = F.element_at(F.array(*[F.lit(x) for x in ("identity", "session_state", "decisions", "patterns")]), (F.col("event_id") % 4 + 1).cast("int"))
    value = F.when(F.col("event_id") % 9 == 0, F.lit("{broken")).when(F.col("event_id") % 5 == 0, F.lit('{"name": "n", "purpose": "p", "last_updated": "t"}')).otherwise(F.col("props"))
    return t.table(s, d, "events").select(F.concat(key, F.lit("")).alias("key"), value.alias("value"))


PLANS = {
    "cl7_known_patterns": (lambda s, d: rp.known_patterns(_functions(s, d)), KNOWN),
    "cl8_framework_patterns": (
        lambda s, d: rp.framework_patterns(
            t.table(s, d, "part").select(F.concat(F.when(F.col("p_partkey") % 3 == 0, "src/app/").otherwise("src/x/"), F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, ".tsx").otherwise(".ts")).alias("file"), F.when(F.col("p_partkey") % 5 == 0, F.array(F.lit("jsx"))).otherwise(F.array().cast("array<string>")).alias("flags")),
            t.table(s, d, "region").select(F.when(F.col("r_regionkey") == 1, "next").otherwise(F.col("r_name")).alias("name")),
        ),
        """SELECT id, c::DOUBLE AS confidence, n AS occurrences FROM (SELECT 'nextjs-app-router' AS id, 0.95 AS c, count(*) FILTER (p_partkey % 3 = 0) AS n FROM part UNION ALL SELECT 'server-components', 0.90, count(*) FILTER (p_partkey % 30 = 0) FROM part) WHERE n > 0""",
    ),
    "sf4_entity_kinds": (
        lambda s, d: t.table(s, d, "part").select("p_partkey", entity_kind(F.element_at(F.array(*[F.lit(x) for x in ("function_item", "struct_item", "trait_item", "impl_item", "odd")]), (F.col("p_partkey") % 5 + 1).cast("int"))).alias("kind")),
        "SELECT p_partkey, ['function', 'class', 'interface', 'type', 'odd'][p_partkey % 5 + 1] AS kind FROM part",
    ),
    "cl15_agent_reports": (
        lambda s, d: rp.agent_reports(_changes(s, d)),
        f"""WITH {CH} SELECT file, 'observer' AS agent, CASE WHEN e % 5 = 0 THEN 'warning' ELSE 'info' END AS severity FROM ch UNION ALL SELECT file, 'intent', CASE WHEN e % 10 >= 8 THEN 'info' ELSE 'warning' END FROM ch
          UNION ALL SELECT file, 'security', 'critical' FROM ch WHERE e % 19 = 0 UNION ALL SELECT file, 'complexity', 'warning' FROM ch WHERE e % 17 > 10 UNION ALL SELECT file, 'tests', 'warning' FROM ch WHERE e % 7 = 0 AND (e % 5 = 0 OR m > 0)
          UNION ALL SELECT file, 'documentation', 'warning' FROM ch WHERE e % 5 = 0 UNION ALL SELECT file, unnest(['patterns', 'generic']), 'info' FROM ch""",
    ),
    "gr13_diff_impact": (
        lambda s, d: rp.diff_impact(_changes(s, d)),
        f"""WITH {CH}, x AS (SELECT *, CASE WHEN d = 0 AND a = 0 AND r = 0 THEN 0 ELSE round(0.5 * r + 0.3 * m + CASE WHEN a > 0 THEN 0.1 ELSE 0 END, 6) END::DOUBLE AS k FROM ch)
          SELECT file, least(k, 1.0)::DOUBLE AS risk, CASE WHEN k >= 1 THEN 'critical' WHEN k >= 0.7 THEN 'high' WHEN k >= 0.4 THEN 'medium' WHEN k > 0 THEN 'low' ELSE 'none' END AS severity, CASE WHEN r > 0 THEN 'removed' WHEN a > 0 THEN 'added' ELSE 'modified' END AS kind FROM x""",
    ),
    "jn7_causal_context": (
        lambda s, d: rp.causal_context(t.nation_edges(s, d)),
        sql("SELECT node, coalesce(calls, '') AS calls, coalesce(called_by, '') AS called_by FROM (SELECT src AS node, array_to_string(list_sort(list(DISTINCT dst)), ',') AS calls FROM edges GROUP BY 1) FULL JOIN (SELECT dst AS node, array_to_string(list_sort(list(DISTINCT src)), ',') AS called_by FROM edges GROUP BY 1) USING (node)", "edges"),
    ),
    "ag16_tag_counts": (lambda s, d: rp.tag_counts(t.memory_rows(s, d)), sql("SELECT tag, count(*) AS n, sum(b)::BIGINT AS bytes FROM (SELECT unnest(tags) AS tag, strlen(content) AS b FROM mem) GROUP BY tag", "mem")),
    "ag22_known_issues": (
        lambda s, d: rp.known_issues(t.event_log(s, d).where("kind = 'mutation'").select("file", F.col("event_id").alias("seq")), t.event_log(s, d).where("kind = 'penalty'").select(F.col("event_id").alias("seq"), F.concat(F.lit("r"), "event_id").alias("subject"), F.when(F.col("severity") > 4, "warning").otherwise("info").alias("severity"))),
        sql("""SELECT kind, subject FROM (SELECT * FROM (SELECT 'deleted' AS kind, file AS subject, 0 AS o, event_id AS q FROM log WHERE kind = 'mutation' ORDER BY event_id DESC LIMIT 10)
          UNION ALL SELECT 'report', 'r' || event_id, 1, event_id FROM (SELECT * FROM log WHERE kind = 'penalty' ORDER BY event_id DESC LIMIT 64) WHERE severity > 4) ORDER BY o, q DESC LIMIT 40""", "log"),
    ),
    "ag28_hot_files": (lambda s, d: rp.hot_files(zones(s, d), few=5), sql(ZONES + " SELECT file FROM z WHERE fan_in >= 3", "edges")),
    "ag29_top_bodies": (lambda s, d: rp.top_bodies(symbols(s, d)), f"WITH {SYM} SELECT file, array_to_string(list(name ORDER BY complexity DESC, name DESC)[1:2], ',') AS names FROM sym GROUP BY file"),
    "ag30_missing_keys": (
        lambda s, d: rp.missing_keys(t.memory_rows(s, d).select(F.col("kind").alias("key")), ["fact", "identity", "patterns", "warning"]),
        sql("SELECT * FROM (VALUES ('fact'), ('identity'), ('patterns'), ('warning')) AS r(key) WHERE key NOT IN (SELECT kind FROM mem)", "mem"),
    ),
    "pf9_write_errors": (
        lambda s, d: rp.write_errors(_values(s, d)).groupBy("key", "errors").agg(F.count("*").alias("n")),
        """WITH v AS (SELECT ['identity', 'session_state', 'decisions', 'patterns'][event_id % 4 + 1] AS key, CASE WHEN event_id % 9 = 0 THEN 0 WHEN event_id % 5 = 0 THEN 1 ELSE 2 END AS c FROM events)
          SELECT key, CASE WHEN c = 0 THEN 'not JSON' WHEN key = 'decisions' THEN 'must be an array' WHEN c = 2 AND key = 'identity' THEN 'identity.name is required;identity.purpose is required' WHEN c = 2 AND key = 'session_state' THEN 'session_state.last_updated is required' ELSE '' END AS errors, count(*) AS n FROM v GROUP BY 1, 2""",
    ),
    "sf16_overflow_and_tail": (
        lambda s, d: t.table(s, d, "documents").select("doc_id", F.md5(rp.tail(F.col("text"), 3)).alias("tail"), rp.overflow(F.split("text", "\n"), F.size(F.split("text", "\n")), 2, "lines").alias("head")),
        """SELECT doc_id, md5(array_to_string(string_split(regexp_replace(text, '\\n$', ''), chr(10))[-3:], chr(10))) AS tail, array_to_string(ls[1:2], ', ') || CASE WHEN len(ls) > 2 THEN ', +' || (len(ls) - 2) || ' more lines' ELSE '' END AS head
          FROM (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents)""",
    ),
    "sf12_token_ratio": (
        lambda s, d: t.table(s, d, "documents").select("doc_id", F.round(token_ratio(F.col("text"), token_estimate(F.col("text"))), 6).alias("ratio")),
        "SELECT doc_id, CASE WHEN strlen(text) // 4 > 0 THEN round(strlen(text) / (strlen(text) // 4), 6) ELSE 0 END AS ratio FROM documents",
    ),
    "sf24_skeleton_text": (
        lambda s, d: rp.skeleton_text(symbols(s, d)).select("file", F.md5("text").alias("digest")),
        f"WITH {SYM} SELECT file, md5('path: ' || file || chr(10) || string_agg(kind || ' ' || name || ' cx' || complexity, chr(10) ORDER BY start)) AS digest FROM sym GROUP BY file",
    ),
}
