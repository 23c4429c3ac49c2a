"""Queries of upkeep, of all built-in filters, and of predictions kept for a time."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import context as cx
from ..operators import graph
from ..operators import textfilter as tf
from ..operators import upkeep as up
from ..operators.cut import shared_folder
from ..sources import files
from ..sources import tables as t
from ..sources.tables import with_adapters as sql
from ..streaming import state

COMMANDS = (
    "git status", "git log -3", "git diff", "git add .", "git commit -m x", "git push", "git pull", "npm ci", "yarn", "pnpm install", "pip3 install y", "cargo check", "cargo test", "cargo update", "npx eslint .", "prettier -w", "ruff check",
    "biome lint", "shellcheck a.sh", "turbo run", "nx build", "make all", "webpack", "vite build", "docker ps", "docker build .", "docker compose up", "jest", "pytest -q", "npx vitest", "ls -la", "tree", "find .", "rg x", "grep x y", "df -h",
    "du -s", "ps aux", "terraform plan", "terraform apply", "helm list", "kubectl get pods", "unknown", "",
)
SIGNS = (
    "On branch main", "nothing to commit, working tree clean", "index ab12..cd34", "diff --git a b", "+++ b/x", "Updating 12ab..34cd", "npm WARN old", "added 3 packages", "   Compiling x", "running 3 tests", "test result: ok", "Collecting y",
    "PASS a.test", "FAILED b.test", "error: c", "Step 1/2", "#12 done", "", "=====", "CONTAINER ID", "  PID TTY", "No changes.", "Filesystem", "[main 12ab] message", "  ^^^",
)


def outputs(s, d):
    """Documents as outputs of commands: signs of tools, of which some are colored, then the text's lines."""
    k = F.col("doc_id")
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))
    signs = F.concat_ws("\n", *[F.concat(F.lit("\x1b[31m") if i % 3 == 0 else F.lit(""), pick(SIGNS, k + 7 * i), F.lit("\x1b[0m") if i % 3 == 0 else F.lit("")) for i in range(6)])
    return t.table(s, d, "documents").select("doc_id", pick(COMMANDS, k).alias("command"), F.concat(signs, F.lit("\n"), F.when(k % 3 == 0, "").otherwise(F.coalesce("text", F.lit("")))).alias("text"))


def _quoted(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _text_sql() -> str:
    esc = "chr(27) || '[31m' || "
    parts = [f"{esc if i % 3 == 0 else ''}({_quoted(SIGNS)})[(doc_id + {7 * i}) % {len(SIGNS)} + 1]{' || chr(27) || ' + chr(39) + '[0m' + chr(39) if i % 3 == 0 else ''}" for i in range(6)]
    return " || chr(10) || ".join(parts) + " || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '' ELSE coalesce(text, '') END"


_null = lambda v: "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"
_one = lambda patterns: "|".join(f"(?:{p})" for p in patterns) or None
FILTERS = ", ".join(f"({_null(f.name)}, {_null(f.command)}, {_null(_one(f.strip))}, {_null(_one(f.keep) if not f.strip else None)}, {f.max_lines or 'NULL'}, {_null(f.on_empty)})" for f in tf.BUILTIN)
BUILTIN_SQL = f"""WITH f(name, cmd, strip, keep, mx, emp) AS (VALUES {FILTERS}),
o AS (SELECT doc_id, ({_quoted(COMMANDS)})[doc_id % {len(COMMANDS)} + 1] AS command, {_text_sql()} AS raw FROM documents),
p AS (SELECT doc_id, min(name) AS name FROM o JOIN f ON regexp_matches(command, cmd) GROUP BY doc_id),
l AS (SELECT o.doc_id, raw, f.*, string_split(regexp_replace(regexp_replace(raw, '\\x1b\\[[0-9;?]*[a-zA-Z]', '', 'g'), '\\n$', ''), chr(10)) AS ls FROM o LEFT JOIN p USING (doc_id) LEFT JOIN f USING (name)),
k AS (SELECT *, CASE WHEN strip IS NOT NULL THEN list_filter(ls, lambda x: NOT regexp_matches(x, strip)) WHEN keep IS NOT NULL THEN list_filter(ls, lambda x: regexp_matches(x, keep)) ELSE ls END AS kept FROM l),
j AS (SELECT doc_id, raw, name, emp, array_to_string(CASE WHEN mx IS NULL THEN kept ELSE kept[1:mx] END, chr(10)) AS out FROM k)
SELECT doc_id, name AS filter, md5(CASE WHEN name IS NULL THEN raw WHEN trim(out) = '' AND emp IS NOT NULL THEN emp ELSE out END) AS digest FROM j"""

STAGES = (
    tf.Filter("end", "^end", keep=("the", "la"), replace=(("the", "THE"), ("(?:de|of) ", "<>")), short=("casino|onoring", "found", "zzz"), max_chars=50, tail=4, max_lines=3, on_empty="nothing"),
    tf.Filter("start", "^start", strip=("^$",), short=("^The", "begins", None), head=2, ansi=False),
)
_ALL = "string_split(regexp_replace(regexp_replace(coalesce(text, ''), '\\x1b\\[[0-9;?]*[a-zA-Z]', '', 'g'), '\\n$', ''), chr(10))"
STAGES_SQL = f"""WITH r AS (SELECT doc_id, coalesce(text, '') AS t, {_ALL} AS ls FROM documents),
a AS (SELECT doc_id, t, list_filter(list_transform(ls, lambda x: regexp_replace(regexp_replace(x, 'the', 'THE'), '(?:de|of) ', '<>')), lambda x: regexp_matches(x, 'the|la')) AS k, list_filter(string_split(regexp_replace(t, '\\n$', ''), chr(10)), lambda x: x <> '') AS h FROM r),
b AS (SELECT *, list_transform(CASE WHEN len(k) > 4 THEN k[len(k) - 3:] ELSE k END, lambda x: left(x, 50))[1:3] AS e FROM a)
SELECT doc_id, CASE WHEN regexp_matches(t, 'casino|onoring') AND NOT regexp_matches(t, 'zzz') THEN 'found' WHEN trim(array_to_string(e, chr(10))) = '' THEN 'nothing' ELSE array_to_string(e, chr(10)) END AS last,
  CASE WHEN regexp_matches(t, '^The') THEN 'begins' ELSE array_to_string(h[1:2], chr(10)) END AS first FROM b"""


def _links(s, d):
    e = t.table(s, d, "events")
    action = F.when(F.col("event_type") == "click", "contradict").when(F.col("event_type") == "view", "resolve").otherwise("supersede")
    return e.select(F.concat(F.lit("m"), F.col("event_id") % 150).alias("id"), F.col("event_id").alias("seq"), action.alias("action"), F.when(F.col("user_id") % 9 == 0, " ").otherwise(F.concat(F.lit("m"), F.col("user_id") % 6)).alias("other"))


def _related(s, d):
    rows = t.memory_rows(s, d).select("id", "superseded_by", F.array(F.concat(F.lit("m"), F.col("n") % 4)).alias("contradicts"), "updated_h")
    return up.related(rows, _links(s, d), 5000).select("id", "superseded_by", F.array_join(F.array_sort("contradicts"), ",").alias("contradicts"), "updated_h")


RELATED = """lk AS (SELECT 'm' || (event_id % 150) AS id, event_id AS seq, CASE event_type WHEN 'click' THEN 'c' WHEN 'view' THEN 'r' ELSE 's' END AS a, 'm' || (user_id % 6) AS other FROM events WHERE user_id % 9 <> 0),
  la AS (SELECT id, other, arg_max(a, seq) AS a FROM lk WHERE a <> 's' GROUP BY id, other), sp AS (SELECT id, arg_max(other, seq) AS other FROM lk WHERE a = 's' GROUP BY id),
  cs AS (SELECT id, 'm' || (n % 4) AS other FROM mem UNION SELECT id, other FROM la WHERE a = 'c')
  SELECT mem.id, coalesce(sp.other, superseded_by) AS superseded_by, coalesce((SELECT string_agg(other, ',' ORDER BY other) FROM cs WHERE cs.id = mem.id AND NOT EXISTS (SELECT 1 FROM la WHERE la.id = cs.id AND la.other = cs.other AND la.a = 'r')), '') AS contradicts,
    CASE WHEN mem.id IN (SELECT id FROM lk) THEN 5000 ELSE updated_h END AS updated_h FROM mem LEFT JOIN sp USING (id)"""


def _migrated(s, d, again: bool):
    rows = t.memory_rows(s, d).select("id", F.upper("kind").alias("kind"), F.concat(F.lit("  "), "content").alias("content"), F.array_union(F.array(F.lit("z"), F.lit("a")), "tags").alias("tags"))
    out, _ = up.migrated(rows, 3)
    return up.migrated(out, 3) if again else up.migrated(rows, 3)


MIGRATED = """SELECT id, kind, md5(trim(content, ' ')) AS digest, array_to_string(list_sort(list_distinct(list_concat(['z', 'a'], tags))), ',') AS tags FROM mem UNION ALL SELECT 'migration::version', 'marker', md5('3'), ''"""

PLACES = ("src/", "src/node_modules/x/", "a/target/", "target/", "lib/dist/", "b/build/", "builds/", "__pycache__/", "x.git/", ".github/", "c/vendor/", "vendors/", "d/coverage/", "coverage/")


def _paths():
    return F.concat(F.element_at(F.array(*[F.lit(x) for x in PLACES]), (F.col("page_id") % len(PLACES) + 1).cast("int")), F.regexp_replace("url", r"^.*?://", ""))


def _activity(s, d):
    log = t.event_log(s, d)
    return log.where("kind in ('intent', 'mutation', 'memory')").select(F.col("project").alias("key"), "event_id", "sec", F.concat(F.lit("f"), F.col("event_id") % 9).alias("file"), "intent")


ACTIVITY = "ac AS (SELECT project AS key, event_id, sec, 'f' || (event_id % 9) AS file, intent FROM log WHERE kind IN ('intent', 'mutation', 'memory'))"

def _mirror(s, d):
    """One project's rows written as a mirror of JSON files and read again."""
    folder = f"{shared_folder(s)}/mirror-{uuid.uuid4().hex}"
    rows = t.memory_rows(s, d).select(F.when(F.col("n") % 10 == 0, F.concat(F.lit("bad/"), "id")).otherwise(F.col("id")).alias("id"), "project_id", "kind", "content", "tags")
    files.export_mirror(rows, folder)
    return files.import_mirror(s, folder, "src11").select("id", "kind", F.md5("content").alias("digest"), F.array_join("tags", ",").alias("tags"))


def _manifests(s, d):
    """A package manifest of each brand; parts of even keys are for development only."""
    pair = lambda even: F.map_from_entries(F.array_distinct(F.collect_list(F.when((F.col("p_partkey") % 2 == 0) == even, F.struct(F.concat(F.lit("pkg-"), F.col("p_partkey") % 97), F.lit("^1.0.0"))))))
    made = t.table(s, d, "part").groupBy("p_brand").agg(pair(False).alias("dependencies"), pair(True).alias("devDependencies"))
    return files.dependencies(made.select(F.to_json(F.struct("dependencies", "devDependencies")).alias("text"))).groupBy("name").agg(F.count("*").alias("n"))


PLANS = {
    "cx6_exports": (
        lambda s, d: cx.exported(t.table(s, d, "conversations").select(F.col("conv_id").alias("request"), F.col("turn").alias("ordinal"), F.col("text").alias("content")).distinct(), 400).select("request", F.md5("text").alias("digest"), "used"),
        """WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY o, x) AS i FROM (SELECT DISTINCT conv_id AS r, turn AS o, text AS x FROM conversations WHERE text IS NOT NULL)),
          f AS (SELECT DISTINCT r, 0::BIGINT AS i, 400 AS l, false AS k, []::VARCHAR[] AS out FROM c UNION ALL
            SELECT f.r, c.i, CASE WHEN length(x) <= l THEN l - length(x) WHEN NOT k AND l > 3 THEN 0 ELSE l END, k OR (length(x) > l AND l > 3), CASE WHEN length(x) <= l THEN list_append(out, x) WHEN NOT k AND l > 3 THEN list_append(out, left(x, l - 3) || '...') ELSE out END
            FROM f JOIN c ON c.r = f.r AND c.i = f.i + 1)
          SELECT r AS request, md5(array_to_string(out, chr(10))) AS digest, (400 - l)::BIGINT AS used FROM f WHERE i = (SELECT max(i) FROM c WHERE c.r = f.r)""",
    ),
    "sc6_mirrored_rows": (_mirror, sql("SELECT id, kind, md5(content) AS digest, array_to_string(tags, ',') AS tags FROM mem WHERE project_id = 'src11' AND n % 10 <> 0", "mem")),
    "sc11_dependencies": (_manifests, "SELECT 'pkg-' || (p_partkey % 97) AS name, count(DISTINCT p_brand) AS n FROM part GROUP BY 1"),
    "tf3_builtin_filters": (lambda s, d: outputs(s, d).select("doc_id", tf.filter_name(F.col("command")).alias("filter"), F.md5(tf.filtered(F.col("command"), F.col("text"))).alias("digest")), BUILTIN_SQL),
    "tf2_all_stages": (lambda s, d: t.table(s, d, "documents").select("doc_id", tf.applied(STAGES[0], F.coalesce("text", F.lit(""))).alias("last"), tf.applied(STAGES[1], F.coalesce("text", F.lit(""))).alias("first")), STAGES_SQL),
    "sk12_relations": (_related, sql(RELATED, "mem")),
    "sk13_migrated_rows": (lambda s, d: _migrated(s, d, False)[0].select("id", "kind", F.md5("content").alias("digest"), F.array_join("tags", ",").alias("tags")), sql(MIGRATED, "mem")),
    "sk13_second_migration": (lambda s, d: _migrated(s, d, True)[1].unionByName(_migrated(s, d, False)[1]), sql("SELECT 0::BIGINT AS rewritten, 3 AS version UNION ALL SELECT count(*), 3 FROM mem", "mem")),
    "sf26_generated_places": (
        lambda s, d: t.table(s, d, "pages").select("page_id", fn.generated(_paths()).alias("generated")),
        f"SELECT page_id, regexp_matches(p, 'node_modules/|/target/|/dist/|/build/|__pycache__/|\\.git/|/vendor/|/coverage/') AS generated FROM (SELECT page_id, ({_quoted(PLACES)})[page_id % {len(PLACES)} + 1] || regexp_replace(url, '^.*?://', '') AS p FROM pages)",
    ),
    "st6_hot_predictions": (
        lambda s, d: state.hot_predictions(_activity(s, d), 1_704_672_000, 86_400 * 2).select("key", "file", "intent"),
        sql(f"{ACTIVITY} SELECT key, file, arg_max(intent, (sec, event_id)) AS intent FROM ac WHERE intent IS NOT NULL GROUP BY key, file HAVING 1704672000 - max(sec) < 172800", "log"),
    ),
    "st10_cached_intents": (
        lambda s, d: state.predictions(_activity(s, d), 86_400),
        sql(f"""{ACTIVITY}, q AS (SELECT key, event_id, file, sec, intent, last_value(CASE WHEN intent IS NOT NULL THEN file END IGNORE NULLS) OVER w AS nf, last_value(intent IGNORE NULLS) OVER w AS ni, last_value(intent IGNORE NULLS) OVER o AS oi, last_value(CASE WHEN intent IS NOT NULL THEN sec END IGNORE NULLS) OVER o AS os FROM ac
          WINDOW w AS (PARTITION BY key ORDER BY sec, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), o AS (PARTITION BY key, file ORDER BY sec, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
          SELECT key, event_id, CASE WHEN nf = file THEN ni WHEN sec - os < 86400 THEN oi END AS intent, CASE WHEN nf = file THEN 'current' WHEN sec - os < 86400 THEN 'cache-hit' END AS source FROM q WHERE intent IS NULL""", "log"),
    ),
    "pf19_triggered_agents": (
        lambda s, d: up.triggered(
            t.event_log(s, d).where("kind = 'mutation'").select("event_id", "sec", (F.col("event_id") % 3 - 1).alias("breaking"), (F.col("event_id") % 4).alias("modified")),
            s.createDataFrame([("impact", "signature_change"), ("lint", "file_save"), ("audit", "file_save"), ("nightly", "interval")], "agent string, trigger string"),
        ).groupBy("agent").agg(F.count("*").alias("n"), F.sum("event_id").alias("events")),
        sql("""m AS (SELECT event_id, event_id % 3 > 1 OR event_id % 4 > 0 AS changed FROM log WHERE kind = 'mutation'), a(agent, any_) AS (VALUES ('impact', false), ('lint', true), ('audit', true))
          SELECT agent, count(*) AS n, sum(event_id)::BIGINT AS events FROM a JOIN m ON any_ OR changed GROUP BY agent""", "log"),
    ),
    "gr15_questions_with_recency": (
        lambda s, d: up.predicted_questions(graph.degrees(t.nation_edges(s, d)), t.table(s, d, "events").where("event_type = 'click'").select(F.format_string("n%02d", F.col("user_id") % 25).alias("file"))),
        sql("""SELECT dst AS node, 'dependency_warning' AS context, CASE WHEN count(*) > 5 THEN 'high' ELSE 'medium' END AS priority FROM edges GROUP BY dst
          UNION ALL SELECT DISTINCT format('n{:02d}', user_id % 25), 'recent_changes', 'low' FROM events WHERE event_type = 'click'""", "edges"),
    ),
}
