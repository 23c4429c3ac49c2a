"""Queries for many requests at once: coverage of skeletons by memory, and the context of every file."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from ..operators import reports as rp
from ..operators.cut import cut_lineage
from ..sources import tables as t
from ..sources.tables import with_adapters as sql
from . import compiler
from .graphs import IMPORTANCE

BUDGET = 2000


def item_skeletons(s, d):
    """Test items as skeletons: a path, and the words as exports; parts by their names add ones that no row may name."""
    words = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)))
    items = t.table(s, d, "benchmark").select(F.concat(F.lit("item"), "item_id").alias("file"), words.alias("exports"))
    return items.union(t.table(s, d, "part").select(F.concat(F.lit("src/"), F.col("p_partkey")), F.array("p_name", F.col("p_partkey").cast("string"))))


ITEM_COVERAGE = """sk AS (SELECT DISTINCT 'item' || item_id AS file, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS name FROM benchmark UNION ALL SELECT 'item' || item_id, 'item' || item_id FROM benchmark
    UNION ALL SELECT 'src/' || p_partkey, unnest([p_name, p_partkey::VARCHAR, 'src/' || p_partkey]) FROM part),
  c AS (SELECT name, count(*) AS n FROM (SELECT DISTINCT name FROM sk WHERE name <> '') JOIN mem ON contains(content, name) GROUP BY name)
  SELECT file, coalesce(sum(n), 0)::BIGINT AS hits, coalesce(sum(n), 0) >= 3 AS covered FROM sk LEFT JOIN c USING (name) GROUP BY file"""


def all_contexts(s, d):
    """(sections, metrics) of a request for each nation."""
    n = F.col("p_partkey")
    own = t.table(s, d, "part").select(F.format_string("n%02d", n % 25).alias("file"), F.col("p_name").alias("name"), F.lit("function").alias("kind"), n.alias("start"), F.col("p_size").cast("int").alias("complexity"))
    edges = cut_lineage(t.nation_edges(s, d))
    rules = t.table(s, d, "region").select(F.col("r_name").alias("file"), F.concat(F.lit("a warning\nabout "), "r_name").alias("text"))
    k = F.col("n_nationkey")
    requests = t.table(s, d, "nation").select(k.cast("long").alias("request"), F.format_string("n%02d", k).alias("active"), F.concat(F.lit("p"), k % 7).alias("project"))
    rows = compiler.sections_of_all(requests, edges, own, t.memory_rows(s, d), t.event_log(s, d), rules, graph.importance(edges), "bug_fix", "almond green")
    return compiler.compile_all(rows, BUDGET)


CONTEXTS = (
    IMPORTANCE
    + f""", u AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
  rq AS (SELECT n_nationkey::BIGINT AS request, format('n{{:02d}}', n_nationkey) AS active, 'p' || (n_nationkey % 7) AS project FROM nation),
  bf AS (SELECT request, active AS node, 0 AS depth FROM rq UNION SELECT request, dst, depth + 1 FROM bf JOIN u ON src = node WHERE depth < 2),
  ln AS (SELECT format('n{{:02d}}', p_partkey % 25) AS file, 'function ' || p_name || ' cx' || p_size AS line, p_partkey AS k FROM part),
  tx AS (SELECT file, 'path: ' || file || chr(10) || string_agg(line, chr(10) ORDER BY k) AS text FROM ln GROUP BY file),
  cv AS (SELECT file, (SELECT count(*) FROM mem WHERE contains(content, file)) >= 3 AS covered FROM tx),
  fl AS (SELECT file, covered, CASE WHEN covered THEN array_to_string(string_split(text, chr(10))[1:4], chr(10)) ELSE text END AS content, round(15 * (0.7 * coalesce(betweenness, 0) + 0.3 * coalesce(pagerank, 0)))::INT AS boost
    FROM tx JOIN cv USING (file) LEFT JOIN im ON im.node = file),
  hs AS (SELECT project, format('{{}} mutations of {{}} files; intents {{}}', count(*) FILTER (kind = 'mutation'), count(DISTINCT file), coalesce(array_to_string(list_sort(list(DISTINCT intent) FILTER (intent IS NOT NULL)), ','), '')) AS content
    FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY sec DESC, event_id DESC) AS r FROM log) WHERE r > 4 GROUP BY project),
  sc AS (SELECT request, 'code:' || file AS id, covered, strlen(content) // 4 AS tk, CASE WHEN boost > 0 THEN least(CASE WHEN file = active THEN 95 ELSE 72 END + boost, 100) ELSE CASE WHEN file = active THEN 95 ELSE 72 END END
      + round((contains(lower(content), 'almond')::INT + contains(lower(content), 'green')::INT) * 10 / 2)::INT AS pr FROM (SELECT DISTINCT request, node FROM bf) JOIN fl ON file = node JOIN rq USING (request)
    UNION ALL SELECT request, 'history', false, strlen(content) // 4, 70 FROM rq JOIN hs USING (project)
    UNION ALL SELECT request, 'rules:' || r_name, false, 2, 55 FROM rq, region
    UNION ALL SELECT request, 'active', false, strlen('Active file: ' || active || chr(10) || 'Task type: bug_fix') // 4, 100 FROM rq),
  so AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY id) AS i FROM sc),
  dp AS (SELECT request, 0::BIGINT AS i, [0::BIGINT for x in range({BUDGET + 1})] AS best FROM rq
    UNION ALL SELECT dp.request, so.i, list_transform(range({BUDGET + 1}), lambda c: greatest(best[c + 1], CASE WHEN c >= tk THEN best[c - tk + 1] + 100 * pr + 1 ELSE 0 END)) FROM dp JOIN so ON so.request = dp.request AND so.i = dp.i + 1)
  SELECT request, count(*) AS considered, sum(tk)::BIGINT AS tokens_considered, count(*) FILTER (starts_with(id, 'code:')) AS relevant_files, count(*) FILTER (covered) AS deduplicated_files,
    (SELECT best[{BUDGET + 1}] FROM dp WHERE dp.request = so.request AND dp.i = (SELECT max(i) FROM so z WHERE z.request = so.request)) AS value FROM so GROUP BY request"""
)

PLANS = {
    "jn10_item_coverage": (lambda s, d: rp.coverage(item_skeletons(s, d), t.memory_rows(s, d)), sql(ITEM_COVERAGE, "mem")),
    "cx1_all_context_metrics": (
        lambda s, d: all_contexts(s, d)[1].select("request", "considered", "tokens_considered", "relevant_files", "deduplicated_files", "value"),
        sql(CONTEXTS, "edges", "mem", "log"),
    ),
}
