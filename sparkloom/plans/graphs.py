"""Queries over graphs: nations that trade, and a smaller acyclic part of them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph as g
from ..sources import tables as t
from ..sources.tables import with_adapters as sql


def _dag(s, d):
    return t.nation_edges(s, d).where("src < dst")


def _start(s):
    return s.createDataFrame([("n03",)], "node string")


BFS = """f AS (SELECT 'n03' AS node, 0 AS depth UNION SELECT {to}, depth + 1 FROM f JOIN {e} ON {frm} = f.node WHERE depth < {max}),
  b AS (SELECT node, min(depth) AS depth FROM f GROUP BY node)"""

HOT = """SELECT file, 10 * changes + fan_in + fan_out + least(cx, 25) AS score FROM (
  SELECT f.file, coalesce(c.n, 0) AS changes, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out, f.cx FROM
  (SELECT format('n{:02d}', n_nationkey) AS file, length(n_name) * 3 AS cx FROM nation) f
  LEFT JOIN (SELECT dst, count(*) AS n FROM edges GROUP BY dst) i ON i.dst = f.file LEFT JOIN (SELECT src, count(*) AS n FROM edges GROUP BY src) o ON o.src = f.file
  LEFT JOIN (SELECT format('n{:02d}', user_id % 25) AS file, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1) c ON c.file = f.file)"""


NODES = "nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges)"
RANKS = "dg AS (SELECT src, count(*) AS d FROM edges GROUP BY src), k AS (SELECT count(*) AS n FROM nodes), r0 AS (SELECT node, 1.0::DOUBLE / n AS r FROM nodes, k)" + "".join(
    f", r{i} AS (SELECT node, 0.15 / n + 0.85 * coalesce(g, 0) AS r FROM k, nodes LEFT JOIN (SELECT dst, sum(r / d) AS g FROM r{i - 1} JOIN edges ON src = node JOIN dg USING (src) GROUP BY dst) ON dst = node)" for i in range(1, 21)
)
RANKED = "SELECT node, round(r / max(r) OVER (), 6) AS pagerank FROM r20"
PAGERANK = f"{NODES}, {RANKS} {RANKED}"
PATHS = """w AS (SELECT node AS s, node AS v, 0 AS k, 1.0::DOUBLE AS c, [node] AS seen FROM nodes
            UNION ALL SELECT s, dst, k + 1, c, list_append(seen, dst) FROM w JOIN edges ON src = v WHERE NOT list_contains(seen, dst) AND k < 4),
          far AS (SELECT s, v, min(k) AS k FROM w GROUP BY s, v), sp AS (SELECT w.s, w.v, w.k, sum(c) AS n FROM w JOIN far USING (s, v, k) GROUP BY ALL),
          b AS (SELECT m.v AS node, sum(m.n * r.n / t.n) AS b FROM sp m JOIN sp r ON r.s = m.v JOIN sp t ON t.s = m.s AND t.v = r.v AND t.k = m.k + r.k WHERE m.v <> m.s AND r.v <> m.v GROUP BY m.v)"""
BETWEEN = "SELECT node, round(coalesce(b / (SELECT max(b) FROM b), 0), 6) AS betweenness FROM nodes LEFT JOIN b USING (node)"
IMPORTANCE = f"{NODES}, {PATHS}, {RANKS}, im AS (SELECT node, betweenness, pagerank, round(0.6 * betweenness + 0.4 * pagerank, 6) AS score FROM ({BETWEEN}) JOIN ({RANKED}) USING (node))"


def zones(s, d):
    """Each file's (nation's) fan-in, fan-out, changes and complexity."""
    files = t.table(s, d, "nation").select(F.format_string("n%02d", F.col("n_nationkey")).alias("file"), (F.length("n_name") * 3).alias("cx"))
    deg = g.degrees(t.nation_edges(s, d)).select(F.col("node").alias("file"), "fan_in", "fan_out")
    changes = t.table(s, d, "events").where("event_type = 'click'").groupBy(F.format_string("n%02d", F.col("user_id") % 25).alias("file")).agg(F.count("*").alias("changes"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return files.join(deg, "file", "left").join(changes, "file", "left").select("file", "cx", zero("fan_in"), zero("fan_out"), zero("changes"))


def hot_zones(s, d):
    score = (10 * F.col("changes") + F.col("fan_in") + F.col("fan_out") + F.least("cx", F.lit(25))).cast("long")
    return zones(s, d).select("file", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "file").limit(5)


def stable_zones(s, d):
    recent = t.table(s, d, "events").where("event_type = 'click' and user_id % 25 < 15").select(F.format_string("n%02d", F.col("user_id") % 25).alias("file"))
    score = (F.col("fan_in") + F.col("fan_out")).cast("long")
    return zones(s, d).join(recent, "file", "left_anti").select("file", score.alias("score")).orderBy(F.desc("score"), "file").limit(5)


def _mixed(s, d):
    """Edges of nations (cyclic), from regions to their nations, and along each nation's suppliers by key."""
    n = t.table(s, d, "nation").select(F.format_string("r%02d", "n_regionkey").alias("src"), F.format_string("n%02d", "n_nationkey").alias("dst"))
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    before = F.lag("s_suppkey").over(w)
    chain = t.table(s, d, "supplier").select(F.when(before.isNull(), F.format_string("n%02d", "s_nationkey")).otherwise(F.format_string("s%08d", before)).alias("src"), F.format_string("s%08d", "s_suppkey").alias("dst"))
    return t.nation_edges(s, d).union(n).union(chain)


def _blasts(s, d):
    return g.blast_radii(t.nation_edges(s, d), t.table(s, d, "nation").select(F.format_string("n%02d", "n_nationkey").alias("node")))


BLASTS = """f AS (SELECT format('n{:02d}', n_nationkey) AS request, format('n{:02d}', n_nationkey) AS node, 0 AS depth FROM nation UNION SELECT request, src, depth + 1 FROM f JOIN edges ON dst = f.node WHERE depth < 5),
  b AS (SELECT request, node, min(depth) AS depth FROM f GROUP BY ALL),
  v AS (SELECT b.request, b.node, b.depth, min(p.node) AS via FROM b JOIN edges ON edges.src = b.node JOIN b p ON p.request = b.request AND p.node = edges.dst AND p.depth = b.depth - 1 WHERE b.depth > 0 GROUP BY ALL),
  q AS (SELECT request, node, 0 AS depth, '' AS via, [node] AS path FROM b WHERE depth = 0 UNION ALL SELECT v.request, v.node, v.depth, v.via, list_append(q.path, v.node) FROM v JOIN q ON q.request = v.request AND q.node = v.via AND v.depth = q.depth + 1)"""

PLANS = {
    "hot_zones": (hot_zones, sql(f"SELECT * FROM ({HOT}) WHERE score > 0 ORDER BY score DESC, file LIMIT 5", "edges")),
    "jn1_hot_scores": (
        lambda s, d: zones(s, d).select("file", (10 * F.col("changes") + F.col("fan_in") + F.col("fan_out") + F.least("cx", F.lit(25))).cast("long").alias("score")),
        sql(HOT, "edges"),
    ),
    "jn2_stable_zones": (
        stable_zones,
        sql("""SELECT f AS file, coalesce(i, 0) + coalesce(o, 0) AS score FROM (SELECT format('n{:02d}', n_nationkey) AS f FROM nation)
          LEFT JOIN (SELECT dst, count(*) AS i FROM edges GROUP BY dst) ON dst = f LEFT JOIN (SELECT src, count(*) AS o FROM edges GROUP BY src) ON src = f
          WHERE f NOT IN (SELECT format('n{:02d}', user_id % 25) FROM events WHERE event_type = 'click' AND user_id % 25 < 15) ORDER BY score DESC, file LIMIT 5""", "edges"),
    ),
    "jn3_mutual_pairs": (
        lambda s, d: g.mutual_pairs(t.nation_edges(s, d)),
        sql("SELECT DISTINCT e.src AS a, e.dst AS b FROM edges e JOIN edges r ON r.src = e.dst AND r.dst = e.src WHERE e.src <= e.dst ORDER BY 1, 2 LIMIT 5", "edges"),
    ),
    "gr11_degrees": (
        lambda s, d: g.degrees(t.nation_edges(s, d)),
        sql("""SELECT node, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out, coalesce(fan_in, 0) >= 5 AS dense FROM (SELECT dst AS node, count(*) AS fan_in FROM edges GROUP BY dst)
          FULL JOIN (SELECT src AS node, count(*) AS fan_out FROM edges GROUP BY src) USING (node)""", "edges"),
    ),
    "gr2_pagerank": (
        lambda s, d: g.pagerank(t.nation_edges(s, d)),
        sql(PAGERANK, "edges"),
    ),
    "gr1_betweenness": (
        lambda s, d: g.betweenness(t.nation_edges(s, d)),
        sql(f"{NODES}, {PATHS} {BETWEEN}", "edges"),
    ),
    "gr5_importance": (lambda s, d: g.importance(t.nation_edges(s, d)).orderBy(F.desc("score"), "node").limit(15), sql(IMPORTANCE + " SELECT * FROM im ORDER BY score DESC, node LIMIT 15", "edges")),
    "gr3_strong_components": (
        lambda s, d: g.strong_components(t.nation_edges(s, d)),
        sql("""r AS (SELECT src AS a, dst AS b FROM edges UNION SELECT a, dst FROM r JOIN edges ON src = b)
          SELECT x.a AS node, min(least(x.a, x.b)) AS component FROM r x JOIN r y ON y.a = x.b AND y.b = x.a WHERE x.a <> x.b GROUP BY x.a""", "edges"),
    ),
    "gr4_topological_levels": (
        lambda s, d: g.topological_order(_dag(s, d)),
        sql("""p AS (SELECT node, 0 AS level FROM (SELECT src AS node FROM edges WHERE src < dst UNION SELECT dst FROM edges WHERE src < dst) UNION SELECT dst, level + 1 FROM p JOIN edges ON src = node WHERE src < dst)
          SELECT node, max(level) AS level FROM p GROUP BY node""", "edges"),
    ),
    "gr8_max_depth": (
        lambda s, d: g.max_depth(_dag(s, d)),
        sql("""p AS (SELECT src AS node, 0 AS level FROM edges WHERE src < dst UNION SELECT dst, level + 1 FROM p JOIN edges ON src = node WHERE src < dst) SELECT max(level)::BIGINT AS depth FROM p""", "edges"),
    ),
    "gr6_blast_radius": (
        lambda s, d: g.blast_radius(t.nation_edges(s, d), "n03"),
        sql(BFS.format(to="src", e="edges", frm="dst", max=5) + " SELECT b.node, b.depth, min(p.node) AS via FROM b JOIN edges ON edges.src = b.node JOIN b p ON p.node = edges.dst AND p.depth = b.depth - 1 WHERE b.depth > 0 GROUP BY b.node, b.depth", "edges"),
    ),
    "gr6_all_blast_radii": (
        lambda s, d: _blasts(s, d).select("request", "node", "depth", "via", F.array_join("path", ">").alias("path")),
        sql(BLASTS + " SELECT request, node, depth, via, array_to_string(path, '>') AS path FROM q WHERE depth > 0", "edges"),
    ),
    "gr6_critical_paths": (
        lambda s, d: g.critical_paths(_blasts(s, d)).select("request", F.array_join("path", ">").alias("path"), "depth"),
        sql(BLASTS + " SELECT request, array_to_string(arg_max(path, depth::VARCHAR || node), '>') AS path, max(depth)::BIGINT AS depth FROM q WHERE depth > 0 GROUP BY request", "edges"),
    ),
    "gr8_condensed_depth": (
        lambda s, d: g.condensed_depth(_mixed(s, d)),
        sql("""ch AS (SELECT coalesce(format('s{:08d}', lag(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey)), format('n{:02d}', s_nationkey)) AS src, format('s{:08d}', s_suppkey) AS dst FROM supplier),
          al AS (SELECT * FROM edges UNION SELECT format('r{:02d}', n_regionkey), format('n{:02d}', n_nationkey) FROM nation UNION SELECT * FROM ch),
          r AS (SELECT src AS a, dst AS b FROM edges UNION SELECT a, dst FROM r JOIN edges ON src = b),
          cm AS (SELECT x.a AS node, min(least(x.a, x.b)) AS c FROM r x JOIN r y ON y.a = x.b AND y.b = x.a WHERE x.a <> x.b GROUP BY x.a),
          ce AS (SELECT DISTINCT coalesce(u.c, src) AS src, coalesce(w.c, dst) AS dst FROM al LEFT JOIN cm u ON u.node = src LEFT JOIN cm w ON w.node = dst WHERE coalesce(u.c, src) <> coalesce(w.c, dst)),
          p AS (SELECT src AS node, 0 AS level FROM ce UNION SELECT dst, level + 1 FROM p JOIN ce ON src = node) SELECT max(level)::BIGINT AS depth FROM p""", "edges"),
    ),
    "gr12_impact": (
        lambda s, d: g.impact(t.nation_edges(s, d), "n03"),
        sql(BFS.format(to="src", e="edges", frm="dst", max=5) + """ SELECT count(*) AS affected, round(least(count(*) / 10, 1), 6) AS risk, count(*) FILTER (depth = 1) AS direct, coalesce(max(depth), 0)::BIGINT AS depth,
          CASE WHEN count(*) > 5 THEN 'high' WHEN count(*) > 0 THEN 'medium' ELSE 'low' END AS severity FROM b WHERE depth > 0""", "edges"),
    ),
    "gr7_nearby": (
        lambda s, d: g.reach(t.nation_edges(s, d), _start(s), 2, undirected=True).select("node", "depth"),
        sql("u AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), " + BFS.format(to="dst", e="u", frm="src", max=2) + " SELECT node, depth FROM b", "edges"),
    ),
    "gr14_callers": (
        lambda s, d: g.simple(t.nation_edges(s, d)).groupBy("dst").agg(F.array_join(F.array_sort(F.collect_set("src")), ",").alias("callers")),
        sql("SELECT dst, array_to_string(list_sort(list(DISTINCT src)), ',') AS callers FROM edges GROUP BY dst", "edges"),
    ),
    "gr15_predicted_questions": (
        lambda s, d: g.degrees(t.nation_edges(s, d)).select("node", F.when(F.col("fan_in") > 5, "high").when(F.col("fan_in") > 0, "medium").otherwise("low").alias("priority")),
        sql("""SELECT node, CASE WHEN coalesce(i, 0) > 5 THEN 'high' WHEN coalesce(i, 0) > 0 THEN 'medium' ELSE 'low' END AS priority FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges)
          LEFT JOIN (SELECT dst AS node, count(*) AS i FROM edges GROUP BY dst) USING (node)""", "edges"),
    ),
    "se1_replace_source": (
        lambda s, d: g.replace_source(t.nation_edges(s, d), s.createDataFrame([("n03", "n00"), ("n03", "n09")], "src string, dst string")),
        sql("SELECT src, dst FROM edges WHERE src <> 'n03' UNION SELECT * FROM (VALUES ('n03', 'n00'), ('n03', 'n09'))", "edges"),
    ),
    "jn17_related_files": (
        lambda s, d: t.nation_edges(s, d).where("src = 'n03'").select(F.col("dst").alias("node")).union(t.nation_edges(s, d).where("dst = 'n03'").select("src")).distinct().orderBy("node").limit(8),
        sql("SELECT dst AS node FROM edges WHERE src = 'n03' UNION SELECT src FROM edges WHERE dst = 'n03' ORDER BY 1 LIMIT 8", "edges"),
    ),
    "page_links_fan_in": (
        lambda s, d: t.page_links(s, d).groupBy("href").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages")),
        sql("SELECT href, count(*) AS n, count(DISTINCT page_id) AS pages FROM links GROUP BY href", "links"),
    ),
}
