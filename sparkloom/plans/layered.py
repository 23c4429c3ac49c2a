"""Queries of layered documents and contexts, and of replicas that are merged."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import crdt, layers
from ..sources import tables as t


def documents(s, d):
    """Suppliers' documents as layers of their nation: some members are scalars here, lists or objects there, some no JSON."""
    k = F.col("s_suppkey")
    cfg = F.when(k % 4 == 0, '"off"').when(k % 4 == 1, F.format_string('{"lim": %d, "on": [%d, 7]}', k % 5, k % 3)).when(k % 4 == 2, F.format_string('{"lim": {"max": %d}}', k % 5)).otherwise(F.format_string("[%d]", k % 2))
    content = F.when(k % 9 == 0, F.concat(F.lit("not JSON: "), "s_name")).when(k % 9 == 1, "{}").otherwise(F.concat(F.lit('{"name": "'), "s_name", F.lit('", "cfg": '), cfg, F.format_string(', "tags": ["t%d", "t%d"]}', k % 3, k % 4)))
    rank = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    return t.table(s, d, "supplier").select(F.format_string("n%02d", "s_nationkey").alias("id"), rank.cast("long").alias("ordinal"), content.alias("content"))


#: Nodes of the documents by path, then what no later layer covers at the node or above it.
MERGED = """WITH s AS (SELECT format('n{:02d}', s_nationkey) AS id, -row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS o, s_suppkey AS k, s_name AS nm FROM supplier),
j AS (SELECT * FROM s WHERE k % 9 > 1),
n AS (SELECT id, o, '' AS p, CASE WHEN k % 9 = 0 THEN 's' ELSE 'o' END AS t, CASE WHEN k % 9 = 0 THEN '"not JSON: ' || nm || '"' END AS v FROM s
  UNION ALL SELECT id, o, 'name', 's', '"' || nm || '"' FROM j
  UNION ALL SELECT id, o, 'cfg', (['s', 'o', 'o', 'a'])[k % 4 + 1], CASE k % 4 WHEN 0 THEN '"off"' WHEN 3 THEN (k % 2)::VARCHAR END FROM j
  UNION ALL SELECT id, o, 'cfg/lim', CASE WHEN k % 4 = 1 THEN 's' ELSE 'o' END, CASE WHEN k % 4 = 1 THEN (k % 5)::VARCHAR END FROM j WHERE k % 4 IN (1, 2)
  UNION ALL SELECT id, o, 'cfg/on', 'a', (k % 3) || ',7' FROM j WHERE k % 4 = 1
  UNION ALL SELECT id, o, 'cfg/lim/max', 's', (k % 5)::VARCHAR FROM j WHERE k % 4 = 2
  UNION ALL SELECT id, o, 'tags', 'a', format('"t{}","t{}"', k % 3, k % 4) FROM j),
a AS (SELECT * FROM n x WHERE NOT EXISTS (SELECT 1 FROM n y WHERE y.id = x.id AND y.o > x.o AND y.t <> 'o' AND x.p <> y.p AND (y.p = '' OR starts_with(x.p, y.p || '/')))),
b AS (SELECT * FROM a x WHERE NOT EXISTS (SELECT 1 FROM a y WHERE y.id = x.id AND y.p = x.p AND y.o > x.o AND (y.t <> x.t OR x.t = 's'))),
u AS (SELECT id, p, o, unnest(string_split(v, ',')) AS e, generate_subscripts(string_split(v, ','), 1) AS i, o = min(o) OVER (PARTITION BY id, p) AS f FROM b WHERE t = 'a'),
q AS (SELECT id, p, '[' || string_agg(e, ',' ORDER BY o, i) || ']' AS v FROM (SELECT *, row_number() OVER (PARTITION BY id, p, e ORDER BY o, i) AS r FROM u) WHERE f OR r = 1 GROUP BY id, p)
SELECT id, p AS path, v AS value FROM b WHERE t = 's' UNION ALL SELECT id, p, v FROM q
UNION ALL SELECT DISTINCT id, p, '{}' FROM b x WHERE t = 'o' AND NOT EXISTS (SELECT 1 FROM b y WHERE y.id = x.id AND y.p <> x.p AND (x.p = '' OR starts_with(y.p, x.p || '/')))"""


def contexts(s, d):
    """Parts as layers over folders by remainder and brand, asked for by files of parts."""
    p = t.table(s, d, "part").where("p_size is not null")
    k = F.col("p_partkey")
    w = Window.partitionBy(k % 3, "p_brand").orderBy("p_partkey")
    top = p.withColumn("r", F.row_number().over(w)).where("r <= 4")  # a folder has four layers
    folder = F.concat(F.lit("src/m"), k % 3, F.when(F.col("r") > 1, F.concat(F.lit("/"), F.replace("p_brand", F.lit("Brand#"), F.lit("b")))).otherwise(""))
    word = lambda n: F.concat(F.lit("w"), k % n)
    two = lambda a, b: F.array(word(a), word(b))
    rows = top.select(F.format_string("l%08d", "p_partkey").alias("name"), F.col("p_size").cast("int").alias("priority"), folder.alias("path"),
        F.when(k % 5 == 0, "override").when(k % 5 == 1, "extend").otherwise("merge").alias("mode"), two(3, 4).alias("patterns"), two(2, 5).alias("decisions"), F.array(word(7)).alias("rules"), F.array("p_type").alias("issues"),
        F.create_map(F.concat(F.lit("f"), k % 3), F.col("p_name")).alias("file_map"))
    asked = p.select(F.concat(F.lit("src/m"), k % 3, F.lit("/"), F.replace("p_brand", F.lit("Brand#"), F.lit("b")), F.lit("/x.ts")).alias("path"))
    got = layers.resolve_contexts(rows, asked)
    files = F.array_join(F.array_sort(F.transform(F.map_entries("file_map"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return got.select("path", *[F.array_join(f, ",").alias(f) for f in (*layers.LISTS, "layers")], files.alias("files"), "conflicts")


#: The state of a path is folded layer by layer over lists.
CONTEXTS = """WITH RECURSIVE lay AS (SELECT *, 'src/m' || p_partkey % 3 || CASE WHEN r > 1 THEN '/' || replace(p_brand, 'Brand#', 'b') ELSE '' END AS path
  FROM (SELECT *, p_partkey::BIGINT AS k, row_number() OVER (PARTITION BY p_partkey % 3, p_brand ORDER BY p_partkey) AS r FROM part WHERE p_size IS NOT NULL) WHERE r <= 4),
asked AS (SELECT DISTINCT 'src/m' || p_partkey % 3 || '/' || replace(p_brand, 'Brand#', 'b') || '/x.ts' AS q FROM part WHERE p_size IS NOT NULL),
u AS (SELECT q, row_number() OVER (PARTITION BY q ORDER BY p_size DESC, k) AS i, format('l{:08d}', k) AS nm, k, p_type AS ty, p_name AS pn FROM asked JOIN lay ON starts_with(q, path)),
f AS (SELECT q, 0::BIGINT AS i, []::VARCHAR[] AS pa, []::VARCHAR[] AS de, []::VARCHAR[] AS ru, []::VARCHAR[] AS iss, []::VARCHAR[] AS ly, []::VARCHAR[] AS sp, []::VARCHAR[] AS sd, NULL::VARCHAR AS f0, NULL::VARCHAR AS f1, NULL::VARCHAR AS f2, 0::BIGINT AS cf FROM asked
  UNION ALL SELECT f.q, u.i,
    CASE k % 5 WHEN 0 THEN np WHEN 1 THEN np || pa ELSE pa || list_filter(dp, lambda x: NOT list_contains(sp, x)) END, CASE k % 5 WHEN 0 THEN nd WHEN 1 THEN nd || de ELSE de || list_filter(dd, lambda x: NOT list_contains(sd, x)) END,
    CASE k % 5 WHEN 0 THEN ['w' || k % 7] WHEN 1 THEN ['w' || k % 7] || ru ELSE ru || ['w' || k % 7] END, CASE k % 5 WHEN 0 THEN [ty] WHEN 1 THEN [ty] || iss ELSE iss || [ty] END, ly || [nm],
    CASE k % 5 WHEN 0 THEN np WHEN 1 THEN sp ELSE sp || dp END, CASE k % 5 WHEN 0 THEN nd WHEN 1 THEN sd ELSE sd || dd END,
    CASE WHEN k % 3 = 0 THEN pn WHEN k % 5 = 0 THEN NULL ELSE f0 END, CASE WHEN k % 3 = 1 THEN pn WHEN k % 5 = 0 THEN NULL ELSE f1 END, CASE WHEN k % 3 = 2 THEN pn WHEN k % 5 = 0 THEN NULL ELSE f2 END,
    cf + CASE WHEN k % 5 > 1 THEN 4 - len(list_filter(dp, lambda x: NOT list_contains(sp, x))) - len(list_filter(dd, lambda x: NOT list_contains(sd, x))) ELSE 0 END
  FROM f JOIN (SELECT *, ['w' || k % 3, 'w' || k % 4] AS np, ['w' || k % 2, 'w' || k % 5] AS nd, CASE WHEN k % 3 = k % 4 THEN ['w' || k % 3] ELSE ['w' || k % 3, 'w' || k % 4] END AS dp, CASE WHEN k % 2 = k % 5 THEN ['w' || k % 2] ELSE ['w' || k % 2, 'w' || k % 5] END AS dd FROM u) u ON u.q = f.q AND u.i = f.i + 1)
SELECT q AS path, array_to_string(pa, ',') AS patterns, array_to_string(de, ',') AS decisions, array_to_string(ru, ',') AS rules, array_to_string(iss, ',') AS issues, array_to_string(ly, ',') AS layers,
  array_to_string(list_filter([CASE WHEN f0 IS NOT NULL THEN 'f0=' || f0 END, CASE WHEN f1 IS NOT NULL THEN 'f1=' || f1 END, CASE WHEN f2 IS NOT NULL THEN 'f2=' || f2 END], lambda x: x IS NOT NULL), ';') AS files, cf AS conflicts
FROM f WHERE i = (SELECT max(i) FROM u WHERE u.q = f.q) AND i > 0"""

#: When replicas part: event_id of the first operation that the others have not seen.
ALONE = "(SELECT floor(avg(event_id)) FROM events)"


def _replicas(s, d):
    """Dots and clocks of three replicas: all begin with what replica 0 did in the first half of the events; then each adds and removes
    for itself. An error removes all that its replica sees of an element, anything else adds it."""
    e = t.table(s, d, "events")
    part = e.agg(F.floor(F.avg("event_id")).alias("part"))  # one row
    e = e.crossJoin(F.broadcast(part)).select((F.col("user_id") % 50).alias("key"), (F.col("event_id") % 7).alias("element"), "event_id", (F.col("event_type") == "error").alias("removes"), (F.col("event_id") >= F.col("part")).alias("alone"), F.when(F.col("event_id") < F.col("part"), 0).otherwise(F.col("event_id") % 3).alias("actor"))
    e = e.withColumn("counter", F.sum((~F.col("removes")).cast("long")).over(Window.partitionBy("key", "actor").orderBy("event_id")))
    # The last removal of a group tells of every row whether one follows; a frame from each row to the end would be read for each row.
    last = F.max(F.when(F.col("removes"), F.col("event_id"))).over(Window.partitionBy("key", "element", "actor"))
    adds = e.withColumn("gone", F.coalesce((last > F.col("event_id")).cast("int"), F.lit(0))).where("not removes")
    removed = e.where("removes and alone").select("key", "element", F.col("actor").alias("replica")).distinct().withColumn("out", F.lit(True))
    later = e.where("removes and not alone").groupBy("key", "element").agg(F.max("event_id").alias("last"))
    shared = adds.where("not alone").join(later, ["key", "element"], "left").where("last is null or last < event_id").crossJoin(s.range(3).select(F.col("id").cast("int").alias("replica")))  # three rows
    shared = shared.join(removed, ["key", "element", "replica"], "left").where("out is null")
    own = adds.where("alone and gone = 0").withColumn("replica", F.col("actor").cast("int"))
    cols = ["replica", "key", "element", "actor", "counter"]
    dots = shared.select(*cols).union(own.select(*cols))
    first = e.where("not alone").groupBy("key", "actor").agg(F.max("counter").alias("clock")).crossJoin(s.range(3).select(F.col("id").cast("int").alias("replica")))
    more = e.where("alone").groupBy("key", "actor").agg(F.max("counter").alias("clock")).withColumn("replica", F.col("actor").cast("int"))
    clocks = first.select("replica", "key", "actor", "clock").union(more.select("replica", "key", "actor", "clock")).groupBy("replica", "key", "actor").agg(F.max("clock").alias("clock"))
    return dots, clocks


SETS = f"""WITH e AS (SELECT user_id % 50 AS key, event_id % 7 AS element, event_id, event_type = 'error' AS rm, event_id >= {ALONE} AS alone, CASE WHEN event_id < {ALONE} THEN 0 ELSE event_id % 3 END AS actor FROM events),
c AS (SELECT *, sum(CASE WHEN rm THEN 0 ELSE 1 END) OVER (PARTITION BY key, actor ORDER BY event_id)::BIGINT AS counter FROM e),
m AS (SELECT key, element, actor, counter FROM c x WHERE NOT rm AND NOT EXISTS (SELECT 1 FROM e y WHERE y.rm AND y.key = x.key AND y.element = x.element AND y.event_id > x.event_id AND (NOT x.alone OR y.actor = x.actor)))"""


def _log(s, d):
    """Events as a log by space: a space's log is kept from a place on that its readers may have passed or not."""
    e = t.table(s, d, "events").select((F.col("user_id") % 40).alias("space"), "event_id", F.concat(F.lit("a"), F.col("event_id") % 4).alias("actor"), (F.col("event_type") != "error").alias("valid"), F.col("user_id").alias("key"), "value")
    log = e.withColumn("seq", F.row_number().over(Window.partitionBy("space").orderBy("event_id")).cast("long")).where(F.col("seq") > F.col("space") * 3)
    readers = s.range(0, 40).select(F.col("id").alias("space"), F.explode(F.array(*[F.lit(f"a{i}") for i in range(4)])).alias("reader")).select("space", "reader", (F.substring("reader", 2, 1).cast("long") * 40).alias("cursor"))
    return log, readers


LOG = """WITH l AS (SELECT * FROM (SELECT user_id % 40 AS space, 'a' || (event_id % 4) AS actor, event_type <> 'error' AS ok, user_id AS key, value, row_number() OVER (PARTITION BY user_id % 40 ORDER BY event_id) AS seq FROM events) WHERE seq > space * 3),
r AS (SELECT space, 'a' || i AS reader, i * 40 AS cursor FROM range(40) x(space), range(4) y(i)), k AS (SELECT space, max(seq) AS cur, count(*) AS n, greatest(max(seq) - count(*) + 1, 1) AS first FROM l GROUP BY space),
g AS (SELECT r.*, coalesce(cur, 0) AS cur, coalesce(cursor + 1 < first, false) AS gap, CASE WHEN cur IS NULL OR cursor + 1 < first THEN 0 ELSE greatest(cursor - first + 1, 0) END::BIGINT AS start FROM r LEFT JOIN k USING (space))"""

PLANS = {
    "cx9_merged_documents": (lambda s, d: layers.merge_documents(documents(s, d)), MERGED),
    "cx10_contexts": (contexts, CONTEXTS),
    "sy3_observed_remove_dots": (lambda s, d: crdt.merge_dots(*_replicas(s, d), "element"), f"{SETS} SELECT * FROM m"),
    "sy3_observed_remove_sets": (
        lambda s, d: crdt.elements(crdt.merge_dots(*_replicas(s, d), "element")).select("key", F.array_join("elements", ",").alias("elements")),
        f"{SETS} SELECT key, array_to_string(list_sort(list(DISTINCT element)), ',') AS elements FROM m GROUP BY key",
    ),
    "sy3_merged_clocks": (lambda s, d: crdt.merge_clocks(_replicas(s, d)[1]), f"{SETS} SELECT key, actor, max(counter) AS clock FROM c GROUP BY key, actor"),
    "sy2_pulls": (
        lambda s, d: crdt.pulls(*_log(s, d)),
        f"""{LOG} SELECT g.space, reader, gap, start, count(*) FILTER (ok AND actor <> reader) AS applied, count(*) FILTER (ok AND actor = reader) AS own, count(*) FILTER (NOT ok) AS invalid,
          CASE WHEN gap THEN any_value(cur) ELSE coalesce(max(seq), any_value(cursor)) END::BIGINT AS cursor FROM g LEFT JOIN l ON l.space = g.space AND NOT gap AND seq > cursor GROUP BY g.space, reader, gap, start""",
    ),
    "sy2_pulled_operations": (
        lambda s, d: crdt.pulled(*_log(s, d)).groupBy("space", "reader").agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"), F.count_distinct("key").alias("keys")),
        f"{LOG} SELECT g.space, reader, count(*) AS n, sum(seq)::BIGINT AS seqs, count(DISTINCT key) AS keys FROM g JOIN l ON l.space = g.space AND NOT gap AND seq > cursor AND ok AND actor <> reader GROUP BY g.space, reader",
    ),
}
