"""Queries over a workspace of modules: parts are files, and parts of neighbouring lines of an order import each other."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import extraction as ex
from ..operators import resolve as m
from ..operators.cut import cut_lineage
from ..sources import tables as t

UP = "../../../"


def _path(k, index="/index.ts"):
    """A part's file; three kinds of extensions, every fourth one the index of a folder."""
    end = F.get(F.array(*[F.lit(x) for x in (index, ".tsx", ".ts", ".js")]), (k % 4).cast("int"))
    return F.concat(F.lit("src/m"), k % 5, F.lit("/b"), k % 7, F.lit("/u"), k, end)


def _specifier(a, b):
    """From part a's folder to part b's module, without extension or index."""
    return F.concat(F.when(a % 4 == 0, UP + "../").otherwise(UP), _path(b, "").substr(F.lit(1), F.length(_path(b, "")) - F.when(b % 4 == 0, 0).when(b % 4 == 1, 4).otherwise(3)))


def pairs(s, d):
    """(a, bs): part a imports parts bs."""
    after = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    rows = t.table(s, d, "lineitem").select(F.col("l_partkey").alias("a"), after.alias("b")).where("b is not null and a <> b")
    return rows.groupBy("a").agg(F.collect_set("b").alias("bs"))


def workspace(s, d, of=None):
    """(file, text) of parts. Part k defines f<k>, by default if k % 3 = 1, and by name if k % 3 = 2; else it passes on that of k div 3
    under its own name. Parts 6 and 7 of ten pass all names on to each other. An import is a name, a namespace or the default, by a + b."""
    k, j = F.col("k"), F.col("k").cast("long")
    third = F.floor(k / 3).cast("long")
    inner = F.when(third % 3 == 1, "default").otherwise(F.concat(F.lit("f"), third))
    own = F.when(k % 3 == 1, F.concat(F.lit("export default function f"), k, F.lit("() {\n}\n"))).when(k % 3 == 2, F.concat(F.lit("export async function f"), k, F.lit("() {\n}\n"))).otherwise(
        F.concat(F.lit("export { "), inner, F.lit(" as f"), k, F.lit(" } from '"), _specifier(j, third), F.lit("';\n")))
    star = F.when(k % 10 == 7, k - 1).when((k % 10 == 6) & (k < F.col("last")), k + 1)
    stars = F.coalesce(F.concat(F.lit("export * from \""), _specifier(j, star), F.lit("\";\n")), F.lit(""))
    a = F.col("a")
    of = pairs(s, d) if of is None else of
    imports = of.select(a.alias("k"), F.array_join(F.array_sort(F.transform("bs", lambda b: _import(a, b))), "").alias("imports"))
    parts = t.table(s, d, "part").select(F.col("p_partkey").alias("k"))
    dealt = parts.repartition(int(s.conf.get("spark.sql.shuffle.partitions")), "k")  # keys are few bytes, the texts made of them are not
    last = parts.agg(F.max("k").alias("last"))  # one row
    return dealt.join(imports, "k", "left").crossJoin(F.broadcast(last)).select(_path(j).alias("file"), F.concat(F.coalesce("imports", F.lit("")), own, stars).alias("text"))


def _import(a, b):
    name = F.when(b % 10 == 7, F.concat(F.lit("f"), b - 1)).when(b % 3 == 1, "default").otherwise(F.concat(F.lit("f"), b))
    clause = F.when((a + b) % 3 == 0, F.concat(F.lit("{ "), name, F.lit(" as x"), b, F.lit(",\n }"))).when((a + b) % 3 == 1, F.concat(F.lit("* as ns"), b)).otherwise(F.concat(F.lit("d"), b))
    return F.concat(F.lit("import "), clause, F.lit(" from '"), _specifier(a, b), F.lit("';\n"))


def calls(s, d, of):
    """Part a calls what it imports of part b, a name, a namespace's member or the default, and a function of its own."""
    a, b = F.col("a"), F.col("b")
    kind = (a + b) % 3
    of = of.select("a", F.explode("bs").alias("b")).select(_path(a).alias("caller_file"), F.lit("run").alias("caller"), F.when(kind == 1, F.concat(F.lit("ns"), b)).alias("object"),
        F.when(kind == 0, F.concat(F.lit("x"), b)).when(kind == 1, F.concat(F.lit("f"), b)).otherwise(F.concat(F.lit("d"), b)).alias("callee"))
    k = F.col("p_partkey")
    own = t.table(s, d, "part").select(_path(k).alias("caller_file"), F.lit("main").alias("caller"), F.lit(None).cast("string").alias("object"), F.concat(F.lit("f"), F.when(k % 2 == 0, k).otherwise(-k)).alias("callee"))
    return of.union(own)


def bindings(s, d):
    return m.resolved_bindings(workspace(s, d))


def _bound(s, d):
    """Calls by their bindings, and the symbols of files."""
    of = cut_lineage(pairs(s, d))
    files = m.parsed(workspace(s, d, of))
    given = cut_lineage(m.resolved_exports(files))
    symbols = cut_lineage(m.exports(files).where("specifier is null").select("file", F.col("local").alias("name")))
    return m.call_targets(calls(s, d, of), m.resolved_bindings(files, given), symbols, given), symbols


def bound_calls(s, d):
    return _bound(s, d)[0]


def located_calls(s, d):
    """Calls by the file and symbol of their binding; what has none by its name alone."""
    found, symbols = _bound(s, d)
    return ex.resolve_calls(cut_lineage(found.select("caller_file", "caller", "callee_file", F.coalesce("callee_symbol", "callee").alias("callee"))), symbols)


PATH = "'src/m' || {k} % 5 || '/b' || {k} % 7 || '/u' || {k} || (['/index.ts', '.tsx', '.ts', '.js'])[{k} % 4 + 1]"
path = lambda k: PATH.format(k=k)
#: Nodes are (part, name): name n stands for f<n>, -1 for default. A way ends at the part that defines the name.
SQL = f"""WITH RECURSIVE parts AS (SELECT p_partkey::BIGINT AS k FROM part), z AS (SELECT max(k) AS last FROM parts),
pairs AS (SELECT DISTINCT a, b FROM (SELECT l_partkey::BIGINT AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey)::BIGINT AS b FROM lineitem) WHERE b IS NOT NULL AND a <> b),
star AS (SELECT k AS pos, CASE WHEN k % 10 = 7 THEN k - 1 ELSE k + 1 END AS too FROM parts, z WHERE k % 10 = 7 OR (k % 10 = 6 AND k < last)),
imp AS (SELECT a, b, (a + b) % 3 AS kind, CASE WHEN b % 10 = 7 THEN b - 1 WHEN b % 3 = 1 THEN -1 ELSE b END AS n FROM pairs),
asked AS (SELECT DISTINCT b AS m, n FROM imp WHERE kind = 0 UNION SELECT b, -1 FROM imp WHERE kind = 2{{more}}),
w AS (SELECT m, n, m AS pos, n AS nm, 0 AS hops FROM asked
  UNION ALL SELECT m, n, CASE WHEN pos % 3 = 0 AND nm = pos THEN pos // 3 ELSE too END, CASE WHEN pos % 3 = 0 AND nm = pos THEN (CASE WHEN (pos // 3) % 3 = 1 THEN -1 ELSE pos // 3 END) ELSE nm END, hops + 1
  FROM w LEFT JOIN star USING (pos) WHERE hops < 40 AND NOT ((pos % 3 = 1 AND nm = -1) OR (pos % 3 = 2 AND nm = pos)) AND ((pos % 3 = 0 AND nm = pos) OR (nm <> -1 AND too IS NOT NULL))),
o AS (SELECT m, n, min(hops) AS hops, arg_min(pos, hops) AS pos FROM w WHERE (pos % 3 = 1 AND nm = -1) OR (pos % 3 = 2 AND nm = pos) GROUP BY m, n)"""
BINDINGS = f"""{SQL.format(more="")}
SELECT {path("a")} AS file, (['named', 'namespace', 'default'])[kind + 1] AS kind, CASE kind WHEN 0 THEN CASE WHEN i.n = -1 THEN 'default' ELSE 'f' || i.n END WHEN 1 THEN '*' ELSE 'default' END AS imported,
  (['x', 'ns', 'd'])[kind + 1] || b AS local, {path("b")} AS module, CASE WHEN kind = 1 THEN {path("b")} ELSE {path("o.pos")} END AS origin_file,
  CASE WHEN kind = 1 THEN '*' ELSE 'f' || o.pos END AS origin_name, CASE WHEN kind = 1 THEN 0 ELSE o.hops END::BIGINT AS hops
FROM imp i LEFT JOIN o ON o.m = b AND o.n = CASE kind WHEN 0 THEN i.n WHEN 2 THEN -1 END"""
CALLS = f"""{SQL.format(more=" UNION SELECT b, b FROM imp WHERE kind = 1")},
c AS (SELECT {path("a")} AS caller_file, 'run' AS caller, CASE WHEN kind = 1 THEN 'ns' || b END AS object, (['x', 'f', 'd'])[kind + 1] || b AS callee,
  coalesce({path("o.pos")}, {path("b")}) AS callee_file, coalesce('f' || o.pos, CASE kind WHEN 0 THEN CASE WHEN i.n = -1 THEN 'default' ELSE 'f' || i.n END WHEN 1 THEN 'f' || b ELSE 'default' END) AS callee_symbol
  FROM imp i LEFT JOIN o ON o.m = b AND o.n = CASE kind WHEN 0 THEN i.n WHEN 1 THEN b ELSE -1 END
  UNION ALL SELECT {path("k")}, 'main', NULL, 'f' || CASE WHEN k % 2 = 0 THEN k ELSE -k END, CASE WHEN k % 2 = 0 AND k % 3 <> 0 THEN {path("k")} END, CASE WHEN k % 2 = 0 AND k % 3 <> 0 THEN 'f' || k END FROM parts)"""
LOCATED = f"""{CALLS}, d AS (SELECT {path("k")} AS file, 'f' || k AS name FROM parts WHERE k % 3 <> 0), q AS (SELECT caller_file, caller, coalesce(callee_symbol, callee) AS callee, callee_file AS cf FROM c)
SELECT caller_file, caller, callee, cf AS callee_file FROM q WHERE EXISTS (SELECT 1 FROM d WHERE file = cf AND name = callee)
UNION ALL SELECT caller_file, caller, callee, file FROM q JOIN d ON name = callee WHERE NOT EXISTS (SELECT 1 FROM d e WHERE e.file = cf AND e.name = callee)"""

PLANS = {
    "sc15_resolved_bindings": (lambda s, d: bindings(s, d).select("file", "kind", "imported", "local", "module", "origin_file", "origin_name", "hops"), BINDINGS),
    "jn6_bound_calls": (bound_calls, f"{CALLS} SELECT * FROM c"),
    "jn6_located_calls": (located_calls, LOCATED),
}
