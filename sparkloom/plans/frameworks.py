"""Queries of framework patterns by project."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frameworks as fw
from ..sources import tables as t

FOLDERS = ("src/pages/", "lib/", "src/ui/", "src/app/", "app/api/", "web/api/route.", "pages/")
ENDS = (".tsx", ".jsx", ".ts", ".js")
NAMES = ("use", "useful", "load", "useCn")
CALLS = (("cn", "clsx", "x"), ("prisma.user.findMany",), ("db.$queryRaw", "cva"), ())
DEPENDENCIES = (
    "next", "react", "prisma", "@prisma/client", "@trpc/server", "express", "fastify", "hono", "tailwindcss", "vitest", "jest", "@playwright/test", "cypress", "zustand", "@reduxjs/toolkit", "jotai",
    "recoil", "mobx", "left-pad", "next-auth",
)


def _pick(values, by):
    return F.get(F.array(*[F.lit(x) for x in values]), by.cast("int"))


def sources(s, d):
    """Parts as files with one function each, brands as projects; every third size names a dependency."""
    n, size, none = F.col("p_partkey"), F.col("p_size"), F.array().cast("array<string>")
    brand = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int")
    file = F.concat(_pick(FOLDERS, F.when(brand % 3 == 0, size % 3).otherwise(size % 7)), F.replace("p_name", F.lit(" "), F.lit("_")), _pick(ENDS, n % 4))
    p = t.table(s, d, "part").withColumns({"project": F.col("p_brand"), "file": file})
    flags = F.array_compact(F.array(F.when(n % 2 == 0, "jsx"), F.when(size % 5 == 0, "use-client"), F.when(size % 11 == 0, "use-server")))
    calls = F.get(F.array(*[F.array(*[F.lit(x) for x in c]).cast("array<string>") if c else none for c in CALLS]), (size % 4).cast("int"))
    name = F.concat(_pick(NAMES, n % 4), F.when(n % 4 == 0, F.col("p_brand")).otherwise(F.lit("")))
    return (
        p.select("project", "file", flags.alias("flags")),
        p.select("project", "file", name.alias("name"), size.cast("long").alias("line"), calls.alias("calls")),
        p.where(size % 3 == 0).select("project", _pick(DEPENDENCIES, n % len(DEPENDENCIES)).alias("name")),
    )


def _shown(s, d):
    shown = F.array_join(F.transform("evidence", lambda x: F.concat(x["file"], F.lit(":"), x["line"], F.lit(":"), x["name"])), ";")
    return fw.detected(*sources(s, d)).select("project", "id", "label", "confidence", "occurrences", shown.alias("evidence"))


_LIST = lambda xs: "[" + ", ".join("'" + x + "'" for x in xs) + "]"
SOURCES = (
    f"p AS (SELECT p_brand AS project, p_partkey AS n, p_size AS z, {_LIST(FOLDERS)}[CASE WHEN regexp_extract(p_brand, '[0-9]+')::INT % 3 = 0 THEN p_size % 3 ELSE p_size % 7 END + 1] || replace(p_name, ' ', '_') || {_LIST(ENDS)}[p_partkey % 4 + 1] AS file, "
    f"{_LIST(NAMES)}[p_partkey % 4 + 1] || CASE WHEN p_partkey % 4 = 0 THEN p_brand ELSE '' END AS name FROM part), d AS (SELECT DISTINCT project, {_LIST(DEPENDENCIES)}[n % {len(DEPENDENCIES)} + 1] AS dep FROM p WHERE z % 3 = 0)"
)
CL8 = f"""WITH {SOURCES},
  h AS (SELECT project, 'server-components' AS id, file, 1 AS line, 'RSC' AS name FROM p WHERE n % 4 = 0 AND z % 5 <> 0 AND contains(file, 'app/')
    UNION ALL SELECT project, 'server-actions', file, 1, '''use server''' FROM p WHERE z % 11 = 0 UNION ALL SELECT project, 'client-components', file, 1, '''use client''' FROM p WHERE z % 5 = 0
    UNION ALL SELECT project, 'api-routes', file, 1, '' FROM p WHERE contains(file, 'api/') UNION ALL SELECT project, 'custom-hooks', file, z, name FROM p WHERE n % 4 IN (0, 3)
    UNION ALL SELECT project, 'prisma-orm', file, z, name FROM p WHERE z % 4 IN (1, 2)),
  k AS (SELECT project, id, count(*) AS n FROM h GROUP BY ALL UNION ALL SELECT project, 'ui-components', count(*) FROM p WHERE n % 2 = 0 GROUP BY project
    UNION ALL SELECT project, 'tailwind-cn', sum(CASE z % 4 WHEN 0 THEN 2 ELSE 1 END) FROM p WHERE z % 4 IN (0, 2) GROUP BY project
    UNION ALL SELECT project, 'nextjs-app-router', 1 FROM p WHERE contains(file, 'app/') GROUP BY project
    UNION ALL SELECT project, 'nextjs-pages-router', 1 FROM p GROUP BY project HAVING bool_or(contains(file, 'pages/')) AND NOT bool_or(contains(file, 'app/'))
    UNION ALL SELECT DISTINCT project, w.id, 1 FROM p CROSS JOIN (VALUES {", ".join(f"('{i}')" for i, _, _, how, _ in fw.FRAMEWORKS if how == "there")}) w(id)),
  r(id, label, dep, confidence) AS (VALUES {", ".join(f"('{i}', '{label}', '{'@trpc/server' if x == '@trpc/' else x}', {c})" for i, label, deps, _, c in fw.FRAMEWORKS for x in deps)}),
  a AS (SELECT DISTINCT project, id, label, confidence FROM d JOIN r USING (dep)),
  e AS (SELECT project, id, string_agg(file || ':' || line || ':' || name, ';' ORDER BY x) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY project, id ORDER BY file, line, name) AS x FROM h) WHERE x <= CASE id WHEN 'custom-hooks' THEN 10 ELSE 5 END GROUP BY ALL)
  SELECT project, id, label, confidence::DOUBLE AS confidence, n::BIGINT AS occurrences, coalesce(evidence, '') AS evidence FROM a JOIN k USING (project, id) LEFT JOIN e USING (project, id)"""

PLANS = {"cl8_project_frameworks": (_shown, CL8)}
