"""Patterns of frameworks: what a project's dependencies, files and functions show together, for all projects in one plan.

files: project, file, flags (array of jsx, use-client, use-server). functions: project, file, name, line, calls (array).
dependencies: project, name. Null arrays are empty; rows without a project count for nothing.

Every file and function is read once and gives a row for each sign it bears; signs are counted with partial sums and
only the first few of each are kept as evidence, so a project that holds most rows costs no task more than its share.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values: (id, label, dependencies, how occurrences count, confidence). "there": once with the dependency alone;
#: "any": once where some sign is found; "all": as often as signs are found. A dependency that ends in / is a prefix.
FRAMEWORKS = (
    ("nextjs-app-router", "Next.js App Router", ("next",), "any", 0.95),
    ("nextjs-pages-router", "Next.js Pages Router", ("next",), "any", 0.95),
    ("server-components", "Server Components", ("next",), "all", 0.90),
    ("server-actions", "Server Actions", ("next",), "all", 0.95),
    ("client-components", "Client Components", ("next",), "all", 0.95),
    ("api-routes", "API Routes", ("next",), "all", 0.90),
    ("custom-hooks", "Custom Hooks", ("react",), "all", 0.93),
    ("ui-components", "UI Components", ("react",), "all", 0.90),
    ("prisma-orm", "Prisma ORM", ("@prisma/client", "prisma"), "all", 0.92),
    ("trpc", "tRPC", ("@trpc/",), "there", 0.90),
    ("express-framework", "Express Framework", ("express",), "there", 0.90),
    ("fastify-framework", "Fastify Framework", ("fastify",), "there", 0.90),
    ("hono-framework", "Hono Framework", ("hono",), "there", 0.90),
    ("tailwind-cn", "Class Merging (cn/clsx)", ("tailwindcss",), "all", 0.88),
    ("tailwind", "Tailwind CSS", ("tailwindcss",), "there", 0.95),
    ("vitest-testing", "Vitest Testing", ("vitest",), "there", 0.95),
    ("jest-testing", "Jest Testing", ("jest",), "there", 0.95),
    ("playwright-test-testing", "Playwright Testing", ("@playwright/test",), "there", 0.95),
    ("cypress-testing", "Cypress Testing", ("cypress",), "there", 0.95),
    ("zustand-state", "Zustand State Management", ("zustand",), "there", 0.90),
    ("reduxjs-toolkit-state", "Redux Toolkit State Management", ("@reduxjs/toolkit",), "there", 0.90),
    ("jotai-state", "Jotai State Management", ("jotai",), "there", 0.90),
    ("recoil-state", "Recoil State Management", ("recoil",), "there", 0.90),
    ("mobx-state", "MobX State Management", ("mobx",), "there", 0.90),
)
#: Parts of calls that reach a database client, and calls that merge class names.
CLIENT_CALLS = ("prisma", "findMany", "findUnique", "$transaction", "$queryRaw")
MERGE_CALLS = ("cn", "clsx", "twMerge", "cva")
#: How many places are shown as evidence; patterns not listed show none.
EVIDENCE = {"server-components": 5, "server-actions": 5, "client-components": 5, "api-routes": 5, "custom-hooks": 10, "prisma-orm": 5}


def _rows(df: DataFrame, signs: dict[str, tuple[Column, Column, Column]], line: Column) -> DataFrame:
    """(project, id, n, file, line, name): a row for each sign (how often, name) that a row of df bears."""
    borne = F.array(*[F.when(met, F.struct(F.lit(i).alias("id"), n.cast("long").alias("n"), name.alias("name"))) for i, (met, n, name) in signs.items()])
    return df.where("project is not null").select("project", "file", line.cast("long").alias("line"), F.explode(F.array_compact(borne)).alias("x")).select("project", "x.id", "x.n", "file", "line", "x.name")


def signs(files: DataFrame, functions: DataFrame) -> DataFrame:
    """What files and functions show, whatever their project depends on."""
    path = F.col("file")
    flags = F.coalesce("flags", F.array().cast("array<string>"))
    jsx, client, server = (F.array_contains(flags, x) for x in ("jsx", "use-client", "use-server"))
    app = path.contains("app/")
    once = lambda met, name="": (met, F.lit(1), F.lit(name))
    of_files = {
        "nextjs-app-router": once(app),
        "nextjs-pages-router": once(path.contains("pages/")),
        "server-components": once((path.endswith(".tsx") | path.endswith(".jsx")) & jsx & ~client & app, "RSC"),
        "server-actions": once(server, "'use server'"),
        "client-components": once(client, "'use client'"),
        "api-routes": once(path.contains("api/") & (path.contains("route.") | path.contains("/api/"))),
        "ui-components": once(jsx),
    }
    calls = F.coalesce("calls", F.array().cast("array<string>"))
    reaches = F.exists(calls, lambda c: reduce(lambda e, w: e | c.contains(w), CLIENT_CALLS[1:], c.contains(CLIENT_CALLS[0])))
    merges = F.size(F.filter(calls, lambda c: c.isin(*MERGE_CALLS)))
    name = F.coalesce("name", F.lit(""))
    of_functions = {
        "custom-hooks": (name.rlike(r"^use\p{Lu}"), F.lit(1), name),
        "prisma-orm": (reaches, F.lit(1), name),
        "tailwind-cn": (merges > 0, merges, name),
    }
    return _rows(files, of_files, F.lit(1)).unionByName(_rows(functions, of_functions, F.col("line")))


def _asked(dependencies: DataFrame, rules) -> DataFrame:
    """(project, id, label, how, confidence): the patterns that a project's dependencies ask for, each once."""
    name = F.col("name")
    asks = lambda deps: reduce(lambda e, d: e | (name.startswith(d) if d.endswith("/") else name == d), deps, F.lit(False))
    rows = F.array(*[F.when(asks(deps), F.struct(F.lit(i).alias("id"), F.lit(label).alias("label"), F.lit(how).alias("how"), F.lit(c).alias("confidence"))) for i, label, deps, how, c in rules])
    return dependencies.where("project is not null").select("project", F.explode(F.array_compact(rows)).alias("x")).select("project", "x.*").distinct()


def evidence(found: DataFrame, most: dict[str, int] | None = None) -> DataFrame:
    """(project, id, evidence): the first places (file, line, name) of each pattern. Ranks are limited before the shuffle."""
    most = EVIDENCE if most is None else most
    first = Window.partitionBy("project", "id").orderBy("file", "line", "name")
    ranked = found.where(F.col("id").isin(*most)).withColumn("r", F.row_number().over(first)).where(F.col("r") <= max(most.values(), default=0))
    limit = reduce(lambda e, kv: e.when(F.col("id") == kv[0], kv[1]), list(most.items())[1:], F.when(F.col("id") == next(iter(most)), next(iter(most.values()))))
    kept = ranked.where(F.col("r") <= limit).groupBy("project", "id").agg(F.array_sort(F.collect_list(F.struct("r", "file", "line", "name"))).alias("e"))
    return kept.select("project", "id", F.transform("e", lambda x: F.struct(x["file"].alias("file"), x["line"].alias("line"), x["name"].alias("name"))).alias("evidence"))


def detected(files: DataFrame, functions: DataFrame, dependencies: DataFrame, rules=FRAMEWORKS) -> DataFrame:
    """(project, id, label, tier, confidence, occurrences, evidence) of each project's framework patterns. A project with
    files of the app router has no pages router."""
    found = signs(files, functions)
    counts = found.groupBy("project", "id").agg(F.sum("n").alias("n"))
    seen = F.when(F.col("how") == "there", F.lit(1).cast("long")).when((F.col("how") == "any") & F.col("n").isNotNull(), F.lit(1).cast("long")).otherwise(F.col("n"))
    own = _asked(dependencies, rules).join(counts, ["project", "id"], "left").withColumn("occurrences", seen).where("occurrences is not null")
    app = F.max(F.col("id") == "nextjs-app-router").over(Window.partitionBy("project"))  # at most one row a rule
    own = own.withColumn("app", app).where(~(F.col("app") & (F.col("id") == "nextjs-pages-router")))
    none = F.array().cast("array<struct<file:string,line:bigint,name:string>>")
    return own.join(evidence(found), ["project", "id"], "left").select("project", "id", "label", F.lit("framework").alias("tier"), "confidence", "occurrences", F.coalesce("evidence", none).alias("evidence"))
