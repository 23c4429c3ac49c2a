"""Framework patterns by hand."""

from __future__ import annotations

from sparkloom.operators import frameworks as fw

FILES = "project string, file string, flags array<string>"
FUNCTIONS = "project string, file string, name string, line int, calls array<string>"
DEPENDENCIES = "project string, name string"


def run(spark, files, functions, dependencies):
    rows = fw.detected(spark.createDataFrame(files, FILES), spark.createDataFrame(functions, FUNCTIONS), spark.createDataFrame(dependencies, DEPENDENCIES)).collect()
    return {(r["project"], r["id"]): (r["occurrences"], r["confidence"], [tuple(e) for e in r["evidence"]]) for r in rows}


def test_signs_count_only_with_their_dependency(spark):
    files = [("a", "src/app/x.tsx", ["jsx"]), ("a", "src/app/y.tsx", ["jsx", "use-client"]), ("a", "pages/z.ts", None), ("a", "api/route.ts", []), ("a", "api/none.ts", ["use-server"]), ("b", "src/app/x.tsx", ["jsx"]), (None, "pages/q.ts", None)]
    functions = [("a", "f.ts", "useIt", 3, ["cn", "cn", "x"]), ("a", "f.ts", "useful", 4, None), ("a", "f.ts", None, 5, ["db.findMany"]), ("b", "g.ts", "useÉ", 1, ["prisma.x"])]
    got = run(spark, files, functions, [("a", "next"), ("a", "next"), ("a", "tailwindcss"), ("b", "react"), ("b", "prisma"), ("b", "@prisma/client"), ("c", "@trpc/server"), ("c", "@trpcx"), ("c", "next"), (None, "hono"), ("d", None)])
    assert got == {
        ("a", "nextjs-app-router"): (1, 0.95, []),
        ("a", "server-components"): (1, 0.90, [("src/app/x.tsx", 1, "RSC")]),
        ("a", "client-components"): (1, 0.95, [("src/app/y.tsx", 1, "'use client'")]),
        ("a", "server-actions"): (1, 0.95, [("api/none.ts", 1, "'use server'")]),
        ("a", "api-routes"): (1, 0.90, [("api/route.ts", 1, "")]),
        ("a", "tailwind-cn"): (2, 0.88, []),
        ("a", "tailwind"): (1, 0.95, []),
        ("b", "custom-hooks"): (1, 0.93, [("g.ts", 1, "useÉ")]),
        ("b", "ui-components"): (1, 0.90, []),
        ("b", "prisma-orm"): (1, 0.92, [("g.ts", 1, "useÉ")]),
        ("c", "trpc"): (1, 0.90, []),
    }


def test_pages_router_without_app_router_and_first_places(spark):
    files = [("a", f"pages/{i:02d}.ts", ["use-client"]) for i in range(9)]
    functions = [("a", "h.ts", f"useH{i:02d}", 20 - i, []) for i in range(15)]
    got = run(spark, files, functions, [("a", "next"), ("a", "react")])
    assert got["a", "nextjs-pages-router"][0] == 1 and ("a", "nextjs-app-router") not in got
    assert got["a", "client-components"][0] == 9 and [e[0] for e in got["a", "client-components"][2]] == [f"pages/{i:02d}.ts" for i in range(5)]
    assert got["a", "custom-hooks"][0] == 15 and [e[1] for e in got["a", "custom-hooks"][2]] == list(range(6, 16))
    assert run(spark, [], [], []) == {}
