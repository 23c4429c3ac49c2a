"""Imports, module paths and re-exports on a small workspace by hand, and on random ones against a plain resolver."""

from __future__ import annotations

import random

from sparkloom.operators import resolve as m

FILES = [
    ("src/app/main.ts", """import Def, { one, two as zwei } from './lib';
import * as all from "../shared";
import type { Shape } from '../shared/shape';
import {
  deep,
  type Kind,
} from './lib/deep.js'
import './side-effect';
import React from 'react';
import { gone } from './nowhere';
const late = import('./lib');
export const here = 1;
"""),
    ("src/app/lib/index.ts", "export { one } from './one';\nexport { deep as two } from './deep';\nexport default class Lib {}\n"),
    ("src/app/lib.ts", "export * from './lib/index';\nexport function one() {}\nexport { x as default } from './lib/one';"),
    ("src/app/lib/one.tsx", "import { deep } from './deep';\nexport { deep as one };\nexport const x = 1;"),
    ("src/app/lib/deep.js", "export async function deep() {}\nexport interface Kind {}\nexport * from './circle';"),
    ("src/app/lib/circle.ts", "export * from './deep';\nexport * as ns from './one';"),
    ("src/shared/index.d.ts", "export declare function util(): void;"),
    ("src/shared/shape.ts", "export type Shape = {};\nfunction hidden() {}\nexport {hidden as shown,};"),
    ("src/empty.ts", ""),
    ("src/null.ts", None),
]
SCHEMA = "file string, text string"


def test_bindings(spark):
    got = {(r["file"], r["local"]): tuple(r)[1:] for r in m.resolved_bindings(spark.createDataFrame(FILES, SCHEMA)).collect()}
    app, lib = "src/app/main.ts", "src/app/lib.ts"
    assert got == {
        (app, "Def"): ("./lib", False, "default", "default", "Def", lib, "src/app/lib/one.tsx", "x", 1),
        (app, "one"): ("./lib", False, "named", "one", "one", lib, lib, "one", 0),
        (app, "zwei"): ("./lib", False, "named", "two", "zwei", lib, "src/app/lib/deep.js", "deep", 2),
        (app, "all"): ("../shared", False, "namespace", "*", "all", "src/shared/index.d.ts", "src/shared/index.d.ts", "*", 0),
        (app, "Shape"): ("../shared/shape", True, "named", "Shape", "Shape", "src/shared/shape.ts", "src/shared/shape.ts", "Shape", 0),
        (app, "deep"): ("./lib/deep.js", False, "named", "deep", "deep", "src/app/lib/deep.js", "src/app/lib/deep.js", "deep", 0),
        (app, "Kind"): ("./lib/deep.js", False, "named", "Kind", "Kind", "src/app/lib/deep.js", "src/app/lib/deep.js", "Kind", 0),
        (app, "React"): ("react", False, "default", "default", "React", None, None, None, None),
        (app, "gone"): ("./nowhere", False, "named", "gone", "gone", None, None, None, None),
        ("src/app/lib/one.tsx", "deep"): ("./deep", False, "named", "deep", "deep", "src/app/lib/deep.js", "src/app/lib/deep.js", "deep", 0),
    }


def test_calls_by_binding_then_by_file(spark):
    files = spark.createDataFrame([("test.ts", "import { validate } from './validator';\nimport * as v from './validator';\nfunction App() {\n  validate(42);\n  return 42;\n}\n"), ("validator.ts", "export function validate(x) {}\n")], SCHEMA)
    calls = spark.createDataFrame([("test.ts", "App", None, "validate"), ("test.ts", "App", "v", "validate"), ("test.ts", "App", "v", "other"), ("test.ts", "App", None, "App"), ("test.ts", "App", "console", "log"), ("test.ts", "App", None, "alert")], "caller_file string, caller string, object string, callee string")
    bindings = m.resolved_bindings(files)
    assert [(r["specifier"], r["local"]) for r in bindings.where("kind = 'named'").collect()] == [("./validator", "validate")]
    symbols = spark.createDataFrame([("test.ts", "App"), ("validator.ts", "validate")], "file string, name string")
    given = m.resolved_exports(files, m.import_bindings(files), m.resolve_modules(m.import_bindings(files), files))
    for told in (None, given):
        got = {(r["object"], r["callee"]): (r["callee_file"], r["callee_symbol"]) for r in m.call_targets(calls, bindings, symbols, told).collect()}
        assert got == {
            (None, "validate"): ("validator.ts", "validate"), ("v", "validate"): ("validator.ts", "validate"), ("v", "other"): ("validator.ts", "other"),
            (None, "App"): ("test.ts", "App"), ("console", "log"): (None, None), (None, "alert"): (None, None),
        }


def test_paths(spark):
    files = [(p, "") for p in ("a.ts", "a.tsx", "a/index.js", "b/index.tsx", "b/index.ts", "c.json", "d.d.ts", "src/a.ts", "src/x/y.mjs", "index.ts")]
    asked = [("src/main.ts", s) for s in ("./a", "../a", "../b", "../b/", "../c", "../d", "./x/../x/y", "./a.ts", "../../a", "./b", "..", ".", "pkg", "/a", "./x/z")]
    got = {r["specifier"]: r["module"] for r in m.resolve_modules(spark.createDataFrame(asked, "file string, specifier string"), spark.createDataFrame(files, SCHEMA)).collect()}
    assert got == {"./a": "src/a.ts", "../a": "a.ts", "../b": "b/index.ts", "../b/": "b/index.ts", "../c": "c.json", "../d": "d.d.ts", "./x/../x/y": "src/x/y.mjs", "./a.ts": "src/a.ts", "./b": "b/index.ts", "..": "index.ts", ".": "index.ts", "/a": "a.ts"}


def test_origins_of_random_exports(spark):
    rng = random.Random(4)
    given = []
    for f in "abcdefgh":
        for n in "uvwxyz":
            kind = rng.randrange(6)
            if kind == 0:
                given.append((f, n, n.upper(), None))
            elif kind < 3:
                given.append((f, n, rng.choice("uvwxyz"), rng.choice("abcdefgh")))
        given += [(f, "*", "*", rng.choice("abcdefgh")) for _ in range(rng.randrange(3))]

    def plain(module, name):
        level, seen = [(module, name)], {(module, name)}
        for hops in range(100):
            own = sorted((f, loc) for f, n in level for g, k, loc, to in given if (g, k) == (f, n) and to is None)
            if own:
                return (*own[0], hops)
            more = set()
            for f, n in level:
                named = [(to, loc) for g, k, loc, to in given if (g, k) == (f, n)]
                more |= set(named or [(to, n) for g, k, _, to in given if (g, k) == (f, "*")])
            level = sorted(more - seen)
            seen |= more
            if not level:
                return None

    asked = [(f, n) for f in "abcdefgh" for n in "uvwxyz"]
    got = {(r["module"], r["name"]): (r["origin_file"], r["origin_name"], r["hops"]) for r in m.origins(spark.createDataFrame(asked, "module string, name string"), spark.createDataFrame(given, "file string, name string, local string, module string")).collect()}
    assert got == {a: p for a in asked if (p := plain(*a))}
    assert 10 < len(got) < 48
