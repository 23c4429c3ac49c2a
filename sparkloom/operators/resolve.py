"""Modules of script workspaces: imports and exports as tables, module paths by joins, re-exports to a fixpoint.

Texts are cut into statements by column expressions. A specifier meets files on one key (its path without dots), because
each file stands under every key that leads to it: its path, its path less an extension, its folder if it is an index; so no
list of candidate paths is ever exploded. Names that a module only passes on are followed round by round: a round joins
what is still open with the exports of the modules it stands at, and drops what was there before (cycles).
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cut import cut_lineage

#: Extensions in the order in which they are tried.
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".json", ".d.ts")

NAME = r"[A-Za-z_$][\w$]*"
QUOTED = r"""["']([^"'\n]*)["']"""
#: A path whose segments begin with no dot; possessive, so that a long one takes no stack.
PLAIN = r"[^./][^/]*+(?:/[^./][^/]*+)*+"
#: A clause can go over lines but not over a statement's end or into the next one.
CLAUSE = r"""[^;"'()=]*?"""
IMPORT = rf"(?m)^[ \t]*import\s+(type\s+)?({CLAUSE})\s*from\s*{QUOTED}"
PASSED_ON = rf"(?m)^[ \t]*export\s+(type\s+)?({CLAUSE})\s*from\s*{QUOTED}"
LISTED = r"(?m)^[ \t]*export\s+(?:type\s+)?\{([^}]*)\}\s*(?:;|$)"
DECLARED = rf"(?m)^[ \t]*export\s+(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:function\s*\*?|class|const|let|var|interface|type|enum)\s+({NAME})"
DEFAULT = rf"(?m)^[ \t]*export\s+default\b[ \t]*(?:async\s+)?(?:(?:function\s*\*?|class)\s*)?({NAME})?"


def _statements(text: Column, pattern: str) -> Column:
    """Groups of every match, as structs (type_only, clause, specifier)."""
    all_of = lambda i: F.regexp_extract_all(text, F.lit(pattern), F.lit(i))
    return F.arrays_zip(all_of(1).alias("type_only"), all_of(2).alias("clause"), all_of(3).alias("specifier"))


def _named(inside: Column) -> Column:
    """Structs (imported, local) of what stands between braces."""
    parts = F.filter(F.transform(F.split(inside, ","), lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"\s+", " ")), "^type ", "")), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(F.regexp_extract(x, r"^(\S+)", 1).alias("imported"), F.regexp_extract(x, r"(\S+)$", 1).alias("local")))


def _bindings(text: Column) -> Column:
    """Structs (specifier, type_only, kind, imported, local) of a text's imported names."""

    def of(s: Column) -> Column:
        clause = s["clause"]
        one = lambda kind, imported, local: F.struct(s["specifier"].alias("specifier"), (s["type_only"] != "").alias("type_only"), F.lit(kind).alias("kind"), imported.alias("imported"), local.alias("local"))
        default = one("default", F.lit("default"), F.regexp_extract(clause, rf"^\s*({NAME})", 1))
        space = one("namespace", F.lit("*"), F.regexp_extract(clause, rf"\*\s*as\s+({NAME})", 1))
        named = F.transform(_named(F.regexp_extract(clause, r"\{([^}]*)\}", 1)), lambda x: one("named", x["imported"], x["local"]))
        return F.concat(F.filter(F.array(default, space), lambda x: x["local"] != ""), named)

    return F.flatten(F.transform(_statements(text, IMPORT), of))


BOUND = ("specifier", "type_only", "kind", "imported", "local")


def parsed(files: DataFrame) -> DataFrame:
    """(file, bound, given) of files (file, text), as a table: all that the functions below read of texts, which are read once.
    They take it in place of files."""
    if "given" in files.columns:
        return files
    text = F.coalesce("text", F.lit(""))
    return cut_lineage(files.select("file", _bindings(text).alias("bound"), _exports(text).alias("given")))


def import_bindings(files: DataFrame) -> DataFrame:
    """(file, specifier, type_only, kind, imported, local) of files (file, text): kind named, default or namespace; imports
    without names are no bindings."""
    return parsed(files).select("file", F.explode("bound").alias("b")).select("file", *[f"b.{c}" for c in BOUND])


def exported_bindings(files: DataFrame) -> DataFrame:
    """import_bindings() of names that their file also gives out as its own, which few are; found within each file."""
    own = F.transform(F.filter("given", lambda x: x["specifier"].isNull()), lambda x: x["local"])
    both = parsed(files).select("file", F.col("bound").alias("b"), own.alias("own")).withColumn("own", F.array_intersect("own", F.transform("b", lambda x: x["local"]))).where(F.size("own") > 0)
    return both.select("file", "own", F.explode("b").alias("b")).where(F.array_contains("own", F.col("b.local"))).select("file", *[f"b.{c}" for c in BOUND])


def _exports(text: Column) -> Column:
    """Structs (name, local, specifier) of what a text gives out."""
    word = lambda p: F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda x: F.struct(x.alias("name"), x.alias("local"), F.lit(None).cast("string").alias("specifier")))
    default = F.transform(F.regexp_extract_all(text, F.lit(DEFAULT), F.lit(1)), lambda x: F.struct(F.lit("default").alias("name"), F.when(x == "", "default").otherwise(x).alias("local"), F.lit(None).cast("string").alias("specifier")))
    listed = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(LISTED), F.lit(1)), lambda c: F.transform(_named(c), lambda x: F.struct(x["local"].alias("name"), x["imported"].alias("local"), F.lit(None).cast("string").alias("specifier")))))

    def passed(s):
        space = F.regexp_extract(s["clause"], rf"^\s*\*\s*as\s+({NAME})", 1)
        braces = F.transform(_named(F.regexp_extract(s["clause"], r"\{([^}]*)\}", 1)), lambda x: F.struct(x["local"].alias("name"), x["imported"].alias("local"), s["specifier"].alias("specifier")))
        star = F.array(F.struct(F.when(space != "", space).otherwise("*").alias("name"), F.lit("*").alias("local"), s["specifier"].alias("specifier")))
        return F.when(s["clause"].rlike(r"^\s*\*"), star).otherwise(braces)

    on = F.flatten(F.transform(_statements(text, PASSED_ON), passed))
    return F.array_distinct(F.concat(word(DECLARED), default, listed, on))


def exports(files: DataFrame) -> DataFrame:
    """(file, name, local, specifier): a name that a file gives out, and what it stands for: a symbol `local` of the file
    itself, or of the module `specifier`; name * passes on all but default."""
    each = parsed(files).select("file", F.explode("given").alias("e"))
    return each.select("file", "e.name", "e.local", "e.specifier").distinct()


def without_dots(path: Column) -> Column:
    """A path less . and empty segments, each .. with the segment before it; null where that leads above the root."""

    def step(done: Column, part: Column) -> Column:
        back = F.when(F.size(done) > 0, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))  # null from then on
        return F.when(part.isin("", "."), done).when(part == "..", back).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def _keys(files: DataFrame) -> DataFrame:
    """(key, rank, module): every key under which a file is found, and how late it is tried."""
    stem = lambda ext: F.left("file", F.length("file") - len(ext))
    keys = [F.struct(F.col("file").alias("key"), F.lit(0).alias("rank"))]
    for i, ext in enumerate(EXTENSIONS):
        has = F.col("file").endswith(ext)
        keys.append(F.when(has, F.struct(stem(ext).alias("key"), F.lit(1 + i).alias("rank"))))
        folder = F.regexp_extract(stem(ext), r"^(?:(.*)/)?index$", 1)
        keys.append(F.when(has & stem(ext).rlike("(^|/)index$"), F.struct(folder.alias("key"), F.lit(1 + len(EXTENSIONS) + i).alias("rank"))))
    return files.select("file").distinct().select(F.explode(F.array_compact(F.array(*keys))).alias("k"), F.col("file").alias("module")).select("k.key", "k.rank", "module")


def _with_keys(asked: DataFrame) -> DataFrame:
    """asked (file, specifier) with key and key2: where a specifier leads relative to the file's folder, and failing that from the
    workspace's root. Both are '' for names of packages; key2 is where there is one way."""
    relative = F.col("specifier").rlike(r"^\.{1,2}(/|$)")
    # Mostly dots only stand before a specifier's names and none in the folder's; then ups are cut off the folder's end. What several
    # columns need is a column first, so that it is found once a row.
    cols = {"_folder": F.regexp_extract("file", r"^(?:(.*)/)?[^/]*$", 1), "_rest": F.regexp_replace("specifier", r"^(?:\./)?(?:\.\./)*+", ""), "_relative": relative}
    folder, rest, ups, depth = (F.col(c) for c in ("_folder", "_rest", "_ups", "_depth"))
    more = {
        "_plain": F.col("_relative") & F.col("specifier").rlike(rf"^(?:\./)?(?:\.\./)*+{PLAIN}\z") & folder.rlike(rf"^{PLAIN}\z"),
        "_ups": F.floor((F.length("specifier") - F.length(rest)) / 3).cast("int"), "_depth": F.length(folder) - F.length(F.replace(folder, F.lit("/"), F.lit(""))) + 1,
    }
    plain, relative = F.col("_plain"), F.col("_relative")
    up = F.when(ups < depth, F.concat(F.call_function("substring_index", folder, F.lit("/"), depth - ups), F.lit("/"), rest)).when(ups == depth, rest)
    near = F.when(plain, up).when(relative, without_dots(F.concat(folder, F.lit("/"), "specifier")))
    root = F.when(plain, F.when(ups == 0, rest)).when(relative | F.col("specifier").startswith("/"), without_dots(F.col("specifier")))
    # A key is kept after a slash, so that the root's own, which is empty, is one.
    key = lambda c: F.coalesce(F.concat(F.lit("/"), c), F.lit(""))
    led = asked.withColumns(cols).withColumns(more).withColumns({"_near": near, "_root": root})
    keys = {"key": key(F.coalesce("_near", "_root")), "key2": key(F.when(F.col("_near").isNotNull(), F.col("_root")))}
    return led.withColumns(keys).drop(*cols, *more, "_near", "_root")


def _modules(keys: DataFrame, files: DataFrame) -> DataFrame:
    """(key, key2, module) of pairs of keys that lead to a file."""
    best = _keys(files).groupBy("key").agg(F.min_by("module", "rank").alias("module")).select(F.concat(F.lit("/"), "key").alias("key"), "module")
    ways = keys.select("key", "key2").distinct().select("key", "key2", F.explode(F.array(F.struct(F.lit(0).alias("base"), F.col("key").alias("at")), F.struct(F.lit(1).alias("base"), F.col("key2").alias("at")))).alias("w")).where("w.at <> ''")
    return ways.select("key", "key2", "w.base", F.col("w.at").alias("at")).join(best.withColumnRenamed("key", "at"), "at").groupBy("key", "key2").agg(F.min_by("module", "base").alias("module"))


def resolve_modules(asked: DataFrame, files: DataFrame) -> DataFrame:
    """(file, specifier, module) for pairs (file, specifier): relative to the file's folder, else to the workspace's root. Names of
    packages and what no file answers to have no row."""
    want = _with_keys(asked.select("file", "specifier").distinct()).where("key <> ''")
    return want.join(_modules(want, files), ["key", "key2"]).select("file", "specifier", "module")


def origins(asked: DataFrame, given: DataFrame) -> DataFrame:
    """(module, name, origin_file, origin_name, hops) for pairs (module, name): the file that a name is defined in, by way
    of the modules that pass it on. given: (file, name, local, module) where module is null for a file's own symbols. Of several
    ways the shortest, then the least file and name. A name that leads in a circle or to nothing has no row."""
    given = cut_lineage(given)
    steps = given.where("module is null or name <> '*'").select(F.col("file").alias("at"), F.col("name").alias("as"), F.col("module").alias("to"), F.col("local").alias("then"), F.lit(True).alias("hit")).distinct()
    star = given.where("module is not null and name = '*'").select(F.col("file").alias("_at"), F.col("module").alias("_to")).distinct()
    # Places (at, as) of the pairs that are open, by the round that first came there; done: an origin, and then the only places of its pair.
    rows = cut_lineage(asked.select("module", "name").distinct().select("module", "name", F.col("module").alias("at"), F.col("name").alias("as"), F.lit(False).alias("done"), F.lit(0).alias("round")))
    pair, found = Window.partitionBy("module", "name"), None
    for hops in itertools.count():
        here = rows.where(~F.col("done") & (F.col("round") == hops))
        if here.isEmpty() and found is not None:
            break
        whole, hit = F.col("as") == "*", F.col("hit").isNotNull()
        met = here.join(steps, ["at", "as"], "left").join(star, (F.col("at") == F.col("_at")) & F.col("hit").isNull() & ~F.col("as").isin("*", "default"), "left")
        to = lambda done, at, name: F.struct(F.lit(done).alias("done"), F.col(at).alias("at"), name.alias("as"))
        ways = F.array(
            F.when(hit & F.col("to").isNull(), to(True, "at", F.col("then"))),
            F.when(whole, to(True, "at", F.lit("*"))),  # a whole module that is passed on under a name is its own origin
            F.when(~whole & F.col("to").isNotNull(), to(False, "to", F.col("then"))),
            F.when(F.col("_to").isNotNull(), to(False, "_to", F.col("as"))),
        )
        moved = met.select("module", "name", F.explode(F.array_compact(ways)).alias("w")).select("module", "name", "w.at", "w.as", "w.done", F.lit(hops + 1).alias("round"))
        # What was there before keeps its round; a pair goes on that has no origin and came to a new place.
        each = moved.union(rows.where(~F.col("done"))).repartition("module", "name").groupBy("module", "name", "at", "as", "done").agg(F.min("round").alias("round"))
        each = each.withColumns({"_done": F.max("done").over(pair), "_last": F.max("round").over(pair)})
        rows = cut_lineage(each.where(F.col("done") | (~F.col("_done") & (F.col("_last") == hops + 1))).drop("_done", "_last"))
        got = rows.where("done").select("module", "name", F.col("at").alias("origin_file"), F.col("as").alias("origin_name"), F.lit(hops).alias("hops"))
        found = got if found is None else found.unionByName(got)
    least = F.min(F.struct("hops", "origin_file", "origin_name")).alias("o")
    return found.groupBy("module", "name").agg(least).select("module", "name", "o.origin_file", "o.origin_name", F.col("o.hops").cast("long").alias("hops"))


def resolved_exports(files: DataFrame, bindings: DataFrame | None = None, modules: DataFrame | None = None) -> DataFrame:
    """(file, name, local, module): exports() with modules in place of specifiers; a file's own export of an imported name passes that on.
    Only bindings of names that their file gives out matter, and the modules (file, specifier, module) of these and of exports."""
    files = parsed(files)
    given, bound = cut_lineage(exports(files)), cut_lineage(exported_bindings(files)) if bindings is None else bindings
    if modules is None:
        modules = cut_lineage(resolve_modules(given.where("specifier is not null").select("file", "specifier").union(bound.select("file", "specifier")), files))
    told = given.where("specifier is not null").join(modules, ["file", "specifier"]).select("file", "name", "local", "module")
    of = bound.join(modules, ["file", "specifier"]).select("file", "local", "imported", F.col("module").alias("of"))
    mine = given.where("specifier is null").join(of, ["file", "local"], "left")
    return told.union(mine.select("file", "name", F.coalesce("imported", "local").alias("local"), F.col("of").alias("module")))


def resolved_bindings(files: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """Per imported name of files (file, text): the module it comes from, and the file and name it is defined by (null where
    the module is not in the workspace, or gives out no such name). A namespace is defined by its module.

    What bindings ask for is resolved once for each pair of a key and a name, and bindings meet it by one join. given is
    resolved_exports(files), where it is known."""
    files = parsed(files)
    bindings = cut_lineage(_with_keys(import_bindings(files)))
    asked = cut_lineage(bindings.where("key <> ''").select("key", "key2", "imported").distinct())
    modules = cut_lineage(_modules(asked, files))
    named = cut_lineage(asked.join(modules, ["key", "key2"]))
    defined = origins(named.select("module", F.col("imported").alias("name")), resolved_exports(files) if given is None else given).withColumnRenamed("name", "imported")
    known = named.join(defined, ["module", "imported"], "left")
    return bindings.join(known, ["key", "key2", "imported"], "left").select("file", "specifier", "type_only", "kind", "imported", "local", "module", "origin_file", "origin_name", "hops")


def call_targets(calls: DataFrame, bindings: DataFrame, symbols: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """Calls (caller_file, caller, object, callee) with callee_file and the symbol there: a plain name by its binding, else by
    a symbol of its own file; a member of a bound object by the object's module, or where given (as in origins) tells,
    by the file that defines it. Others have none."""
    plain, member = F.col("object").isNull(), F.col("object").isNotNull()
    what = ("module", "kind", "imported", "origin_file", "origin_name")
    b = bindings.where("module is not null").select(F.col("file").alias("caller_file"), F.col("local").alias("_bound"), *what, F.lit(False).alias("_own"))
    # A file's own symbols stand among its bindings: a name that is none of these calls them.
    own = symbols.select(F.col("file").alias("caller_file"), F.col("name").alias("_bound"), *[F.lit(None).cast("string").alias(c) for c in what], F.lit(True).alias("_own"))
    names = b.unionByName(own).groupBy("caller_file", "_bound").agg(F.min_by(F.struct(*what, "_own"), "_own").alias("b"), F.max("_own").alias("_has"))
    out = calls.withColumn("_bound", F.coalesce("object", "callee")).join(names, ["caller_file", "_bound"], "left").select("caller_file", "caller", "object", "callee", *[f"b.{c}" for c in what], "_has")
    none = {"_file": F.lit(None).cast("string"), "_name": F.lit(None).cast("string")}
    if given is not None:
        out = cut_lineage(out)
        asks = member & F.coalesce(F.col("kind") == "namespace", F.lit(False))
        told = origins(out.where(asks).select("module", F.col("callee").alias("name")), given).select("module", F.col("name").alias("callee"), F.col("origin_file").alias("_file"), F.col("origin_name").alias("_name"))
        out = out.where(asks).join(told, ["module", "callee"], "left").unionByName(out.where(~asks).withColumns(none))
    else:
        out = out.withColumns(none)
    bound = F.col("module").isNotNull()
    file = F.when(plain & bound, F.coalesce("origin_file", "module")).when(member & bound, F.coalesce("_file", "module")).when(plain & F.col("_has"), F.col("caller_file"))
    name = F.when(plain & bound, F.coalesce("origin_name", F.when(F.col("kind") == "namespace", F.col("callee")).otherwise(F.col("imported")))).when(member & bound, F.coalesce("_name", "callee")).when(plain & F.col("_has"), F.col("callee"))
    return out.select("caller_file", "caller", "object", "callee", file.alias("callee_file"), name.alias("callee_symbol"))
