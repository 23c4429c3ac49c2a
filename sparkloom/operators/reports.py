"""Reports over symbols, edges and memory: known patterns, agent findings, issue roll-ups, snapshots, impact."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import name_counts

#: Names and words that the known patterns look for.
SINGLETONS = ("db", "prisma", "client", "redis", "supabase", "firebase", "connection", "pool", "cache", "instance", "app")
CRUD = ("create", "find", "get", "update", "delete", "remove", "list", "upsert", "save", "destroy")
FACTORIES = ("create", "build", "make", "new", "generate", "produce")
WRAPPERS = ("with", "enhance", "wrap", "connect")
PUBSUB = ("on", "off", "emit", "addEventListener", "removeEventListener", "subscribe", "unsubscribe")


def _any(column: Column, words, how: str) -> Column:
    return reduce(lambda e, w: e | getattr(column, how)(w), words, F.lit(False))


def known_patterns(functions: DataFrame, least: int = 3) -> DataFrame:
    """(id, confidence, occurrences) of the known patterns that occur often enough. functions: file, name,
    exported, flags (array of guard, async, result, validation), params (array), calls (array). Patterns of single
    functions are counts over rows; patterns of files are counts over files of one row each."""
    name = F.lower("name")
    flag = lambda f: F.array_contains("flags", f)
    has = lambda w: F.exists("params", lambda p: p.contains(w))
    single = {
        "factory": (0.82, 2, _any(name, FACTORIES, "startswith") & F.col("exported") & flag("result")),
        "guard-clause": (0.95, least, flag("guard")),
        "async-await": (0.98, least, flag("async")),
        "result-type": (0.75, least, flag("result")),
        "middleware": (0.87, least, (F.size("params") >= 2) & (has("next") | (has("req") & has("res")))),
        "decorator-hoc": (0.78, least, _any(name, WRAPPERS, "startswith") & F.col("exported")),
        "input-validation": (0.92, least, flag("validation")),
    }
    own = functions.agg(*[F.count_if(c).alias(i) for i, (_, _, c) in single.items()])
    ends = F.when(F.col("exported"), name)
    files = functions.groupBy("file").agg(
        F.max(name.contains("getinstance") | name.contains("get_instance")).alias("instance"),
        F.max(ends.isin(*SINGLETONS)).alias("named"),
        F.count("exported").alias("n"),
        F.count_if(F.col("exported")).alias("exports"),
        F.count_if(F.col("exported") & _any(name, CRUD, "contains")).alias("crud"),
        F.max(name.contains("handler") | name.contains("strategy")).alias("handler"),
        F.size(F.array_intersect(F.array(*[F.lit(w) for w in PUBSUB]), F.flatten(F.collect_set("calls")))).alias("pubsub"),
    )
    whole = {
        "singleton": (0.88, 1, F.col("instance") | F.coalesce("named", F.lit(False))),
        "repository": (0.90, 1, (F.col("exports") >= 2) & (F.col("crud") >= 2)),
        "observer": (0.85, 1, F.col("pubsub") >= 2),
        "strategy": (0.70, least, F.col("handler") | ((F.col("exports") >= 3) & (F.col("n") >= 3))),
    }
    per = files.agg(*[F.count_if(c).alias(i) for i, (_, _, c) in whole.items()])
    rows = lambda df, of: df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("id"), F.lit(c).alias("confidence"), F.col(f"`{i}`").alias("occurrences"), F.lit(k).alias("k")) for i, (c, k, _) in of.items()])).alias("x")).select("x.*")
    return rows(own, single).unionAll(rows(per, whole)).where("occurrences >= k").drop("k")


def barrels(files: DataFrame, least: int = 3) -> DataFrame:
    """(id, confidence, occurrences) of index files that only export. files: file, functions, exports (counts)."""
    index = F.col("file").rlike(r"index\.(ts|js|tsx)$")
    n = files.agg(F.count_if(index & (F.col("functions") == 0) & (F.col("exports") > 0)).alias("occurrences"))
    return n.where(F.col("occurrences") >= least).select(F.lit("barrel-exports").alias("id"), F.lit(0.95).alias("confidence"), "occurrences")


#: Patterns that go with a dependency, as (id, dependency, path expression, flag of the file, confidence).
FRAMEWORKS = (
    ("nextjs-app-router", "next", r"(^|/)app/", None, 0.95),
    ("nextjs-pages-router", "next", r"(^|/)pages/", None, 0.95),
    ("server-components", "next", r"(^|/)app/.*\.(tsx|jsx)$", "jsx", 0.90),
    ("server-actions", "next", r".", "use-server", 0.90),
)


def framework_patterns(files: DataFrame, dependencies: DataFrame, rules=FRAMEWORKS) -> DataFrame:
    """(id, confidence, occurrences) of the rules whose dependency is there and that some file meets.
    files: file, flags (array). dependencies: name."""
    names = dependencies.agg(F.collect_set(F.when(F.col("name").isin(*{d for _, d, _, _, _ in rules}), F.col("name"))).alias("names"))  # at most the rules' names
    met = lambda path, flag: F.col("file").rlike(path) & (F.array_contains("flags", flag) if flag else F.lit(True))
    counts = files.agg(*[F.count_if(met(p, f)).alias(f"c{i}") for i, (_, _, p, f, _) in enumerate(rules)])
    rows = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(c).alias("confidence"), F.col(f"c{n}").alias("occurrences"), F.array_contains("names", d).alias("ok")) for n, (i, d, _, _, c) in enumerate(rules)])
    return counts.join(F.broadcast(names)).select(F.explode(rows).alias("x")).select("x.*").where("ok and occurrences > 0").drop("ok")


def agent_reports(changes: DataFrame) -> DataFrame:
    """(file, agent, severity) of a batch of saved files, by the eight kinds of agent; one of another name reports as generic.
    changes: file, modified, breaking, complexity, findings, tests, confidence."""
    report = lambda name, severity, when=F.lit(True): F.when(when, F.struct(F.lit(name).alias("agent"), severity.alias("severity")))
    all_ = F.array(
        report("observer", F.when(F.col("breaking") > 0, "warning").otherwise("info")),
        report("intent", F.when(F.col("confidence") >= 0.8, "info").otherwise("warning")),
        report("security", F.lit("critical"), F.col("findings") > 0),
        report("complexity", F.lit("warning"), F.col("complexity") > 10),
        report("tests", F.lit("warning"), (F.col("tests") > 0) & ((F.col("breaking") > 0) | (F.col("modified") > 0))),
        report("patterns", F.lit("info")),
        report("documentation", F.lit("warning"), F.col("breaking") > 0),
        report("generic", F.lit("info")),
    )
    return changes.select("file", F.explode(F.array_compact(all_)).alias("r")).select("file", "r.agent", "r.severity")


def is_test_path(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/"))).rlike(r"/test|/spec|\.test\.|\.spec\.")


def test_impact(edges: DataFrame, file: str) -> DataFrame:
    """Direct dependents of a file that look like tests."""
    return edges.where(F.col("dst") == file).select("src").distinct().where(is_test_path(F.col("src")))


def coverage(skeletons: DataFrame, memory: DataFrame, enough: int = 3) -> DataFrame:
    """(file, hits, covered): in how many memory rows (content) a skeleton's path stands, and each of its exports; covered
    means that the skeleton may be cut short. skeletons: file, exports."""
    of = skeletons.select("file", F.explode(F.concat(F.array("file"), "exports")).alias("name")).where("name <> ''")
    zero = F.lit(0).cast("long")
    per_file = of.join(name_counts(of, memory), "name").groupBy("file").agg(F.sum("n").alias("hits"))
    return skeletons.select("file").distinct().join(per_file, "file", "left").select("file", F.coalesce("hits", zero).alias("hits"), (F.coalesce("hits", zero) >= enough).alias("covered"))


def file_map(symbols: DataFrame, edges: DataFrame, files: int = 50, names: int = 20) -> DataFrame:
    """The first files by path with the names of their first symbols and how many files they use and are used by."""
    own = symbols.groupBy("file").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("start", "name"))), 1, names), lambda x: x["name"]), ",").alias("names"))
    few = own.orderBy("file").limit(files)  # the report is of so many files
    outs = edges.groupBy(F.col("src").alias("file")).agg(F.count_distinct("dst").alias("outs"))
    ins = edges.groupBy(F.col("dst").alias("file")).agg(F.count_distinct("src").alias("ins"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return few.join(outs, "file", "left").join(ins, "file", "left").select("file", "names", zero("outs"), zero("ins"))


def skeletons(symbols: DataFrame, edges: DataFrame, types: int = 30, functions: int = 50, links: int = 20) -> DataFrame:
    """By file: its language, its first types and functions by place, exports, files it uses and is used by, the average
    complexity of the functions named, and how many symbols it has."""
    ordered = F.array_sort(F.collect_list(F.struct("start", "kind", "name", "complexity", "exported", "language")))
    of = symbols.groupBy("file").agg(ordered.alias("s"))
    pick = lambda kind, n: F.slice(F.filter("s", lambda x: x["kind"] == kind), 1, n)
    names = lambda xs: F.array_join(F.transform(xs, lambda x: x["name"]), ",")
    kept = pick("function", functions)
    total = F.aggregate(kept, F.lit(0), lambda a, x: a + x["complexity"])
    own = of.select(
        "file", F.get("s", F.lit(0))["language"].alias("language"), names(pick("class", types)).alias("types"), names(kept).alias("functions"), names(F.filter("s", lambda x: x["exported"])).alias("exports"),
        F.when(F.size(kept) > 0, F.round(total / F.size(kept), 6)).alias("avg_complexity"), F.size("s").cast("long").alias("symbols"),
    )
    near = lambda a, b, name: edges.groupBy(F.col(a).alias("file")).agg(F.array_join(F.slice(F.array_sort(F.collect_set(b)), 1, links), ",").alias(name))
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    joined = own.join(near("src", "dst", "uses"), "file", "left").join(near("dst", "src", "used_by"), "file", "left")
    return joined.select("file", "language", "types", "functions", "exports", "avg_complexity", "symbols", empty("uses"), empty("used_by"))


def causal_context(edges: DataFrame) -> DataFrame:
    """By node: sorted callees and callers, each joined by commas."""
    join = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    outs = edges.groupBy(F.col("src").alias("node")).agg(join("dst").alias("calls"))
    ins = edges.groupBy(F.col("dst").alias("node")).agg(join("src").alias("called_by"))
    return outs.join(ins, "node", "full_outer").select("node", F.coalesce("calls", F.lit("")).alias("calls"), F.coalesce("called_by", F.lit("")).alias("called_by"))


def diff_impact(changes: DataFrame) -> DataFrame:
    """(file, risk, severity, kind). changes: file, added, removed, modified, dependents."""
    raw = F.round(0.5 * F.col("removed") + 0.3 * F.col("modified") + F.when(F.col("added") > 0, 0.1).otherwise(0.0), 6)
    none = (F.col("dependents") == 0) & (F.col("added") == 0) & (F.col("removed") == 0)
    risk = F.when(none, F.lit(0.0)).otherwise(raw)
    severity = F.when(risk >= 1.0, "critical").when(risk >= 0.7, "high").when(risk >= 0.4, "medium").when(risk > 0, "low").otherwise("none")
    kind = F.when(F.col("removed") > 0, "removed").when(F.col("added") > 0, "added").otherwise("modified")
    return changes.select("file", F.least(risk, F.lit(1.0)).alias("risk"), severity.alias("severity"), kind.alias("kind"))


def known_issues(deleted: DataFrame, reports: DataFrame, cap: int = 40) -> DataFrame:
    """(kind, subject): at most 10 deleted files and the warnings among the last 64 reports, cap rows in all.
    deleted: file, seq. reports: seq, subject, severity."""
    a = deleted.orderBy(F.desc("seq")).limit(10).select(F.lit("deleted").alias("kind"), F.col("file").alias("subject"), F.lit(0).alias("o"), "seq")
    b = reports.orderBy(F.desc("seq")).limit(64).where("severity <> 'info'").select(F.lit("report").alias("kind"), "subject", F.lit(1).alias("o"), "seq")
    return a.unionAll(b).orderBy("o", F.desc("seq")).limit(cap).select("kind", "subject")


def tag_counts(rows: DataFrame) -> DataFrame:
    """By tag: rows and bytes of content."""
    return rows.select(F.explode("tags").alias("tag"), F.octet_length("content").alias("b")).groupBy("tag").agg(F.count("*").alias("n"), F.sum("b").alias("bytes"))


def hot_files(per_file: DataFrame, few: int = 30, fan_in: int = 3) -> DataFrame:
    """Files that get rows for each symbol: all while there are few, else those of enough fan-in. per_file: file, fan_in."""
    n = per_file.agg(F.count("*").alias("n"))
    return per_file.join(F.broadcast(n), (F.col("n") <= few) | (F.col("fan_in") >= fan_in)).select("file")


def missing_keys(rows: DataFrame, required: list[str]) -> DataFrame:
    """Required keys that no row has."""
    spark = rows.sparkSession
    return spark.createDataFrame([(k,) for k in required], "key string").join(rows.select("key").distinct(), "key", "left_anti")


def top_bodies(symbols: DataFrame, k: int = 2) -> DataFrame:
    """By file the names of its k most complex symbols."""
    top = F.slice(F.sort_array(F.collect_list(F.struct("complexity", "name")), asc=False), 1, k)
    return symbols.groupBy("file").agg(F.array_join(F.transform(top, lambda x: x["name"]), ",").alias("names"))


#: Fields that each stored key needs, and what secrets look like there.
REQUIRED = {"identity": ("name", "purpose"), "session_state": ("last_updated",)}
LISTS = ("session_log", "decisions", "known_issues")
SECRETS = (r"sk[-_][a-zA-Z0-9]{20,}", r"ghp_[a-zA-Z0-9]{36}", r"-----BEGIN (RSA |EC )?PRIVATE KEY", r"""(?i)password\s*[:=]\s*["'][^"']+["']""", r"Bearer\s+[a-zA-Z0-9\-._~+/]+=*", r"AKIA[0-9A-Z]{16}")


def write_errors(rows: DataFrame, max_bytes: int = 51200) -> DataFrame:
    """(key, errors) of values to be stored. rows: key, value (JSON text)."""
    v = F.col("value")
    json_ok = F.try_parse_json(v).isNotNull()
    need = [F.when((F.col("key") == k) & F.coalesce(F.get_json_object(v, f"$.{f}"), F.lit("")).isin("", "null"), F.lit(f"{k}.{f} is required")) for k, fs in REQUIRED.items() for f in fs]
    shape = F.when(F.col("key").isin(*LISTS) & ~F.ltrim(v).startswith("["), F.lit("must be an array"))
    secret = F.when(_any(v, SECRETS, "rlike"), F.lit("secret"))
    found = F.when(~json_ok, F.array_compact(F.array(F.when(F.octet_length(v) > max_bytes, F.lit("too large")), F.lit("not JSON")))).otherwise(
        F.array_compact(F.array(F.when(F.octet_length(v) > max_bytes, F.lit("too large")), *need, shape, secret))
    )
    return rows.select("key", F.array_join(found, ";").alias("errors"))


def overflow(items: Column, total: Column, most: int, label: str) -> Column:
    """Items joined by commas, the rest counted."""
    shown = F.array_join(F.slice(items, 1, most), ", ")
    return F.when(total > most, F.concat(shown, F.lit(", +"), (total - most).cast("string"), F.lit(f" more {label}"))).otherwise(shown)


def tail(text: Column, n: int) -> Column:
    lines = F.split(F.regexp_replace(text, r"\n\z", ""), "\n")
    return F.array_join(F.slice(lines, F.greatest(F.size(lines) - n + 1, F.lit(1)), F.lit(n)), "\n")


def skeleton_text(symbols: DataFrame) -> DataFrame:
    """By file a compact text: its path, then a line for each symbol in order."""
    line = lambda x: F.concat(x["kind"], F.lit(" "), x["name"], F.lit(" cx"), x["complexity"].cast("string"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("start", "kind", "name", "complexity"))), line)
    return symbols.groupBy("file").agg(F.concat_ws("\n", F.concat(F.lit("path: "), F.first("file")), F.array_join(rows, "\n")).alias("text"))
