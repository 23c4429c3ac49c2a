"""Declarative rules over symbols: pattern tags, file categories, architecture and error style.

A rule file's rows become column expressions of one pass over symbols grouped by file, in rule order; custom
rules stand before built-in ones. symbols: file, name, kind, language, body, complexity, exported, tags, start.
"""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    id: str
    value: str
    paths: tuple[str, ...] = ()
    names: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    exported: bool | None = None
    any_tags: tuple[str, ...] = ()
    all_tags: tuple[str, ...] = ()


API = (r"(^|/)(api)(/|$)", r"route\.(ts|tsx|js|jsx|rs|py|go|java)$")
#: Built-in category rules, in order of trial.
CATEGORIES = (
    Rule("builtin-api-surface", "api-surface", API),
    Rule("builtin-api-surface-pattern", "api-surface", any_tags=("api-route",)),
    Rule("builtin-server-actions", "server-actions", (r"(^|/)(actions)(/|$)",)),
    Rule("builtin-server-actions-pattern", "server-actions", any_tags=("server-actions",)),
    Rule("builtin-ui-components", "ui-components", (r"(^|/)(components)(/|$)",)),
    Rule("builtin-ui-components-pattern", "ui-components", any_tags=("component-driven", "react-hook")),
    Rule("builtin-domain-services", "domain-services", (r"(^|/)(services|repositories|adapters|facades)(/|$)",)),
    Rule("builtin-domain-services-pattern", "domain-services", any_tags=("repository", "service", "adapter", "facade")),
    Rule("builtin-tests", "tests", (r"(^|/)(tests?|spec)(/|$)", r"\.(test|spec)\.[^.]+$")),
    Rule("builtin-tests-pattern", "tests", any_tags=("tests",)),
    Rule("builtin-shared-library", "shared-library", (r"(^|/)(lib|shared)(/|$)",)),
)
#: Built-in pattern rules.
PATTERNS = (
    Rule("builtin-api-route-pattern", "api-route", API, (r"^(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)$",), kinds=("function",), exported=True),
    Rule("builtin-repository-pattern", "repository", (r"(^|/)(repository|repositories)(/|\.|$)",), (r"(?i)repository",)),
    Rule("builtin-service-pattern", "service", (r"(^|/)(service|services)(/|\.|$)",), (r"(?i)service",)),
    Rule("builtin-adapter-pattern", "adapter", (r"(^|/)(adapter|adapters)(/|\.|$)",), (r"(?i)adapter",)),
    Rule("builtin-facade-pattern", "facade", (r"(^|/)(facade|facades)(/|\.|$)",), (r"(?i)facade",)),
    Rule("builtin-edge-guards-pattern", "edge-guards", (r"(^|/)(middleware|webhook|webhooks)(/|\.|$)",)),
)


def _match(text: Column, patterns: tuple[str, ...]) -> Column:
    """Any of the patterns; one that is no valid expression is a substring."""

    def one(p: str) -> Column:
        try:
            re.compile(p)
            return text.rlike(p)
        except re.error:
            return text.contains(p)

    return reduce(lambda e, p: e | one(p), patterns, F.lit(False))


def matches(rule: Rule) -> Column:
    """Whether a file's row (path, symbols, signals) meets all clauses of a rule; an empty clause is met."""
    s = F.col("symbols")
    clauses = [F.lit(True)]
    if rule.paths:
        clauses.append(_match(F.col("path"), rule.paths))
    if rule.names:
        clauses.append(F.exists(s, lambda x: _match(x["name"], rule.names)))
    if rule.languages:
        clauses.append(F.exists(s, lambda x: F.lower(x["language"]).isin(*[v.lower() for v in rule.languages])))
    if rule.kinds:
        clauses.append(F.exists(s, lambda x: F.lower(x["kind"]).isin(*[v.lower() for v in rule.kinds])))
    if rule.exported is not None:
        clauses.append(F.exists(s, lambda x: x["exported"] == F.lit(rule.exported)))
    if rule.any_tags:
        clauses.append(F.arrays_overlap("signals", F.array(*[F.lit(t) for t in rule.any_tags])))
    if rule.all_tags:
        clauses.append(F.size(F.array_except(F.array(*[F.lit(t) for t in rule.all_tags]), "signals")) == 0)
    return reduce(lambda a, b: a & b, clauses)


def files_of(symbols: DataFrame, patterns=PATTERNS) -> DataFrame:
    """A row for each file: symbols in order, path, and signals (sorted tags of symbols and rules)."""
    g = symbols.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("start", "name", "kind", "language", "complexity", "exported", "tags"))).alias("symbols"))
    g = g.withColumn("path", F.lower(F.regexp_replace(F.replace("file", F.lit("\\"), F.lit("/")), r"^(\./)+", ""))).withColumn("signals", F.array().cast("array<string>"))
    own = F.flatten(F.transform("symbols", lambda x: F.coalesce(x["tags"], F.array().cast("array<string>"))))
    by_rule = F.array_compact(F.array(*[F.when(matches(r), F.lit(r.value)) for r in patterns]))
    return g.withColumn("signals", F.array_sort(F.array_distinct(F.concat(own, by_rule))))


def is_test() -> Column:
    return F.col("path").contains("/tests/") | F.col("path").contains(".test.") | F.col("path").contains(".spec.") | F.exists("symbols", lambda x: F.array_contains(x["tags"], "tests") | x["name"].startswith("test_"))


def categorized(files: DataFrame, rules=CATEGORIES) -> DataFrame:
    """Files with the first category that fits, and what is left: tests, shared library, application logic."""
    rest = F.when(is_test(), "tests").when(F.exists("symbols", lambda x: x["exported"]), "shared-library").otherwise("application-logic")
    return files.withColumn("category", F.coalesce(*[F.when(matches(r), F.lit(r.value)) for r in rules], rest))


def fingerprints(files: DataFrame) -> DataFrame:
    """By file: total complexity and exports, or else the first five names."""
    names = F.transform(F.filter("symbols", lambda x: x["exported"]), lambda x: x["name"])
    some = F.when(F.size(names) > 0, names).otherwise(F.slice(F.transform("symbols", lambda x: x["name"]), 1, 5))
    return files.select("file", F.aggregate(F.transform("symbols", lambda x: x["complexity"]), F.lit(0).cast("long"), lambda a, x: a + x).alias("complexity"), F.array_join(some, ",").alias("exports"))


TYPED = r"\.(ts|tsx|rs|go|java|cs|kt|swift)$"


def project_summary(files: DataFrame) -> DataFrame:
    """One row: files, functions, complexity score, shares of typed files and of tests."""
    n = F.size("symbols")
    cx = F.aggregate(F.transform("symbols", lambda x: x["complexity"]), F.lit(0).cast("long"), lambda a, x: a + x)
    g = files.agg(F.count("*").alias("files"), F.sum(n).alias("functions"), F.sum(cx).alias("cx"), F.count_if(F.col("path").rlike(TYPED)).alias("typed"), F.count_if(is_test()).alias("tests"))
    share = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(F.lit(0.0)), 6)
    return g.select("files", "functions", F.least(share(F.col("cx"), F.col("functions") * 12), F.lit(1.0)).alias("complexity_score"), share(F.col("typed"), F.col("files")).alias("type_coverage"), share(F.col("tests"), F.col("files")).alias("test_share"))


def languages(files: DataFrame) -> DataFrame:
    return files.groupBy(F.coalesce(F.get(F.transform("symbols", lambda x: x["language"]), F.lit(0)), F.lit("unknown")).alias("language")).agg(F.count("*").alias("files"))


@dataclass(frozen=True)
class Architecture:
    name: str
    categories: tuple[tuple[str, int], ...] = ()
    patterns: tuple[tuple[str, int], ...] = ()
    min_depth: int | None = None
    dense: bool | None = None


#: Built-in architectures, in order of trial (the first also asks for each kind of category).
ARCHITECTURES = (Architecture("server-first/modular-monolith", (("api-surface", 1), ("server-actions", 1), ("ui-components", 1), ("domain-services", 1))),)


def architecture(categorized_files: DataFrame, depth: int, dense: bool, rules=ARCHITECTURES, otherwise: str = "modular-monolith") -> DataFrame:
    """One row: the first architecture whose counts of categories and patterns, depth and density are met."""
    need = {(c, "category") for r in rules for c, _ in r.categories} | {(p, "pattern") for r in rules for p, _ in r.patterns}
    names = {k: f"c{i}" for i, k in enumerate(sorted(need))}
    count = lambda v, kind: F.count_if(F.col("category") == v) if kind == "category" else F.count_if(F.array_contains("signals", v))
    g = categorized_files.agg(F.count("*").alias("n"), *[count(*k).alias(a) for k, a in names.items()])
    out = F.lit(otherwise)
    for r in reversed(rules):
        ok = reduce(lambda e, c: e & c, [F.col(names[v, k]) >= max(m, 1) for k, vs in (("category", r.categories), ("pattern", r.patterns)) for v, m in vs], F.lit((r.min_depth is None or depth >= r.min_depth) and (r.dense is None or dense == r.dense)))
        out = F.when(ok, F.lit(r.name)).otherwise(out)
    return g.select(out.alias("architecture"))


def dominant_style(bodies: DataFrame, rules: list[tuple[str, list[str], int]], otherwise: str = "mixed") -> DataFrame:
    """One row: the label whose patterns match most often and at least its minimum; of equal ones the first.
    rules: (label, patterns, minimum). bodies: body."""
    sums = bodies.agg(*[F.sum(sum((F.regexp_count("body", F.lit(p)) for p in ps), F.lit(0))).alias(f"s{i}") for i, (_, ps, _) in enumerate(rules)])
    ok = [F.when(F.col(f"s{i}") >= m, F.col(f"s{i}")).otherwise(F.lit(-1)) for i, (_, _, m) in enumerate(rules)]
    best = F.greatest(*ok) if len(ok) > 1 else ok[0]
    label = F.lit(otherwise)
    for c, (name, _, _) in reversed(list(zip(ok, rules))):
        label = F.when((c == best) & (best >= 0), F.lit(name)).otherwise(label)
    return sums.select(label.alias("style"))


def load_rules(text: str, table: str, value: str) -> tuple[Rule, ...]:
    """Rules of a TOML table, to stand before the built-in ones."""
    made = []
    for r in tomllib.loads(text).get(table, []):
        made.append(
            Rule(r["id"], r[value], tuple(r.get("path_patterns", ())), tuple(r.get("name_patterns", ())), tuple(r.get("languages", ())), tuple(r.get("entity_kinds", ())), r.get("require_exported"), tuple(r.get("requires_any_patterns", ())), tuple(r.get("requires_all_patterns", ())))
        )
    return tuple(made)


@dataclass(frozen=True)
class Decision:
    id: str
    kind: str
    trigger: str
    pattern: str | None
    title: str


def decisions(signals: DataFrame, rules: list[Decision]) -> DataFrame:
    """(signal, rule, title) of all rules that a signal meets: equal kind and trigger, and the pattern in its
    subject; a pattern that is no valid expression counts as met. signals: signal, kind, trigger, subject."""

    def ok(r: Decision) -> Column:
        base = (F.col("kind") == r.kind) & (F.lower("trigger") == r.trigger.lower())
        try:
            re.compile(r.pattern or "")
        except re.error:
            return base
        return base & F.col("subject").rlike(r.pattern) if r.pattern else base

    hit = F.array_compact(F.array(*[F.when(ok(r), F.struct(F.lit(r.id).alias("rule"), F.replace(F.lit(r.title), F.lit("{name}"), F.col("subject")).alias("title"))) for r in rules]))
    return signals.select("signal", F.explode(hit).alias("h")).select("signal", "h.rule", "h.title")


#: Wordings of commit messages that record a decision, in order of trial.
COMMIT_WORDINGS = (
    r"use\s+(\w+)\s+(?:for|as|in)\s+(.+)", r"introduce\s+(\w+)\s+(?:for|as|in)\s+(.+)", r"adopt\s+(\w+)\s+(?:for|as|in)\s+(.+)",
    r"switch\s+to\s+(\w+)\s+(?:for|as|in)\s*(.*)", r"migrate\s+(?:to\s+)?(\w+)\s*(.*)",
)


def commit_decisions(commits: DataFrame) -> DataFrame:
    """(commit, tool, purpose) of the first wording that a message holds. commits: commit, message."""
    part = lambda i: F.coalesce(*[F.when(F.col("message").rlike(p), F.regexp_extract("message", p, i)) for p in COMMIT_WORDINGS])
    return commits.select("commit", part(1).alias("tool"), part(2).alias("purpose")).where("tool is not null")
