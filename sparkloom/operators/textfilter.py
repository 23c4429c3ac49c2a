"""Declarative filters for terminal output: eight fixed stages per filter, all as array expressions.

Stages: strip colour codes; replace (first match of a line); short-circuit message; strip or else keep lines;
cut long lines; head or else tail; most lines; message for nothing left.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import strip_ansi, token_estimate


@dataclass(frozen=True)
class Filter:
    name: str
    command: str
    strip: tuple[str, ...] = ()
    keep: tuple[str, ...] = ()
    replace: tuple[tuple[str, str], ...] = ()
    short: tuple[str, str, str | None] | None = None  # pattern, message, unless
    max_chars: int | None = None
    head: int | None = None
    tail: int | None = None
    max_lines: int | None = None
    on_empty: str | None = None
    ansi: bool = field(default=True)


EMPTY = ("^$",)
#: The built-in filters.
BUILTIN = (
    Filter("git-status", r"^git\s+status", ("^On branch", "^Your branch is", "nothing to commit", "working tree clean"), max_lines=30, on_empty="git: clean"),
    Filter("git-log", r"^git\s+log", max_lines=20),
    Filter("git-diff", r"^git\s+diff", (r"^index [a-f0-9]+\.{2}", "^diff --git", "^--- a/", r"^\+\+\+ b/"), max_lines=100),
    Filter("git-add", r"^git\s+add", EMPTY, max_lines=5, on_empty="git add: ok"),
    Filter("git-commit", r"^git\s+commit", (r"^\[", r"^\s*$", "^create mode"), max_lines=10),
    Filter("git-push", r"^git\s+push", max_lines=10),
    Filter("git-pull", r"^git\s+pull", (r"^Updating [a-f0-9]+\.{2}", "^Fast-forward"), max_lines=15),
    Filter("npm-install", r"^npm\s+(i|install|ci)", ("^$", "^npm WARN", "up to date", "added", "removed"), max_lines=5, on_empty="npm install: ok"),
    Filter("yarn-install", r"^yarn(\s+install)?", EMPTY, max_lines=5, on_empty="yarn: ok"),
    Filter("pnpm-install", r"^pnpm\s+install", EMPTY, max_lines=5, on_empty="pnpm: ok"),
    Filter("pip-install", r"^pip(3)?\s+install", ("^Collecting", "^  Using cached", "^Downloading", "Successfully installed"), max_lines=10, on_empty="pip: ok"),
    Filter("cargo-build", r"^cargo\s+(build|check|clippy)", ("^   Compiling", "^    Checking", "^    Finished", "^     Running"), max_lines=30),
    Filter("cargo-test", r"^cargo\s+test", (r"^running \d+ tests", "^test result:", "^$"), ("FAILED", "error", "panic"), max_lines=30, on_empty="cargo test: passed"),
    Filter("cargo-update", r"^cargo\s+update", EMPTY, max_lines=20),
    Filter("eslint", r"^eslint|^npx\s+eslint", EMPTY, max_lines=50, on_empty="eslint: ok"),
    Filter("prettier", r"^prettier|^npx\s+prettier", EMPTY, max_lines=5, on_empty="prettier: ok"),
    Filter("ruff", r"^ruff\s+(check|format)", EMPTY, max_lines=30, on_empty="ruff: ok"),
    Filter("biome", r"^biome\b", (r"^\s*$", r"^Checked \d+ file", r"^Fixed \d+ file"), max_lines=50, on_empty="biome: ok"),
    Filter("shellcheck", "^shellcheck", EMPTY, max_lines=30),
    Filter("turbo", r"^turbo|^npx\s+turbo", (r"^\s*$", "^ELAPSED", "^─"), max_lines=30),
    Filter("nx", r"^nx\s+(build|test|lint)", EMPTY, max_lines=30),
    Filter("make", "^make", EMPTY, max_lines=50),
    Filter("webpack", r"^webpack|^npx\s+webpack", EMPTY, max_lines=20),
    Filter("vite", r"^vite\s+build|^npx\s+vite\s+build", EMPTY, max_lines=20),
    Filter("docker-ps", r"^docker\s+ps", ("^CONTAINER ID",), max_lines=20),
    Filter("docker-build", r"^docker\s+build", (r"^Step \d+/", r"^#\d+", "^$"), max_lines=20),
    Filter("docker-compose", r"^docker-compose|^docker\s+compose", EMPTY, max_lines=30),
    Filter("jest", r"^jest|^npx\s+jest", ("^PASS", "^$", r"^\s*\^+"), max_lines=50, on_empty="jest: passed"),
    Filter("pytest", "^pytest", ("^=+$", "^-+$", "^$", "^PASSED", "^test session starts"), ("FAILED", "ERROR", "failed"), max_lines=30, on_empty="pytest: passed"),
    Filter("vitest", r"^vitest|^npx\s+vitest", EMPTY, max_lines=50, on_empty="vitest: passed"),
    Filter("ls", "^ls", max_lines=50),
    Filter("tree", "^tree", max_lines=30),
    Filter("find", "^find", max_lines=50),
    Filter("ripgrep", r"^rg\s|^ripgrep", max_lines=50),
    Filter("grep", "^grep", max_lines=50),
    Filter("df", "^df", ("^Filesystem",), max_lines=10),
    Filter("du", "^du", max_lines=20),
    Filter("ps", "^ps", (r"^\s*PID",), max_lines=20),
    Filter("terraform-plan", r"^terraform\s+plan", ("^$", r"^\s*$", "No changes"), max_lines=50),
    Filter("terraform-apply", r"^terraform\s+apply", EMPTY, max_lines=30),
    Filter("helm", "^helm", EMPTY, max_lines=30),
    Filter("kubectl", "^kubectl", EMPTY, max_lines=30),
)


def filter_name(command: Column, filters=BUILTIN) -> Column:
    """The first filter by name whose pattern the command matches."""
    return F.coalesce(*[F.when(command.rlike(f.command), F.lit(f.name)) for f in sorted(filters, key=lambda f: f.name)])


def _any(line: Column, patterns) -> Column:
    """Whether one of the patterns is met: in one pass, unless a pattern refers to its groups by number."""
    if not patterns or any(re.search(r"\\[1-9]", p) for p in patterns):
        return reduce(lambda e, p: e | line.rlike(p), patterns, F.lit(False))
    return line.rlike("|".join(f"(?:{p})" for p in patterns))


def lines_of(text: Column) -> Column:
    """Lines, a last line end not opening one."""
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"\n\z", ""), "\n"))


def applied(f: Filter, text: Column) -> Column:
    """The text after the stages of a filter."""
    text = strip_ansi(text) if f.ansi else text
    lines = lines_of(text)
    for pattern, new in f.replace:
        lines = F.transform(lines, _first_replaced(pattern, new))
    if f.strip:
        lines = F.filter(lines, lambda x: ~_any(x, f.strip))
    elif f.keep:
        lines = F.filter(lines, lambda x: _any(x, f.keep))
    if f.max_chars:
        lines = F.transform(lines, lambda x: F.left(x, F.lit(f.max_chars)))
    if f.head:
        lines = F.slice(lines, 1, f.head)
    elif f.tail:
        lines = F.slice(lines, F.greatest(F.size(lines) - f.tail + 1, F.lit(1)), F.lit(f.tail))
    if f.max_lines:
        lines = F.slice(lines, 1, f.max_lines)
    out = F.array_join(lines, "\n")
    if f.on_empty is not None:
        out = F.when(F.length(F.trim(out)) == 0, F.lit(f.on_empty)).otherwise(out)
    if f.short:
        pattern, message, unless = f.short
        hit = text.rlike(pattern)
        out = F.when(hit & ~text.rlike(unless) if unless else hit, F.lit(message)).otherwise(out)
    return out


def filtered(command: Column, text: Column, filters=BUILTIN) -> Column:
    """The text after the stages of the first filter by name that fits the command; unchanged where none does."""
    return F.coalesce(*[F.when(command.rlike(f.command), applied(f, text)) for f in sorted(filters, key=lambda f: f.name)], text)


def _first_replaced(pattern: str, new: str):
    """Replaces the first match in a line; the rest of the line keeps its other matches."""
    after = re.compile(pattern).groups + 1
    return lambda x: F.when(x.rlike(pattern), F.concat(F.regexp_extract(x, f"^(.*?)(?:{pattern})", 1), F.lit(new), F.regexp_extract(x, f"^.*?(?:{pattern})(.*)$", after))).otherwise(x)


def savings(rows: DataFrame, raw: str, filtered: str) -> DataFrame:
    """Tokens before and after, saved, and the share saved."""
    a, b = token_estimate(F.col(raw)), token_estimate(F.col(filtered))
    return rows.withColumns({"raw_tokens": a, "filtered_tokens": b}).withColumns({
        "saved": F.greatest(F.col("raw_tokens") - F.col("filtered_tokens"), F.lit(0)),
        "saved_percent": F.round(F.when(F.col("raw_tokens") > 0, (F.col("raw_tokens") - F.col("filtered_tokens")) * 100.0 / F.col("raw_tokens")).otherwise(F.lit(0.0)), 6),
    })


#: Task words that pruning keeps lines by.
TASK_WORDS = {
    "new_feature": ("pattern", "architecture", "memory", "auto-save", "agent"),
    "bug_fix": ("warning", "issue", "debug", "safety", "agent"),
    "refactor": ("dependency", "decision", "pattern", "architecture", "agent"),
    "code_review": ("pattern", "convention", "warning", "safety", "agent"),
    "unknown": ("memory", "pattern", "agent"),
}


def pruned(text: Column, task: str, query: list[str]) -> Column:
    """Lines that hold a task word or a query term, at most 80; if none, the first 30 without a query, else nothing."""
    words = [*TASK_WORDS[task], *query]
    lines = lines_of(text)
    got = F.filter(lines, lambda x: reduce(lambda e, w: e | F.lower(x).contains(w), words, F.lit(False)))
    return F.array_join(F.when(F.size(got) > 0, F.slice(got, 1, 80)).otherwise(F.slice(lines, 1, 0 if query else 30)), "\n")


#: The command classifier's patterns, in order of trial.
IGNORED = (r"\|", "&&", ";", ">", "<<", r"^\s*(vim|nano|emacs|less|more|man|top|htop|btop)\s", r"^\s*code\s", r"^\s*cursor\s")
DENIED = (r"rm\s+-rf\s+/(\s|$)", r"rm\s+-rf\s+~", r"dd\s+if=.*of=/dev/", r"mkfs\.", r">\s*/dev/sd", r"curl.*\|\s*(sudo\s+)?bash", r"wget.*\|\s*(sudo\s+)?bash")
ASK = (r"git\s+push\s+(-f|--force)", r"git\s+reset\s+--hard", r"DROP\s+TABLE", r"DELETE\s+FROM")
ENV_PREFIX = r"^(?:sudo\s+|env\s+|[A-Z_][A-Z0-9_]*=\S+\s+)+"
#: Categories by first word.
CATEGORIES = {
    "Git": ("git",),
    "Rust": ("cargo", "rustc", "rustup"),
    "Node.js": ("npm", "yarn", "pnpm", "node"),
    "Python": ("pip", "poetry", "uv", "python", "pytest"),
    "Infra": ("docker", "kubectl", "helm", "terraform"),
    "Build": ("make", "cmake", "gradle", "mvn"),
    "Files": ("ls", "find", "grep", "rg", "fd", "tree"),
    "Network": ("curl", "wget", "http", "ssh", "scp"),
    "GitHub": ("gh", "glab", "bitbucket"),
}


def classified(command: Column) -> tuple[Column, Column]:
    """Class (ignored, denied, ask, supported, unsupported) and category of a command."""
    c = F.trim(command)
    clean = F.trim(F.regexp_replace(c, ENV_PREFIX, ""))
    first = F.get(F.split(clean, r"\s+"), F.lit(0))
    kind = (
        F.when(F.length(c) == 0, "ignored").when(_any(c, IGNORED), "ignored").when(_any(c, DENIED), "denied").when(_any(c, ASK), "ask").when(_any(clean, [f.command for f in BUILTIN]), "supported").otherwise("unsupported")
    )
    category = reduce(lambda e, kv: F.when(first.isin(*kv[1]), F.lit(kv[0])).otherwise(e), reversed(CATEGORIES.items()), F.lit("Other"))
    return kind, category
