"""Filters of source text that carry state from line to line: comments, skeletons and truncation."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.batches import mapped

#: Comment signs by language: line, block begin, block end, docstring.
SIGNS = {"python": ("#", None, None, '"""'), "rust": ("//", "/*", "*/", None), "typescript": ("//", "/*", "*/", None), "javascript": ("//", "/*", "*/", None), "go": ("//", "/*", "*/", None), "java": ("//", "/*", "*/", None), "shell": ("#", None, None, None)}
KEEP = re.compile(r"^\s*(?:pub|export|import|use|from|fn|def|func|function|class|struct|enum|trait|impl|interface|type|const|let|async|public|private|#\[|@)\b")


def without_comments(text: str, language: str) -> str:
    """The text without comment lines and blocks; data formats (no known signs) stay; at most one blank line in a row."""
    if language not in SIGNS:
        return text
    line_sign, begin, end, doc = SIGNS[language]
    out, block, quoted = [], False, False
    for line in text.split("\n"):
        s = line.strip()
        if block:
            block = end not in s
            continue
        if quoted:
            out.append(line)
            quoted = doc not in s
            continue
        if doc and s.startswith(doc):
            quoted = s.count(doc) == 1
            out.append(line)
            continue
        if begin and s.startswith(begin):
            block = end not in s[len(begin) :]
            continue
        if not s.startswith(line_sign):
            out.append(line)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()


def skeleton(text: str, language: str) -> str:
    """Imports, signatures and the braces around them."""
    out, depth = [], 0
    for line in without_comments(text, language).split("\n"):
        if KEEP.match(line) or (line.strip() in ("}", "{") and depth <= 1):
            out.append(line)
        depth += line.count("{") - line.count("}")
    return "\n".join(out)


def smart_truncate(text: str, max_lines: int) -> str:
    """At most max_lines lines: structural ones first, then the first others; marks count what is left out."""
    lines = text.split("\n")
    if len(lines) <= max_lines:
        return text
    keep = [i for i, x in enumerate(lines) if KEEP.match(x)][:max_lines]
    chosen = set(keep) | set([i for i in range(len(lines)) if i not in set(keep)][: max_lines - len(keep)])
    out, gap = [], 0
    for i, line in enumerate(lines):
        if i in chosen:
            if gap:
                out.append(f"... {gap} lines omitted")
            out.append(line)
            gap = 0
        else:
            gap += 1
    return "\n".join([*out, f"... {gap} lines omitted"] if gap else out)


def applied(text: Column, language: Column, fn=without_comments) -> Column:
    """A filter over a column, in Arrow batches."""

    @F.arrow_udf("string")
    def run(t: pa.Array, lang: pa.Array) -> pa.Array:
        return mapped(lambda a, b: None if a is None else fn(a, b), pa.string(), t, lang)

    return run(text, language)
