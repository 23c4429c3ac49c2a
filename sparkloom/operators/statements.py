"""Kinds of statements and bodies of source text in the C family: what a function begins with, and what it does.

Text is cut into statements at semicolons and blocks of depth 0. Strings and comments are blanked first, so their signs
don't count.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame

#: What validation and logging calls look like.
VALIDATION = (".parse(", ".safeParse(", ".validate(", "z.object", "z.string", "z.number", "z.array", "z.enum", "Joi.", "yup.", ".validateSync(")
LOGGING = ("console.log", "console.error", "console.warn", "console.info", "logger.", "log.info", "log.error", "log.warn", "log.debug")

_QUIET = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_WORD = re.compile(r"[A-Za-z_]\w*")
_BLOCK = re.compile(r"\s*(if|for|while|do|switch|try|async function|function|class)\b|\s*\{")
#: What continues a block that begins with a word.
GOES_ON = {"if": "else", "try": "catch|finally", "do": "while"}
_LEAVES = re.compile(r"\b(return|throw)\b")
BY_WORD = {"return": "return", "throw": "throw", "try": "try", "for": "loop", "while": "loop", "do": "loop", "switch": "switch", "yield": "yield", "await": "await"}


def statements(body: str) -> list[str]:
    """The statements of a body, in order."""
    quiet = _QUIET.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), body)
    out, depth, start = [], 0, 0
    for i, c in enumerate(quiet):
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        block = c == "}" and _BLOCK.match(quiet, start)
        whole = depth == 0 and (c == ";" or block and not re.match(rf"\s*(?:{GOES_ON.get(block[1], '$^')})\b", quiet[i + 1 : i + 20]))
        if whole:
            out.append((start, i + 1))
            start = i + 1
    return [body[a:b].strip() for a, b in [*out, (start, len(body))] if quiet[a:b].strip(" \t\r\n;")]  # not comments alone


def statement_kind(statement: str) -> str:
    word = (m := _WORD.match(statement)) and m[0]
    if word == "if":
        inside = statement.split(")", 1)[-1].split("else", 1)[0]
        return "guard" if _LEAVES.search(inside) else "if"
    if word in BY_WORD:
        return BY_WORD[word]
    if word in ("const", "let", "var"):
        return "declare-await" if "await " in statement else "destructure" if "= {" in statement or "= [" in statement else "declare"
    if re.match(r"[\w.\[\]]+\s*(=|\+=|-=|\*=|/=)(?!=)", statement):
        return "assign"
    if re.match(r"[\w.]+\s*\(", statement):
        return "validate" if any(x in statement for x in VALIDATION) else "log" if any(x in statement for x in LOGGING) else "call"
    return "expr"


def body_flags(body: str) -> list[str]:
    """Which of guard, validation, logging and result a body has."""
    parts = statements(body)
    found = {
        "guard": bool(parts) and statement_kind(parts[0]) == "guard",
        "validation": any(x in body for x in VALIDATION),
        "logging": any(x in body for x in LOGGING),
        "result": any(p.startswith("return") and "{" in p and re.search("success|data|error", p) for p in parts),
    }
    return [k for k, v in found.items() if v]


def classified(bodies: DataFrame, most: int = 3) -> DataFrame:
    """(id, prefix, flags) of bodies (id, body): kinds of the first statements, and the body's flags, joined."""

    def run(parts):
        for pdf in parts:
            own = [statements(b or "") for b in pdf["body"]]
            yield pd.DataFrame({"id": pdf["id"], "prefix": [">".join(map(statement_kind, s[:most])) for s in own], "flags": [",".join(body_flags(b or "")) for b in pdf["body"]]})

    return bodies.select("id", "body").mapInPandas(run, "id long, prefix string, flags string")
