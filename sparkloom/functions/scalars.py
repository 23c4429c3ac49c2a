"""Scalar functions as column expressions: paths, ids, names, tokens, sizes and text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Leading verbs of identifiers, in order of trial.
VERBS = (
    "create", "build", "make", "get", "fetch", "find", "list", "update", "set", "patch", "delete", "remove", "destroy", "handle", "on", "use", "with", "is", "has", "can", "validate", "check",
    "parse", "transform", "map", "convert", "render", "draw", "show", "hide", "toggle", "init", "setup", "configure", "register", "subscribe", "send", "emit", "dispatch", "trigger", "notify",
)

#: File extensions by language.
EXTENSIONS = {
    "typescript": ("ts", "tsx"),
    "javascript": ("js", "jsx", "mjs", "cjs"),
    "rust": ("rs",),
    "python": ("py",),
    "go": ("go",),
    "java": ("java",),
    "cpp": ("cpp", "cc", "cxx", "c", "h", "hpp"),
    "csharp": ("cs",),
    "ruby": ("rb",),
    "swift": ("swift",),
    "kotlin": ("kt", "kts"),
    "php": ("php",),
}
LANGUAGES = {e: name for name, es in EXTENSIONS.items() for e in es}

#: Syntax node kinds by the kind of entity they stand for.
NODE_KINDS = {
    "function": ("function_declaration", "method_definition", "function_item", "function_definition", "function_definition_item", "method_declaration", "arrow_function", "function_expression"),
    "class": ("class_declaration", "class_definition", "class_specifier", "struct_item", "struct_specifier"),
    "interface": ("interface_declaration", "trait_item"),
    "type": ("enum_item", "type_spec", "impl_item"),
}

#: Directories that hold generated files.
GENERATED = ("node_modules/", "/target/", "/dist/", "/build/", "__pycache__/", ".git/", "/vendor/", "/coverage/")


def normalize_path(p: Column) -> Column:
    return F.regexp_replace(F.replace(p, F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def file_id(p: Column) -> Column:
    return F.concat(F.lit("fsi::"), normalize_path(p))


def symbol_id(p: Column, symbol: Column, kind: Column) -> Column:
    safe = F.regexp_replace(F.replace(symbol, F.lit("::"), F.lit("_")), r"\s+", "_")
    return F.concat(F.lit("fusi::"), normalize_path(p), F.lit("::"), safe, F.lit("::"), kind)


def extension(p: Column) -> Column:
    return F.lower(F.regexp_extract(p, r"\.([A-Za-z0-9]+)$", 1))


def language(p: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.element_at(known, F.nullif(extension(p), F.lit(""))), F.lit("unknown"))


def entity_kind(kind: Column) -> Column:
    """The kind of entity of a syntax node, or the node's own."""
    return reduce(lambda e, kv: F.when(kind.isin(*kv[1]), F.lit(kv[0])).otherwise(e), NODE_KINDS.items(), kind)


def signature_head(body: Column) -> Column:
    return F.trim(F.get(F.split(F.trim(F.get(F.split(body, "\n"), F.lit(0))), r"\{"), F.lit(0)))


def line_count(body: Column) -> Column:
    """Lines, a last line end not opening one; at least 1."""
    return F.greatest(F.size(F.split(F.regexp_replace(body, r"\n$", ""), "\n")), F.lit(1))


def token_estimate(text: Column) -> Column:
    return F.floor(F.octet_length(text) / 4).cast("long")


def token_ratio(text: Column, tokens: Column) -> Column:
    """Bytes for each token; 0 without tokens."""
    return F.when(tokens > 0, F.octet_length(text) / tokens).otherwise(F.lit(0.0))


def verb(name: Column) -> Column:
    """The leading verb of a name, or its first word."""
    low = F.lower(name)
    first = F.lower(F.regexp_extract(name, r"^(.[^A-Z]*)", 1))
    return reduce(lambda e, v: F.when(low.startswith(v), F.lit(v)).otherwise(e), reversed(VERBS), first)


def slug(text: Column, size: int = 40) -> Column:
    return F.left(F.regexp_replace(F.lower(text), r"[^a-z0-9]", "_"), F.lit(size))


def truncated(text: Column, size: int) -> Column:
    """At most size characters, the last three dots where some went."""
    return F.when(F.length(text) <= size, text).otherwise(F.lit("...") if size < 3 else F.concat(F.left(text, F.lit(size - 3)), F.lit("...")))


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, r"\x1b\[[0-9;?]*[a-zA-Z]|\x1b\][^\x07]*\x07|\x1b[()][A-Z0-9]", "")


def one_decimal(x: Column) -> Column:
    """A double from 1 to 2^49 with one decimal, rounded by its exact binary value, ties to even, as C's %.1f does (Java's rounds its
    shortest decimal form, ties up). What stands behind the point is a whole number of 2^-52."""
    whole = F.floor(x).cast("long")
    tens = ((x - whole) * float(2**52)).cast("long") * 10
    tenth = F.shiftright(tens, 52)
    rest = tens - F.shiftleft(tenth, 52)
    up = (rest > 2**51) | ((rest == 2**51) & (tenth % 2 == 1))
    t = whole * 10 + tenth + up.cast("long")
    return F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"))


def format_tokens(n: Column) -> Column:
    return F.when(n >= 1_000_000, F.concat(one_decimal(n / 1e6), F.lit("M"))).when(n >= 1000, F.concat(one_decimal(n / 1e3), F.lit("K"))).otherwise(n.cast("string"))


def format_usd(x: Column) -> Column:
    return F.when(x >= 0.01, F.format_string("$%.2f", x)).otherwise(F.format_string("$%.4f", x))


def human_bytes(n: Column) -> Column:
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        out = F.when(n >= 1024**power, F.concat(one_decimal(n / float(1024**power)), F.lit(f" {unit}"))).otherwise(out)
    return out


def cooldown_ms(text: Column) -> Column:
    """Milliseconds of '500ms', '2 s' or 'every 5 minutes'; 0 where neither is met."""
    t = F.lower(F.trim(text))
    short, unit = F.regexp_extract(t, r"^(\d+)(ms|s|m|h)$", 1), F.regexp_extract(t, r"^(\d+)(ms|s|m|h)$", 2)
    every, word = F.regexp_extract(t, r"every\s+(\d+)\s+(second|minute|hour)", 1), F.regexp_extract(t, r"every\s+(\d+)\s+(second|minute|hour)", 2)
    by = lambda u, pairs: reduce(lambda e, p: F.when(u == p[0], F.lit(p[1])).otherwise(e), pairs, F.lit(0))
    a = F.nullif(short, F.lit("")).cast("long") * by(unit, [("ms", 1), ("s", 1000), ("m", 60_000), ("h", 3_600_000)])
    b = F.nullif(every, F.lit("")).cast("long") * by(word, [("second", 1000), ("minute", 60_000), ("hour", 3_600_000)])
    return F.coalesce(a, b, F.lit(0)).cast("long")


def generated(p: Column) -> Column:
    return reduce(lambda e, g: e | p.contains(g), GENERATED, F.lit(False))


def filled(template: Column, values: dict[str, Column]) -> Column:
    """A template with each {name} replaced."""
    return reduce(lambda e, kv: F.replace(e, F.lit("{" + kv[0] + "}"), F.coalesce(kv[1], F.lit(""))), values.items(), template)


def session_score(contradictions: Column, reverted: Column) -> tuple[Column, Column]:
    """Compliance and penalty."""
    return F.greatest(100 - 15 * contradictions - 5 * reverted, F.lit(0)), F.least(20 * contradictions + 10 * reverted, F.lit(255))


def terms(query: str) -> list[str]:
    """Words of at least three bytes, lower-cased and stripped of signs at their ends."""
    import re

    return [w for w in (re.sub(r"^[^\w]+|[^\w]+$", "", x.lower()) for x in query.split() if len(x.encode()) >= 3) if w]


def keyword_score(query: str, content: Column) -> Column:
    """Share of the query's words (three bytes or more) that the content holds."""
    words = [w for w in query.lower().split() if len(w.encode()) >= 3]
    if not words:
        return F.lit(0.0)
    low = F.lower(content)
    return sum((low.contains(w).cast("int") for w in words), F.lit(0)) / float(len(words))


def query_boost(query: str, content: Column) -> Column:
    """0 to 10 by the share of the query's terms that the content holds."""
    words = terms(query)
    if not words:
        return F.lit(0)
    low = F.lower(content)
    return F.least(F.round(sum((low.contains(w).cast("int") for w in words), F.lit(0)) * 10.0 / len(words)), F.lit(10)).cast("int")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 where a vector has no length."""
    na, nb = dot(a, a), dot(b, b)
    return F.when((na <= 1.1920929e-07) | (nb <= 1.1920929e-07), F.lit(0.0)).otherwise(dot(a, b) / (F.sqrt(na) * F.sqrt(nb)))
