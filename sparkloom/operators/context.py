"""Budgeted selection of sections: ranking, knapsack, greedy fills and layered resolution.

Folds that depend on what was taken before run by group in pandas; a group is one request's sections.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def boosted(base: Column, betweenness: Column, pagerank: Column) -> Column:
    """Priority of a section with its file's graph scores, at most 100 where boosted."""
    boost = F.round(15 * (0.7 * betweenness + 0.3 * pagerank)).cast("int")
    return F.when(boost > 0, F.least(base + boost, F.lit(100))).otherwise(base)


#: Priority of a section by its kind.
BASES = {"active-context": 100, "causal-chain": 95, "code-skeleton": 72, "skeleton-fsi": 85, "skeleton-fusi": 78, "history": 70, "rules": 55}
ACTIVE_CODE = 95


def base_priority(kind: Column, active: Column) -> Column:
    """Priority of a kind of section; code of the active file is above other code."""
    base = F.element_at(F.create_map(*[F.lit(x) for kv in BASES.items() for x in kv]), kind)
    return F.when((kind == "code-skeleton") & active, F.lit(ACTIVE_CODE)).otherwise(base)


def ranked(sections: DataFrame) -> DataFrame:
    """Sections in order: priority falling, tokens rising, then ordinal."""
    return sections.orderBy("request", F.desc("priority"), "tokens", "ordinal")


def knapsack_of(tokens: list[int], priorities: list[int], budget: int) -> list[int]:
    """Places of the sections that a budget holds at the greatest value, 100 x priority + 1 each. An item enters
    only if it betters the value strictly; the walk back starts from the last."""
    values = [100 * p + 1 for p in priorities]
    best = np.zeros(budget + 1, np.int64)
    taken: list[np.ndarray | None] = []  # a bit for each capacity
    for t, v in zip(tokens, values):
        if t > budget:
            taken.append(None)
            continue
        with_ = np.full(budget + 1, -1, np.int64)
        with_[t:] = best[: budget + 1 - t] + v
        taken.append(np.packbits(with_ > best))
        best = np.maximum(best, with_)
    out, cap = [], budget
    for i in range(len(tokens) - 1, -1, -1):
        bits = taken[i]
        if bits is not None and bits[cap >> 3] >> (7 - (cap & 7)) & 1:
            out.append(i)
            cap -= tokens[i]
    return out[::-1]


def knapsack(sections: DataFrame, budget: int) -> DataFrame:
    """The chosen sections of each request. sections: request, ordinal, priority, tokens.

    Of a request's sections of one size only the first budget / size by priority and ordinal can be chosen, since a later one
    never betters a set that leaves out one before it; sections of no tokens are chosen as they are. So a task holds at most
    budget x (1 + ln budget) sections of a request, of budget / 8 bytes each, however many it has."""

    def pick(t: pa.Table) -> pa.Table:
        t = t.sort_by([("priority", "descending"), ("tokens", "ascending"), ("ordinal", "ascending")])
        chosen = knapsack_of(t.column("tokens").to_pylist(), t.column("priority").to_pylist(), budget)
        return t.take(pa.array(chosen, pa.int64()))

    own = sections.select("request", "ordinal", "priority", "tokens")
    place = F.row_number().over(Window.partitionBy("request", "tokens").orderBy(F.desc("priority"), "ordinal"))
    some = own.where((F.col("tokens") > 0) & (F.col("tokens") <= budget)).withColumn("_r", place).where(F.col("_r") <= budget).where(F.col("_r") * F.col("tokens") <= budget).drop("_r")
    return some.groupBy("request").applyInArrow(pick, own.schema).unionByName(own.where("tokens = 0 and priority >= 0"))


def greedy(sections: DataFrame, budget: int, order: list[str], distinct: str | None = None) -> DataFrame:
    """Sections taken in order while they fit; one that does not is skipped and the fill goes on. With distinct, a
    value is taken once."""

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        left, keep, seen = budget, [], set()
        for t, d in zip(pdf["tokens"], pdf[distinct] if distinct else pdf["tokens"]):
            ok = t <= left and not (distinct and d in seen)
            keep.append(ok)
            if ok:
                left -= t
                seen.add(d)
        return pdf[keep]

    return sections.groupBy("request").applyInPandas(fill, sections.schema)


#: Headings of an assembled prompt, in order, and the kinds of section below each.
HEADINGS = (
    ("Active Context", ("active-context",)),
    ("Call Graph (Causal Chain)", ("causal-chain",)),
    ("Code Structure", ("code-skeleton", "skeleton-fsi", "skeleton-fusi")),
    ("Recent Development Activity", ("history",)),
    ("Project Rules & Conventions", ("rules",)),
)


def assembled(sections: DataFrame, prompts: DataFrame) -> DataFrame:
    """(request, text): by request a heading for each group of kinds that has sections, these in order of priority, and the
    prompt last. sections: request, ordinal, kind, priority, content. prompts: request, prompt."""
    place = {k: i for i, (_, kinds) in enumerate(HEADINGS) for k in kinds}
    at = F.element_at(F.create_map(*[F.lit(x) for kv in place.items() for x in kv]), F.col("kind"))
    own = sections.withColumn("_o", at).where("_o is not null")
    blocks = own.groupBy("request", "_o").agg(F.array_sort(F.collect_list(F.struct((-F.col("priority")).alias("p"), "ordinal", "content"))).alias("s"), F.count("*").alias("n"))
    title = F.get(F.array(*[F.lit(h) for h, _ in HEADINGS]), F.col("_o"))
    block = F.concat(F.lit("### "), title, F.lit("\n"), F.array_join(F.transform("s", lambda x: x["content"]), "\n"))
    text = blocks.groupBy("request").agg(F.sum("n").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("b"))
    head = F.concat(F.lit("STRUCTURAL CONTEXT: "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" sections"), F.coalesce(F.concat(F.lit("\n\n"), "b"), F.lit("")))
    return prompts.join(text, "request", "left").select("request", F.concat(head, F.lit("\n\n### Request\n"), "prompt").alias("text"))


#: The keys of each pack.
PACKS = {
    "small": ("identity", "session_state", "patterns", "intent"),
    "standard": ("identity", "session_state", "patterns", "decisions", "known_issues", "tasks", "file_map", "intent", "dna", "changes"),
    "deep": ("identity", "session_state", "patterns", "decisions", "known_issues", "tasks", "file_map", "session_log", "intent", "dna", "changes", "git"),
}


def prompt_packs(values: DataFrame, packs: dict = PACKS) -> DataFrame:
    """(request, variant, text, included, missing) for each request and variant: what the request has of the variant's keys, in
    their order. values: request, key, value."""
    rows = F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(i).alias("o"), F.lit(k).alias("key")) for v, ks in packs.items() for i, k in enumerate(ks)])
    one = values.groupBy("request", "key").agg(F.min("value").alias("value"))
    asked = one.select("request").distinct().select("request", F.explode(rows).alias("w")).select("request", "w.*")
    got = asked.join(one, ["request", "key"], "left").groupBy("request", "variant").agg(F.array_sort(F.collect_list(F.struct("o", "key", "value"))).alias("s"))
    have, lack = F.filter("s", lambda x: x["value"].isNotNull()), F.filter("s", lambda x: x["value"].isNull())
    text = F.array_join(F.transform(have, lambda x: F.concat(F.lit("## "), x["key"], F.lit("\n\n"), x["value"])), "\n\n")
    return got.select("request", "variant", text.alias("text"), F.size(have).cast("long").alias("included"), F.array_join(F.transform(lack, lambda x: x["key"]), ",").alias("missing"))


def char_budget(parts: list[str], budget: int, dots: str = "...") -> list[str]:
    """Sections within a budget of characters: the first that does not fit is cut, later ones that do not are left out."""
    out, left, cut = [], budget, False
    for p in parts:
        if len(p) <= left:
            out.append(p)
            left -= len(p)
        elif not cut and left > len(dots):
            out.append(p[: left - len(dots)] + dots)
            left, cut = 0, True
    return out


def exported(sections: DataFrame, budget: int, dots: str = "...") -> DataFrame:
    """(request, text, used): by request its sections in order of ordinal while their characters fit the budget; the first that does
    not is cut to what is left, ending in dots, and nothing but empty sections follows. sections: request, ordinal, content."""
    size = F.char_length
    start = F.struct(F.lit(budget).alias("left"), F.lit(False).alias("cut"), F.array().cast("array<string>").alias("out"))

    def step(a, x):
        fits, room = size(x["content"]) <= a["left"], ~a["cut"] & (a["left"] > len(dots))
        part = F.when(fits, x["content"]).when(room, F.concat(F.left(x["content"], a["left"] - len(dots)), F.lit(dots)))
        left = F.when(fits, a["left"] - size(x["content"])).when(room, 0).otherwise(a["left"]).cast("int")
        return F.struct(left.alias("left"), (a["cut"] | (~fits & room)).alias("cut"), F.when(part.isNotNull(), F.concat(a["out"], F.array(part))).otherwise(a["out"]).alias("out"))

    rows = sections.where("content is not null").groupBy("request").agg(F.sort_array(F.collect_list(F.struct("ordinal", "content"))).alias("s"))
    done = rows.select("request", F.aggregate("s", start, step).alias("a"))
    return done.select("request", F.array_join("a.out", "\n").alias("text"), (budget - F.col("a.left")).cast("long").alias("used"))


def merge_values(base, overlay):
    """Deep merge: objects by key, lists as ordered unions, scalars by the overlay."""
    if isinstance(base, dict) and isinstance(overlay, dict):
        return {**base, **{k: merge_values(base[k], v) if k in base else v for k, v in overlay.items()}}
    if isinstance(base, list) and isinstance(overlay, list):
        return base + [x for i, x in enumerate(overlay) if x not in base and x not in overlay[:i]]
    return overlay


def parse_or_text(content: str):
    try:
        return json.loads(content)
    except (TypeError, ValueError):
        return content


def merged_layers(layers: DataFrame) -> DataFrame:
    """For each id its layers' JSON contents merged, the layer of greatest ordinal first beneath. layers: id, ordinal, content."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        values = [parse_or_text(c) for c in pdf.sort_values("ordinal", ascending=False)["content"]]
        out = values[0]
        for v in values[1:]:
            out = merge_values(out, v)
        return pd.DataFrame({"id": [pdf["id"].iloc[0]], "content": [json.dumps(out, sort_keys=True)]})

    return layers.groupBy("id").applyInPandas(fold, "id string, content string")


def first_hit(layers: DataFrame) -> DataFrame:
    """For each id the content of its first layer."""
    return layers.groupBy("id").agg(F.min_by("content", "ordinal").alias("content"))


def resolve_layers(layers: list[dict], path: str) -> dict:
    """Layers by falling priority, those whose path is a prefix: merge adds, override replaces, extend prepends.
    Conflicts are counted in merges only."""
    out = {"patterns": [], "decisions": [], "rules": [], "issues": [], "file_map": {}}
    seen = {"patterns": set(), "decisions": set()}
    conflicts, used = 0, []
    for layer in sorted(layers, key=lambda x: -x["priority"]):
        if not path.startswith(layer["path"]):
            continue
        used.append(layer["name"])
        if layer["mode"] == "override":
            out = {k: (dict(layer[k]) if k == "file_map" else list(layer[k])) for k in out}
            seen = {k: set(out[k]) for k in seen}
            continue
        for k in ("patterns", "decisions", "rules", "issues"):
            if layer["mode"] == "extend":
                out[k] = [*layer[k], *out[k]]
            elif k in seen:
                for v in layer[k]:
                    if v in seen[k]:
                        conflicts += 1
                    else:
                        seen[k].add(v)
                        out[k].append(v)
            else:
                out[k] += layer[k]
        out["file_map"] |= layer["file_map"]
    return out | {"layers": used, "conflicts": conflicts}
