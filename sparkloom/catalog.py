"""All queries over the supplied tables, with their DuckDB equivalents."""

from __future__ import annotations

from .plans import code, configs, facts, frameworks, graphs, layered, life, memory, modules, reports, requests, selection, textindexes, texts, upkeep

MODULES = [facts, graphs, life, memory, texts, selection, code, modules, textindexes, layered, requests, upkeep, reports, frameworks, configs]


def queries() -> dict:
    return {name: run for m in MODULES for name, (run, _) in m.PLANS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.PLANS.items() if sql}
