"""The queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from . import bwt_dedup, fm_index, lsh_forest, ordinal, pii, quality_rules, sharding, sp_sample, substring_chain, threshold_search, token_align, url_filter, warc


def queries() -> dict:
    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_warc": warc.op2_warc,
        "op3_substring_chain": substring_chain.op3_substring_chain,
        "op4_sharding": sharding.op4_sharding,
        "op5_sp_sample": sp_sample.op5_sp_sample,
        "op6_fm_index": fm_index.op6_fm_index,
        "op7_lsh_forest": lsh_forest.op7_lsh_forest,
        "op8_ordinal": ordinal.op8_ordinal,
        "op9_bwt_dedup": bwt_dedup.op9_bwt_dedup,
        "op10_pii": pii.op10_pii,
        "op11_url_filter": url_filter.op11_url_filter,
        "op12_threshold_search": threshold_search.op12_threshold_search,
        "op13_token_align": token_align.op13_token_align,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_rules.ORACLE_SQL,
        "op2_warc": warc.ORACLE_SQL,
        "op6_fm_index": fm_index.ORACLE_SQL,
        "op7_lsh_forest": lsh_forest.ORACLE_SQL,
        "op9_bwt_dedup": bwt_dedup.ORACLE_SQL,
        "op11_url_filter": url_filter.ORACLE_SQL,
        "op12_threshold_search": threshold_search.ORACLE_SQL,
    }
