"""The registered queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from kinotable.llm import decontaminate, langid, licenses, lmscore, packing, pii, sharding, simhash, tokencount, topk

_MODULES = {
    "op1_decontamination": decontaminate,
    "op2_simhash": simhash,
    "op3_language_id": langid,
    "op4_topk": topk,
    "op5_lm_score": lmscore,
    "op6_pii": pii,
    "op7_licenses": licenses,
    "op8_sharding": sharding,
    "op9_token_counts": tokencount,
    "op10_packing": packing,
}


def queries() -> dict:
    return {name: module.query for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.SQL for name, module in _MODULES.items() if hasattr(module, "SQL")}
