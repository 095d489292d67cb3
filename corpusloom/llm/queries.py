"""The queries of this subpackage and, where DuckDB can express them, their SQL."""

from __future__ import annotations

import importlib

#: Query name and the module that holds it.
_MODULES = {
    "op1_quality_model": "quality_model",
    "op2_quality_rules": "quality_rules",
    "op3_toxicity": "toxicity",
    "op4_sharding": "sharding",
    "op5_jaccard_join": "jaccard_join",
    "op6_substring_dedup": "substring_dedup",
    "op7_embedding_dedup": "embedding_dedup",
    "op8_packing": "packing",
    "op9_bpe": "bpe",
    "op10_chat_formatting": "chat_formatting",
    "op11_secret_scan": "secret_scan",
    "op12_ranked_search": "ranked_search",
    "op13_name_join": "name_join",
}


def _module(name: str):
    return importlib.import_module(f"corpusloom.llm.{name}")


#: Further queries: the module, its function and the name of its SQL.
_MORE = {"embedding_links_planted": ("embedding_dedup", "planted", "PLANTED_SQL")}


def queries() -> dict:
    found = {name: (lambda spark, sf_dir, m=module: _module(m).query(spark, sf_dir)) for name, module in _MODULES.items()}
    return found | {name: (lambda spark, sf_dir, m=m, f=f: getattr(_module(m), f)(spark, sf_dir)) for name, (m, f, _) in _MORE.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(_module(module), "ORACLE_SQL", None) for name, module in _MODULES.items()}
    found |= {name: getattr(_module(m), sql) for name, (m, _, sql) in _MORE.items()}
    return {name: sql for name, sql in found.items() if sql}
