"""Queries of this subpackage: ``QUERIES`` name -> (spark, sf_dir) -> DataFrame, ``ORACLE`` name -> DuckDB SQL."""

from __future__ import annotations

import importlib

#: module name -> query names that it registers
MODULES = ("q_suffix_dedup", "q_chat", "q_url_filter", "q_quality_rules", "q_token_ids", "q_quality", "q_html", "q_sentencepiece", "q_jaccard", "q_decontamination")

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _m in MODULES:
    _mod = importlib.import_module(f"{__package__}.{_m}")
    QUERIES.update(_mod.QUERIES)
    ORACLE.update(getattr(_mod, "ORACLE", {}))
