"""Training-data operators. Nothing else in the package imports this subpackage."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: query -> the module that holds a function of that name, and oracle() if SQL can express it
_MODULES = {
    "op1_html_extraction": "html_mincut",
    "op2_token_store": "token_store",
    "op3_warc": "warc",
    "op4_toxicity": "toxicity",
    "op5_decontaminate": "decontaminate",
    "op6_near_dedup": "near_dedup",
    "op7_ann": "ann",
    "op8_pii": "pii",
    "op9_licenses": "licenses",
    "op10_sentencepiece": "sentencepiece_codec",
    "op11_mixing": "mixing",
    "op12_repair": "repair",
    "op13_prefix_trie": "trie",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f".{module}", __name__), name) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: import_module(f".{module}", __name__) for name, module in _MODULES.items()}
    return {name: m.oracle() for name, m in found.items() if hasattr(m, "oracle")}
