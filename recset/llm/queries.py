"""Registry of the subpackage: each query applies one operator to its whole table and derives the digest columns."""
from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn

    return deco


# Modules that register queries, in the order of their numbers.
MODULES = "decontamination token_counts language_id class_ngrams simhash bit_planes private_data packing url_rules pivots whitening byte_bpe spelling".split()

for _m in MODULES:
    importlib.import_module(f"recset.llm.{_m}")
