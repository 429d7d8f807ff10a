"""The corpus queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

MODULES = (
    "token_counts",
    "neighbours",
    "url_filters",
    "secret_scans",
    "mixing",
    "toxicity",
    "packing",
    "simhash",
    "order_minhash",
    "line_dedup",
)

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _name in MODULES:
    _module = importlib.import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= getattr(_module, "ORACLE_SQL", {})
