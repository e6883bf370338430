"""All queries of this package and their SQL."""

from __future__ import annotations

import importlib

MODULES = ["scoring", "mixing", "minhash", "licenses", "topk", "quality", "tokenfile", "separators", "urls", "bpe", "linededup", "negatives", "vectorcode"]

QUERIES: dict = {}
SQL: dict = {}
for _name in MODULES:
    _m = importlib.import_module(f"{__package__}.{_name}")
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
