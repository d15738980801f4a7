"""All bound queries and their SQL, gathered from the plan modules."""

from __future__ import annotations

import importlib

MODULES = ["indicators", "registries", "peers", "spatial", "shapes", "overlay", "strips", "services", "registers", "projections", "exports", "export_files", "quality", "texts", "scans", "pulls", "nearby", "documents", "climate", "lookups", "whole"]

QUERIES: dict = {}
ORACLES: dict = {}

for _m in MODULES:
    _mod = importlib.import_module(f"{__package__}.{_m}")
    _twice = set(QUERIES) & set(_mod.QUERIES)
    if _twice:
        raise ValueError(f"query names used twice: {sorted(_twice)}")
    QUERIES.update(_mod.QUERIES)
    ORACLES.update(_mod.ORACLES)
