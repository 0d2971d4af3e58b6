"""Operators on training data for language models; nothing else in the library imports this package."""

from __future__ import annotations

import importlib

MODULES = ("p1_overlap", "p2_defects", "p3_terms", "p4_subset", "p5_setjoin", "p6_neighbours", "p7_encode", "p8_leaks", "p9_levels")


def _all(name: str) -> dict:
    found: dict = {}
    for m in MODULES:
        found |= getattr(importlib.import_module(f"{__name__}.{m}"), name)
    return found


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLES")
