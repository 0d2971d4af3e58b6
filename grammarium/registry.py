"""All queries of the core and their SQL."""

from __future__ import annotations

import importlib

#: Modules that hold QUERIES and ORACLES.
MODULES: tuple[str, ...] = (
    "operators.rules", "operators.corpus", "operators.scoring", "operators.retrieval", "operators.sampling", "operators.dataflow", "operators.planning", "operators.languages", "operators.alignments", "operators.texts", "operators.prompts", "operators.ingest",
    "operators.labels",
)
FLAGSHIP = "rule_composition"


def _all(name: str) -> dict:
    found: dict = {}
    for m in MODULES:
        found |= getattr(importlib.import_module(f"grammarium.{m}"), name)
    return found


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLES")
