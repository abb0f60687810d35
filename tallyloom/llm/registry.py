"""The query modules of this subpackage."""

from __future__ import annotations

import importlib

NAMES = ("queries_clusters", "queries_products", "queries_categories", "queries_tokens", "queries_text", "queries_copies")


def modules() -> list:
    return [importlib.import_module(f"tallyloom.llm.{n}") for n in NAMES]
