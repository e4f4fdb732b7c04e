"""Every named query; importing the modules registers them."""

from __future__ import annotations

import importlib

from corpusflow.catalog.registry import ENTRIES, Entry

MODULES = ("retrieval", "documents", "conversation", "storage", "agents", "streams")


def load_all() -> dict[str, Entry]:
    for module in MODULES:
        importlib.import_module(f"corpusflow.catalog.{module}")
    return ENTRIES
