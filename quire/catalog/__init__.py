"""All registered queries, by topic."""

from __future__ import annotations

import importlib

TOPICS = ("text", "layout", "toc", "store", "checks", "retrieval", "answers", "memory", "chat", "streams")


def load_catalog():
    from quire.catalog import base
    for topic in TOPICS:
        importlib.import_module(f"quire.catalog.{topic}")
    return base.QUERIES, base.ORACLES
