"""The registered queries, by topic."""

from __future__ import annotations

import importlib

_TOPICS = ("profiles", "texts", "rankings", "evidence", "service", "streams", "files")


def _load():
    from laurel.catalog import registry

    for topic in _TOPICS:
        importlib.import_module(f"laurel.catalog.{topic}")
    return registry


def all_queries():
    return dict(_load().QUERIES)


def all_oracles():
    return dict(_load().ORACLES)
