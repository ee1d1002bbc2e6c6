"""The query catalogue run by ``__spark_entry__``."""

import importlib

MODULES = ("dashboards", "archive", "texts", "search", "places", "quality")


def catalogue():
    """``(queries, oracles)`` of all modules."""
    from newsloom.queries import base

    for name in MODULES:
        importlib.import_module(f"newsloom.queries.{name}")
    return dict(base.QUERIES), dict(base.ORACLES)
