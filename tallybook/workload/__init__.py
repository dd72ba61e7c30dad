"""Queries over the given tables, one per operator of the inventory."""

from importlib import import_module

from tallybook.workload import registry

MODULES = ["summaries", "text", "matching", "insight_queries", "analysis_queries", "upkeep", "source_queries", "stream_queries"]


def _load():
    for m in MODULES:
        import_module(f"tallybook.workload.{m}")


def queries():
    _load()
    return dict(registry.QUERIES)


def oracles():
    _load()
    return dict(registry.ORACLES)
