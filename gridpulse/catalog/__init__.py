"""Named queries over the given tables, with the equivalent SQL where there is one."""

from __future__ import annotations

from . import aggregates, learning, profiles, projections, series, sinks, streams
from .base import Query

MODULES = (projections, profiles, aggregates, series, sinks, streams, learning)


def all_queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for module in MODULES:
        found.update(module.catalog.entries)
    return found
