"""Narrowing of wide integers to the stored types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = {"tinyint": 8, "smallint": 16, "int": 32}


def narrow(column: Column, kind: str) -> Column:
    """Cast to a smaller integer type, null where the value does not fit.

    The range is tested first: a failing cast raises, and on dirty columns catching the
    errors costs more than the rest of the query.
    """
    limit = 2 ** (BITS[kind] - 1)
    return F.when(column.between(-limit, limit - 1), column.cast(kind))


# Stored types of the point key.
KEY_TYPES = {"line": "tinyint", "transformer": "int", "usage_point": "int"}


def raw_types(columns: dict[str, Column]) -> list[Column]:
    """Columns of the point key in their stored types."""
    return [narrow(c, KEY_TYPES[name]).alias(name) for name, c in columns.items()]
