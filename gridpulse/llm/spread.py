"""Looking values up by a key that a large part of all rows may share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one in so many of the rows is hot, so fewer than ``SHARE`` keys are.
SHARE = 1000


def looked_up(rows: DataFrame, facts: DataFrame, key: str, copies: str = "copies") -> DataFrame:
    """``rows`` with the other columns of ``facts``, null where no fact has their key; nulls are one key.

    ``facts`` has one row per key and in ``copies`` the number of rows with it, a column that is
    dropped. Facts of hot keys are broadcast, fewer than ``SHARE`` rows, so no hot key is shuffled;
    the rest meet in a shuffle join. Both inputs are read twice and should be checkpoints.
    """
    total = rows.count()
    named = facts.withColumnRenamed(key, "__key")
    hot = named.filter(F.col(copies) * SHARE > total).drop(copies)
    cool = named.filter(F.col(copies) * SHARE <= total).drop(copies)
    same = F.col(key).eqNullSafe(F.col("__key"))
    of_hot = rows.join(F.broadcast(hot), same)
    rest = rows.join(F.broadcast(hot.select("__key")), same, "left_anti").join(cool, same, "left")
    return of_hot.unionByName(rest).drop("__key")
