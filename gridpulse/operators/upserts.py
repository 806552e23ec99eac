"""Last-write-wins reductions behind the keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last written row of every key; ``order`` must be unique within a key."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    last = F.max(F.struct(*order, *rest))
    merged = df.groupBy(*keys).agg(last.alias("_last")).select(*keys, "_last.*")
    return merged.select(*df.columns)


def last_value(value: str, order: list[str]) -> Column:
    """Aggregate for the value of the last written row.

    One number to order by keeps the aggregate in fixed-width hash buffers; more than one
    are compared as a struct.
    """
    if len(order) == 1:
        return F.max_by(value, order[0])
    return F.max(F.struct(*order, value)).getField(value)


def newest_rows(df: DataFrame, keys: list[str], order: list[str], n: int = 1) -> DataFrame:
    """The ``n`` newest rows per key, newest first.

    Spark trims every key to ``n`` rows before the shuffle, so a hot key ships little. It does
    so up to a configured ``n``; beyond, each input partition's share of a key is trimmed
    first, which bounds what one task sees of a key by the size of a partition.
    """
    newest_first = [F.col(c).desc() for c in order]
    trimmed_by_spark = int(
        df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")
    )
    if n > trimmed_by_spark:
        shares = Window.partitionBy(*keys, "_share").orderBy(*newest_first)
        df = (
            df.withColumn("_share", F.spark_partition_id())
            .withColumn("_rank", F.row_number().over(shares))
            .filter(F.col("_rank") <= n)
            .drop("_share", "_rank")
        )
    recent = Window.partitionBy(*keys).orderBy(*newest_first)
    return df.withColumn("recency", F.row_number().over(recent)).filter(F.col("recency") <= n)


def limit_rows(df: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    """First ``n`` rows in a fixed order, so a repeated call shows the same rows."""
    return df.orderBy(*order).limit(n)


def upsert_epochs(df: DataFrame, value: str, order: list[str], merge: str = "max") -> DataFrame:
    """One row per epoch.

    ``merge="max"`` keeps the largest value; ``"overwrite"`` the last written one, which is
    what per-batch maxima written one after the other leave behind.
    """
    if merge == "max":
        kept = F.max(value)
    elif merge == "overwrite":
        kept = last_value(value, order)
    else:
        raise ValueError(f"unknown merge {merge!r}")
    return df.groupBy("epoch").agg(kept.alias(value))
