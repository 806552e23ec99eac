"""Keyed reductions. All of them combine on the map side, so a hot key costs one row per task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .upserts import last_value

OFF_LIMIT = 120.0
OFF_LIMIT_COUNT = 2


def max_by_epoch(df: DataFrame, value: str, epoch: str = "epoch") -> DataFrame:
    return df.groupBy(epoch).agg(F.max(value).alias(value))


def single_temperature(df: DataFrame, how: str = "max", value: str = "temperature") -> DataFrame:
    """One temperature per epoch: the maximum, or the mean if asked for."""
    fold = {"max": F.max, "avg": F.avg}[how]
    return df.groupBy("epoch").agg(fold(value).alias(value))


def max_by_subject(df: DataFrame, value: str, keys: tuple[str, ...] = ("subject",)) -> DataFrame:
    """Latest epoch and largest value, which may come from different rows."""
    return df.groupBy(*keys).agg(F.max("epoch").alias("epoch"), F.max(value).alias(value))


def off_limits(df: DataFrame, value: str, limit: float = OFF_LIMIT) -> DataFrame:
    return df.filter(F.col(value) > limit)


def off_limit_count(
    df: DataFrame, value: str, keys: tuple[str, ...] = ("subject",), limit: float = OFF_LIMIT
) -> DataFrame:
    """First epoch and number of off-limit readings per key."""
    beyond = off_limits(df, value, limit)
    return beyond.groupBy(*keys).agg(F.min("epoch").alias("epoch"), F.count("*").alias("n"))


def alerts(
    df: DataFrame,
    value: str,
    keys: tuple[str, ...] = ("subject",),
    limit: float = OFF_LIMIT,
    count: int = OFF_LIMIT_COUNT,
) -> DataFrame:
    """Keys with at least ``count`` readings beyond ``limit``."""
    return off_limit_count(df, value, keys, limit).filter(F.col("n") >= count)


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def average_by(df: DataFrame, keys: list[str], value: str, name: str | None = None) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias(name or f"{value}_avg"))


def total_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def tag_summary(df: DataFrame, tag: str, value: str, order: list[str]) -> DataFrame:
    """Current, smallest and largest value per tag."""
    return df.groupBy(tag).agg(
        last_value(value, order).alias("current"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
