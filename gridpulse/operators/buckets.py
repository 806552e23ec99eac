"""Time-bucket aggregates, tiered retention and rule-driven downsampling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timeparts import bucket_start
from .upserts import last_value


def bucketed(
    df: DataFrame,
    seconds: int,
    aggregates: dict[str, Column],
    series: tuple[str, ...] = (),
    epoch: str = "epoch",
) -> DataFrame:
    """Aggregate per series and bucket; empty buckets give no row."""
    bucket = bucket_start(F.col(epoch), seconds).alias("bucket")
    return df.groupBy(*series, bucket).agg(*[c.alias(name) for name, c in aggregates.items()])


def bucket_mean(
    df: DataFrame, value: str, seconds: int, series: tuple[str, ...] = ()
) -> DataFrame:
    return bucketed(df, seconds, {value: F.avg(value)}, series)


def bucket_last(
    df: DataFrame, value: str, seconds: int, order: list[str], series: tuple[str, ...] = ()
) -> DataFrame:
    """Value of the last row per bucket."""
    return bucketed(df, seconds, {value: last_value(value, order)}, series)


def bucket_count(df: DataFrame, seconds: int, series: tuple[str, ...] = ()) -> DataFrame:
    return bucketed(df, seconds, {"n": F.count("*")}, series)


def bucket_max(
    df: DataFrame, value: str, seconds: int, series: tuple[str, ...] = ()
) -> DataFrame:
    return bucketed(df, seconds, {value: F.max(value)}, series)


def bucket_distinct(df: DataFrame, value: str, seconds: int, series: tuple[str, ...] = ()) -> DataFrame:
    """One row per bucket and distinct value."""
    bucket = bucket_start(F.col("epoch"), seconds).alias("bucket")
    return df.select(*series, bucket, value).distinct()


def since(df: DataFrame, time: str, seconds: int, now: Column | None = None) -> DataFrame:
    """Rows of the last ``seconds`` before ``now``, by default the newest row.

    The bound is a scalar subquery on the bare column: Spark evaluates it first and hands
    the value to the Parquet scan.
    """
    if now is not None:
        return df.filter(F.col(time) >= now - F.expr(f"interval {seconds} seconds"))
    newest = df.agg((F.max(time) - F.expr(f"interval {seconds} seconds")).alias("t"))
    return df.filter(F.col(time) >= newest.scalar())


def threshold_breach(df: DataFrame, value: str, threshold: float) -> DataFrame:
    return df.withColumn("breach", F.col(value) > threshold)


@dataclass(frozen=True)
class Rule:
    """How a metric whose name matches ``pattern`` is downsampled."""

    pattern: str
    method: str
    min_known: float


# The first rule that matches a metric name decides.
RULES = [
    Rule(r"\.lower$", "min", 0.1),
    Rule(r"\.upper(_\d+)?$", "max", 0.1),
    Rule(r"\.sum$", "sum", 0.0),
    Rule(r"\.count$", "sum", 0.0),
    Rule(r"^stats_counts.*", "sum", 0.0),
    Rule(r".*", "average", 0.3),
]


# Seconds per point and seconds kept of the fine and the coarse tier.
FINE_TIER = (10, 3600)
COARSE_TIER = (60, 86400)


def rollup(
    df: DataFrame,
    fine_seconds: int = FINE_TIER[0],
    coarse_seconds: int = COARSE_TIER[0],
    rules: list[Rule] = RULES,
    order: tuple[str, ...] = ("epoch",),
) -> DataFrame:
    """Downsample ``(name, epoch, value)`` points from fine to coarse slots.

    A fine slot holds its last point. A coarse slot is null unless enough of its fine slots
    are known. Names are matched once per coarse slot, not once per point.
    """
    if coarse_seconds % fine_seconds:
        raise ValueError("a coarse slot must hold a whole number of fine slots")
    fine = bucketed(df, fine_seconds, {"value": last_value("value", list(order))}, ("name",))
    return by_rules(coarse_slots(fine, coarse_seconds), coarse_seconds // fine_seconds, rules)


def coarse_slots(fine: DataFrame, coarse_seconds: int) -> DataFrame:
    """What every method needs of ``(name, bucket, value)`` fine slots: (name, slot, min, max, sum, average, known)."""
    return fine.groupBy("name", bucket_start(F.col("bucket"), coarse_seconds).alias("slot")).agg(
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.sum("value").alias("sum"),
        F.avg("value").alias("average"),
        F.count("value").alias("known"),
    )


def by_rules(coarse: DataFrame, expected: int, rules: list[Rule] = RULES) -> DataFrame:
    """(name, slot, known, value) of coarse slots, null where too few of ``expected`` fine slots are known."""
    name, known = F.col("name"), F.col("known") / expected
    value = F.lit(None).cast("double")
    for rule in reversed(rules):
        enough = F.when(known >= rule.min_known, F.col(rule.method))
        value = F.when(name.rlike(rule.pattern), enough).otherwise(value)
    return coarse.select("name", "slot", "known", value.alias("value"))


def retain(tiers: dict[str, tuple[DataFrame, int]], time: str, now: Column) -> DataFrame:
    """Union of the tiers, each cut to its own retention in seconds before ``now``."""
    kept = None
    for tier, (df, seconds) in tiers.items():
        part = df.filter(F.col(time) >= now - seconds).withColumn("tier", F.lit(tier))
        kept = part if kept is None else kept.unionByName(part)
    return kept


def stored_tiers(
    df: DataFrame,
    now: Column,
    fine: tuple[int, int] = FINE_TIER,
    coarse: tuple[int, int] = COARSE_TIER,
    rules: list[Rule] = RULES,
) -> DataFrame:
    """What the metric store keeps of ``(name, epoch, value)`` points at time ``now``."""
    points = bucketed(df, fine[0], {"value": last_value("value", ["epoch"])}, ("name",))
    rolled = rollup(df, fine[0], coarse[0], rules).withColumnRenamed("slot", "bucket")
    tiers = {"fine": (points, fine[1]), "coarse": (rolled.drop("known"), coarse[1])}
    return retain(tiers, "bucket", now)
