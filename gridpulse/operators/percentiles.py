"""Exact percentiles that hold when one group has most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_DOUBLE_BITS = 53
# Significant bits kept by the two coarse histograms. A coarse bin then holds at most about
# 2**21 finer ones, and a sign and exponent range at most about 2**22 coarse bins.
_COARSE_BITS = (11, 32)


def round_bits(value: Column, bits: int) -> Column:
    """Round a double to ``bits`` significant bits; never reverses the order of two values."""
    scaled = value * (2.0 ** (_DOUBLE_BITS - bits) + 1.0)
    size = F.abs(value)
    return (
        F.when(size <= 2.0**-900, F.lit(0.0))
        .when(size < 2.0**900, scaled - (scaled - value))
        .otherwise(value)
    )


def percentile(
    df: DataFrame,
    value: str,
    fraction: float,
    keys: list[str],
    name: str | None = None,
) -> DataFrame:
    """Exact percentile of the known values per group, interpolated between neighbours.

    One plan for every size: values are ranked by :func:`percentile_by_rank`, which never holds
    a group in one task. Results equal the built-in aggregate, infinities included.
    """
    known = df.filter(F.col(value).isNotNull())
    return percentile_by_rank(known, value, fraction, keys, name or value)


def median(df: DataFrame, value: str, keys: list[str], name: str | None = None) -> DataFrame:
    return percentile(df, value, 0.5, keys, name)


def percentile_by_rank(
    df: DataFrame, value: str, fraction: float, keys: list[str], name: str
) -> DataFrame:
    """Find the two neighbours of the wanted rank by narrowing three nested histograms.

    Rows are first counted per distinct value, then per coarser and coarser bin. Going back
    down, only the bins around the wanted rank are opened. Every window covers the bins of
    one opened bin, however many rows they stand for.
    """
    exact = df.groupBy(*keys, F.col(value).cast("double").alias("_bin")).agg(
        F.count("*").alias("_n")
    )
    levels = [exact]
    for bits in reversed(_COARSE_BITS):
        finer = levels[0].select(*keys, round_bits(F.col("_bin"), bits).alias("_bin"), "_n")
        levels.insert(0, finer.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_n")))

    group = Window.partitionBy(*keys)
    rank = F.col("_total").cast("double") - 1
    opened = _around_rank(
        levels[0]
        .withColumn("_total", F.sum("_n").over(group))
        .withColumn("_before", F.sum("_n").over(group.orderBy("_bin")) - F.col("_n"))
        .withColumn("_lo", F.floor(rank * fraction))
        .withColumn("_hi", F.ceil(rank * fraction))
    )
    for bits, level in zip(_COARSE_BITS, levels[1:]):
        parents = opened.select(
            *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
            F.col("_bin").alias("_parent"),
            F.col("_before").alias("_start"),
            "_total", "_lo", "_hi",
        )
        same = round_bits(F.col("_bin"), bits) == F.col("_parent")
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        within = Window.partitionBy(*keys, "_parent").orderBy("_bin")
        children = level.join(parents, same)
        opened = _around_rank(
            children.withColumn(
                "_before", F.col("_start") + F.sum("_n").over(within) - F.col("_n")
            )
        )
    low = F.max(F.when(_holds("_lo"), F.col("_bin")))
    high = F.max(F.when(_holds("_hi"), F.col("_bin")))
    share = F.max((F.col("_total") - 1) * fraction - F.col("_lo"))
    between = F.when(low == high, low).otherwise((1 - share) * low + share * high)
    return opened.groupBy(*keys).agg(between.alias(name))


def _holds(rank: str) -> Column:
    r = F.col(rank)
    return (F.col("_before") <= r) & (r < F.col("_before") + F.col("_n"))


def _around_rank(df: DataFrame) -> DataFrame:
    return df.filter(_holds("_lo") | _holds("_hi"))


def percentile_sketch(
    df: DataFrame, value: str, fraction: float, keys: list[str], name: str | None = None,
    accuracy: int = 10_000,
) -> DataFrame:
    """Approximate percentile in one pass; the rank is off by at most ``1 / accuracy``."""
    sketch = F.percentile_approx(value, fraction, accuracy)
    return df.groupBy(*keys).agg(sketch.alias(name or value))


#: Size of a mergeable sketch, and how far the rank of its percentile may be off: two standard 99 % bounds
#: of 0.55 % for this size, whatever the number of values and of merges. Up to its size a sketch is exact.
SKETCH_SIZE = 800
RANK_ERROR = 0.011


def sketches(df: DataFrame, value: str, keys: list[str], size: int = SKETCH_SIZE) -> DataFrame:
    """(keys, n, sketch): a quantile sketch of a few kilobytes per group. Nulls and NaN do not count;
    a group without other values has no row."""
    known = df.filter(F.col(value).isNotNull() & ~F.isnan(value))
    sketch = F.kll_sketch_agg_double(F.col(value).cast("double"), size)
    return known.groupBy(*keys).agg(F.count("*").alias("n"), sketch.alias("sketch"))


def merged_sketches(df: DataFrame, keys: list[str | Column], size: int = SKETCH_SIZE) -> DataFrame:
    """Sketches of coarser groups from those of finer ones; partial merges come before the shuffle."""
    return df.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", size).alias("sketch")
    )


def sketched_percentile(df: DataFrame, fraction: float, name: str) -> DataFrame:
    """Replace the sketch of every row by its percentile, a value that occurred."""
    value = F.kll_sketch_get_quantile_double("sketch", F.lit(float(fraction)))
    return df.withColumn(name, value).drop("sketch")


def rank_within(
    values: DataFrame, estimates: DataFrame, value: str, estimate: str, fraction: float,
    keys: list[str], error: float = RANK_ERROR,
) -> DataFrame:
    """(keys, n, within): whether each estimate stands at the wanted share of all values, give or take ``error``.

    ``estimates`` has one row per group and is joined after the values are counted, so a group with
    most of the values meets it as one row per distinct value. Groups with a null key have no row.
    """
    counted = values.filter(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys, value).agg(
        F.count("*").alias("_times")
    )
    both = counted.join(estimates.select(*keys, F.col(estimate).alias("_estimate")), keys)
    n = F.sum("_times")
    below = F.sum(F.when(F.col(value) < F.col("_estimate"), F.col("_times")).otherwise(0)) / n
    upto = F.sum(F.when(F.col(value) <= F.col("_estimate"), F.col("_times")).otherwise(0)) / n
    within = (below - error <= fraction) & (F.lit(fraction) <= upto + error)
    return both.groupBy(*keys).agg(n.alias("n"), within.alias("within"))
