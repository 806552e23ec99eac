"""Gap handling on bucketed series.

Every function takes one row per (series, bucket). A series is then as long as the time
range has buckets, whatever the number of readings behind it, and fits a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def fill_null(
    df: DataFrame,
    seconds: int,
    series: list[str],
    bounds: tuple[int | Column, int | Column] | None = None,
    bucket: str = "bucket",
) -> DataFrame:
    """Every bucket of every series, null where nothing was seen.

    ``bounds`` are the first and last bucket of the requested range, by default those of the
    data. Each row spreads over the empty buckets up to the next row of its series, so the
    frame is read and shuffled once and a window over the same series needs no further shuffle.
    """
    here, ordered = F.col(bucket), _past(series, bucket)
    if bounds is None:
        ends = df.agg(F.struct(F.min(bucket).alias("lo"), F.max(bucket).alias("hi"))).scalar()
        lo, hi = ends.getField("lo"), ends.getField("hi")
    else:
        lo, hi = [b if isinstance(b, Column) else F.lit(b) for b in bounds]
        df = df.filter(here.between(lo, hi))
    first = F.when(F.lag(bucket).over(ordered).isNull(), lo).otherwise(here)
    last = F.coalesce(F.lead(bucket).over(ordered) - seconds, hi)
    spread = (
        df.withColumns({"_first": first, "_last": last})
        .withColumn("_at", F.explode(F.sequence("_first", "_last", F.lit(seconds).cast("bigint"))))
    )
    return spread.select(
        *[
            F.col("_at").alias(c) if c == bucket
            else F.col(c) if c in series
            else F.when(here == F.col("_at"), F.col(c)).alias(c)
            for c in df.columns
        ]
    )


def _past(series: list[str], bucket: Column | str) -> Window:
    return Window.partitionBy(*(series or [F.lit(0)])).orderBy(bucket)


def fill_previous(
    df: DataFrame, value: str, series: list[str], bucket: str = "bucket"
) -> DataFrame:
    """Carry the last known value forward; leading gaps stay null."""
    so_far = _past(series, bucket).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(so_far))


def fill_linear(
    df: DataFrame, value: str, series: list[str], bucket: str = "bucket"
) -> DataFrame:
    """Connect known neighbours by a straight line; outer gaps stay null."""
    back = _past(series, F.col(bucket)).rowsBetween(Window.unboundedPreceding, 0)
    # The next known value is the last one seen in reverse order: a running frame, where a
    # frame open to the end would be summed up anew for every row.
    ahead = _past(series, F.col(bucket).desc()).rowsBetween(Window.unboundedPreceding, 0)

    def known(column: str, over: Window) -> Column:
        seen = F.when(F.col(value).isNotNull(), F.col(column))
        return F.last(seen, ignorenulls=True).over(over)

    v0, v1 = known(value, back), known(value, ahead)
    t0, t1 = known(bucket, back), known(bucket, ahead)
    line = v0 + (v1 - v0) * F.try_divide(F.col(bucket) - t0, t1 - t0)
    return df.withColumn(value, F.coalesce(F.col(value), line))


def fill_none(df: DataFrame, value: str) -> DataFrame:
    """Leave empty buckets out. A bucketed frame needs no gap filling for it."""
    return df.filter(F.col(value).isNotNull())


def null_as_zero(df: DataFrame, value: str) -> DataFrame:
    return df.withColumn(value, F.coalesce(F.col(value), F.lit(0.0)))
