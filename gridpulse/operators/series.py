"""Row-to-row operators on time series at raw grain."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def _along(series: list[str]) -> Window:
    """Window over each series, or over the whole frame as one series."""
    return Window.partitionBy(*(series or [F.lit(0)]))


def with_previous(
    df: DataFrame, series: list[str], order: list[str], columns: list[str]
) -> DataFrame:
    """Add ``prev_<c>``: the column in the previous row of the same series.

    The frame is range-partitioned by series and ``order``, nulls first, so a series of any length
    is dealt over as many partitions as it fills. Within a sorted partition the previous row is the
    one above. The first row of a partition takes it from the last row of the nearest partition
    before that has rows; those carries are two rows a partition, which bounds their broadcast.

    Rows of equal ``order`` are told apart by ``columns``, so the result depends neither on the number
    of partitions nor on how the rows arrived.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = list(dict.fromkeys([*series, *order, *columns]))
    ranged = df.repartitionByRange(parts, *key).withColumn("_part", F.spark_partition_id())
    paired = _shifted(ranged.sortWithinPartitions(*key), series, columns)
    here = F.struct(*[F.col(f"`{c}`") for c in key])
    before = F.struct(*[F.col(f"`_prev_{c}`").alias(c) for c in dict.fromkeys([*series, *columns])])

    # Two rows a partition: its first one, and a copy of its last one.
    ends = paired.filter("_first or _copy").select("_part", "_copy", here.alias("_key"))
    last = F.lag("_key").over(Window.partitionBy(F.lit(0)).orderBy("_part", "_copy"))
    carried = ends.withColumn("_last", last).filter("not _copy")
    carried = carried.select(F.col("_part").alias("_of"), F.col("_key").alias("_expected"), "_last")

    rows = paired.filter("not _copy").withColumn("_here", here).withColumn("_before", before)
    joined = rows.join(F.broadcast(carried), F.expr("if(_first, _part, null)") == F.col("_of"), "left")
    # Both reads of the partitions have to see the same ones.
    astray = F.col("_first") & ~F.col("_expected").eqNullSafe(F.col("_here"))
    checked = F.when(astray, F.raise_error(F.lit("the partitions were cut anew between two reads")).cast("boolean"))

    def previous(c: str):
        above = F.when(F.col("_first"), F.col("_last").getField(c)).otherwise(F.col("_before").getField(c))
        return F.when(checked.isNull(), above)

    same = F.when(F.col("_first"), F.col("_last").isNotNull()).otherwise(F.lit(True))
    for c in series:
        same = same & previous(c).eqNullSafe(F.col(c))
    return joined.select(*df.columns, *[F.when(same, previous(c)).alias(f"prev_{c}") for c in columns])


def _shifted(sorted_parts: DataFrame, series: list[str], columns: list[str]) -> DataFrame:
    """The rows with ``_prev_<c>`` of the row above in the partition, whatever its series; ``_first``
    marks the first row of a partition, ``_copy`` a copy of its last row below it."""
    names = list(dict.fromkeys([*series, *columns]))
    fields = sorted_parts.schema.fields
    added = [T.StructField(f"_prev_{n}", sorted_parts.schema[n].dataType) for n in names]
    flags = [T.StructField("_first", T.BooleanType()), T.StructField("_copy", T.BooleanType())]

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not len(batch):
                continue
            above = []
            for n in names:
                column = batch.column(batch.schema.get_field_index(n))
                lead = pa.nulls(1, column.type) if last is None else last.column(last.schema.get_field_index(n))
                above.append(pa.concat_arrays([lead, column.slice(0, len(column) - 1)]))
            first = pa.array([last is None] + [False] * (len(batch) - 1))
            no = pa.array([False] * len(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns, *above, first, no], names=out)
            last = batch.slice(len(batch) - 1)
        if last is not None:
            none = [pa.nulls(1, last.column(last.schema.get_field_index(n)).type) for n in names]
            yield pa.RecordBatch.from_arrays(
                [*last.columns, *none, pa.array([False]), pa.array([True])], names=out
            )

    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in fields], *added, *flags])
    out = schema.names
    return sorted_parts.mapInArrow(shift, schema)


def derivative(
    df: DataFrame,
    value: str,
    time: str,
    series: list[str],
    order: list[str],
    ticks_per_second: int = 1,
) -> DataFrame:
    """Change per second since the previous row; may be negative, the first row has none."""
    paired = with_previous(df, series, order, [value, time])
    seconds = (F.col(time) - F.col(f"prev_{time}")) / ticks_per_second
    rate = F.try_divide(F.col(value) - F.col(f"prev_{value}"), seconds)
    return (
        paired.filter(F.col(f"prev_{time}").isNotNull())
        .withColumn("derivative", rate)
        .drop(f"prev_{value}", f"prev_{time}")
    )


def instant_rate(
    df: DataFrame,
    counter: str,
    range_seconds: int,
    series: list[str],
    time: str = "epoch",
) -> DataFrame:
    """Per-second rate of the last two samples within ``range_seconds``.

    A falling counter was reset, so its whole value is the increase. Two samples with one time have
    no rate.
    """
    paired = with_previous(df, series, [time], [counter, time])
    now, prev = F.col(counter), F.col(f"prev_{counter}")
    elapsed = F.col(time) - F.col(f"prev_{time}")
    increase = F.when(now < prev, now).otherwise(now - prev)
    return (
        paired.filter(elapsed < range_seconds)
        .withColumn("rate", F.try_divide(increase, elapsed))
        .drop(f"prev_{counter}", f"prev_{time}")
    )


def step_changes(
    df: DataFrame, value: str, limit: float, series: list[str], order: list[str]
) -> DataFrame:
    """Rows that differ from their predecessor by ``limit`` or more."""
    paired = with_previous(df, series, order, [value])
    step = F.abs(F.col(value) - F.col(f"prev_{value}"))
    return paired.withColumn("step", step).filter(F.col("step") >= limit)


def cadence_breaks(
    df: DataFrame, cadence: int, series: list[str], time: str = "epoch"
) -> DataFrame:
    """Rows that do not follow their predecessor by exactly ``cadence``."""
    paired = with_previous(df, series, [time], [time])
    gap = F.col(time) - F.col(f"prev_{time}")
    return paired.withColumn("gap", gap).filter(F.col("gap") != cadence)


def lag_forecast(
    df: DataFrame, value: str, series: list[str], time: str = "epoch", steps: int = 12
) -> DataFrame:
    """Pair each row with the forecast of ``steps`` rows before, whatever the time between.

    Takes one row per (series, time), as :func:`align_forecast` does.
    """
    ordered = _along(series).orderBy(time)
    return df.withColumn("forecast", F.lag(value, steps).over(ordered)).filter(
        F.col("forecast").isNotNull()
    )


def align_forecast(
    forecast: DataFrame, actual: DataFrame, value: str, horizon: int = 12 * 3600
) -> DataFrame:
    """Pair each actual value with the forecast made ``horizon`` seconds earlier.

    Both sides have one row per epoch, so the join key is unique on either side.
    """
    ahead = forecast.select(
        (F.col("epoch") + horizon).alias("epoch"), F.col(value).alias("forecast")
    )
    return actual.select("epoch", F.col(value).alias("actual")).join(ahead, "epoch")
