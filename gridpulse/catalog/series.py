"""Derivatives, counter rates, gap handling and checks on series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import buckets, gaps, series
from ..sources import tables
from .base import (
    COUNTERS, HOUR_MAX, HOUR_TEMPERATURE, READINGS, READINGS_BIG, TEMPERATURES, TYPE_GRID,
    TYPE_HOURS, Catalog, tidy,
)
from .profiles import hour_temperatures

catalog = Catalog()

HOUR = tables.HOUR


def _ticking(rows):
    return rows.withColumn("micros", F.unix_micros(F.col("ts").cast("timestamp")))


DERIVATIVE = """select event_id, round((voltage - prev_v) / nullif((epoch_us(ts) - epoch_us(prev_ts)) / 1000000.0, 0), 6) as derivative
    from (select *, lag(voltage) over w as prev_v, lag(ts) over w as prev_ts
          from readings window w as (partition by {by} order by ts, event_id))
    where prev_ts is not null"""


@catalog.query(DERIVATIVE.format(by="usage_point"), READINGS)
def derivative_1s(spark, sf_dir):
    rows = _ticking(tables.readings(spark, sf_dir))
    change = series.derivative(
        rows, "voltage", "micros", ["usage_point"], ["ts", "event_id"], 1_000_000
    )
    return tidy(change.select("event_id", "derivative"))


@catalog.query(DERIVATIVE.format(by="line"), READINGS)
def derivative_chunked(spark, sf_dir):
    """Three long series, dealt over more partitions than there are series."""
    rows = _ticking(tables.readings(spark, sf_dir))
    change = series.derivative(
        rows, "voltage", "micros", ["line"], ["ts", "event_id"], 1_000_000
    )
    return tidy(change.select("event_id", "derivative"))


@catalog.query(
    """select event_type, epoch, round(case when counter < prev then counter else counter - prev end
                                       / cast(epoch - prev_epoch as double), 6) as rate
       from (select *, lag(counter) over w as prev, lag(epoch) over w as prev_epoch
             from counters window w as (partition by event_type order by epoch))
       where epoch - prev_epoch < 7200""",
    COUNTERS,
)
def irate_1m(spark, sf_dir):
    rate = series.instant_rate(tables.counters(spark, sf_dir), "counter", 2 * HOUR, ["event_type"])
    return tidy(rate.select("event_type", "epoch", "rate"))


def _event_hours(spark, sf_dir):
    rows = tables.events(spark, sf_dir).select(
        "event_type", tables.epoch_of("ts").alias("epoch"), "value"
    )
    return buckets.bucket_max(rows, "value", HOUR, ("event_type",))


def _filled(spark, sf_dir):
    return gaps.fill_null(_event_hours(spark, sf_dir), HOUR, ["event_type"])


@catalog.query(
    """select bucket, temperature from
           (select unnest(generate_series(lo, hi, 3600)) as bucket
            from (select min(h) as lo, max(h) as hi from
                  (select cast(floor(epoch(ts)) as bigint) - cast(floor(epoch(ts)) as bigint) % 3600 as h
                   from events)))
       left join (select epoch as bucket, temperature from hour_temperature) using (bucket)""",
    TEMPERATURES, HOUR_TEMPERATURE,
)
def fill_null(spark, sf_dir):
    hours = hour_temperatures(spark, sf_dir).withColumnRenamed("epoch", "bucket")
    every = tables.hourly(
        tables.events(spark, sf_dir).select(tables.epoch_of("ts").alias("epoch"))
    )
    ends = every.agg(F.struct(F.min("epoch").alias("lo"), F.max("epoch").alias("hi"))).scalar()
    return gaps.fill_null(hours, HOUR, [], (ends.getField("lo"), ends.getField("hi")))


@catalog.query("select event_type, bucket, value from type_hours", TYPE_HOURS)
def fill_none(spark, sf_dir):
    return gaps.fill_none(_event_hours(spark, sf_dir), "value")


@catalog.query(
    """select event_type, bucket, last_value(value ignore nulls) over (
           partition by event_type order by bucket rows unbounded preceding) as value
       from filled""",
    TYPE_HOURS, TYPE_GRID,
)
def fill_previous(spark, sf_dir):
    return gaps.fill_previous(_filled(spark, sf_dir), "value", ["event_type"])


@catalog.query("select event_type, bucket, coalesce(value, 0) as value from filled", TYPE_HOURS, TYPE_GRID)
def null_as_zero(spark, sf_dir):
    return gaps.null_as_zero(_filled(spark, sf_dir), "value")


@catalog.query(
    """select event_type, bucket, round(coalesce(value,
              v0 + (v1 - v0) * (bucket - t0) / nullif(t1 - t0, 0)), 6) as value
       from (select *,
                 last_value(value ignore nulls) over back as v0,
                 first_value(value ignore nulls) over ahead as v1,
                 last_value(case when value is not null then bucket end ignore nulls) over back as t0,
                 first_value(case when value is not null then bucket end ignore nulls) over ahead as t1
             from filled
             window back as (partition by event_type order by bucket
                             rows between unbounded preceding and current row),
                    ahead as (partition by event_type order by bucket
                              rows between current row and unbounded following))""",
    TYPE_HOURS, TYPE_GRID,
)
def fill_linear(spark, sf_dir):
    return tidy(gaps.fill_linear(_filled(spark, sf_dir), "value", ["event_type"]))


@catalog.query(
    """select epoch, voltage, round(abs(voltage - prev), 6) as step
       from (select *, lag(voltage) over (order by epoch) as prev from hour_max)
       where abs(voltage - prev) >= 100""",
    READINGS, HOUR_MAX,
)
def step_change(spark, sf_dir):
    rows = tables.hourly(tables.readings(spark, sf_dir))
    hours = buckets.bucket_max(rows, "voltage", HOUR).withColumnRenamed("bucket", "epoch")
    steps = series.step_changes(hours, "voltage", 100.0, [], ["epoch"])
    return tidy(steps.select("epoch", "voltage", "step"))


@catalog.query(
    """select epoch, gap from (
           select epoch, epoch - lag(epoch) over (order by epoch) as gap from hour_temperature)
       where gap <> 3600""",
    TEMPERATURES, HOUR_TEMPERATURE,
)
def cadence_break(spark, sf_dir):
    hours = hour_temperatures(spark, sf_dir)
    return series.cadence_breaks(hours, HOUR, []).select("epoch", "gap")


@catalog.query(
    """select reading_id, usage_point, epoch, voltage, step from (
           select *, abs(voltage - lag(voltage) over (
                      partition by usage_point order by ts, reading_id, voltage)) as step
           from readings_big)
       where step >= 45""",
    READINGS_BIG,
)
def step_change_big(spark, sf_dir):
    steps = series.step_changes(
        tables.readings_big(spark, sf_dir), "voltage", 45.0, ["usage_point"],
        ["ts", "reading_id", "voltage"],
    )
    return steps.select("reading_id", "usage_point", "epoch", "voltage", "step")
