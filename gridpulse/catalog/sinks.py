"""Keyed tables: upserts, counters and replaced aggregates, read back after writing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timeparts import local_date
from ..operators import upserts
from ..plans import averages
from ..session import scratch
from ..sinks import tables as stored
from ..sources import tables
from ..streaming.jobs import POINT_KEY, raw_rows
from .base import DAY_PARTS, READINGS, TIME_PARTS, Catalog, tidy

catalog = Catalog()

LAST = ["ts", "event_id"]


@catalog.query(
    f"""select * exclude (recency) from (
            select line, transformer, usage_point, {TIME_PARTS}, voltage,
                   row_number() over (partition by usage_point, date_trunc('minute', ts)
                                      order by ts desc, event_id desc) as recency
            from readings)
        where recency = 1""",
    READINGS,
)
def raw_upsert_latest(spark, sf_dir):
    raw = raw_rows(tables.readings(spark, sf_dir))
    return tidy(upserts.latest_by_key(raw, POINT_KEY, LAST).drop("ts", "event_id", "date"))


@catalog.query(
    f"""select line, transformer, usage_point, {DAY_PARTS}, cast(hour(ts) as bigint) as hour,
               cast(minute(ts) as bigint) as minute, voltage
        from (select *, row_number() over (partition by usage_point, date_trunc('minute', ts)
                                           order by ts desc, event_id desc) as recency
              from readings)
        where recency = 1""",
    READINGS,
)
def raw_upsert_table(spark, sf_dir):
    """Two overlapping batches written by day, the first of them twice, then merged."""
    raw = raw_rows(tables.readings(spark, sf_dir))
    path = scratch(spark, "raw")
    day = local_date(F.unix_seconds(F.col("ts").cast("timestamp")))
    first = raw.filter(F.col("hour") < 16)
    for batch_id, rows in ((0, first), (0, first), (1, raw)):
        stored.upsert_batch(rows.drop("date"), path, batch_id, POINT_KEY, LAST, day)
    merged = stored.read_upserts(spark, path, POINT_KEY, LAST)
    return tidy(merged.select(*POINT_KEY, "voltage"))


@catalog.query(
    "select epoch - epoch % 3600 as epoch, max(voltage) as voltage from readings group by 1", READINGS
)
def epoch_upsert_max(spark, sf_dir):
    return upserts.upsert_epochs(
        tables.hourly(tables.readings(spark, sf_dir)), "voltage", LAST, "max"
    )


@catalog.query(
    """select epoch - epoch % 3600 as epoch, arg_max(voltage, struct_pack(a := ts, b := event_id)) as voltage
       from readings group by 1""",
    READINGS,
)
def epoch_upsert_last(spark, sf_dir):
    return upserts.upsert_epochs(
        tables.hourly(tables.readings(spark, sf_dir)), "voltage", LAST, "overwrite"
    )


@catalog.query("select line, count(*) as n from readings group by line", READINGS)
def counter_increment(spark, sf_dir):
    """Counted in two batches, one of which is replayed."""
    rows = tables.readings(spark, sf_dir)
    path = scratch(spark, "counts")
    early = F.hour("ts") < 12
    for batch_id, part in ((0, early), (1, ~early), (1, ~early)):
        stored.increment_batch(rows.filter(part), path, batch_id, ["line"])
    return stored.read_counters(spark, path, ["line"])


@catalog.query(
    f"""select line, transformer, {DAY_PARTS}, round(avg(voltage), 6) as voltage_avg
        from readings group by all""",
    READINGS,
)
def daily_avg_overwrite(spark, sf_dir):
    """The whole batch job: stored raw table, SQL scan, average, replaced result table."""
    raw_path, target = scratch(spark, "raw"), scratch(spark, "daily")
    raw = raw_rows(tables.readings(spark, sf_dir))
    stored.overwrite(raw, raw_path, ("date",))
    for _ in range(2):
        daily = averages.run(spark.read.parquet(raw_path), target)
    return tidy(daily)
