"""Reductions by key and by time bucket."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import subjects, timeparts
from ..operators import aggregates as agg
from ..operators import buckets, percentiles, upserts
from ..plans import averages
from ..session import scratch
from ..sinks import reports
from ..sources import messages, metrics, tables
from ..streaming import runner, tiers
from .base import (
    DAY_PARTS, FLUSHED, HOUR_MAX, METRICS, READINGS, READINGS_BIG, TEMPERATURES, Catalog, tidy,
)

catalog = Catalog()

HOUR, DAY = tables.HOUR, timeparts.DAY
LAST = ["ts", "event_id"]


@catalog.query("select * from hour_max", READINGS, HOUR_MAX)
def max_by_epoch(spark, sf_dir):
    return agg.max_by_epoch(tables.hourly(tables.readings(spark, sf_dir)), "voltage")


@catalog.query(
    "select epoch - epoch % 3600 as epoch, max(temperature) as temperature from temperatures group by 1",
    TEMPERATURES,
)
def temperature_by_epoch(spark, sf_dir):
    return agg.single_temperature(tables.hourly(tables.temperatures(spark, sf_dir)))


@catalog.query(
    """select epoch - epoch % 3600 as epoch, round(avg(temperature), 6) as temperature
       from temperatures group by 1""",
    TEMPERATURES,
)
def temperature_mean_by_epoch(spark, sf_dir):
    return tidy(agg.single_temperature(tables.hourly(tables.temperatures(spark, sf_dir)), "avg"))


@catalog.query(
    "select subject, max(epoch) as epoch, max(voltage) as voltage from readings group by subject",
    READINGS,
)
def max_by_subject(spark, sf_dir):
    return agg.max_by_subject(tables.readings(spark, sf_dir), "voltage")


@catalog.query("select event_id, subject, epoch, voltage from readings where voltage > 120", READINGS)
def off_limits(spark, sf_dir):
    rows = tables.readings(spark, sf_dir).select("event_id", "subject", "epoch", "voltage")
    return agg.off_limits(rows, "voltage")


@catalog.query(
    """select subject, min(epoch) as epoch, count(*) as n from readings where voltage > 120
       group by subject""",
    READINGS,
)
def off_limit_count(spark, sf_dir):
    return agg.off_limit_count(tables.readings(spark, sf_dir), "voltage")


@catalog.query(
    """select subject, epoch - epoch % 86400 as day, min(epoch) as epoch, count(*) as n
       from readings where voltage > 120 group by 1, 2 having count(*) >= 2""",
    READINGS,
)
def alerts(spark, sf_dir):
    rows = tables.readings(spark, sf_dir)
    daily = rows.withColumn("day", timeparts.bucket_start(F.col("epoch"), DAY))
    return agg.alerts(daily, "voltage", ("subject", "day"))


@catalog.query("select line, count(*) as n from readings group by line", READINGS)
def count_by_line(spark, sf_dir):
    return agg.count_by(tables.readings(spark, sf_dir), "line")


@catalog.query("select line, count(*) as n from readings_big group by line", READINGS_BIG)
def count_by_line_big(spark, sf_dir):
    return tidy(agg.count_by(tables.readings_big(spark, sf_dir), "line"))


@catalog.query("select count(*) as n from readings", READINGS)
def total_count(spark, sf_dir):
    return agg.total_count(tables.readings(spark, sf_dir))


@catalog.query(
    f"""select line, transformer, {DAY_PARTS}, round(avg(voltage), 6) as voltage_avg
        from readings group by all""",
    READINGS,
)
def daily_avg(spark, sf_dir):
    return tidy(averages.average_voltage(tables.readings(spark, sf_dir)))


@catalog.query(
    """select line, cast(year(ts) as bigint) as year, cast(month(ts) as bigint) as month,
              round(avg(voltage), 6) as voltage_avg
       from readings_big group by all""",
    READINGS_BIG,
)
def monthly_avg_big(spark, sf_dir):
    rows = tables.readings_big(spark, sf_dir)
    return tidy(averages.average_voltage(rows, averages.MONTH_KEYS))


@catalog.query(
    f"""select line, transformer, {DAY_PARTS}, round(avg(voltage), 6) as voltage_avg
        from readings_big group by all""",
    READINGS_BIG,
)
def daily_avg_big(spark, sf_dir):
    return tidy(averages.average_voltage(tables.readings_big(spark, sf_dir)))


@catalog.query(
    """select epoch - epoch % 3600 as bucket, round(avg(temperature), 6) as temperature
       from temperatures group by 1""",
    TEMPERATURES,
)
def bucket_mean(spark, sf_dir):
    return tidy(buckets.bucket_mean(tables.temperatures(spark, sf_dir), "temperature", HOUR))


@catalog.query(
    """select epoch - epoch % 3600 as bucket, arg_max(temperature, struct_pack(a := ts, b := event_id)) as temperature
       from temperatures group by 1""",
    TEMPERATURES,
)
def bucket_last(spark, sf_dir):
    return buckets.bucket_last(tables.temperatures(spark, sf_dir), "temperature", HOUR, LAST)


@catalog.query(
    "select distinct epoch - epoch % 86400 as bucket, voltage from readings", READINGS
)
def bucket_distinct(spark, sf_dir):
    return buckets.bucket_distinct(tables.readings(spark, sf_dir), "voltage", DAY)


@catalog.query(
    "select line, epoch - epoch % 3600 as bucket, count(*) as n from readings group by 1, 2", READINGS
)
def bucket_count(spark, sf_dir):
    return buckets.bucket_count(tables.readings(spark, sf_dir), HOUR, ("line",))


def _by_day(spark, sf_dir):
    rows = tables.readings(spark, sf_dir)
    return rows.select(
        "line", timeparts.bucket_start(F.col("epoch"), DAY).alias("bucket"), "voltage"
    )


@catalog.query(
    """select line, epoch - epoch % 86400 as bucket, round(median(voltage), 6) as median
       from readings group by 1, 2""",
    READINGS,
)
def bucket_median(spark, sf_dir):
    return tidy(percentiles.median(_by_day(spark, sf_dir), "voltage", ["line", "bucket"], "median"))


@catalog.query(
    """select line, epoch - epoch % 86400 as bucket, round(quantile_cont(voltage, 0.9), 6) as p90
       from readings group by 1, 2""",
    READINGS,
)
def bucket_p90(spark, sf_dir):
    return tidy(
        percentiles.percentile(_by_day(spark, sf_dir), "voltage", 0.9, ["line", "bucket"], "p90")
    )


@catalog.query(
    """select line, round(quantile_cont(voltage, 0.9), 6) as p90 from readings_big group by 1""",
    READINGS_BIG,
)
def p90_by_rank_big(spark, sf_dir):
    rows = tables.readings_big(spark, sf_dir)
    return tidy(percentiles.percentile_by_rank(rows, "voltage", 0.9, ["line"], "p90"))


@catalog.query(
    """select usage_point, arg_max(voltage, struct_pack(a := ts, b := event_id)) as current,
              min(voltage) as min, max(voltage) as max
       from readings group by 1""",
    READINGS,
)
def tag_summary(spark, sf_dir):
    return agg.tag_summary(tables.readings(spark, sf_dir), "usage_point", "voltage", LAST)


@catalog.query(
    """select '{' || string_agg('"' || line || '":' || n, ',' order by line) || '}' as counts
       from (select line, count(*) as n from readings group by line)""",
    READINGS,
)
def count_map_json(spark, sf_dir):
    counts = agg.count_by(tables.readings(spark, sf_dir), "line")
    text = counts.select(F.concat(F.lit(" "), "line", F.lit(" | "), "n").alias("text"))
    return metrics.counts_as_json(metrics.counter_lines(text, "text"))


@catalog.query("select count(*) as write_count from readings", READINGS)
def write_count_sum(spark, sf_dir):
    counts = agg.count_by(tables.readings(spark, sf_dir), "transformer")
    text = counts.select(F.concat(F.lit("\t\tLocal write count: "), "n").alias("text"))
    return metrics.write_counts(text, "text")


@catalog.query("select epoch, voltage, voltage > 116 as breach from hour_max", READINGS, HOUR_MAX)
def threshold_breach(spark, sf_dir):
    return buckets.threshold_breach(max_by_epoch(spark, sf_dir), "voltage", 116.0)


@catalog.query(
    """select event_id, cast(floor(epoch(ts)) as bigint) as epoch, value from events
       where ts >= (select max(ts) - interval 6 hours from events)"""
)
def time_range(spark, sf_dir):
    recent = buckets.since(tables.events(spark, sf_dir), "ts", 6 * HOUR)
    return recent.select("event_id", tables.epoch_of("ts").alias("epoch"), "value")


FINE = """fine as (
    select name, epoch - epoch % 600 as bucket, arg_max(value, epoch) as value from metrics group by 1, 2),
coarse as (
    select name, bucket - bucket % 3600 as slot, min(value) as lo, max(value) as hi,
           sum(value) as total, avg(value) as mean, count(value) as known
    from fine group by 1, 2),
rolled as (
    select name, slot, known, case
        when regexp_matches(name, '\\.lower$') then case when known / 6.0 >= 0.1 then lo end
        when regexp_matches(name, '\\.upper(_\\d+)?$') then case when known / 6.0 >= 0.1 then hi end
        when regexp_matches(name, '\\.sum$') then total
        when regexp_matches(name, '\\.count$') then total
        when regexp_matches(name, '^stats_counts.*') then total
        else case when known / 6.0 >= 0.3 then mean end end as value
    from coarse)"""




@catalog.query(
    "select name, slot, known, round(value, 6) as value from rolled", FLUSHED, METRICS, FINE
)
def rollup_rules(spark, sf_dir):
    return tidy(buckets.rollup(tables.metrics(spark, sf_dir), 600, HOUR))


@catalog.query(
    "select name, slot, known, round(value, 6) as value from rolled", FLUSHED, METRICS, FINE
)
def rollup_incremental(spark, sf_dir):
    """The points landed in no order of time and rolled up two files a batch; late ones reopen their slots."""
    landing, root = scratch(spark, "points"), scratch(spark, "tiers")
    tables.metrics(spark, sf_dir).repartition(6).write.parquet(landing)
    points = messages.message_files(spark, landing, "name string, epoch bigint, value double", 2)
    runner.drain(points, tiers.store_tiers(root, 600, HOUR), scratch(spark, "progress"))
    return tidy(tiers.read_coarse(spark, root, 600, HOUR))


@catalog.query(
    """select name, seconds, epoch - epoch % seconds as slot, count(*) as n, true as within
       from (select event_type as name, cast(floor(epoch(ts)) as bigint) as epoch from events where value is not null),
            (select unnest([3600, 86400, 2419200]) as seconds)
       group by 1, 2, 3"""
)
def p90_sketch_tiers(spark, sf_dir):
    """Sketches of ten minutes, stored batch by batch and merged into hours, days and four weeks; each
    merged percentile is held against the exact ranks of all values of its slot."""
    landing, root = scratch(spark, "points"), scratch(spark, "tiers")
    points = tables.events(spark, sf_dir).select(
        F.col("event_type").alias("name"), tables.epoch_of("ts").alias("epoch"), "value"
    )
    points.repartition(6).write.parquet(landing)
    stream = messages.message_files(spark, landing, "name string, epoch bigint, value double", 2)
    runner.drain(stream, tiers.store_sketches(root, 600), scratch(spark, "progress"))
    checked = []
    for seconds in (HOUR, DAY, tiers.LAYOUT):
        known = tiers.read_percentile(spark, root, seconds, 0.9)
        slots = points.withColumn("slot", timeparts.bucket_start(F.col("epoch"), seconds))
        within = percentiles.rank_within(
            slots, known.withColumnRenamed("value", "p90"), "value", "p90", 0.9, ["name", "slot"]
        )
        same = within.withColumnRenamed("n", "_n").join(known.drop("value"), ["name", "slot"], "full")
        checked.append(same.select(
            "name", F.lit(seconds).cast("long").alias("seconds"), "slot", "n",
            (F.col("within") & (F.col("n") == F.col("_n"))).alias("within"),
        ))
    return checked[0].unionAll(checked[1]).unionAll(checked[2])


@catalog.query(
    """select 'fine' as tier, name, epoch, round(value, 6) as value from metrics
       where epoch >= (select cast(floor(max(epoch(ts))) as bigint) - 86400 from events)
       union all
       select 'coarse', name, slot, round(value, 6) from rolled
       where slot >= (select cast(floor(max(epoch(ts))) as bigint) - 7 * 86400 from events)""",
    FLUSHED, METRICS, FINE,
)
def retention_filter(spark, sf_dir):
    rows = tables.events(spark, sf_dir)
    now = tables.epoch_of(rows.agg(F.max("ts")).scalar())

    def points(seconds):
        # Also cut at the scan; a second is added for the fraction of the newest time.
        return tables.as_metrics(buckets.since(rows, "ts", seconds + 1))

    rolled = buckets.rollup(points(7 * DAY), 600, HOUR)
    coarse = rolled.select("name", F.col("slot").alias("epoch"), "value")
    kept = {"fine": (points(DAY), DAY), "coarse": (coarse, 7 * DAY)}
    return tidy(buckets.retain(kept, "epoch", now))


@catalog.query(
    """select usage_point, epoch, voltage, recency from (
           select *, row_number() over (partition by usage_point order by ts desc, event_id desc) as recency
           from readings)
       where recency <= 3""",
    READINGS,
)
def latest_per_point(spark, sf_dir):
    newest = upserts.newest_rows(tables.readings(spark, sf_dir), ["usage_point"], LAST, 3)
    return tidy(newest.select("usage_point", "epoch", "voltage", "recency"))


@catalog.query(
    """select usage_point, epoch, voltage from (
           select *, row_number() over (partition by usage_point
                                        order by ts desc, reading_id desc, voltage desc) as recency
           from readings_big)
       where recency = 1""",
    READINGS_BIG,
)
def latest_per_point_big(spark, sf_dir):
    order = ["ts", "reading_id", "voltage"]
    newest = upserts.newest_rows(tables.readings_big(spark, sf_dir), ["usage_point"], order)
    return newest.select("usage_point", "epoch", "voltage")


@catalog.query(
    "select event_id, subject, epoch, voltage from readings order by ts, event_id limit 10", READINGS
)
def limit_rows(spark, sf_dir):
    first = upserts.limit_rows(tables.readings(spark, sf_dir), LAST)
    return first.select("event_id", "subject", "epoch", "voltage")


@catalog.query(
    """select '{"epoch":' || epoch || ',"voltage":' || cast(voltage as varchar) || '}' as message
       from hour_max""",
    READINGS, HOUR_MAX,
)
def max_report_json(spark, sf_dir):
    return reports.json_report(max_by_epoch(spark, sf_dir), "voltage")


@catalog.query(
    """select 'report.' || subject as subject, cast(cast(max(voltage) as float) as varchar) as message
       from readings group by readings.subject""",
    READINGS,
)
def text_report(spark, sf_dir):
    maxima = max_by_subject(spark, sf_dir).withColumn("voltage", F.col("voltage").cast("float"))
    subject = subjects.report_subject(F.concat(F.lit("extract."), "subject"))
    return reports.text_report(maxima, "voltage", subject)
