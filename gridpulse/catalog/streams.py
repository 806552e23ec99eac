"""Stream jobs drained over the stored events, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.payloads import decode_wide_reading
from ..functions.timeparts import HOUR_SECONDS
from ..session import scratch
from ..sinks import reports
from ..sinks import tables as stored
from ..sources import framed, messages, metrics, tables
from ..streaming import jobs, runner, state
from .base import READINGS, TEMPERATURES, TIME_PARTS, Catalog, tidy

catalog = Catalog()

# A stored table comes in any file order, so no row of it counts as late.
WHOLE_TABLE = None
LANDED_FILES = 6


def _events(spark, sf_dir):
    return messages.table_stream(tables.use_utc(spark), sf_dir, "events", tables.EVENTS_SCHEMA)


def _readings(spark, sf_dir):
    return tables.as_readings(_events(spark, sf_dir)).withColumn(
        "event_time", F.col("ts").cast("timestamp")
    )


def _drain(spark, stream, handler, mode="append"):
    runner.drain(stream, handler, scratch(spark, "progress"), mode)


@catalog.query(
    """select subject, epoch, round(cast(cast(voltage as float) as double), 6) as value from readings""",
    READINGS,
)
def stream_keyed_source(spark, sf_dir):
    path = scratch(spark, "keyed")
    decoded = messages.keyed(tables.as_messages(_events(spark, sf_dir)), "raw.voltage.data.>")
    _drain(spark, decoded, jobs.store_updates(path))
    return tidy(spark.read.parquet(path).drop(stored.BATCH))


@catalog.query(
    """select epoch, round(cast(cast(temperature as float) as double), 6) as value from temperatures""",
    TEMPERATURES,
)
def stream_unkeyed_source(spark, sf_dir):
    path = scratch(spark, "unkeyed")
    decoded = messages.unkeyed(tables.as_messages(_events(spark, sf_dir)), tables.TEMPERATURE_SUBJECT)
    _drain(spark, decoded, jobs.store_updates(path))
    return tidy(spark.read.parquet(path).drop(stored.BATCH))


@catalog.query(
    """select subject, epoch, round(cast(cast(voltage as float) as double), 6) as value from readings""",
    READINGS,
)
def stream_framed_source(spark, sf_dir):
    """Messages published to framed logs, then read from them as a stream of its own offsets."""
    logs, path = scratch(spark, "logs"), scratch(spark, "keyed")
    sent = tables.as_messages(_events(spark, sf_dir))
    framed.publish_framed(sent, logs, scratch(spark, "progress")).awaitTermination()
    decoded = messages.keyed(framed.framed_stream(spark, logs), "raw.voltage.data.>")
    _drain(spark, decoded, jobs.store_updates(path))
    return tidy(spark.read.parquet(path).drop(stored.BATCH))


@catalog.query(
    """select 'report.voltage.max.' || subject as subject, cast(cast(max(voltage) as float) as varchar) as message
       from readings group by subject""",
    READINGS,
)
def stream_published(spark, sf_dir):
    """Maxima of every subject published to framed logs as they change, every batch twice; the largest counts."""
    logs, landing = scratch(spark, "logs"), scratch(spark, "landing")
    readings = tables.readings(spark, sf_dir).select("subject", "epoch", F.col("voltage").alias("value"))
    readings.repartition(LANDED_FILES).write.parquet(landing)
    stream = messages.message_files(spark, landing, "subject string, epoch bigint, value double", 2)

    def publish(batch, batch_id):
        subject = F.concat(F.lit("report.voltage.max."), "subject")
        sent = reports.text_report(batch.withColumn("value", F.col("value").cast("float")), "value", subject)
        sent = sent.select("subject", F.encode("message", "UTF-8").alias("payload"))
        sent = sent.persist()  # repeating the batch does not repeat its states
        try:
            for _ in range(2):
                framed.publish_framed_batch(sent, logs, batch_id)
        finally:
            sent.unpersist()

    _drain(spark, state.subject_states(stream), publish, "update")
    text = F.decode("payload", "UTF-8")
    return framed.framed_table(spark, logs).groupBy("subject").agg(F.max_by(text, text.cast("float")).alias("message"))


@catalog.query(
    """select subject, max(epoch) as epoch, max(voltage) as voltage from readings group by subject""",
    READINGS,
)
def stream_batch_reduce(spark, sf_dir):
    """Batches reduced on their own; the reader folds what they found of a subject."""
    path = scratch(spark, "reduced")
    reduce = jobs.reduce_each_batch(path, lambda batch: jobs.agg.max_by_subject(batch, "voltage"))
    _drain(spark, _readings(spark, sf_dir), reduce)
    return tidy(jobs.agg.max_by_subject(stored.read_batches(spark, path), "voltage"))


@catalog.query(
    """select epoch - epoch % 3600 as bucket, max(voltage) as voltage from readings group by 1""",
    READINGS,
)
def stream_window_max(spark, sf_dir):
    path = scratch(spark, "windows")
    hours = jobs.windowed_max(
        _readings(spark, sf_dir), "voltage", width=f"{HOUR_SECONDS} seconds", lateness=WHOLE_TABLE
    )
    _drain(spark, hours, jobs.store_updates(path), "update")
    return stored.read_folded(spark, path, ["bucket"], "voltage")


@catalog.query(
    """select subject, epoch - epoch % 86400 as bucket, min(epoch) as epoch, count(*) as n
       from readings where voltage > 120 group by 1, 2 having count(*) >= 2""",
    READINGS,
)
def stream_alerts(spark, sf_dir):
    path = scratch(spark, "alerts")
    found = jobs.windowed_alerts(
        _readings(spark, sf_dir), "voltage", ["subject"], width="1 day", lateness=WHOLE_TABLE
    )
    _drain(spark, found, jobs.store_updates(path), "update")
    newest = stored.latest_by_key(
        stored.read_batches(spark, path), ["subject", "bucket"], [stored.BATCH]
    )
    return newest.drop(stored.BATCH)


@catalog.query(
    """select 'raw' as output, count(*) as n, round(sum(voltage), 6) as total from (
           select *, row_number() over (partition by usage_point, date_trunc('minute', ts)
                                        order by ts desc, event_id desc) as recency from readings)
       where recency = 1
       union all select 'counts', count(distinct line), count(*) from readings
       union all select 'max', count(*), round(sum(v), 6) from (
           select max(voltage) as v from readings group by epoch)
       union all select 'report', count(*), round(sum(v), 6) from (
           select max(voltage) as v from readings group by epoch)""",
    READINGS,
)
def stream_multi_sink(spark, sf_dir):
    root = scratch(spark, "jobs")
    _drain(spark, _readings(spark, sf_dir), jobs.store_readings(root))
    raw = stored.read_upserts(
        spark, f"{root}/raw", jobs.POINT_KEY, ["ts", "event_id"], newest="order"
    )
    counts = stored.read_counters(spark, f"{root}/counts", ["line"])
    maxima = stored.read_folded(spark, f"{root}/max", ["epoch"], "voltage")
    # An epoch spread over batches is reported by each of them; together they give its maximum.
    reported = metrics.ingest_json(
        spark.read.parquet(f"{root}/max_report"), "message",
        {"epoch": "bigint", "voltage": "double"}, "max_voltage",
    )
    report = jobs.agg.max_by_epoch(reported, "voltage")
    outputs = [
        ("raw", raw, F.col("voltage")),
        ("counts", counts, F.col("n")),
        ("max", maxima, F.col("voltage")),
        ("report", report, F.col("voltage")),
    ]
    parts = [
        df.agg(F.count("*").alias("n"), F.sum(v).cast("double").alias("total")).select(
            F.lit(name).alias("output"), "n", "total"
        )
        for name, df, v in outputs
    ]
    return tidy(parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3]))


@catalog.query(
    f"""select line, transformer, usage_point, {TIME_PARTS}, epoch,
               round(cast(cast(voltage as float) as double), 6) as voltage,
               round(cast(cast(voltage + 11 as float) as double), 6) as val12, slot_count
        from (select *, row_number() over (partition by usage_point, date_trunc('minute', ts)
                                           order by epoch desc, voltage desc) as recency,
                     count(*) over () as slot_count
              from readings)
        where recency = 1""",
    READINGS,
)
def stream_raw_bridge(spark, sf_dir):
    """Wide binary messages to the wide raw table, with the number counted for the slot."""
    root = scratch(spark, "bridge")
    decoded = messages.point_readings(
        tables.as_wide_messages(_events(spark, sf_dir)), "raw.voltage.data.>", decode_wide_reading
    )
    _drain(spark, decoded, jobs.store_messages(root, "1"))
    raw = stored.read_upserts(
        spark, f"{root}/raw", jobs.POINT_KEY, ["epoch", "voltage"], newest="order"
    )
    counted = stored.read_counters(spark, f"{root}/counts", ["slot"])
    return tidy(
        raw.select(
            *jobs.POINT_KEY, "day_of_week", "epoch", "voltage", "val12",
            counted.filter(F.col("slot") == "1").select("n").scalar().alias("slot_count"),
        )
    )


@catalog.query(
    """select 'max' as output, 'report.voltage.max.' || subject as subject, cast(cast(max(voltage) as float) as varchar) as message
       from readings group by subject
       union all
       select 'alert', 'report.voltage.alert.' || subject, cast(count(*) as varchar) from readings
       where cast(voltage as float) > 120 group by subject having count(*) >= 2""",
    READINGS,
)
def stream_alert_job(spark, sf_dir):
    """The alert job from binary messages to its text reports."""
    root = scratch(spark, "alert-job")
    decoded = messages.keyed(tables.as_messages(_events(spark, sf_dir)), "raw.voltage.data.>")
    _drain(spark, state.subject_states(decoded), jobs.publish_states(root), "update")
    texts = [
        reports.newest(spark, f"{root}/{folder}").select(F.lit(name).alias("output"), "subject", "message")
        for name, folder in (("max", "subject_max_text"), ("alert", "alert_text"))
    ]
    return texts[0].unionAll(texts[1])


@catalog.query(
    """select subject, max(epoch) as epoch, max(voltage) as value,
              count(*) filter (voltage > 120) as n, min(epoch) filter (voltage > 120) as first_epoch,
              count(*) filter (voltage > 120) >= 2 as alert
       from readings group by subject""",
    READINGS,
)
def stream_alerts_stateful(spark, sf_dir):
    """The readings landed as files and taken two files a batch; the state joins what batches cut apart."""
    landing, path = scratch(spark, "landing"), scratch(spark, "states")
    readings = tables.readings(spark, sf_dir).select("subject", "epoch", F.col("voltage").alias("value"))
    readings.repartition(LANDED_FILES).write.parquet(landing)
    stream = messages.message_files(spark, landing, "subject string, epoch bigint, value double", 2)
    _drain(spark, state.subject_states(stream), jobs.store_updates(path), "update")
    newest = stored.latest_by_key(stored.read_batches(spark, path), ["subject"], [stored.BATCH])
    return tidy(newest.drop(stored.BATCH)).withColumn("alert", F.col("n") >= jobs.agg.OFF_LIMIT_COUNT)


@catalog.query(
    """select epoch - epoch % 3600 as epoch, max(temperature) as temperature from temperatures group by 1""",
    TEMPERATURES,
)
def stream_temperatures(spark, sf_dir):
    root = scratch(spark, "temperatures")
    stream = tables.hourly(tables.as_temperatures(_events(spark, sf_dir)))
    _drain(spark, stream, jobs.store_temperatures(root))
    return stored.read_folded(spark, f"{root}/temperature", ["epoch"], "temperature")


@catalog.query(
    """select epoch - epoch % 3600 as epoch, round(avg(temperature), 6) as temperature from temperatures group by 1""",
    TEMPERATURES,
)
def stream_temperature_means(spark, sf_dir):
    """Hours spread over several batches: their sums and counts give the mean of all their rows."""
    root, landing = scratch(spark, "means"), scratch(spark, "landing")
    rows = tables.hourly(tables.temperatures(spark, sf_dir)).select("epoch", "temperature")
    rows.repartition(LANDED_FILES).write.parquet(landing)
    stream = messages.message_files(spark, landing, "epoch bigint, temperature double", 2)
    _drain(spark, stream, jobs.store_temperatures(root, how="avg"))
    return tidy(stored.read_means(spark, f"{root}/temperature", ["epoch"], "temperature"))
