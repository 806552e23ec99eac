"""Scalar functions, subject filters and payload codecs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import casts, payloads, subjects, timeparts
from ..plans import prediction
from ..sinks import reports
from ..sources import messages as streams
from ..sources import metrics, tables
from ..operators import aggregates as agg
from .base import HOUR_MAX, READINGS, TEMPERATURES, TIME_PARTS, Catalog, tidy

catalog = Catalog()

MESSAGE_SUBJECTS = """messages as (
    select event_id, cast(floor(epoch(ts)) as bigint) as epoch, value,
           case when event_type = 'view' then 'raw.temperature.data'
                else 'raw.voltage.data.' || (user_id % 3) || '.' || (user_id % 10) || '.' || user_id
           end as subject
    from events)"""


@catalog.query(
    r"""select event_id, subject from messages
        where regexp_full_match(subject, 'raw\.[^.]+\.data\.1\.[^.]+(\.[^.]+)*')""",
    MESSAGE_SUBJECTS,
)
def subject_filter(spark, sf_dir):
    rows = tables.messages(spark, sf_dir).select("event_id", "subject")
    return rows.filter(subjects.subject_matches(F.col("subject"), "raw.*.data.1.>"))


@catalog.query(
    """select event_id, epoch, line, transformer, usage_point, voltage, subject from readings""",
    READINGS,
)
def raw_scan_sql(spark, sf_dir):
    tables.readings(spark, sf_dir).createOrReplaceTempView("raw_readings")
    return spark.sql(
        "select event_id, epoch, line, transformer, usage_point, voltage, subject from raw_readings"
    )


@catalog.query(
    r"""select event_id, cast(floor(epoch(ts)) as bigint) as epoch, 'event_props' as measurement,
               cast(regexp_extract(props, '"k": *(\d+)', 1) as bigint) as k
        from events"""
)
def json_ingest(spark, sf_dir):
    rows = tables.events(spark, sf_dir).withColumn("epoch", tables.epoch_of("ts"))
    return metrics.ingest_json(rows, "props", {"k": "bigint"}, "event_props", ("event_id", "epoch"))


@catalog.query(
    r"""select event_id, 'event_props' as measurement, 'k' as field,
               cast(regexp_extract(props, '"k": *(\d+)', 1) as double) as value
        from events where regexp_matches(props, '"k": *\d')
        union all
        select event_id, 'reading', unnest(['epoch', 'line', 'usage_point', 'voltage']),
               unnest([cast(epoch as double), line, usage_point, voltage])
        from readings""",
    READINGS,
)
def json_ingest_variant(spark, sf_dir):
    """Two kinds of JSON messages in one column, ingested without naming their fields."""
    props = tables.events(spark, sf_dir).select("event_id", F.lit("event_props").alias("kind"), "props")
    body = F.to_json(F.struct("epoch", "subject", "line", "usage_point", "voltage"))
    readings = tables.readings(spark, sf_dir).select("event_id", F.lit("reading"), body)
    return tidy(metrics.json_points(props.unionAll(readings), "props", F.col("kind"), ("event_id",)))


@catalog.query(
    """select event_id, 'telemetry.local.' || event_type || '.voltage.value' as path from events"""
)
def metric_path(spark, sf_dir):
    path = subjects.metric_path(
        F.lit("telemetry"), F.lit("local"), F.col("event_type"), F.lit("voltage"), F.lit("value")
    )
    return tables.events(spark, sf_dir).select("event_id", path.alias("path"))


@catalog.query(
    """select event_id, path, split_part(path, '.', 3) as node
       from (select event_id, 'telemetry.local.' || event_type || '.voltage.value' as path from events)
       where regexp_full_match(path, 'telemetry[.]local[.][^.]*o[^.]*[.]voltage[.]value')"""
)
def path_node(spark, sf_dir):
    paths = metric_path(spark, sf_dir)
    wanted = paths.filter(subjects.path_matches(F.col("path"), "telemetry.local.*o*.voltage.value"))
    return wanted.withColumn("node", subjects.path_node(F.col("path"), 2))


@catalog.query(
    """select event_id, subject, epoch, round(cast(cast(value as float) as double), 6) as value
       from messages""",
    MESSAGE_SUBJECTS,
)
def payload_decode(spark, sf_dir):
    decoded = tables.messages(spark, sf_dir).select(
        "event_id", "subject", *payloads.decode_reading(F.col("payload"))
    )
    return tidy(decoded)


@catalog.query(
    "select event_id, epoch, "
    + ", ".join(
        f"round(cast(cast(voltage + {i} as float) as double), 6) as {f}"
        for i, f in enumerate(payloads.WIDE_FIELDS)
    )
    + " from readings",
    READINGS,
)
def payload_decode_wide(spark, sf_dir):
    wide = tables.wide_messages(spark, sf_dir)
    return tidy(
        wide.select("event_id", payloads.decode_wide("payload").alias("d")).select("event_id", "d.*")
    )


@catalog.query(
    """select event_id, 12::bigint as n_bytes, epoch, round(cast(cast(value as float) as double), 6) as value
       from messages""",
    MESSAGE_SUBJECTS,
)
def binary_encode(spark, sf_dir):
    sent = tables.messages(spark, sf_dir).select(
        "event_id",
        F.octet_length("payload").alias("n_bytes"),
        *payloads.decode_reading(F.col("payload")),
    )
    return tidy(sent)


@catalog.query(
    """select 'max' as kind, epoch, round(cast(cast(voltage as float) as double), 6) as number from hour_max
       union all
       select 'alert', min(epoch), cast(count(*) as double) from readings where voltage > 120
       group by subject having count(*) >= 2
       union all
       select 'data', epoch, round(cast(cast(temperature as float) as double), 6) from temperatures""",
    READINGS,
    TEMPERATURES,
    HOUR_MAX,
)
def routed_decode(spark, sf_dir):
    rows = tables.readings(spark, sf_dir)
    maxima = reports.binary_values(
        agg.max_by_epoch(tables.hourly(rows), "voltage"), "voltage", F.lit("extract.voltage.max")
    )
    alerts = reports.binary_counts(agg.alerts(rows, "voltage"), "n", F.lit("extract.voltage.alert"))
    data = reports.binary_values(
        tables.temperatures(spark, sf_dir), "temperature", F.lit(tables.TEMPERATURE_SUBJECT)
    )
    sent = maxima.unionByName(alerts).unionByName(data)
    return tidy(sent.select(*payloads.decode_routed(F.col("subject"), F.col("payload"))))


@catalog.query("select event_id, subject, line, transformer, usage_point from readings", READINGS)
def subject_tokens(spark, sf_dir):
    rows = tables.readings(spark, sf_dir)
    return tidy(rows.select("event_id", "subject", *subjects.subject_tokens(F.col("subject"))))


@catalog.query(
    """select subject, 'extract.voltage.max' as max_subject, 'extract.temperature.max' as temperature_subject,
              'extract.voltage.alert' as alert_subject, 'report.voltage.max' as report_subject,
              'report.voltage.alert' as alert_report_subject
       from readings group by subject""",
    READINGS,
)
def subject_route(spark, sf_dir):
    base = F.lit("extract")
    out = subjects.append_token(base, "voltage.max")
    alert = subjects.alert_subject(out)
    return (
        agg.max_by_subject(tables.readings(spark, sf_dir), "voltage")
        .select(
            "subject",
            out.alias("max_subject"),
            subjects.append_token(base, "temperature.max").alias("temperature_subject"),
            alert.alias("alert_subject"),
            subjects.report_subject(out).alias("report_subject"),
            subjects.report_subject(alert).alias("alert_report_subject"),
        )
    )


@catalog.query(f"select event_id, {TIME_PARTS} from readings", READINGS)
def calendar_parts(spark, sf_dir):
    rows = tables.readings(spark, sf_dir)
    return tidy(rows.select("event_id", *timeparts.calendar_parts(F.col("epoch"))))


@catalog.query(
    """select event_id, strftime(ts - interval 18 hours, '%Y-%m-%d %H:%M:%S') as local_time,
              cast(hour(ts - interval 18 hours) as bigint) as local_hour
       from readings""",
    READINGS,
)
def local_hour(spark, sf_dir):
    epoch = F.col("epoch")
    return tidy(
        tables.readings(spark, sf_dir).select(
            "event_id",
            F.date_format(timeparts.local_timestamp(epoch, -18), "yyyy-MM-dd HH:mm:ss").alias(
                "local_time"
            ),
            timeparts.local_hour(epoch, -18).alias("local_hour"),
        )
    )


ANGLE = "cast(cast(hour / 24.0 as float) as double) * 2 * pi()"


@catalog.query(
    f"""select event_id, hour, round(50 * sin({ANGLE}), 6) as hour_sin, round(50 * cos({ANGLE}), 6) as hour_cos
        from (select event_id, cast(hour(ts) as bigint) as hour from readings)""",
    READINGS,
)
def hour_features(spark, sf_dir):
    rows = tables.readings(spark, sf_dir)
    parts = prediction.date_features(F.col("epoch"))
    return tidy(rows.select("event_id", *parts).drop("day_of_week"))


@catalog.query(
    """select event_id, case when dayofweek(ts) in (0, 6) then 50::bigint else 0 end as weekend from readings""",
    READINGS,
)
def weekend_flag(spark, sf_dir):
    rows = tables.readings(spark, sf_dir)
    return tidy(rows.select("event_id", timeparts.weekend_flag(F.col("epoch")).alias("weekend")))


@catalog.query(
    """select event_id, case when voltage > 116 then 1::bigint else 0 end as label from readings""", READINGS
)
def threshold_label(spark, sf_dir):
    rows = tables.readings(spark, sf_dir)
    return tidy(rows.select("event_id", prediction.threshold_label(F.col("voltage")).alias("label")))


@catalog.query(
    """select event_id, '{"timestamp":' || (epoch * 1000) || ',"temperature":' || cast(temperature as varchar)
              || ',"alert":116.0}' as message
       from temperatures""",
    TEMPERATURES,
)
def prediction_json(spark, sf_dir):
    message = reports.prediction_json(F.col("epoch"), F.col("temperature"), 116.0)
    return tables.temperatures(spark, sf_dir).select("event_id", message.alias("message"))


@catalog.query(
    """select event_id, coalesce(cast(try_cast(line as tinyint) as bigint), -1) as line,
              coalesce(cast(try_cast(usage_point as tinyint) as bigint), -1) as point_byte,
              coalesce(cast(try_cast(event_id as smallint) as bigint), -1) as id_short,
              coalesce(cast(try_cast(epoch as integer) as bigint), -1) as epoch_int,
              coalesce(cast(try_cast(epoch * 1000 as integer) as bigint), -1) as millis_int
       from readings""",
    READINGS,
)
def narrow_types(spark, sf_dir):
    narrow = {
        "line": casts.narrow(F.col("line"), "tinyint"),
        "point_byte": casts.narrow(F.col("usage_point"), "tinyint"),
        "id_short": casts.narrow(F.col("event_id"), "smallint"),
        "epoch_int": casts.narrow(F.col("epoch"), "int"),
        "millis_int": casts.narrow(F.col("epoch") * 1000, "int"),
    }
    shown = [F.coalesce(c, F.lit(-1)).alias(name) for name, c in narrow.items()]
    return tidy(tables.readings(spark, sf_dir).select("event_id", *shown))


@catalog.query(
    """select event_id, 1704067200 + (epoch - 1704067200) * 900 as scaled_epoch from readings""", READINGS
)
def time_rescale(spark, sf_dir):
    scaled = timeparts.time_rescale(F.col("epoch"), 1704067200)
    return tables.readings(spark, sf_dir).select("event_id", scaled.alias("scaled_epoch"))


@catalog.query(
    """select subject, epoch, round(cast(cast(voltage as float) as double), 6) as value from readings
       where line = 2 and transformer = 7""",
    READINGS,
)
def keyed_messages(spark, sf_dir):
    rows = streams.keyed(tables.messages(spark, sf_dir), "raw.voltage.data.2.7.*")
    return tidy(rows)
