import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridpulse import session
from gridpulse.functions import payloads
from gridpulse.operators import aggregates as agg
from gridpulse.sinks import reports, tables
from gridpulse.sources import messages
from gridpulse.streaming import jobs, runner, state

START = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp())
SCHEMA = "event_id bigint, subject string, epoch bigint, voltage double, line int, transformer int, usage_point int"


def _readings(spark, n=400):
    i = F.col("id")
    return spark.range(n).select(
        i.alias("event_id"),
        F.concat(F.lit("raw.voltage.data.1.2."), i % 7).alias("subject"),
        (i * 13 % 600 + START).alias("epoch"),
        (i * 37 % 50 + 90).cast("double").alias("voltage"),
        F.lit(1).alias("line"), F.lit(2).alias("transformer"), (i % 7).cast("int").alias("usage_point"),
    )


@pytest.fixture
def landed(spark):
    """The same readings, landed as four files in time order of the ids."""
    path = session.scratch(spark, "landed")
    df = _readings(spark)
    for k in range(4):
        df.filter((F.col("event_id") >= k * 100) & (F.col("event_id") < (k + 1) * 100)).coalesce(1).write.mode(
            "append").parquet(path)
    return path


def _stream(spark, path, per_batch=1):
    df = messages.message_files(spark, path, SCHEMA, per_batch)
    return df.withColumn("ts", F.timestamp_seconds("epoch")).withColumn("event_time", F.col("ts"))


def _drain(spark, stream, handler, mode="append"):
    runner.drain(stream, handler, session.scratch(spark, "progress"), mode)


def test_each_batch_is_reduced_on_its_own(spark, landed, rows):
    path = session.scratch(spark, "out")
    _drain(spark, _stream(spark, landed), jobs.reduce_each_batch(path, lambda b: agg.count_by(b, "subject")))
    out = tables.read_batches(spark, path)
    assert out.select("batch_id").distinct().count() == 4
    assert out.agg(F.sum("n")).first()[0] == 400


def test_all_outputs_equal_the_batch_result(spark, landed, rows):
    root = session.scratch(spark, "jobs")
    _drain(spark, _stream(spark, landed), jobs.store_readings(root))
    batch = _readings(spark).withColumn("ts", F.timestamp_seconds("epoch"))
    raw = tables.read_upserts(spark, f"{root}/raw", jobs.POINT_KEY, ["ts", "event_id"])
    # The last batch that touches a minute wins, and inside a batch the newest row.
    expected = (
        jobs.raw_rows(batch.withColumn("ts", F.col("ts")))
        .withColumn("batch", F.floor(F.col("event_id") / 100))
    )
    want = tables.latest_by_key(expected, jobs.POINT_KEY, ["batch", "ts", "event_id"])
    assert rows(raw, *jobs.POINT_KEY, "voltage") == rows(want, *jobs.POINT_KEY, "voltage")
    assert rows(tables.read_counters(spark, f"{root}/counts", ["line"])) == [(1, 400)]
    maxima = tables.read_folded(spark, f"{root}/max", ["epoch"], "voltage")
    assert rows(maxima) == rows(agg.max_by_epoch(batch, "voltage"))
    report = spark.read.parquet(f"{root}/max_report")
    assert {r.subject for r in report.select("subject").distinct().collect()} == {"extract.voltage.max"}


def test_restart_continues_without_double_counting(spark, landed, rows):
    path, progress = session.scratch(spark, "counts"), session.scratch(spark, "progress")

    def count(batch, batch_id):
        tables.increment_batch(batch, path, batch_id, ["line"])

    calls = []

    def failing(batch, batch_id):
        calls.append(batch_id)
        count(batch, batch_id)
        if batch_id == 2:
            raise RuntimeError("executor lost after the write")

    with pytest.raises(Exception):
        runner.drain(_stream(spark, landed), failing, progress)
    assert max(calls) == 2
    runner.drain(_stream(spark, landed), count, progress)
    assert rows(tables.read_counters(spark, path, ["line"])) == [(1, 400)]


def test_event_time_windows_equal_the_batch_result(spark, landed, rows):
    path = session.scratch(spark, "windows")
    windows = jobs.windowed_max(_stream(spark, landed), "voltage", width="60 seconds", lateness="1 hour")
    _drain(spark, windows, jobs.store_updates(path), "update")
    want = _readings(spark).groupBy((F.col("epoch") - F.col("epoch") % 60).alias("bucket")).agg(F.max("voltage"))
    assert rows(tables.read_folded(spark, path, ["bucket"], "voltage")) == rows(want)


def test_windowed_alerts_equal_the_batch_result(spark, landed, rows):
    path = session.scratch(spark, "alerts")
    found = jobs.windowed_alerts(_stream(spark, landed), "voltage", ["subject"], width="60 seconds", lateness="1 hour")
    _drain(spark, found, jobs.store_updates(path), "update")
    newest = tables.latest_by_key(tables.read_batches(spark, path), ["subject", "bucket"], ["batch_id"])
    daily = _readings(spark).withColumn("bucket", F.col("epoch") - F.col("epoch") % 60)
    want = agg.alerts(daily, "voltage", ("subject", "bucket"))
    assert rows(newest, "subject", "bucket", "epoch", "n") == rows(want)
    assert want.count() > 0


def _below(df, prefix):
    return df.withColumn("subject", F.concat(F.lit(prefix), "subject"))


def test_binary_alert_job(spark, rows):
    landed, root = session.scratch(spark, "messages"), session.scratch(spark, "alert-job")
    df = _readings(spark)
    df.select("subject", payloads.encode_long_float("epoch", F.col("voltage").cast("float")).alias("payload")).coalesce(1).write.parquet(landed)
    decoded = messages.keyed(messages.message_files(spark, landed), "raw.voltage.data.>")
    _drain(spark, decoded, jobs.publish_alerts(root))
    maxima = spark.read.parquet(f"{root}/subject_max").select("subject", *payloads.decode_reading(F.col("payload")))
    assert rows(maxima) == rows(agg.max_by_subject(_below(df, "extract.voltage.max."), "voltage"))
    alerts = spark.read.parquet(f"{root}/alert").select(
        "subject", payloads.decode_long(F.col("payload")), payloads.decode_int(F.col("payload")))
    assert rows(alerts) == rows(agg.alerts(_below(df, "extract.voltage.alert."), "voltage"))
    text = spark.read.parquet(f"{root}/subject_max_text")
    assert rows(text, "message") == [("139.0",)] * 7


def test_temperature_job(spark, rows):
    landed, root = session.scratch(spark, "messages"), session.scratch(spark, "temperature-job")
    spark.createDataFrame([(5, 1.5), (5, 2.5), (6, -1.0)], "epoch bigint, temperature double").coalesce(1).write.parquet(landed)
    stream = messages.message_files(spark, landed, "epoch bigint, temperature double")
    _drain(spark, stream, jobs.store_temperatures(root))
    assert rows(tables.read_folded(spark, f"{root}/temperature", ["epoch"], "temperature")) == [(5, 2.5), (6, -1.0)]
    assert rows(spark.read.parquet(f"{root}/temperature_report"), "subject", "message") == [
        ("extract.temperature.max", '{"epoch":5,"temperature":2.5}'),
        ("extract.temperature.max", '{"epoch":6,"temperature":-1.0}')]


def test_interval_trigger(spark, landed):
    seen = []
    query = runner.start(
        _stream(spark, landed, None), lambda b, i: seen.append(b.count()),
        session.scratch(spark, "progress"), interval="100 milliseconds")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert sum(seen) == 400


def test_raw_bridge_stores_wide_messages_and_counts_its_slot(spark, rows):
    landed, root = session.scratch(spark, "messages"), session.scratch(spark, "bridge")
    fields = F.struct(*[(F.col("voltage") + i).cast("float").alias(f) for i, f in enumerate(payloads.WIDE_FIELDS)])
    wide = _readings(spark).select("subject", payloads.encode_wide("epoch", fields).alias("payload"))
    wide.repartition(3).write.parquet(landed)
    decoded = messages.point_readings(
        messages.message_files(spark, landed, files_per_batch=1), "raw.voltage.data.>", payloads.decode_wide_reading)
    _drain(spark, decoded, jobs.store_messages(root, "3"))
    assert rows(tables.read_counters(spark, f"{root}/counts", ["slot"])) == [("3", 400)]
    raw = tables.read_upserts(spark, f"{root}/raw", jobs.POINT_KEY, ["epoch"])
    assert raw.count() == _readings(spark).select("subject", F.floor(F.col("epoch") / 60)).distinct().count()
    assert raw.filter(F.col("val12") != F.col("voltage") + 11).count() == 0
    assert dict(raw.dtypes)["line"] == "tinyint" and dict(raw.dtypes)["year"] == "smallint"


def test_a_wide_message_is_decoded_once(spark):
    df = spark.createDataFrame([("a.1.2.3", bytearray(56))], "subject string, payload binary")
    decoded = messages.point_readings(df, "a.>", payloads.decode_wide_reading)
    plan = decoded._jdf.queryExecution().executedPlan().toString()
    assert plan.count("decode_wide(") == 1


@pytest.mark.parametrize("per_batch", [1, 2, None])
def test_alert_states_do_not_depend_on_the_batches(spark, landed, rows, per_batch):
    path = session.scratch(spark, "states")
    stream = messages.message_files(spark, landed, SCHEMA, per_batch)
    _drain(spark, state.subject_states(stream, "voltage"), jobs.store_updates(path), "update")
    got = tables.latest_by_key(tables.read_batches(spark, path), ["subject"], ["batch_id"])
    beyond = F.col("voltage") > 120
    want = _readings(spark).groupBy("subject").agg(
        F.max("epoch").alias("epoch"), F.max("voltage").alias("value"),
        F.count_if(beyond).alias("n"), F.min(F.when(beyond, F.col("epoch"))).alias("first_epoch"),
    )
    assert rows(got, *want.columns) == rows(want)


def test_two_batches_raise_one_alert(spark, rows):
    path, root = session.scratch(spark, "landed"), session.scratch(spark, "published")
    parts = [[("a", 5, 130.0), ("b", 1, 200.0), (None, 1, 150.0)], [("a", 3, 121.0), ("b", 2, 120.0), (None, 2, None)], [("c", 9, None)]]
    for part in parts:
        spark.createDataFrame(part, "subject string, epoch bigint, value double").coalesce(1).write.mode("append").parquet(path)
    stream = messages.message_files(spark, path, "subject string, epoch bigint, value double", 1)
    _drain(spark, state.subject_states(stream), jobs.publish_states(root), "update")
    alerts = reports.newest(spark, f"{root}/alert_text")
    assert rows(alerts, "subject", "message") == [("report.voltage.alert.a", "2")]
    texts = dict(rows(reports.newest(spark, f"{root}/subject_max_text"), "subject", "message"))
    assert texts["report.voltage.max.a"] == "130.0" and texts["report.voltage.max.c"] is None


class Known:
    """The state of one key as Spark hands it over."""

    def __init__(self):
        self.value, self.hasTimedOut, self.timeout = None, False, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, ms):
        self.timeout = ms


def test_silent_subjects_are_forgotten():
    known, update = Known(), state._update(10)
    part = pd.DataFrame({"epoch": [4], "value": [130.0], "n": [1], "first_epoch": [4]})
    (first,) = update(("a",), iter([part]), known)
    assert known.value == (4, 130.0, 1, 4) and known.timeout == 10_000 and first["n"].tolist() == [1]
    known.hasTimedOut = True
    assert list(update(("a",), iter([]), known)) == [] and not known.exists
    known.hasTimedOut = False
    (again,) = update(("a",), iter([part]), known)
    assert again["n"].tolist() == [1]


def test_lasting_states_are_one_aggregate_with_the_same_values(spark, rows):
    schema = "subject string, epoch bigint, value double"
    parts = [("a", 5, 130.0), ("a", 3, 121.0), ("a", 1, float("nan")), ("b", 2, 120.0), ("b", None, 300.0),
             (None, 1, 150.0), (None, 2, None), ("c", None, None), ("d", 4, float("nan")), ("e", 7, float("inf"))]
    df = spark.createDataFrame(parts, schema).coalesce(1)
    by_key = {}
    for subject, *part in df.mapInArrow(state._partial(120.0), f"subject string, {state.KNOWN}").collect():
        part = [None if pd.isna(x) else x for x in part]
        by_key[subject] = state.merged(by_key.get(subject, (None, None, 0, None)), part)
    kept = state.subject_states(df, limit=120.0)
    assert rows(kept) == sorted(((k, *v) for k, v in by_key.items()), key=repr)
    assert dict(kept.dtypes) == {"subject": "string", "epoch": "bigint", "value": "double", "n": "bigint", "first_epoch": "bigint"}
    plan = kept._jdf.queryExecution().analyzed().toString()
    assert "InPandasWithState" not in plan and "MapInArrow" not in plan


@pytest.mark.parametrize("per_batch", [1, 2, None])
def test_means_do_not_depend_on_the_batches(spark, rows, per_batch):
    landed, root = session.scratch(spark, "landed"), session.scratch(spark, "means")
    parts = [[(1, 10.0), (1, 20.0), (2, None)], [(1, 90.0), (3, 4.0)], [(3, None), (3, 6.0)]]
    for part in parts:
        spark.createDataFrame(part, "epoch bigint, temperature double").coalesce(1).write.mode("append").parquet(landed)
    stream = messages.message_files(spark, landed, "epoch bigint, temperature double", per_batch)
    _drain(spark, stream, jobs.store_temperatures(root, how="avg"))
    means = tables.read_means(spark, f"{root}/temperature", ["epoch"], "temperature")
    assert rows(means) == [(1, 40.0), (2, None), (3, 5.0)]
