"""All programs one after the other on the same folder."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridpulse import apps, session
from gridpulse.functions import payloads
from gridpulse.sinks import tables
from gridpulse.streaming.jobs import POINT_KEY

START = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp())


@pytest.fixture(scope="module")
def folder(spark):
    """Ten days of hourly messages: two points that follow the hour, temperatures, forecasts."""
    landed = session.scratch(spark, "app-messages")
    hours = spark.range(240).select((F.col("id") * 3600 + START).alias("epoch"), (F.col("id") % 24).alias("hour"))
    volts = F.when(F.col("hour") >= 12, 118.0).otherwise(112.0)
    parts = [
        hours.select(F.lit("raw.voltage.data.1.2.3").alias("subject"), "epoch", volts.alias("v")),
        hours.select(F.lit("raw.voltage.data.1.2.4").alias("subject"), "epoch", (volts + 2.5).alias("v")),
        hours.select(F.lit("raw.temperature.data").alias("subject"), "epoch", (F.col("hour") + 0.5).alias("v")),
        hours.select(F.lit("raw.temperature.forecast.12").alias("subject"), (F.col("epoch") + 43200).alias("epoch"), (F.col("hour") + 0.5).alias("v")),
    ]
    every = parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])
    every.select("subject", payloads.encode_long_float("epoch", F.col("v").cast("float")).alias("payload")).repartition(2).write.parquet(landed)
    return landed, session.scratch(spark, "app-tables")


def _run(folder, job, *more):
    landed, root = folder
    apps.main([job, "--root", root, "--messages", landed, "--once", *more])
    return root


def test_programs(spark, folder, rows, capfd):
    root = _run(folder, "max", "--log-level", "MAX")
    raw = tables.read_upserts(spark, f"{root}/raw", POINT_KEY, ["epoch"])
    assert raw.count() == 480
    assert rows(tables.read_counters(spark, f"{root}/counts", ["line"])) == [(1, 480)]
    maxima = tables.read_folded(spark, f"{root}/max", ["epoch"], "voltage")
    assert rows(maxima.select("voltage").distinct()) == [(114.5,), (120.5,)]
    assert tables.read_folded(spark, f"{root}/temperature", ["epoch"], "temperature").count() == 240

    _run(folder, "average")
    daily = spark.read.parquet(f"{root}/avg_voltage_by_transformer")
    assert daily.count() == 10
    assert {round(r.voltage_avg, 2) for r in daily.collect()} == {116.25}

    _run(folder, "alert", "--input", "raw.voltage.data.>")
    alerts = spark.read.parquet(f"{root}/alert").select(
        "subject", payloads.decode_long(F.col("payload")), payloads.decode_int(F.col("payload")))
    assert rows(alerts) == [("extract.voltage.alert.raw.voltage.data.1.2.4", START + 12 * 3600, 120)]

    _run(folder, "train", "--max-iter", "60")
    _run(folder, "predict")
    predicted = spark.read.parquet(f"{root}/prediction/batch_id=*")
    hours = {(r.epoch // 3600) % 24 for r in predicted.collect()}
    assert hours and predicted.count() <= 240

    _run(folder, "accuracy", "--max-iter", "60")
    out = capfd.readouterr().out
    assert "Size: 240" in out
    assert float(out.split("Test set accuracy = ")[1].split()[0]) > 0.8

    # A second run finds nothing new and changes nothing.
    _run(folder, "max")
    assert rows(tables.read_counters(spark, f"{root}/counts", ["line"])) == [(1, 480)]
