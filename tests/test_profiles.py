import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridpulse.functions import profiles


def jvm_hash(text):
    h = 0
    for c in text:
        h = (31 * h + ord(c)) & 0xFFFFFFFF
    return h - (1 << 32) if h >= 1 << 31 else h


def test_string_hash(spark):
    names = ["3.3.2", "1.1.1", "", "11.20.345678", "127.2147483647.2147483647", "polygenelubricants"]
    df = spark.createDataFrame([(n,) for n in names if n], "p string").coalesce(1)
    got = [r[0] for r in df.select(profiles.string_hash(F.col("p"))).collect()]
    assert got == [jvm_hash(n) for n in names if n]
    assert got[0] == 48520444


def test_every_class_has_its_kind(spark):
    df = spark.range(10).select(profiles.class_of(F.col("id")))
    assert [r[0] for r in df.collect()] == ["business"] * 3 + ["industry"] * 2 + ["consumer"] * 5


@pytest.mark.parametrize("kind", ["demand", "voltage"])
def test_curves_match_linear_interpolation(spark, kind):
    monday = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp())
    hours = spark.range(7 * 24).select((F.col("id") * 3600 + monday).alias("epoch"))
    for usage in ("business", "industry", "consumer"):
        got = profiles.with_curve(hours, kind, F.lit(usage), F.col("epoch")).collect()
        assert len(got) == 7 * 24
        for row in got:
            t = dt.datetime.fromtimestamp(row.epoch, dt.timezone.utc)
            knots = profiles.KNOTS[usage, kind, t.weekday() >= 5]
            assert row.expected == pytest.approx(np.interp(t.hour, range(0, 25, 3), knots))


def test_bias_moves_the_curve(spark):
    df = spark.createDataFrame([(0, 0.0), (0, 0.5), (0, 1.0)], "epoch bigint, noise double")
    got = profiles.with_curve(df, "voltage", F.lit("consumer"), F.col("epoch"), F.col("noise"))
    # The weekday curve spans 114..118, so the bias is within 0.4 * 4 / 2.
    assert sorted(r.bias for r in got.collect()) == pytest.approx([-0.8, 0.0, 0.8])
    assert sorted(r.expected for r in got.collect()) == pytest.approx([116.2, 117.0, 117.8])


def test_unknown_point_keeps_its_row(spark):
    df = spark.createDataFrame([(0, None)], "epoch bigint, point string")
    usage = profiles.usage_class(F.col("point"))
    assert profiles.with_curve(df, "demand", usage, F.col("epoch")).first().expected is None


def test_linear_profile(spark):
    df = spark.createDataFrame([("3.3.2", 12, 0.25)], "point string, hour int, noise double")
    row = profiles.with_linear_profile(df, F.col("point"), F.col("hour"), F.col("noise")).first()
    h = jvm_hash("3.3.2")
    n, modulus, base = profiles.CLASS_COEFFICIENTS[abs(h) % 10]
    assert row.class_number == n
    assert row.class_demand == pytest.approx(0.25 * (abs(h) % modulus))
    assert row.class_voltage == pytest.approx(0.5 + 5.0 + base)


def test_seasonal_temperature_is_smooth_over_a_year(spark):
    start = int(dt.datetime(2017, 1, 1, tzinfo=dt.timezone.utc).timestamp())
    hours = spark.range(365 * 24).select((F.col("id") * 3600 + start).alias("epoch"))
    values = [
        r.t for r in hours.select("epoch", profiles.temperature_model(F.col("epoch")).alias("t")).orderBy("epoch").collect()
    ]
    assert max(abs(a - b) for a, b in zip(values, values[1:])) < 2


def test_voltage_correction(spark):
    df = spark.createDataFrame([(117.0, 25.0), (117.0, -15.0)], "v double, t double")
    got = [r[0] for r in df.select(profiles.voltage_correction(F.col("v"), F.col("t"))).collect()]
    assert got == pytest.approx([117.6, 117.6])
