import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridpulse.functions import timeparts


def _one(spark, *columns, epoch=0):
    return tuple(spark.createDataFrame([(epoch,)], "epoch bigint").select(*columns).first())


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(-10**10, 10**10), min_size=1, max_size=50), st.sampled_from([0, -18, 12]))
def test_calendar_parts_match_python(spark, epochs, offset):
    df = spark.createDataFrame([(e,) for e in epochs], "epoch bigint").coalesce(1)
    got = df.select(*timeparts.calendar_parts(F.col("epoch"), offset)).collect()
    for epoch, row in zip(epochs, got):
        t = dt.datetime(1970, 1, 1) + dt.timedelta(seconds=epoch, hours=offset)
        assert tuple(row) == (t.year, t.month, t.day, t.hour, t.minute, t.isoweekday() % 7)


def test_parts_do_not_depend_on_the_session_zone(spark):
    epoch = 1482549376
    columns = timeparts.calendar_parts(F.col("epoch"))
    here = _one(spark, *columns, epoch=epoch)
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert _one(spark, *columns, epoch=epoch) == here
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_printed_raw_row(spark):
    # 2016-12-24 03:16 is a Saturday, day 24 and weekday 6.
    epoch = int(dt.datetime(2016, 12, 24, 3, 16, tzinfo=dt.timezone.utc).timestamp())
    assert _one(spark, *timeparts.calendar_parts(F.col("epoch")), epoch=epoch) == (2016, 12, 24, 3, 16, 6)


@pytest.mark.parametrize(
    "hour, sin, cos",
    [
        (13, -12.940958284226115, -48.296289698960514),
        (14, -24.999994594456457, -43.3012733101135),
        (3, 35.35533905932737, 35.35533905932738),
        (23, -12.94095828422611, 48.296289698960514),
        (2, 25.000000675692913, 43.30126979911044),
        (5, 48.29629091058026, 12.940953762401076),
        (9, 35.35533905932738, -35.35533905932737),
        (19, -48.29628969896052, 12.94095828422609),
        (16, -43.30127331011349, -24.99999459445649),
    ],
)
def test_printed_hour_features(spark, hour, sin, cos):
    got = spark.createDataFrame([(hour,)], "hour int").select(*timeparts.hour_features(F.col("hour"))).first()
    assert got.hour_sin == pytest.approx(sin, abs=1e-12)
    assert got.hour_cos == pytest.approx(cos, abs=1e-12)


def test_weekend_flag(spark):
    monday = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp())
    df = spark.createDataFrame([(monday + i * 86400,) for i in range(7)], "epoch bigint").coalesce(1)
    flags = [r[0] for r in df.select(timeparts.weekend_flag(F.col("epoch"))).collect()]
    assert flags == [0, 0, 0, 0, 0, 50, 50]


def test_time_rescale_steps_a_quarter_hour_per_second(spark):
    root = 1493105656
    df = spark.range(root, root + 50).select(timeparts.time_rescale(F.col("id"), root).alias("t"))
    times = sorted(r.t for r in df.collect())
    assert times[0] == root
    assert {b - a for a, b in zip(times, times[1:])} == {15 * 60}


def test_bucket_start_of_negative_epochs(spark):
    assert _one(spark, timeparts.bucket_start(F.col("epoch"), 3600), epoch=-1) == (-3600,)
