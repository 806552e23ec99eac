import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridpulse.functions import casts
from gridpulse.operators import aggregates as agg
from gridpulse.operators import buckets, gaps, percentiles, series, upserts
from gridpulse.sources import metrics


def test_subject_maxima_are_independent(spark, rows):
    df = spark.createDataFrame([("a", 1, 9.0), ("a", 5, 2.0), ("b", 3, 1.0)], "subject string, epoch int, v double")
    assert rows(agg.max_by_subject(df, "v")) == [("a", 5, 9.0), ("b", 3, 1.0)]


def test_alert_limits_are_strict(spark, rows):
    readings = [("a", 9, 120.5), ("a", 4, 121.0), ("a", 1, 120.0), ("b", 1, 130.0), ("c", 2, 119.0)]
    df = spark.createDataFrame(readings, "subject string, epoch int, v double")
    assert rows(agg.alerts(df, "v")) == [("a", 4, 2)]
    assert rows(agg.alerts(df, "v", count=1)) == [("a", 4, 2), ("b", 1, 1)]
    assert rows(agg.off_limit_count(df, "v", limit=119.5)) == [("a", 1, 3), ("b", 1, 1)]


def test_single_temperature(spark, rows):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0)], "epoch int, temperature double")
    assert rows(agg.single_temperature(df)) == [(1, 4.0)]
    assert rows(agg.single_temperature(df, "avg")) == [(1, 3.0)]


def test_daily_average_of_printed_shape(spark, rows):
    df = spark.createDataFrame(
        [(1, 2, 24, 118.5), (1, 2, 24, 112.5), (1, 2, 23, 114.0)],
        "line int, transformer int, day int, voltage double",
    )
    got = agg.average_by(df, ["line", "transformer", "day"], "voltage")
    assert got.columns[-1] == "voltage_avg"
    assert rows(got) == [(1, 2, 23, 114.0), (1, 2, 24, 115.5)]


def test_latest_by_key_keeps_column_order_and_null_values(spark, rows):
    df = spark.createDataFrame(
        [("a", 1, 1, 5.0), ("a", 1, 2, None), ("b", 9, 9, 1.0)], "k string, t int, id int, v double"
    )
    got = upserts.latest_by_key(df, ["k"], ["t", "id"])
    assert got.columns == ["k", "t", "id", "v"]
    assert rows(got) == [("a", 1, 2, None), ("b", 9, 9, 1.0)]


def test_newest_rows_and_limit(spark, rows):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 7)], "k string, t int")
    assert rows(upserts.newest_rows(df, ["k"], ["t"], 2)) == [("a", 3, 2), ("a", 4, 1), ("b", 7, 1)]
    assert [r.t for r in upserts.limit_rows(df, ["t"], 3).collect()] == [0, 1, 2]


def test_newest_rows_beyond_sparks_own_trimming(spark, rows):
    df = spark.range(0, 3000, 1, 6).select(F.when(F.col("id") % 3 > 0, 1).otherwise(0).alias("k"), F.col("id").alias("t"))
    got = upserts.newest_rows(df, ["k"], ["t"], 1001)
    assert got.columns == ["k", "t", "recency"]
    want = [(0, t, i + 1) for i, t in enumerate(sorted((t for t in range(3000) if t % 3 == 0), reverse=True))]
    want += [(1, t, i + 1) for i, t in enumerate(sorted((t for t in range(3000) if t % 3), reverse=True)) if i < 1001]
    assert rows(got) == sorted(want, key=repr)


def test_epoch_upsert_modes(spark, rows):
    df = spark.createDataFrame([(1, 1, 9.0), (1, 2, 5.0)], "epoch int, batch_id int, v double")
    assert rows(upserts.upsert_epochs(df, "v", ["batch_id"])) == [(1, 9.0)]
    assert rows(upserts.upsert_epochs(df, "v", ["batch_id"], "overwrite")) == [(1, 5.0)]
    with pytest.raises(ValueError):
        upserts.upsert_epochs(df, "v", ["batch_id"], "min")


finite = st.floats(allow_nan=False, allow_infinity=False)


@settings(max_examples=30, deadline=None)
@given(st.lists(finite, min_size=2, max_size=60), st.sampled_from([11, 32]))
def test_rounding_to_bits_keeps_the_order(spark, values, bits):
    df = spark.createDataFrame([(v,) for v in sorted(values)], "v double").coalesce(1)
    got = [r[0] for r in df.select(percentiles.round_bits(F.col("v"), bits)).collect()]
    assert got == sorted(got)


@settings(max_examples=12, deadline=None)
@given(
    st.lists(st.tuples(st.sampled_from("abc"), finite | st.integers(0, 3).map(float)), min_size=1, max_size=80),
    st.sampled_from([0.0, 0.25, 0.5, 0.9, 1.0]),
)
def test_ranked_percentile_matches_the_built_in(spark, values, fraction):
    df = spark.createDataFrame(values, "k string, v double")
    got = {r.k: r.p for r in percentiles.percentile_by_rank(df, "v", fraction, ["k"], "p").collect()}
    for k in {k for k, _ in values}:
        want = sorted(v for kk, v in values if kk == k)
        position = (len(want) - 1) * fraction
        lo, hi = want[int(np.floor(position))], want[int(np.ceil(position))]
        assert got[k] == pytest.approx(lo + (hi - lo) * (position - np.floor(position)), rel=1e-9, abs=1e-300)


def test_ranked_percentile_of_a_hot_group(spark):
    hot = spark.range(200_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"),
        (F.hash("id") / 1e6).alias("v"),
    )
    plain = {r.k: r.v for r in percentiles.median(hot, "v", ["k"]).collect()}
    split = {r.k: r.v for r in hot.groupBy("k").agg(F.percentile("v", 0.5).alias("v")).collect()}
    assert plain == pytest.approx(split)
    sketch = {r.k: r.v for r in percentiles.percentile_sketch(hot, "v", 0.5, ["k"]).collect()}
    assert sketch.keys() == plain.keys()


def test_percentile_skips_nulls_and_keeps_null_keys(spark, rows):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", None), ("b", 2.0), ("b", None)], "k string, v double")
    got = percentiles.percentile(df, "v", 0.5, ["k"])
    assert rows(got) == sorted([(None, 2.0), ("b", 2.0)], key=repr)


def test_percentile_of_extreme_values_equals_the_built_in(spark):
    inf, huge = float("inf"), 1.7e308
    groups = [(1.0, inf, inf, inf), (-huge, huge), (-inf, 1.0, 2.0), (huge, huge, -huge), (0.5,)]
    df = spark.createDataFrame([(k, v) for k, vs in enumerate(groups) for v in vs], "k int, v double")
    for share in (0.0, 0.25, 0.5, 0.9, 1.0):
        got = {r.k: repr(r.v) for r in percentiles.percentile(df, "v", share, ["k"]).collect()}
        assert got == {r.k: repr(r.v) for r in df.groupBy("k").agg(F.percentile("v", share).alias("v")).collect()}


def _walk(spark, n=3000, seed=5):
    rng = random.Random(seed)
    data, t = [], 0
    for i in range(n):
        t += rng.choice([0, 1, 7, 400, 90_000])
        data.append((rng.choice(["hot", "hot", "hot", "cold"]), t, i, rng.random()))
    return spark.createDataFrame(data, "s string, epoch bigint, id int, v double")


def _lagged(df, by, order, columns):
    over = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order, *columns)
    return df.withColumns({f"prev_{c}": F.lag(c).over(over) for c in columns})


@pytest.mark.parametrize("parts", ["1", "3", "50"])
@pytest.mark.parametrize("by", [["s"], []], ids=["series", "whole frame"])
def test_long_series_see_every_predecessor(spark, rows, parts, by):
    df, before = _walk(spark, 1500), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = series.with_previous(df, by, ["epoch", "id"], ["v", "epoch"])
        assert rows(got) == rows(_lagged(df, by, ["epoch", "id"], ["v", "epoch"]).select(got.columns))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_order_need_not_be_time(spark, rows):
    # times run against the order, and some orders and series are null
    data = [(s, i if i % 9 else None, 10_000 - 7 * i, float(i)) for i in range(200) for s in ("a", None)]
    df = spark.createDataFrame(data, "s string, seq int, epoch bigint, v double")
    got = series.with_previous(df, ["s"], ["seq"], ["v", "epoch"])
    assert rows(got) == rows(_lagged(df, ["s"], ["seq"], ["v", "epoch"]))


def test_few_rows_leave_empty_partitions(spark, rows):
    df = spark.createDataFrame([(2, 1), (5, 2)], "v int, seq int")
    assert rows(series.with_previous(df, [], ["seq"], ["v"])) == [(2, 1, None), (5, 2, 2)]
    assert rows(series.with_previous(df.filter("v > 9"), [], ["seq"], ["v"])) == []
    many = spark.range(3000).select(F.lit(1).alias("v"), F.lit(1).alias("seq"))
    assert series.with_previous(many, [], ["seq"], ["v"]).filter("prev_v is null").count() == 1


def test_previous_row_shuffles_once_and_runs_nothing_early(spark):
    tracker, group = spark.sparkContext.statusTracker(), "previous-row"
    spark.sparkContext.setJobGroup(group, group)
    try:
        got = series.with_previous(_walk(spark, 300), ["s"], ["epoch"], ["v"])
        assert not list(tracker.getJobIdsForGroup(group))
        got.collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan and "CartesianProduct" not in plan


def test_derivative(spark, rows):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 2, 5.0), ("a", 3, 4.0), ("b", 0, 1.0)], "s string, epoch bigint, v double")
    got = series.derivative(df, "v", "epoch", ["s"], ["epoch"])
    assert rows(got, "s", "epoch", "derivative") == [("a", 2, 2.0), ("a", 3, -1.0)]


def test_instant_rate_handles_resets_and_range(spark, rows):
    df = spark.createDataFrame([(0, 10), (10, 30), (20, 5), (100, 9)], "epoch bigint, c bigint").withColumn("s", F.lit(1))
    got = series.instant_rate(df, "c", 60, ["s"])
    assert rows(got, "epoch", "rate") == [(10, 2.0), (20, 0.5)]


def test_step_and_cadence(spark, rows):
    df = spark.createDataFrame([(0, 1.0), (900, 2.5), (1800, 6.0), (3600, 6.0)], "epoch bigint, v double").withColumn("s", F.lit(1))
    assert rows(series.step_changes(df, "v", 2, ["s"], ["epoch"]), "epoch", "step") == [(1800, 3.5)]
    assert rows(series.cadence_breaks(df, 900, ["s"]), "epoch", "gap") == [(3600, 1800)]


def test_forecast_alignment(spark, rows):
    df = spark.createDataFrame([(h * 3600, float(h)) for h in range(20)], "epoch bigint, t double")
    got = rows(series.align_forecast(df, df, "t"))
    assert got == sorted([(h * 3600, float(h), float(h - 12)) for h in range(12, 20)], key=repr)


def test_gap_filling(spark, rows):
    df = spark.createDataFrame([("a", 10, 1.0), ("a", 40, 4.0), ("b", 20, 2.0)], "s string, bucket bigint, v double")
    every = gaps.fill_null(df, 10, ["s"], (0, 50))
    assert rows(every) == sorted(
        [("a", t, {10: 1.0, 40: 4.0}.get(t)) for t in range(0, 51, 10)]
        + [("b", t, {20: 2.0}.get(t)) for t in range(0, 51, 10)], key=repr)
    carried = {(s, t): v for s, t, v in rows(gaps.fill_previous(every, "v", ["s"]))}
    assert [carried["a", t] for t in range(0, 51, 10)] == [None, 1.0, 1.0, 1.0, 4.0, 4.0]
    line = {(s, t): v for s, t, v in rows(gaps.fill_linear(every, "v", ["s"]))}
    assert [line["a", t] for t in range(0, 51, 10)] == [None, 1.0, 2.0, 3.0, 4.0, None]
    assert [line["b", t] for t in range(0, 51, 10)] == [None, None, 2.0, None, None, None]
    assert rows(gaps.fill_none(every, "v")) == rows(df)
    assert {v for *_, v in rows(gaps.null_as_zero(every, "v"))} == {0.0, 1.0, 2.0, 4.0}
    inner = gaps.fill_null(df, 10, ["s"], (20, 40))
    assert rows(inner) == sorted([("a", 20, None), ("a", 30, None), ("a", 40, 4.0), ("b", 20, 2.0), ("b", 30, None), ("b", 40, None)], key=repr)


def test_rollup_rules_and_coverage(spark, rows):
    def points(name, known):
        return [(name, i * 10, float(i)) for i in range(known)]

    data = points("x.lower", 1) + points("x.upper_90", 6) + points("x.sum", 1) + points("x.count", 3)
    data += points("stats_counts.x", 2) + points("x.mean", 1) + points("y.mean", 2) + [("x.sum", 5, 7.0)]
    df = spark.createDataFrame(data, "name string, epoch bigint, value double")
    got = {r.name: (r.known, r.value) for r in buckets.rollup(df, 10, 60).collect()}
    assert got == {
        "x.lower": (1, 0.0), "x.upper_90": (6, 5.0), "x.sum": (1, 7.0), "x.count": (3, 3.0),
        "stats_counts.x": (2, 1.0), "x.mean": (1, None), "y.mean": (2, 0.5),
    }


def test_retention_tiers(spark, rows):
    df = spark.createDataFrame([(t,) for t in (0, 50, 99)], "epoch bigint")
    got = buckets.retain({"fine": (df, 10), "coarse": (df, 60)}, "epoch", F.lit(100))
    assert rows(got) == [(50, "coarse"), (99, "coarse"), (99, "fine")]


def test_since(spark, rows):
    df = spark.sql("select timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) as ts, id from range(60)")
    assert rows(buckets.since(df, "ts", 600), "id") == sorted([(i,) for i in range(49, 60)], key=repr)
    now = F.expr("timestamp_ntz'2024-01-01 01:00:00'")
    assert buckets.since(df, "ts", 600, now).count() == 10


def test_buckets(spark, rows):
    df = spark.createDataFrame([(0, 1, 1.0), (5, 2, 3.0), (5, 3, 3.0), (12, 4, 7.0)], "epoch bigint, id int, v double")
    assert rows(buckets.bucket_mean(df, "v", 10)) == [(0, 7 / 3), (10, 7.0)]
    assert rows(buckets.bucket_last(df, "v", 10, ["epoch", "id"])) == [(0, 3.0), (10, 7.0)]
    assert rows(buckets.bucket_last(df, "v", 10, ["id"])) == [(0, 3.0), (10, 7.0)]
    assert rows(buckets.bucket_distinct(df, "v", 10)) == [(0, 1.0), (0, 3.0), (10, 7.0)]
    assert rows(buckets.bucket_count(df, 10)) == [(0, 3), (10, 1)]
    assert rows(buckets.threshold_breach(df, "v", 3.0), "breach") == [(False,)] * 3 + [(True,)]


def test_metric_ingest_and_points(spark, rows):
    df = spark.createDataFrame([('{"epoch": 5, "voltage": 1.5, "site": "x"}',), ('{"epoch": 6}',)], "body string")
    ingested = metrics.ingest_json(df, "body", {"epoch": "double", "voltage": "double"}, "max_voltage")
    assert rows(ingested) == sorted([("max_voltage", 5.0, 1.5), ("max_voltage", 6.0, None)], key=repr)
    assert rows(metrics.metric_points(ingested, ["epoch", "voltage"])) == [
        ("max_voltage", "epoch", 5.0), ("max_voltage", "epoch", 6.0), ("max_voltage", "voltage", 1.5)]


def test_counter_text(spark):
    text = [(" slot | count",), ("------+-------",), ("    1 | 250",), ("    0 | 17",), ("",), ("(2 rows)",)]
    lines = metrics.counter_lines(spark.createDataFrame(text, "t string"), "t")
    assert metrics.counts_as_json(lines).first()[0] == '{"0":17,"1":250}'
    status = [("\t\tLocal write count: 12",), ("\t\tLocal read count: 99",), ("\t\tLocal write count: 30",)]
    assert metrics.write_counts(spark.createDataFrame(status, "t string"), "t").first()[0] == 42


def test_stored_tiers(spark, rows):
    df = spark.createDataFrame([("a.sum", t, 1.0) for t in range(0, 200, 5)], "name string, epoch bigint, value double")
    got = buckets.stored_tiers(df, F.lit(200), (10, 30), (60, 140))
    assert rows(got, "tier", "bucket", "value") == sorted(
        [("fine", t, 1.0) for t in (170, 180, 190)]
        + [("coarse", 60, 6.0), ("coarse", 120, 6.0), ("coarse", 180, 2.0)], key=repr)


def test_lag_forecast(spark, rows):
    df = spark.createDataFrame([(1, t * 900, float(t)) for t in range(14)], "s int, epoch bigint, t double")
    assert rows(series.lag_forecast(df, "t", ["s"]), "t", "forecast") == [(12.0, 0.0), (13.0, 1.0)]


def test_narrowing_gives_null_where_it_does_not_fit(spark):
    df = spark.createDataFrame([(v,) for v in (-129, -128, 127, 128, 2**40, None)], "v bigint").coalesce(1)
    assert [r[0] for r in df.select(casts.narrow(F.col("v"), "tinyint")).collect()] == [None, -128, 127, None, None, None]


def test_any_number_of_a_json_object_is_a_point(spark, rows):
    texts = [
        '{"a": 1, "b": 2.5, "c": "x", "d": null, "e": true, "f": {"g": 1}, "h": [1], "i": -1e300, "j": "7"}',
        "[1, 2]", "3", "{broken", "", None, "{}", '{"a": 99999999999999999999}',
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, body string")
    got = rows(metrics.json_points(df, "body", "m", ("id",)), "id", "measurement", "field", "value")
    assert got == [(0, "m", "a", 1.0), (0, "m", "b", 2.5), (0, "m", "i", -1e300), (7, "m", "a", 1e20)]
