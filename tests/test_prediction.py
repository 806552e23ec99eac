import datetime as dt
import logging

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from gridpulse import session
from gridpulse.functions import profiles
from gridpulse.plans import prediction
from gridpulse.plans.network import Network
from gridpulse.sources import messages
from gridpulse.streaming import features, jobs, runner

START = int(dt.datetime(2017, 1, 1, tzinfo=dt.timezone.utc).timestamp())


@pytest.fixture(scope="module")
def year(spark):
    """Half a year of hourly maxima that follow the consumer curve and the temperature."""
    hours = spark.range(180 * 24).select((F.col("id") * 3600 + START).alias("epoch"), F.rand(7).alias("noise"))
    curve = profiles.with_curve(hours, "voltage", F.lit("consumer"), F.col("epoch"))
    rows = curve.select(
        "epoch",
        profiles.temperature_model(F.col("epoch"), F.col("noise")).cast("double").alias("temperature"),
        "expected",
    )
    voltage = profiles.voltage_correction(F.col("expected"), F.col("temperature"))
    df = rows.select("epoch", "temperature", voltage.alias("voltage")).persist()
    yield df
    df.unpersist()


@pytest.fixture(scope="module")
def training(year):
    return prediction.training_rows(year.select("epoch", "voltage"), year.select("epoch", "temperature"), 117.0)


@pytest.fixture(scope="module")
def quick(training):
    return prediction.train(training, prediction.EARLIER_LAYERS, 10)


def test_training_rows(spark):
    saturday = int(dt.datetime(2016, 12, 24, 2, 30, tzinfo=dt.timezone.utc).timestamp())
    volts = spark.createDataFrame([(saturday, 117.5), (5, 117.0)], "epoch bigint, voltage double")
    temps = spark.createDataFrame([(saturday, 21.0), (5, 1.0), (6, 1.0)], "epoch bigint, temperature double")
    got = prediction.training_rows(volts, temps, 117.0).orderBy(F.col("epoch").desc()).collect()
    assert [r.label for r in got] == [1, 0]
    assert got[0].hour == 2 and got[0].day_of_week == 50 and got[0].temperature == 21.0
    assert got[0].hour_sin == pytest.approx(25.000000675692913, abs=1e-12)
    shifted = prediction.training_rows(volts, temps, 117.0, -18).orderBy(F.col("epoch").desc()).first()
    assert shifted.hour == 8 and shifted.day_of_week == 0


def test_holdout_accuracy_on_a_small_sample_is_the_published_one(training):
    """The published 0.9643 equals 27 of 28, which points to a small hold-out. Its data is not
    public; twenty days of the simulated curve stand in."""
    days = training.filter(F.col("epoch") < START + 20 * 86400)
    row = prediction.holdout_accuracy(days, prediction.EARLIER_LAYERS, 100).first()
    assert 100 < row.n < 300
    assert row.accuracy >= 0.9642857142857143


def test_holdout_accuracy_over_half_a_year_beats_the_majority(training):
    majority = training.agg(F.avg("label")).first()[0]
    row = prediction.holdout_accuracy(training).first()
    assert row.n > 1000
    assert row.accuracy > max(majority, 1 - majority) + 0.3


def test_hash_split_does_not_move_rows(training):
    a, b = prediction.hash_split(training, F.col("epoch"))
    again, _ = prediction.hash_split(training.repartition(13), F.col("epoch"))
    assert {r.epoch for r in a.select("epoch").collect()} == {r.epoch for r in again.select("epoch").collect()}
    n = training.count()
    assert a.count() + b.count() == n
    assert a.count() / n == pytest.approx(0.6, abs=0.05)
    assert sum(part.count() for part in prediction.random_split(training)) == n


def test_accuracy_agrees_with_the_evaluator(training, quick):
    scored = prediction.score(quick, training)
    assert prediction.accuracy(scored) == pytest.approx(prediction.accuracy_frame(scored).first().accuracy)


def test_alert_messages_hold_positive_predictions_only(year, quick):
    forecast = year.select("epoch", "temperature")
    scored = prediction.score(quick, prediction.forecast_rows(forecast))
    expected = {r.epoch for r in scored.filter("prediction > 0").select("epoch").collect()}
    messages_ = prediction.alert_messages(quick, forecast, 117.0)
    assert {r.epoch for r in messages_.collect()} == expected
    first = messages_.orderBy("epoch").first()
    assert first.message.startswith('{"timestamp":%d,"temperature":' % (first.epoch * 1000))
    assert first.message.endswith(',"alert":117.0}')


def test_store_versions_and_round_trip(spark, training, quick):
    store = prediction.ModelStore(spark, session.scratch(spark, "store"))
    assert store.latest_version() is None
    assert [store.save(quick), store.save(quick)] == [1, 2]
    assert store.latest_version() == 2
    assert store.load(2).weights == quick.weights


def test_train_once_and_retrain(spark, training, caplog):
    store = prediction.ModelStore(spark, session.scratch(spark, "store"))
    few = training.limit(200)
    version, n = prediction.train_once(store, few, max_iter=2)
    assert (version, n) == (1, 200)
    attempts = []

    def load():
        attempts.append(1)
        if len(attempts) == 1:
            raise OSError("table not there")
        return few

    with caplog.at_level(logging.INFO):
        prediction.retrain(store, load, 0, passes=2, max_iter=2)
    assert "training pass failed" in caplog.text
    assert store.latest_version() == 2


def test_refresh_picks_up_newer_and_survives_failure(spark, quick):
    store = prediction.ModelStore(spark, session.scratch(spark, "store"))
    current = prediction.CurrentModel(store, every=2)
    assert current.get() is None
    store.save(quick)
    assert current.get() is not None and current.version == 1
    store.save(quick)
    current.get()
    current.get()
    assert current.version == 2
    # A marker without a model: loading fails, the old model stays.
    spark.range(1).selectExpr("9L as version").write.mode("append").json(f"{store.path}/markers")
    kept = current.model
    current.refresh()
    assert current.model is kept and current.version == 2


def test_stream_scoring_equals_batch_scoring(spark, year, quick, rows):
    store = prediction.ModelStore(spark, session.scratch(spark, "store"))
    store.save(quick)
    landed, root = session.scratch(spark, "forecast"), session.scratch(spark, "predictions")
    forecast = year.select("epoch", "temperature").filter(F.col("epoch") < START + 30 * 86400)
    forecast.repartition(3).write.parquet(landed)
    stream = messages.message_files(spark, landed, "epoch bigint, temperature double", 1)
    handler = prediction.score_stream(prediction.CurrentModel(store).get, root, 117.0)
    runner.drain(stream, handler, session.scratch(spark, "progress"))
    got = spark.read.parquet(f"{root}/batch_id=*")
    assert rows(got) == rows(prediction.alert_messages(quick, forecast, 117.0))


def test_forecasts_wait_for_a_model(spark, year, quick, rows):
    store = prediction.ModelStore(spark, session.scratch(spark, "store"))
    landed, root, progress = (session.scratch(spark, name) for name in ("forecast", "predictions", "progress"))
    forecast = year.select("epoch", "temperature").filter(F.col("epoch") < START + 20 * 86400)
    forecast.repartition(2).write.parquet(landed)
    handler = prediction.score_stream(prediction.CurrentModel(store).get, root, 117.0)
    stream = messages.message_files(spark, landed, "epoch bigint, temperature double", 1)
    with pytest.raises(StreamingQueryException, match="train a model"):
        runner.drain(stream, handler, progress)
    store.save(quick)
    runner.drain(stream, handler, progress)
    got = spark.read.parquet(f"{root}/batch_id=*")
    assert rows(got) == rows(prediction.alert_messages(quick, forecast, 117.0))


def test_network_of_weights_scores_like_its_model(spark, year, quick, rows):
    network = Network.of_model(quick)
    again = Network.of_table(network.table(spark).repartition(3))
    assert all(np.array_equal(a, b) for one, two in zip(network.layers, again.layers) for a, b in zip(one, two))
    features = prediction.forecast_rows(year)
    want = prediction.score(quick, features).select("epoch", "prediction")
    assert rows(prediction.score(again, features), "epoch", "prediction") == rows(want)
    holes = features.withColumn("temperature", F.when(F.col("epoch") % 7200 == 0, F.col("temperature")))
    scored = prediction.score(again, holes)
    assert scored.filter("(temperature is null) <> (prediction is null)").count() == 0


def test_network_needs_all_its_weights():
    with pytest.raises(ValueError, match="7 weights"):
        Network.of_vector([2, 2, 1], np.zeros(7))


@pytest.mark.parametrize("per_batch", [1, 2, None])
def test_features_join_while_both_sides_arrive(spark, year, rows, per_batch):
    landed, path = session.scratch(spark, "sides"), session.scratch(spark, "pairs")
    few = year.filter(F.col("epoch") < START + 12 * 86400)
    for day in range(0, 12, 4):
        part = few.filter(F.col("epoch").between(START + day * 86400, START + (day + 4) * 86400 - 1)).coalesce(1)
        part.select("epoch", "voltage").write.mode("append").parquet(f"{landed}/max")
        part.filter("epoch % 10800 <> 0").select("epoch", "temperature").write.mode("append").parquet(f"{landed}/temperature")
    pairs = features.joined(
        messages.message_files(spark, f"{landed}/max", "epoch bigint, voltage double", per_batch),
        messages.message_files(spark, f"{landed}/temperature", "epoch bigint, temperature double", per_batch),
    )
    query = runner.start(pairs, jobs.store_updates(path), session.scratch(spark, "progress"), interval=None)
    query.awaitTermination()
    want = prediction.training_rows(few, few.filter("epoch % 10800 <> 0"), 117.0)
    assert rows(features.read_features(spark, path, 117.0)) == rows(want)
    if per_batch == 1:
        # rows whose partner can no longer come are gone
        held = query.lastProgress["stateOperators"][0]["numRowsTotal"]
        assert held < few.count()


def test_epochs_reported_again_count_once(spark, rows):
    path = session.scratch(spark, "pairs")
    pairs = [(3600, 110.0, 4.0), (3600, 119.0, 4.0), (3600, 119.0, 7.0), (7200, 100.0, 1.0)]
    jobs.store_updates(path)(spark.createDataFrame(pairs, "epoch bigint, voltage double, temperature double"), 0)
    got = features.read_features(spark, path, 117.0)
    assert rows(got, "epoch", "label", "voltage", "temperature") == [(3600, 1, 119.0, 7.0), (7200, 0, 100.0, 1.0)]
