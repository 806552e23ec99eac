"""Training rows, splits, training, scoring and model hand-off."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..plans import prediction
from ..plans.network import Network
from ..session import scratch
from ..sources import messages, tables
from ..streaming import features, jobs, runner
from .aggregates import max_by_epoch
from .base import HOUR_MAX, HOUR_TEMPERATURE, READINGS, TEMPERATURES, Catalog, tidy
from .profiles import hour_temperatures
from .projections import ANGLE

catalog = Catalog()

LIMIT = 120.0

TRAINING = f"""training as (
    select epoch, case when voltage > 120 then 1::bigint else 0 end as label, voltage, hour,
           50 * sin({ANGLE}) as hour_sin, 50 * cos({ANGLE}) as hour_cos, day_of_week, temperature
    from (select epoch, voltage, temperature, epoch % 86400 // 3600 as hour,
                 case when dayofweek(make_timestamp(epoch * 1000000)) in (0, 6) then 50::bigint else 0 end as day_of_week
          from hour_max join hour_temperature using (epoch)))"""

VIEWS = (READINGS, TEMPERATURES, HOUR_MAX, HOUR_TEMPERATURE, TRAINING)


def _training(spark, sf_dir):
    return prediction.training_rows(
        max_by_epoch(spark, sf_dir), hour_temperatures(spark, sf_dir), LIMIT
    )


@catalog.query(
    """select epoch, label, voltage, hour, round(hour_sin, 6) as hour_sin, round(hour_cos, 6) as hour_cos,
              day_of_week, temperature from training""",
    *VIEWS,
)
def feature_join(spark, sf_dir):
    return tidy(_training(spark, sf_dir))


@catalog.query(
    """select epoch, label, round(hour_sin, 6) as hour_sin, round(hour_cos, 6) as hour_cos,
              cast(day_of_week as double) as day_of_week, temperature from training""",
    *VIEWS,
)
def feature_vector(spark, sf_dir):
    """The assembled vector, taken apart again."""
    parts = vector_to_array("features")
    return tidy(
        prediction.assemble(_training(spark, sf_dir)).select(
            "epoch", "label", *[parts[i].alias(name) for i, name in enumerate(prediction.FEATURES)]
        )
    )


@catalog.query(
    """select event_id, event_id % 10 < 6 as is_train from events"""
)
def hash_split(spark, sf_dir):
    rows = tables.events(spark, sf_dir).select("event_id")
    return prediction.key_split(rows, F.col("event_id"))


@catalog.query(
    """select count(*) as n, round(avg(case when (case when hour_cos < 0 then 1 else 0 end) = label
                                            then 1.0 else 0.0 end), 6) as accuracy
       from training""",
    *VIEWS,
)
def accuracy_metric(spark, sf_dir):
    ruled = _training(spark, sf_dir).withColumn(
        "prediction", (F.col("hour_cos") < 0).cast("double")
    )
    return tidy(prediction.accuracy_frame(ruled))


def _store(spark, sf_dir) -> prediction.ModelStore:
    """A store of its own, with one model trained on this data."""
    store = prediction.ModelStore(spark, scratch(spark, "model"))
    prediction.train_once(store, _training(spark, sf_dir))
    return store


@catalog.query("select 1::bigint as version, count(*) as n, sum(label)::bigint as positives from training", *VIEWS)
def train_once(spark, sf_dir):
    store = prediction.ModelStore(spark, scratch(spark, "model"))
    rows = _training(spark, sf_dir)
    version, fitted = prediction.train_once(store, rows)
    positives = rows.agg(F.sum("label").alias("positives"))
    return tidy(positives.select(
        F.lit(version).cast("bigint").alias("version"), F.lit(fitted).cast("bigint").alias("n"), "positives"
    ))


@catalog.query("select count(*) as n, count(*) as same from training", *VIEWS)
def model_roundtrip(spark, sf_dir):
    """Predictions of a model before saving and after loading, row by row."""
    store = _store(spark, sf_dir)
    model = store.load(1)
    again = store.load(store.save(model))
    rows = _training(spark, sf_dir)
    before = prediction.score(model, rows).select("epoch", F.col("prediction").alias("before"))
    after = prediction.score(again, rows).select("epoch", "prediction")
    same = F.sum((F.col("before") == F.col("prediction")).cast("bigint"))
    return before.join(after, "epoch").agg(F.count("*").alias("n"), same.alias("same"))


@catalog.query()
def holdout_accuracy(spark, sf_dir):
    return tidy(prediction.holdout_accuracy(_training(spark, sf_dir), split="hash"))


@catalog.query(
    """select epoch, '{"timestamp":' || (epoch * 1000) || ',"temperature":' || cast(temperature as varchar)
              || ',"alert":120.0}' as message
       from training where hour_cos < 0""",
    *VIEWS,
)
def positive_by_rule(spark, sf_dir):
    """The filter and message of positive predictions, on predictions SQL can make too."""
    ruled = _training(spark, sf_dir).withColumn(
        "prediction", (F.col("hour_cos") < 0).cast("double")
    )
    message = prediction.reports.prediction_json(F.col("epoch"), F.col("temperature"), LIMIT)
    return prediction.positive_predictions(ruled).select("epoch", message.alias("message"))


@catalog.query()
def score_positive(spark, sf_dir):
    scored = prediction.score(_store(spark, sf_dir).load(1), _training(spark, sf_dir))
    return tidy(prediction.positive_predictions(scored).select("epoch", "label", "prediction"))


@catalog.query()
def stream_score(spark, sf_dir):
    """Temperature messages scored batch by batch with the stored model."""
    root = scratch(spark, "predictions")
    events = messages.table_stream(tables.use_utc(spark), sf_dir, "events", tables.EVENTS_SCHEMA)
    forecast = messages.unkeyed(tables.as_messages(events), tables.TEMPERATURE_SUBJECT)
    current = prediction.CurrentModel(_store(spark, sf_dir))
    handler = prediction.score_stream(current.get, root, LIMIT)
    runner.drain(
        forecast.withColumnRenamed("value", "temperature"), handler, scratch(spark, "progress")
    )
    return spark.read.schema("epoch bigint, message string").parquet(f"{root}/batch_id=*")


#: A network by a rule, so that SQL can have the same one: weight k is 0.9 * sin(1.7 * k * k).
RULED_WEIGHTS = """
weights as (
    select layer, unit, source, 0.9 * sin(1.7 * k * k) as weight
    from (select layer, unit, source,
                 case when source = -1 then base + n_in * n_out + unit else base + source * n_out + unit end as k
          from (values (0, 4, 16, 0), (1, 16, 12, 80), (2, 12, 6, 284), (3, 6, 2, 362)) as l(layer, n_in, n_out, base),
               unnest(generate_series(0, n_out - 1)) as u(unit), unnest(generate_series(-1, n_in - 1)) as s(source)))"""


def _layer(n: int) -> str:
    """Values of layer ``n`` from those before; a bias comes from the source -1, which is always 1."""
    value = "sum(weight * value)" if n == 3 else "1 / (1 + exp(-sum(weight * value)))"
    return f"""
values_{n} as (
    select epoch, unit as source, {value} as value
    from (select epoch, source, value from values_{n - 1} union all select distinct epoch, -1, 1.0 from values_{n - 1})
    join weights using (source) where layer = {n} group by 1, 2)"""


FORWARD = f"""{RULED_WEIGHTS},
values_first as (
    select epoch, unnest([0, 1, 2, 3]) as source, unnest([hour_sin, hour_cos, cast(day_of_week as double), temperature]) as value
    from scored_rows),
{_layer(0).replace("values_-1", "values_first")},{_layer(1)},{_layer(2)},{_layer(3)},
predictions as (select epoch, cast(arg_max(source, value) as double) as prediction from values_3 group by 1)"""


def ruled_network() -> Network:
    sizes = prediction.LAYERS
    n = sum((a + 1) * b for a, b in zip(sizes, sizes[1:]))
    return Network.of_vector(sizes, 0.9 * np.sin(1.7 * np.arange(n) ** 2.0))


@catalog.query(
    "select epoch, label, prediction from predictions join training using (epoch) where prediction > 0",
    *VIEWS,
    "scored_rows as (select * from training)",
    FORWARD.strip(),
)
def score_network(spark, sf_dir):
    """Positive predictions of a given network, which went through its table of weights."""
    network = Network.of_table(ruled_network().table(spark))
    scored = prediction.score(network, _training(spark, sf_dir))
    return tidy(prediction.positive_predictions(scored).select("epoch", "label", "prediction"))


@catalog.query(
    """select epoch, '{"timestamp":' || (epoch * 1000) || ',"temperature":' || cast(temperature as varchar)
              || ',"alert":120.0}' as message
       from predictions join scored_rows using (epoch) where prediction > 0""",
    TEMPERATURES,
    HOUR_TEMPERATURE,
    f"""scored_rows as (
    select epoch, 50 * sin({ANGLE}) as hour_sin, 50 * cos({ANGLE}) as hour_cos, day_of_week, temperature
    from (select epoch, temperature, epoch % 86400 // 3600 as hour,
                 case when dayofweek(make_timestamp(epoch * 1000000)) in (0, 6) then 50::bigint else 0 end as day_of_week
          from hour_temperature))""",
    FORWARD.strip(),
)
def stream_score_network(spark, sf_dir):
    """Hourly forecasts that arrive as messages, scored batch by batch with a given network."""
    root, landing = scratch(spark, "scored"), scratch(spark, "forecasts")
    hour_temperatures(spark, sf_dir).repartition(4).write.parquet(landing)
    forecast = messages.message_files(spark, landing, "epoch bigint, temperature double", 2)
    handler = prediction.score_stream(lambda: ruled_network(), root, LIMIT)
    runner.drain(forecast, handler, scratch(spark, "progress"))
    return spark.read.schema("epoch bigint, message string").parquet(f"{root}/batch_id=*")


@catalog.query(
    """select epoch, label, voltage, hour, round(hour_sin, 6) as hour_sin, round(hour_cos, 6) as hour_cos,
              day_of_week, temperature from training""",
    *VIEWS,
)
def stream_feature_join(spark, sf_dir):
    """Both tables of hours arrive as files; pairs are stored as soon as both rows of an hour are there."""
    path, landing = scratch(spark, "pairs"), scratch(spark, "hours")
    max_by_epoch(spark, sf_dir).repartition(3).write.parquet(f"{landing}/max")
    hour_temperatures(spark, sf_dir).repartition(3).write.parquet(f"{landing}/temperature")
    pairs = features.joined(
        messages.message_files(spark, f"{landing}/max", "epoch bigint, voltage double"),
        messages.message_files(spark, f"{landing}/temperature", "epoch bigint, temperature double"),
    )
    runner.drain(pairs, jobs.store_updates(path), scratch(spark, "progress"))
    return tidy(features.read_features(spark, path, LIMIT))


@catalog.query("select 1::bigint as first_version, 2::bigint as second_version, count(*) as scored from training", *VIEWS)
def model_refresh(spark, sf_dir):
    """A scorer that picks up a newer version and scores every row with it."""
    store = _store(spark, sf_dir)
    current = prediction.CurrentModel(store, every=1)
    current.get()
    first = current.version
    prediction.train_once(store, _training(spark, sf_dir), max_iter=20)
    scored = prediction.score(current.get(), _training(spark, sf_dir))
    return scored.agg(
        F.lit(first).cast("bigint").alias("first_version"),
        F.lit(current.version).cast("bigint").alias("second_version"),
        F.count("prediction").alias("scored"),
    )
