"""Predict over-voltage from the hour, the weekday and the temperature."""

from __future__ import annotations

import logging
import math
import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.ml.classification import (
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeparts import hour_features, local_hour, weekend_flag
from ..sinks import reports
from .network import Network

log = logging.getLogger(__name__)

# Network, solver and label settings.
LAYERS = [4, 16, 12, 6, 2]
EARLIER_LAYERS = [4, 12, 12, 2]
BLOCK_SIZE = 128
SEED = 1234
MAX_ITER = 120
THRESHOLD = 116.0
TRAIN_SHARE = 0.6
REFRESH_INTERVALS = 4

ROWS_PER_PARTITION = 20_000

FEATURES = ["hour_sin", "hour_cos", "day_of_week", "temperature"]


def threshold_label(voltage: Column, threshold: float = THRESHOLD) -> Column:
    return (voltage > threshold).cast("int")


def date_features(epoch: Column, utc_offset_hours: int = 0) -> list[Column]:
    """hour, its position on the daily circle, and the weekend flag."""
    hour = local_hour(epoch, utc_offset_hours)
    return [
        hour.alias("hour"),
        *hour_features(hour),
        weekend_flag(epoch, utc_offset_hours).alias("day_of_week"),
    ]


def training_rows(
    max_voltage: DataFrame,
    temperature: DataFrame,
    threshold: float = THRESHOLD,
    utc_offset_hours: int = 0,
) -> DataFrame:
    """Join the two per-epoch tables and derive label and features.

    The epoch is unique on either side, so no key of this join can be hot.
    """
    joined = max_voltage.select("epoch", "voltage").join(
        temperature.select("epoch", "temperature"), "epoch"
    )
    return training_columns(joined, threshold, utc_offset_hours)


def training_columns(
    joined: DataFrame, threshold: float = THRESHOLD, utc_offset_hours: int = 0
) -> DataFrame:
    """Label and features of ``(epoch, voltage, temperature)``."""
    return joined.select(
        "epoch",
        threshold_label(F.col("voltage"), threshold).alias("label"),
        "voltage",
        *date_features(F.col("epoch"), utc_offset_hours),
        "temperature",
    )


def assemble(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df)


def classifier(
    layers: list[int] = LAYERS, max_iter: int = MAX_ITER
) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(
        layers=layers, maxIter=max_iter, blockSize=BLOCK_SIZE, seed=SEED
    )


def train(rows: DataFrame, layers: list[int] = LAYERS, max_iter: int = MAX_ITER):
    return classifier(layers, max_iter).fit(assemble(rows))


def score(model, rows: DataFrame) -> DataFrame:
    """Rows with their ``prediction``, by a fitted model or by the network of its weights."""
    if isinstance(model, Network):
        return model.score(rows, FEATURES)
    return model.transform(assemble(rows))


def random_split(rows: DataFrame, share: float = TRAIN_SHARE) -> list[DataFrame]:
    return rows.randomSplit([share, 1 - share], SEED)


def hash_split(rows: DataFrame, key: Column, share: float = TRAIN_SHARE) -> tuple[DataFrame, DataFrame]:
    """Split by a hash of the key: the same rows on either side however they are partitioned."""
    in_train = F.pmod(F.xxhash64(key), F.lit(1000)) < int(round(share * 1000))
    return rows.filter(in_train), rows.filter(~in_train)


def key_split(rows: DataFrame, key: Column, share: float = TRAIN_SHARE) -> DataFrame:
    """Mark rows of an integer key as train or test by its last digit."""
    return rows.withColumn("is_train", F.pmod(key, F.lit(10)) < int(round(share * 10)))


def accuracy(scored: DataFrame) -> float:
    return MulticlassClassificationEvaluator(
        labelCol="label", predictionCol="prediction", metricName="accuracy"
    ).evaluate(scored)


def accuracy_frame(scored: DataFrame) -> DataFrame:
    hit = (F.col("prediction") == F.col("label")).cast("double")
    return scored.agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy"))


def holdout_accuracy(
    rows: DataFrame, layers: list[int] = LAYERS, max_iter: int = MAX_ITER, split: str = "random"
) -> DataFrame:
    """Train on 60 % of the rows, report the accuracy on the rest."""
    if split == "random":
        fit_on, held_out = random_split(rows)
    else:
        fit_on, held_out = hash_split(rows, F.col("epoch"))
    return accuracy_frame(score(train(fit_on, layers, max_iter), held_out))


def positive_predictions(scored: DataFrame) -> DataFrame:
    return scored.filter(F.col("prediction") > 0)


def forecast_rows(forecast: DataFrame, utc_offset_hours: int = 0) -> DataFrame:
    """Features of ``(epoch, temperature)`` forecasts."""
    return forecast.select(
        "epoch", *date_features(F.col("epoch"), utc_offset_hours), "temperature"
    )


def alert_messages(
    model, forecast: DataFrame, threshold: float = THRESHOLD, utc_offset_hours: int = 0
) -> DataFrame:
    """JSON alerts for all forecasts that the model takes for an over-voltage."""
    found = positive_predictions(score(model, forecast_rows(forecast, utc_offset_hours)))
    message = reports.prediction_json(F.col("epoch"), F.col("temperature"), threshold)
    return found.select("epoch", message.alias("message"))


class ModelStore:
    """Versioned models below one path.

    A version is visible once its marker row is written, after the model itself. Readers
    therefore never load a half-written model, and a failed save leaves no trace.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def latest_version(self) -> int | None:
        try:
            markers = self.spark.read.schema("version bigint").json(f"{self.path}/markers")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise
        return markers.agg(F.max("version")).first()[0]

    def save(self, model, version: int | None = None) -> int:
        if version is None:
            version = (self.latest_version() or 0) + 1
        model.write().overwrite().save(f"{self.path}/models/{version}")
        marker = self.spark.range(1).select(F.lit(version).cast("bigint").alias("version"))
        marker.write.mode("append").json(f"{self.path}/markers")
        return version

    def load(self, version: int) -> MultilayerPerceptronClassificationModel:
        return MultilayerPerceptronClassificationModel.load(f"{self.path}/models/{version}")


def train_once(store: ModelStore, rows: DataFrame, **settings) -> tuple[int, int]:
    """One training pass: fit, save as a new version, report (version, rows).

    The solver passes over the rows more than a hundred times, so they are kept, in no more
    partitions than their number is worth. They are sorted by epoch, so that the fit does not
    follow the order in which shuffled rows happened to arrive.
    """
    rows = rows.persist()
    try:
        n = rows.count()
        parts = max(1, math.ceil(n / ROWS_PER_PARTITION))
        sized = rows.repartitionByRange(parts, "epoch").sortWithinPartitions("epoch").persist()
        try:
            return store.save(train(sized, **settings)), n
        finally:
            sized.unpersist()
    finally:
        rows.unpersist()


def retrain(
    store: ModelStore,
    load_rows: Callable[[], DataFrame],
    interval_seconds: float,
    passes: int | None = None,
    **settings,
) -> None:
    """Train again and again; a failed pass is logged and the next one still runs."""
    done = 0
    while passes is None or done < passes:
        try:
            version, n = train_once(store, load_rows(), **settings)
            log.info("model %s trained on %s rows", version, n)
        except Exception:
            log.exception("training pass failed")
        done += 1
        if passes is None or done < passes:
            time.sleep(interval_seconds)


class CurrentModel:
    """The newest stored model, looked up again every few micro-batches."""

    def __init__(self, store: ModelStore, every: int = REFRESH_INTERVALS):
        self.store, self.every = store, every
        self.model, self.version = None, None
        self._calls = 0

    def get(self):
        if self.model is None or self._calls % self.every == 0:
            self.refresh()
        self._calls += 1
        return self.model

    def refresh(self) -> None:
        """Load a newer version if there is one; keep the present model if that fails."""
        try:
            newest = self.store.latest_version()
            if newest is not None and newest != self.version:
                self.model, self.version = self.store.load(newest), newest
        except Exception:
            log.exception("no newer model can be loaded, keeping %s", self.version)


class NoModelYet(RuntimeError):
    """A stream has forecasts to score, but no model has been stored."""


def score_stream(
    current: Callable[[], object],
    root: str,
    threshold: float = THRESHOLD,
    utc_offset_hours: int = 0,
) -> Callable[[DataFrame, int], None]:
    """Handler that scores a whole micro-batch of forecasts with the model that ``current`` gives.

    Without a model the batch fails and stays uncommitted, so that its forecasts are scored when the
    stream starts again and not lost.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        model = current()
        if model is None:
            raise NoModelYet("train a model before scoring")
        messages = alert_messages(model, batch, threshold, utc_offset_hours)
        reports.publish_files(messages, root, batch_id)

    return on_batch
