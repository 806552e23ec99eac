"""Maxima and temperatures joined while both still arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.prediction import THRESHOLD, training_columns
from ..sinks import tables

LATENESS = "1 hour"


def joined(maxima: DataFrame, temperatures: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """(epoch, voltage, temperature) for every pair of rows of one epoch, as soon as both are there.

    Both streams have a watermark on the time of their epoch. A row whose partner may still come is
    kept as state; once both streams are ``lateness`` past its epoch it goes, and later rows of that
    epoch are late. An epoch that is reported again gives a further pair, see :func:`read_features`.
    """

    def timed(stream: DataFrame, value: str) -> DataFrame:
        time = F.timestamp_seconds(F.col("epoch")).alias("time")
        return stream.select("epoch", value, time).withWatermark("time", lateness)

    return timed(maxima, "voltage").join(timed(temperatures, "temperature"), ["epoch", "time"]).drop("time")


def read_features(
    spark: SparkSession, path: str, threshold: float = THRESHOLD, utc_offset_hours: int = 0
) -> DataFrame:
    """Training rows of the stored pairs, the greatest value of each side deciding."""
    pairs = tables.read_batches(spark, path).groupBy("epoch")
    greatest = pairs.agg(F.max("voltage").alias("voltage"), F.max("temperature").alias("temperature"))
    return training_columns(greatest, threshold, utc_offset_hours)
