"""Readings, temperatures, metrics and counters as views over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.payloads import WIDE_FIELDS, encode_long_float, encode_wide
from ..functions.subjects import data_subject
from ..functions.timeparts import bucket_start
from ..session import use_utc

HOUR = 3600
TEMPERATURE_EVENT = "view"
VOLTAGE_PREFIX = "raw.voltage.data"
TEMPERATURE_SUBJECT = "raw.temperature.data"

EVENTS_SCHEMA = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def register_table(spark: SparkSession, sf_dir: str, name: str, view: str | None = None) -> None:
    """Make a stored table known to ``spark.sql``."""
    table(spark, sf_dir, name).createOrReplaceTempView(view or name)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def epoch_of(ts: str | Column) -> Column:
    """Epoch seconds of a zone-less UTC time."""
    return F.unix_seconds((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def as_readings(events_df: DataFrame) -> DataFrame:
    """Voltage readings; works on batch and streaming frames."""
    line, transformer = F.col("user_id") % 3, F.col("user_id") % 10
    return events_df.filter(F.col("event_type") != TEMPERATURE_EVENT).select(
        "event_id",
        "ts",
        epoch_of("ts").alias("epoch"),
        line.alias("line"),
        transformer.alias("transformer"),
        F.col("user_id").alias("usage_point"),
        F.col("value").alias("voltage"),
        data_subject(VOLTAGE_PREFIX, line, transformer, F.col("user_id")).alias("subject"),
    )


def as_temperatures(events_df: DataFrame) -> DataFrame:
    return events_df.filter(F.col("event_type") == TEMPERATURE_EVENT).select(
        "event_id",
        "ts",
        epoch_of("ts").alias("epoch"),
        F.col("value").alias("temperature"),
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_readings(events(spark, sf_dir))


def temperatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_temperatures(events(spark, sf_dir))


def hourly(df: DataFrame) -> DataFrame:
    """Round the epoch down to the hour, the epoch grain of these tables."""
    return df.withColumn("epoch", bucket_start(F.col("epoch"), HOUR))


def readings_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings at the size of ``lineitem``."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("line"),
        F.col("l_suppkey").alias("transformer"),
        F.col("l_partkey").alias("usage_point"),
        F.col("l_orderkey").alias("reading_id"),
        F.col("l_quantity").alias("voltage"),
        F.col("l_shipdate").alias("ts"),
        epoch_of("l_shipdate").alias("epoch"),
    )


def as_messages(events_df: DataFrame) -> DataFrame:
    """Every event as a 12-byte message under its voltage or temperature subject."""
    user = F.col("user_id")
    voltage = data_subject(VOLTAGE_PREFIX, user % 3, user % 10, user)
    subject = F.when(F.col("event_type") == TEMPERATURE_EVENT, TEMPERATURE_SUBJECT).otherwise(voltage)
    return events_df.select(
        "event_id",
        "ts",
        subject.alias("subject"),
        encode_long_float(epoch_of("ts"), F.col("value").cast("float")).alias("payload"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_messages(events(spark, sf_dir))


def as_wide_messages(events_df: DataFrame) -> DataFrame:
    """Readings as 56-byte messages: demand and val3..val12 step up from the voltage."""
    fields = F.struct(
        *[(F.col("voltage") + i).cast("float").alias(f) for i, f in enumerate(WIDE_FIELDS)]
    )
    return as_readings(events_df).select(
        "event_id", "subject", encode_wide(F.col("epoch"), fields).alias("payload")
    )


def wide_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_wide_messages(events(spark, sf_dir))


FLUSH_SECONDS = 300


def as_metrics(events_df: DataFrame) -> DataFrame:
    """Flushed statistics of each event type: one point per flush and statistic."""
    flushed = (
        events_df.groupBy("event_type", bucket_start(epoch_of("ts"), FLUSH_SECONDS).alias("epoch"))
        .agg(
            F.count("*").cast("double").alias("n"),
            F.min("value").alias("lo"),
            F.max("value").alias("hi"),
            F.sum("value").alias("total"),
            F.avg("value").alias("mean"),
        )
    )
    statistics = F.expr(
        "stack(5, 'count', n, 'lower', lo, 'upper', hi, 'sum', total, 'mean', mean)"
    ).alias("statistic", "value")
    return flushed.select("event_type", "epoch", statistics).select(
        F.concat_ws(".", F.lit("app"), "event_type", "statistic").alias("name"), "epoch", "value"
    )


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_metrics(events(spark, sf_dir))


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A counter per event type, read every hour and reset at midnight.

    Only the hourly counts are windowed, so a series is as long as the time range has hours.
    """
    counts = (
        events(spark, sf_dir)
        .groupBy("event_type", bucket_start(epoch_of("ts"), HOUR).alias("epoch"))
        .agg(F.count("*").alias("n"))
    )
    return counts.selectExpr(
        "event_type",
        "epoch",
        "sum(n) over (partition by event_type, epoch div 86400 order by epoch) as counter",
    )
