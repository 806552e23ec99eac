"""Published messages: JSON reports, keyed text and keyed binary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.payloads import encode_long_float, encode_long_int
from ..operators.upserts import latest_by_key


def json_report(df: DataFrame, value: str, subject: Column | None = None) -> DataFrame:
    """``{"epoch": n, "<value>": x}`` messages."""
    body = F.to_json(F.struct("epoch", value)).alias("message")
    return df.select(body) if subject is None else df.select(subject.alias("subject"), body)


def prediction_json(epoch: Column, temperature: Column, threshold: float) -> Column:
    """``{"timestamp": ms, "temperature": x, "alert": threshold}`` message."""
    return F.to_json(
        F.struct(
            (epoch * 1000).alias("timestamp"),
            temperature.alias("temperature"),
            F.lit(threshold).alias("alert"),
        )
    )


def text_report(df: DataFrame, value: str, subject: Column) -> DataFrame:
    """The value as text under its subject."""
    return df.select(subject.alias("subject"), F.col(value).cast("string").alias("message"))


def key_values(
    df: DataFrame, subject: Column, encoder: Callable[..., Column], *fields: Column
) -> DataFrame:
    """Binary messages under their subject; ``encoder`` is any vectorised function of the fields."""
    return df.select(subject.alias("subject"), encoder(*fields).alias("payload"))


def binary_values(df: DataFrame, value: str, subject: Column) -> DataFrame:
    """12-byte messages of epoch and single-precision value."""
    return key_values(df, subject, encode_long_float, F.col("epoch"), F.col(value).cast("float"))


def binary_counts(df: DataFrame, count: str, subject: Column) -> DataFrame:
    """12-byte messages of epoch and 32-bit count."""
    return key_values(df, subject, encode_long_int, F.col("epoch"), F.col(count).cast("int"))


def publish_files(messages: DataFrame, path: str, batch_id: int) -> None:
    """Land a batch of messages where a file stream can pick them up."""
    messages.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def newest(spark: SparkSession, path: str, keys: tuple[str, ...] = ("subject",)) -> DataFrame:
    """The last message of every subject of those that :func:`publish_files` landed below ``path``."""
    landed = spark.read.option("basePath", path).parquet(path)
    return latest_by_key(landed, list(keys), ["batch_id"]).drop("batch_id")


def publish_topic(messages: DataFrame, servers: str, topic: str) -> None:
    """Send a batch of messages to Kafka; needs the Kafka package on the cluster."""
    body = "payload" if "payload" in messages.columns else "message"
    key = [F.col("subject").alias("key")] if "subject" in messages.columns else []
    sent = messages.select(*key, F.col(body).alias("value"))
    sent.write.format("kafka").option("kafka.bootstrap.servers", servers).option(
        "topic", topic
    ).save()


def show_stage(df: DataFrame, stage: str, log_level: str, n: int = 10) -> DataFrame:
    """Print the first rows of a stage when ``log_level`` names it, and pass it on."""
    if stage in log_level:
        df.show(n, truncate=False)
    return df
