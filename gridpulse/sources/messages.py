"""Message streams of ``(subject, payload)`` and their decoding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.payloads import decode_reading
from ..functions.subjects import subject_matches, subject_tokens

MESSAGE_SCHEMA = "subject string, payload binary"

Decoder = Callable[[Column], list[Column]]


def message_files(
    spark: SparkSession, path: str, schema: str = MESSAGE_SCHEMA, files_per_batch: int | None = None
) -> DataFrame:
    """Stream of messages landed as Parquet files, replayable from the checkpoint."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def message_topic(spark: SparkSession, servers: str, topics: str, **options: str) -> DataFrame:
    """Stream of messages from Kafka; needs the Kafka package on the cluster."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
    return (
        reader.option("subscribe", topics)
        .options(**options)
        .load()
        .select(F.col("key").cast("string").alias("subject"), F.col("value").alias("payload"))
    )


FILES_PER_BATCH = 1000


def table_stream(
    spark: SparkSession, sf_dir: str, name: str, schema: str, files_per_batch: int = FILES_PER_BATCH
) -> DataFrame:
    """A stored table, one file or a folder of them, read as a stream."""
    # A glob that matches just this name: a file source takes no plain file as its path.
    path = f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet"
    return message_files(spark, path, schema, files_per_batch)


def keyed(
    messages: DataFrame, pattern: str, decoder: Decoder = decode_reading, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Decoded messages of the matching subjects, with the subject as key."""
    chosen = messages.filter(subject_matches(F.col("subject"), pattern))
    return chosen.select(*keep, "subject", *decoder(F.col("payload")))


def point_readings(
    messages: DataFrame, pattern: str, decoder: Decoder = decode_reading, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Decoded messages with line, transformer and usage_point taken from the subject."""
    return keyed(messages, pattern, decoder, keep).select("*", *subject_tokens(F.col("subject")))


def unkeyed(
    messages: DataFrame, pattern: str, decoder: Decoder = decode_reading, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Decoded messages of the matching subjects without their key."""
    chosen = messages.filter(subject_matches(F.col("subject"), pattern))
    return chosen.select(*keep, *decoder(F.col("payload")))
