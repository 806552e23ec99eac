"""Metric points from JSON messages and from counter text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ingest_json(
    df: DataFrame, body: str, fields: dict[str, str], measurement: str, keep: tuple[str, ...] = ()
) -> DataFrame:
    """JSON object fields become typed measurement fields under a given name."""
    schema = ", ".join(f"{name} {kind}" for name, kind in fields.items())
    parsed = F.from_json(F.col(body), schema)
    return df.select(*keep, F.lit(measurement).alias("measurement"), parsed.alias("_f")).select(
        *keep, "measurement", "_f.*"
    )


def json_points(df: DataFrame, body: str, measurement: str | Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, measurement, field, value): a metric point for every number in a JSON object, whatever its fields.

    No schema is named: the text becomes a VARIANT, and its fields are taken apart on the executors.
    Fields that hold no number give no point, nor do arrays, nested objects and text that is no JSON.
    """
    name = F.lit(measurement) if isinstance(measurement, str) else measurement
    parsed = df.select(*keep, name.alias("measurement"), F.try_parse_json(F.col(body)).alias("_object"))
    fields = df.sparkSession.tvf.variant_explode(F.col("_object").outer())
    number = F.schema_of_variant("value").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    points = parsed.lateralJoin(fields).filter(F.col("key").isNotNull() & number)
    return points.select(
        *keep, "measurement", F.col("key").alias("field"), F.variant_get("value", "$", "double").alias("value")
    )


def metric_points(df: DataFrame, fields: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per field of each measurement; missing fields give no point."""
    points = df.unpivot([*keep, "measurement"], fields, "field", "value")
    return points.filter(F.col("value").isNotNull())


def parse_counter_line(text: Column) -> list[Column]:
    """``slot | count`` text; null for header and footer lines."""
    parts = F.split(text, "[|]")
    return [
        F.trim(F.get(parts, F.lit(0))).alias("slot"),
        F.trim(F.get(parts, F.lit(1))).try_cast("bigint").alias("n"),
    ]


def counter_lines(df: DataFrame, text: str) -> DataFrame:
    return df.select(*parse_counter_line(F.col(text))).filter(F.col("n").isNotNull())


def counts_as_json(df: DataFrame, slot: str = "slot", n: str = "n") -> DataFrame:
    """Fold a counter table, one row per slot, into one JSON object.

    The fold runs over summed counters: a slot is a one-byte number, so at most 256 rows.
    """
    totals = df.groupBy(F.col(slot).alias("slot")).agg(F.sum(n).alias("n"))
    entries = F.sort_array(F.collect_list(F.struct("slot", "n")))
    return totals.agg(F.to_json(F.map_from_entries(entries)).alias("counts"))


def write_counts(df: DataFrame, text: str, label: str = "Local write count") -> DataFrame:
    """Sum of the counts of all status lines that carry ``label``."""
    value = F.regexp_extract(F.col(text), r"(\d+)\s*$", 1).try_cast("bigint")
    return df.filter(F.col(text).contains(label)).agg(F.sum(value).alias("write_count"))
