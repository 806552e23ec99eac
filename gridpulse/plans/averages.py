"""The batch job: average voltage per transformer and day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timeparts import calendar_parts
from ..operators.aggregates import average_by
from ..sinks.tables import overwrite

DAY_KEYS = ["line", "transformer", "year", "month", "day"]
MONTH_KEYS = ["line", "year", "month"]


def average_voltage(readings: DataFrame, keys: list[str] = DAY_KEYS) -> DataFrame:
    """Mean voltage per line, transformer and calendar day, or by any coarser ``keys``."""
    dated = readings.select("line", "transformer", "voltage", *calendar_parts(F.col("epoch")))
    return average_by(dated, keys, "voltage")


def run(raw: DataFrame, target: str) -> DataFrame:
    """Register the raw table as a SQL view, average it and replace the result table."""
    spark = raw.sparkSession
    raw.createOrReplaceTempView("raw_data")
    overwrite(average_by(spark.sql("select * from raw_data"), DAY_KEYS, "voltage"), target)
    return spark.read.parquet(target)
