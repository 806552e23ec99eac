"""Keyed tables on plain Parquet.

A batch reduces its rows to one per key and writes them under its own ``batch_id``. Running
the batch again replaces exactly these files, so a retry after a lost executor or a restart
changes nothing. Readers merge the batches: the newest wins, or counts add up. ``compact``
folds all batches into one fresh table when too many have piled up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.upserts import latest_by_key

BATCH = "batch_id"
#: The batch of a compacted table; no stream gives this number, and every batch is newer.
BASE = -1


def overwrite(df: DataFrame, path: str, partitions: tuple[str, ...] = ()) -> None:
    """Replace an aggregate table.

    Rows of a partitioned table are gathered by partition first, otherwise every task would
    leave a file in every folder. Adaptive execution splits a partition too large for a task.
    """
    if partitions:
        df = df.hint("rebalance", *partitions)
    df.write.mode("overwrite").partitionBy(*partitions).parquet(path)


def write_batch(df: DataFrame, path: str, batch_id: int, partitions: tuple[str, ...] = ()) -> None:
    """Write a batch's rows, replacing whatever an earlier try of the same batch left."""
    overwrite(df, f"{path}/{BATCH}={batch_id}", partitions)


def read_batch(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    return spark.read.parquet(f"{path}/{BATCH}={batch_id}")


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path)


def upsert_batch(
    df: DataFrame,
    path: str,
    batch_id: int,
    keys: list[str],
    order: list[str],
    day: Column | None = None,
) -> None:
    """Write the last row of every key, laid out by day where the table has one."""
    last = latest_by_key(df, keys, order)
    if day is None:
        write_batch(last, path, batch_id)
    else:
        write_batch(last.withColumn("day_partition", day), path, batch_id, ("day_partition",))


def read_upserts(
    spark: SparkSession,
    path: str,
    keys: list[str],
    order: list[str],
    where: Column | None = None,
    newest: str = "batch",
) -> DataFrame:
    """Current rows of a table written by :func:`upsert_batch`.

    With ``newest="batch"`` a later batch overwrites an earlier one, as writes to a store do.
    With ``"order"`` the greatest ``order`` wins whichever batch brought it, so the result does
    not depend on how the input was cut into batches. ``where`` is applied before the merge, so
    a condition on ``day_partition`` prunes files.
    """
    rows = read_batches(spark, path)
    if where is not None:
        rows = rows.filter(where)
    by = {"batch": [BATCH, *order], "order": [*order, BATCH]}[newest]
    return latest_by_key(rows, keys, by).drop(BATCH, "day_partition")


def read_folded(
    spark: SparkSession, path: str, keys: list[str], value: str, fold: Callable[[str], Column] = F.max
) -> DataFrame:
    """Current rows of a per-key aggregate whose batches merge by ``fold``."""
    return read_batches(spark, path).groupBy(*keys).agg(fold(value).alias(value))


def mean_batch(df: DataFrame, path: str, batch_id: int, keys: list[str], value: str) -> None:
    """Write a batch's sums and counts per key, of which means over several batches can be formed."""
    sums = df.groupBy(*keys).agg(F.sum(value).alias("total"), F.count(value).alias("n"))
    write_batch(sums, path, batch_id)


def read_means(spark: SparkSession, path: str, keys: list[str], value: str) -> DataFrame:
    """Mean per key over all batches of :func:`mean_batch`; null where only nulls were seen."""
    sums = read_batches(spark, path).groupBy(*keys).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return sums.select(*keys, F.try_divide("total", "n").alias(value))


def increment_batch(df: DataFrame, path: str, batch_id: int, keys: list[str]) -> None:
    """Add a batch's row counts to a counter table."""
    write_batch(df.groupBy(*keys).agg(F.count("*").alias("n")), path, batch_id)


def read_counters(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    return read_folded(spark, path, keys, "n", F.sum)


def compact(current: DataFrame, target: str, day: Column | None = None) -> None:
    """Write the merged rows of a table as the base of a fresh one at ``target``.

    Batches that a stream later writes there, from 0 on, stand beside the base.
    """
    if day is None:
        write_batch(current, target, BASE)
    else:
        write_batch(current.withColumn("day_partition", day), target, BASE, ("day_partition",))
