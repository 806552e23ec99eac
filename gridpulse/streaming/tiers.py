"""Tiers of a metric store, kept up to date batch by batch.

A batch leaves the last point of every fine slot it touches, with the order that makes it the last, so
fine slots of several batches merge by taking the greatest. Then the coarse slots above them are formed
anew from the merged fine slots, whatever batch those came from; a late point thus reopens its slot. Both
tiers are laid out by periods of four weeks, and a batch reads only the periods that it touches.

Percentiles do not merge, their sketches do: a batch leaves one of every fine slot that it touches, and
any wider slot merges those of all batches in it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeparts import DAY, bucket_start
from ..operators import buckets, percentiles
from ..sinks import tables


#: Seconds of a partition: few files a batch, and no more to read again than a late point asks for.
LAYOUT = 28 * DAY


def _period(time: str) -> Column:
    return bucket_start(F.col(time), LAYOUT)


def merged_fine(rows: DataFrame) -> DataFrame:
    """(name, bucket, value) of the fine slots of all ``rows``."""
    last = F.max(F.struct("order", "value")).alias("last")
    return rows.groupBy("name", "bucket").agg(last).select("name", "bucket", "last.value")


def store_tiers(
    root: str,
    fine_seconds: int = buckets.FINE_TIER[0],
    coarse_seconds: int = buckets.COARSE_TIER[0],
    order: tuple[str, ...] = ("epoch",),
) -> Callable[[DataFrame, int], None]:
    """Handler for batches of ``(name, epoch, value)`` points. Of points of equal ``order`` the greater value is last.

    A batch that is repeated finds its own earlier fine slots replaced and forms the same coarse ones.
    """
    if coarse_seconds % fine_seconds:
        raise ValueError("a coarse slot must hold a whole number of fine slots")
    if LAYOUT % coarse_seconds:
        raise ValueError("a period must hold a whole number of coarse slots")

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last = F.max(F.struct(F.struct(*order).alias("order"), "value")).alias("last")
        slots = batch.groupBy("name", bucket_start(F.col("epoch"), fine_seconds).alias("bucket")).agg(last)
        fine = slots.select("name", "bucket", "last.order", "last.value", _period("bucket").alias("period"))
        tables.write_batch(fine, f"{root}/fine", batch_id, ("period",))

        touched = tables.read_batch(spark, f"{root}/fine", batch_id).select(
            "period", "name", bucket_start(F.col("bucket"), coarse_seconds).alias("slot")
        ).distinct()
        known = tables.read_batches(spark, f"{root}/fine").filter(F.col(tables.BATCH) <= batch_id)
        # the periods of the batch, one row each, prune the files; its slots pick the rows
        known = known.join(F.broadcast(touched.select("period").distinct()), "period", "left_semi")
        known = known.withColumn("slot", bucket_start(F.col("bucket"), coarse_seconds))
        known = known.join(touched.select("name", "slot"), ["name", "slot"], "left_semi")
        coarse = buckets.coarse_slots(merged_fine(known), coarse_seconds)
        tables.write_batch(coarse.withColumn("period", _period("slot")), f"{root}/coarse", batch_id, ("period",))

    return on_batch


def read_fine(spark: SparkSession, root: str) -> DataFrame:
    """(name, bucket, value): the fine tier."""
    return merged_fine(tables.read_batches(spark, f"{root}/fine"))


def read_coarse(
    spark: SparkSession,
    root: str,
    fine_seconds: int = buckets.FINE_TIER[0],
    coarse_seconds: int = buckets.COARSE_TIER[0],
    rules: list[buckets.Rule] = buckets.RULES,
) -> DataFrame:
    """(name, slot, known, value): the coarse tier, each slot as the newest batch that touched it left it."""
    newest = tables.latest_by_key(
        tables.read_batches(spark, f"{root}/coarse"), ["name", "slot"], [tables.BATCH]
    )
    return buckets.by_rules(newest, coarse_seconds // fine_seconds, rules)


def retained(spark: SparkSession, root: str, now: Column, **widths: int) -> DataFrame:
    """Both tiers as (name, bucket, value, tier), each cut to its retention before ``now``."""
    coarse = read_coarse(spark, root, **widths).select("name", F.col("slot").alias("bucket"), "value")
    tiers = {"fine": (read_fine(spark, root), buckets.FINE_TIER[1]), "coarse": (coarse, buckets.COARSE_TIER[1])}
    return buckets.retain(tiers, "bucket", now)


def store_sketches(root: str, fine_seconds: int = buckets.FINE_TIER[0]) -> Callable[[DataFrame, int], None]:
    """Handler for batches of ``(name, epoch, value)`` points: a quantile sketch per name and fine slot.

    A batch that is repeated replaces its own sketches, so no point counts twice.
    """
    if LAYOUT % fine_seconds:
        raise ValueError("a period must hold a whole number of fine slots")

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        slots = batch.withColumn("bucket", bucket_start(F.col("epoch"), fine_seconds))
        rows = percentiles.sketches(slots, "value", ["name", "bucket"])
        tables.write_batch(rows.withColumn("period", _period("bucket")), f"{root}/sketches", batch_id, ("period",))

    return on_batch


def read_percentile(
    spark: SparkSession, root: str, seconds: int, fraction: float, where: Column | None = None
) -> DataFrame:
    """(name, slot, n, value): a percentile per slot of ``seconds``, a multiple of the fine slots' width.

    Its rank is off by at most ``percentiles.RANK_ERROR``. ``where`` may select names, buckets and, to
    prune files, periods.
    """
    rows = tables.read_batches(spark, f"{root}/sketches")
    if where is not None:
        rows = rows.filter(where)
    slot = bucket_start(F.col("bucket"), seconds).alias("slot")
    return percentiles.sketched_percentile(percentiles.merged_sketches(rows, ["name", slot]), fraction, "value")
