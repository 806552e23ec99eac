"""The stream jobs: raw storage, maxima, temperatures and alerts.

Each job is given as a ``foreachBatch`` handler, so the operators inside are the batch ones.
Handlers write under the batch id and can be repeated without effect.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.casts import raw_types
from ..functions.payloads import WIDE_FIELDS
from ..functions.subjects import alert_subject, append_token, report_subject
from ..functions.timeparts import calendar_parts, local_date
from ..operators import aggregates as agg
from ..sinks import reports, tables

BatchHandler = Callable[[DataFrame, int], None]

POINT_KEY = ["line", "transformer", "usage_point", "year", "month", "day", "hour", "minute"]


def reduce_each_batch(path: str, reduce: Callable[[DataFrame], DataFrame]) -> BatchHandler:
    """Reduce every batch on its own and store the result under its batch id."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        tables.write_batch(reduce(batch), path, batch_id)

    return on_batch


WRITE_ORDER = ("ts", "event_id")


def raw_rows(
    readings: DataFrame,
    utc_offset_hours: int = 0,
    values: tuple[str, ...] = ("voltage",),
    order: tuple[str, ...] = WRITE_ORDER,
) -> DataFrame:
    """Readings with the calendar parts that make up the raw table's key.

    ``order`` names the columns that tell which of two rows was written last.
    """
    ids = {name: F.col(name) for name in ("line", "transformer", "usage_point")}
    return readings.select(
        *raw_types(ids),
        *calendar_parts(F.col("epoch"), utc_offset_hours),
        local_date(F.col("epoch"), utc_offset_hours).alias("date"),
        *values,
        *order,
    )


def store_readings(
    root: str,
    subject: str = "extract",
    log_level: str = "",
    order: tuple[str, ...] = WRITE_ORDER,
) -> BatchHandler:
    """One input, four outputs: raw rows, counts per line, maxima per epoch and their report.

    The batch is kept while the outputs are written, so its source is read and decoded once;
    lost blocks are recomputed from the replayable source. The report is made from the stored
    maxima, which are few, instead of reducing the batch again.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            raw = raw_rows(batch, order=order)
            reports.show_stage(raw, "RAW_DATA", log_level)
            tables.upsert_batch(
                raw, f"{root}/raw", batch_id, POINT_KEY, list(order), F.col("date")
            )
            tables.increment_batch(batch, f"{root}/counts", batch_id, ["line"])
            tables.write_batch(agg.max_by_epoch(batch, "voltage"), f"{root}/max", batch_id)
            maxima = tables.read_batch(batch.sparkSession, f"{root}/max", batch_id)
            reports.show_stage(maxima, "MAX", log_level)
            out = append_token(F.lit(subject), "voltage.max")
            report = reports.json_report(maxima, "voltage", out)
            reports.show_stage(report, "MAX_REPORT", log_level)
            reports.publish_files(report, f"{root}/max_report", batch_id)
        finally:
            batch.unpersist()

    return on_batch


def store_messages(
    root: str,
    slot: str,
    values: tuple[str, ...] = tuple(WIDE_FIELDS),
    order: tuple[str, ...] = ("epoch",),
) -> BatchHandler:
    """The raw bridge: every decoded message to the raw table, and counts per writer slot."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            raw = raw_rows(batch, values=values, order=order)
            tables.upsert_batch(
                raw, f"{root}/raw", batch_id, POINT_KEY, list(order), F.col("date")
            )
            slotted = batch.withColumn("slot", F.lit(slot))
            tables.increment_batch(slotted, f"{root}/counts", batch_id, ["slot"])
        finally:
            batch.unpersist()

    return on_batch


def store_temperatures(root: str, subject: str = "extract", how: str = "max") -> BatchHandler:
    """One temperature per epoch, stored and reported: the largest, or with ``how="avg"`` the mean.

    Means are stored as sums and counts, so that :func:`~..sinks.tables.read_means` does not depend on
    how an epoch was cut into batches. The report of a batch gives what its own rows say.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        path = f"{root}/temperature"
        if how == "avg":
            tables.mean_batch(batch, path, batch_id, ["epoch"], "temperature")
            sums = tables.read_batch(batch.sparkSession, path, batch_id)
            single = sums.select("epoch", F.try_divide("total", "n").alias("temperature"))
        else:
            tables.write_batch(agg.single_temperature(batch, how), path, batch_id)
            single = tables.read_batch(batch.sparkSession, path, batch_id)
        out = append_token(F.lit(subject), "temperature.max")
        reports.publish_files(
            reports.json_report(single, "temperature", out), f"{root}/temperature_report", batch_id
        )

    return on_batch


def _below(output: Column) -> Column:
    return F.concat_ws(".", output, F.col("subject"))


def _alert_outputs(maxima: DataFrame, alerts: DataFrame, value: str, subject: str) -> dict[str, DataFrame]:
    """Maxima and alerts as binary and as text messages.

    Messages go out below ``subject``, with the subject they came in under as the tail. Only the
    output subject is rewritten for alerts and reports.
    """
    maximum, alert = F.lit(subject), alert_subject(F.lit(subject))
    return {
        "subject_max": reports.binary_values(maxima, value, _below(maximum)),
        "subject_max_text": reports.text_report(maxima, value, _below(report_subject(maximum))),
        "alert": reports.binary_counts(alerts, "n", _below(alert)),
        "alert_text": reports.text_report(alerts, "n", _below(report_subject(alert))),
    }


def publish_alerts(
    root: str,
    value: str = "value",
    limit: float = agg.OFF_LIMIT,
    count: int = agg.OFF_LIMIT_COUNT,
    log_level: str = "",
    subject: str = "extract.voltage.max",
) -> BatchHandler:
    """Per subject of a batch of readings: the maxima and the alerts, without memory of other batches.

    What comes out follows the batches; :func:`publish_states` does not.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            maxima = agg.max_by_subject(batch, value)
            alerts = agg.alerts(batch, value, limit=limit, count=count)
            reports.show_stage(maxima, "MAX", log_level)
            reports.show_stage(alerts, "ALERTS", log_level)
            for name, messages in _alert_outputs(maxima, alerts, value, subject).items():
                reports.publish_files(messages, f"{root}/{name}", batch_id)
        finally:
            batch.unpersist()

    return on_batch


def publish_states(
    root: str,
    count: int = agg.OFF_LIMIT_COUNT,
    log_level: str = "",
    subject: str = "extract.voltage.max",
) -> BatchHandler:
    """Maxima and alerts of the subjects whose :func:`~.state.subject_states` a batch changed.

    The last message of a subject holds for all its readings so far, see :func:`~..sinks.reports.newest`.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            alerts = batch.filter(F.col("n") >= count).select("subject", F.col("first_epoch").alias("epoch"), "n")
            reports.show_stage(batch, "MAX", log_level)
            reports.show_stage(alerts, "ALERTS", log_level)
            values = batch.withColumn("value", F.col("value").cast("float"))
            for name, messages in _alert_outputs(values, alerts, "value", subject).items():
                reports.publish_files(messages, f"{root}/{name}", batch_id)
        finally:
            batch.unpersist()

    return on_batch


def _bounded(stream: DataFrame, time: str, lateness: str | None) -> DataFrame:
    return stream if lateness is None else stream.withWatermark(time, lateness)


def windowed_max(
    stream: DataFrame, value: str, time: str = "event_time", width: str = "5 seconds",
    lateness: str | None = "1 minute",
) -> DataFrame:
    """Largest value per event-time window; state is one row per open window.

    Without ``lateness`` no row is late and no window closes. That is for a stored table, whose
    files come in any order and whose stream ends.
    """
    windows = _bounded(stream, time, lateness).groupBy(F.window(time, width).alias("w"))
    return windows.agg(F.max(value).alias(value)).select(
        F.unix_seconds("w.start").alias("bucket"), value
    )


def windowed_alerts(
    stream: DataFrame, value: str, keys: list[str], time: str = "event_time",
    width: str = "5 seconds", lateness: str | None = "1 minute",
    limit: float = agg.OFF_LIMIT, count: int = agg.OFF_LIMIT_COUNT,
) -> DataFrame:
    """Keys with at least ``count`` off-limit readings in an event-time window.

    ``lateness`` as for :func:`windowed_max`.
    """
    beyond = _bounded(agg.off_limits(stream, value, limit), time, lateness)
    counted = beyond.groupBy(*keys, F.window(time, width).alias("w")).agg(
        F.min("epoch").alias("epoch"), F.count("*").alias("n")
    )
    return counted.filter(F.col("n") >= count).select(
        *keys, F.unix_seconds("w.start").alias("bucket"), "epoch", "n"
    )


def store_updates(path: str) -> BatchHandler:
    """Store the updated windows of an ``update`` mode query; the newest batch counts."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        tables.write_batch(batch, path, batch_id)

    return on_batch
