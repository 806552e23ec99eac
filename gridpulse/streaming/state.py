"""What is known of each subject so far, as keyed state that outlives the micro-batch.

The state of a subject is one row: its latest epoch, its largest value, and the number and first
epoch of its off-limit readings. Every batch puts out the subjects that it changed. The last row of
a subject is therefore the same however its readings were cut into batches, and two off-limit
readings raise an alert in whichever batches they arrive.

Subjects that are kept for good are aggregated by Spark itself. Only a time to live needs a function of
each subject's own, whose cost is a call into Python per subject and batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.aggregates import OFF_LIMIT

#: Seconds after which a silent subject is forgotten.
TIME_TO_LIVE = 7 * 86400

COLUMNS = ["epoch", "value", "n", "first_epoch"]
KNOWN = "epoch bigint, value double, n bigint, first_epoch bigint"


def _least(a, b):
    return b if a is None else a if b is None else min(a, b)


def _most(a, b):
    return b if a is None else a if b is None else max(a, b)


def merged(one: tuple, two: tuple) -> tuple:
    """What two parts of a subject's readings say together; None is nothing yet."""
    return _most(one[0], two[0]), _most(one[1], two[1]), one[2] + two[2], _least(one[3], two[3])


def _aggregated(readings: DataFrame, limit: float) -> DataFrame:
    """The same states as a streaming aggregate; as there, a value that is no number counts as null."""
    value = F.when(~F.isnan("value"), F.col("value"))
    beyond = F.coalesce(value > limit, F.lit(False))
    return readings.groupBy("subject").agg(
        F.max("epoch").alias("epoch"),
        F.max(value).alias("value"),
        F.count_if(beyond).alias("n"),
        F.min(F.when(beyond, F.col("epoch"))).alias("first_epoch"),
    )


def _update(ttl_seconds: int):
    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = state.get if state.exists else (None, None, 0, None)
        for part in parts:
            for row in part[COLUMNS].itertuples(index=False):
                known = merged(known, tuple(None if pd.isna(x) else x for x in row))
        # whole numbers come as floats where a column has nulls
        known = tuple(None if x is None else kind(x) for kind, x in zip((int, float, int, int), known))
        state.update(known)
        state.setTimeoutDuration(ttl_seconds * 1000)
        found = pd.DataFrame([(key[0], *known)], columns=["subject", *COLUMNS])
        yield found.astype({"epoch": "Int64", "n": "Int64", "first_epoch": "Int64", "value": "float64"})

    return update


def _partial(limit: float):
    """One row per subject and Arrow batch, so that a hot subject sends few rows to its state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            beyond = pa.compute.fill_null(pa.compute.greater(table["value"], limit), False)
            table = table.append_column("n", beyond.cast(pa.int64())).append_column(
                "first_epoch", pa.compute.if_else(beyond, table["epoch"], pa.scalar(None, pa.int64()))
            )
            sums = table.group_by("subject").aggregate(
                [("epoch", "max"), ("value", "max"), ("n", "sum"), ("first_epoch", "min")]
            )
            sums = sums.select(["subject", "epoch_max", "value_max", "n_sum", "first_epoch_min"])
            yield from sums.rename_columns(["subject", "epoch", "value", "n", "first_epoch"]).to_batches()

    return run


def subject_states(
    stream: DataFrame,
    value: str = "value",
    limit: float = OFF_LIMIT,
    ttl_seconds: int | None = None,
) -> DataFrame:
    """(subject, epoch, value, n, first_epoch) of the subjects that a batch changed, in update mode.

    ``n`` readings were strictly above ``limit``, the first at ``first_epoch``. A subject without a reading
    for ``ttl_seconds`` starts anew; None keeps all subjects. Time to live is processing time, and waiting
    for it a stream never ends, so a stream that drains what is there has to go without. A null
    subject is a subject too.
    """
    slim = stream.select("subject", F.col("epoch").cast("bigint").alias("epoch"), F.col(value).cast("double").alias("value"))
    if ttl_seconds is None:
        return _aggregated(slim, limit)
    partial = slim.mapInArrow(_partial(limit), f"subject string, {KNOWN}")
    return partial.groupBy("subject").applyInPandasWithState(
        _update(ttl_seconds), f"subject string, {KNOWN}", KNOWN, "update", GroupStateTimeout.ProcessingTimeTimeout
    )
