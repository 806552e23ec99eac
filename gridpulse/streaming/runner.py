"""Starting streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

DEFAULT_INTERVAL = "5 seconds"


def start(
    stream: DataFrame,
    on_batch: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
    interval: str | None = DEFAULT_INTERVAL,
) -> StreamingQuery:
    """Hand every micro-batch to ``on_batch``; ``interval=None`` drains what is there and stops."""
    writer = stream.writeStream.foreachBatch(on_batch).outputMode(mode)
    writer = writer.option("checkpointLocation", checkpoint)
    if interval is None:
        writer = writer.trigger(availableNow=True)
    else:
        writer = writer.trigger(processingTime=interval)
    return writer.start()


def drain(
    stream: DataFrame,
    on_batch: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
) -> None:
    """Run the stream over all input that is there now, in as many batches as it takes."""
    start(stream, on_batch, checkpoint, mode, interval=None).awaitTermination()
