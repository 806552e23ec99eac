"""Cutting lineage through the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a local master without one gets its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def bounded_batches(spark: SparkSession) -> None:
    """Batches for Python end at ``BATCH_BYTES`` too, unless the session has a limit of its own.

    By rows alone a batch is 10,000 texts of any length, which the JVM and the worker hold several times.
    """
    if BATCH_LIMIT not in spark.conf.getAll:
        spark.conf.set(BATCH_LIMIT, BATCH_BYTES)


def cut(frame: DataFrame) -> DataFrame:
    """The frame as a reliable checkpoint: computed once, and safe when executors are lost."""
    checkpoint_dir(frame.sparkSession)
    return frame.checkpoint()


def stored(frame: DataFrame) -> DataFrame:
    """The frame as a compressed table in the shared folder, for intermediate rows that are many."""
    path = f"{checkpoint_dir(frame.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.parquet(path)


def packed(documents: DataFrame, **columns: str) -> DataFrame:
    """Named columns beside the whole row as ``row``, so that no other name can clash."""
    from pyspark.sql import functions as F

    return documents.select(
        F.struct(*[documents[f"`{name}`"] for name in documents.columns]).alias("row"),
        *[documents[f"`{name}`"].alias(new) for new, name in columns.items()],
    )
