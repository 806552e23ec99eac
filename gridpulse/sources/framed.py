"""Framed message logs as a Spark source and sink, in batches and as streams.

A log folder holds numbered logs, each a folder of segments named by the byte of the log at which they
start. A segment never changes once it has its name. It is a sequence of frames: subject length, payload
length (4 bytes each, big-endian; a length of ``NULL`` stands for null), subject in UTF-8, payload. An
offset is the end of every log, so a stream goes on at the byte where it stopped; a segment is a task.

Writers fill pending files, one or more a task. A commit first writes down where each of them goes and then
gives them their names, so a commit that breaks off is finished when its batch is repeated, and a batch
that is repeated after its commit adds nothing. Pending files of failed tasks are never read.
"""

from __future__ import annotations

import json
import struct
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamArrowWriter,
    DataSourceStreamReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.streaming import StreamingQuery

# The source travels with the query, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "subject string, payload binary"
_ARROW = pa.schema([("subject", pa.string()), ("payload", pa.binary())])
_HEAD = ">II"
_HEAD_BYTES = 8
NULL = 0xFFFFFFFF
SEGMENT_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
LOGS = 8


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, named by a path or a URI, and the folder within it."""
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(path)


def segments(path: str) -> dict[str, list[tuple[int, int, str]]]:
    """(start, end, file) of every segment, by log, as far as each log has no hole."""
    store, root = _open(path)
    logs: dict[str, list[tuple[int, int, str]]] = {}
    for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True)):
        log, _, name = info.path[len(root):].strip("/").partition("/")
        if log.isdigit() and name.endswith(".seg"):
            start = int(name[: -len(".seg")])
            logs.setdefault(log, []).append((start, start + info.size, info.path))
    for log, found in logs.items():
        found.sort()
        whole = next((i for i, s in enumerate(found) if s[0] != (found[i - 1][1] if i else 0)), len(found))
        del found[whole:]
    return logs


def ends(path: str) -> dict[str, int]:
    return {log: found[-1][1] for log, found in segments(path).items() if found}


@dataclass
class Stretch(InputPartition):
    """Bytes ``low`` to ``high`` of one segment; both lie between frames."""

    file: str
    low: int
    high: int

    def __post_init__(self) -> None:
        super().__init__(self.file)


def stretches(path: str, start: dict, end: dict) -> list[Stretch]:
    """What lies between two offsets; an error if a part of it is gone."""
    parts = []
    known = segments(path)
    for log, until in end.items():
        at = start.get(log, 0)
        for first, last, file in known.get(log, []):
            if first < until and last > at:
                parts.append(Stretch(file, max(at, first) - first, min(until, last) - first))
                at = min(until, last)
        if at < until:
            raise RuntimeError(f"log {log} has no bytes {at} to {until}")
    return parts


def unframe(data: bytes) -> pa.RecordBatch:
    """The messages of whole frames."""
    subjects, payloads, at = [], [], 0
    while at < len(data):
        one, two = struct.unpack_from(_HEAD, data, at)
        at += _HEAD_BYTES
        for size, out in ((one, subjects), (two, payloads)):
            out.append(None if size == NULL else data[at : at + size])
            at += 0 if size == NULL else size
    if at != len(data):
        raise ValueError("the last frame is cut off")
    return pa.RecordBatch.from_arrays([pa.array(subjects, pa.binary()).cast(pa.string()), pa.array(payloads, pa.binary())], schema=_ARROW)


def frame(subject: str | None, payload: bytes | None) -> bytes:
    one = None if subject is None else subject.encode()
    sizes = [NULL if part is None else len(part) for part in (one, payload)]
    return struct.pack(_HEAD, *sizes) + (one or b"") + (payload or b"")


def _whole(data: bytes) -> int:
    """Length of the whole frames at the head of ``data``."""
    at = 0
    while at + _HEAD_BYTES <= len(data):
        to = at + _HEAD_BYTES + sum(size for size in struct.unpack_from(_HEAD, data, at) if size != NULL)
        if to > len(data):
            break
        at = to
    return at


def read_stretch(path: str, part: Stretch) -> Iterator[pa.RecordBatch]:
    """The messages of a stretch, a few megabytes at once."""
    store, _ = _open(path)
    with store.open_input_file(part.file) as source:
        source.seek(part.low)
        left, held = part.high - part.low, b""
        while left:
            piece = source.read(min(left, BATCH_BYTES))
            if not piece:
                raise OSError(f"{part.file} ends early")
            left -= len(piece)
            held += piece
            cut = _whole(held)
            if cut:
                yield unframe(held[:cut])
            held = held[cut:]
        if held:
            raise ValueError(f"{part.file} ends within a frame")


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Stretch]:
        return stretches(self.path, {}, ends(self.path)) or [Stretch("", 0, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        return read_stretch(self.path, partition) if partition.file else iter(())


class _StreamReader(DataSourceStreamReader):
    def __init__(self, path: str, start: dict) -> None:
        self.path, self.start = path, start

    def initialOffset(self) -> dict:
        return self.start

    def latestOffset(self) -> dict:
        return {**self.start, **ends(self.path)}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        return stretches(self.path, start, end)

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        return read_stretch(self.path, partition)


@dataclass
class Pending(WriterCommitMessage):
    files: list[str]


class _Writer(DataSourceStreamArrowWriter):
    def __init__(self, path: str, logs: int) -> None:
        self.path, self.logs = path, logs

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Pending:
        store, root = _open(self.path)
        store.create_dir(f"{root}/_pending")
        files, out, size = [], None, 0
        try:
            for batch in iterator:
                for subject, payload in zip(batch["subject"].to_pylist(), batch["payload"].to_pylist()):
                    if out is None:
                        files.append(f"_pending/{uuid.uuid4().hex}")
                        out, size = store.open_output_stream(f"{root}/{files[-1]}"), 0
                    size += out.write(frame(subject, payload))
                    if size >= SEGMENT_BYTES:
                        out.close()
                        out = None
        except BaseException:
            if out is not None:
                out.close()
            self._drop(files)
            raise
        if out is not None:
            out.close()
        return Pending(files)

    def _drop(self, files: list[str]) -> None:
        store, root = _open(self.path)
        for info in store.get_file_info([f"{root}/{file}" for file in files]):
            if info.type == fs.FileType.File:
                store.delete_file(info.path)

    def commit(self, messages: list[Pending | None], batchId: int) -> None:
        store, root = _open(self.path)
        files = [file for message in messages if message for file in message.files]
        note = f"{root}/_commits/{batchId}"
        store.create_dir(f"{root}/_commits")
        if store.get_file_info(note).type == fs.FileType.NotFound:
            self._note(store, root, note, files)
            files = []
        with store.open_input_file(note) as source:
            places = json.loads(source.read())
        self._drop([file for file in files if file not in places])
        for file, target in places.items():
            if store.get_file_info(f"{root}/{target}").type == fs.FileType.NotFound:
                store.create_dir(f"{root}/{target.partition('/')[0]}")
                store.move(f"{root}/{file}", f"{root}/{target}")

    def _note(self, store: fs.FileSystem, root: str, note: str, files: list[str]) -> None:
        """Write down which place each file gets, under a name that only a whole note has."""
        at, places = ends(self.path), {}
        sizes = {info.path: info.size for info in store.get_file_info([f"{root}/{file}" for file in files])}
        for i, file in enumerate(files):
            log = str(i % self.logs)
            places[file] = f"{log}/{at.get(log, 0):020d}.seg"
            at[log] = at.get(log, 0) + sizes[f"{root}/{file}"]
        draft = f"{note}.{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as out:
            out.write(json.dumps(places).encode())
        store.move(draft, note)

    def abort(self, messages: list[Pending | None], batchId: int) -> None:
        self._drop([file for message in messages if message for file in message.files])


class _BatchWriter(DataSourceArrowWriter):
    """The same for one batch of a ``foreachBatch`` stream."""

    def __init__(self, writer: _Writer, batch_id: int) -> None:
        self.writer, self.batch_id = writer, batch_id

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Pending:
        return self.writer.write(iterator)

    def commit(self, messages: list[Pending | None]) -> None:
        self.writer.commit(messages, self.batch_id)

    def abort(self, messages: list[Pending | None]) -> None:
        self.writer.abort(messages, self.batch_id)


class FramedLogs(DataSource):
    """Format ``framed``. Options: ``path``; ``start``, the ends to begin after, as JSON; ``logs``, how
    many logs a writer fills; ``batch_id`` of a batch written outside a stream's own sink. One stream
    writes to a folder, as batches are told apart by their number."""

    @classmethod
    def name(cls) -> str:
        return "framed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"], json.loads(self.options.get("start", "{}")))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("framed logs are only appended to")
        logs = int(self.options.get("logs", LOGS))
        return _BatchWriter(_Writer(self.options["path"], logs), int(self.options["batch_id"]))

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _Writer(self.options["path"], int(self.options.get("logs", LOGS)))


def framed_stream(spark: SparkSession, path: str, start: dict[str, int] | None = None) -> DataFrame:
    """Messages of a log folder as a stream, from ``start`` (the :func:`ends` of an earlier time) on."""
    spark.dataSource.register(FramedLogs)
    return spark.readStream.format("framed").option("path", path).option("start", json.dumps(start or {})).load()


def framed_table(spark: SparkSession, path: str) -> DataFrame:
    """All messages of a log folder; none where it does not exist."""
    spark.dataSource.register(FramedLogs)
    return spark.read.format("framed").option("path", path).load()


def publish_framed(messages: DataFrame, path: str, checkpoint: str, logs: int = LOGS) -> StreamingQuery:
    """Start a stream that appends (subject, payload) to a log folder, each batch once, and drains its input."""
    messages.sparkSession.dataSource.register(FramedLogs)
    writer = messages.select("subject", "payload").writeStream.format("framed").option("path", path)
    return writer.option("logs", logs).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def publish_framed_batch(messages: DataFrame, path: str, batch_id: int, logs: int = LOGS) -> None:
    """Append one batch of (subject, payload); a batch that is there already adds nothing.

    For streams in update mode, which hand over their batches (:func:`~..streaming.runner.start`).
    """
    messages.sparkSession.dataSource.register(FramedLogs)
    writer = messages.select("subject", "payload").write.format("framed").option("path", path)
    writer.option("logs", logs).option("batch_id", batch_id).mode("append").save()
