"""WARC archives: written and read back with Spark, their index merged from sorted runs.

A record is one string, and Spark's text writer puts the blank lines between records, so archives
come from committed tasks and survive lost executors. Each archive is read by one task, record by
record, and gives one run of the index, sorted by URL key and time. The runs are dealt out by key
ranges (a hot URL is split by time), and in each range a loser tree merges them, so the ranges in
order are the capture history of all URLs.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from operator import itemgetter
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpulse.llm.work import checkpoint_dir, cut

#: Payloads below this many bytes are stored again rather than referred to.
LEAST_SHARED = 100
RECORDS_PER_FILE = 4000
END = "\r\n\r\n"
READ_BYTES = 1 << 20


def capture_time(page_id: Column) -> Column:
    """A time for tables without one: seconds after the start of 2024 by page, within ten years."""
    seconds = F.pmod(F.coalesce(page_id.cast("bigint"), F.lit(0)), F.lit(315_360_000))
    days, rest = F.floor(seconds / 86400).cast("int"), seconds % 86400
    clock = [F.lpad((x).cast("int").cast("string"), 2, "0") for x in (F.floor(rest / 3600), F.floor(rest / 60) % 60, rest % 60)]
    return F.concat(F.date_add(F.lit("2024-01-01").cast("date"), days).cast("string"), F.lit("T"), F.concat_ws(":", *clock), F.lit("Z"))


def planned(pages: DataFrame, time: Column | None = None) -> DataFrame:
    """(page_id, url, captured, html, digest, bytes, refers_to): what each record will be.

    Only digests are grouped; of equal payloads the smallest page id (nulls aside) is the response.
    Rows that repeat its id are responses too, as are all rows whose ids are null.
    """
    rows = pages.select(
        F.col("page_id"),
        "url",
        (capture_time(F.col("page_id")) if time is None else time).alias("captured"),
        F.coalesce("html", F.lit("")).alias("html"),
    ).withColumns({"digest": F.sha2("html", 256), "bytes": F.octet_length("html").cast("long")})
    shared = (
        rows.filter(F.col("bytes") >= LEAST_SHARED)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1 and first is not null")
        .drop("n")
    )
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(shared, "digest", "left").withColumn("refers_to", refers).drop("first")


def records(planned_pages: DataFrame) -> DataFrame:
    """One string per record, without the blank lines that end it."""
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("bytes").cast("string"),
        F.lit(END),
    )
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))

    def header(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    page = F.col("page_id").cast("string")
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(page, F.lit("none")), F.lit(">"))),
        header("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20]", "")),
        header("WARC-Date", F.col("captured")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        header("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        header("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        header("Content-Length", F.octet_length("block").cast("string")),
    )
    return planned_pages.withColumn("block", block).select(F.concat(head, F.lit("\r\n"), F.col("block")).alias("value"))


def write(pages: DataFrame, path: str, time: Column | None = None) -> None:
    """Writes one gzip-compressed archive per part of the input, none with more than a few thousand records."""
    (
        records(planned(pages, time))
        .write.option("lineSep", END)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", RECORDS_PER_FILE)
        .text(path)
    )


class _Stream:
    """Bytes of a compressed archive, a little at a time."""

    def __init__(self, content: bytes):
        self.content, self.at, self.held, self.offset = memoryview(content), 0, b"", 0
        self.inflate = zlib.decompressobj(31)

    def more(self) -> bool:
        while self.at < len(self.content) or self.inflate.unconsumed_tail:
            source = self.inflate.unconsumed_tail
            if not source:
                source = self.content[self.at : self.at + READ_BYTES]
                self.at += len(source)
            part = self.inflate.decompress(source, 8 * READ_BYTES)
            if part:
                self.held += part
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        at = self.held.find(mark)
        while at < 0:
            known = len(self.held)
            if not self.more():
                return None
            at = self.held.find(mark, max(0, known - len(mark)))
        return self.take(at + len(mark))

    def take(self, n: int) -> bytes:
        if len(self.held) < n:
            parts, size = [self.held], len(self.held)
            self.held = b""
            while size < n:
                if not self.more():
                    raise ValueError("the archive ends within a record")
                parts.append(self.held)
                size += len(self.held)
                self.held = b""
            self.held = b"".join(parts)
        out, self.held = self.held[:n], self.held[n:]
        self.offset += n
        return out


def parse(content: bytes) -> Iterator[dict]:
    """The records of an archive: headers by lower-case name, payload, and offset in the inflated bytes."""
    stream = _Stream(content)
    while True:
        offset = stream.offset
        head = stream.until(END.encode())
        if head is None:
            if stream.held:
                raise ValueError("the archive ends within a header")
            return
        lines = head.decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"not a record at byte {offset}")
        record = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:] if line)}
        block = stream.take(int(record["content-length"]))
        if stream.take(len(END)) != END.encode():
            raise ValueError(f"no end of the record at byte {offset}")
        http, _, payload = block.partition(END.encode())
        yield {"headers": record, "http": http, "payload": payload, "offset": offset}


def url_key(url: str | None) -> str:
    """Host labels in reverse, then path and query, in lower case: neighbours of a site sort together."""
    try:
        parts = urlsplit(url or "")
        host = ",".join(reversed((parts.hostname or "").split(".")))
    except ValueError:
        return (url or "").lower()
    query = f"?{parts.query}" if parts.query else ""
    return f"{host}){parts.path or '/'}{query}".lower()


INDEX = pa.schema(
    [
        ("page_id", pa.int64()), ("url_key", pa.string()), ("captured", pa.string()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ("archive", pa.string()), ("offset", pa.int64()),
    ]
)
_SQL = (
    "page_id bigint, url_key string, captured string, payload_bytes bigint, payload_digest string, "
    "record_type string, refers_to bigint, archive string, offset bigint"
)
ORDER = ("url_key", "captured", "page_id", "archive", "offset")


def _page(value: str | None) -> int | None:
    number = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number and number != "none" else None


def _entry(record: dict, archive: str) -> dict:
    headers, payload = record["headers"], record["payload"]
    digest = headers["warc-payload-digest"].removeprefix("sha256:")
    revisit = headers["warc-type"] == "revisit"
    size = len(payload)
    if revisit:
        size = int(record["http"].rpartition(b": ")[2])
    elif hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"{archive}: the payload at byte {record['offset']} has another digest")
    return {
        "page_id": _page(headers["warc-record-id"]), "url_key": url_key(headers.get("warc-target-uri")),
        "captured": headers["warc-date"], "payload_bytes": size, "payload_digest": digest,
        "record_type": headers["warc-type"], "refers_to": _page(headers.get("warc-refers-to")),
        "archive": archive, "offset": record["offset"],
    }


def _rank(entry: dict) -> tuple:
    page = entry["page_id"]
    return entry["url_key"], entry["captured"], page is not None, page or 0, entry["archive"], entry["offset"]


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The index of all archives: each archive's entries sorted, one archive after another."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content")):
                archive = name.as_py().rpartition("/")[2]
                entries = sorted((_entry(r, archive) for r in parse(content.as_py())), key=_rank)
                yield pa.RecordBatch.from_pylist(entries, INDEX)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("path", "content").mapInArrow(read, _SQL)


class LoserTree:
    """Merges sorted iterators: each inner node holds the loser of its match, the root's winner is next."""

    def __init__(self, players: list[Iterator[tuple]]):
        self.players = players
        self.heads = [next(p, None) for p in players]
        self.losers = [-1] * max(len(players), 1)
        for player in range(len(players)):
            self._play(player)

    def _beats(self, one: int, two: int) -> bool:
        a, b = self.heads[one], self.heads[two]
        return a is not None and (b is None or (a, one) < (b, two))

    def _play(self, player: int) -> None:
        node = (player + len(self.players)) // 2
        while node > 0:
            if self.losers[node] < 0:
                self.losers[node] = player
                return
            if self._beats(self.losers[node], player):
                player, self.losers[node] = self.losers[node], player
            node //= 2
        self.losers[0] = player

    def __iter__(self) -> Iterator[tuple[int, tuple]]:
        while self.players and self.heads[self.losers[0]] is not None:
            winner = self.losers[0]
            yield winner, self.heads[winner]
            self.heads[winner] = next(self.players[winner], None)
            self._play(winner)


def merged(index_runs: DataFrame) -> DataFrame:
    """The index in global order, with ``position`` rising along it (not without gaps)."""
    dealt = cut(index_runs).repartitionByRange(*ORDER).sortWithinPartitions("archive", *ORDER[:3], "offset")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), INDEX)
        archives = table["archive"].to_numpy(zero_copy_only=False)
        change = np.flatnonzero(archives[1:] != archives[:-1]) + 1 if len(table) else []
        bounds = [0, *change, len(table)]

        def run(start: int, stop: int) -> Iterator[tuple]:
            part = table.slice(start, stop - start)
            columns = [part[c].to_pylist() for c in ORDER]
            for i, (key, time, page, archive, offset) in enumerate(zip(*columns), start):
                yield key, time, page is not None, page or 0, archive, offset, i

        players = [run(a, b) for a, b in zip(bounds, bounds[1:])]
        order = np.fromiter(map(itemgetter(-1), (row for _, row in LoserTree(players))), np.int64)
        base = TaskContext.get().partitionId() << 33
        out = table.take(pa.array(order)).append_column("position", pa.array(base + np.arange(len(order))))
        yield from out.to_batches(max_chunksize=10_000)

    return dealt.mapInArrow(merge, _SQL + ", position bigint")


def round_trip(pages: DataFrame, path: str | None = None, time: Column | None = None) -> DataFrame:
    """Writes the pages to archives below ``path`` and returns the merged index that was read back.

    One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to, url_key,
    captured, archive, offset, position. A null html is an empty payload, a null url an empty key;
    a null page_id comes back null.
    """
    spark = pages.sparkSession
    path = path or f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write(pages, path, time)
    return merged(runs(spark, path))
