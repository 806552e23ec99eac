"""Benchmark decontamination: windows of benchmark words, looked for in every document.

The windows of a bounded block of benchmark items travel to the tasks as a broadcast. A document's
windows are hashed in one pass over its words; a hash that the block knows is verified on the words
themselves. A benchmark larger than a block is worked through in several passes over the documents,
each adding its hits, so no broadcast grows with the benchmark.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpulse.llm import tokens
from gridpulse.llm.work import packed

WINDOW = 13
#: Bytes of benchmark text in one broadcast.
BLOCK_BYTES = 32 << 20
FILTER_BITS = 20
ONE_IN = 20


class Windows:
    """The windows of some benchmark items: exact words, and their hashes by length."""

    def __init__(self, items: list[tuple[str | None, str]], size: int = WINDOW):
        self.items: dict[bytes, set[str | None]] = defaultdict(set)
        hashes: dict[int, list[np.ndarray]] = defaultdict(list)
        for found in tokens.words(pa.array([text for _, text in items], pa.string()), tokens.LETTERS):
            for i in range(found.n):
                low, high = int(found.bounds[i]), int(found.bounds[i + 1])
                length = min(size, high - low)
                if not length:
                    continue
                hashes[length].append(tokens.windows(found.hashes[low:high], length))
                for at in range(low, high - length + 1):
                    self.items[tokens.folded(found, tokens.LETTERS, at, at + length)].add(items[found.first + i][0])
        self.hashes = {n: np.unique(np.concatenate(parts)) for n, parts in hashes.items()}
        self.filters = {}
        for n, known in self.hashes.items():
            self.filters[n] = np.zeros(1 << FILTER_BITS, bool)
            self.filters[n][known >> np.uint64(64 - FILTER_BITS)] = True

    def hits(self, found: tokens.Words) -> Iterator[tuple[int, int, set[str | None]]]:
        """(first word, length, items) of every verified window that lies within one text."""
        bounds = found.bounds
        for n, known in self.hashes.items():
            hashes = tokens.windows(found.hashes, n)
            at = np.flatnonzero(self.filters[n][hashes >> np.uint64(64 - FILTER_BITS)])
            place = np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)
            at = at[known[place] == hashes[at]]
            text = np.searchsorted(bounds, at, side="right")
            for i in at[at + n <= bounds[text]].tolist():
                items = self.items.get(tokens.folded(found, tokens.LETTERS, i, i + n))
                if items:
                    yield i, n, items


def _spans(hit: np.ndarray) -> list[dict[str, int]]:
    """Runs of True as inclusive positions."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"first": int(a), "last": int(b) - 1} for a, b in zip(edges[::2], edges[1::2])]


_SPAN = pa.struct([("first", pa.int64()), ("last", pa.int64())])


def _scan(windows: Windows, batch: pa.RecordBatch) -> pa.RecordBatch:
    known = batch.schema.names
    n_words, spans, names = [], [], []
    old_spans = batch.column(known.index("spans")) if "spans" in known else None
    old_names = batch.column(known.index("names")) if "names" in known else None
    for found in tokens.words(batch.column(known.index("text")), tokens.LETTERS):
        hit = np.zeros(len(found.starts), bool)
        items: dict[int, set[str | None]] = defaultdict(set)
        for at, n, named in windows.hits(found):
            hit[at : at + n] = True
            items[int(np.searchsorted(found.bounds, at, side="right")) - 1] |= named
        for i in range(found.n):
            low, high = int(found.bounds[i]), int(found.bounds[i + 1])
            n_words.append(high - low)
            own, at = hit[low:high], found.first + i
            if old_spans is not None:
                for span in old_spans[at].as_py():
                    own[span["first"] : span["last"] + 1] = True
                items[i] |= set(old_names[at].as_py())
            spans.append(_spans(own) if own.any() else [])
            names.append(sorted(items[i], key=lambda x: (x is None, x or "")) if i in items else [])
    kept = {n: batch.column(i) for i, n in enumerate(known)}
    kept["n_words"] = pa.array(n_words, pa.int64())
    kept["spans"] = pa.array(spans, pa.list_(_SPAN))
    kept["names"] = pa.array(names, pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays(list(kept.values()), names=list(kept))


def scan(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds n_words, spans (hit words, from 0) and names (ids of items found) to a frame with ``text``.

    Benchmark rows without words have no windows. Those without id have; all of them are one item, named
    null, which counts in n_items and leaves no trace in items_sha256.
    """
    spark = documents.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").dropna(subset=["text"])
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rounds = -(-total // block_bytes) or 1
    span = T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())])
    added = {"n_words": T.LongType(), "spans": T.ArrayType(span), "names": T.ArrayType(T.StringType())}
    schema = T.StructType([*documents.schema.fields, *[T.StructField(n, kind) for n, kind in added.items()]])
    out = documents
    for k in range(rounds):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds)) == k)
        shared = spark.sparkContext.broadcast(Windows([tuple(r) for r in part.collect()], size))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _scan(shared.value, batch)

        out = out.mapInArrow(run, schema)
    return out


def _n_hit(spans: str = "spans"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, s: total + s["last"] - s["first"] + 1)


def _contaminated(one_in: int):
    return (F.col("n_hit") > 0) & (F.lit(one_in) * F.col("n_hit") >= F.col("n_words"))


def contamination(
    documents: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", size: int = WINDOW,
    one_in: int = ONE_IN, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    A document is contaminated if at least one in ``one_in`` of its words lies in a benchmark
    window. A null text has no words. Repeated rows and null ids each keep their own row.
    """
    slim = documents.select(documents[f"`{id}`"].alias("doc_id"), documents[f"`{text}`"].alias("text"))
    return (
        scan(slim, benchmark, size, block_bytes)
        .withColumn("n_hit", _n_hit())
        .select(
            "doc_id",
            "n_words",
            "n_hit",
            F.size("names").cast("long").alias("n_items"),
            F.sha2(F.array_join(F.array_sort("names"), ","), 256).alias("items_sha256"),
            _contaminated(one_in).alias("contaminated"),
            "spans",
        )
    )


def clean(documents: DataFrame, benchmark: DataFrame, text: str = "text", size: int = WINDOW, one_in: int = ONE_IN) -> DataFrame:
    """The rows that are not contaminated, with all their columns."""
    marked = scan(packed(documents, text=text), benchmark, size).withColumn("n_hit", _n_hit())
    return marked.filter(~_contaminated(one_in)).select("row.*")


def without_spans(documents: DataFrame, benchmark: DataFrame, text: str = "text", size: int = WINDOW) -> DataFrame:
    """All rows; benchmark windows are cut out of the text, the rest stays byte by byte."""
    marked = scan(packed(documents, text=text), benchmark, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            spans = batch.column("spans")
            for found in tokens.words(batch.column("text"), tokens.LETTERS):
                for i in range(found.n):
                    cuts = spans[found.first + i].as_py()
                    if not cuts:
                        continue
                    low, begin, rest, at = int(found.bounds[i]), int(found.offsets[i]), b"", int(found.offsets[i])
                    for span in cuts:
                        rest += found.data[at : found.starts[low + span["first"]]].tobytes()
                        at = int(found.ends[low + span["last"]])
                    rest += found.data[at : found.offsets[i + 1]].tobytes()
                    texts[found.first + i] = rest.decode()
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "cut"])

    shape = T.StructType([marked.schema["row"], T.StructField("cut", T.StringType())])
    columns = [F.col("cut").alias(n) if n == text else F.col(f"row.`{n}`").alias(n) for n in documents.columns]
    return marked.select("row", "text", "spans").mapInArrow(run, shape).select(*columns)
