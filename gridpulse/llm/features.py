"""Indicator features of texts, hashed to a fixed number of columns, and labelled samples of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpulse.llm import tokens

BITS = 18
SIZE = 1 << BITS

_marks = np.zeros(256, bool)
_marks[33:127] = True
_marks[48:58] = _marks[65:91] = _marks[97:123] = False
#: Runs of ASCII punctuation.
MARKS = tokens._alphabet(_marks)

Features = Callable[[pa.Array], Iterator[tuple[int, int, np.ndarray, np.ndarray]]]


def _column(hashes: np.ndarray, kind: int) -> np.ndarray:
    return (tokens.mix(hashes + np.uint64(kind)) >> np.uint64(64 - BITS)).astype(np.int64)


def _distinct(first: int, n: int, owners: list[np.ndarray], columns: list[np.ndarray]):
    """(first text, texts, text of each feature, column of each feature), each feature once a text."""
    pairs = np.unique((np.concatenate(owners) << BITS) | np.concatenate(columns))
    return first, n, pairs >> BITS, pairs & (SIZE - 1)


def ngrams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Words, pairs of words, runs of punctuation, and whether a word stands three times in a row."""
    for first, data, offsets in tokens.blocks(column):
        found = tokens.split(first, data, offsets, tokens.LETTERS)
        owner = found.owner()
        marks = tokens.split(first, data, offsets, MARKS)
        owners, columns = [owner, marks.owner()], [_column(found.hashes, 1), _column(marks.hashes, 2)]
        if len(owner) > 1:
            inside = owner[1:] == owner[:-1]
            owners.append(owner[1:][inside])
            columns.append(_column(tokens.windows(found.hashes, 2), 3)[inside])
        if len(owner) > 2:
            same = (found.hashes[2:] == found.hashes[1:-1]) & (found.hashes[1:-1] == found.hashes[:-2])
            same &= owner[2:] == owner[:-2]
            owners.append(owner[2:][same])
            columns.append(_column(np.zeros(int(same.sum()), np.uint64), 4))
        yield _distinct(first, found.n, owners, columns)


def stems(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Words, and their first three to six bytes."""
    for first, data, offsets in tokens.blocks(column):
        found = tokens.split(first, data, offsets, tokens.LETTERS)
        owner, width = found.owner(), found.ends - found.starts
        owners, columns = [owner], [_column(found.hashes, 1)]
        for n in range(3, 7):
            long = width > n
            starts = found.starts[long]
            head = np.zeros(len(starts), np.uint64)
            for k in range(n):
                head = tokens.mix(head + tokens.LETTERS.value[data[starts + k]])
            owners.append(owner[long])
            columns.append(_column(head, 4 + n))
        yield _distinct(first, found.n, owners, columns)


def held_out(id: Column, parts: int, part: int) -> Column:
    """Whether a document is set aside; one without id is not."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % parts == part, F.lit(False))


def sample(labels: DataFrame, label: str, parts: int, part: int, rows: int, seed: int) -> DataFrame:
    """(doc_id, label) of at most ``rows`` labelled documents that are not set aside, seeded.

    A document with contradicting labels counts as labelled by the smaller one.
    """
    known = labels.select(F.col("doc_id").alias("of"), F.col(label).cast("int").alias("label")).dropna()
    known = known.filter(~held_out(F.col("of"), parts, part)).groupBy("of").agg(F.min("label").alias("label"))
    return known.orderBy(F.xxhash64(F.lit(seed), "of"), "of").limit(rows)


def collected(documents: DataFrame, known: DataFrame, features: Features, other: Callable[[bytes], bytes] | None = None):
    """Labels and features of a bounded labelled sample: (labels, bounds, columns, twins).

    ``other`` rewrites a text; ``twins`` lists (row, columns) of the texts that it changes. The ids of
    the sample are at most as many as its bound, so they may be broadcast.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [list(_rows(features, batch.column("text")))]
            if other is not None:
                texts = [t.as_py() or "" for t in batch.column("text")]
                changed = [other(t.encode()).decode() for t in texts]
                twins = list(_rows(features, pa.array(changed, pa.string())))
                out.append([b if t != c else None for t, c, b in zip(texts, changed, twins)])
            else:
                out.append([None] * len(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column("of"), batch.column("label"), *[pa.array(x, pa.binary()) for x in out]],
                names=["of", "label", "own", "twin"],
            )

    kind = known.schema["of"].dataType.simpleString()
    rows = (
        documents.join(F.broadcast(known), F.col("doc_id") == F.col("of"))
        .select("of", "label", "text")
        .mapInArrow(run, f"of {kind}, label int, own binary, twin binary")
        .toArrow()
        .sort_by([("of", "ascending"), ("own", "ascending")])
    )
    own = [np.frombuffer(x.as_py(), np.int32) for x in rows["own"]]
    twins = [(i, np.frombuffer(x.as_py(), np.int32)) for i, x in enumerate(rows["twin"]) if x.is_valid]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
    columns = np.concatenate([np.zeros(0, np.int32), *own]).astype(np.int64)
    return rows["label"].to_numpy().astype(np.int64), bounds, columns, twins


def _rows(features: Features, column: pa.Array) -> Iterator[bytes]:
    for _, n, owner, columns in features(column):
        at = np.searchsorted(owner, np.arange(n + 1))
        for i in range(n):
            yield columns[at[i] : at[i + 1]].astype(np.int32).tobytes()


def scored(documents: DataFrame, features: Features, weights: np.ndarray, squares: np.ndarray | None, bias: float, slope: float, shift: float) -> DataFrame:
    """(doc_id, score): a sigmoid of the linear margin, divided by the length of the scaled features
    where ``squares`` gives their squares. The model's size is fixed by the number of columns."""
    shared = documents.sparkSession.sparkContext.broadcast((weights, squares))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, squares = shared.value
        for batch in batches:
            scores = []
            for _, n, owner, columns in features(batch.column("text")):
                margin = np.bincount(owner, weights[columns], n) + bias
                if squares is not None:
                    margin /= np.sqrt(np.bincount(owner, squares[columns], n) + 1.0)
                scores.append(1.0 / (1.0 + np.exp(-np.clip(slope * margin + shift, -500, 500))))
            column = pa.array(np.concatenate(scores) if scores else np.zeros(0))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column], names=["doc_id", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.mapInArrow(run, f"doc_id {kind}, score double")
