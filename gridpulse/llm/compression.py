"""Vector codes: each part of a vector becomes the number of the nearest entry of that part's codebook.

The nearest entry is found by slice and intersect. In each dimension of a part the entries' coordinates are
sorted, and a mask of 64 bits is kept for every prefix of that order. The entries within a radius of a
component are a slice of the order, so their mask is one prefix mask without another; the masks of the
dimensions are ANDed, which leaves the entries in a cube around the part. The first radius is the typical
distance between neighbouring entries. If its cube holds entries, the least of their distances bounds the
nearest one: either it lies within the radius, or a cube of that size is cut once more. An empty cube
doubles the radius. All entries of the last cube are compared, so the result is exact, ties included.

Codebooks are learned in rounds. A task adds up its own vectors per entry, so a round sends the sums of
each task, whose size the codebook bounds, and the driver gets one sum per entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpulse.llm.spread import looked_up
from gridpulse.llm.work import cut

PARTS = 16
#: One bit of a mask per entry.
ENTRIES = 64
ROUNDS = 2
SCALE = 256
BLOCK = 4096


def widest(dimensions: int) -> int:
    """The greatest size of a component such that no squared distance of two vectors exceeds a long."""
    return isqrt((1 << 62) // max(dimensions, 1)) // 2


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector is not null and holds neither nulls nor components that are not finite."""
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.filter(F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False)))


def quantised(column: pa.Array, dimensions: int) -> np.ndarray:
    """Vectors as rows of integers floor(256 * x); what a vector lacks counts as 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes == dimensions).all():
        full = values.reshape(len(column), dimensions)
    else:
        full = np.zeros((len(column), dimensions))
        full[np.arange(dimensions) < sizes[:, None]] = values
    most = widest(dimensions)
    return np.clip(np.floor(full * SCALE), -most, most).astype(np.int64)


@dataclass(frozen=True)
class Sliced:
    """The codebook of one part, with its coordinates in order and the masks of their prefixes."""

    entries: np.ndarray  # (entries, width)
    order: np.ndarray  # (width, entries): coordinates in ascending order
    masks: np.ndarray  # (width, entries + 1): bits of the entries before each place
    radius: int

    @staticmethod
    def of(entries: np.ndarray) -> Sliced:
        n = len(entries)
        by = np.argsort(entries, axis=0, kind="stable").T
        masks = np.zeros((entries.shape[1], n + 1), np.uint64)
        np.bitwise_or.accumulate(np.uint64(1) << by.astype(np.uint64), axis=1, out=masks[:, 1:])
        apart = ((entries[:, None] - entries[None]) ** 2).sum(axis=2)
        apart = np.where(apart == 0, np.iinfo(np.int64).max, apart).min(axis=1)
        apart = apart[apart < np.iinfo(np.int64).max]
        return Sliced(entries, np.sort(entries, axis=0).T, masks, isqrt(int(np.median(apart))) + 1 if len(apart) else 1)

    def cube(self, points: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Mask of the entries within ``radius`` of each point in every dimension."""
        inside = np.full(len(points), ~np.uint64(0))
        for order, masks, x in zip(self.order, self.masks, points.T):
            low, high = np.searchsorted(order, x - radius, "left"), np.searchsorted(order, x + radius, "right")
            inside &= masks[high] & ~masks[low]
        return inside

    def least(self, points: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of the nearest entry of each mask, the lower number on ties; a mask has a bit."""
        bits = np.unpackbits(inside.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, entry = np.nonzero(bits)
        distance = ((points[row] - self.entries[entry]) ** 2).sum(axis=1)
        starts = np.searchsorted(row, np.arange(len(points)))
        best = np.minimum.reduceat(distance, starts)
        # rows come with ascending entries: the first that is as near wins
        hit = np.flatnonzero(distance == best[row])
        return entry[hit[np.searchsorted(row[hit], np.arange(len(points)))]], best

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(points)
        entry, distance = np.zeros(n, np.int64), np.zeros(n, np.int64)
        at, radius, final = np.arange(n), np.full(n, self.radius, np.int64), np.zeros(n, bool)
        while len(at):
            inside = self.cube(points[at], radius)
            some = inside != 0
            radius[~some] *= 2
            found, best = self.least(points[at[some]], inside[some])
            # nothing outside a cube is nearer than its radius
            sure = final[some] | (best <= radius[some] ** 2)
            done = at[some][sure]
            entry[done], distance[done] = found[sure], best[sure]
            bound = np.floor(np.sqrt(best)).astype(np.int64) + 1
            radius[some], final[some] = bound, True
            rest = np.ones(len(at), bool)
            rest[np.flatnonzero(some)[sure]] = False
            at, radius, final = at[rest], radius[rest], final[rest]
        return entry, distance


def _sliced(books: np.ndarray) -> list[Sliced]:
    return [Sliced.of(book) for book in books if len(book)]


def _codes(parts: list[Sliced], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry of every part, squared distances summed over the parts) of each vector."""
    width = vectors.shape[1] // len(parts)
    found = [p.nearest(vectors[:, i * width : (i + 1) * width]) for i, p in enumerate(parts)]
    return np.stack([e for e, _ in found], axis=1), sum(d for _, d in found)


def _blocks(column: pa.Array, dimensions: int) -> Iterator[tuple[int, np.ndarray]]:
    for at in range(0, len(column), BLOCK):
        yield at, quantised(column.slice(at, BLOCK), dimensions)


def improved(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: entries at the floored means of their parts; unused ones stay."""
    n_parts, n, width = books.shape
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _sliced(shared.value)
        sums, counts = np.zeros((n_parts * n, width), np.int64), np.zeros(n_parts * n, np.int64)
        for batch in batches:
            for _, block in _blocks(batch.column("vector"), n_parts * width):
                codes, _ = _codes(parts, block)
                place = (codes + np.arange(n_parts) * n).ravel()
                counts += np.bincount(place, minlength=len(counts))
                np.add.at(sums, place, block.reshape(-1, width))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(counts[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))], names=["place", "n", "sums"]
        )

    partial = vectors.select("vector").mapInArrow(add, "place bigint, n bigint, sums array<bigint>")
    places = partial.select("place", "n", F.posexplode("sums").alias("at", "x"))
    out = books.reshape(-1, width).copy()
    for r in places.groupBy("place", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).toLocalIterator():
        out[r.place, r.at] = r.x // r.n
    return out.reshape(books.shape)


def first_books(vectors: DataFrame, dimensions: int, entries: int = ENTRIES, parts: int = PARTS) -> np.ndarray:
    """The parts of the vectors with the smallest ids (null last, ties by the vector), by part and entry."""
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").toArrow()["vector"]
    return quantised(rows, dimensions).reshape(len(rows), parts, dimensions // parts).transpose(1, 0, 2).copy()


def compressed(
    embeddings: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS
) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error) of every usable row, codebooks as an array by part, entry and position).

    Rows whose vector is null, or holds a null or a component that is not finite, are left out. Vectors
    may differ in length: all count as long as the longest, rounded up to whole parts, and end in zeros;
    an empty one is all zeros. Fewer rows than entries make smaller codebooks. Components beyond
    ``widest`` (134,217,727 for 64 dimensions) count as that, so that distances fit a long.
    """
    slim = embeddings.select(
        embeddings[f"`{id}`"].alias("vec_id"), embeddings[f"`{label}`"].alias("label"), embeddings[f"`{vector}`"].alias("vector")
    )
    vectors = usable(slim, "vector")
    longest = vectors.agg(F.max(F.size("vector"))).first()[0]
    dimensions = max(-(-(longest or 0) // PARTS), 1) * PARTS
    books = first_books(vectors, dimensions)
    for _ in range(rounds if longest is not None else 0):
        books = improved(vectors, books)
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _sliced(shared.value)
        for batch in batches:
            for at, block in _blocks(batch.column("vector"), dimensions):
                codes, error = _codes(parts, block)
                texts = [row.tobytes().hex() for row in codes.astype(np.uint8)]
                part = batch.slice(at, len(block))
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), part.column("label"), pa.array(texts, pa.string()), pa.array(error)],
                    names=["vec_id", "label", "code", "error"],
                )

    fields = [vectors.schema["vec_id"], vectors.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]
    return vectors.mapInArrow(assign, T.StructType(fields)), books


def book_digest(books: np.ndarray) -> str:
    """SHA-256 of the entries' components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(embeddings: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per usable row: vec_id, code, error, label_error, codebooks_sha256.

    ``label_error`` is the error of all rows with the same label, null being one of them, and null where
    it exceeds a long. A label may be that of most rows: sums are formed before the shuffle.
    """
    codes, books = compressed(embeddings, id, vector, label)
    codes = cut(codes)
    sums = codes.groupBy("label").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("copies"))
    return looked_up(codes, cut(sums), "label").select(
        "vec_id", "code", "error", "label_error", F.lit(book_digest(books)).alias("codebooks_sha256")
    )
