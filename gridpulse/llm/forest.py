"""Near-duplicates by an LSH forest over minhash signatures, confirmed on full shingle sets.

A document's set is its distinct two-word shingles. Documents with equal sets form a class. The
classes are laid out in several orders, each sorting the signatures from another slot on. In an
order the neighbours with the longest common prefix stand side by side, so a region is searched as
deep as its density asks: in a thin region a shared first slot makes two classes neighbours, in a
crowded one only a long shared prefix does. Each order is range-partitioned on the whole key, so
no region has to fit one task; rows at the partition edges are compared in a second, small pass.

Neighbours whose signatures agree on enough slots are candidates, and candidates are confirmed on
the texts. The threshold on slots lies five standard deviations below what a pair at the very edge
of the wanted similarity shows. Pairs that share many slots and yet cannot be links go without a look
at their texts: every class carries the parities of its set by bin, and the bins in which two classes
differ are at most as many as the shingles that only one of them has. In a group of many copies almost all neighbours are candidates, and most of them
say nothing new. So a first round takes the few nearest of each class; the classes that had more are
searched again with a larger number, now only for candidates outside their component, until none is
left over. Candidates thus grow with the classes, not with the square of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.llm import tokens
from gridpulse.llm.components import components
from gridpulse.llm.exact import BITMAP_ROWS
from gridpulse.llm.work import cut

SHINGLE = 2
PERCENT = 80
ORDERS = 24
STRIDE = 4
SLOTS = ORDERS * STRIDE
#: Slots of 16 bits that an order sorts by.
DEPTH = 8
REACH = 64
#: Of pairs at exactly 80 percent, fewer than one in a million shows fewer equal slots.
AGREE = 56
#: Bins of the parities, eight a byte.
BINS = 512
#: Candidates that each class takes in an order, by round; in the last round none is left over.
ROUNDS = (4, REACH)

_random = np.random.default_rng(20)
_FLIP = _random.integers(0, 1 << 63, SLOTS, dtype=np.uint64)
_FACTOR = _random.integers(0, 1 << 63, SLOTS, dtype=np.uint64) | np.uint64(1)


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The set of each text, in order, as sorted distinct hashes."""
    for found in tokens.words(column, tokens.VISIBLE, tokens.SMALL_BYTES):
        pairs = tokens.windows(found.hashes, size)
        for i in range(found.n):
            low, high = int(found.bounds[i]), int(found.bounds[i + 1])
            if high - low >= size:
                yield np.unique(pairs[low : high - size + 1])
            else:
                yield tokens.windows(found.hashes[low:high], high - low)[:1] if high > low else found.hashes[:0]


def signature(members: np.ndarray) -> np.ndarray:
    """The least 16-bit slots of a set under each of the hash functions."""
    least = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(members), 1024):
        part = (members[at : at + 1024, None] ^ _FLIP) * _FACTOR
        np.minimum(least, part.min(axis=0), out=least)
    return (tokens.mix(least) >> np.uint64(48)).astype(">u2")


def parities(members: np.ndarray) -> np.ndarray:
    """A bit per bin, set where an odd number of members falls into it."""
    bins = tokens.mix(members) >> np.uint64(64 - BINS.bit_length() + 1)
    return np.packbits(np.bincount(bins.astype(np.int64), minlength=BINS) & 1)


def digest(members: np.ndarray) -> bytes:
    """128 bits that identify a set."""
    low, high = tokens.mix(members).sum(dtype=np.uint64), tokens.mix(members ^ _FLIP[0]).sum(dtype=np.uint64)
    return np.array([low, high], ">u8").tobytes()


def sketches(documents: DataFrame, size: int = SHINGLE, with_text: bool = False) -> DataFrame:
    """(doc_id, n_shingles, node, and signature or text); node is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, nodes, extra = [], [], []
            for members in shingle_sets(batch.column("text"), size):
                n.append(len(members))
                nodes.append(digest(members) if len(members) else None)
                if not with_text:
                    extra.append(signature(members).tobytes() + parities(members).tobytes() if len(members) else None)
            last = batch.column("text") if with_text else pa.array(extra, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(nodes, pa.binary()), last],
                names=["doc_id", "n_shingles", "node", "text" if with_text else "slots"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    last = "text string" if with_text else "slots binary"
    return documents.mapInArrow(run, f"doc_id {kind}, n_shingles bigint, node binary, {last}")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    data, offsets = tokens.layout(column.cast(pa.large_binary()))
    return data[offsets[0] : offsets[-1]].reshape(-1, width)


def orders(classes: DataFrame) -> DataFrame:
    """Every class once per order: (place, path, marks, n, root, node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketch = _matrix(batch.column("slots"), 2 * SLOTS + BINS // 8)
            slots = sketch[:, : 2 * SLOTS].reshape(-1, SLOTS, 2)
            marks = np.concatenate([slots[:, :, 1], sketch[:, 2 * SLOTS :]], axis=1)
            marks = pa.array([row.tobytes() for row in marks], pa.binary())
            for k in range(ORDERS):
                path = slots[:, (np.arange(DEPTH) + k * STRIDE) % SLOTS].reshape(len(slots), 2 * DEPTH)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(slots), k, np.int32)),
                        pa.array([row.tobytes() for row in path], pa.binary()),
                        marks,
                        batch.column("n_shingles"),
                        batch.column("root"),
                        batch.column("node"),
                    ],
                    names=["place", "path", "marks", "n", "root", "node"],
                )

    return classes.select("node", "slots", "n_shingles", "root").mapInArrow(run, f"{_LAID}, node binary")


_LAID = "place int, path binary, marks binary, n bigint, root bigint"


def _pairs(table: pa.Table, fresh: int, percent: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates among neighbours of a sorted run: (first, second, whether left over), the second at
    ``fresh`` or later. Of each second the nearest ``most`` are taken. Rows with a ``part`` are only
    compared with those of other parts."""
    place, root, n = (table[c].to_numpy() for c in ("place", "root", "n"))
    path = _matrix(table["path"].combine_chunks(), 2 * DEPTH)
    marks = _matrix(table["marks"].combine_chunks(), SLOTS + BINS // 8)
    odd = np.ascontiguousarray(marks[:, SLOTS:]).view(np.uint64)
    marks = marks[:, :SLOTS]
    part = table["part"].to_numpy() if "part" in table.column_names else None
    taken = np.zeros(len(n), np.int64)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))]
    for reach in range(1, min(REACH, len(n) - 1) + 1):
        second = np.arange(max(reach, fresh), len(n))
        first = second - reach
        near = (place[first] == place[second]) & (path[first, :2] == path[second, :2]).all(axis=1)
        near &= (root[first] != root[second]) & (100 * np.minimum(n[first], n[second]) >= percent * np.maximum(n[first], n[second]))
        if part is not None:
            near &= part[first] != part[second]
        first, second = first[near], second[near]
        # a link has at most so many shingles on one side only
        apart = np.bitwise_count(odd[first] ^ odd[second]).sum(axis=1, dtype=np.int64)
        near = (100 + percent) * apart <= (100 - percent) * (n[first] + n[second])
        first, second = first[near], second[near]
        near = (marks[first] == marks[second]).sum(axis=1) >= AGREE
        first, second = first[near], second[near]
        out.append((first, second, taken[second] >= most))
        taken[second] += 1
    return tuple(np.concatenate(x) for x in zip(*out))


def _found(table: pa.Table, fresh: int, percent: int, most: int) -> pa.RecordBatch:
    """Candidates as (a, b), and classes with candidates left over as (a, null), each once."""
    first, second, over = _pairs(table, fresh, percent, most)
    nodes = table["node"].combine_chunks()
    rest = np.unique(np.concatenate([first[over], second[over]]))
    a = pa.concat_arrays([nodes.take(pa.array(first[~over])), nodes.take(pa.array(rest))])
    b = pa.concat_arrays([nodes.take(pa.array(second[~over])), pa.nulls(len(rest), nodes.type)])
    return pa.RecordBatch.from_arrays([a, b], names=["a", "b"])


_EDGE = pa.schema(
    [("place", pa.int32()), ("path", pa.binary()), ("marks", pa.binary()), ("n", pa.int64()), ("root", pa.int64()), ("part", pa.int32())]
)


def _report(found: pa.RecordBatch | None, edges: pa.Table | None) -> Iterator[pa.RecordBatch]:
    names = ["a", "b", *_EDGE.names]
    if found is not None and len(found):
        yield pa.RecordBatch.from_arrays([found["a"], found["b"], *[pa.nulls(len(found), t) for t in _EDGE.types]], names=names)
    if edges is not None and len(edges):
        edges = edges.combine_chunks().to_batches()[0]
        part = pa.array(np.full(len(edges), TaskContext.get().partitionId(), np.int32))
        columns = [edges["node"], pa.nulls(len(edges), pa.binary()), *[edges[c] for c in _EDGE.names[:-1]], part]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def candidates(classes: DataFrame, percent: int, most: int) -> DataFrame:
    """(a, b) of classes that are neighbours in some order, look alike and differ in root; (a, null)
    of classes that have more such neighbours than were taken."""
    laid = orders(classes).repartitionByRange("place", "path", "node").sortWithinPartitions("place", "path", "node")

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = None, 0
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch])
            yield from _report(None, table.slice(0, max(0, REACH - seen)))
            seen += len(table)
            fresh = 0 if held is None else len(held)
            table = table if held is None else pa.concat_tables([held, table])
            yield from _report(_found(table, fresh, percent, most), None)
            held = table.slice(max(0, len(table) - REACH))
        if held is not None:
            # in a short partition the head has rows of the tail
            yield from _report(None, held.slice(min(len(held), max(0, REACH - seen + len(held)))))

    def across(table: pa.Table) -> pa.Table:
        table = table.rename_columns({"a": "node"}).sort_by([("path", "ascending"), ("node", "ascending")])
        return pa.Table.from_batches([_found(table, 0, percent, most)])

    found = cut(laid.mapInArrow(along, f"a binary, b binary, {_LAID}, part int"))
    edges = found.filter("place is not null").drop("b").groupBy("place").applyInArrow(across, "a binary, b binary")
    pairs = found.filter("place is null").select("a", "b").unionAll(edges).filter("b is null or a <> b")
    least = F.when(F.col("b").isNull(), F.col("a")).otherwise(F.least("a", "b"))
    return pairs.select(least.alias("a"), F.when(F.col("b").isNotNull(), F.greatest("a", "b")).alias("b")).distinct()


def confirmed(pairs: DataFrame, documents: DataFrame, classes: DataFrame, percent: int, size: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    wanted = pairs.select("a").unionAll(pairs.select("b")).distinct().withColumnRenamed("a", "node")
    wanted = wanted.join(classes.select("node", "least"), "node")
    # only texts of candidates are shuffled: their hashes go back to the scan as a bitmap of fixed size
    place, bit = F.expr(f"(xxhash64(node) >> 6) & {BITMAP_ROWS - 1}"), F.expr("shiftleft(1L, cast(xxhash64(node) & 63 as int))")
    marks = wanted.groupBy(place.alias("place")).agg(F.bit_or(bit).alias("bits"))
    texts = sketches(documents, size, with_text=True).filter("node is not null")
    texts = texts.join(F.broadcast(marks), place == F.col("place")).filter(bit.bitwiseAND(F.col("bits")) != 0)
    texts = texts.join(wanted, "node").filter(F.col("doc_id").eqNullSafe(F.col("least"))).select("node", "text")
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("one")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("text").alias("two")), "b"
    )

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = zip(shingle_sets(batch.column("one"), size), shingle_sets(batch.column("two"), size))
            keep = []
            for one, two in sets:
                shared = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * shared >= percent * (len(one) + len(two) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "one", "two").mapInArrow(confirm, "a binary, b binary")


def rooted(documents: DataFrame, classes: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """(node, root) of the classes that some link joins."""
    open_classes, roots = classes.withColumn("root", F.xxhash64("node")), None
    for most in ROUNDS:
        found = cut(candidates(open_classes, percent, most))
        links = cut(confirmed(found.filter("b is not null"), documents, classes, percent, size))
        # what earlier rounds linked hangs on their roots, with a link per class
        known = [] if roots is None else [roots.select(F.col("node").alias("a"), F.col("root").alias("b"))]
        roots = cut(components(reduce(DataFrame.unionAll, known, links)))
        rest = found.filter("b is null").select(F.col("a").alias("node"))
        if rest.isEmpty():
            break
        label = F.xxhash64(F.coalesce(F.col("to"), F.col("node")))
        names = roots.select(F.col("node").alias("of"), F.col("root").alias("to"))
        open_classes = classes.join(rest, "node", "left_semi").join(names, F.col("node") == F.col("of"), "left").withColumn("root", label)
    return roots


def near_duplicates(
    documents: DataFrame, id: str = "doc_id", text: str = "text", percent: int = PERCENT, size: int = SHINGLE
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Links join documents whose sets have at least ``percent`` percent of their union in common;
    ``component_id`` is the least id that links reach, null only where no reached row has an id. A
    text without words (or null) has an empty set and stays alone. Rows that repeat an id with
    another text are told apart by their sets.
    """
    slim = documents.select(documents[f"`{id}`"].alias("doc_id"), documents[f"`{text}`"].alias("text"))
    rows = cut(sketches(slim, size))
    classes = cut(
        rows.filter("node is not null")
        .groupBy("node")
        .agg(F.min("doc_id").alias("least"), F.first("slots").alias("slots"), F.first("n_shingles").alias("n_shingles"))
    )
    roots = rooted(slim, classes, percent, size)
    named = classes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = named.join(least, "root").select("node", "component_id")
    return rows.join(by_class, "node", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(F.col("node").isNull(), True).otherwise(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"),
    )


def one_of_each(documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows whose document stays, with all their columns; rows that share an id go together."""
    kept = near_duplicates(documents, id, text).filter("kept").select(F.col("doc_id").alias("__kept")).distinct()
    return documents.join(kept, documents[f"`{id}`"].eqNullSafe(F.col("__kept")), "left_semi")
