"""Near-duplicates by SimHash, found by multi-index hashing.

A fingerprint has 64 bits, and two documents are linked when at most three bits differ. Cut into two
segments of 32 bits, two such fingerprints differ in at most one bit of some segment. So each one
is filed in a table per segment under the segment's value, and looked up there under every value of the
Hamming ball of radius one around it. Of two values that differ in one bit exactly one has a 0 there, so
it is enough to look up those with a 0 turned into a 1. What meets under a value is verified on
all 64 bits.

Only distinct fingerprints are filed. Entries are range-partitioned by value and fingerprint and compared
in one pass over each sorted partition, so a value that many share is not gathered in a task. Values that
reach over the edge of a partition, and values with more than ``CROWD`` entries, are filed again under the
value and half of the other segment: in one of the halves at most one bit differs. A value of that second
table leaves 16 bits open, which bounds how many entries can share it.

A task sends no pairs but the links of a spanning forest of what it found, so the links grow with the
fingerprints and not with the square of a group; all linked fingerprints stay connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from gridpulse.llm.components import components
from gridpulse.llm.spread import looked_up
from gridpulse.llm.work import cut

SHINGLE = 3
SEED = 42
RADIUS = 3
BITS = 64
#: Entries of one value that are compared at once; more are filed again under longer values.
CROWD = 2048
#: Shingles hashed, and links held, at a time.
BLOCK = 1 << 16
HELD = 1 << 20

_LOWER = bytes(c + 32 if ord("A") <= c <= ord("Z") else c for c in range(256))


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Bit k is set if it is in over half of the hashes of the text's shingles, repeats included."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    size = min(size, len(words))
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - size + 1
    set_bits = np.zeros(BITS, np.int64)
    for at in range(0, n, BLOCK):
        to = min(at + BLOCK, n)
        spans = zip(starts[at:to].tolist(), ends[at + size - 1 : to + size - 1].tolist())
        hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in spans], "<u8")
        set_bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, bits) of (doc_id, text); the 64 bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), size) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "bits"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, bits bigint")


def ball(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, value): each value, and all that arise from it by turning one of its 0 bits into a 1."""
    flips = np.uint64(1) << np.arange(width, dtype=np.uint64)
    near = values[:, None] | flips
    owner, bit = np.nonzero(near != values[:, None])
    return np.concatenate([np.arange(len(values)), owner]), np.concatenate([values, near[owner, bit]])


def _segment(bits: np.ndarray, at: int, width: int) -> np.ndarray:
    return bits >> np.uint64(at) & np.uint64((1 << width) - 1)


def _filed(key: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(bits.view(np.int64))], names=["key", "bits"])


def by_segment(distinct: DataFrame) -> DataFrame:
    """(key, bits): every fingerprint under the values to look up of each half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = batch.column("bits").to_numpy().view(np.uint64)
            for half in (0, 1):
                owner, value = ball(_segment(bits, 32 * half, 32), 32)
                yield _filed(np.uint64(half) << np.uint64(32) | value, bits[owner])

    return distinct.mapInArrow(run, "key bigint, bits bigint")


def by_quarter(crowded: DataFrame) -> DataFrame:
    """(key, bits): entries of crowded keys under the key and the values of each half of the other segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, bits = (batch.column(c).to_numpy().view(np.uint64) for c in ("key", "bits"))
            other = np.where(key >> np.uint64(32) == 0, bits >> np.uint64(32), bits & np.uint64(0xFFFFFFFF))
            for quarter in (0, 1):
                owner, value = ball(_segment(other, 16 * quarter, 16), 16)
                yield _filed(key[owner] << np.uint64(17) | np.uint64(quarter << 16) | value, bits[owner])

    return crowded.mapInArrow(run, "key bigint, bits bigint")


class Forest:
    """Links between fingerprints, kept as one link from each to the least that it is connected with."""

    def __init__(self) -> None:
        self.a, self.b = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.new: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.new.append((a, b))
        self.waiting += len(a)
        if self.waiting > HELD:
            self.settle()

    def settle(self) -> None:
        a, b = np.concatenate([self.a, *[x for x, _ in self.new]]), np.concatenate([self.b, *[y for _, y in self.new]])
        nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        a, b = place[: len(a)], place[len(a) :]
        least = np.arange(len(nodes))
        while (least[a] != least[b]).any():
            low = np.minimum(least[a], least[b])
            # roots hook on to lower roots, then every node jumps to its root
            np.minimum.at(least, least[a], low)
            np.minimum.at(least, least[b], low)
            while (least[least] != least).any():
                least = least[least]
        rest = np.flatnonzero(least != np.arange(len(nodes)))
        self.a, self.b, self.new, self.waiting = nodes[rest], nodes[least[rest]], [], 0


def _compare(forest: Forest, key: np.ndarray, bits: np.ndarray) -> None:
    """Adds the links among entries of equal keys, which stand side by side."""
    at, reach = np.arange(len(key)), 0
    while len(at):
        reach += 1
        at = at[at + reach < len(key)]
        at = at[key[at] == key[at + reach]]
        near = at[np.bitwise_count(bits[at] ^ bits[at + reach]) <= RADIUS]
        if len(near):
            forest.add(bits[near], bits[near + reach])


_FOUND = ["a", "b", "key", "bits"]


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(a), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), none, none], names=_FOUND)


def _put_off(key: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(key), pa.int64())
    return pa.RecordBatch.from_arrays([none, none, pa.array(key.view(np.int64)), pa.array(bits.view(np.int64))], names=_FOUND)


def compared(filed: DataFrame, whole: bool) -> DataFrame:
    """(a, b, key, bits): links between fingerprints, or an entry that has to be filed again.

    The partitions of ``filed`` are sorted by key. If they are not ``whole``, a key may go on in the next
    one, so the first and the last key of each are filed again, as are those with over ``CROWD`` entries.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, first = Forest(), None
        held_key, held_bits, crowded = np.zeros(0, np.uint64), np.zeros(0, np.uint64), None
        for batch in batches:
            key, bits = (batch.column(c).to_numpy().view(np.uint64) for c in ("key", "bits"))
            if not len(key):
                continue
            first = key[0] if first is None else first
            key, bits = np.concatenate([held_key, key]), np.concatenate([held_bits, bits])
            # entries of the last key wait for more, unless they are put off anyway
            last = int(np.searchsorted(key, key[-1]))
            done_key, done_bits = key[:last], bits[:last]
            held_key, held_bits = key[last:], bits[last:]
            if not whole:
                away = (done_key == first) | (done_key == crowded if crowded is not None else False)
                starts = np.flatnonzero(np.diff(done_key, prepend=~done_key[:1]))
                sizes = np.diff(np.append(starts, len(done_key)))
                away |= np.repeat(sizes > CROWD, sizes)
                if away.any():
                    yield _put_off(done_key[away], done_bits[away])
                    done_key, done_bits = done_key[~away], done_bits[~away]
                if held_key[0] in (first, crowded) or len(held_key) > CROWD:
                    crowded = held_key[0]
                    yield _put_off(held_key, held_bits)
                    held_key, held_bits = held_key[:0], held_bits[:0]
            _compare(forest, done_key, done_bits)
            if len(forest.a) > HELD:
                forest.settle()
                yield _links(forest.a, forest.b)
                forest = Forest()
        if len(held_key) and not whole:
            yield _put_off(held_key, held_bits)
        else:
            _compare(forest, held_key, held_bits)
        forest.settle()
        yield _links(forest.a, forest.b)

    return filed.mapInArrow(run, "a bigint, b bigint, key bigint, bits bigint")


def links(distinct: DataFrame) -> DataFrame:
    """(a, b) of distinct fingerprints (bits): as many links as connect all that differ in ``RADIUS`` bits or fewer."""
    filed = by_segment(distinct).repartitionByRange("key", "bits").sortWithinPartitions("key", "bits")
    found = cut(compared(filed, whole=False))
    crowded = found.filter("key is not null").select("key", "bits")
    again = by_quarter(crowded).repartition("key").sortWithinPartitions("key", "bits")
    rest = compared(again, whole=True)
    return found.filter("a is not null").select("a", "b").unionAll(rest.select("a", "b"))


def near_duplicates(documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hexadecimal digits), component_id.

    ``component_id`` is the least id that links reach, null only where no reached row has an id. Null and
    empty texts and texts without words have the fingerprint zero, and are linked like others. Rows
    that repeat an id are separate rows.
    """
    slim = documents.select(documents[f"`{id}`"].alias("doc_id"), documents[f"`{text}`"].alias("text"))
    rows = cut(fingerprints(slim))
    classes = cut(rows.groupBy("bits").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    roots = components(links(classes.select("bits")))
    joined = cut(classes.join(roots, F.col("bits") == F.col("node")).select("bits", "root", "least"))
    groups = joined.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("copies"))
    linked = looked_up(joined, cut(groups), "root").select(F.col("bits").alias("of"), "component")
    facts = classes.join(linked, F.col("bits") == F.col("of"), "left")
    facts = facts.select("bits", "copies", F.when(F.col("of").isNull(), F.col("least")).otherwise(F.col("component")).alias("component_id"))
    return looked_up(rows, cut(facts), "bits").select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id"
    )
