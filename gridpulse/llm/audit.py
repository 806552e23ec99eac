"""Filter interaction audit: what each quality filter removes, alone and after the others.

The texts go through a table-driven transducer over their UTF-8 bytes. Two tables say, for a state and
a byte's class, what the next state is and what is put out: a code point, a capital, a symbol, the
opening or the closing of a word. The spans of the words enter a hash table per text, whose hits are
verified on the words' bytes, so the distinct words are counted in the same pass. After any byte the
state depends on the class of that byte alone; so all bytes of a block are taken through the tables
at once.

A text then fails some of the filters, which is a set of bits. Texts are counted by part and set, with
partial counts before the shuffle; the figures of every order of the filters follow from at most
``2 ** filters`` counts a part. Only the filter for repeated texts looks beyond the text: digests are
grouped to the least id that has them.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpulse.llm import tokens
from gridpulse.llm.spread import looked_up
from gridpulse.llm.work import cut

# classes of bytes
BLANK, PLAIN, CAPITAL, SYMBOL, INNER = range(5)
# states
GAP, WORD = range(2)
# what a step puts out; a step may put out several
OPEN, CLOSE, POINT, IS_CAPITAL, IS_SYMBOL = 1, 2, 4, 8, 16

CLASS = np.full(256, PLAIN, np.uint8)
CLASS[[0x20, *range(0x09, 0x0E)]] = BLANK
CLASS[ord("A") : ord("Z") + 1] = CAPITAL
CLASS[[ord(c) for c in "#$%&*|"]] = SYMBOL
CLASS[0x80:0xC0] = INNER

#: The state after a byte, by the state before it and its class.
NEXT = np.array([[GAP, WORD, WORD, WORD, WORD], [GAP, WORD, WORD, WORD, WORD]], np.uint8)
OUTPUT = np.array(
    [
        [POINT, OPEN | POINT, OPEN | POINT | IS_CAPITAL, OPEN | POINT | IS_SYMBOL, OPEN],
        [CLOSE | POINT, POINT, POINT | IS_CAPITAL, POINT | IS_SYMBOL, 0],
    ],
    np.uint8,
)
assert (NEXT[GAP] == NEXT[WORD]).all()

_KINDS = (OPEN, POINT, IS_CAPITAL, IS_SYMBOL)
_ADDS = np.array([[out & kind > 0 for kind in _KINDS] for out in range(32)], np.int64)
PIECE = 1 << 20

FILTERS = "ABCDE"
#: The filter of repeated texts, which is the only one that needs other texts.
REPEATED = "E"


def transduce(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """What the machine puts out at each byte of texts that lie side by side; each starts in a gap."""
    kind = CLASS[data]
    state = np.zeros(len(data), np.uint8)
    state[1:] = NEXT[GAP][kind[:-1]]
    starts = offsets[:-1]
    state[starts[starts < len(data)]] = GAP
    return OUTPUT[state, kind]


def spans(output: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and byte after of every word; the end of a text closes its last word."""
    ends = offsets[1:][np.diff(offsets) > 0]
    open_ends = ends[CLASS[data[ends - 1]] != BLANK]
    return np.flatnonzero(output & OPEN), np.sort(np.concatenate([np.flatnonzero(output & CLOSE), open_ends]))


def measured(column: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
    """(words, distinct words, code points, capitals, symbols) of each text; a null is empty."""
    for _, data, offsets in tokens.blocks(column):
        output = transduce(data, offsets)
        opens, closes = spans(output, data, offsets)
        bounds, raw = np.searchsorted(opens, offsets), data.tobytes()
        for i in range(len(offsets) - 1):
            found = np.zeros(len(_KINDS), np.int64)
            for at in range(int(offsets[i]), int(offsets[i + 1]), PIECE):
                found += np.bincount(output[at : min(at + PIECE, offsets[i + 1])], minlength=32) @ _ADDS
            own = slice(int(bounds[i]), int(bounds[i + 1]))
            # a set finds a word by its hash and compares the bytes
            distinct = len({raw[a:b] for a, b in zip(opens[own].tolist(), closes[own].tolist())})
            words, points, capitals, symbols = found.tolist()
            yield words, distinct, points, capitals, symbols


_NUMBERS = ("n_words", "n_distinct", "n_points", "n_capitals", "n_symbols")
_ADDED = T.StructType([*[T.StructField(n, T.LongType()) for n in _NUMBERS], T.StructField("digest", T.BinaryType())])


def measures(documents: DataFrame, text: str = "text") -> DataFrame:
    """The rows, their text replaced by its measures: ``n_words``, ``n_distinct``, ``n_points``,
    ``n_capitals``, ``n_symbols`` and ``digest``, the SHA-256 of its bytes. A null text is empty; the
    other columns must not have these names."""
    rest = [name for name in documents.columns if name != text]
    texts = documents.select(*[documents[f"`{name}`"] for name in rest], documents[f"`{text}`"].alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(rest))
            found = np.array(list(measured(column)), np.int64).reshape(-1, 5)
            digests = [sha256(t.as_buffer() if t.is_valid else b"").digest() for t in column]
            columns = [*batch.columns[: len(rest)], *[pa.array(x) for x in found.T], pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*rest, *_ADDED.names])

    return texts.mapInArrow(run, T.StructType([*[texts.schema[n] for n in rest], *_ADDED]))


def fails_by_text() -> dict[str, Column]:
    """When a text fails a filter: too few words, too repetitive, too loud, or with code or markup signs."""
    return {
        "A": F.expr("n_words < 200"),
        "B": F.expr("100 * n_distinct < 50 * n_words"),
        "C": F.expr("100 * n_capitals > 3 * n_points"),
        "D": F.expr("n_symbols > 0"),
    }


def failing(documents: DataFrame, id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(doc_id, part, fails): one row per input row, bit k of ``fails`` set if it fails filter k.

    A null text is empty, a null part the empty string. A text is repeated if a row with a smaller id
    has the same one; an id that is null is greater than all others, and equal ids repeat nothing.
    """
    slim = documents.select(
        documents[f"`{id}`"].alias("doc_id"),
        F.coalesce(documents[f"`{part}`"].cast("string"), F.lit("")).alias("part"),
        documents[f"`{text}`"].alias("text"),
    )
    bits = [F.when(c, F.lit(1 << FILTERS.index(k))).otherwise(0) for k, c in fails_by_text().items()]
    rows = cut(measures(slim).select("doc_id", "part", "digest", sum(bits[1:], bits[0]).alias("fails")))
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")).filter("copies > 1")
    # null where nothing is repeated, and where no copy has an id
    later = F.col("least").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("least"))
    fails = F.when(later, F.col("fails").bitwiseOR(F.lit(1 << FILTERS.index(REPEATED)))).otherwise(F.col("fails"))
    return looked_up(rows, cut(firsts), "digest").select("doc_id", "part", fails.alias("fails"))


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, from (part, fails, n, good, toxic).

    ``counts`` has at most one row per part and set of failed filters. The orders of n filters are n!,
    which is what limits their number.
    """
    bit = {k: 1 << i for i, k in enumerate(filters)}
    orders = F.array(*[F.lit("".join(p)) for p in permutations(filters)])
    steps = (
        counts.groupBy("part")
        .agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("sets"))
        .select("part", "sets", F.explode(orders).alias("filter_order"))
        .select("*", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step"))
        .withColumn("letter", F.expr("substring(filter_order, step, 1)"))
        .withColumn("earlier", F.expr("substring(filter_order, 1, step - 1)"))
        .withColumn("own", sum((F.when(F.col("letter") == k, b).otherwise(0) for k, b in bit.items()), F.lit(0)))
        .withColumn("before", sum((F.when(F.col("earlier").contains(k), b).otherwise(0) for k, b in bit.items()), F.lit(0)))
    )
    new = "(s.fails & own) != 0 and (s.fails & before) = 0"

    def total(when: str, what: str = "s.n") -> Column:
        return F.expr(f"aggregate(sets, 0L, (a, s) -> a + if({when}, {what}, 0L))")

    return steps.select(
        "part",
        "filter_order",
        "step",
        total("(s.fails & (own | before)) = 0").alias("kept"),
        total(new).alias("removed"),
        total("(s.fails & own) != 0 and (s.fails & before) != 0").alias("redundant"),
        total("s.fails = own").alias("unique_fails"),
        total(new, "s.good").alias("good_lost"),
        total(new, "s.toxic").alias("toxic_lost"),
        # of the filters that a text fails each is first in the same number of orders
        total("(s.fails & own) != 0", f"s.n * ({factorial(len(filters))}L div bit_count(s.fails))").alias("shapley"),
    )


def audit(
    documents: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    part: str = "lang",
    good: str = "quality",
    toxic: str = "toxic",
) -> DataFrame:
    """One row per part, order of the five filters and step: part, filter_order, step, kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley.

    Counts are of rows, so a repeated row counts again; a row is good or toxic if any label of its id
    says 1. Without rows there are no parts and no result; without labels the last losses are 0.
    """
    marks = (
        labels.groupBy(labels[f"`{id}`"].alias("of"))
        .agg(*[F.coalesce(F.max((labels[f"`{c}`"] == 1).cast("long")), F.lit(0)).alias(n) for c, n in ((good, "good"), (toxic, "toxic"))])
        .filter("of is not null and good + toxic > 0")
    )
    rows = failing(documents, id, text, part).join(marks, F.col("doc_id") == F.col("of"), "left")
    counts = rows.groupBy("part", "fails").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")
    )
    return interactions(counts)
