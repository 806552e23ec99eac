"""Line deduplication by content-defined chunks of lines.

A text is cut into lines: at line feeds, at clause ends, and within a clause by a rolling hash over
neighbouring words, so that a passage pasted in mid-sentence has lines of its own. The lines' hashes then
choose the chunks: a chunk ends after each line whose hash is less than those of the lines beside
it. A chunk has two lines at least, and its boundaries depend on nothing but the lines around them, so they fall
into step again after an insertion.

Chunks that occur again are compared byte by byte, by grouping on their digest; of each the first
occurrence stays. With the first occurrence goes the text around it, where a run may end there. A later run of chunks that follow one another there as well is extended by the words that
both have before and after it, unless it stands between chunks that are repeated as well. The run goes if it then has ``WORDS`` words, so a removed passage has always
occurred before as a whole, and a passage is found up to the words at which it begins to differ. The ends of
a text cut its outer chunks in their own way; the first copy of a passage to be cut so may keep such a chunk.

Only chunks whose hash was counted more than once are shuffled with their bytes: those hashes are
marked in a bitmap of fixed size that goes back to the scan. Frequent chunks are salted by their share
of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpulse.llm import tokens
from gridpulse.llm.exact import BITMAP_ROWS
from gridpulse.llm.work import bounded_batches, cut, stored

#: Words whose rolling hash ends a line within a clause, on average after one word in ``EVERY``.
WINDOW = 2
EVERY = 4
#: Words that a chunk needs to be looked up, and a passage to be removed.
LEAST = 6
WORDS = 13
#: Bytes of the text before and after a chunk that go with its first occurrence.
CONTEXT = 128
#: Bytes of text whose words are held at once; the arrays made of them fit a core's cache.
BLOCK = 1 << 17
BITMAP_BITS = 26
#: Rows of 64 bits of the bitmap of first occurrences whose surroundings are fetched.
PLACE_ROWS = 1 << 20
#: A hash with more than one in so many of the repeated chunks is salted.
SHARE = 1000

_stops = np.zeros(256, bool)
_stops[[ord(c) for c in ".,;:!?"]] = True


@dataclass(frozen=True)
class Chunks:
    """Chunks of the texts of a block, as runs of their words."""

    words: tokens.Words
    first: np.ndarray  # first word of each chunk
    last: np.ndarray  # word after its last one
    hashes: np.ndarray
    bounds: np.ndarray  # the chunks of each text
    clause: np.ndarray  # clause of each word, counted through the block

    @property
    def eligible(self) -> np.ndarray:
        return self.last - self.first >= LEAST

    def span(self, chunk: int) -> tuple[int, int]:
        return int(self.words.starts[self.first[chunk]]), int(self.words.ends[self.last[chunk] - 1])

    def clauses(self, text: int) -> int:
        low, high = self.words.bounds[text], self.words.bounds[text + 1]
        return int(self.clause[high - 1] - self.clause[low] + 1) if high > low else 0


def _run_hashes(words: tokens.Words, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of runs of words, by prefix sums."""
    sums = np.zeros(len(words.hashes) + 1, np.uint64)
    np.cumsum(words.hashes * tokens.powers(tokens.BASE, len(words.hashes)), out=sums[1:])
    hashes = (sums[last] - sums[first]) * tokens.powers(tokens.INVERSE, len(words.hashes) + 1)[first]
    return tokens.mix(hashes ^ (last - first).astype(np.uint64))


def _clause_ends(data: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words end a text, and which a clause."""
    ends_text = np.zeros(len(ends), bool)
    ends_text[bounds[1:][np.diff(bounds) > 0] - 1] = True
    ends_clause = _stops[data[ends - 1]] | ends_text
    before_feed = np.searchsorted(ends, np.flatnonzero((data == 10) | (data == 13)), side="right") - 1
    ends_clause[before_feed[before_feed >= 0]] = True
    return ends_text, ends_clause


def clause_counts(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first text, clauses of each) of runs of texts, without hashes of their words."""
    for first, data, offsets in tokens.blocks(column, BLOCK):
        starts, ends = tokens.borders(data, offsets, tokens.VISIBLE.inside.take(data))
        bounds = np.searchsorted(starts, offsets)
        clauses = np.concatenate([[0], np.cumsum(_clause_ends(data, ends, bounds)[1])])
        yield first, np.diff(clauses[bounds])


def chunks(column: pa.Array) -> Iterator[Chunks]:
    for first, data, offsets in tokens.blocks(column, BLOCK):
        words = tokens.split(first, data, offsets, tokens.VISIBLE)
        n = len(words.starts)
        ends_text, ends_clause = _clause_ends(data, words.ends, words.bounds)
        ends_line = ends_clause.copy()
        rolled = np.flatnonzero(tokens.windows(words.hashes, WINDOW) % np.uint64(EVERY) == 0) + WINDOW - 1
        text = np.searchsorted(words.bounds, rolled, side="right") - 1
        ends_line[rolled[rolled - WINDOW + 1 >= words.bounds[text]]] = True

        line_last = np.flatnonzero(ends_line) + 1
        line_first = np.concatenate([[0], line_last[:-1]]) if len(line_last) else line_last
        line = _run_hashes(words, line_first, line_last)
        closes = ends_text[line_last - 1]
        if len(line) > 2:
            inner = (line[1:-1] < line[:-2]) & (line[1:-1] < line[2:])
            # a text's outer lines have no line beside them to be less than
            closes[1:-1] |= inner & ~closes[:-2] & ~closes[2:] & ~closes[1:-1]
        last = line_last[closes]
        begin = np.concatenate([[0], last[:-1]]) if len(last) else last
        clause = np.cumsum(ends_clause) - ends_clause
        yield Chunks(words, begin, last, _run_hashes(words, begin, last), np.searchsorted(begin, words.bounds), clause)


def _place(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - BITMAP_BITS)


def chunk_counts(documents: DataFrame) -> DataFrame:
    """(hash, count) of the hashes that more than one chunk has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in chunks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(found.hashes[found.eligible].view(np.int64))], names=["hash"])

    return documents.select("text").mapInArrow(run, "hash bigint").groupBy("hash").count().filter("count > 1")


def repeated_places(counts: DataFrame) -> np.ndarray:
    """A bitmap of the counted hashes."""
    place = F.shiftrightunsigned("hash", 64 - BITMAP_BITS)
    rows = (
        counts.select(place.alias("place"))
        .groupBy(F.shiftright("place", 6).alias("slot"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits"))
        .toArrow()
    )
    bitmap = np.zeros(1 << BITMAP_BITS - 6, np.int64)
    bitmap[rows["slot"].to_numpy()] = rows["bits"].to_numpy()
    return bitmap.view(np.uint8)


def salted_hashes(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, shares) of the hashes with over one in ``SHARE`` of all rows, fewer than
    ``SHARE`` of them; a hash is dealt over as many salts as it has such shares."""
    total = counts.agg(F.sum("count")).first()[0] or 0
    rows = counts.filter(F.col("count") * SHARE > total).toArrow().sort_by("hash")
    return rows["hash"].to_numpy(), rows["count"].to_numpy() * SHARE // max(total, 1) + 1


def _marked(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = _place(hashes)
    return (bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Copies of runs of bytes."""
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], ends - starts)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[at])])


def occurrences(documents: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc_id, mark, number, digest, salts, salt, chunk, before, after, left, right) of every chunk whose hash
    is marked.

    ``before`` and ``after`` hold ``CONTEXT`` bytes of the text around the chunk, fewer at its ends; ``left`` and
    ``right`` say whether the chunk beside it is marked as well.
    """
    shared = documents.sparkSession.sparkContext.broadcast((repeated_places(counts), *salted_hashes(counts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, heavy, many = shared.value
        for batch in batches:
            marks = batch.column("mark").to_numpy(zero_copy_only=False)
            for found in chunks(batch.column("text")):
                marked = _marked(bitmap, found.hashes) & found.eligible
                at = np.flatnonzero(marked)
                owner = np.searchsorted(found.bounds, at, side="right") - 1
                low, high = found.words.offsets[owner], found.words.offsets[owner + 1]
                raw = found.words.data.tobytes()
                beside = np.concatenate([[False], marked, [False]])
                opens = np.zeros(len(marked) + 1, bool)
                opens[found.bounds] = True
                start, end = found.words.starts[found.first[at]], found.words.ends[found.last[at] - 1]
                digests = [blake2b(raw[i:j], digest_size=16).digest() for i, j in zip(start.tolist(), end.tolist())]
                around = np.maximum(low, start - CONTEXT), np.minimum(high, end + CONTEXT)
                row, number = found.words.first + owner, at - found.bounds[owner]
                salts = np.ones(len(at), np.int64)
                if len(heavy):
                    own = found.hashes[at].view(np.int64)
                    place = np.minimum(np.searchsorted(heavy, own), len(heavy) - 1)
                    salts = np.where(heavy[place] == own, many[place], salts)
                salt = tokens.mix((marks[row] + number).view(np.uint64)) % salts.astype(np.uint64)
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(rows),
                        batch.column("mark").take(rows),
                        pa.array(number.astype(np.int32)),
                        pa.array(digests, pa.binary()),
                        pa.array(salts),
                        pa.array(salt.astype(np.int64)),
                        *[_slices(found.words.data, *x) for x in ((start, end), (around[0], start), (end, around[1]))],
                        pa.array(beside[at] & ~opens[at]),
                        pa.array(beside[at + 2] & ~opens[at + 1]),
                    ],
                    names=names,
                )

    id = documents.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {id}, mark bigint, number int, digest binary, salts bigint, salt bigint"
    columns += ", chunk binary, before binary, after binary, left boolean, right boolean"
    names = [c.split()[0] for c in columns.split(", ")]
    return documents.mapInArrow(run, columns)


def _bits(frame: DataFrame, hash: str, rows: int) -> DataFrame:
    """A column of hashes as rows (place, bits) of a bitmap of fixed size; only rows with bits are there."""
    return frame.groupBy(F.expr(f"({hash} >> 6) & {rows - 1}").alias("place")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast({hash} & 63 as int))")).alias("bits")
    )


def _flagged(frame: DataFrame, hash: str, bits: DataFrame, rows: int) -> DataFrame:
    """Rows with ``flagged``: whether the bit of their hash is set."""
    joined = frame.join(F.broadcast(bits), F.expr(f"({hash} >> 6) & {rows - 1}") == F.col("place"), "left")
    is_set = F.expr(f"shiftleft(1L, cast({hash} & 63 as int))").bitwiseAND(F.col("bits")) != 0
    return joined.withColumn("flagged", F.coalesce(is_set, F.lit(False))).drop("place", "bits")


def _first_occurrences(found: DataFrame) -> DataFrame:
    """(digest, place, left, right, salts, before, after) of the first occurrence of each chunk that occurs again.

    Only places are compared. The text around a chunk is fetched for the first occurrences alone, and for those
    that some occurrence may be extended from: their places go to the stored rows as a bitmap of fixed size.
    """
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark", "number")
    first = stored(
        found.groupBy("digest")
        .agg(
            F.min(F.struct(order.alias("place"), "left", "right")).alias("first"),
            F.count("*").alias("n"), F.max("salts").alias("salts"), F.min("chunk").alias("low"), F.max("chunk").alias("high"),
            F.bool_and("left").alias("all_left"), F.bool_and("right").alias("all_right"),
        )
        .filter("n > 1 and low = high")
        .select("digest", "first.*", "salts", "all_left", "all_right")
        .withColumn("key", F.xxhash64("place.doc_id", "place.mark", "place.number"))
    )
    rows = found.select("doc_id", "mark", "number", "before", "after", F.xxhash64("doc_id", "mark", "number").alias("own"))
    around = (
        _flagged(rows, "own", _bits(first.filter("not (all_left and all_right)"), "key", PLACE_ROWS), PLACE_ROWS)
        .filter("flagged")
        .select("own", order.alias("where"), F.struct("before", "after").alias("around"))
        # rows that repeat an id and its text have the same place, and the same text around it
        .groupBy("own")
        .agg(F.collect_set(F.struct("where", "around")).alias("rows"))
    )
    here = F.get(F.filter("rows", lambda x: x["where"].eqNullSafe(F.col("place"))), F.lit(0))["around"]
    return (
        first.join(around, F.col("key") == F.col("own"), "left")
        .withColumn("around", here)
        .select(
            "digest", "place", "left", "right", "salts",
            F.when(~F.col("all_left"), F.col("around.before")).alias("before"),
            F.when(~F.col("all_right"), F.col("around.after")).alias("after"),
        )
    )


def later_occurrences(documents: DataFrame) -> DataFrame:
    """(doc_id, mark, number, of, at, before, after): the chunks of each document that have occurred before it or
    in it, and of the first occurrence ``of`` (its document), ``at`` (its number), ``before`` and ``after``.

    The first occurrence has the least id (null last), then the least mark and number. Occurrences
    are compared as bytes; a digest that turned out to stand for several chunks names none of them.
    """
    found = stored(occurrences(documents, cut(chunk_counts(documents))))
    first = _first_occurrences(found).select(
        "digest", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
        F.struct("place", "left", "right", "before", "after").alias("first"),
    )
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark", "number")
    slim = found.select("doc_id", "mark", "number", "digest", "salt", "left", "right")
    later = slim.join(first, ["digest", "salt"]).filter(~order.eqNullSafe(F.col("first.place")))
    of = F.xxhash64("first.place.doc_id", "first.place.mark").alias("of")
    # inside a run nothing needs to be extended
    before = F.when(~(F.col("left") & F.col("first.left")), F.col("first.before")).alias("before")
    after = F.when(~(F.col("right") & F.col("first.right")), F.col("first.after")).alias("after")
    return later.select("doc_id", "mark", "number", of, F.col("first.place.number").alias("at"), before, after)


_LATER = ["number", "of", "at", "before", "after"]


def repeated(documents: DataFrame) -> DataFrame:
    """(doc_id, mark, later): ``later_occurrences`` of each document in order."""
    one = F.struct(*_LATER)
    return later_occurrences(documents).groupBy("doc_id", "mark").agg(F.array_sort(F.collect_list(one)).alias("later"))


_BLANKS = b" \t\n\r\x0b\x0c"


def _shared_before(own: bytes, other: bytes) -> int:
    """Bytes of whole words that both texts end in. A word at which either begins may be part of a longer one."""
    k, most = 0, min(len(own), len(other))
    while k < most:
        middle = (k + most + 1) // 2
        if own.endswith(other[-middle:]):
            k = middle
        else:
            most = middle - 1
    while k and (own[-k] in _BLANKS or k in (len(own), len(other)) or own[-k - 1] not in _BLANKS or other[-k - 1] not in _BLANKS):
        k -= 1
    return k


def _shared_after(own: bytes, other: bytes) -> int:
    """Bytes of whole words that both texts begin with."""
    return _shared_before(own[::-1], other[::-1])


def _removed(found: Chunks, text: int, later: Sequence[tuple]) -> list[tuple[int, int]]:
    """(first word, word after) of the passages to remove, in order and apart; ``later`` has tuples of ``_LATER``."""
    low, base = int(found.words.offsets[text]), int(found.bounds[text])
    high = int(found.words.offsets[text + 1])
    raw, starts = found.words.data, found.words.starts
    out: list[tuple[int, int]] = []
    i = 0
    while i < len(later):
        number, of, at, before, _ = later[i]
        j = i
        while j + 1 < len(later) and later[j + 1][:3] == (number + j + 1 - i, of, at + j + 1 - i):
            j += 1
        after = later[j][4]
        a, b = int(found.first[base + number]), int(found.last[base + number + j - i])
        # a blank stands for the border of a text
        if before:
            start = int(starts[a])
            start -= _shared_before(b" " + raw[max(low, start - len(before)) : start].tobytes(), b" " + before)
            a = int(np.searchsorted(starts, start))
        if after:
            end = int(found.words.ends[b - 1])
            end += _shared_after(raw[end : min(high, end + len(after))].tobytes() + b" ", after + b" ")
            b = int(np.searchsorted(starts, end))
        if b - a >= WORDS:
            if out and a <= out[-1][1]:
                out[-1] = out[-1][0], max(b, out[-1][1])
            else:
                out.append((a, b))
        i = j + 1
    return out


def _tuples(later: pa.Array) -> list[list[tuple]]:
    """Lists of structs of ``_LATER`` as lists of tuples; of a null an empty one."""
    ends = np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(later), 0).to_numpy(zero_copy_only=False)).tolist()
    flat = later.flatten()
    columns = [pa.compute.struct_field(flat, [name]) for name in _LATER]
    rows = list(zip(*(x.to_numpy(zero_copy_only=False).tolist() for x in columns)))
    return [rows[a:b] for a, b in zip([0, *ends], ends)]


_CLEANED = [
    T.StructField("cleaned", T.StringType()),
    T.StructField("n_lines", T.LongType()),
    T.StructField("n_removed", T.LongType()),
]


def _without(found: Chunks, text: int, passages: list[tuple[int, int]]) -> tuple[str, int]:
    """What remains of a text, and how many of its clauses lose words."""
    words, at, rest, clauses = found.words, int(found.words.offsets[text]), b"", set()
    high = int(words.bounds[text + 1])
    for a, b in passages:
        rest += words.data[at : words.starts[a]].tobytes()
        at = int(words.starts[b]) if b < high else int(words.offsets[text + 1])
        clauses.update(range(int(found.clause[a]), int(found.clause[b - 1]) + 1))
    return (rest + words.data[at : words.offsets[text + 1]].tobytes()).decode(), len(clauses)


def cleaned(documents: DataFrame, id: str = "doc_id", text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """Rows as (row, cleaned, n_lines, n_removed); the text is null where it was null.

    ``n_lines`` counts clauses and ``n_removed`` those that lose words. Rows are told apart by id and
    text: equal rows are one document and keep the same chunks. Empty texts and texts without words have no
    chunk and stay as they are. ``row`` has the columns ``keep``, all by default; the text as it was need not be moved.
    """
    bounded_batches(documents.sparkSession)
    keep = documents.columns if keep is None else keep
    carried = ["row"] if text in keep else ["row", "text"]
    rows = documents.select(
        F.struct(*[documents[f"`{name}`"] for name in keep]).alias("row"), documents[f"`{id}`"].alias("doc_id"), documents[f"`{text}`"].alias("text")
    ).withColumn("mark", F.xxhash64("text"))
    found = stored(later_occurrences(rows.select("doc_id", "text", "mark")))
    # texts without repeated chunks are not shuffled: the marks of the others go to the scan as a bitmap of fixed size
    flagged = _flagged(rows, "mark", _bits(found, "mark", BITMAP_ROWS), BITMAP_ROWS)
    # grouped as it is joined, so that it is dealt out once
    gone = found.groupBy(F.xxhash64("doc_id", "mark").alias("of")).agg(
        F.array_sort(F.collect_list(F.struct("doc_id", "mark", *_LATER))).alias("found")
    )
    same = lambda x: x["doc_id"].eqNullSafe(F.col("doc_id")) & (x["mark"] == F.col("mark"))
    own = F.transform(F.filter("found", same), lambda x: F.struct(*(x[name].alias(name) for name in _LATER)))
    touched = (
        flagged.filter("flagged").select(*carried, "doc_id", "mark", F.xxhash64("doc_id", "mark").alias("key"))
        .join(gone, F.col("key") == F.col("of"), "left").select(*carried, own.alias("later"))
    )
    rest = flagged.filter("not flagged").select(*carried, F.lit(None).cast(touched.schema["later"].dataType).alias("later"))
    joined = touched.unionAll(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text") if "text" in carried else pa.compute.struct_field(batch.column("row"), [text])
            later = batch.column("later")

            def out(first: int, texts: pa.Array, lines: Sequence[int], removed: Sequence[int]) -> pa.RecordBatch:
                arrays = [batch.column("row").slice(first, len(texts)), texts, pa.array(lines, pa.int64()), pa.array(removed, pa.int64())]
                return pa.RecordBatch.from_arrays(arrays, names=["row", *[f.name for f in _CLEANED]])

            # block by block, so that no second copy of all texts of a batch is held
            if later.null_count == len(later):
                for first, lines in clause_counts(column):
                    yield out(first, column.slice(first, len(lines)), lines, np.zeros(len(lines), np.int64))
                continue
            for found in chunks(column):
                first, n = found.words.first, found.words.n
                texts, removed = column.slice(first, n), [0] * n
                passages = [_removed(found, i, x) if x else [] for i, x in enumerate(_tuples(later.slice(first, n)))]
                if any(passages):
                    left = texts.to_pylist()
                    for i, x in enumerate(passages):
                        if x:
                            left[i], removed[i] = _without(found, i, x)
                    texts = pa.array(left, pa.string())
                yield out(first, texts, [found.clauses(i) for i in range(n)], removed)

    return joined.mapInArrow(run, T.StructType([joined.schema["row"], *_CLEANED]))


def report(documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed, n_chars, text_sha256 of what remains."""
    return cleaned(documents, id, text, keep=[id]).select(
        F.col(f"row.`{id}`").alias("doc_id"),
        "n_lines",
        "n_removed",
        F.char_length(F.coalesce("cleaned", F.lit(""))).cast("long").alias("n_chars"),
        F.sha2(F.coalesce("cleaned", F.lit("")), 256).alias("text_sha256"),
    )


def deduplicated(documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with all their columns, repeated passages cut out of the text.

    A row that loses all its words is a copy and goes; one that had none before stays, also a null
    text. ``n_chars``, if there, counts what remains.
    """
    new = {text: F.col("cleaned")}
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        length = F.char_length("cleaned").cast(kind)
        new["n_chars"] = F.when(F.col("n_removed") > 0, length).otherwise(F.col("row.n_chars"))
    columns = [new.get(n, F.col(f"row.`{n}`")).alias(n) for n in documents.columns]
    left = (F.col("n_removed") == 0) | F.col("cleaned").rlike(r"[^\x00-\x20]")
    return cleaned(documents, id, text, keep=[n for n in documents.columns if n != text]).filter(left).select(*columns)
