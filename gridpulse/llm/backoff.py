"""Language-model scores by stupid backoff over pairs of words.

The score of a word after another is the share of the pair among the pairs with that first word; a
pair that the corpus lacks falls back to ``ALPHA`` times the share of the single word. Where the
documents are the corpus themselves, each is left out of the counts that score it: its own pairs and
words are subtracted, so a pair that no other document has does fall back.

Pairs are exploded into arrays: one row holds what a block of texts has for one hash partition, sorted
by first word, so that a pair costs its second word and little more. Counts and the pairs to be scored
meet in their partition. A pair that is not found goes on to the partition of its second word, where
the count of that word is, and sums per document are added up.

A pair belongs to the partition of its first word, where the pairs of that word add up to its count.
A document is known by its block and its place there until its sums are complete; its id goes straight
to the block. Words with a notable share of all words would overfill a partition; these (a bounded number) are
counted beforehand, and their pairs are dealt out by both words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.llm import tokens

ALPHA = 0.4
#: A word is frequent from this share of all words on.
FREQUENT = 1 / 4096
#: Words and pairs travel by the lower 48 bits of their hash, six bytes each.
LOW = np.uint64((1 << 48) - 1)
START = np.uint64(0x5851F42D4C957F2D) & LOW
STOP = np.uint64(0x14057B7EF767814F) & LOW
COUNT, SCORE = 1, 2
#: Hash partitions for each shuffle partition at least, words of a hash partition at most (on average),
#: and bytes of text in a block of pairs.
PARTS = 2
PART_WORDS = 4_000_000
PAIR_BLOCK = 2 * tokens.BLOCK_BYTES


def _pairs(found: tokens.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, second word) of all pairs, with a start before and a stop after each text."""
    size = np.diff(found.bounds)
    size = np.where(size > 0, size + 1, 0)
    owner = np.repeat(np.arange(found.n), size)
    ends = np.cumsum(size)
    first = np.full(len(owner), START, np.uint64)
    second = np.full(len(owner), STOP, np.uint64)
    opens, closes = (ends - size)[size > 0], ends[size > 0] - 1
    inside = np.ones(len(owner), bool)
    inside[opens] = False
    first[inside] = found.hashes & LOW
    inside[:] = True
    inside[closes] = False
    second[inside] = found.hashes & LOW
    return owner, first, second


def frequent_words(documents: DataFrame, share: float = FREQUENT) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes and exact counts, as first words, of the words with at least about this share of all; number of all.

    Tasks report the words that reach half the share in a block, so at most 2 / share of them a block;
    no word that has the share overall can miss it everywhere.
    """

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in tokens.words(batch.column("text"), tokens.LETTERS):
                _, first, _ = _pairs(found)
                words, n = np.unique(first, return_counts=True)
                size = len(found.hashes)
                keep = n >= max(share / 2 * size, 1)
                keep &= n > 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(words[keep].view(np.int64), 0)), pa.array(np.append(n[keep], 0)), pa.array(np.append(np.zeros(keep.sum(), np.int64), size))],
                    names=["word", "n", "total"],
                )

    seen = documents.select("text").mapInArrow(candidates, "word bigint, n bigint, total bigint")
    sums = seen.groupBy("word").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).persist()
    total = sums.agg(F.sum("total")).first()[0] or 0
    chosen = sums.filter(F.col("n") >= share / 2 * total).filter("n > 0").select("word").toArrow()["word"].to_numpy()
    sums.unpersist()
    chosen = np.sort(chosen.astype(np.int64).view(np.uint64))
    shared = documents.sparkSession.sparkContext.broadcast(chosen)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        counts = np.zeros(len(words) + 1, np.int64)
        for batch in batches:
            for found in tokens.words(batch.column("text"), tokens.LETTERS):
                counts += np.bincount(_lookup(words, _pairs(found)[1]), minlength=len(words) + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(words))), pa.array(counts[:-1])], names=["at", "n"])

    rows = documents.select("text").mapInArrow(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(chosen), np.int64)
    counts[rows["at"].to_numpy()] = rows["n"].to_numpy()
    return chosen, counts, int(total)


def _lookup(words: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Position of each wanted hash among sorted words; their number if it is not there."""
    if not len(words):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(words, wanted), len(words) - 1)
    return np.where(words[at] == wanted, at, len(words))


def _both(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return tokens.mix(first * tokens.BASE + second)


def _small(values: np.ndarray) -> bytes:
    """Counts or positions in as many bytes each as the largest needs; the first byte says how many."""
    top = int(values.max(initial=0))
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _wide(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<u{packed[0]}", offset=1).astype(np.int64)


def _column(table: pa.Table, name: str) -> np.ndarray:
    """The values of all rows of a column that :func:`_small` packed."""
    return np.concatenate([np.zeros(0, np.int64), *[_wide(x) for x in table[name].to_pylist()]])


def _six(hashes: np.ndarray) -> bytes:
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _hashes(table: pa.Table, name: str) -> np.ndarray:
    """The hashes of all rows of a column that :func:`_six` packed."""
    packed = np.frombuffer(b"".join(table[name].to_pylist()), np.uint8).reshape(-1, 6)
    full = np.zeros((len(packed), 8), np.uint8)
    full[:, :6] = packed
    return full.view("<u8").ravel().astype(np.uint64)


def _part(words: np.ndarray, parts: int) -> np.ndarray:
    return (words % np.uint64(parts)).astype(np.int64)


def _own(owner: np.ndarray, word: np.ndarray, times: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """How often the text of each entry has its ``wanted`` word as the first of a pair."""
    known, at = np.unique(_both(word, owner.astype(np.uint64)), return_inverse=True)
    sums = np.bincount(at, times, len(known)).astype(np.int64)
    at = _lookup(known, _both(wanted, owner.astype(np.uint64)))
    return np.append(sums, 0)[at]


_ROW = "part bigint, role int, block bigint, ids array<{id}>, firsts binary, runs binary, seconds binary, " \
    "texts binary, times binary, own_first binary, own_second binary"


def exploded(documents: DataFrame, role: int, frequent: np.ndarray, parts: int) -> DataFrame:
    """Distinct pairs of each document with their multiplicity, in arrays by block and partition.

    Beside a pair go the times that its document has the first and the second word at all; for a
    document that does not count, and so need not be left out, both are zero.
    """
    shared = documents.sparkSession.sparkContext.broadcast(frequent)
    leave_out = role == COUNT | SCORE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, task = 0, TaskContext.get().partitionId()
        for batch in batches:
            ids = batch.column("doc_id")
            for found in tokens.words(batch.column("text"), tokens.LETTERS, PAIR_BLOCK):
                number += 1
                owner, first, second = _pairs(found)
                if not len(owner):
                    continue
                common = _lookup(shared.value, first) < len(shared.value)
                part = _part(np.where(common, _both(first, second), first), parts)
                order = np.lexsort((owner, second, first, part))
                owner, first, second, part = owner[order], first[order], second[order], part[order]
                new = np.ones(len(owner), bool)
                new[1:] = (owner[1:] != owner[:-1]) | (second[1:] != second[:-1]) | (first[1:] != first[:-1])
                at = np.flatnonzero(new)
                times = np.diff(np.append(at, len(owner)))
                owner, first, second, part = owner[at], first[at], second[at], part[at]
                own_first = own_second = np.zeros(len(owner), np.int64)
                if leave_out:
                    own_first, own_second = [_own(owner, first, times, x) for x in (first, second)]
                cuts = np.flatnonzero(np.diff(part)) + 1
                block = (task << 32 | number) << 2 | role
                rows = [{"part": block % parts, "role": 0, "block": block, "ids": ids.slice(found.first, found.n).to_pylist()}]
                for a, b in zip(np.append(0, cuts), np.append(cuts, len(part))):
                    heads = np.flatnonzero(np.append(True, first[a + 1 : b] != first[a : b - 1]))
                    rows.append(
                        {
                            "part": int(part[a]), "role": role, "block": block, "ids": None,
                            "firsts": _six(first[a:b][heads]), "runs": _small(np.diff(np.append(heads, b - a))),
                            "seconds": _six(second[a:b]), "texts": _small(owner[a:b]), "times": _small(times[a:b]),
                            "own_first": _small(own_first[a:b]), "own_second": _small(own_second[a:b]),
                        }
                    )
                types = [pa.int64(), pa.int32(), pa.int64(), pa.list_(ids.type), *[pa.binary()] * 7]
                yield pa.RecordBatch.from_pylist(rows, pa.schema(list(zip(rows[-1], types))))

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, _ROW.format(id=kind))


#: What a row of a scored partition holds: ids of a block, sums of a block, pairs not found, counts of words.
IDS, SUMS, MISSED, WORDS = 0, 1, 2, 3
_FOUND = "key bigint, kind int, ids array<{id}>, blocks array<bigint>, sizes binary, logs array<double>, n binary, " \
    "missed binary, words binary, texts binary, times binary, own binary"
_SUMS = "block bigint, ids array<{id}>, texts binary, logs array<double>, n binary, missed binary"


def _rows(rows: list[dict], schema: dict[str, pa.DataType]) -> pa.Table:
    return pa.Table.from_pylist(rows, pa.schema(list(schema.items())))


def _runs(values: np.ndarray) -> Iterator[slice]:
    """The runs of equal values."""
    cuts = np.flatnonzero(np.diff(values)) + 1
    for a, b in zip(np.append(0, cuts), np.append(cuts, len(values))):
        if b > a:
            yield slice(a, b)


def _scored(table: pa.Table, frequent: np.ndarray, counts: np.ndarray, parts: int) -> pa.Table:
    """One partition: sums of every block's texts, pairs to be looked up by second word, counts of words."""
    kind_of_ids = table.schema.field("ids").type
    named = table.filter(pa.compute.equal(table["role"], 0))
    rows = [{"key": b, "kind": IDS, "ids": i} for b, i in zip(named["block"].to_pylist(), named["ids"].to_pylist())]
    table = table.filter(pa.compute.not_equal(table["role"], 0))
    lengths = [len(x) // 6 for x in table["seconds"].to_pylist()]
    firsts = np.repeat(_hashes(table, "firsts"), _column(table, "runs"))
    seconds, times, text = _hashes(table, "seconds"), _column(table, "times"), _column(table, "texts")
    role = np.repeat(table["role"].to_numpy().astype(np.int8), lengths)
    counted = (role & COUNT) > 0
    left_out = np.where(role == COUNT | SCORE, times, 0)
    words, word = np.unique(firsts, return_inverse=True)
    of_word = np.bincount(word[counted], times[counted], len(words)).astype(np.int64)
    at = _lookup(frequent, words)
    common = at < len(frequent)
    of_word[common] = counts[at[common]]
    others_first = of_word[word] - _column(table, "own_first")
    del word
    pairs, pair = np.unique(_both(firsts, seconds), return_inverse=True)
    del firsts
    of_pair = np.bincount(pair[counted], times[counted], len(pairs)).astype(np.int64)
    del pairs
    others = of_pair[pair] - left_out
    del pair, of_pair, left_out
    asked = ((role & SCORE) > 0) & (seconds != STOP)
    seen = asked & (others > 0)
    logs = np.zeros(len(text))
    logs[seen] = times[seen] * np.log(others[seen] / others_first[seen])
    own = _column(table, "own_second")
    at = _lookup(frequent, seconds)
    known = asked & ~seen & (at < len(frequent))
    logs[known] = times[known] * np.log(np.maximum(counts[at[known]] - own[known], 0.5))
    lost = asked & ~seen & ~known
    del at, others, others_first

    bounds = np.append(0, np.cumsum(lengths)).astype(np.int64)
    for block, a, b in zip(table["block"].to_pylist(), bounds[:-1], bounds[1:]):
        texts, local = np.unique(text[a:b], return_inverse=True)
        n, missed = [np.bincount(local, np.where(x[a:b], times[a:b], 0), len(texts)) for x in (asked, asked & ~seen)]
        sums = np.bincount(local, logs[a:b], len(texts))
        rows.append({"key": block, "kind": SUMS, "texts": _small(texts), "logs": sums, "n": _small(n), "missed": _small(missed)})
    lost = np.flatnonzero(lost)
    part = _part(seconds[lost], parts)
    order = np.argsort(part, kind="stable")  # by block within a part
    lost, part = lost[order], part[order]
    block = np.repeat(table["block"].to_numpy(), lengths)[lost]
    for some in _runs(part):
        runs = list(_runs(block[some]))
        rows.append({
            "key": -1 - int(part[some.start]), "kind": MISSED,
            "blocks": [block[some][r.start] for r in runs], "sizes": _small(np.array([r.stop - r.start for r in runs])),
            "words": _six(seconds[lost[some]]), "texts": _small(text[lost[some]]),
            "times": _small(times[lost[some]]), "own": _small(own[lost[some]]),
        })
    single = np.flatnonzero(~common & (of_word > 0) & (words != START))
    if len(single):  # all of them belong to this partition
        home = int(_part(words[single[:1]], parts)[0])
        rows.append({"key": -1 - home, "kind": WORDS, "words": _six(words[single]), "times": _small(of_word[single])})
    long, packed = pa.int64(), pa.binary()
    return _rows(rows, {
        "key": long, "kind": pa.int32(), "ids": kind_of_ids, "blocks": pa.list_(long), "sizes": packed, "logs": pa.list_(pa.float64()),
        "n": packed, "missed": packed, "words": packed, "texts": packed, "times": packed, "own": packed,
    })


def _looked_up(table: pa.Table) -> list[dict]:
    """Sums of the pairs that fall back to the words of one partition."""
    of_words = table.filter(pa.compute.equal(table["kind"], WORDS))
    words, counts = _hashes(of_words, "words"), _column(of_words, "times")
    order = np.argsort(words)
    words, counts = words[order], counts[order]
    lost = table.filter(pa.compute.equal(table["kind"], MISSED))
    if not len(lost):
        return []
    block = np.repeat(pa.compute.list_flatten(lost["blocks"]).to_numpy(), _column(lost, "sizes"))
    others = np.append(counts, 0)[_lookup(words, _hashes(lost, "words"))] - _column(lost, "own")
    logs, text = _column(lost, "times") * np.log(np.maximum(others, 0.5)), _column(lost, "texts")
    order = np.lexsort((text, block))
    block, text, logs = block[order], text[order], logs[order]
    rows = []
    for run in _runs(block):
        texts, local = np.unique(text[run], return_inverse=True)
        rows.append({"block": block[run.start], "texts": _small(texts), "logs": np.bincount(local, logs[run], len(texts))})
    return rows


def _added(table: pa.Table) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of one block, and by text the sums of its rows: log-scores, words, pairs not found."""
    ids = next((x for x in table["ids"].to_pylist() if x is not None), [])
    rows = table.filter(pa.compute.is_valid(table["texts"]))
    texts, logs = _column(rows, "texts"), pa.compute.list_flatten(rows["logs"]).to_numpy()
    size = max(len(ids), int(texts.max(initial=-1)) + 1)
    counted = rows.filter(pa.compute.is_valid(rows["n"]))
    of = _column(counted, "texts")
    n, missed = [np.bincount(of, _column(counted, x), size).astype(np.int64) for x in ("n", "missed")]
    return ids, np.bincount(texts, logs, size).astype(float), n, missed


def _summed(table: pa.Table) -> pa.Table:
    """Sums of a block over all partitions, or of the pairs that fell back to words of one partition, still packed."""
    key = table["key"][0].as_py()
    if key < 0:
        rows = _looked_up(table)
    else:
        ids, logs, n, missed = _added(table)
        rows = [{"block": key, "ids": ids, "texts": _small(np.arange(len(logs))), "logs": logs, "n": _small(n), "missed": _small(missed)}]
    packed = pa.binary()
    return _rows(rows, {
        "block": pa.int64(), "ids": table.schema.field("ids").type, "texts": packed, "logs": pa.list_(pa.float64()), "n": packed, "missed": packed,
    })


def _named(table: pa.Table) -> pa.Table:
    """The sums of one block by document id."""
    ids, logs, n, missed = _added(table)
    kind = table.schema.field("ids").type.value_type
    rows = pa.table({"doc_id": pa.array(ids, kind), "logs": logs, "n": n, "missed": missed})
    return rows.filter(pa.compute.greater(rows["n"], 0))


def scores(
    documents: DataFrame, corpus: DataFrame | None = None, id: str = "doc_id", text: str = "text", alpha: float = ALPHA
) -> DataFrame:
    """One row per document id: doc_id, n_words, n_backed_off, log_score, mean_log_score.

    Counts come from all texts of ``corpus``, by default of the documents themselves without the one
    that is scored. A text without words (or null) scores 0 over 0 words, its mean is null. Rows that
    share an id (null is one) are added up; each is left out by itself, all of them of the number of
    words. A word that the counts lack scores as if it had been seen half a time, and where they have
    no words at all, as if they had one.
    """
    spark = documents.sparkSession
    slim = documents.select(documents[f"`{id}`"].alias("doc_id"), documents[f"`{text}`"].alias("text"))
    base = slim
    if corpus is not None:
        base = corpus.select(F.lit(None).cast(slim.schema["doc_id"].dataType).alias("doc_id"), corpus[f"`{text}`"].alias("text"))
    frequent, counts, words = frequent_words(base)
    parts = max(PARTS * int(spark.conf.get("spark.sql.shuffle.partitions")), words // PART_WORDS + 1)
    rows = exploded(base, COUNT | (SCORE if corpus is None else 0), frequent, parts)
    if corpus is not None:
        rows = rows.unionAll(exploded(slim, SCORE, frequent, parts))
    shared = spark.sparkContext.broadcast((frequent, counts))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def score(table: pa.Table) -> pa.Table:
        return _scored(table, *shared.value, parts)

    found = rows.groupBy("part").applyInArrow(score, _FOUND.format(id=kind))
    # sums stay packed until all of a block are added up: one row per document goes on
    sums = found.groupBy("key").applyInArrow(_summed, _SUMS.format(id=kind))
    sums = sums.groupBy("block").applyInArrow(_named, f"doc_id {kind}, logs double, n bigint, missed bigint")
    sums = sums.groupBy("doc_id").agg(*[F.sum(name).alias(name) for name in ("n", "missed", "logs")])
    sums = sums.withColumnRenamed("doc_id", "of")
    n, missed = [F.coalesce(name, F.lit(0)).cast("long") for name in ("n", "missed")]
    of_all = F.greatest(F.lit(words) - (n if corpus is None else 0), F.lit(1)).cast("double")
    logs = F.coalesce("logs", F.lit(0.0)) + missed * (F.lit(math.log(alpha)) - F.log(of_all))
    return (
        slim.select("doc_id").distinct().join(sums, F.col("doc_id").eqNullSafe(F.col("of")), "left")
        .select("doc_id", n.alias("n_words"), missed.alias("n_backed_off"), logs.alias("log_score"), F.try_divide(logs, n).alias("mean_log_score"))
    )
