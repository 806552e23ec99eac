import random
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from gridpulse.llm import chunks, language, work


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 7))) for _ in range(n))


def documents(spark, texts):
    return spark.createDataFrame([(i, t, len(t or "")) for i, t in texts], "doc_id long, text string, n_chars long")


def repeats():
    passage = ". ".join(prose(900 + k, 6) for k in range(20)) + "."
    texts = [(i, f"{prose(i, 30)}. {passage} {prose(i + 50, 30)}.") for i in range(6)]
    return [*texts, (3, texts[3][1]), (None, texts[1][1]), (7, None), (8, ""), (9, prose(9, 100))]


def test_text_goes_only_with_first_occurrences_that_a_run_ends_at(spark):
    frame = documents(spark, repeats()).select("doc_id", "text", F.xxhash64("text").alias("mark"))
    found = work.stored(chunks.occurrences(frame, work.cut(chunks.chunk_counts(frame))))
    first = chunks._first_occurrences(found).collect()
    assert len(first) == found.select("digest").distinct().count()
    assert sum(r.before is None and r.after is None for r in first) > len(first) / 3
    assert any(r.before for r in first) and any(r.after for r in first)
    stored = {(r.doc_id, r.mark, r.number): r for r in found.collect()}
    for r in first:
        own = stored[r.place.doc_id, r.place.mark, r.place.number]
        same = [x for x in stored.values() if x.digest == r.digest]
        assert r.before == (None if all(x.left for x in same) else own.before)
        assert r.after == (None if all(x.right for x in same) else own.after)


def test_rows_carry_the_text_once(spark):
    frame = documents(spark, repeats())
    slim = chunks.cleaned(frame, keep=["doc_id"])
    assert slim.schema["row"].dataType.names == ["doc_id"]
    columns = ["row.doc_id", "cleaned", "n_lines", "n_removed"]
    whole = chunks.cleaned(frame).select(*columns).collect()
    assert sorted(slim.select(*columns).collect(), key=str) == sorted(whole, key=str)
    assert sum(r.n_removed > 0 for r in whole) == 7


def test_clauses_are_counted_without_hashes_as_with_them():
    texts = [None, "", "\n", "a\n", "\nb", "a\n\nb. c\r\n", "x, y", " \t", *(f"{prose(i, 40)}.\n{prose(i + 1, 3)}; z" for i in range(300))]
    for column in (pa.array(texts), pa.array(texts * 30)):
        counted = [n for _, x in chunks.clause_counts(column) for n in x.tolist()]
        assert counted == [c.clauses(i) for c in chunks.chunks(column) for i in range(c.words.n)]


def test_shared_words_are_found_as_by_comparing_each_byte():
    def by_bytes(own, other):
        k = 0
        while k < min(len(own), len(other)) and own[-k - 1] == other[-k - 1]:
            k += 1
        while k and (own[-k] in b" \n" or k in (len(own), len(other)) or own[-k - 1] not in b" \n" or other[-k - 1] not in b" \n"):
            k -= 1
        return k

    draw = random.Random(4)
    for _ in range(3000):
        own, other = (b" " + bytes(draw.choice(b"aab \n") for _ in range(draw.randint(0, 20))) for _ in range(2))
        tail = bytes(draw.choice(b"ab ") for _ in range(draw.randint(0, 12)))
        assert chunks._shared_before(own + tail, other + tail) == by_bytes(own + tail, other + tail)


def test_a_worker_holds_few_words_at_once():
    column = pa.array([prose(i, 400) for i in range(1000)])
    list(chunks.chunks(column.slice(0, 10)))  # tables of powers are made once
    tracemalloc.start()
    try:
        for _ in chunks.chunks(column):
            pass
        assert tracemalloc.get_traced_memory()[1] < 16 << 20
    finally:
        tracemalloc.stop()


def test_batches_for_python_are_bounded_in_bytes(spark):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    frame = documents(spark, [(1, "x")]).withColumn("text", F.lit("ab " * 1500)).select(F.explode(F.sequence(F.lit(1), F.lit(4000))), "text")
    known = spark.conf.getAll.get(work.BATCH_LIMIT)
    for use in (
        lambda docs: chunks.cleaned(docs),
        lambda docs: language.only_accepted(docs.withColumns({"lang": F.lit("en"), "source": F.lit("s")})),
    ):
        try:
            spark.conf.unset(work.BATCH_LIMIT)
            use(documents(spark, [(1, "x y")]))
            sizes = [r.n for r in frame.mapInArrow(run, "n long").collect()]
            assert sum(sizes) > 16 << 20 and max(sizes) < 6 << 20
            spark.conf.set(work.BATCH_LIMIT, 1 << 20)
            use(documents(spark, [(1, "x y")]))
            assert int(spark.conf.get(work.BATCH_LIMIT)) == 1 << 20
        finally:
            spark.conf.unset(work.BATCH_LIMIT)
            if known is not None:
                spark.conf.set(work.BATCH_LIMIT, known)
