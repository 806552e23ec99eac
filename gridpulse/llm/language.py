"""Language identification by fusing evidence.

For each language a text has a likelihood under byte trigrams; the model is counted from all texts
by their declared language. The likelihood is tempered, so that a long text does not drown the
rest. It is fused with the declared language, whose reliability is estimated, and with a prior of
the host, smoothed towards that of its address suffix and of the whole corpus. Priors are sums per
host and suffix, formed before the shuffle; a document's own share is taken out of them again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpulse.llm import tokens
from gridpulse.llm.work import bounded_batches, cut, packed

LANGUAGES = ("en", "de", "fr", "es")
UNKNOWN = "und"
BITS = 16
SMOOTHING = 0.01
#: Trigrams that count in full; more raise the evidence no further.
EVIDENCE = 60
#: Documents that a parent's prior weighs as.
STRENGTH = 10.0
ACCEPT = 0.5


def declared_language(tag: Column) -> Column:
    """The primary subtag in lower case; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(tag, r"^\s*([A-Za-z]{2,8})(?:[-_].*)?\s*$", 1)), F.lit(""))


def address_host(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))


def address_suffix(host: Column) -> Column:
    return F.nullif(F.regexp_extract(host, r"\.([^.]+)$", 1), F.lit(""))


def visible_text(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<[^>]*>", " ")


def declared_in_markup(html: Column) -> Column:
    return declared_language(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z0-9_-]+)", 1))


def trigrams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, texts, text of each trigram, its bucket); trigrams of blanks only are left out."""
    fold = np.frombuffer(tokens.LETTERS.fold, np.uint8)
    for first, data, offsets in tokens.blocks(column, tokens.SMALL_BYTES):
        n = len(offsets) - 1
        folded = fold[data].astype(np.uint64)
        if len(folded) < 3:
            yield first, n, np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        gram = folded[:-2] << np.uint64(16) | folded[1:-1] << np.uint64(8) | folded[2:]
        owner = np.repeat(np.arange(n), np.diff(offsets))
        whole = (owner[2:] == owner[:-2]) & ((gram & np.uint64(0xFFFF)) != 0x2020)
        yield first, n, owner[:-2][whole], (tokens.mix(gram[whole]) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    logs: np.ndarray  # languages and the unknown one, by bucket


def train(documents: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> Model:
    """Trigram counts of the declared languages, over all rows (text, declared).

    Each task adds up its own buckets; what reaches the driver is bounded by buckets and languages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), 1 << BITS), np.int64)
        for batch in batches:
            of = np.array([languages.index(x) for x in batch.column("declared").to_pylist()], np.int64)
            for first, _, owner, bucket in trigrams(batch.column("text")):
                counts += np.bincount((of[first + owner] << BITS) | bucket, minlength=counts.size).reshape(counts.shape)
        which, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(which.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(counts[which, bucket])],
            names=["language", "bucket", "n"],
        )

    rows = (
        documents.select("declared", "text")
        .filter(F.col("declared").isin(*languages))
        .mapInArrow(run, "language int, bucket int, n bigint")
        .groupBy("language", "bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    counts = np.full((len(languages), 1 << BITS), SMOOTHING)
    counts[rows["language"].to_numpy(), rows["bucket"].to_numpy()] += rows["n"].to_numpy()
    logs = np.log(counts / counts.sum(axis=1, keepdims=True))
    unknown = np.full((1, 1 << BITS), -BITS * np.log(2))
    return Model(languages, np.concatenate([logs, unknown]).astype(np.float32))


def evidence(documents: DataFrame, model: Model) -> DataFrame:
    """Adds ``logs`` (tempered log-likelihoods, the unknown language last) and ``own`` (their shares)
    to rows with ``text``; the text itself goes."""
    shared = documents.sparkSession.sparkContext.broadcast(model.logs)
    kept = [f for f in documents.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = shared.value
        for batch in batches:
            parts = [np.zeros((0, len(logs)))]
            for _, n, owner, bucket in trigrams(batch.column("text")):
                seen = np.bincount(owner, minlength=n)
                sums = np.column_stack([np.bincount(owner, row[bucket], n) for row in logs])
                parts.append(sums * np.minimum(1.0, EVIDENCE / np.maximum(seen, 1))[:, None])
            sums = np.concatenate(parts)
            own = np.exp(sums - sums.max(axis=1, keepdims=True))
            own /= own.sum(axis=1, keepdims=True)
            names = [f.name for f in kept]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(list(sums), pa.list_(pa.float64())), pa.array(list(own), pa.list_(pa.float64()))],
                names=[*names, "logs", "own"],
            )

    doubles = T.ArrayType(T.DoubleType())
    return documents.mapInArrow(run, T.StructType([*kept, T.StructField("logs", doubles), T.StructField("own", doubles)]))


def _total(n: int) -> Column:
    return F.array(*[F.sum(F.col("own")[i]) for i in range(n)])


def fused(rows: DataFrame, shares: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """Adds lang_found, probability and accepted to ``rows``, whose declared, host, logs and own go.

    ``shares`` are the rows that the priors are summed from. One row per host is joined; Spark
    broadcasts those only below its own threshold.
    """
    n = len(languages) + 1
    known = F.when(F.col("declared").isin(*languages), F.col("declared")).when(F.col("declared").isNotNull(), "other").otherwise("")
    totals = {r[0]: r[1] for r in shares.groupBy(known.alias("declared")).agg(_total(n).alias("own")).collect()}
    whole = [sum(v[i] for v in totals.values()) for i in range(n)]
    all_rows = sum(whole) or 1.0
    prior = [(w + 1.0 / n) / (all_rows + 1.0) for w in whole]
    labels = [*languages, "other", ""]
    says = {d: [(totals.get(d, [0.0] * n)[i] + 0.5) / (whole[i] + 0.5 * len(labels)) for i in range(n)] for d in labels}
    by_host = shares.filter("host is not null").groupBy("host").agg(_total(n).alias("own"))
    by_host = by_host.withColumn("suffix", address_suffix(F.col("host")))
    by_suffix = by_host.filter("suffix is not null").groupBy("suffix").agg(_total(n).alias("of_suffix"))
    hosts = by_host.join(by_suffix, "suffix", "left").select(
        F.col("host").alias("of"), F.col("own").alias("of_host"), "of_suffix"
    )

    shared = rows.sparkSession.sparkContext.broadcast((np.array(prior), {d: np.log(says[d]) for d in labels}))
    inputs = ("declared", "host", "logs", "own")
    kept = [f for f in rows.schema.fields if f.name not in inputs]
    names = np.array([*languages, UNKNOWN])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prior, says = shared.value
        for batch in batches:
            own, logs = _table(batch.column("own"), n), _table(batch.column("logs"), n)
            parent = np.tile(prior, (len(batch), 1))
            for column in ("of_suffix", "of_host"):  # each level smooths towards the one above
                rest = np.maximum(_table(batch.column(column), n) - own, 0.0)
                parent = (rest + STRENGTH * parent) / (rest.sum(axis=1, keepdims=True) + STRENGTH)
            said = np.array([says[d] for d in batch.column("known").to_pylist()]).reshape(len(batch), n)
            total = logs + said + np.log(parent)
            best = total.argmax(axis=1)
            share = np.exp(total - total.max(axis=1, keepdims=True))
            probability = 1.0 / share.sum(axis=1)
            accepted = logs.any(axis=1) & (best < n - 1) & (probability >= ACCEPT)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(f.name) for f in kept], pa.array(names[best].tolist(), pa.string()), pa.array(probability), pa.array(accepted)],
                names=[*[f.name for f in kept], "lang_found", "probability", "accepted"],
            )

    found = [
        T.StructField("lang_found", T.StringType()),
        T.StructField("probability", T.DoubleType()),
        T.StructField("accepted", T.BooleanType()),
    ]
    joined = rows.withColumn("known", known).join(hosts, F.col("host") == F.col("of"), "left").drop("of", "declared", "host")
    return joined.mapInArrow(run, T.StructType([*kept, *found]))


def _table(column: pa.Array, n: int) -> np.ndarray:
    """A column of lists of ``n`` numbers; a null list is all zero, which leaves a prior to its parent."""
    out = np.zeros((len(column), n))
    out[column.is_valid().to_numpy(zero_copy_only=False)] = column.drop_null().flatten().to_numpy().reshape(-1, n)
    return out


def identify(
    documents: DataFrame, id: str = "doc_id", text: str = "text", declared: str = "lang", host: str = "source",
    languages: tuple[str, ...] = LANGUAGES,
) -> DataFrame:
    """One row per input row: doc_id, lang, probability, accepted.

    A text without letters has no evidence of its own and is not accepted. A missing declaration is
    evidence like any other; without a host the prior is that of the whole corpus. Ties go to the
    first language.
    """
    slim = documents.select(
        documents[f"`{id}`"].alias("doc_id"),
        documents[f"`{text}`"].alias("text"),
        declared_language(documents[f"`{declared}`"]).alias("declared"),
        F.lower(documents[f"`{host}`"]).alias("host"),
    )
    rows = cut(evidence(slim, train(slim, languages)))
    return fused(rows, rows, languages).select("doc_id", F.col("lang_found").alias("lang"), "probability", "accepted")


def only_accepted(
    documents: DataFrame, text: str = "text", declared: str = "lang", host: str = "source",
    languages: tuple[str, ...] = LANGUAGES,
) -> DataFrame:
    """The accepted rows with all their columns."""
    bounded_batches(documents.sparkSession)
    rows = packed(documents, text=text, declared=declared, host=host).withColumns(
        {"declared": declared_language(F.col("declared")), "host": F.lower("host")}
    )
    model = train(rows, languages)
    shares = evidence(rows.drop("row"), model)
    return fused(evidence(rows, model), shares, languages).filter("accepted").select("row.*")


def identify_pages(pages: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """One row per page: page_id, lang, probability, accepted; the evidence is taken from url and html."""
    rows = pages.select(
        "page_id",
        visible_text(F.col("html")).alias("page_text"),
        declared_in_markup(F.col("html")).alias("page_lang"),
        address_host(F.col("url")).alias("page_host"),
    )
    return identify(rows, "page_id", "page_text", "page_lang", "page_host", languages).withColumnRenamed("doc_id", "page_id")
