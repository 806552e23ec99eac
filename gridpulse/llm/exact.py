"""Exact duplicates by progressive refinement: length, then a prefix hash, then the full hash.

Only DataFrame functions are used. Texts are never shuffled: the groups that survive the cheap
keys are marked in a bitmap of fixed size, which goes back to the scan as a broadcast, and only
rows whose bit is set have their full content hashed. A bit set by chance costs one hash and
changes nothing, because the groups are formed on length, prefix hash and full hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpulse.llm.work import cut

#: The bitmap has this many rows of 64 bits: the size of the broadcast, whatever the input.
BITMAP_ROWS = 1 << 18
PREFIX = 64


def without_blanks(text: Column) -> Column:
    """Text without blanks, tabs, line feeds, vertical tabs, form feeds and carriage returns."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def exact_groups(documents: DataFrame, id: str = "doc_id", text: str = "text", hash_all: bool = False) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are without blanks. Of equal texts the one with the most code points
    stays, then the smallest id (null last). A null text is empty. Rows that repeat the id and size
    of the row that stays are the same document and stay with it. ``text_sha256`` is null for rows that
    never needed their full content, unless ``hash_all``.
    """
    rows = documents.select(
        documents[f"`{id}`"].alias("doc_id"),
        F.char_length(F.coalesce(documents[f"`{text}`"], F.lit(""))).alias("points"),
        without_blanks(documents[f"`{text}`"]).alias("plain"),
    ).select(
        "doc_id",
        "points",
        "plain",
        F.octet_length("plain").alias("length"),
        F.xxhash64(F.substring("plain", 1, PREFIX)).alias("prefix"),
    )
    slot = F.xxhash64("length", "prefix")
    bit = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    alive = (
        rows.groupBy("length", "prefix")
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
        .select(slot.alias("slot"))
        .groupBy(F.expr(f"(slot >> 6) & {BITMAP_ROWS - 1}").alias("place"))
        .agg(F.bit_or(bit).alias("bits"))
    )
    hashed = rows.withColumn("slot", slot).join(
        F.broadcast(alive), F.expr(f"(slot >> 6) & {BITMAP_ROWS - 1}") == F.col("place"), "left"
    )
    survives = F.coalesce(bit.bitwiseAND(F.col("bits")) != 0, F.lit(False))
    full = F.sha2("plain", 256)
    slim = cut(
        hashed.select(
            "doc_id",
            "points",
            "length",
            "prefix",
            survives.alias("survives"),
            (full if hash_all else F.when(survives, full)).alias("text_sha256"),
        )
    )
    key = ["length", "prefix", "text_sha256"]
    best = F.min(F.struct((-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("unnamed"), "doc_id"))
    groups = (
        slim.filter("survives")
        .groupBy(*key)
        .agg(best.alias("best"), F.count("*").alias("n"))
        .filter("n > 1")
    )
    joined = slim.join(groups, key, "left")
    grouped = F.col("n").isNotNull()
    return joined.select(
        "doc_id",
        F.when(grouped, F.col("best.doc_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        F.when(grouped, F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.less") == -F.col("points")))
        .otherwise(F.lit(True))
        .alias("kept"),
        "text_sha256",
    )
