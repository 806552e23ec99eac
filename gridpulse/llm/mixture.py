"""Mixing sources to target weights: blocks of equal size, apportioned by highest quotients.

Targets come from water-filling: sources share the wanted size by weight, none above its cap. The
size is cut into blocks, and the blocks go to the sources by Sainte-Laguë, then within each source
to its shards. In a shard the documents lie on a line in seeded order; whole passes over the line
and one run of blocks from a seeded start make up the quota. Only sums per source and shard are
joined, so a source with a third of all rows costs no more per task than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridpulse.llm.work import cut

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
BLOCK = 4
SHARDS = 256


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ordinal(frame: DataFrame, *order: Column) -> DataFrame:
    """The frame with ``position``: 0, 1, ... in the given order, counted over all partitions."""
    laid = cut(frame.orderBy(*order)).withColumn("slot", F.monotonically_increasing_id())
    part = F.shiftright("slot", 33)
    counts = sorted(laid.groupBy(part.alias("part")).count().collect())  # one row per partition
    before, total = [], 0
    for row in counts:
        before += [F.lit(row[0]), F.lit(total)]
        total += row[1]
    if not before:
        return laid.withColumnRenamed("slot", "position")
    offset = F.create_map(*before)[part]
    return laid.withColumn("position", offset + F.col("slot").bitwiseAND((1 << 33) - 1)).drop("slot")


def source_targets(sizes: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds ``target`` to rows of (source, source_size).

    Each round fixes the sources above their cap and shares the rest anew; it sends two sums to the
    driver. It ends when a round finds no further source.
    """
    ranked = ordinal(sizes, F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight)
    top = F.col("source_size") * F.lit(float(cap))
    goal = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, fixed = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) > top
        n, taken, free = ranked.agg(
            F.count(F.when(over, 1)), F.sum(F.when(over, top)), F.sum(F.when(~over, F.col("weight")))
        ).first()
        if n == fixed or not free:
            break
        fixed, level = n, (goal - (taken or 0.0)) / free
    wanted = F.col("weight") * F.lit(level)
    return ranked.withColumn("target", F.least(wanted, top) if free else top).drop("weight", "position")


def apportion(frame: DataFrame, weight: str, key: str, seats: float | None = None, group: str | None = None) -> DataFrame:
    """Adds ``quota``: seats by the quotients weight / 1, weight / 3, weight / 5, ...; ties to the first key.

    Without ``group`` all rows share ``seats``; with it the rows of a group share its column
    ``seats``. Most seats follow from a divisor that gives out too few; only the quotients around
    the border are ranked, a few for each row.
    """
    sums = [F.count("*").alias("rows"), F.sum(weight).alias("whole")]
    if group is None:
        n, whole = frame.agg(*sums).first()
        based = frame.withColumns({"rows": F.lit(n), "whole": F.lit(float(whole or 0)), "seats": F.lit(int(seats or 0))})
    else:
        totals = frame.groupBy(group).agg(*sums)
        based = frame.join(totals.withColumnRenamed(group, "of"), F.col(group).eqNullSafe(F.col("of"))).drop("of")
    share = F.when(F.col("whole") > 0, F.col(weight) / F.col("whole")).otherwise(F.lit(0.0))
    first = F.greatest(F.floor(share * (F.col("seats") - F.col("rows") / 2) + 0.5), F.lit(0)).cast("long")
    based = based.withColumn("share", share).withColumn("first", first)
    border = based.withColumn(
        "turn", F.explode(F.expr("sequence(first, first + cast(ceil(2 * rows * share) as long) + 2)"))
    ).filter("share > 0").withColumn("quotient", F.col(weight) / (2 * F.col("turn") + 1))
    order = [F.desc("quotient"), F.asc_nulls_last(key), F.asc("turn")]
    if group is None:
        left = int(seats or 0) - int(based.agg(F.sum("first")).first()[0] or 0)
        won = border.orderBy(*order).limit(max(left, 0))
    else:
        left = based.groupBy(F.col(group).alias("of")).agg((F.first("seats") - F.sum("first")).alias("left"))
        place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
        won = border.withColumn("place", place).join(left, F.col(group).eqNullSafe(F.col("of"))).filter("place <= left").drop("of")
    keys = [key] if group is None else [group, key]
    gained = won.groupBy(*[F.col(k).alias(f"of_{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("gain"))
    same = [F.col(k).eqNullSafe(F.col(f"of_{i}")) for i, k in enumerate(keys)]
    extra = ["rows", "whole", "seats", "share", "first", "gain", *[f"of_{i}" for i in range(len(keys))]]
    return (
        based.join(gained, same, "left")
        .withColumn("quota", F.col("first") + F.coalesce("gain", F.lit(0)))
        .drop(*extra)
    )


def mix(
    documents: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 11,
    block: int = BLOCK, shards: int = SHARDS, share: float = SHARE, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS,
) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken.

    ``size`` counts words (null text: 0). ``taken`` is how many words of the document the mix
    takes, repeats counted; it never exceeds ``cap`` times the size. A null source is a source of
    its own. Equal rows are exchangeable: the result as a whole does not depend on their order.
    """
    slim = cut(
        documents.select(
            documents[f"`{id}`"].alias("doc_id"),
            documents[f"`{source}`"].cast("string").alias("source"),
            word_count(documents[f"`{text}`"]).alias("size"),
        )
        .withColumn("draw", F.xxhash64(F.lit(seed), "doc_id"))
        .withColumn("shard", F.pmod(F.col("draw"), F.lit(shards)))
    )
    lines = slim.groupBy("source", "shard").agg(F.sum("size").alias("line"))
    targets = cut(source_targets(lines.groupBy("source").agg(F.sum("line").alias("source_size")), share, cap, weights))
    wanted = targets.agg(F.sum("target")).first()[0] or 0.0
    quotas = apportion(targets, "target", "source", round(wanted / block)).withColumnRenamed("quota", "seats")
    # ten rows per source and shard at most: the second apportionment
    shares = lines.join(quotas.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "inner").drop("of")
    shares = apportion(shares.select("source", "shard", "line", "seats"), "line", "shard", group="source")
    room = F.greatest(F.col("line"), F.lit(1))
    passes = F.least(F.floor(F.col("quota") * block / room), F.lit(cap)).cast("long")
    blocks = F.ceil(F.col("line") / block).cast("long")
    rest = F.when(F.col("passes") >= cap, 0).otherwise(F.col("quota") * block - F.col("passes") * F.col("line"))
    plan = (
        shares.withColumn("passes", passes)
        .withColumn("blocks", F.greatest(blocks, F.lit(1)))
        .withColumn("run", F.least(F.round(rest / block).cast("long"), F.col("blocks")))
        .withColumn("start", F.pmod(F.xxhash64(F.lit(seed), "source", "shard"), F.col("blocks")))
        .select(F.col("source").alias("s"), F.col("shard").alias("h"), "line", "passes", "blocks", "run", "start")
    )
    along = Window.partitionBy("source", "shard").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = slim.withColumn("end", F.sum("size").over(along)).withColumn("begin", F.col("end") - F.col("size"))

    def within(low: Column, high: Column) -> Column:
        return F.greatest(F.least(F.col("end"), high) - F.greatest(F.col("begin"), low), F.lit(0))

    stop = F.col("start") + F.col("run")
    extra = within(F.col("start") * block, F.least(stop, F.col("blocks")) * block) + within(
        F.lit(0), F.greatest(stop - F.col("blocks"), F.lit(0)) * block
    )
    taken = F.col("passes") * F.col("size") + extra
    return (
        placed.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("h")))
        .withColumn("taken", taken.cast("long"))
        .join(targets.withColumnRenamed("source", "t"), F.col("source").eqNullSafe(F.col("t")))
        .select("doc_id", "source", "size", "source_size", "target", "taken")
    )
