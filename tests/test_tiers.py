import pytest
from pyspark.sql import functions as F

from gridpulse import session
from gridpulse.operators import buckets, percentiles
from gridpulse.sources import messages
from gridpulse.streaming import runner, tiers

SCHEMA = "name string, epoch bigint, value double"
START = 1_700_000_000 - 1_700_000_000 % 86400


def _points(spark, n=900):
    i = F.col("id")
    names = F.array(*[F.lit(f"app.{k}") for k in ("lower", "upper_90", "sum", "count", "mean")])
    return spark.range(n).select(
        F.element_at(names, (i % 5 + 1).cast("int")).alias("name"),
        (START + i * 7919 % 172_800).alias("epoch"),
        (i * 31 % 101).cast("double").alias("value"),
    )


@pytest.mark.parametrize("per_batch", [1, 3, None])
def test_tiers_do_not_depend_on_the_batches(spark, rows, per_batch):
    landed, root = session.scratch(spark, "points"), session.scratch(spark, "tiers")
    points = _points(spark)
    points.repartition(5).write.parquet(landed)
    stream = messages.message_files(spark, landed, SCHEMA, per_batch)
    runner.drain(stream, tiers.store_tiers(root, 300, 3600), session.scratch(spark, "progress"))
    assert rows(tiers.read_coarse(spark, root, 300, 3600)) == rows(buckets.rollup(points, 300, 3600))
    fine = buckets.bucketed(points, 300, {"value": F.max_by("value", "epoch")}, ("name",))
    assert rows(tiers.read_fine(spark, root), "name", "bucket", "value") == rows(fine, "name", "bucket", "value")


def test_late_points_reopen_their_slot(spark, rows):
    root = session.scratch(spark, "tiers")
    store = tiers.store_tiers(root, 10, 60)

    def batch(k, *points):
        store(spark.createDataFrame([("a.sum", START + t, v) for t, v in points], SCHEMA), k)

    def coarse():
        return [(s - START, n, v) for _, s, n, v in rows(tiers.read_coarse(spark, root, 10, 60))]

    batch(0, (5, 1.0), (12, 2.0))
    batch(1, (65, 8.0))
    assert coarse() == [(0, 2, 3.0), (60, 1, 8.0)]
    batch(2, (9, 4.0), (31, 5.0))  # the first slot has a later last point and one more fine slot
    assert coarse() == [(0, 3, 11.0), (60, 1, 8.0)]
    batch(3, (3, 100.0))  # later to arrive, but not the last of its fine slot
    assert coarse() == [(0, 3, 11.0), (60, 1, 8.0)]
    batch(2, (9, 4.0), (31, 5.0))  # a repeated batch changes nothing
    assert coarse() == [(0, 3, 11.0), (60, 1, 8.0)]
    kept = tiers.retained(spark, root, F.lit(START + 3600 + 30), fine_seconds=10, coarse_seconds=60)
    assert rows(kept.filter("tier = 'fine'"), "bucket") == [(START + 30,), (START + 60,)]


def test_slots_have_to_fit(spark):
    with pytest.raises(ValueError, match="whole number of fine"):
        tiers.store_tiers("x", 7, 60)
    with pytest.raises(ValueError, match="whole number of coarse"):
        tiers.store_tiers("x", 10, 50_000)


@pytest.mark.parametrize("per_batch", [1, None])
def test_sketched_percentiles_keep_their_rank(spark, rows, per_batch):
    landed, root = session.scratch(spark, "points"), session.scratch(spark, "sketches")
    i = F.col("id")
    points = spark.range(40_000).select(
        F.when(i % 3 == 0, "rare").otherwise("hot").alias("name"),
        (START + i * 7919 % 86_400).alias("epoch"),
        (i * 104_729 % 30_011).cast("double").alias("value"),
    )
    points.repartition(4).write.parquet(landed)
    stream = messages.message_files(spark, landed, SCHEMA, per_batch)
    runner.drain(stream, tiers.store_sketches(root, 600), session.scratch(spark, "progress"))
    for seconds, slots in ((600, 288), (86_400, 2)):
        found = tiers.read_percentile(spark, root, seconds, 0.9)
        here = points.withColumn("slot", F.col("epoch") - F.col("epoch") % seconds)
        checked = percentiles.rank_within(here, found, "value", "value", 0.9, ["name", "slot"]).collect()
        assert len(checked) == slots and all(r.within for r in checked)
        assert sum(r.n for r in checked) == found.agg(F.sum("n")).first()[0] == 40_000
    wrong = found.withColumn("value", F.col("value") * 0.95)
    assert not any(r.within for r in percentiles.rank_within(here, wrong, "value", "value", 0.9, ["name", "slot"]).collect())
    some = tiers.read_percentile(spark, root, 86_400, 0.5, (F.col("name") == "rare") & (F.col("period") <= START))
    assert [r.name for r in some.collect()] == ["rare"]


def test_sketches_of_a_repeated_batch_and_of_unknown_values(spark, rows):
    root = session.scratch(spark, "sketches")
    store = tiers.store_sketches(root, 10)
    values = [("a", START, None), ("b", START, float("nan")), ("b", START + 3, 4.0), ("b", START + 60, 8.0)]
    for _ in range(2):
        store(spark.createDataFrame(values, SCHEMA), 0)
    store(spark.createDataFrame([("b", START + 5, 2.0)], SCHEMA), 1)
    assert rows(tiers.read_percentile(spark, root, 10, 1.0)) == [("b", START, 2, 4.0), ("b", START + 60, 1, 8.0)]
    assert rows(tiers.read_percentile(spark, root, 3600, 0.5)) == [("b", START - START % 3600, 3, 4.0)]
    store(spark.createDataFrame([], SCHEMA), 2)
    assert tiers.read_percentile(spark, root, 10, 0.5).count() == 2
    with pytest.raises(ValueError, match="whole number of fine"):
        tiers.store_sketches("x", 7000)
