import pytest
from pyspark.sql import functions as F

from gridpulse import session
from gridpulse.functions.timeparts import local_date
from gridpulse.plans import averages
from gridpulse.sinks import reports, tables

KEYS, ORDER = ["k"], ["t", "id"]


@pytest.fixture
def path(spark):
    return session.scratch(spark, "test")


def _frame(spark, data):
    return spark.createDataFrame(data, "k string, t bigint, id int, v double")


def test_upserts_merge_and_survive_a_replay(spark, path, rows):
    first = _frame(spark, [("a", 1, 1, 1.0), ("a", 2, 1, 2.0), ("b", 1, 1, 5.0)])
    second = _frame(spark, [("a", 1, 9, 7.0), ("c", 90_000, 1, 8.0)])
    day = local_date(F.col("t"))
    for batch_id, df in ((0, first), (0, first), (1, second), (1, second)):
        tables.upsert_batch(df, path, batch_id, KEYS, ORDER, day)
    assert rows(tables.read_upserts(spark, path, KEYS, ORDER), "k", "v") == [("a", 7.0), ("b", 5.0), ("c", 8.0)]
    by_time = tables.read_upserts(spark, path, KEYS, ORDER, newest="order")
    assert rows(by_time, "k", "v") == [("a", 2.0), ("b", 5.0), ("c", 8.0)]
    late = F.col("day_partition") > "1970-01-01"
    assert rows(tables.read_upserts(spark, path, KEYS, ORDER, late), "k", "v") == [("c", 8.0)]


def test_compaction_keeps_the_rows(spark, path, rows):
    for batch_id in range(3):
        tables.upsert_batch(_frame(spark, [("a", batch_id, 0, float(batch_id))]), path, batch_id, KEYS, ORDER)
    fresh = session.scratch(spark, "compacted")
    tables.compact(tables.read_upserts(spark, path, KEYS, ORDER), fresh)
    assert rows(tables.read_upserts(spark, fresh, KEYS, ORDER), "k", "v") == [("a", 2.0)]
    assert tables.read_batches(spark, fresh).count() == 1
    tables.upsert_batch(_frame(spark, [("b", 0, 0, 7.0)]), fresh, 0, KEYS, ORDER)
    tables.upsert_batch(_frame(spark, [("a", 0, 0, 9.0)]), fresh, 1, KEYS, ORDER)
    assert rows(tables.read_upserts(spark, fresh, KEYS, ORDER), "k", "v") == [("a", 9.0), ("b", 7.0)]


def test_counters_count_each_batch_once(spark, path, rows):
    df = _frame(spark, [("a", 1, 1, 1.0), ("a", 2, 1, 2.0), ("b", 1, 1, 5.0)])
    for batch_id in (0, 0, 1):
        tables.increment_batch(df, path, batch_id, KEYS)
    assert rows(tables.read_counters(spark, path, KEYS)) == [("a", 4), ("b", 2)]


def test_batch_job_replaces_its_result(spark, path, rows):
    raw = spark.createDataFrame(
        [(1, 2, 2016, 12, 24, 115.0), (1, 2, 2016, 12, 24, 117.0)],
        "line int, transformer int, year int, month int, day int, voltage double",
    )
    target = session.scratch(spark, "daily")
    tables.overwrite(raw, path)
    averages.run(spark.read.parquet(path), target)
    tables.overwrite(raw.limit(0).unionAll(raw.withColumn("voltage", F.lit(1.0))), path)
    assert rows(averages.run(spark.read.parquet(path), target)) == [(1, 2, 2016, 12, 24, 1.0)]


def test_reports(spark, rows, capsys):
    df = spark.createDataFrame([(1482549376, 116.366646)], "epoch bigint, v double").withColumn("voltage", F.col("v").cast("float"))
    assert rows(reports.json_report(df, "voltage")) == [('{"epoch":1482549376,"voltage":116.366646}',)]
    message = reports.prediction_json(F.col("epoch"), F.col("voltage"), 116.0)
    assert df.select(message).first()[0] == '{"timestamp":1482549376000,"temperature":116.366646,"alert":116.0}'
    assert rows(reports.text_report(df, "voltage", F.lit("s"))) == [("s", "116.366646")]
    assert reports.show_stage(df, "MAX", "RAW_DATA") is df
    assert capsys.readouterr().out == ""
    reports.show_stage(df, "MAX", "MAX,RAW_DATA")
    assert "116.36" in capsys.readouterr().out


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        session.scratch(Session(), "x")
    assert session.scratch(spark, "x") != session.scratch(spark, "x")
