import pytest
from pyspark.sql import functions as F

from gridpulse.functions import subjects


@pytest.fixture
def subject_frame(spark):
    names = ["a.b", "a.b.c", "a.b.c.d", "a", "x.b.c", "a.bb.c", "a.b+c"]
    return spark.createDataFrame([(n,) for n in names], "subject string")


@pytest.mark.parametrize(
    "pattern, expected",
    [
        ("a.>", {"a.b", "a.b.c", "a.b.c.d", "a.bb.c", "a.b+c"}),
        ("a.b.>", {"a.b.c", "a.b.c.d"}),
        ("a.*.c", {"a.b.c", "a.bb.c"}),
        ("*.b.c", {"a.b.c", "x.b.c"}),
        (">", {"a.b", "a.b.c", "a.b.c.d", "a", "x.b.c", "a.bb.c", "a.b+c"}),
        ("a.b", {"a.b"}),
        ("a.b+c", {"a.b+c"}),
        ("a.b.*", {"a.b.c"}),
    ],
)
def test_subject_patterns(subject_frame, pattern, expected):
    found = subject_frame.filter(subjects.subject_matches(F.col("subject"), pattern)).collect()
    assert {r.subject for r in found} == expected


def test_tail_wildcard_must_be_last():
    with pytest.raises(ValueError):
        subjects.subject_regex("a.>.b")


def test_tokens_are_the_last_three(spark, rows):
    df = spark.createDataFrame(
        [("city.voltage.data.3.4.2",), ("1.2",), ("a.b.c",)], "subject string"
    )
    assert rows(df.select(*subjects.subject_tokens(F.col("subject")))) == sorted(
        [(3, 4, 2), (None, 1, 2), (None, None, None)], key=repr
    )


def test_routing(spark):
    base = F.lit("city.extract")
    out = subjects.append_token(base, "voltage.max")
    row = spark.range(1).select(
        out.alias("out"),
        subjects.alert_subject(out).alias("alert"),
        subjects.report_subject(subjects.alert_subject(out)).alias("report"),
    ).first()
    assert tuple(row) == (
        "city.extract.voltage.max", "city.extract.voltage.alert", "city.report.voltage.alert"
    )


def test_metric_paths(spark):
    df = spark.createDataFrame(
        [("load.inject.users.meter_1.active",), ("load.inject.users.meter.1.active",)], "path string"
    )
    wanted = df.filter(subjects.path_matches(F.col("path"), "load.inject.users.meter_*.active"))
    assert [r[0] for r in wanted.select(subjects.path_node(F.col("path"), 3)).collect()] == ["meter_1"]
    built = subjects.metric_path(F.lit("p"), F.lit(None), F.lit("m"), F.lit("f"))
    assert spark.range(1).select(built).first()[0] == "p.m.f"
    assert spark.range(1).select(subjects.path_node(F.lit("a.b"), 5)).first()[0] is None
