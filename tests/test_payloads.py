import math
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridpulse.functions import payloads


def _frame(spark, messages):
    return spark.createDataFrame([(bytearray(m),) for m in messages], "payload binary")


def _same(a, b):
    return (a is None and b is None) or a == b or (math.isnan(a) and math.isnan(b))


def test_decodes_every_exponent_and_special_value(spark):
    words = [0, 0x80000000, 1, 0x007FFFFF, 0x7F800000, 0xFF800000, 0x7FC00000, 0x80000001]
    words += [(s << 31) | (e << 23) | m for s in (0, 1) for e in range(255) for m in (0, 1, 0x555555, 0x7FFFFF)]
    messages = [struct.pack(">qI", i - 5, w) for i, w in enumerate(words)]
    got = _frame(spark, messages).select(*payloads.decode_reading(F.col("payload"))).collect()
    for row, message in zip(got, messages):
        epoch, value = struct.unpack(">qf", message)
        assert row.epoch == epoch
        assert _same(row.value, value), (row.value, value)
    assert math.copysign(1, got[1].value) == -1


def test_known_bytes(spark):
    raw = [b % 256 for b in (0, 0, 0, 0, 88, 47, -12, -62, 66, -32, 117, -61)]
    row = _frame(spark, [raw]).select(*payloads.decode_reading(F.col("payload"))).first()
    assert tuple(row) == struct.unpack(">qf", bytes(raw))


def test_round_trip_of_a_reading(spark):
    df = spark.createDataFrame([(1482549376, 12345.6789)], "epoch bigint, v double")
    sent = df.select(payloads.encode_long_float("epoch", F.col("v").cast("float")).alias("payload"))
    row = sent.select(*payloads.decode_reading(F.col("payload"))).first()
    assert (row.epoch, row.value) == (1482549376, float(np.float32(12345.6789)))


@settings(max_examples=10, deadline=None)
@given(
    st.lists(
        st.tuples(
            st.integers(-(2**63), 2**63 - 1),
            st.floats(width=32, allow_nan=False),
            st.integers(-(2**31), 2**31 - 1),
        ),
        min_size=1,
        max_size=40,
    )
)
def test_encoders_match_struct(spark, values):
    df = spark.createDataFrame(values, "e bigint, v float, n int").coalesce(1)
    got = df.select(
        payloads.encode_long_float("e", "v").alias("f"), payloads.encode_long_int("e", "n").alias("i")
    ).collect()
    assert [bytes(r.f) for r in got] == [struct.pack(">qf", e, v) for e, v, _ in values]
    assert [bytes(r.i) for r in got] == [struct.pack(">qi", e, n) for e, _, n in values]
    back = (
        df.select(payloads.encode_long_int("e", "n").alias("p"))
        .select(payloads.decode_long(F.col("p")), payloads.decode_int(F.col("p")))
        .collect()
    )
    assert [tuple(r) for r in back] == [(e, n) for e, _, n in values]


def test_nulls_and_short_messages_decode_to_null(spark):
    df = spark.createDataFrame(
        [(None,), (bytearray(b""),), (bytearray(b"1234567"),), (bytearray(b"12345678901"),)],
        "payload binary",
    )
    got = df.select(
        *payloads.decode_reading(F.col("payload")), payloads.decode_wide("payload").alias("w")
    ).collect()
    assert [r.epoch is None for r in got] == [True, True, True, False]
    assert all(r.value is None and r.w.epoch is None and r.w.val12 is None for r in got)
    nulls = spark.createDataFrame([(1, None), (2, 3.0)], "e bigint, v float").coalesce(1)
    sent = nulls.select(payloads.encode_long_float("e", "v").alias("p")).collect()
    assert sent[0].p is None and len(sent[1].p) == 12


def test_wide_round_trip(spark):
    floats = [100.5 + i for i in range(12)]
    message = struct.pack(">q12f", 1490939785, *floats)
    row = _frame(spark, [message]).select(payloads.decode_wide("payload").alias("d")).first().d
    assert tuple(row) == (1490939785, *floats)
    fields = F.struct(*[F.lit(v).cast("float").alias(f) for f, v in zip(payloads.WIDE_FIELDS, floats)])
    sent = spark.range(1).select(payloads.encode_wide(F.lit(1490939785), fields).alias("p")).first()
    assert bytes(sent.p) == message


@pytest.mark.parametrize(
    "subject, message, text",
    [
        ("x.max", struct.pack(">qf", 3600, 116.5), "(x.max, 1970-01-01T01:00:00, 116.5)"),
        ("x.alert", struct.pack(">qi", 0, 7), "(x.alert, 1970-01-01T00:00:00, 7)"),
        ("x.data", struct.pack(">qf", 0, 2.0), "(x.data, 1970-01-01T00:00:00, 2.0)"),
    ],
)
def test_routed_text(spark, subject, message, text):
    df = spark.createDataFrame([(subject, bytearray(message))], "subject string, payload binary")
    got = df.select(payloads.decode_routed_text(F.col("subject"), F.col("payload"))).first()[0]
    assert got == text
