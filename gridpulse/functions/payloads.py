"""Big-endian binary payloads.

The 12-byte head is decoded with built-in expressions, so the hot path never leaves the
JVM. The wide layout and the encoders move whole Arrow batches through numpy.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The float fields of a voltage message, in wire order.
WIDE_FIELDS = [
    "voltage", "demand", "val3", "val4", "val5", "val6",
    "val7", "val8", "val9", "val10", "val11", "val12",
]

# The codecs travel with the query, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_LONG_BYTES = 8
_WORD_BYTES = 4


def _number(payload: Column, start: int, size: int, base: int) -> Column:
    """Integer in ``size`` bytes, or null when the payload stops before them."""
    whole = F.octet_length(payload) >= start + size - 1
    digits = F.hex(F.when(whole, F.substring(payload, start, size)))
    return F.conv(digits, 16, base).cast("bigint")


def decode_long(payload: Column, start: int = 1) -> Column:
    """Signed 64-bit integer at byte ``start`` (from 1)."""
    return _number(payload, start, _LONG_BYTES, -10)


def decode_int(payload: Column, start: int = 9) -> Column:
    """Signed 32-bit integer at byte ``start``."""
    word = _number(payload, start, _WORD_BYTES, 10)
    return F.shiftright(F.shiftleft(word, 32), 32).cast("int")


def decode_float(payload: Column, start: int = 9) -> Column:
    """IEEE single-precision number at byte ``start``, special values included.

    Plain arithmetic without branches around the word, so that Spark computes the word once.
    The largest exponent overflows to infinity in the final cast.
    """
    word = _number(payload, start, _WORD_BYTES, 10)
    exponent = F.shiftright(word, 23).bitwiseAND(255)
    fraction = word.bitwiseAND(2**23 - 1)
    sign = 1.0 - 2.0 * F.shiftright(word, 31)
    mantissa = F.least(exponent, F.lit(1)) * 2**23 + fraction
    power = F.pow(F.lit(2.0), F.greatest(exponent, F.lit(1)) - 150)
    not_a_number = (exponent == 255) & (fraction > 0)
    return (sign * mantissa * power + F.when(not_a_number, float("nan")).otherwise(-0.0)).cast("float")


def decode_reading(payload: Column) -> list[Column]:
    """The default decoder hook: epoch and value of any message."""
    return [decode_long(payload).alias("epoch"), decode_float(payload).alias("value")]


def _rows(payload: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``width`` bytes of each message as a matrix, and which rows have them."""
    if isinstance(payload, pa.ChunkedArray):
        payload = payload.combine_chunks()
    offsets = np.frombuffer(payload.buffers()[1], np.int32)[payload.offset:][: len(payload) + 1]
    lengths = np.diff(offsets)
    usable = (lengths >= width) & np.asarray(payload.is_valid())
    if not usable.any():
        return np.zeros((len(payload), width), np.uint8), ~usable
    data = np.frombuffer(payload.buffers()[2], np.uint8)
    if usable.all() and (lengths == lengths[0]).all():
        # Messages of one layout lie back to back, so a view will do.
        body = data[offsets[0]: offsets[-1]].reshape(len(payload), lengths[0])
        return np.ascontiguousarray(body[:, :width]), ~usable
    matrix = np.zeros((len(payload), width), np.uint8)
    matrix[usable] = data[offsets[:-1][usable, None] + np.arange(width)]
    return matrix, ~usable


_WIDE_TYPE = T.StructType(
    [T.StructField("epoch", T.LongType()), *[T.StructField(f, T.FloatType()) for f in WIDE_FIELDS]]
)


@F.arrow_udf(_WIDE_TYPE)
def decode_wide(payload: pa.Array) -> pa.Array:
    """All thirteen fields of a 56-byte voltage message; null fields when it is shorter."""
    layout = np.dtype([("epoch", ">i8")] + [(f, ">f4") for f in WIDE_FIELDS])
    matrix, bad = _rows(payload, layout.itemsize)
    records = matrix.view(layout).ravel()
    fields = [pa.array(records["epoch"].astype(np.int64), mask=bad)]
    fields += [pa.array(records[f].astype(np.float32), mask=bad, from_pandas=False) for f in WIDE_FIELDS]
    return pa.StructArray.from_arrays(fields, ["epoch", *WIDE_FIELDS])


def decode_wide_reading(payload: Column) -> list[Column]:
    """The decoder hook for 56-byte voltage messages."""
    fields = decode_wide(payload)
    return [fields.getField(name).alias(name) for name in ("epoch", *WIDE_FIELDS)]


def _packed(columns: list[pa.Array], types: list[str]) -> pa.Array:
    """One fixed-width record per row; null where any input is null."""
    layout = np.dtype([(f"f{i}", t) for i, t in enumerate(types)])
    n = len(columns[0])
    records = np.zeros(n, layout)
    valid = np.ones(n, bool)
    for i, column in enumerate(columns):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        valid &= np.asarray(column.is_valid())
        records[f"f{i}"] = column.fill_null(0).to_numpy(zero_copy_only=False)
    lengths = np.where(valid, layout.itemsize, 0)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    bitmap = pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    data = pa.py_buffer(records[valid].tobytes())
    return pa.Array.from_buffers(pa.binary(), n, [bitmap, pa.py_buffer(offsets.tobytes()), data])


@F.arrow_udf(T.BinaryType())
def encode_long_float(epoch: pa.Array, value: pa.Array) -> pa.Array:
    """Encoder hook for readings and maxima: int64 and float32."""
    return _packed([epoch, value], [">i8", ">f4"])


@F.arrow_udf(T.BinaryType())
def encode_long_int(epoch: pa.Array, count: pa.Array) -> pa.Array:
    """Encoder hook for alerts: int64 and int32."""
    return _packed([epoch, count], [">i8", ">i4"])


@F.arrow_udf(T.BinaryType())
def encode_wide(epoch: pa.Array, fields: pa.Array) -> pa.Array:
    """56-byte voltage message from an epoch and a struct of the twelve floats."""
    if isinstance(fields, pa.ChunkedArray):
        fields = fields.combine_chunks()
    return _packed([epoch, *fields.flatten()], [">i8"] + [">f4"] * len(WIDE_FIELDS))


def decode_routed(subject: Column, payload: Column) -> list[Column]:
    """Decode by subject: maxima as floats, alerts as counts, anything else as a reading."""
    is_max = subject.contains("max")
    is_alert = ~is_max & subject.contains("alert")
    number = F.when(is_alert, decode_int(payload).cast("double")).otherwise(
        decode_float(payload).cast("double")
    )
    return [
        F.when(is_max, "max").when(is_alert, "alert").otherwise("data").alias("kind"),
        decode_long(payload).alias("epoch"),
        number.alias("number"),
    ]


def decode_routed_text(subject: Column, payload: Column, utc_offset_hours: int = 0) -> Column:
    """Printable form of a routed message: (subject, local time, value)."""
    at = F.date_format(
        F.timestamp_seconds(decode_long(payload) + utc_offset_hours * 3600),
        "yyyy-MM-dd'T'HH:mm:ss",
    )
    is_alert = ~subject.contains("max") & subject.contains("alert")
    value = F.when(is_alert, decode_int(payload).cast("string")).otherwise(
        decode_float(payload).cast("string")
    )
    return F.concat(F.lit("("), F.concat_ws(", ", subject, at, value), F.lit(")"))
