"""Expected load, voltage and temperature curves, used to compute residuals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .timeparts import is_weekend, local_date, local_hour

KNOT_HOURS = 3

# Curve knots at hours 0, 3, 6, 9, 12, 15, 18, 21, 24.
KNOTS = {
    ("consumer", "demand", False): [100.0, 100.0, 80.0, 50.0, 60.0, 80.0, 90.0, 115.0, 100.0],
    ("consumer", "demand", True): [100.0, 100.0, 80.0, 90.0, 80.0, 90.0, 115.0, 90.0, 100.0],
    ("consumer", "voltage", False): [117.0, 117.0, 118.0, 116.0, 115.0, 114.0, 116.0, 118.0, 117.0],
    ("consumer", "voltage", True): [117.0, 117.0, 116.0, 116.0, 118.0, 119.0, 119.0, 118.0, 117.0],
    ("business", "demand", False): [60.0, 80.0, 160.0, 280.0, 300.0, 290.0, 180.0, 80.0, 60.0],
    ("business", "demand", True): [100.0, 80.0, 70.0, 70.0, 60.0, 70.0, 80.0, 90.0, 100.0],
    ("business", "voltage", False): [117.0, 117.0, 118.0, 119.0, 119.0, 120.0, 118.0, 117.0, 117.0],
    ("business", "voltage", True): [117.0, 116.0, 116.0, 115.0, 114.0, 114.0, 114.0, 115.0, 117.0],
    ("industry", "demand", False): [3000.0, 3000.0, 3200.0, 3300.0, 3200.0, 3300.0, 3100.0, 3000.0, 3000.0],
    ("industry", "demand", True): [2700.0, 2700.0, 2750.0, 2800.0, 2800.0, 2850.0, 2750.0, 2700.0, 2700.0],
    ("industry", "voltage", False): [120.0, 120.0, 121.0, 122.0, 121.0, 122.0, 121.0, 121.0, 120.0],
    ("industry", "voltage", True): [120.0, 120.0, 121.0, 121.0, 121.0, 121.0, 120.0, 120.0, 120.0],
}

# Class number 0..9 -> demand modulus and voltage base of the closed form.
CLASS_COEFFICIENTS = [
    (0, 100, 100.0),
    (1, 150, 101.0),
    (2, 200, 102.0),
    (3, 250, 103.0),
    (4, 300, 104.0),
    (5, 800, 109.0),
    (6, 850, 110.0),
    (7, 900, 111.0),
    (8, 950, 112.0),
    (9, 1000, 113.0),
]

# Kind of each class number.
CLASS_KINDS = ["business"] * 3 + ["industry"] * 2 + ["consumer"] * 5

DEFAULT_MODULUS = 1000
DEFAULT_BASE = 113.0
BIAS_WEIGHT = 0.4


def string_hash(text: Column) -> Column:
    """Signed 32-bit polynomial hash of base 31, the usual JVM string hash."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("bigint"))
    word = F.aggregate(codes, F.lit(0).cast("bigint"), lambda h, c: (h * 31 + c) % 2**32)
    # Two shifts carry the sign over, where a comparison would compute the word twice.
    return F.shiftright(F.shiftleft(word, 32), 32)


def class_number(point_hash: Column) -> Column:
    return F.abs(point_hash) % 10


def class_of(number: Column) -> Column:
    return F.get(F.array(*[F.lit(kind) for kind in CLASS_KINDS]), number.cast("int"))


def usage_class(point: Column) -> Column:
    """Stable class of a usage point ``line.transformer.usage_point``."""
    return class_of(class_number(string_hash(point)))


def knot_segments(spark: SparkSession, kind: str) -> DataFrame:
    """One row per straight piece of each curve of ``kind``: 48 rows, a fixed size."""
    rows = []
    for (usage, what, weekend), ys in KNOTS.items():
        if what != kind:
            continue
        for i in range(len(ys) - 1):
            rows.append((usage, weekend, i, ys[i], ys[i + 1], max(ys) - min(ys)))
    return spark.createDataFrame(
        rows,
        "usage_class string, weekend boolean, segment int, y0 double, y1 double, curve_range double",
    )


def with_curve(
    df: DataFrame,
    kind: str,
    usage: Column,
    epoch: Column,
    noise: Column | None = None,
    utc_offset_hours: int = 0,
) -> DataFrame:
    """Add ``bias`` and ``expected`` of the class curve at the reading's hour.

    The joined table is fixed at 48 rows, which is why it may always be broadcast. The left
    join keeps readings without a class and spares a null check that hashes every key again.
    """
    hour = local_hour(epoch, utc_offset_hours)
    keyed = df.withColumns(
        {
            "usage_class": usage,
            "weekend": is_weekend(epoch, utc_offset_hours),
            "segment": F.floor(hour / KNOT_HOURS).cast("int"),
            "knot_offset": hour % KNOT_HOURS,
        }
    )
    joined = keyed.join(
        F.broadcast(knot_segments(df.sparkSession, kind)),
        ["usage_class", "weekend", "segment"],
        "left",
    )
    curve = F.col("y0") + (F.col("y1") - F.col("y0")) * F.col("knot_offset") / KNOT_HOURS
    bias = F.lit(0.0) if noise is None else profile_bias(F.col("curve_range"), noise)
    return joined.withColumns({"bias": bias, "expected": F.abs(bias + curve)}).drop(
        "segment", "knot_offset", "y0", "y1"
    )


def profile_bias(curve_range: Column, noise: Column) -> Column:
    return curve_range * BIAS_WEIGHT * (noise - 0.5)


def default_demand(
    point_hash: Column, noise: Column, modulus: int | Column = DEFAULT_MODULUS
) -> Column:
    return F.abs(noise * (point_hash % modulus))


def default_voltage(hour: Column, noise: Column, base: float | Column = DEFAULT_BASE) -> Column:
    return noise * 2 + hour / 2.4 + base


def class_coefficients(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        CLASS_COEFFICIENTS, "class_number bigint, demand_modulus bigint, voltage_base double"
    )


def with_linear_profile(df: DataFrame, point: Column, hour: Column, noise: Column) -> DataFrame:
    """Add the point's hash and the per-class closed forms; the joined table has ten rows."""
    hashed = df.withColumn("point_hash", string_hash(point))
    classed = hashed.withColumn("class_number", class_number(F.col("point_hash")))
    joined = classed.join(F.broadcast(class_coefficients(df.sparkSession)), "class_number", "left")
    return joined.withColumns(
        {
            "class_demand": default_demand(F.col("point_hash"), noise, F.col("demand_modulus")),
            "class_voltage": default_voltage(hour, noise, F.col("voltage_base")),
        }
    ).drop("demand_modulus", "voltage_base")


def temperature_model(epoch: Column, noise: Column | None = None, utc_offset_hours: int = 0) -> Column:
    """Seasonal temperature in single precision: yearly, weekly and hourly waves plus noise."""
    date = local_date(epoch, utc_offset_hours)
    hour = local_hour(epoch, utc_offset_hours)
    turn = F.lit(2 * math.pi)
    yearly = F.cos(turn * (F.dayofyear(date) - 1) / 365) * -22.0
    weekly = F.cos(turn * (F.weekday(date) - 1) / 6)
    hourly = F.cos(turn * hour / 23) * -5.0
    drift = F.lit(0.0) if noise is None else noise * 2
    return (yearly + weekly + hourly + drift).cast("float")


def voltage_correction(voltage: Column, temperature: Column) -> Column:
    """Load effect of the temperature on the voltage."""
    return voltage + F.abs(temperature - 5) * 0.08 - 1
