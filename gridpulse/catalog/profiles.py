"""Expected values and residuals per reading."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import profiles, timeparts
from ..operators import series
from ..sources import tables
from .base import HOUR_MAX, HOUR_TEMPERATURE, READINGS, TEMPERATURES, Catalog, tidy

catalog = Catalog()

POINTS = """points as (
    select usage_point, word - case when word >= 2147483648 then 4294967296 else 0 end as point_hash
    from (select usage_point,
                 list_reduce(list_prepend(cast(0 as bigint), list_transform(
                     string_split(line || '.' || transformer || '.' || usage_point, ''),
                     lambda c: cast(unicode(c) as bigint))),
                     lambda h, c: (h * 31 + c) % 4294967296) as word
          from (select distinct line, transformer, usage_point from readings)))"""

CLASSED = """classed as (
    select r.*, point_hash, abs(point_hash) % 10 as class_number,
           case when abs(point_hash) % 10 <= 2 then 'business'
                when abs(point_hash) % 10 <= 4 then 'industry' else 'consumer' end as usage_class,
           dayofweek(ts) in (0, 6) as weekend, cast(hour(ts) as bigint) as hour,
           (event_id % 1000) / 1000.0 as noise
    from readings r join points using (usage_point))"""


def _knots(kind: str) -> str:
    rows = ", ".join(
        f"('{usage}', {str(weekend).lower()}, {i}, {ys[i]}::double, {ys[i + 1]}::double, {max(ys) - min(ys)}::double)"
        for (usage, what, weekend), ys in profiles.KNOTS.items()
        if what == kind
        for i in range(len(ys) - 1)
    )
    return f"knots(usage_class, weekend, segment, y0, y1, curve_range) as (values {rows})"


CURVE = "(y0 + (y1 - y0) * (hour % 3) / 3.0)"
ON_KNOT = """from classed join knots on classed.usage_class = knots.usage_class
             and classed.weekend = knots.weekend and classed.hour // 3 = knots.segment"""

COEFFICIENTS = "coefficients(class_number, modulus, base) as (values " + ", ".join(
    f"({n}, {m}, {b}::double)" for n, m, b in profiles.CLASS_COEFFICIENTS
) + ")"


def _points(spark, sf_dir):
    """Readings with their point key and a repeatable noise column in [0, 1)."""
    return tables.readings(spark, sf_dir).select(
        "event_id",
        "epoch",
        "voltage",
        F.concat_ws(".", "line", "transformer", "usage_point").alias("point"),
        ((F.col("event_id") % 1000) / 1000.0).alias("noise"),
    )


@catalog.query("select event_id, usage_class from classed", READINGS, POINTS, CLASSED)
def usage_class(spark, sf_dir):
    return _points(spark, sf_dir).select(
        "event_id", profiles.usage_class(F.col("point")).alias("usage_class")
    )


def _curve(spark, sf_dir, kind, noise=None):
    points = _points(spark, sf_dir)
    return profiles.with_curve(
        points, kind, profiles.usage_class(F.col("point")), F.col("epoch"), noise
    )


@catalog.query(
    f"select event_id, classed.usage_class, round({CURVE}, 6) as expected {ON_KNOT}",
    READINGS, POINTS, CLASSED, _knots("demand"),
)
def profile_expected(spark, sf_dir):
    return tidy(_curve(spark, sf_dir, "demand").select("event_id", "usage_class", "expected"))


@catalog.query(
    f"""select event_id, round({CURVE}, 6) as expected, round(voltage - {CURVE}, 6) as residual {ON_KNOT}""",
    READINGS, POINTS, CLASSED, _knots("voltage"),
)
def profile_residual(spark, sf_dir):
    curve = _curve(spark, sf_dir, "voltage")
    residual = (F.col("voltage") - F.col("expected")).alias("residual")
    return tidy(curve.select("event_id", "expected", residual))


@catalog.query(
    f"""select event_id, round(0.4 * curve_range * (noise - 0.5), 6) as bias,
               round(abs(0.4 * curve_range * (noise - 0.5) + {CURVE}), 6) as expected {ON_KNOT}""",
    READINGS, POINTS, CLASSED, _knots("demand"),
)
def profile_bias(spark, sf_dir):
    curve = _curve(spark, sf_dir, "demand", F.col("noise"))
    return tidy(curve.select("event_id", "bias", "expected"))


@catalog.query(
    """select event_id, class_number, round(abs(noise * (point_hash % 1000)), 6) as demand,
              round(noise * 2 + hour / 2.4 + 113, 6) as voltage,
              round(abs(noise * (point_hash % modulus)), 6) as class_demand,
              round(noise * 2 + hour / 2.4 + base, 6) as class_voltage
       from classed join coefficients using (class_number)""",
    READINGS, POINTS, CLASSED, COEFFICIENTS,
)
def profile_linear(spark, sf_dir):
    points = _points(spark, sf_dir).withColumn("hour", timeparts.local_hour(F.col("epoch")))
    noise, hour = F.col("noise"), F.col("hour")
    linear = profiles.with_linear_profile(points, F.col("point"), hour, noise)
    return tidy(
        linear.select(
            "event_id",
            "class_number",
            profiles.default_demand(F.col("point_hash"), noise).alias("demand"),
            profiles.default_voltage(hour, noise).alias("voltage"),
            "class_demand",
            "class_voltage",
        )
    )


@catalog.query(
    """select event_id, round(cast(cast(
              -22 * cos(2 * pi() * (dayofyear(ts) - 1) / 365) + cos(2 * pi() * (isodow(ts) - 2) / 6)
              - 5 * cos(2 * pi() * hour(ts) / 23) + 2 * ((event_id % 1000) / 1000.0) as float) as double), 3)
              as expected
       from temperatures""",
    TEMPERATURES,
)
def temperature_model(spark, sf_dir):
    noise = (F.col("event_id") % 1000) / 1000.0
    expected = profiles.temperature_model(F.col("epoch"), noise).alias("expected")
    return tidy(tables.temperatures(spark, sf_dir).select("event_id", expected), 3)


@catalog.query(
    """select epoch, round(voltage + abs(temperature - 5) * 0.08 - 1, 6) as corrected
       from hour_max join hour_temperature using (epoch)""",
    READINGS, TEMPERATURES, HOUR_MAX, HOUR_TEMPERATURE,
)
def voltage_correction(spark, sf_dir):
    pairs = hour_pairs(spark, sf_dir)
    corrected = profiles.voltage_correction(F.col("voltage"), F.col("temperature"))
    return tidy(pairs.select("epoch", corrected.alias("corrected")))


def hour_pairs(spark, sf_dir):
    voltage = tables.hourly(tables.readings(spark, sf_dir)).groupBy("epoch").agg(
        F.max("voltage").alias("voltage")
    )
    return voltage.join(hour_temperatures(spark, sf_dir), "epoch")


def hour_temperatures(spark, sf_dir):
    return tables.hourly(tables.temperatures(spark, sf_dir)).groupBy("epoch").agg(
        F.max("temperature").alias("temperature")
    )


@catalog.query(
    """select epoch, temperature, forecast from (
           select *, lag(temperature, 12) over (order by epoch) as forecast from hour_temperature)
       where forecast is not null""",
    TEMPERATURES, HOUR_TEMPERATURE,
)
def forecast_lag(spark, sf_dir):
    return series.lag_forecast(hour_temperatures(spark, sf_dir), "temperature", [])


@catalog.query(
    """select a.epoch, a.temperature as actual, f.temperature as forecast
       from hour_temperature a join hour_temperature f on a.epoch = f.epoch + 43200""",
    TEMPERATURES, HOUR_TEMPERATURE,
)
def forecast_align(spark, sf_dir):
    hours = hour_temperatures(spark, sf_dir)
    return series.align_forecast(hours, hours, "temperature")
