"""Calendar arithmetic on epoch seconds.

Everything works on integers and dates, so results do not depend on the session zone.
``utc_offset_hours`` is one explicit parameter for writers, training and scoring alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_SECONDS = 3600
DAY = 86400


def shifted(epoch: Column, utc_offset_hours: int = 0) -> Column:
    return epoch + F.lit(utc_offset_hours * 3600) if utc_offset_hours else epoch


def bucket_start(epoch: Column, seconds: int) -> Column:
    """First second of the bucket that holds ``epoch``."""
    return epoch - F.pmod(epoch, F.lit(seconds))


def local_date(epoch: Column, utc_offset_hours: int = 0) -> Column:
    return F.date_from_unix_date(F.floor(shifted(epoch, utc_offset_hours) / DAY).cast("int"))


def local_hour(epoch: Column, utc_offset_hours: int = 0) -> Column:
    return F.floor(F.pmod(shifted(epoch, utc_offset_hours), F.lit(DAY)) / 3600).cast("int")


def local_minute(epoch: Column, utc_offset_hours: int = 0) -> Column:
    return F.floor(F.pmod(shifted(epoch, utc_offset_hours), F.lit(3600)) / 60).cast("int")


def local_timestamp(epoch: Column, utc_offset_hours: int = 0) -> Column:
    """Local wall-clock time; shown as such in a UTC session."""
    return F.timestamp_seconds(shifted(epoch, utc_offset_hours))


def calendar_parts(epoch: Column, utc_offset_hours: int = 0) -> list[Column]:
    """year, month, day of month, hour, minute, day_of_week (Sunday is 0)."""
    date = local_date(epoch, utc_offset_hours)
    return [
        F.year(date).cast("smallint").alias("year"),
        F.month(date).cast("tinyint").alias("month"),
        F.dayofmonth(date).cast("tinyint").alias("day"),
        local_hour(epoch, utc_offset_hours).cast("tinyint").alias("hour"),
        local_minute(epoch, utc_offset_hours).cast("tinyint").alias("minute"),
        (F.dayofweek(date) - 1).cast("tinyint").alias("day_of_week"),
    ]


def is_weekend(epoch: Column, utc_offset_hours: int = 0) -> Column:
    return F.dayofweek(local_date(epoch, utc_offset_hours)).isin(1, 7)


def weekend_flag(epoch: Column, utc_offset_hours: int = 0) -> Column:
    """50 on Saturday and Sunday, otherwise 0."""
    return F.when(is_weekend(epoch, utc_offset_hours), 50).otherwise(0)


def hour_angle(hour: Column) -> Column:
    """Angle of the hour on a 24 h circle, from a single-precision fraction of the day."""
    return (hour / 24).cast("float").cast("double") * 2 * F.lit(math.pi)


def hour_features(hour: Column) -> list[Column]:
    angle = hour_angle(hour)
    return [(F.sin(angle) * 50).alias("hour_sin"), (F.cos(angle) * 50).alias("hour_cos")]


def time_rescale(epoch: Column, root: int | Column, factor: int = 900) -> Column:
    """Stretch time from ``root`` on: one second becomes ``factor`` (15 minutes)."""
    start = root if isinstance(root, Column) else F.lit(root)
    return start + (epoch - start) * factor
