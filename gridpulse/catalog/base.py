"""Registering queries, and the SQL views their comparisons share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFunction = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: QueryFunction
    sql: str | None


class Catalog:
    def __init__(self) -> None:
        self.entries: dict[str, Query] = {}

    def query(self, sql: str | None = None, *views: str) -> Callable[[QueryFunction], QueryFunction]:
        """Register a function under its own name; ``views`` are prepended to ``sql``."""

        def register(run: QueryFunction) -> QueryFunction:
            text = sql
            if sql is not None and views:
                text = "with " + ",\n".join(views) + "\n" + sql
            self.entries[run.__name__] = Query(run, text)
            return run

        return register


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Widen integers and round floats, so both engines print the same values."""
    columns = []
    for field in df.schema.fields:
        c = F.col(field.name)
        if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            c = F.round(c.cast("double"), digits)
        columns.append(c.alias(field.name))
    return df.select(*columns)


READINGS = """readings as (
    select event_id, ts, cast(floor(epoch(ts)) as bigint) as epoch, user_id % 3 as line,
           user_id % 10 as transformer, user_id as usage_point, value as voltage,
           'raw.voltage.data.' || (user_id % 3) || '.' || (user_id % 10) || '.' || user_id as subject
    from events where event_type <> 'view')"""

TEMPERATURES = """temperatures as (
    select event_id, ts, cast(floor(epoch(ts)) as bigint) as epoch, value as temperature
    from events where event_type = 'view')"""

READINGS_BIG = """readings_big as (
    select cast(l_linenumber as bigint) as line, l_suppkey as transformer, l_partkey as usage_point,
           l_orderkey as reading_id, l_quantity as voltage, l_shipdate as ts,
           cast(floor(epoch(l_shipdate)) as bigint) as epoch
    from lineitem)"""

HOUR_MAX = """hour_max as (
    select epoch - epoch % 3600 as epoch, max(voltage) as voltage from readings group by 1)"""

HOUR_TEMPERATURE = """hour_temperature as (
    select epoch - epoch % 3600 as epoch, max(temperature) as temperature from temperatures group by 1)"""

FLUSHED = """flushed as (
    select event_type, cast(floor(epoch(ts)) as bigint) - cast(floor(epoch(ts)) as bigint) % 300 as epoch,
           cast(count(*) as double) as n, min(value) as lo, max(value) as hi,
           sum(value) as total, avg(value) as mean
    from events group by 1, 2)"""

METRICS = """metrics as (
    select 'app.' || event_type || '.count' as name, epoch, n as value from flushed
    union all select 'app.' || event_type || '.lower', epoch, lo from flushed
    union all select 'app.' || event_type || '.upper', epoch, hi from flushed
    union all select 'app.' || event_type || '.sum', epoch, total from flushed
    union all select 'app.' || event_type || '.mean', epoch, mean from flushed)"""

COUNTERS = """counters as (
    select event_type, epoch, cast(sum(n) over (
               partition by event_type, epoch // 86400 order by epoch) as bigint) as counter
    from (select event_type,
                 cast(floor(epoch(ts)) as bigint) - cast(floor(epoch(ts)) as bigint) % 3600 as epoch,
                 count(*) as n
          from events group by 1, 2))"""

TYPE_HOURS = """type_hours as (
    select event_type,
           cast(floor(epoch(ts)) as bigint) - cast(floor(epoch(ts)) as bigint) % 3600 as bucket,
           max(value) as value
    from events group by 1, 2)"""

TYPE_GRID = """grid as (
    select event_type, unnest(generate_series(lo, hi, 3600)) as bucket
    from (select distinct event_type from type_hours),
         (select min(bucket) as lo, max(bucket) as hi from type_hours)),
filled as (
    select event_type, bucket, value from grid left join type_hours using (event_type, bucket))"""

DAY_PARTS = """cast(year(ts) as bigint) as year, cast(month(ts) as bigint) as month,
           cast(day(ts) as bigint) as day"""

TIME_PARTS = DAY_PARTS + """, cast(hour(ts) as bigint) as hour,
           cast(minute(ts) as bigint) as minute, cast(dayofweek(ts) as bigint) as day_of_week"""
