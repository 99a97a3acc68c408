"""Instants. Inside the engine a time is a UTC TIMESTAMP or its epoch microseconds (``us``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICRO = 1_000_000

_ISO = (
    r"^\d{4}-\d{2}-\d{2}"
    r"([T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
)
_NUMBER = r"^[+-]?\d+(\.\d+)?$"
# Fixed value: epoch numbers above this are milliseconds, at or below it seconds.
_MILLIS_ABOVE = 20_000_000_000


def parse_ts(c: Column) -> Column:
    """ISO-8601 text to an instant, NULL otherwise; no offset means UTC.

    The shape is checked first: a bare cast also takes years and times of today.
    """
    return F.when(c.rlike(_ISO), F.try_to_timestamp(F.translate(c, ",", ".")))


def from_epoch(number: Column) -> Column:
    """Epoch seconds or milliseconds, told apart by size, to an instant."""
    exact = number.cast("decimal(38,9)")
    us = F.when(F.abs(exact) > _MILLIS_ABOVE, exact * 1000).otherwise(exact * MICRO)
    return F.timestamp_micros(F.round(us).cast("long"))


def parse_ts_or_epoch(c: Column) -> Column:
    return F.when(c.rlike(_NUMBER), from_epoch(F.when(c.rlike(_NUMBER), c))).otherwise(parse_ts(c))


def seconds_to_us(c: Column) -> Column:
    return F.round(c * MICRO).cast("long")


def wire_time(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
