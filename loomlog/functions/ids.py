"""Content ids and partition names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomlog.schema import DEFAULT_TENANT


def canonical_json(c: Column) -> Column:
    """JSON text with sorted keys and no spaces; NULL if it does not parse."""
    return F.to_json(F.try_parse_json(c))


def _framed(c: Column) -> Column:
    # length-prefixed, so no two different field lists give the same text
    text = c.cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("~"))


def framed_sha1(*cols: Column) -> Column:
    return F.sha1(F.concat(*[_framed(c) for c in cols]))


def doc_id() -> Column:
    """Id from content alone: a redelivered event gets the id it had. Expects canonical attrs."""
    return framed_sha1(
        F.col("tenant"),
        F.unix_micros("timestamp"),
        F.col("service"),
        F.col("level"),
        F.col("message"),
        F.col("attrs"),
    )


def tenant_or_default(c: Column) -> Column:
    return F.coalesce(c, F.lit(DEFAULT_TENANT))


def day_of(ts: Column) -> Column:
    return F.to_date(ts)


def index_name(tenant: Column, day: Column) -> Column:
    return F.concat(F.lit("logs-"), tenant_or_default(tenant), F.lit("-"), F.date_format(day, "yyyy.MM.dd"))


def parse_index_day(name: Column) -> Column:
    """Day from the last dash segment, NULL if that is no date."""
    last = F.substring_index(name, "-", -1)
    return F.when(last.rlike(r"^\d{4}\.\d{1,2}\.\d{1,2}$"), F.try_to_date(last, "yyyy.M.d"))


def parse_index_tenant(name: Column) -> Column:
    """Tenant between the prefix and the day; the short form without a tenant is the default's."""
    middle = F.regexp_extract(name, r"^logs-(.*)-[^-]*$", 1)
    return F.when(middle == "", F.lit(DEFAULT_TENANT)).otherwise(middle)


def row_key() -> Column:
    """What the live view takes as the same row between two polls."""
    return F.concat_ws(
        "|",
        F.coalesce(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("")),
        F.coalesce("service", F.lit("")),
        F.coalesce("message", F.lit("")),
    )
