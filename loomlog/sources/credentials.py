"""Credentials from ``key:tenant,key:tenant`` text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.functions.text import strip


def _pair(c: Column) -> Column:
    # split on the first colon only: the tenant part may hold more
    return F.split(c, ":", 2)


def credential_pairs(df: DataFrame, raw: str = "raw", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep…, pos, api_key, tenant) for the well-formed pairs; malformed ones are skipped."""
    pair = _pair(strip(F.col("_pair")))
    return (
        df.select(*keep, F.posexplode(F.split(raw, ",")).alias("pos", "_pair"))
        .where(F.contains("_pair", F.lit(":")))
        .select(*keep, "pos", strip(pair[0]).alias("api_key"), strip(pair[1]).alias("tenant"))
        .where("api_key != '' and tenant != ''")
    )


def credential_table(df: DataFrame, raw: str = "raw", order: tuple[str, ...] = ()) -> DataFrame:
    """(api_key, tenant): of several entries for one key the last one counts.

    ``order`` names the columns that put several texts in sequence.
    """
    last = F.max_by("tenant", F.struct(*order, "pos"))
    return credential_pairs(df, raw, keep=order).groupBy("api_key").agg(last.alias("tenant"))
