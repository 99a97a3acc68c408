"""Joins of many rows with a smaller table on keys that may be hot.

A key that a third of all rows have would be one task of a shuffled join. Here the smaller table is broadcast if a
count shows that it is small; otherwise each of its rows is copied under a few salts, and the rows of the
large side are dealt over these by a hash of themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlog.session import broadcast_if_small

#: Copies of the smaller side; a key of all rows is then that many tasks' work.
SALTS = 64
FEW_ROWS = 10_000


def same_keys(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join on equal columns of which nulls are equal too, with the columns of ``on`` once."""
    if how in ("left_semi", "left_anti"):
        return a.alias("a").join(b.alias("b"), _equal(on), how)
    others = [F.col(f"b.`{c}`") for c in b.columns if c not in on]
    return a.alias("a").join(b.alias("b"), _equal(on), how).select("a.*", *others)


def _equal(on: list[str]) -> Column:
    return reduce(Column.__and__, (F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) for c in on))


def row_salt(df: DataFrame, salts: int = SALTS) -> Column:
    """A number below ``salts`` from the row's own values, the same in every attempt of a task. Rows that are
    equal throughout get the same, so count them before."""
    plain = [F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, T.MapType | T.VariantType)]
    return F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("int")


def salted(small: DataFrame, salts: int = SALTS) -> DataFrame:
    return small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def apart(rows: DataFrame, small: DataFrame, on: list[str], how: str = "inner", few: int = FEW_ROWS) -> DataFrame:
    """``same_keys`` of many ``rows`` with a smaller table, without a task per key. Nulls are equal."""
    marked = broadcast_if_small(small, few)
    if marked is not small:
        return same_keys(rows, marked, on, how)
    return same_keys(rows.withColumn("_salt", row_salt(rows)), salted(small), [*on, "_salt"], how).drop("_salt")
