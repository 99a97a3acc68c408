"""Folders that a stream writes per micro-batch, kept few.

``Versions``: each batch replaces the whole; a batch that is run again writes over its own version and starts from the
one before. ``Parts``: each batch adds a part, and from time to time the parts are rolled up into one whose
name says up to which batch it goes, so a roll-up that is repeated or broken off counts nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomlog.session import folders, remove_folder


def _numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """The numbers of the folders that were written to their end, in order."""
    return sorted(int(f.split("=")[1]) for f in folders(spark, path, f"{prefix}=*/_SUCCESS"))


class Versions:
    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def _read(self, found: list[int]) -> DataFrame:
        if not found:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/version={found[-1]}")

    def before(self, batch_id: int) -> DataFrame:
        return self._read([n for n in _numbers(self.spark, self.path, "version") if n < batch_id])

    def last(self) -> DataFrame:
        return self._read(_numbers(self.spark, self.path, "version"))

    def write(self, df: DataFrame, batch_id: int) -> None:
        """This batch's version; of those before it, one stays, for this batch to be run again and for readers."""
        df.write.mode("overwrite").parquet(f"{self.path}/version={batch_id}")
        for n in [n for n in _numbers(self.spark, self.path, "version") if n < batch_id][:-1]:
            remove_folder(self.spark, f"{self.path}/version={n}")


class Parts:
    """``fold`` makes one table of the union of parts and may be applied again to its own result."""

    def __init__(self, spark: SparkSession, path: str, schema: str, fold: Callable[[DataFrame], DataFrame], every: int = 100):
        self.spark, self.path, self.schema, self.fold, self.every = spark, path, schema, fold, every

    def write(self, df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        if len(_numbers(self.spark, self.path, "batch")) >= 2 * self.every:
            self.roll_up(batch_id - self.every)

    def read(self) -> DataFrame:
        return self.fold(self._until(None))

    def _until(self, limit: int | None) -> DataFrame:
        """The last roll-up (not beyond ``limit``) and the parts after it."""

        def within(n: int) -> bool:
            return limit is None or n <= limit

        # parts first: one that a roll-up removes in between is in the roll-up that is listed after it
        parts = [n for n in _numbers(self.spark, self.path, "batch") if within(n)]
        rolled = [n for n in _numbers(self.spark, self.path, "upto") if within(n)][-1:]
        paths = [f"{self.path}/upto={n}" for n in rolled]
        paths += [f"{self.path}/batch={n}" for n in parts if not rolled or n > rolled[0]]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def roll_up(self, limit: int) -> None:
        """Fold all parts up to batch ``limit``. What an earlier roll-up has covered is removed, what this one
        covers stays until the next one, for readers that have listed it."""
        rolled = _numbers(self.spark, self.path, "upto")
        if rolled and rolled[-1] >= limit:
            return
        self.fold(self._until(limit)).write.mode("overwrite").parquet(f"{self.path}/upto={limit}")
        if rolled:
            for n in rolled[:-1]:
                remove_folder(self.spark, f"{self.path}/upto={n}")
            for n in _numbers(self.spark, self.path, "batch"):
                if n <= rolled[-1]:
                    remove_folder(self.spark, f"{self.path}/batch={n}")
