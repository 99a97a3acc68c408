"""The log table: Parquet partitioned by tenant and day, one writer per table."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import date
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loomlog.functions.ids import canonical_json, day_of, doc_id, tenant_or_default
from loomlog.schema import LOG_COLUMNS, STORE_SCHEMA
from loomlog.plans.merges import MergeLog
from loomlog.session import path_exists, pin_utc

PROBED_DAYS = 1_000  # tenant-days of a batch that are looked up one by one; beyond, Spark lists the table
THREADS = 16


def store_rows(logs: DataFrame) -> DataFrame:
    """Log columns in stored form: canonical attrs, tenant, id, day."""
    attrs = F.coalesce("attrs", F.lit("{}"))
    return (
        logs.select(*LOG_COLUMNS)
        # attrs that do not parse, as with a key twice, stay as they came
        .withColumns({"tenant": tenant_or_default(F.col("tenant")), "attrs": F.coalesce(canonical_json(attrs), attrs)})
        .withColumns({"doc_id": doc_id(), "day": day_of(F.col("timestamp"))})
        .select(*STORE_SCHEMA.fieldNames())
    )


def dedupe(rows: DataFrame) -> DataFrame:
    """One row per id. The id covers every column, so equal ids are equal rows and a plain
    distinct does it: hash aggregation. Rows are dealt by id, which also serves a join on it."""
    return rows.repartition("doc_id").distinct()


def upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored and incoming rows together, each id once."""
    return dedupe(stored.unionByName(incoming))


def only_new(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming ids that are not stored yet, each once."""
    return dedupe(incoming).join(stored.select("doc_id"), "doc_id", "left_anti").select(*incoming.columns)


def _day_of_file(file: str) -> str:
    """The day of a file of the table from its folder's name; of a folder that names none, one after all days."""
    day = file.rsplit("/", 2)[1].removeprefix("day=")
    return day if day[:1].isdigit() else "~"


@dataclass(frozen=True)
class WriteResult:
    received: int
    new: int


class LogStore:
    def __init__(self, spark: SparkSession, path: str):
        pin_utc(spark)
        self.spark = spark
        self.path = path.rstrip("/")
        self.merges = MergeLog(spark, self.path)

    def exists(self) -> bool:
        return path_exists(self.spark, self.path)

    def read(self, tenant: str | None = None, since: date | None = None, until: date | None = None) -> DataFrame:
        """The table, or the part of one tenant and a range of days (both ends included).
        For one tenant only that tenant's folders are listed."""
        rows = self._scan(self.spark, "" if tenant is None else f"/{self._tenant_folder(tenant)}")
        if tenant is not None:
            rows = rows.where(F.col("tenant") == tenant)
        if since is not None:
            rows = rows.where(F.col("day") >= F.lit(since))
        if until is not None:
            rows = rows.where(F.col("day") <= F.lit(until))
        return rows

    def _scan(self, spark: SparkSession, part: str = "") -> DataFrame:
        if not path_exists(spark, self.path + part):
            return spark.createDataFrame([], STORE_SCHEMA)
        # the log of merges first: what is merged after it was read is not taken twice
        visible = self.merges.last().visible()
        return self.open(spark, [self.path + part], visible)

    def open(self, spark: SparkSession, paths: list[str], visible: Column | None) -> DataFrame:
        rows = spark.read.schema(STORE_SCHEMA).option("basePath", self.path).parquet(*paths)
        return rows if visible is None else rows.where(visible)

    def files(self, before: date | None = None) -> list[str]:
        """The files of one listing, of days before ``before``, retired ones too; for ``read_files`` and ``drop_files``."""
        if not self.exists():
            return []
        files = self.open(self.spark, [self.path], None).inputFiles()
        return [f for f in files if before is None or _day_of_file(f) < before.isoformat()]

    def read_files(self, files: list[str]) -> DataFrame:
        """The rows of just these files, as ``files`` names them: URL-encoded."""
        if not files:
            return self.spark.createDataFrame([], STORE_SCHEMA)
        return self.open(self.spark, [*map(unquote, files)], self.merges.last().visible())

    def _tenant_folder(self, tenant: str) -> str:
        return f"tenant={self._names().escapePathName(tenant)}"

    def _names(self):
        return self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils

    def write(self, logs: DataFrame) -> WriteResult:
        """Add the events that are not stored yet. Writing the same events again adds none,
        so a job that failed half way is simply run again. Events without a time have no day to
        be found by again and are refused. Only the tenant-days of the batch are listed and read."""
        rows = store_rows(logs).persist()
        try:
            return self._write(rows)
        finally:
            rows.unpersist()

    def _write(self, rows: DataFrame) -> WriteResult:
        us = F.unix_micros("timestamp")
        spans = rows.groupBy("tenant", "day").agg(F.count("*").alias("n"), F.min(us).alias("lo"), F.max(us).alias("hi"))
        few = spans.limit(PROBED_DAYS + 1).collect()
        whole = F.sum("n"), F.sum(F.when(F.col("day").isNull(), F.col("n"))), F.min("day"), F.max("day"), F.min("lo"), F.max("hi")
        if len(few) > PROBED_DAYS:
            received, undated, *ends = spans.agg(*whole).first()
        elif few:
            received, undated = sum(s.n for s in few), sum(s.n for s in few if s.day is None)
            ends = [None] * 4 if undated else [min(s.day for s in few), max(s.day for s in few), min(s.lo for s in few), max(s.hi for s in few)]
        else:
            return WriteResult(0, 0)
        if undated:
            raise ValueError(f"{undated} events have no timestamp")
        fresh = dedupe(rows)
        # the batch's own session, which in a stream is not the store's
        known = self._known(rows.sparkSession, spans, few if len(few) <= PROBED_DAYS else None, ends)
        if known is not None:
            fresh = fresh.join(known, "doc_id", "left_anti")
        seen = Observation()
        (
            fresh.select(*STORE_SCHEMA.fieldNames())
            # even file sizes: small tenant-days share a task, a hot one is split over many
            .hint("rebalance", "tenant", "day")
            .sortWithinPartitions("tenant", "day", "timestamp")
            # observed in the writing stage, whose tasks count once however often they run
            .observe(seen, F.count(F.lit(1)).alias("new"))
            .write.mode("append")
            .partitionBy("tenant", "day")
            .parquet(self.path)
        )
        return WriteResult(received, seen.get["new"])

    def _known(self, spark: SparkSession, spans: DataFrame, few: list | None, ends: list) -> DataFrame | None:
        """Ids of the stored rows that could equal a row of the batch. The id covers the tenant and
        the time, so a copy lies in its tenant's day and within its time span, and Parquet
        statistics skip the files outside all spans. The folders of a few tenant-days are looked up;
        of many, Spark lists the table, and partitions outside the batch's days are not read."""
        if few is None:
            if not path_exists(spark, self.path):
                return None
            stored = self.open(spark, [self.path], None).where(F.col("day").between(F.lit(ends[0]), F.lit(ends[1])))
        else:
            paths = [f"{self.path}/{self._tenant_folder(s.tenant)}/day={s.day.isoformat()}" for s in few]
            with ThreadPoolExecutor(THREADS) as pool:
                there = [p for p, found in zip(paths, pool.map(lambda p: path_exists(spark, p), paths), strict=True) if found]
            if not there:
                return None
            stored = self.open(spark, there, None)
        within = F.col("timestamp").between(F.timestamp_micros(F.lit(ends[2])), F.timestamp_micros(F.lit(ends[3])))
        own = F.unix_micros("timestamp").between(F.col("lo"), F.col("hi"))
        return stored.where(within).join(spans.drop("n"), ["tenant", "day"]).where(own).select("doc_id")

    def day_folders(self, tenant: str | None = None) -> list[tuple[str, date, str]]:
        """(tenant, day, path) of every partition, from folder names alone."""
        if not self.exists():
            return []
        owner = "tenant=*" if tenant is None else self._tenant_folder(tenant)
        pattern = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{owner}/day=*")
        fs = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = []
        for status in fs.globStatus(pattern):
            folder = status.getPath()
            name = self._names().unescapePathName(folder.getParent().getName().split("=", 1)[1])
            try:
                day = date.fromisoformat(folder.getName().split("=", 1)[1])
            except ValueError:
                continue
            out.append((name, day, folder.toString()))
        return out

    def drop_files(self, files: list[str]) -> int:
        """Delete just these files, and the tenant-days that have none left then. How many tenant-days they were of."""
        Path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        days = {f.rsplit("/", 1)[0] for f in files}
        uri = self.spark._jvm.java.net.URI

        def drop(file: str) -> None:
            fs.delete(Path(uri(file)), False)

        def drop_if_empty(day: str) -> None:
            folder = Path(uri(day))
            if fs.exists(folder) and not fs.listStatus(folder):
                try:
                    fs.delete(folder, False)
                except Exception:  # filled in between: it stays
                    pass

        with ThreadPoolExecutor(THREADS) as pool:
            for step, paths in ((drop, files), (drop_if_empty, days)):
                list(pool.map(step, paths))
        return len(days)
