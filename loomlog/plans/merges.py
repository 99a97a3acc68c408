"""Small files of a table merged into large ones, without a moment in which a reader sees half of it.

A merge writes its files aside, moves them into place under a name that carries the merge's id, and
only then adds the id to the log, together with the files it replaces. A reader takes the
newest log, which appears at once or not at all: it leaves out merged files of ids that are not
in it, and replaced files. Replaced files are deleted by a later run, after the time that
running readers are given.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loomlog.session import files_below, remove_folder

_LOG = "_merges"
_STAGED = "_staged"
_MERGED = "merged-"
TARGET_BYTES = 128 << 20


@dataclass
class State:
    version: int = 0
    committed: list[str] = field(default_factory=list)
    retired: dict[str, float] = field(default_factory=dict)  # tenant folder/day folder/file: since when

    def visible(self) -> Column | None:
        """What a reader may take, or None for all."""
        if not self.version:
            return None
        name = F.col("_metadata.file_name")
        merged = F.substring(name, len(_MERGED) + 1, 32)
        seen = ~F.startswith(name, F.lit(_MERGED)) | (merged.isin(self.committed) if self.committed else F.lit(False))
        if self.retired:
            place = F.array_join(F.slice(F.split(F.col("_metadata.file_path"), "/"), -3, 3), "/")
            seen &= ~place.isin(list(self.retired))
        return seen


class MergeLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self):
        self._Path = self.spark._jvm.org.apache.hadoop.fs.Path
        return self._Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        files = self._fs()
        folder = self._Path(f"{self.path}/{_LOG}")
        names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
        return sorted(int(n[1:].split(".")[0]) for n in names if n.startswith("v"))

    def last(self) -> State:
        versions = self._versions()
        if not versions:
            return State()
        files = self._fs()
        stream = files.open(self._Path(f"{self.path}/{_LOG}/v{versions[-1]}.json"))
        try:
            text = bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()
        return State(versions[-1], **json.loads(text))

    def put(self, state: State) -> None:
        """The next version, by one rename; the one before it stays for readers that are about to open it."""
        files, number = self._fs(), state.version + 1
        aside = self._Path(f"{self.path}/{_LOG}/.{uuid.uuid4().hex}")
        out = files.create(aside)
        out.write(json.dumps({"committed": state.committed, "retired": state.retired}).encode())
        out.close()
        if not files.rename(aside, self._Path(f"{self.path}/{_LOG}/v{number}.json")):
            raise RuntimeError(f"version {number} of the merges is there already: a table has one writer")
        for old in [v for v in self._versions() if v < number - 1]:
            files.delete(self._Path(f"{self.path}/{_LOG}/v{old}.json"), False)


def _small_files(store, least: int, most_days: int, target: int) -> dict[str, list]:
    """(tenant folder/day folder) to the small files in it, of days with at least ``least`` of them."""
    by_day: dict[str, list[str]] = {}
    hidden = store.merges.last()
    for file in store.files():
        place = "/".join(file.rsplit("/", 3)[1:])
        name = place.rsplit("/", 1)[1]
        if place in hidden.retired or (name.startswith(_MERGED) and name[len(_MERGED) :][:32] not in hidden.committed):
            continue
        by_day.setdefault(file.rsplit("/", 1)[0], []).append(file)
    uri, found = store.spark._jvm.java.net.URI, {}
    files = store.merges._fs()
    for day, names in by_day.items():
        if len(names) < least or len(found) == most_days:
            continue
        sizes = {s.getPath().getName(): s.getLen() for s in files.listStatus(store.merges._Path(uri(day)))}
        small = [n for n in names if sizes.get(n.rsplit("/", 1)[1], target) < target // 2]
        if len(small) >= least:
            found[day] = small
    return found


def compact(store, least: int = 8, most_days: int = 1_000, target: int = TARGET_BYTES, grace_s: float = 3600) -> int:
    """Merge the small files of tenant-days that have at least ``least`` of them, at most ``most_days`` days a run,
    and return how many files were replaced.

    Appends may go on meanwhile: only files of one listing are replaced. A run that stops
    half way leaves files that no reader takes and the next run deletes. Files that were
    replaced over ``grace_s`` seconds ago are deleted first. Merges and retention run one at a time.
    """
    if not store.exists():
        return 0
    vacuum(store, grace_s)
    small = _small_files(store, least, most_days, target)
    if not small:
        return 0
    spark, log = store.spark, store.merges
    files, Path, uri = log._fs(), log._Path, spark._jvm.java.net.URI
    merge, state = uuid.uuid4().hex, log.last()
    if not state.version:
        log.put(state)  # from here on readers leave out what is not committed
        state = log.last()
    sources = [f for names in small.values() for f in names]
    read, written = Observation(), Observation()
    rows = store.open(spark, [*map(unquote, sources)], None).observe(read, F.count(F.lit(1)).alias("n"))
    staged = f"{store.path}/{_STAGED}/{merge}"
    (
        rows.hint("rebalance", "tenant", "day").sortWithinPartitions("tenant", "day", "timestamp")
        .observe(written, F.count(F.lit(1)).alias("n"))
        .write.partitionBy("tenant", "day").parquet(staged)
    )
    if read.get["n"] != written.get["n"]:
        raise RuntimeError("a merge must not change the number of rows; nothing was replaced")
    moved = spark.read.schema(rows.schema).option("basePath", staged).parquet(staged).inputFiles()
    folders = {tuple(d.rsplit("/", 2)[1:]): d for d in small}
    for i, file in enumerate(moved):
        tenant, day, _ = file.rsplit("/", 3)[1:]
        into = Path(uri(folders[tenant, day]))
        if not files.rename(Path(uri(file)), Path(into, f"{_MERGED}{merge}-{i:05d}.parquet")):
            raise RuntimeError(f"{file} could not be moved; nothing was replaced")
    now = time.time()
    state.committed.append(merge)
    state.retired |= {"/".join(f.rsplit("/", 3)[1:]): now for f in sources}
    log.put(state)
    remove_folder(spark, staged)
    return len(sources)


def vacuum(store, grace_s: float = 3600) -> int:
    """Delete files that were replaced over ``grace_s`` seconds ago or that a broken merge left; how many."""
    state = store.merges.last()
    if not state.version:
        return 0
    now, gone = time.time(), []
    for file in store.files():
        place = "/".join(file.rsplit("/", 3)[1:])
        name = place.rsplit("/", 1)[1]
        broken = name.startswith(_MERGED) and name[len(_MERGED) :][:32] not in state.committed
        if broken or (place in state.retired and now - state.retired[place] >= grace_s):
            gone.append(file)
    store.drop_files(gone)
    left = {p: t for p, t in state.retired.items() if now - t < grace_s}
    if left != state.retired:
        state.retired = left
        store.merges.put(state)
    remove_folder(store.spark, f"{store.path}/{_STAGED}")
    return len(gone)


def file_counts(store) -> DataFrame:
    """(tenant, day, files): how many files a reader of each tenant-day takes."""
    rows = store.read().select("tenant", "day", F.col("_metadata.file_name").alias("file")).distinct()
    return rows.groupBy("tenant", "day").agg(F.count("*").alias("files"))
