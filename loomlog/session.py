"""Session helpers: zone pinning, the shared folder, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, name: str = "loomlog", **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    settings = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.host": "127.0.0.1",
        "spark.driver.bindAddress": "127.0.0.1",
        "spark.driver.memory": "12g",
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.session.timeZone": "UTC",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def pin_utc(spark: SparkSession) -> None:
    """All instants are UTC; call before building a plan with TIMESTAMP expressions."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in spark.checkpoint.dir."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="loomlog-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder, so a lost executor never restarts the whole chain."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Hint a broadcast only after counting; a larger side is left to Spark's own choice."""
    if len(df.select(F.lit(1)).take(max_rows + 1)) <= max_rows:
        return F.broadcast(df)
    return df


def path_exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def folders(spark: SparkSession, path: str, pattern: str) -> list[str]:
    """Names of the first level below ``path`` of what matches ``pattern`` there."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    depth = pattern.count("/")
    out = []
    for status in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, pattern)) or []:
        found = status.getPath()
        for _ in range(depth):
            found = found.getParent()
        out.append(found.getName())
    return out


def remove_folder(spark: SparkSession, path: str, recursive: bool = True) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, recursive)


def files_below(spark: SparkSession, path: str, suffix: str = "") -> list[str]:
    """Names of the files in a folder, or none if there is no such folder."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    names = [s.getPath().getName() for s in files.listStatus(root)]
    return [n for n in names if n.endswith(suffix) and n[0] not in "._"]


def set_order(spark: SparkSession, path: str, names: list[str], after: int = 0) -> None:
    """Date files a second apart in the given order, as a file stream takes the oldest first."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for i, name in enumerate(names, after):
        files.setTimes(spark._jvm.org.apache.hadoop.fs.Path(root, name), 1_600_000_000_000 + 1000 * i, -1)
