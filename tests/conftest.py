import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from loomlog.session import local_session, pin_utc  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    return local_session(8, "tests", **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})


@pytest.fixture(autouse=True)
def utc(spark):
    pin_utc(spark)


@pytest.fixture
def logs(spark):
    """Builds log rows from (second, level, service, message, tenant) tuples."""
    from pyspark.sql import functions as F

    def build(rows):
        df = spark.createDataFrame(rows, "s double, level string, service string, message string, tenant string")
        return df.select(
            F.timestamp_micros(F.round(F.col("s") * 1_000_000).cast("long")).alias("timestamp"),
            "level",
            "service",
            "message",
            F.lit("{}").alias("attrs"),
            "tenant",
        )

    return build
