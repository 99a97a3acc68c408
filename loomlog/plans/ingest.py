"""From requests to events: size check, credential, parsing, tenant stamp."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.operators.tenancy import resolve, stamp_tenant
from loomlog.schema import DEFAULT_SERVICE, LOG_COLUMNS, MAX_BODY_BYTES
from loomlog.sources.raw import parse_lines, split_bodies
from loomlog.sources.structured import fits, structured

REJECT_COLUMNS = ["raw", "reason"]


def _admit(
    requests: DataFrame, credentials: DataFrame | None, body: str, max_bytes: int
) -> tuple[DataFrame, DataFrame]:
    checked = resolve(requests, credentials).withColumn(
        "reason", F.when(~fits(F.col(body), max_bytes), "too_large").otherwise(F.col("reason"))
    )
    refused = checked.where("reason is not null").select(F.col(body).alias("raw"), "reason")
    return checked.where("reason is null").drop("reason").withColumnRenamed("tenant", "_owner"), refused


def ingest_structured(
    requests: DataFrame,
    credentials: DataFrame | None = None,
    body: str = "body",
    ingest_time: Column | None = None,
    max_bytes: int = MAX_BODY_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) from JSON requests (api_key, body). Works on streams as on tables."""
    admitted, refused = _admit(requests, credentials, body, max_bytes)
    events, malformed = structured(admitted, body, ingest_time, keep=("_owner",))
    stamped = stamp_tenant(events, F.col("_owner")).select(*LOG_COLUMNS)
    return stamped, refused.unionByName(malformed.select(*REJECT_COLUMNS))


def ingest_raw(
    requests: DataFrame,
    credentials: DataFrame | None = None,
    body: str = "body",
    service: str | Column = DEFAULT_SERVICE,
    ingest_time: Column | None = None,
    max_bytes: int = MAX_BODY_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) from text requests: every non-blank line becomes an event."""
    admitted, refused = _admit(requests, credentials, body, max_bytes)
    lines = split_bodies(
        admitted.withColumns(
            {
                "_line_service": F.lit(service) if isinstance(service, str) else service,
                "_line_time": F.current_timestamp() if ingest_time is None else ingest_time,
            }
        ),
        body,
        keep=("_owner", "_line_service", "_line_time"),
    )
    events = parse_lines(
        lines, service=F.col("_line_service"), ingest_time=F.col("_line_time"), tenant=F.col("_owner")
    )
    return events, refused


def counted(events: DataFrame, name: str = "ingest", ok: Column | None = None) -> DataFrame:
    """The same rows, with accepted and rejected counts reported as they pass."""
    good = F.lit(True) if ok is None else ok
    return events.observe(
        name, F.count_if(good).alias("accepted"), F.count_if(~good).alias("rejected")
    )
