"""The given tables seen as logs, raw lines, payloads, polls. sql.py has the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlog.functions.ids import canonical_json, day_of, doc_id
from loomlog.session import pin_utc
from loomlog.sources.raw import split_bodies
from loomlog.sources.rules import load_rules

RULES_JSON = """[
  {"name": "error-burst", "threshold": 5, "window_s": 21600, "cooldown_s": 86400, "level": "ERROR"},
  {"name": "svc1-any", "threshold": 4, "window_s": 86400, "cooldown_s": 43200, "service": "svc1"},
  {"name": "any-burst", "threshold": 20, "window_s": 21600, "cooldown_s": 3600}
]"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    pin_utc(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


FILES_PER_BATCH = 100


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as a file stream, whether it is one file or a directory of parts."""
    pin_utc(spark)
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_BATCH)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jpath).isDirectory():
        return stream.parquet(path)
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def as_logs(events: DataFrame) -> DataFrame:
    level = (
        F.when(F.col("event_type") == "error", "ERROR")
        .when(F.col("event_type") == "signup", "WARNING")
        .when(F.col("event_type") == "click", "DEBUG")
        .otherwise("INFO")
    )
    tenant = F.element_at(
        F.array(F.lit("t0"), F.lit("t1"), F.lit("t0-eu"), F.lit("default")), (F.col("user_id") % 4 + 1).cast("int")
    )
    text = F.concat(
        "event_type",
        F.lit(" by user "),
        F.col("user_id").cast("string"),
        F.lit(" k "),
        F.get_json_object("props", "$.k"),
    )
    return events.select(
        "event_id",
        "user_id",
        F.col("ts").cast("timestamp").alias("timestamp"),
        level.alias("level"),
        F.concat(F.lit("svc"), (F.col("event_id") % 12).cast("string")).alias("service"),
        text.alias("message"),
        canonical_json(F.col("props")).alias("attrs"),
        tenant.alias("tenant"),
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_logs(table(spark, sf_dir, "events"))


def with_ids(df: DataFrame) -> DataFrame:
    return df.withColumns({"doc_id": doc_id(), "day": day_of(F.col("timestamp"))})


def twice_every_seventh(df: DataFrame) -> DataFrame:
    """Redelivery: each seventh event comes a second time."""
    times = F.when(F.col("event_id") % 7 == 0, 2).otherwise(1)
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1), times))).drop("_copy")


def redelivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return twice_every_seventh(logs(spark, sf_dir))


def _case(n: int, *values: Column) -> Column:
    out = F.when(F.col("event_id") % n == 0, values[0])
    for i, value in enumerate(values[1:], 1):
        out = out.when(F.col("event_id") % n == i, value)
    return out


def as_raw_lines(logs: DataFrame) -> DataFrame:
    """(event_id, tenant, timestamp, value): JSON, plain, broken and blank lines in turn."""
    word = F.upper(F.substring_index("message", " ", 1))
    line = _case(
        6,
        F.concat(
            F.lit('{"message":"'), "message", F.lit('","level":" warn ","service":"'), "service",
            F.lit('","attrs":'), "attrs", F.lit(',"extra":1}'),
        ),
        F.concat(F.lit("2024-01-01 "), word, F.lit(" "), "message"),
        F.concat(F.lit("  <<half {a line [of "), F.col("event_id").cast("string"), F.lit("  ")),
        F.concat(F.lit('{"level":"ERROR","note":"'), "message", F.lit('"}')),
        F.concat(F.lit('{"message":"'), "message", F.lit('","level":"verbose"}')),
        F.lit("   "),
    )
    return logs.select("event_id", "tenant", "timestamp", line.alias("value"))


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_raw_lines(logs(spark, sf_dir))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, tenant, timestamp, payload): single events, lists, and every kind of reject."""
    eid = F.col("event_id").cast("string")
    iso = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    payload = _case(
        8,
        F.concat(
            F.lit('{"timestamp":"'), iso, F.lit('","level":"warn","service":"'), "service", F.lit('","message":"'),
            "message", F.lit('","attrs":'), "attrs", F.lit(',"tenant":"forged","extra":1}'),
        ),
        F.concat(F.lit('[{"message":"a '), eid, F.lit('"},{"message":"b","level":"fatal","service":"s2"}]')),
        F.lit('{"message":""}'),
        F.concat(F.lit('[{"message":5},{"message":"ok '), eid, F.lit('","timestamp":1704067200}]')),
        F.concat(F.lit("{oops "), eid),
        F.lit('{"attrs":[1],"message":"x"}'),
        F.lit('{"message":"y","service":null}'),
        F.concat(F.lit('{"message":"z","timestamp":'), (F.lit(1704067200000) + F.col("event_id")).cast("string"), F.lit("}")),
    )
    return logs(spark, sf_dir).select("event_id", "tenant", "timestamp", payload.alias("payload"))


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, service, tenant, message): the lines of the documents."""
    docs = table(spark, sf_dir, "documents")
    lines = split_bodies(docs, "text", keep=("doc_id", "source", "lang"))
    return lines.select(
        "doc_id", "pos", F.col("source").alias("service"), F.col("lang").alias("tenant"), F.col("value").alias("message")
    )


def rules(spark: SparkSession) -> DataFrame:
    return load_rules(spark, RULES_JSON)


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tenant, t, total): the running total per tenant at each day's end, in epoch seconds.
    Counted per day first, so the running sum sees one row per tenant-day."""
    daily = with_days(logs(spark, sf_dir)).groupBy("tenant", "day").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("tenant").orderBy("day")
    return daily.select(
        "tenant",
        ((F.unix_date("day") + 1) * 86400).cast("double").alias("t"),
        F.sum("n").over(upto).alias("total"),
    )


def with_days(df: DataFrame) -> DataFrame:
    return df.withColumn("day", day_of(F.col("timestamp")))


def credentials_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, raw): one credential text per user; each fifth user's names no key."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    uid = F.col("user_id").cast("string")
    team = F.concat(F.lit("team-"), (F.col("user_id") % 4).cast("string"))
    tenant = F.when(F.col("user_id") % 7 == 0, F.lit("Bad*")).otherwise(team)
    key = F.when(F.col("user_id") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit(" k"), uid))
    return users.select("user_id", F.concat(key, F.lit(": "), tenant, F.lit(" ,stray,:nokey,noname:")).alias("raw"))
