import json

import pytest
from pyspark.sql import functions as F

from loomlog.functions.events import encode_event
from loomlog.functions.text import detect_level, general_number, normalize_level
from loomlog.functions.times import parse_ts, parse_ts_or_epoch
from loomlog.sources.raw import parse_lines, split_bodies
from loomlog.sources.structured import check_payloads, structured

NOW = 1_700_000_000_000_000


def parse(spark, line, service="unknown", tenant=None):
    df = spark.createDataFrame([(line,)], "value string")
    now = F.timestamp_micros(F.lit(NOW))
    rows = parse_lines(df, service=service, ingest_time=now, tenant=tenant).withColumn("us", F.unix_micros("timestamp"))
    return rows.first()


@pytest.mark.parametrize(
    "line, service, level, message, attrs",
    [
        ('{"service":"cart","level":"warn","message":"basket near its limit","attrs":{"n":9}}', "cart", "WARNING", "basket near its limit", '{"n":9}'),
        ("2025-02-11 ERROR printer out of ink", "svc", "ERROR", "2025-02-11 ERROR printer out of ink", "{}"),
        ("<<half {a line [of", "svc", "INFO", "<<half {a line [of", "{}"),
        ('{"message":"m","level":"verbose"}', "svc", "INFO", "m", "{}"),
        ('{"message":"m","level":" fatal\\t"}', "svc", "CRITICAL", "m", "{}"),
        ("  err 　", "svc", "ERROR", "err", "{}"),
        ("two errors, no keyword", "svc", "INFO", "two errors, no keyword", "{}"),
        ("first warn then ERROR", "svc", "WARNING", "first warn then ERROR", "{}"),
        ("xéERROR is no word, err_1 neither", "svc", "INFO", "xéERROR is no word, err_1 neither", "{}"),
        ('{"message":"m","unknown":[1],"attrs":{"b":1.0,"a":{"d":1,"c":null}}}', "svc", "INFO", "m", '{"a":{"c":null,"d":1},"b":1}'),
    ],
)
def test_lines(spark, line, service, level, message, attrs):
    row = parse(spark, line, "svc")
    assert (row.service, row.level, row.message, row.attrs, row.us) == (service, level, message, attrs, NOW)


@pytest.mark.parametrize(
    "line",
    [
        '{"message":5}',
        '{"message":""}',
        '{"level":"ERROR"}',
        '{"message":"m","service":null}',
        '{"message":"m","level":3}',
        '{"message":"m","timestamp":"x"}',
        '{"message":"m","timestamp":null}',
        '{"message":"m","attrs":[1]}',
        '{"message":"m","attrs":null}',
        '[{"message":"m"}]',
        '"message"',
        '{"message":"a","message":"b"}',
    ],
)
def test_json_that_is_no_event_stays_text(spark, line):
    row = parse(spark, line)
    assert (row.message, row.service, row.us) == (line, "unknown", NOW)


@pytest.mark.parametrize(
    "value, us",
    [
        ('"2024-01-01T00:00:00.123456Z"', 1704067200123456),
        ('"2024-01-01T00:00:00+05:30"', 1704067200000000 - 19800 * 10**6),
        ('"2024-01-01 10:11"', 1704067200000000 + 36660 * 10**6),
        ("1704067200", 1704067200000000),
        ("1704067200.25", 1704067200250000),
        ("1704067200123", 1704067200123000),
        ('"1704067200"', 1704067200000000),
    ],
)
def test_own_timestamp_of_a_json_line(spark, value, us):
    assert parse(spark, f'{{"message":"m","timestamp":{value}}}').us == us


def test_tenant_of_a_line_is_overruled(spark):
    line = '{"message":"m","tenant":"forged"}'
    assert parse(spark, line).tenant == "forged"
    assert parse(spark, line, tenant=F.lit("acme")).tenant == "acme"


def test_parse_ts_rejects_what_only_looks_like_time(spark):
    texts = ["12:30", "2024", "2024-13-01", "garbage", "1704067200"]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    assert [r.t for r in df.select(parse_ts(F.col("x")).alias("t")).collect()] == [None] * 5
    assert df.where(parse_ts_or_epoch(F.col("x")).isNotNull()).count() == 2  # both bare numbers


def test_bodies_split_like_lines(spark):
    body = "a\r\n\r\n  \nb\x0bc\x1dd\x85e f"
    df = spark.createDataFrame([(1, body)], "id int, body string")
    rows = split_bodies(df, "body", keep=("id",)).orderBy("pos").collect()
    assert [r.value for r in rows] == list("abcdef")


def test_levels(spark):
    df = spark.createDataFrame([("Warn",), ("",), (None,), ("error ",), ("nope",)], "x string")
    got = [r.y for r in df.select(normalize_level(F.col("x")).alias("y")).collect()]
    assert got == ["WARNING", "INFO", "INFO", "ERROR", "INFO"]
    assert spark.range(1).select(detect_level(F.lit("a CRITICAL b"))).first()[0] == "CRITICAL"


def payload(spark, text):
    df = spark.createDataFrame([(text,)], "payload string")
    return check_payloads(df, ingest_time=F.timestamp_micros(F.lit(NOW))).collect()


def test_structured_is_strict_per_event(spark):
    rows = payload(spark, '[{"message":""},{"message":5},7,{"message":"m","tenant":3}]')
    assert [r.reason for r in rows] == [None, "message", "not_an_object", "tenant"]
    assert rows[0].message == "" and rows[1].message is None and rows[1].raw == '{"message":5}'
    assert payload(spark, "[]") == []
    assert [r.reason for r in payload(spark, "{oops")] == ["not_json"]
    assert [r.reason for r in payload(spark, "null")] == ["not_an_object"]


def test_structured_splits(spark):
    df = spark.createDataFrame([('{"message":"m"}',), ("x",)], "payload string")
    accepted, rejected = structured(df)
    assert [r.message for r in accepted.collect()] == ["m"]
    assert [(r.raw, r.reason) for r in rejected.collect()] == [("x", "not_json")]


def test_encode_keeps_microseconds_nulls_and_nesting(spark):
    df = spark.createDataFrame([("m", '{"b":{"c":1}}')], "message string, attrs string").select(
        F.timestamp_micros(F.lit(NOW + 1)).alias("timestamp"), F.lit(None).cast("string").alias("level"),
        F.lit("s").alias("service"), "message", "attrs", F.lit("t").alias("tenant"),
    )
    assert json.loads(df.select(encode_event()).first()[0]) == {
        "timestamp": "2023-11-14T22:13:20.000001Z", "level": None, "service": "s", "message": "m",
        "attrs": {"b": {"c": 1}}, "tenant": "t",
    }


@pytest.mark.parametrize("x", [10.0, 0.5, 21600.0, 12.25, 123456.0, 1234567.0, 1e6, 1 / 3, 99999.96, 0.00012, 1e9, 2.5e-7])
def test_general_number_is_percent_g(spark, x):
    assert spark.range(1).select(general_number(F.lit(x))).first()[0] == f"{x:g}"
