"""Fixed schemas. ``attrs`` is carried as canonical JSON text; VARIANT is only a view on it."""

from pyspark.sql import types as T

# The five levels and the spellings folded onto them.
LEVELS = ["DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"]
LEVEL_ALIASES = {"WARN": "WARNING", "FATAL": "CRITICAL", "ERR": "ERROR"}

DEFAULT_LEVEL = "INFO"
DEFAULT_SERVICE = "unknown"
DEFAULT_TENANT = "default"
DEFAULT_COOLDOWN_S = 300.0
MAX_BODY_BYTES = 4 * 1024 * 1024

LOG_COLUMNS = ["timestamp", "level", "service", "message", "attrs", "tenant"]

LOG_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("level", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("attrs", T.StringType()),
        T.StructField("tenant", T.StringType()),
    ]
)

STORE_SCHEMA = T.StructType(
    LOG_SCHEMA.fields[:5]
    + [
        T.StructField("doc_id", T.StringType()),
        T.StructField("tenant", T.StringType()),
        T.StructField("day", T.DateType()),
    ]
)

RULE_SCHEMA = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("threshold", T.IntegerType()),
        T.StructField("window_s", T.DoubleType()),
        T.StructField("cooldown_s", T.DoubleType()),
        T.StructField("level", T.StringType()),
        T.StructField("service", T.StringType()),
    ]
)

ALERT_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("tenant", T.StringType()),
        T.StructField("rule", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("count", T.IntegerType()),
        T.StructField("window_s", T.DoubleType()),
        T.StructField("message", T.StringType()),
    ]
)
