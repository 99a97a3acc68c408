"""Every registered query: a Spark plan and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.functions import ids as ids_
from loomlog.functions.events import attr, encode_event
from loomlog.functions.text import detect_level, normalize_level
from loomlog.functions.times import parse_ts
from loomlog.operators import alerts as alerts_
from loomlog.operators import metrics, retention, search, stats, tenancy
from loomlog.plans import find, ingest, merges
from loomlog.plans.archive import Archive, expire_days, restore
from loomlog.plans.store import LogStore, dedupe, only_new, upsert
from loomlog.session import files_below, new_folder, set_order
from loomlog.sources import credentials, generate, raw
from loomlog.sources import rules as rules_
from loomlog.sources import structured as structured_
from loomlog.streaming import alerts as stream_alerts_
from loomlog.streaming import index as stream_index_
from loomlog.streaming import retention as stream_retention
from loomlog.streaming import sinks
from loomlog.streaming import sources as stream_sources
from loomlog.streaming import stats as stream_stats_
from workload import tables as t
from workload.sql import DOC_ID, draw, first_keyword, framed, level_of, pick, sql, strip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

AS_OF = datetime(2024, 1, 31, 12, tzinfo=timezone.utc)
KEEP_DAYS = 7
AS_OF_US = 1706702400000000
CUTOFF_US = AS_OF_US - KEEP_DAYS * 86_400_000_000
JAN_20 = 1705708800000000
JAN_22 = 1705881600000000
FAR = "2100-01-01 00:00:00"



def us_col():
    return F.unix_micros("timestamp").alias("us")


def day_col():
    return F.date_format("day", "yyyy-MM-dd").alias("day")


def event_cols():
    return [us_col(), "level", "service", "message", "attrs", "tenant"]


EVENT_SQL = "us, level, service, message, attrs, tenant"


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


# --- scans -----------------------------------------------------------------------------


@query(
    "scan_structured",
    sql(
        f"""select event_id,
              case json_type(j, '$.timestamp')
                when 'VARCHAR' then epoch_us(cast(json_extract_string(j, '$.timestamp') as timestamp))
                when 'UBIGINT' then case when cast(json_extract(j, '$.timestamp') as bigint) > 20000000000
                                         then cast(json_extract(j, '$.timestamp') as bigint) * 1000
                                         else cast(json_extract(j, '$.timestamp') as bigint) * 1000000 end
                else us end as us,
              {level_of("coalesce(json_extract_string(j, '$.level'), '')")} as level,
              coalesce(json_extract_string(j, '$.service'), 'unknown') as service,
              json_extract_string(j, '$.message') as message,
              coalesce(cast(json_extract(j, '$.attrs') as varchar), '{{}}') as attrs,
              tenant
            from checked where reason is null"""
    ),
)
def scan_structured(spark, sf):
    accepted, _ = structured_.structured(
        t.payloads(spark, sf).withColumnRenamed("tenant", "owner"), ingest_time=F.col("timestamp"), keep=("event_id", "owner")
    )
    return tenancy.stamp_tenant(accepted, F.col("owner")).select("event_id", *event_cols())


@query(
    "scan_raw_lines",
    sql(
        f"""select doc_id, pos, {level_of(first_keyword(strip('message')))} as level, service,
                   {strip('message')} as message, '{{}}' as attrs, tenant from doc_lines"""
    ),
)
def scan_raw_lines(spark, sf):
    lines = t.doc_lines(spark, sf)
    parsed = raw.parse_lines(
        lines, "message", F.col("service"), F.timestamp_micros(F.lit(0)), F.col("tenant"), keep=("doc_id", "pos")
    )
    return parsed.select("doc_id", "pos", "level", "service", "message", "attrs", "tenant")


LINES_SQL = f"""select event_id, us,
    case when ok then {level_of("coalesce(json_extract_string(j, '$.level'), '')")}
         else {level_of(first_keyword('text'))} end as level,
    case when ok then coalesce(json_extract_string(j, '$.service'), 'legacy') else 'legacy' end as service,
    case when ok then json_extract_string(j, '$.message') else text end as message,
    case when ok then coalesce(cast(json_extract(j, '$.attrs') as varchar), '{{}}') else '{{}}' end as attrs,
    tenant from json_lines"""


@query("parse_line", sql(LINES_SQL))
def parse_line(spark, sf):
    lines = t.raw_lines(spark, sf)
    parsed = raw.parse_lines(
        lines, service="legacy", ingest_time=F.col("timestamp"), tenant=F.col("tenant"), keep=("event_id",)
    )
    return parsed.select("event_id", *event_cols())


@query("parse_json_line", sql("select event_id, ok as is_json from json_lines"))
def parse_json_line(spark, sf):
    # a line was taken as JSON exactly if its whole text is not the message
    lines = t.raw_lines(spark, sf).withColumn("whole", F.btrim("value"))
    parsed = raw.parse_lines(lines, ingest_time=F.col("timestamp"), keep=("event_id", "whole"))
    return parsed.select("event_id", (F.col("message") != F.col("whole")).alias("is_json"))


def _text_folder(spark, df, label):
    folder = new_folder(spark, label)
    df.write.text(folder)
    return folder


@query("stream_source", sql(f"select {EVENT_SQL} from logs"))
def stream_source(spark, sf):
    wire, out = new_folder(spark, "wire"), new_folder(spark, "stream-source")
    sinks.publish(t.logs(spark, sf), wire)
    stream = stream_sources.event_files(spark, wire, max_files=4)
    stream.writeStream.format("parquet").option("checkpointLocation", f"{out}/offsets").trigger(
        availableNow=True
    ).start(f"{out}/rows").awaitTermination()
    return spark.read.parquet(f"{out}/rows").select(*event_cols())


@query(
    "tail_dir",
    sql(f"select level, service, message, attrs, tenant from ({LINES_SQL.replace('legacy', 'shipper').replace('tenant from', chr(39) + 'default' + chr(39) + ' as tenant from')})"),
)
def tail_dir(spark, sf):
    folder = _text_folder(spark, t.raw_lines(spark, sf).select("value"), "lines")
    out = new_folder(spark, "tail")
    stream_sources.tail(spark, folder, max_files=4).writeStream.format("parquet").option(
        "checkpointLocation", f"{out}/offsets"
    ).trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("level", "service", "message", "attrs", "tenant")


def _grown(spark, whole, live, share):
    """Bring the files below ``live`` to a share of those below ``whole``, mostly in the middle of a line."""
    paths = spark.read.format("binaryFile").load(whole).select("path")

    def copy(batches):
        import pandas as pd
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(live) if "://" in live or live.startswith("file:") else (fs.LocalFileSystem(), live)
        files.create_dir(root)
        for batch in batches:
            for path in batch["path"]:
                source, name = fs.FileSystem.from_uri(path)
                with source.open_input_file(name) as f, files.open_output_stream(f"{root}/{name.rsplit('/', 1)[1]}") as out:
                    left = int(f.size() * share)
                    while left and (data := f.read(min(left, 1 << 20))):
                        out.write(data)
                        left -= len(data)
            yield pd.DataFrame({"n": [len(batch)]})

    paths.mapInPandas(copy, "n long").agg(F.sum("n")).collect()


@query(
    "tail_growing",
    sql(f"select level, service, message, attrs, tenant from ({LINES_SQL.replace('legacy', 'shipper').replace('tenant from', chr(39) + 'default' + chr(39) + ' as tenant from')})"),
)
def tail_growing(spark, sf):
    # two batches and a restart: the files are cut at four tenths of their bytes, then at nine, then whole
    whole, live, out = _text_folder(spark, t.raw_lines(spark, sf).select("value"), "whole"), new_folder(spark, "live"), new_folder(spark, "follow")
    for share in (0.4, 0.9, 1):
        _grown(spark, whole, live, share)
        stream_sources.follow(spark, live).writeStream.format("parquet").option("checkpointLocation", f"{out}/offsets").trigger(
            availableNow=True
        ).start(f"{out}/rows").awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("level", "service", "message", "attrs", "tenant")


@query(
    "load_rules",
    sql(
        """select user_id, 'u' || user_id || '-any' as name, cast(n as integer) as threshold,
                  cast(60 * (user_id % 5 + 1) as double) as window_s, 300.0::double as cooldown_s,
                  cast(null as varchar) as level, cast(null as varchar) as service
           from (select user_id, count(*) as n from events group by 1) where user_id % 10 <> 0
           union all
           select user_id, 'u' || user_id || '-err', 2, 10.5::double, 30.0::double, 'ERROR', 'svc' || (user_id % 12)
           from (select distinct user_id from events) where user_id % 10 <> 0"""
    ),
)
def load_rules(spark, sf):
    # one rule document per user, sized by the user's events; each tenth user's is blank
    uid = F.col("user_id").cast("string")
    document = F.concat(
        F.lit('[{"name":"u'), uid, F.lit('-any","threshold":'), F.col("n").cast("string"), F.lit(',"window_s":'),
        ((F.col("user_id") % 5 + 1) * 60).cast("string"), F.lit('},{"name":"u'), uid,
        F.lit('-err","threshold":"2","window_s":10.5,"cooldown_s":30,"level":"ERROR","service":"svc'),
        (F.col("user_id") % 12).cast("string"), F.lit('"}]'),
    )
    documents = (
        t.table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"))
        .select("user_id", F.when(F.col("user_id") % 10 == 0, F.lit("  ")).otherwise(document).alias("raw"))
    )
    return rules_.parse_rules(documents, keep=("user_id",))


@query(
    "credential_table",
    sql(
        """select api_key, arg_max(team, c_custkey) as tenant from (
             select c_custkey, 'k' || (c_custkey % 500) as api_key, 'n' || c_nationkey || ':x' as team from customer
             union all select c_custkey, 'c' || c_custkey, lower(c_mktsegment) from customer) group by 1"""
    ),
)
def credential_table(spark, sf):
    key = F.col("c_custkey").cast("string")
    texts = t.table(spark, sf, "customer").select(
        "c_custkey",
        F.concat(
            F.lit(" k"), (F.col("c_custkey") % 500).cast("string"), F.lit(" : n"), F.col("c_nationkey").cast("string"),
            F.lit(":x , stray, :nokey, noname: ,c"), key, F.lit(":"), F.lower("c_mktsegment"),
        ).alias("raw"),
    )
    return credentials.credential_table(texts, order=("c_custkey",))


_WORDS_SQL = ", ".join(pick(3 + i, generate.WORDS) for i in range(generate.MAX_WORDS))


@query(
    "gen_events",
    sql(
        f"""select event_id, {pick(0, generate.SERVICES)} as service, {pick(1, generate.EVENT_LEVELS)} as level,
                   array_to_string(list_slice([{_WORDS_SQL}], 1, {draw(2, 6)} + 4), ' ') as message,
                   '{{"req_id":' || {draw(12, 10**9, 12)} || '}}' as attrs from digests"""
    ),
)
def gen_events(spark, sf):
    return generate.gen_events(t.table(spark, sf, "events").select("event_id"), "event_id")


@query(
    "gen_lines",
    sql(
        f"""select event_id, strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S') || ' ' || {pick(0, generate.LINE_LEVELS)}
                   || ' ' || {pick(1, generate.LINE_MESSAGES)} as value from digests"""
    ),
)
def gen_lines(spark, sf):
    return generate.gen_lines(t.logs(spark, sf).select("event_id", "timestamp"), "event_id", F.col("timestamp"))


# --- columns ---------------------------------------------------------------------------

# Level spellings to try, by event: the stored one in lower case with white space around it,
# the aliases, and words that are no level.
_SPELLING = """case event_id % 7 when 0 then lower(level) when 1 then chr(9) || level || ' ' when 2 then 'warn'
    when 3 then ' Err' when 4 then 'fatal' when 5 then '' else 'verbose' end"""


@query("normalize_level", sql(f"select event_id, {level_of('raw')} as level from (select event_id, {_SPELLING} as raw from logs)"))
def normalize_level_(spark, sf):
    raw_level = F.expr(_SPELLING.replace("chr(9)", "char(9)"))
    return t.logs(spark, sf).select("event_id", normalize_level(raw_level).alias("level"))


@query("detect_level", sql(f"select event_id, {level_of(first_keyword('line'))} as level from raw_lines"))
def detect_level_(spark, sf):
    return t.raw_lines(spark, sf).select("event_id", detect_level(F.col("value")).alias("level"))


@query(
    "parse_ts",
    sql(
        """select event_id, case event_id % 7 when 0 then us when 1 then us - 19800000000 when 2 then us // 1000000 * 1000000
             when 3 then us // 86400000000 * 86400000000 when 4 then us // 1000000 * 1000000 + 10800000000 end as us from logs"""
    ),
)
def parse_ts_(spark, sf):
    form = F.expr(
        """case event_id % 7
             when 0 then date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
             when 1 then date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+05:30'")
             when 2 then date_format(timestamp, 'yyyy-MM-dd HH:mm:ss')
             when 3 then date_format(timestamp, 'yyyy-MM-dd')
             when 4 then date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss'-0300'")
             when 5 then concat('not a time ', event_id) else '12:30' end"""
    )
    return t.logs(spark, sf).select("event_id", F.unix_micros(parse_ts(form)).alias("us"))


@query("doc_id", sql("select event_id, doc_id from ids"))
def doc_id_(spark, sf):
    return t.with_ids(t.logs(spark, sf)).select("event_id", "doc_id")


@query("index_name", sql("select event_id, 'logs-' || tenant || '-' || replace(day, '-', '.') as index_name from ids"))
def index_name(spark, sf):
    rows = t.with_days(t.logs(spark, sf)).withColumn("tenant", F.nullif("tenant", F.lit("default")))
    return rows.select("event_id", ids_.index_name(F.col("tenant"), F.col("day")).alias("index_name"))


@query(
    "parse_index_name",
    sql(
        """select event_id, case event_id % 5 when 0 then 'default' else tenant end as tenant,
                  case event_id % 5 when 1 then null else day end as day from ids"""
    ),
)
def parse_index_name(spark, sf):
    full = ids_.index_name(F.col("tenant"), F.col("day"))
    short = F.concat(F.lit("logs-"), F.date_format("day", "yyyy.MM.dd"))
    broken = F.concat(F.lit("logs-"), "tenant", F.lit("-2024.13.77"))
    name = F.when(F.col("event_id") % 5 == 0, short).when(F.col("event_id") % 5 == 1, broken).otherwise(full)
    rows = t.with_days(t.logs(spark, sf)).select("event_id", name.alias("name"))
    return rows.select(
        "event_id",
        ids_.parse_index_tenant(F.col("name")).alias("tenant"),
        F.date_format(ids_.parse_index_day(F.col("name")), "yyyy-MM-dd").alias("day"),
    )


@query(
    "stamp_tenant",
    sql("select event_id, team as tenant from logs join creds on api_key = 'k' || user_id where team <> 'Bad*'"),
)
def stamp_tenant(spark, sf):
    resolved = tenancy.resolve(_requests(spark, sf).withColumn("claimed", F.lit("forged")), _credentials(spark, sf))
    stamped = tenancy.stamp_tenant(resolved.where("reason is null"), F.col("tenant"))
    return stamped.select("event_id", "tenant")


@query(
    "fill_defaults",
    sql(
        f"""select event_id, case when event_id % 2 = 0 then {JAN_20} else us end as us,
             case when event_id % 3 = 0 then 'INFO' else level end as level,
             case when event_id % 5 = 0 then 'unknown' else service end as service, message,
             case when event_id % 7 = 0 then '{{}}' else attrs end as attrs,
             case when event_id % 11 = 0 then 'default' else tenant end as tenant from logs"""
    ),
)
def fill_defaults(spark, sf):
    holes = {"timestamp": 2, "level": 3, "service": 5, "attrs": 7, "tenant": 11}
    holed = t.logs(spark, sf).withColumns(
        {c: F.when(F.col("event_id") % n != 0, F.col(c)) for c, n in holes.items()}
    )
    filled = structured_.fill_defaults(holed, F.timestamp_micros(F.lit(JAN_20)))
    return filled.select("event_id", *event_cols())


@query("alert_text", sql("""select ':rotating_light: ' || message || ' (tenant=' || tenant || ')' as text, us from alerts"""))
def alert_text(spark, sf):
    return _alerts(spark, sf).select(alerts_.notification().alias("text"), us_col())


@query(
    "display_rows",
    sql(
        """select substr(strftime(make_timestamp(us), '%Y-%m-%d %H:%M:%S.%f'), 1, 23) as time,
                  case when event_id % 11 = 0 then 'INFO' else level end as level,
                  case when event_id % 10 = 0 then '—' else service end as service, message from logs"""
    ),
)
def display_rows(spark, sf):
    rows = t.logs(spark, sf).withColumns(
        {
            "level": F.when(F.col("event_id") % 11 == 0, F.lit("TRACE")).otherwise(F.col("level")),
            "service": F.when(F.col("event_id") % 10 == 0, F.lit("")).otherwise(F.col("service")),
        }
    )
    return search.display(rows)


_ENCODED_SQL = """cast(to_json({'timestamp': strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S.%fZ'), 'level': level,
    'service': service, 'message': message, 'attrs': cast(attrs as json), 'tenant': tenant}) as varchar)"""


@query("encode_event", sql(f"select event_id, {_ENCODED_SQL} as value from logs"))
def encode_event_(spark, sf):
    return t.logs(spark, sf).select("event_id", encode_event().alias("value"))


@query("attr_get", sql("select event_id, cast(json_extract(attrs, '$.k') as bigint) as k, cast(null as varchar) as absent from logs"))
def attr_get(spark, sf):
    return t.logs(spark, sf).select(
        "event_id", attr(F.col("attrs"), "k", "bigint").alias("k"), attr(F.col("attrs"), "none").alias("absent")
    )


# --- filters and search ----------------------------------------------------------------


@query("tenant_scope", sql("select event_id, tenant from logs where tenant = 't0'"))
def tenant_scope(spark, sf):
    return t.logs(spark, sf).where(search.of_tenant("t0")).select("event_id", "tenant")


@query("filter_terms", sql("select event_id, level, service from logs where level = 'ERROR' and service = 'svc1'"))
def filter_terms(spark, sf):
    return t.logs(spark, sf).where(search.terms("ERROR", "svc1")).select("event_id", "level", "service")


_PHRASE_SQL = r"""contains(' ' || trim(regexp_replace(lower(message), '[^\p{L}\p{N}]+', ' ', 'g')), ' %s')"""


@query("search_substring", sql("select doc_id, pos, message from doc_lines where contains(lower(message), 'and the')"))
def search_substring(spark, sf):
    return t.doc_lines(spark, sf).where(search.matches("And The", mode="substring")).select("doc_id", "pos", "message")


@query("search_phrase_prefix", sql(f"select doc_id, pos, message from doc_lines where {_PHRASE_SQL % 'and the'}"))
def search_phrase_prefix(spark, sf):
    return t.doc_lines(spark, sf).where(search.matches("And, the")).select("doc_id", "pos", "message")


@query(
    "search",
    sql(f"select event_id, {EVENT_SQL} from logs where tenant = 't0' and level = 'ERROR' and service = 'svc1' and {_PHRASE_SQL % 'error by us'}"),
)
def search_(spark, sf):
    return search.search(t.logs(spark, sf), "t0", "error by us", "ERROR", "svc1").select("event_id", *event_cols())


@query("search_page", sql(f"select doc_id, {EVENT_SQL} from ids where tenant = 't0' and {_PHRASE_SQL % 'by user'} order by us desc, doc_id limit 100"))
def search_page(spark, sf):
    hits = search.search(t.with_ids(t.logs(spark, sf)), "t0", "by user")
    return search.page(hits).select("doc_id", *event_cols())


@query("latest_arrivals", sql("select event_id, us, message from logs where tenant = 't1' and contains(message, 'click') order by event_id desc limit 100"))
def latest_arrivals(spark, sf):
    hits = search.search(t.logs(spark, sf), "t1", "CLICK", mode="substring")
    return search.latest_arrivals(hits, "event_id").select("event_id", us_col(), "message")


@query("live_tail", sql("select doc_id, tenant, us, message from tail"))
def live_tail(spark, sf):
    return search.live_tail(t.with_ids(t.logs(spark, sf))).select("doc_id", "tenant", us_col(), "message")


@query(
    "new_rows",
    sql(
        """select doc_id, tenant, us from tail
           where (tenant, us, service, message) not in (select tenant, us, service, message from before)""",
        before=f"""select * from (select *, row_number() over (partition by tenant order by us desc, doc_id) as rn
                   from ids where us < {JAN_22 + 7 * 86_400_000_000}) where rn <= 200""",
    ),
)
def new_rows(spark, sf):
    rows = t.with_ids(t.logs(spark, sf))
    earlier = rows.where(F.unix_micros("timestamp") < JAN_22 + 7 * 86_400_000_000)
    fresh = search.new_rows(search.live_tail(rows), search.live_tail(earlier), ids_.row_key())
    return fresh.select("doc_id", "tenant", us_col())


@query("retention_events", sql(f"select event_id, us, tenant from logs where us >= {CUTOFF_US}"))
def retention_events(spark, sf):
    kept, _ = retention.split(t.logs(spark, sf), retention.event_kept(AS_OF, KEEP_DAYS))
    return kept.select("event_id", us_col(), "tenant")


@query("retention_days", sql(f"select tenant, day, epoch_us(cast(day as timestamp)) < {CUTOFF_US} as expired from ids group by all"))
def retention_days(spark, sf):
    days = t.with_days(t.logs(spark, sf)).select("tenant", "day").distinct()
    return days.select("tenant", day_col(), (~retention.day_kept(AS_OF, KEEP_DAYS)).alias("expired"))


@query(
    "retention_split",
    sql(f"select event_id, us >= {CUTOFF_US} as by_event, epoch_us(cast(day as timestamp)) >= {CUTOFF_US} as by_day from ids"),
)
def retention_split(spark, sf):
    rows = t.with_days(t.logs(spark, sf))
    return rows.select(
        "event_id",
        retention.event_kept(AS_OF, KEEP_DAYS).alias("by_event"),
        retention.day_kept(AS_OF, KEEP_DAYS).alias("by_day"),
    )


_NAME_FORM = """case c_custkey % 5 when 0 then lower(replace(c_name, '#', '-')) when 1 then c_name
    when 2 then repeat('a', c_custkey % 80) when 3 then 'team_' || c_custkey || chr(10) else '-team' end"""


@query("valid_tenant", sql(f"select c_custkey, regexp_matches({_NAME_FORM}, '^[a-z0-9][a-z0-9_-]{{0,63}}$') as valid from customer"))
def valid_tenant(spark, sf):
    name = F.expr(_NAME_FORM.replace("c_custkey % 80)", "cast(c_custkey % 80 as int))"))
    return t.table(spark, sf, "customer").select("c_custkey", tenancy.valid_tenant(name).alias("valid"))


@query("oversize_split", sql("select doc_id, strlen(text) as n_bytes, strlen(text) <= 4096 as accepted from documents"))
def oversize_split(spark, sf):
    docs = t.table(spark, sf, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    within, beyond = structured_.oversize_split(docs, "text", 4096)
    both = within.withColumn("accepted", F.lit(True)).unionByName(beyond.withColumn("accepted", F.lit(False)), True)
    return both.select("doc_id", "n_bytes", "accepted")


# --- lookups ---------------------------------------------------------------------------


def _requests(spark, sf):
    return t.logs(spark, sf).select("event_id", F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("api_key"))


def _credentials(spark, sf):
    return credentials.credential_table(t.credentials_text(spark, sf), order=("user_id",))


@query("match_rules", sql("select rule, tenant, us from matched"))
def match_rules(spark, sf):
    matched = alerts_.match_rules(t.logs(spark, sf), t.rules(spark))
    return matched.select("rule", "tenant", us_col())


@query(
    "rules_per_user",
    sql(
        """select rule, tenant, us from (select *, 'u' || user_id as own from logs) l join (
             select distinct 'for u' || user_id as rule, null as rlevel, 'u' || user_id as rservice from events
             union all values ('any', null, null), ('bad', 'ERROR', null)) r
           on (rlevel is null or rlevel = level) and (rservice is null or rservice = own)"""
    ),
)
def rules_per_user(spark, sf):
    """A rule for each user, one open and one for a level, through the join for more rules than are broadcast."""
    logs = t.logs(spark, sf).withColumn("service", F.concat(F.lit("u"), "user_id"))
    own = logs.select(F.concat(F.lit("for "), "service").alias("name"), F.lit(None).cast("string").alias("level"), "service").distinct()
    shared = spark.createDataFrame([("any", None, None), ("bad", "ERROR", None)], own.schema)
    rules = own.union(shared).select("name", F.lit(5).alias("threshold"), F.lit(60.0).alias("window_s"), F.lit(0.0).alias("cooldown_s"), "level", "service")
    return alerts_.match_rules(logs, rules, few=100).select("rule", "tenant", us_col())


@query("resolve_tenant", sql("select event_id, team as tenant from logs join creds on api_key = 'k' || user_id where team <> 'Bad*'"))
def resolve_tenant(spark, sf):
    resolved = tenancy.resolve(_requests(spark, sf), _credentials(spark, sf))
    return resolved.where("reason is null").select("event_id", "tenant")


@query(
    "reject_unauth",
    sql(
        """select event_id, case when team is null then 'unknown_credential' else 'invalid_tenant' end as reason
           from logs left join creds on api_key = 'k' || user_id where team is null or team = 'Bad*'"""
    ),
)
def reject_unauth(spark, sf):
    resolved = tenancy.resolve(_requests(spark, sf), _credentials(spark, sf))
    return resolved.where("reason is not null").select("event_id", "reason")


def _before_and_after(spark, sf):
    """What is stored (all before the 22nd) and what comes in (all since the 20th, some twice)."""
    us = F.unix_micros("timestamp")
    stored = t.with_ids(t.logs(spark, sf)).where(us < JAN_22).drop("event_id", "user_id")
    incoming = t.with_ids(t.redelivered(spark, sf)).where(us >= JAN_20).drop("event_id", "user_id")
    return stored, incoming


@query("index_new", sql(f"select doc_id, {EVENT_SQL} from ids where us >= {JAN_22}"))
def index_new(spark, sf):
    stored, incoming = _before_and_after(spark, sf)
    return only_new(incoming, stored).select("doc_id", *event_cols())


@query("upsert", sql(f"select doc_id, {EVENT_SQL} from ids"))
def upsert_(spark, sf):
    return upsert(*_before_and_after(spark, sf)).select("doc_id", *event_cols())


# --- aggregates ------------------------------------------------------------------------


@query("count_by_tenant", sql("select tenant, count(*) as n from logs group by 1"))
def count_by_tenant(spark, sf):
    return stats.count_by_tenant(t.logs(spark, sf))


@query("stats", sql("select tenant, dimension, key, n from stats"))
def stats_(spark, sf):
    return stats.stats(t.logs(spark, sf))


@query(
    "terms_top10",
    sql(
        """select tenant, dimension, key, n, rank from (
             select *, cast(row_number() over (partition by tenant, dimension order by n desc, key) as integer) as rank
             from stats where dimension <> 'total') where rank <= 10"""
    ),
)
def terms_top10(spark, sf):
    return stats.terms_top(t.logs(spark, sf))


@query(
    "level_distribution",
    sql(
        """select tenant, cast(position as integer) as position, level, n, round(n / total * 100, 6) as share from (
             select a.tenant, position, l.level, count(b.level) as n, any_value(total) as total
             from (select tenant, count(*) as total from logs group by 1) a
             cross join (values (0, 'DEBUG'), (1, 'INFO'), (2, 'WARNING'), (3, 'ERROR'), (4, 'CRITICAL')) l(position, level)
             left join logs b on b.tenant = a.tenant and b.level = l.level
             group by a.tenant, position, l.level)
           where n > 0 or level in ('INFO', 'WARNING', 'ERROR')"""
    ),
)
def level_distribution(spark, sf):
    return stats.level_distribution(t.logs(spark, sf))


@query(
    "top_services",
    sql(
        """select tenant, service, n, rank, round(greatest(4.0, n / max(n) over (partition by tenant) * 100), 6) as width from (
             select tenant, service, count(*) as n,
                    cast(row_number() over (partition by tenant order by count(*) desc, service) as integer) as rank
             from logs group by tenant, service) where rank <= 5"""
    ),
)
def top_services(spark, sf):
    return stats.top_services(t.logs(spark, sf))


@query(
    "latency_percentiles",
    sql(
        """select run, p, value as latency_s from (
             select event_type as run, value, row_number() over (partition by event_type order by value) - 1 as place,
                    count(*) over (partition by event_type) as n from events)
           cross join (values (0.5::double), (0.99::double)) ps(p)
           where place = least(cast(floor(n * p) as bigint), n - 1)"""
    ),
)
def latency_percentiles(spark, sf):
    samples = t.table(spark, sf, "events").select(F.col("event_type").alias("run"), F.col("value").alias("latency_s"))
    return metrics.percentiles(samples, ["run"], "latency_s", [0.5, 0.99])


@query(
    "price_percentiles",
    sql(
        """select l_returnflag, l_linestatus, p, coalesce(price, 0) as price
           from (select distinct l_returnflag from lineitem) cross join (values ('O'), ('F'), ('none')) s(l_linestatus)
           cross join (values (0.01::double), (0.5::double), (0.99::double), (1.0::double)) ps(p) left join (
             select l_returnflag, l_linestatus, p, l_extendedprice as price from (
               select l_returnflag, l_linestatus, l_extendedprice, count(*) over (partition by l_returnflag, l_linestatus) as n,
                 row_number() over (partition by l_returnflag, l_linestatus order by l_extendedprice) - 1 as place from lineitem)
             cross join (values (0.01::double), (0.5::double), (0.99::double), (1.0::double)) ps(p)
             where place = least(cast(floor(n * p) as bigint), n - 1)) using (l_returnflag, l_linestatus, p)"""
    ),
)
def price_percentiles(spark, sf):
    """Groups of more values than are put in order at once, and groups without any."""
    lines = t.table(spark, sf, "lineitem").withColumnRenamed("l_extendedprice", "price")
    status = F.explode(F.array(*map(F.lit, ("O", "F", "none")))).alias("l_linestatus")
    groups = lines.select("l_returnflag").distinct().select("l_returnflag", status)
    return metrics.percentiles(lines, ["l_returnflag", "l_linestatus"], "price", [0.01, 0.5, 0.99, 1.0], limit=1_000, groups=groups)


@query(
    "throughput",
    sql(
        """select tenant, day, sent, elapsed_s, round(sent / nullif(elapsed_s, 0), 6) as rate from (
             select tenant, day, count(*) as sent, (max(us) - min(us)) / 1000000 as elapsed_s from ids group by 1, 2)"""
    ),
)
def throughput(spark, sf):
    rows = t.with_days(t.logs(spark, sf)).select("tenant", day_col(), us_col())
    return metrics.throughput(rows, ["tenant", "day"])


@query(
    "reconcile",
    sql(
        """select sent.tenant, any_value(n) as sent, max(total - baseline) as stored,
                  any_value(n) - max(total - baseline) as missing,
                  min(case when total - baseline >= n then t end) as drained_at
           from sent join polls using (tenant) group by sent.tenant""",
        sent=f"""select tenant, count(*) filter (us >= {JAN_20} and us < {JAN_22}) as n,
                        count(*) filter (us < {JAN_20}) as baseline from logs group by 1""",
    ),
)
def reconcile(spark, sf):
    us = F.unix_micros("timestamp")
    sent = t.logs(spark, sf).groupBy("tenant").agg(
        F.count_if((us >= JAN_20) & (us < JAN_22)).alias("n"), F.count_if(us < JAN_20).alias("baseline")
    )
    return metrics.reconcile(sent, t.polls(spark, sf), "tenant")


@query(
    "ingest_counters",
    sql("select tenant, count(*) filter (reason is null) as accepted, count(*) filter (reason is not null) as rejected from checked group by 1"),
)
def ingest_counters(spark, sf):
    checked = structured_.check_payloads(
        t.payloads(spark, sf).withColumnRenamed("tenant", "owner"), ingest_time=F.col("timestamp"), keep=("owner",)
    )
    counted = metrics.ingest_counters(checked, F.col("reason").isNull(), ["owner"])
    return counted.withColumnRenamed("owner", "tenant")


@query("distinct_docs", sql("select tenant, count(*) as received, count(distinct doc_id) as distinct_n from redelivered group by 1"))
def distinct_docs(spark, sf):
    return stats.distinct_docs(t.with_ids(t.redelivered(spark, sf)))


@query("accept_split", sql("select event_id, row_number() over (partition by day order by event_id) <= 300 as accepted from ids"))
def accept_split(spark, sf):
    rows = t.with_days(t.logs(spark, sf)).select("event_id", "day")
    return metrics.accept_split(rows, ["day"], "event_id", 300).select("event_id", "accepted")


# --- windows and sequences -------------------------------------------------------------


def _alerts(spark, sf):
    return alerts_.evaluate(t.logs(spark, sf), t.rules(spark))


def alert_cols():
    return [us_col(), "tenant", "rule", "level", "service", "count", "window_s", "message"]


ALERT_SQL = 'select us, tenant, rule, level, service, "count", window_s::double as window_s, message from alerts'


@query("window_counts", sql("select rule, tenant, us, n from counted"))
def window_counts(spark, sf):
    return alerts_.window_counts(t.logs(spark, sf), t.rules(spark))


@query("alert_candidates", sql("select rule, tenant, us, cast(least(n, threshold) as integer) as n from counted where n >= threshold"))
def alert_candidates(spark, sf):
    return alerts_.candidates(t.logs(spark, sf), t.rules(spark))


@query("alerts", sql(ALERT_SQL))
def alerts(spark, sf):
    return _alerts(spark, sf).select(*alert_cols())


@query("recent_alerts", sql(ALERT_SQL + " where tenant = 't0' order by us desc, rule limit 20"))
def recent_alerts(spark, sf):
    return alerts_.recent_alerts(_alerts(spark, sf), "t0").select(*alert_cols())


@query(
    "rate_limit",
    sql(
        "select event_id, n <= 2 as allowed from steps",
        numbered="select event_id, user_id, us, row_number() over (partition by user_id order by us, event_id) as i from logs",
        steps="""select event_id, user_id, i, us as start, 1 as n from numbered where i = 1
                 union all
                 select x.event_id, x.user_id, x.i, case when x.us - s.start >= 86400000000 then x.us else s.start end,
                        case when x.us - s.start >= 86400000000 then 1 else s.n + 1 end
                 from steps s join numbered x on x.user_id = s.user_id and x.i = s.i + 1""",
    ),
)
def rate_limit(spark, sf):
    hits = t.logs(spark, sf).select("event_id", "user_id", us_col())
    limited = tenancy.rate_limit(hits, "user_id", "us", "event_id", limit=2, window_us=86_400_000_000)
    return limited.select("event_id", "allowed")


@query("ingest_rate", sql("select tenant, t, round(rate, 6) as rate from rates"))
def ingest_rate(spark, sf):
    return metrics.ingest_rate(t.polls(spark, sf)).select("tenant", "t", F.round("rate", 6).alias("rate"))


@query(
    "ewma_rate",
    sql(
        """select tenant, t, round(r, 6) as ewma, case when r > 1 then 'receiving' else 'idle' end as status from smooth""",
        numbered="select tenant, t, rate, row_number() over (partition by tenant order by t) as i from rates where rate is not null",
        smooth="""select tenant, t, i, cast(rate as double) as r from numbered where i = 1
                  union all
                  select x.tenant, x.t, x.i, 0.6 * s.r + 0.4 * x.rate
                  from smooth s join numbered x on x.tenant = s.tenant and x.i = s.i + 1""",
    ),
)
def ewma_rate(spark, sf):
    return metrics.ewma(metrics.ingest_rate(t.polls(spark, sf)))


# --- sinks and table maintenance -------------------------------------------------------


@query("publish_roundtrip", sql(f"select {EVENT_SQL} from logs"))
def publish_roundtrip(spark, sf):
    folder = new_folder(spark, "topic")
    sinks.publish(t.logs(spark, sf), folder)
    return stream_sources.decode_events(spark.read.text(folder)).select(*event_cols())


def _store(spark, logs):
    store = LogStore(spark, new_folder(spark, "store"))
    store.write(logs)
    return store


@query("store_roundtrip", sql(f"select doc_id, day, {EVENT_SQL} from ids"))
def store_roundtrip(spark, sf):
    us = F.unix_micros("timestamp")
    rows = t.redelivered(spark, sf)
    store = _store(spark, rows.where(us < JAN_22))
    store.write(rows.where(us >= JAN_20))
    return store.read().select("doc_id", day_col(), *event_cols())


@query(
    "dead_letter",
    sql("select coalesce(cast(j as varchar), payload) as raw, reason, cast(7 as bigint) as batch_id from checked where reason is not null"),
)
def dead_letter(spark, sf):
    _, rejected = structured_.structured(t.payloads(spark, sf), ingest_time=F.col("timestamp"))
    folder = new_folder(spark, "dead")
    sinks.dead_letter(rejected, folder, 7)
    sinks.dead_letter(rejected, folder, 7)  # the same batch again must not double it
    return sinks.read_dead_letters(spark, folder)


def _expired(spark, sf):
    store = _store(spark, t.logs(spark, sf))
    archive = Archive(spark, new_folder(spark, "archive"))
    expire_days(store, AS_OF, KEEP_DAYS, archive)
    return store, archive


@query(
    "archive_roundtrip",
    sql(f"select {EVENT_SQL}, day, case when epoch_us(cast(day as timestamp)) < {CUTOFF_US} then 'archive' else 'store' end as place from ids"),
)
def archive_roundtrip(spark, sf):
    store, archive = _expired(spark, sf)
    kept = store.read().select(*event_cols(), day_col(), F.lit("store").alias("place"))
    return kept.unionByName(archive.read().select(*event_cols(), day_col(), F.lit("archive").alias("place")))


@query("restore", sql(f"select doc_id, {EVENT_SQL} from ids where epoch_us(cast(day as timestamp)) < {CUTOFF_US}"))
def restore_(spark, sf):
    _, archive = _expired(spark, sf)
    back = LogStore(spark, new_folder(spark, "restored"))
    restore(archive, back)
    restore(archive, back)
    return back.read().select("doc_id", *event_cols())


@query("compaction", sql(f"select doc_id, day, {EVENT_SQL}, 1 as files from ids"))
def compaction(spark, sf):
    # four writes leave four files a tenant-day; what they held is merged, and deleted once nobody reads it
    store = LogStore(spark, new_folder(spark, "small-files"))
    rows = t.logs(spark, sf)
    for i in range(4):
        store.write(rows.where(F.col("event_id") % 4 == i))
    merges.compact(store, least=2)
    merges.vacuum(store, grace_s=0)
    per_day = merges.file_counts(store)
    kept = store.read().join(per_day, ["tenant", "day"])
    return kept.select("doc_id", day_col(), *event_cols(), F.col("files").cast("int").alias("files"))


@query(
    "late_during_expiry",
    sql(
        f"""select {EVENT_SQL}, day, case when epoch_us(cast(day as timestamp)) < {CUTOFF_US} and event_id % 5 <> 0 then 'archive'
                                          else 'store' end as place from ids"""
    ),
)
def late_during_expiry(spark, sf):
    # each fifth event arrives after its day was archived and before the day is deleted: it stays
    rows = t.logs(spark, sf)
    store = _store(spark, rows.where("event_id % 5 <> 0"))

    class Slow(Archive):
        def missing(self, logs, until=None):
            store.write(rows.where("event_id % 5 = 0"))
            return super().missing(logs, until)

    archive = Slow(spark, new_folder(spark, "archive"))
    expire_days(store, AS_OF, KEEP_DAYS, archive)
    kept = store.read().select(*event_cols(), day_col(), F.lit("store").alias("place"))
    return kept.unionByName(archive.read().select(*event_cols(), day_col(), F.lit("archive").alias("place")))


@query("find_page", sql(f"select doc_id, {EVENT_SQL} from ids where tenant = 't0' and {_PHRASE_SQL % 'by user'} order by us desc, doc_id limit 100"))
def find_page(spark, sf):
    return find.newest(_store(spark, t.logs(spark, sf)), "t0", "by user").select("doc_id", *event_cols())


@query(
    "ingest_store",
    sql(
        f"""select distinct us, level, service, message, attrs, team as tenant from ({LINES_SQL.replace("legacy", "unknown")})
            join (select event_id, user_id from logs) using (event_id)
            join creds on api_key = 'k' || user_id where team <> 'Bad*'"""
    ),
)
def ingest_store(spark, sf):
    # text requests with their credential, to stored events of the credential's tenant
    requests = t.raw_lines(spark, sf).join(_requests(spark, sf), "event_id")
    events, _ = ingest.ingest_raw(requests, _credentials(spark, sf), "value", ingest_time=F.col("timestamp"))
    return _store(spark, events).read().select(*event_cols())


@query("dead_letter_replay", sql(f"select doc_id, day, {EVENT_SQL} from ids"))
def dead_letter_replay(spark, sf):
    # the store is down for as long as the batch is tried: all of it goes through the dead letters
    folder, store = new_folder(spark, "dead-replay"), LogStore(spark, new_folder(spark, "store"))

    class Down:
        def write(self, _):
            raise OSError("the store is down")

    stream_index_.index_batch(Down(), t.redelivered(spark, sf), 0, folder, sleep=lambda _: None)
    stream_index_.replay_dead_letters(store, folder)
    stream_index_.replay_dead_letters(store, folder)  # a second time adds nothing
    return store.read().select("doc_id", day_col(), *event_cols())


# --- streams ---------------------------------------------------------------------------


TICKS_US = (AS_OF_US - 11 * 86_400_000_000, AS_OF_US)


@query(
    "retention_job",
    sql(
        """select as_of_us, (select count(distinct (tenant, day)) from ids
                             where epoch_us(cast(day as timestamp)) < as_of_us - keep and epoch_us(cast(day as timestamp)) >= before - keep)
                  as dropped_days from ticks""",
        ticks=f"select *, {KEEP_DAYS * 86_400_000_000} as keep from (values ({TICKS_US[0]}, 0), ({TICKS_US[1]}, {TICKS_US[0]})) v(as_of_us, before)",
    ),
)
def retention_job(spark, sf):
    # two ticks, the stream restarted between them, and once more with none
    folder, store = new_folder(spark, "retention"), _store(spark, t.logs(spark, sf))
    archive = Archive(spark, f"{folder}/archive")
    for us in (*TICKS_US, None):
        if us is not None:
            spark.range(1).select(F.timestamp_micros(F.lit(us)).alias("timestamp")).coalesce(1).write.mode("append").parquet(f"{folder}/ticks")
        ticks = spark.readStream.schema("timestamp timestamp").parquet(f"{folder}/ticks")
        stream_retention.retention_stream(ticks, store, KEEP_DAYS, f"{folder}/runs", f"{folder}/offsets", archive, once=True).awaitTermination()
    runs = stream_retention.read_runs(spark, f"{folder}/runs")
    return runs.select(F.unix_micros("as_of").alias("as_of_us"), "dropped_days")


def _stream(spark, sf):
    return t.as_logs(t.table_stream(spark, sf, "events"))


def _ordered(spark, events, folder):
    """Add the events to a folder as files of disjoint time ranges that a stream takes in order of time."""
    held = set(files_below(spark, folder, ".parquet"))
    # the ranges are cut at the same places whatever the number of files that the events came in
    events.repartitionByRange("ts", "event_id").sortWithinPartitions("ts").write.mode("append").parquet(folder)
    new = sorted(set(files_below(spark, folder, ".parquet")) - held)
    set_order(spark, folder, new, after=len(held))


def _end_marker(events):
    """A far-future event, which moves the watermark past all others."""
    return events.orderBy(F.col("event_id").asc_nulls_last()).limit(1).withColumn("ts", F.expr(f"timestamp_ntz'{FAR}'"))


def _run_alerts(spark, folder, schema, **options):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", t.FILES_PER_BATCH).parquet(f"{folder}/ordered")
    stream_alerts_.alert_stream(
        t.as_logs(stream), t.rules(spark), f"{folder}/alerts", f"{folder}/offsets", delay=ALERT_DELAY, once=True, **options
    ).awaitTermination()


def _drain(df, spark, label):
    out = new_folder(spark, label)
    df.writeStream.format("parquet").option("checkpointLocation", f"{out}/offsets").trigger(
        availableNow=True
    ).start(f"{out}/rows").awaitTermination()
    return spark.read.parquet(f"{out}/rows")


@query("stream_index", sql(f"select doc_id, day, {EVENT_SQL} from ids"))
def stream_index(spark, sf):
    folder = new_folder(spark, "stream-store")
    store = LogStore(spark, f"{folder}/store")
    stream = t.twice_every_seventh(_stream(spark, sf))
    stream_index_.index_stream(stream, store, f"{folder}/offsets", f"{folder}/dead", once=True).awaitTermination()
    return store.read().select("doc_id", day_col(), *event_cols())


ALERT_DELAY, ALERT_DELAY_US = "6 hours", 6 * 3_600_000_000


@query("stream_alerts", sql(ALERT_SQL))
def stream_alerts(spark, sf):
    folder, events = new_folder(spark, "stream-alerts"), t.table(spark, sf, "events")
    _ordered(spark, events.unionByName(_end_marker(events)), f"{folder}/ordered")
    _run_alerts(spark, folder, events.schema)
    return sinks.read_alerts(spark, f"{folder}/alerts").where(F.col("timestamp") < F.lit(FAR).cast("timestamp")).select(*alert_cols())


@query(
    "alert_state",
    sql(
        """select rule, tenant, us, count(*) as hits from matched
           where us <= (select last from edge) and us >= (select last from edge) - window_us group by all""",
        # the watermark has whole milliseconds
        edge=f"select max(us) as last from matched where us <= (select max(us) // 1000 * 1000 - {ALERT_DELAY_US} from logs)",
    ),
)
def alert_state(spark, sf):
    # what the stream remembers when it has seen all: hits that a window may still reach
    folder, events = new_folder(spark, "alert-state"), t.table(spark, sf, "events")
    _ordered(spark, events, f"{folder}/ordered")
    _run_alerts(spark, folder, events.schema)
    return stream_alerts_.alert_state(spark, f"{folder}/offsets")[0]


@query(
    "notify_outbox",
    sql("""select ':rotating_light: ' || message || ' (tenant=' || tenant || ')' as text, count(*) as n from alerts group by 1"""),
)
def notify_outbox(spark, sf):
    # the first two sends fail; what they held arrives with a later one
    folder, refused = new_folder(spark, "outbox"), iter([True, True])

    def send(texts):
        if next(refused, False):
            raise OSError("nobody listens")
        texts.write.mode("append").text(f"{folder}/sent")

    events = t.table(spark, sf, "events")
    for part in (events, _end_marker(events)):  # two runs on one checkpoint
        _ordered(spark, part, f"{folder}/ordered")
        _run_alerts(spark, folder, events.schema, send=send)
    stream_alerts_.outbox(spark, f"{folder}/offsets").deliver(send)
    sent = spark.read.schema("text string").text(f"{folder}/sent")
    return sent.groupBy("text").agg(F.count("*").alias("n"))


@query("stream_dedupe", sql("select doc_id from ids"))
def stream_dedupe(spark, sf):
    stream = t.with_ids(t.twice_every_seventh(_stream(spark, sf)))
    return _drain(stream_index_.deduplicated(stream), spark, "stream-dedupe").select("doc_id")


@query("stream_stats", sql("select tenant, dimension, key, n from stats"))
def stream_stats(spark, sf):
    folder = new_folder(spark, "stream-stats")
    stream_stats_.live_cells(_stream(spark, sf), f"{folder}/cells", f"{folder}/offsets", once=True).awaitTermination()
    return stream_stats_.read_live_stats(spark, f"{folder}/cells")


@query("stream_rate", sql("select tenant, us // 86400000000 * 86400000000 as start_us, count(*) as n from logs group by 1, 2"))
def stream_rate(spark, sf):
    folder = new_folder(spark, "stream-rate")
    stream_stats_.rate_table(_stream(spark, sf), f"{folder}/rate", f"{folder}/offsets", "1 day", once=True).awaitTermination()
    rows = stream_stats_.read_rate(spark, f"{folder}/rate")
    return rows.select("tenant", F.unix_micros("window.start").alias("start_us"), "n")
