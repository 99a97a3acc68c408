"""The adapters of tables.py as common table expressions, for the comparison engine."""

from __future__ import annotations

import re

from loomlog.functions.text import WHITESPACE

# the whitespace set as a SQL expression, free of invisible characters
_SPACE = " || ".join(f"chr({ord(c)})" for c in WHITESPACE)
_BREAK = r"'\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]'"

RULE_VALUES = """values
  ('error-burst', 5, 21600.0, 86400.0, 'ERROR', null),
  ('svc1-any', 4, 86400.0, 43200.0, null, 'svc1'),
  ('any-burst', 20, 21600.0, 3600.0, null, null)"""


def framed(expr: str) -> str:
    return f"coalesce(length(cast({expr} as varchar)) || ':' || cast({expr} as varchar), '~')"


def strip(expr: str) -> str:
    return f"trim({expr}, (select chars from spaces))"


def level_of(expr: str) -> str:
    """The level that a raw spelling stands for."""
    up = f"upper({strip(expr)})"
    return (
        f"case when {up} in ('DEBUG','INFO','WARNING','ERROR','CRITICAL') then {up} "
        f"when {up} = 'WARN' then 'WARNING' when {up} = 'FATAL' then 'CRITICAL' when {up} = 'ERR' then 'ERROR' "
        f"else 'INFO' end"
    )


def first_keyword(expr: str) -> str:
    word = r"(?i)(?:^|[^\p{L}\p{N}_])(DEBUG|INFO|WARNING|WARN|ERROR|ERR|CRITICAL|FATAL)(?:$|[^\p{L}\p{N}_])"
    return f"regexp_extract({expr}, '{word}', 1)"


DOC_ID = "sha1(" + " || ".join(framed(c) for c in ("tenant", "us", "service", "level", "message", "attrs")) + ")"

CTES = {
    "spaces": f"select {_SPACE} as chars",
    "logs": """
      select event_id, user_id, epoch_us(ts) as us,
        case event_type when 'error' then 'ERROR' when 'signup' then 'WARNING'
                        when 'click' then 'DEBUG' else 'INFO' end as level,
        'svc' || (event_id % 12) as service,
        event_type || ' by user ' || user_id || ' k ' || json_extract_string(props, '$.k') as message,
        cast(json(props) as varchar) as attrs,
        case user_id % 4 when 0 then 't0' when 1 then 't1' when 2 then 't0-eu' else 'default' end as tenant
      from events""",
    "ids": f"select *, {DOC_ID} as doc_id, strftime(make_timestamp(us), '%Y-%m-%d') as day from logs",
    "redelivered": "select * from ids union all select * from ids where event_id % 7 = 0",
    "raw_lines": """
      select event_id, us, tenant, case event_id % 6
        when 0 then '{"message":"' || message || '","level":" warn ","service":"' || service
                    || '","attrs":' || attrs || ',"extra":1}'
        when 1 then '2024-01-01 ' || upper(split_part(message, ' ', 1)) || ' ' || message
        when 2 then '  <<half {a line [of ' || event_id || '  '
        when 3 then '{"level":"ERROR","note":"' || message || '"}'
        when 4 then '{"message":"' || message || '","level":"verbose"}'
        else '   ' end as line
      from logs""",
    "typed_lines": f"""
      select *, try_cast(text as json) as j
      from (select event_id, us, tenant, {strip('line')} as text from raw_lines) where text <> ''""",
    "json_lines": """
      select *, coalesce(json_type(j) = 'OBJECT' and json_type(j, '$.message') = 'VARCHAR'
        and json_extract_string(j, '$.message') <> ''
        and coalesce(json_type(j, '$.level'), 'VARCHAR') = 'VARCHAR'
        and coalesce(json_type(j, '$.service'), 'VARCHAR') = 'VARCHAR'
        and coalesce(json_type(j, '$.attrs'), 'OBJECT') = 'OBJECT', false) as ok
      from typed_lines""",
    "payloads": """
      select event_id, us, tenant, case event_id % 8
        when 0 then '{"timestamp":"' || strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S.%fZ') || '","level":"warn","service":"'
                    || service || '","message":"' || message || '","attrs":' || attrs || ',"tenant":"forged","extra":1}'
        when 1 then '[{"message":"a ' || event_id || '"},{"message":"b","level":"fatal","service":"s2"}]'
        when 2 then '{"message":""}'
        when 3 then '[{"message":5},{"message":"ok ' || event_id || '","timestamp":1704067200}]'
        when 4 then '{oops ' || event_id
        when 5 then '{"attrs":[1],"message":"x"}'
        when 6 then '{"message":"y","service":null}'
        else '{"message":"z","timestamp":' || (1704067200000 + event_id) || '}' end as payload
      from logs""",
    "items": """
      select event_id, us, tenant, payload,
        unnest(case when json_type(try_cast(payload as json)) = 'ARRAY'
                    then json_extract(try_cast(payload as json), '$[*]')
                    else [try_cast(payload as json)] end) as j
      from payloads""",
    "checked": """
      select *, case when j is null then 'not_json' when json_type(j) <> 'OBJECT' then 'not_an_object'
        when coalesce(json_type(j, '$.message'), '') <> 'VARCHAR' then 'message'
        when coalesce(json_type(j, '$.service'), 'VARCHAR') <> 'VARCHAR' then 'service'
        when coalesce(json_type(j, '$.attrs'), 'OBJECT') <> 'OBJECT' then 'attrs' end as reason
      from items""",
    "doc_lines": rf"""
      select doc_id, pos, source as service, lang as tenant, message from (
        select doc_id, source, lang, unnest(parts) as message, generate_subscripts(parts, 1) - 1 as pos
        from (select *, string_split_regex(text, {_BREAK}) as parts from documents))
      where {strip('message')} <> ''""",
    "rules": f"""
      select name as rule, threshold, window_s, cast(window_s * 1e6 as bigint) as window_us,
             cast(cooldown_s * 1e6 as bigint) as cooldown_us, rlevel, rservice
      from ({RULE_VALUES}) r(name, threshold, window_s, cooldown_s, rlevel, rservice)""",
    "matched": """
      select rule, tenant, us, threshold, window_us, cooldown_us
      from logs join rules on (rlevel is null or rlevel = level) and (rservice is null or rservice = service)""",
    "counted": """
      select distinct * from (
        select *, count(*) over (partition by rule, tenant order by us
                                 range between window_us preceding and current row) as n from matched)""",
    "cand": "select rule, tenant, us, cooldown_us from counted where n >= threshold",
    "fired": """
      select rule, tenant, min(us) as us, max(cooldown_us) as cooldown_us from cand group by rule, tenant
      union all
      select rule, tenant, us, cooldown_us from (
        select fired.rule, fired.tenant, fired.cooldown_us,
               (select min(x.us) from cand x where x.rule = fired.rule and x.tenant = fired.tenant
                                               and x.us >= fired.us + fired.cooldown_us) as us
        from fired) where us is not null""",
    "alerts": """
      select us, tenant, rule, rlevel as level, rservice as service, threshold as "count", window_s,
             rule || ': ' || threshold || ' matching events within ' || cast(window_s as bigint) || 's' as message
      from fired join rules using (rule)""",
    "polls": """
      select tenant, t, cast(sum(n) over (partition by tenant order by t) as bigint) as total from (
        select tenant, cast((us // 86400000000 + 1) * 86400 as double) as t, count(*) as n from logs group by all)""",
    "rates": """
      select tenant, t, case when lag(t) over w is not null
        then greatest(0.0, (total - lag(total) over w) / (t - lag(t) over w)) end as rate
      from polls window w as (partition by tenant order by t)""",
    "tail": """
      select * from (select *, row_number() over (partition by tenant order by us desc, doc_id) as rn from ids)
      where rn <= 200""",
    "cells": "select tenant, level, service, count(*) as n from logs group by all",
    "stats": """
      select tenant, 'total' as dimension, '' as key, cast(sum(n) as bigint) as n from cells group by all
      union all select tenant, 'level', level, cast(sum(n) as bigint) from cells group by all
      union all select tenant, 'service', service, cast(sum(n) as bigint) from cells group by all""",
    "creds": """
      select 'k' || user_id as api_key, case when user_id % 7 = 0 then 'Bad*' else 'team-' || (user_id % 4) end as team
      from (select distinct user_id from events) where user_id % 5 <> 0""",
    "digests": "select event_id, epoch_us(ts) as us, sha256('42:' || event_id) as d from events",
}


def _needs(text: str, found: list[str]) -> list[str]:
    for name, body in CTES.items():
        if name not in found and re.search(rf"\b(from|join)\s+{name}\b", text):
            found.append(name)
            _needs(body, found)
    return found


def sql(text: str, **more: str) -> str:
    """A statement with the table expressions it needs; ``more`` adds some of its own."""
    found = _needs(" ".join([text, *more.values()]), [])
    parts = [f"{name} as ({CTES[name]})" for name in CTES if name in found]
    parts += [f"{name} as ({body})" for name, body in more.items()]
    return f"with recursive {', '.join(parts)} {text}" if parts else text


def draw(slot: int, n: int, digits: int = 4) -> str:
    return f"(cast('0x' || substr(d, {slot * 4 + 1}, {digits}) as bigint) % {n})"


def pick(slot: int, values: list[str]) -> str:
    return "list_extract([" + ", ".join(f"'{v}'" for v in values) + f"], {draw(slot, len(values))} + 1)"
