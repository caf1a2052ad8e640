"""Views that stand in for access logs, archives, reports and corpora: one SQL text each, for Spark and for DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Fixed payloads of `path` by event_id % 20; the others are plain pages.
PAYLOADS = [
    "/search?q=1 union select name from users", "/a/../../etc/passwd", "/x?cmd=;whoami", "/admin/", "/p?n=<script>alert(1)</script>", "/q?id=1 or 1=1",
    "/f?u=..%2f..%2fetc", "/.git/config", "/s?x=javascript:alert(1)", "/d?x=sleep(5)", "/run?c=$(whoami)", "/dump/database.sql",
]
_PATH = "case event_id % 20 " + " ".join(f"when {i} then '{p}'" for i, p in enumerate(PAYLOADS)) + " else concat('/item/', cast(event_id % 97 as string), '?page=', cast(event_id % 3 as string)) end"

VIEWS: dict[str, str] = {
    "access_log": f"""
select cast(event_id as string) as event_id, event_id as n, {{ms}} as ts_ms,
case when user_id % 5 = 0 then '10.0.0.1' else concat('10.', cast(user_id % 250 as string), '.', cast(user_id % 7 as string), '.9') end as ip,
case event_type when 'view' then 'GET' when 'click' then 'get' when 'error' then 'PUT' else 'POST' end as method,
{_PATH} as path,
case when event_type = 'error' then 500 when event_id % 7 = 0 then 404 when event_id % 7 = 1 then 302 when event_id % 7 = 2 then 403 else 200 end as status,
event_id * 37 % 5000 as bytes,
case event_id % 9 when 0 then '' when 1 then 'http://example.com/?q=<script>alert(1)</script>' else 'http://example.com/' end as referrer,
case event_id % 6 when 0 then '' when 1 then 'Mozilla/5.0' when 2 then 'nmap scripting engine' when 3 then 'Googlebot/2.1' when 4 then 'curl/8.0' else 'Mozilla/5.0 (X11)' end as user_agent
from events""",
    "access_line": """
select n, ts_ms, case when n % 50 = 0 then concat('broken line ', cast(n as string)) else concat(ip, ' - - [', {httpdate}, ' +0000] "', method, ' ', replace(path, ' ', '+'), ' HTTP/1.1" ', cast(status as string), ' ', cast(bytes as string), ' "', referrer, '" "', user_agent, '"') end as line
from access_log""",
    "versioned_log": """
select event_id as record_id, ts_ms as event_time, 2 + n % 1000 as version, cast(n % 3 as string) as topic, n % 4 as part, n as off, concat('h', cast(n % 11 as string)) as payload_hash, ip, path, status, method from access_log
union all
select event_id, case when n % 100 = 0 then ts_ms + 1 else ts_ms end, 2 + n % 1000 + n % 2, cast(n % 3 as string), n % 4, n + 5, concat('h', cast(n % 13 as string)), ip, path, status, method from access_log where n % 10 = 0""",
    "reports": """
select a.event_id, a.n, a.ts_ms, a.ip, a.path, a.method, a.status, a.user_agent,
case a.n % 6 when 0 then 'critical' when 1 then 'high' when 2 then 'medium' when 3 then 'low' when 4 then 'unknown' else '' end as risk_level,
e.user_id % 101 as risk_score, case a.n % 20 when 0 then 'sql_injection' when 4 then 'xss' else 'path_traversal' end as detect_type,
case a.n % 4 when 0 then 'pending' when 1 then 'claimed' when 2 then 'processed' else 'pending' end as review_status,
a.ts_ms + (a.n % 40) * 60000 as claimed_ms
from access_log a join events e on a.n = e.event_id where a.n % 20 < 12""",
    "reviews": """
select event_id, k as seq, ts_ms + k * 1000 as at_ms, case (n + k) % 3 when 0 then 'confirmed' when 1 then 'false_positive' else 'uncertain' end as verdict,
case when n % 5 = 0 then ' ok ' else 'looked at it' end as comment
from reports join (select 1 as k union all select 2 union all select 3) ks on k <= n % 4""",
    "calls": """
select cast(conv_id as string) as case_id, turn as step, role, case turn % 3 when 0 then 'query_ip_logs' when 1 then 'query_events' else 'search_docs' end as tool,
length(text) as tokens, turn % 5 <> 4 as ok, turn * 7 % 100 as ms, case when turn % 4 = 3 then '' else concat('s', cast((conv_id + turn) % 6 as string)) end as source_id,
case when turn % 2 = 0 then 'a=1' else 'b=2' end as args, text from conversations""",
    "scored": """
select l.doc_id as id, l.toxic as label, -(d.n_chars % 1000) / 1000.0 as score, case when d.n_chars % 1000 > 700 then 1 else 0 end as predicted
from labels l join documents d on l.doc_id = d.doc_id where l.toxic is not null""",
    "corpus": """
select concat('d', cast(doc_id as string)) as source_id, case when lang = 'en' then 'knowledge' else 'case' end as source_type, source as attack_type, text as content, doc_id as created from documents""",
    "queries": """
select item_id as query_id, text from benchmark""",
    "checkpoints": """
select k.topic, k.part, k.initial_offset, k.next_offset, k.next_offset + k.part % 2 as observed_offset, 4 as partition_count from
(select topic, part, min(off) as initial_offset, max(off) + 1 as next_offset from versioned_log group by topic, part) k""",
    "windows": """
select concat('k', cast(event_id % 3 as string)) as kind, {ms} as start_ms, {ms} + case when event_id % 17 = 0 then 1000 else 900000 end as end_ms, event_id % 23 <> 0 as verified from events""",
}

_FORMS = {
    "spark": {"ms": "timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))", "httpdate": "date_format(timestamp_millis(ts_ms), 'dd/MMM/yyyy:HH:mm:ss')"},
    "duckdb": {"ms": "(epoch_us(ts) // 1000)", "httpdate": "strftime(make_timestamp(ts_ms * 1000), '%d/%b/%Y:%H:%M:%S')"},
}


def text(name: str, dialect: str) -> str:
    sql = VIEWS[name]
    for k, v in _FORMS[dialect].items():
        sql = sql.replace("{" + k + "}", v)
    return sql


_NEEDS = {"access_line": ["access_log"], "versioned_log": ["access_log"], "reports": ["access_log"], "reviews": ["access_log", "reports"], "checkpoints": ["access_log", "versioned_log"]}
TABLES = ("events", "documents", "labels", "benchmark", "conversations", "embeddings")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture as a DataFrame over the tables of sf_dir, which are read lazily."""
    ctes = [f"{v} as ({text(v, 'spark')})" for v in [*_NEEDS.get(name, []), name]]
    body = "with " + ", ".join(ctes) + f" select * from {name}"
    body = re.sub(rf"\b(from|join) ({'|'.join(TABLES)})\b", r"\1 {\2}", body)
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in body}
    return spark.sql(body, **used)


def with_views(sql: str, *names: str) -> str:
    """DuckDB's SQL with the fixtures that it names in front; sql may start with `with`."""
    order = list(dict.fromkeys(v for n in names for v in [*_NEEDS.get(n, []), n]))
    ctes = ", ".join(f"{v} as ({text(v, 'duckdb')})" for v in order)
    sql = sql.strip()
    if sql.lower().startswith("with recursive "):
        return f"with recursive {ctes}, {sql[15:]}"
    return f"with {ctes}, {sql[5:]}" if sql.lower().startswith("with ") else f"with {ctes} {sql}"
