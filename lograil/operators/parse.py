"""Access lines to structured logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRICT = r'^((?:\d{1,3}\.){3}\d{1,3}|[0-9A-Fa-f:]*:[0-9A-Fa-f:.]+) \S+ \S+ \[(\d{2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4})\] "([A-Za-z]+) (\S+) HTTP/([0-9.]+)" (\d+) (\d+|-) "([^"]*)" "([^"]*)"'
LENIENT = r'^(\S+) \S+ \S+ \[([^\]]+)\] "([^"]*)" (\d+) (\d+|-) "([^"]*)" "([^"]*)"'
FIELDS = ["ip", "time_text", "method", "path", "http_version", "status", "bytes", "referrer", "user_agent"]


def http_time_ms(text: Column) -> Column:
    """Epoch milliseconds of an HTTP date, null if it is none."""
    return F.unix_millis(F.try_to_timestamp(text, F.lit("dd/MMM/yyyy:HH:mm:ss Z")))


def parse_strict(lines: DataFrame, col: str = "line") -> DataFrame:
    """Adds parsed, the nine fields (null if not parsed), ts_ms, and the enrichment of parsed rows.

    event_id is the hash of the line and the row's number, so a replay gives the same id.
    """
    parsed = F.coalesce(F.col(col).rlike(STRICT), F.lit(False))
    out = lines.withColumn("parsed", parsed)
    part = lambda i: F.when(F.col("parsed"), F.regexp_extract(col, STRICT, i))
    out = out.withColumns({name: part(i) for i, name in enumerate(FIELDS, 1)})
    return out.withColumns({
        "ts_ms": http_time_ms(F.col("time_text")), "status": F.expr("try_cast(status as int)"), "bytes": F.expr("try_cast(bytes as bigint)"),
        "event_id": F.when(F.col("parsed"), F.sha2(F.concat_ws("|", F.col("n").cast("string"), F.col(col)), 256)), "log_source": F.when(F.col("parsed"), F.lit("nginx")),
        "audit_user": F.col("ip"), "audit_event": F.concat_ws(" ", "method", "path"), "pipeline_status": F.when(F.col("parsed"), F.lit("pending")),
    })


def split_parsed(parsed: DataFrame, col: str = "line") -> tuple[DataFrame, DataFrame]:
    """Structured rows, and dead letters of the lines that were not parsed."""
    bad = parsed.where(~F.col("parsed")).select("n", F.col(col).alias("original_payload"), F.lit("parse_failure").alias("reason"), F.lit("structuring").alias("stage"))
    return parsed.where("parsed").drop("parsed"), bad


def parse_lenient(lines: DataFrame, col: str = "line") -> DataFrame:
    """Any quoted request; fewer than two words: method GET and the request as the uri; unmatched lines go."""
    rows = lines.where(F.col(col).rlike(LENIENT)).withColumn("_p", F.split(F.regexp_extract(col, LENIENT, 3), " ", 3))
    two = F.size("_p") >= 2
    part = lambda i: F.regexp_extract(col, LENIENT, i)
    return rows.select(*[c for c in lines.columns if c != col], part(1).alias("ip"), F.when(two, F.get("_p", F.lit(0))).otherwise("GET").alias("method"), F.when(two, F.get("_p", F.lit(1))).otherwise(part(3)).alias("uri"), part(4).alias("status"), part(5).alias("size"), part(6).alias("referrer"), part(7).alias("user_agent"))
