"""Normalized logs, the storage contract, dead letters, and flattening for analysis."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograil.functions.addresses import canonical_ip
from lograil.functions.decode import canonical_payload, decoded
from lograil.functions.times import log_time, strict_time

REQUIRED = ["event_id", "ip", "method", "path", "status"]


def blank(name: str) -> Column:
    return F.coalesce(F.trim(F.col(name).cast("string")) == "", F.lit(True))


def missing(names: list[str] = REQUIRED) -> Column:
    """Names of required fields that are null or blank."""
    return F.filter(F.array(*[F.when(blank(n), F.lit(n)) for n in names]), lambda x: x.isNotNull())


def normalize(raw: DataFrame, now_ms: int = 0) -> DataFrame:
    """Decoded rows in the shape of normalized logs, with `error` (null if valid) and original_path."""
    fields = ["event_id", "ip", "method", "path", "status", "referrer", "user_agent"]
    rows = raw.withColumn("original_path", F.col("path")).withColumns({f: decoded(F.col(f).cast("string")) for f in fields if f in raw.columns})
    status = F.trim(F.col("status")).try_cast("int")
    size = F.when(F.coalesce(F.col("bytes").cast("string"), F.lit("")) == "", F.lit(0).cast("long")).otherwise(F.col("bytes").cast("string").try_cast("long"))
    gone = missing()
    error = F.when(F.size(gone) > 0, F.concat(F.lit("missing fields: "), F.array_join(gone, ", "))).when(status.isNull() | size.isNull(), "invalid number")
    version = F.coalesce(F.col("http_version"), F.lit("1.1")) if "http_version" in raw.columns else F.lit("1.1")
    return rows.select(
        "event_id", "ip", F.upper("method").alias("method"), "path", "original_path", status.alias("status"), size.alias("bytes"),
        F.when(~version.startswith("HTTP/"), F.concat(F.lit("HTTP/"), version)).otherwise(version).alias("http_version"), F.coalesce("referrer", F.lit("")).alias("referrer"), F.coalesce("user_agent", F.lit("")).alias("user_agent"),
        log_time(F.col("ts_ms").cast("string"), F.lit(False), F.lit(now_ms)).alias("ts_ms"), error.alias("error"),
    )


def tokens(text: Column) -> Column:
    """Comma-separated tokens: trimmed, without blanks, distinct, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")))


def rule_ids(detections: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(detections, lambda d: d["rule_id"])))


def storage_row(rows: DataFrame, now_ms: int) -> DataFrame:
    """The storage contract: version, hash, tokens and the first reason for refusal in `error`.

    rows: event_id, ts_ms, ip, status, bytes, attack_type, off (null for backfill), payload.
    """
    record = F.trim(F.coalesce(F.col("event_id"), F.lit("")))
    error = (
        F.when(record == "", "record id is missing").when(F.length(record) > 255, "record id is too long").when(F.col("ts_ms").isNull(), "event time is missing")
        .when(F.col("ts_ms") > now_ms + 300_000, "event time is in the future").when(~F.col("status").between(0, 65535), "status is out of range").when(F.col("bytes") < 0, "bytes are out of range")
    )
    return rows.select(record.alias("record_id"), F.col("ts_ms").alias("event_time"), F.coalesce(F.col("off") + 2, F.lit(1)).alias("version"), F.sha2("payload", 256).alias("payload_hash"), tokens(F.coalesce("attack_type", F.lit(""))).alias("attack_types"), error.alias("error"))


#: Columns of a storage record, in order.
RECORD = (
    "record_id", "event_id", "event_time", "ingested_at", "archived_at", "ip", "method", "path", "normalized_path", "status", "bytes", "http_version", "referrer", "user_agent", "log_source",
    "attack_types", "rule_ids", "raw_payload", "payload_hash", "schema_version", "source_kind", "source_topic", "source_partition", "source_offset", "version",
)


def storage_record(messages: DataFrame, kind: str, now_ms: int) -> DataFrame:
    """The whole storage contract: the columns of RECORD, and in `error` the first reason why a message is refused.

    messages: payload (JSON text), source_kind, source_topic, source_partition, source_offset, source_ms, legacy_id (used
    for backfill alone). kind: raw (fields at the top) or events (fields in log_context). The content is hashed in its
    canonical form without `_storage`, so the order of keys makes no other version. Times are milliseconds; bytes are
    decimals, as they reach 2^64. Truth values of text fields are written as JSON has them.
    """
    inside = "$." if kind == "raw" else "$.log_context."
    words = ("method", "path", "normalized_path", "http_version", "referrer", "user_agent")
    places = {"event_id": "$.event_id", "log_context": "$.log_context", "time": "$['@timestamp']" if kind == "raw" else "$.log_context.timestamp", "ingested": "$.ingested_at", "types": "$.attack_type", "source": "$.log_source", **{n: inside + n for n in ("ip", "status", "bytes", *words)}}
    rows = messages.withColumn("raw_payload", canonical_payload("payload")).withColumn("_v", F.try_parse_json("raw_payload"))
    rows = rows.withColumns({f"_{n}": F.struct(F.try_variant_get("_v", p, "string").alias("text"), F.coalesce(F.schema_of_variant(F.try_variant_get("_v", p, "variant")), F.lit("VOID")).alias("type")) for n, p in places.items()})
    at, type_ = lambda n: F.col(f"_{n}.text"), lambda n: F.col(f"_{n}.type")
    text = lambda n: F.when((type_(n) == "VOID") | (type_(n) == "BOOLEAN") & (at(n) == "false") | (type_(n) != "STRING") & at(n).isin("0", "[]", "{}"), "").otherwise(F.coalesce(at(n), F.lit("")))

    def exact(name: str) -> Column:
        """A field as a whole number, null if it is none; texts of digits count, truth values do not."""
        digits = F.when(at(name).rlike(r"^\s*[+-]?\d+\s*$"), F.trim(at(name)).try_cast("decimal(38,9)"))
        return F.when(type_(name) == "STRING", digits).when(type_(name) != "BOOLEAN", at(name).try_cast("decimal(38,9)"))

    event = F.when((type_("event_id") == "STRING") & (at("event_id") != ""), at("event_id"))
    record = F.coalesce(event, F.when((F.col("source_kind") == "es_backfill") & (F.col("legacy_id") != ""), F.col("legacy_id")))
    rules = F.transform(F.coalesce(F.expr("try_variant_get(_v, '$.detections', 'array<variant>')"), F.array().cast("array<variant>")), lambda d: F.try_variant_get(d, "$.rule_id", "string"))
    types = F.when(type_("types").startswith("ARRAY"), F.try_variant_get("_v", "$.attack_type", "array<string>")).otherwise(F.split(text("types"), ","))
    tidy = lambda a: F.array_sort(F.array_distinct(F.filter(F.transform(a, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))))
    read = {
        "_event": event, "_record": record, "_at": strict_time(at("time")), "_ip6": canonical_ip(text("ip")), "_status_n": exact("status"), "_bytes_n": exact("bytes"),
        "_version": F.when(F.col("source_kind") == "kafka", F.col("source_offset") + 2).otherwise(1).cast("long"), "_types_a": tidy(types), "_rules_a": tidy(rules), "_taken": strict_time(at("ingested")),
    }
    rows = rows.withColumns(read)
    c = F.col
    bad = lambda name, most: (type_(name) != "VOID") & ~F.coalesce((c(f"_{name}_n") == F.floor(f"_{name}_n")) & c(f"_{name}_n").between(0, F.lit(str(most)).cast("decimal(20,0)")), F.lit(False))
    error = (
        F.when(c("raw_payload").isNull(), "not a log object").when(c("_record").isNull(), "event id is missing").when(F.length("_record") > 255, "record id is too long")
        .when(F.lit(kind != "raw") & ~type_("log_context").startswith("OBJECT") & (type_("log_context") != "VOID"), "log context is invalid").when(c("_at").isNull(), "event time is invalid")
        .when(c("_at") > now_ms + 300_000, "event time is in the future").when(c("_ip6").isNull(), "ip is invalid").when(at("ingested").isNotNull() & c("_taken").isNull(), "ingest time is invalid")
        .when(bad("status", 65535), "status is invalid").when(bad("bytes", 2**64 - 1), "bytes are invalid").when(~F.coalesce(c("_version") >= 1, F.lit(False)), "source version is invalid")
    )
    made = {
        "record_id": c("_record"), "event_id": F.coalesce("_event", F.lit("")), "event_time": c("_at"), "ingested_at": F.coalesce("_taken", "source_ms"), "archived_at": F.lit(now_ms).cast("long"), "ip": c("_ip6"),
        **{n: text(n) for n in words}, "status": c("_status_n").try_cast("int"), "bytes": c("_bytes_n").try_cast("decimal(20,0)"), "log_source": text("source"),
        "attack_types": c("_types_a"), "rule_ids": c("_rules_a"), "payload_hash": F.sha2("raw_payload", 256), "schema_version": F.lit(1), "version": c("_version"),
    }
    return rows.select(*[made[c].alias(c) if c in made else F.col(c) for c in RECORD], error.alias("error"))


def dead_letter(rows: DataFrame, payload: str, reason: str, stage: str, error: str, source: str = "raw-logs") -> DataFrame:
    """Dead-letter envelopes; an id is made from the payload where there is none."""
    return rows.select(
        F.coalesce("event_id", F.sha2(F.col(payload), 256)).alias("event_id"), F.lit(reason).alias("reason"), F.lit(stage).alias("stage"), F.col(error).alias("error_message"), F.lit("ValidationError").alias("error_type"),
        F.substring(payload, 1, 2048).alias("message"), F.array(F.lit("dlq"), F.lit(stage)).alias("tags"), F.lit("pending").alias("status"), F.lit(0).alias("retry_count"), F.lit(source).alias("source_topic"), F.col(payload).alias("original_payload"),
    )


def flatten_event(messages: DataFrame, col: str = "message") -> DataFrame:
    """Seven fields of a JSON event, from log_entry.log_context, log_context or the top, else 'unknown'."""
    names = ["event_id", "ip", "path", "method", "status", "user_agent", "attack_type"]
    at = lambda n: F.coalesce(*[F.get_json_object(col, f"$.{p}{n}") for p in ("log_entry.log_context.", "log_context.", "log_entry.", "")], F.lit("unknown")).alias(n)
    return messages.select(*[at(n) for n in names])


def request_payload(rows: DataFrame, fields: list[str], user: str = "log_{event_id}") -> DataFrame:
    """event_id, inputs (JSON of the fields, null ones as "unknown") and user, from a template over columns; a template that
    names a column which is null or is not there gives log_unknown."""
    inputs = F.to_json(F.struct(*[F.coalesce(F.col(f).cast("string"), F.lit("unknown")).alias(f) for f in fields if f in rows.columns]))
    parts = re.split(r"\{(\w+)\}", user)
    pieces = [F.lit(p) if i % 2 == 0 else F.col(p).cast("string") if p in rows.columns else F.lit(None).cast("string") for i, p in enumerate(parts)]
    return rows.select("event_id", inputs.alias("inputs"), F.coalesce(F.concat(*pieces), F.lit("log_unknown")).alias("user"))


def report_record(rows: DataFrame) -> DataFrame:
    """Report rows: lower-case risk, status of at most 0 and unknown or empty ips null, safe integer score."""
    return rows.select("event_id", F.lower("risk_level").alias("risk_level"), F.when(F.col("status") > 0, F.col("status")).alias("status"), F.when(~F.col("ip").isin("unknown", ""), F.col("ip")).alias("ip"), F.coalesce(F.col("risk_score").cast("string").try_cast("int"), F.lit(0)).alias("risk_score"))


def with_degraded(events: DataFrame, results: DataFrame) -> DataFrame:
    """events with their analysis; without one the AI fields are empty, the score 0 and `degraded` is set."""
    r = results.select("event_id", F.col("risk_score").alias("_score"), F.col("risk_level").alias("_level"))
    joined = events.join(r, "event_id", "left")
    none = F.col("_score").isNull()
    return joined.select("event_id", "detect_type", F.when(none, 0).otherwise(F.col("_score")).alias("risk_score"), F.when(none, "").otherwise(F.col("_level")).alias("risk_level"), none.alias("degraded"))


def first_detection(events: DataFrame) -> DataFrame:
    d = F.get("detections", F.lit(0))
    return events.select("event_id", d["rule_id"].alias("rule_id"), F.get(d["matches"], F.lit(0))["matched_value"].alias("matched_value"))
