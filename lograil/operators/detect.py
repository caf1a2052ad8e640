"""Rule detection: patterns as column expressions, evaluated where the rows are, without a shuffle or Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograil.operators.rules import LIBRARIES, PROFILES, Profile, dialect, validate

MATCH = "array<struct<field:string,pattern_id:string,matched_value:string>>"


def union_of(patterns: list[tuple[str, str]]) -> str:
    """One alternation of a library's patterns, each with its own flags."""
    flagged = [(rx[2 : rx.index(")")], rx[rx.index(")") + 1 :]) if rx.startswith("(?i") else ("", rx) for rx in (dialect(rx) for _, rx in patterns)]
    return "|".join(f"(?{fl}:{rx})" if fl else f"(?:{rx})" for fl, rx in flagged)


def matches(field: str, patterns: list[tuple[str, str]]) -> Column:
    """The patterns found in a field, in order; single patterns are only tried where the alternation finds one."""
    each = F.array(*[F.when(F.col(field).rlike(dialect(rx)), F.struct(F.lit(field).alias("field"), F.lit(pid).alias("pattern_id"), F.col(field).alias("matched_value"))) for pid, rx in patterns])
    found = F.col(field).isNotNull() & (F.col(field) != "") & F.col(field).rlike(union_of(patterns))
    return F.when(found, F.filter(each, lambda x: x.isNotNull())).otherwise(F.array().cast(MATCH))


def detections(profiles: list[Profile] = PROFILES, libraries: dict[str, list[tuple[str, str]]] = LIBRARIES) -> Column:
    """Array of detections (rule_id, attack_type, matches) of the enabled profiles that have a match."""
    validate(profiles, libraries)
    own = [F.struct(F.lit(p.id).alias("rule_id"), F.lit(p.attack_type).alias("attack_type"), F.concat(*[matches(f, libraries[p.library]) for f in p.fields]).alias("matches")) for p in profiles if p.enabled]
    return F.filter(F.array(*own), lambda d: F.size(d["matches"]) > 0)


def detect(logs: DataFrame, profiles: list[Profile] = PROFILES, libraries: dict[str, list[tuple[str, str]]] = LIBRARIES) -> DataFrame:
    """Rows with a detection: the log's columns, detections and attack_type (types joined by commas, in order).

    Detections come out of a generator, below which no filter is pushed: patterns are tried once a row, not again in a filter.
    """
    found = logs.drop("detections").select("*", F.explode(F.array(detections(profiles, libraries))).alias("detections")).where(F.size("detections") > 0)
    return found.withColumn("attack_type", F.array_join(F.transform("detections", lambda d: d["attack_type"]), ","))


def security_events(logs: DataFrame, original: str = "path", profiles: list[Profile] = PROFILES, libraries: dict[str, list[tuple[str, str]]] = LIBRARIES) -> DataFrame:
    """event_id, attack_type, detections and log_context with the raw and the decoded path."""
    context = F.struct("ip", "method", F.col(original).alias("path"), F.col("path").alias("normalized_path"), "status", "bytes", "referrer", "user_agent", F.col("ts_ms").alias("timestamp"))
    return detect(logs, profiles, libraries).select("event_id", "attack_type", "detections", context.alias("log_context"))


def flat_matches(events: DataFrame, key: str = "event_id") -> DataFrame:
    """One row for each event, rule, field and pattern."""
    each = events.select(key, F.explode("detections").alias("d")).select(key, "d.rule_id", F.explode("d.matches").alias("m"))
    return each.select(key, "rule_id", "m.field", "m.pattern_id", "m.matched_value")
