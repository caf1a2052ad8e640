"""Readers and writers of the platform's tables and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lograil.sources.ledger import Batch, key_bucket, put


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Access-log text without blank lines."""
    return spark.read.text(path).where(F.trim("value") != "").withColumnRenamed("value", "line")


def read_json(lines: DataFrame, schema: str, col: str = "value") -> tuple[DataFrame, DataFrame]:
    """Rows of JSON messages, and the messages that are none."""
    rows = lines.withColumn("_j", F.from_json(col, schema)).withColumn("_ok", F.expr(f"try_parse_json({col}) is not null"))
    return rows.where("_ok").select("_j.*"), rows.where("not coalesce(_ok, false)").select(col)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """A JSONL golden set: blank, comment, malformed and incomplete lines go; category defaults to case."""
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    j = F.from_json("value", "query string, expected_source_ids array<string>, self_event_id string, category string")
    return rows.select(j.alias("j")).select("j.*").where("query is not null and size(expected_source_ids) > 0").withColumn("category", F.coalesce("category", F.lit("case")))


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Labelled requests of CSV files with a header: method, path, user_agent, Class; columns that are missing are null."""
    rows = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    names = {"Method": "method", "URI": "path", "User-Agent": "user_agent", "Class": "Class"}
    return rows.select(*[(F.col(f"`{c}`") if c in rows.columns else F.lit(None).cast("string")).alias(n) for c, n in names.items()])


def write_table(rows: DataFrame, path: str) -> None:
    """Features or results as CSV files with a header."""
    rows.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def archive(rows: DataFrame, base: str, batch: Batch, key: list[str] | None = None, time: str = "event_time") -> bool:
    """Rows of one batch for the full history, by kind and month; with a key, rows that the history has are not added again."""
    month = F.concat_ws(".", "kind", F.date_format(F.timestamp_millis(time), "yyyy-MM"))
    return put(rows, base, batch, month, key)


def hot_rows(rows: DataFrame, now_ms: int, days: int = 7, time: str = "event_time") -> DataFrame:
    """Rows inside the hot tier, with their day."""
    return rows.where(F.col(time) >= now_ms - days * 86_400_000).withColumn("day", F.date_format(F.timestamp_millis(time), "yyyy-MM-dd"))


def upsert(rows: DataFrame, base: str, batch: Batch, key: str = "record_id", version: str = "version") -> bool:
    """Events: a higher or equal version of a record replaces it."""
    return put(rows, base, batch, key_bucket([key]), [key], [version])


def insert_only(rows: DataFrame, base: str, batch: Batch, key: str = "record_id") -> bool:
    """Raw rows and dead letters: a record that is there is never changed."""
    return put(rows, base, batch, key_bucket([key]), [key])


def quarantine(rows: DataFrame, error: str = "error") -> DataFrame:
    """Source position, base64 of the raw bytes, and the error."""
    return rows.select(F.to_json(F.struct("topic", "part", "off")).alias("source"), F.base64(F.col("value").cast("binary")).alias("raw"), F.col(error).alias("error"))


def keyed_messages(events: DataFrame, key: str = "event_id") -> DataFrame:
    """Key and JSON value of each event, for message sinks."""
    return events.select(F.col(key).alias("key"), F.to_json(F.struct("*")).alias("value"))
