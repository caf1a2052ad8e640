"""Dashboards, report lists, reviews and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = ["Critical", "High", "Medium", "Low", "Normal"]
#: Fixed values of a review.
VERDICTS = ["correct", "false_positive", "partially_correct", "uncertain"]
CATEGORIES = ["real_attack", "scanner_probe", "normal_business", "rule_misfire", "ai_misjudgment", "other"]
ACTIONS = ["ignored", "observed", "ip_blocked", "waf_rule_added", "incident_created", "notified", "other"]
UNCERTAIN_ACTIONS = ["observed", "ignored", "other"]


def threat_levels(reports: DataFrame, since_ms: int | None = None) -> DataFrame:
    """level, n: five levels, zero where there are none; unknown counts as Low, blank not at all. since_ms: of later reports only."""
    reports = reports if since_ms is None else reports.where(F.col("ts_ms") >= since_ms)
    level = F.when(F.lower("risk_level") == "unknown", "Low").otherwise(F.initcap("risk_level"))
    n = reports.where(F.trim("risk_level") != "").groupBy(level.alias("level")).agg(F.count("*").alias("n"))
    all_levels = reports.sparkSession.createDataFrame([(x,) for x in LEVELS], "level string")
    return all_levels.join(F.broadcast(n), "level", "left").select("level", F.coalesce("n", F.lit(0)).alias("n"))


def report_counts(reports: DataFrame, today_ms: int) -> DataFrame:
    c = lambda e: F.count_if(F.expr(e))
    return reports.agg(F.count("*").alias("total"), c("risk_level in ('high', 'critical')").alias("high"), c("risk_level = 'medium'").alias("medium"), c(f"ts_ms >= {today_ms}").alias("new_today"), c("review_status = 'pending'").alias("pending"), c("review_status = 'claimed'").alias("claimed"), c(f"review_status = 'processed' and claimed_ms >= {today_ms}").alias("processed_today"))


def volume(n: Column) -> Column:
    """A count for a card: millions with one decimal, whole thousands, or as it is."""
    thousands = F.concat(F.floor(n / 1000).cast("string"), F.lit("K"))
    return F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1_000_000)).when(n >= 1000, thousands).otherwise(n.cast("string"))


def dashboard(logs: DataFrame, reports: DataFrame, today_ms: int) -> DataFrame:
    a = logs.agg(F.count_if(F.col("ts_ms") >= today_ms).alias("today"), F.count("*").alias("all_time"))
    b = reports.agg(F.count_if(F.col("ts_ms") >= today_ms).alias("reports_today"), F.count_if((F.col("ts_ms") >= today_ms) & F.col("risk_level").isin("critical", "high")).alias("severe_today"))
    return a.join(F.broadcast(b)).withColumn("today_text", volume(F.col("today")))


def next_reports(reports: DataFrame, now_ms: int, k: int, exclude: str | None = None) -> DataFrame:
    """The queue: pending, or claimed for more than 30 minutes; highest score, then newest."""
    open_ = (F.col("review_status") == "pending") | ((F.col("review_status") == "claimed") & (F.col("claimed_ms") < now_ms - 1_800_000))
    rows = reports.where(open_)
    return (rows.where(F.col("event_id") != exclude) if exclude else rows).orderBy(F.desc("risk_score"), F.desc("ts_ms"), "event_id").limit(k).select("event_id", "risk_score", "ts_ms")


def listing(reports: DataFrame, keyword: str = "", number: int = 1, size: int = 20, order: str = "risk_score", **equal: str) -> DataFrame:
    """A page of reports: equal filters, a keyword in type, ip or path whatever the case, a known order."""
    if order not in {"risk_score", "ts_ms"}:
        raise ValueError("unknown order")
    word = keyword.lower()
    rows = reports.where(F.lower("detect_type").contains(word) | F.lower("ip").contains(word) | F.lower("path").contains(word))
    for k, v in equal.items():
        rows = rows.where(F.col(k) == v)
    return rows.orderBy(F.desc(order), "event_id").offset((number - 1) * size).limit(size)


def review_states(reviews: DataFrame) -> DataFrame:
    """event_id, seq, change (created or revised) and whether the row is the current one."""
    up = Window.partitionBy("event_id").orderBy("at_ms", "seq")
    down = Window.partitionBy("event_id").orderBy(F.desc("at_ms"), F.desc("seq"))
    return reviews.withColumns({"change": F.when(F.row_number().over(up) == 1, "created").otherwise("revised"), "current": F.row_number().over(down) == 1})


def report_details(reports: DataFrame, logs: DataFrame, reviews: DataFrame) -> DataFrame:
    """Each report with its log line's bytes, current review and last change."""
    now = review_states(reviews).where("current").select("event_id", "verdict", "change")
    return reports.join(logs.select("event_id", "bytes"), "event_id", "left").join(now, "event_id", "left").select("event_id", "risk_level", "bytes", "verdict", "change")


def review_errors(rows: DataFrame, actions: Column) -> DataFrame:
    """errors of a review (verdict, category, comment, actions) and its actions, each once, in order.

    verdict and category are of fixed values, the trimmed comment has 5 characters or more; up to seven actions, of fixed
    values, and of three only where the verdict is `uncertain`.
    """
    among = lambda c, values: F.coalesce(F.col(c).isin(values), F.lit(False))
    given = F.coalesce(actions, F.array().cast("array<string>"))
    other = lambda values: F.size(F.array_except(given, F.array(*[F.lit(v) for v in values]))) > 0
    bad = other(ACTIONS) | (F.size(given) > 7) | ((F.col("verdict") == "uncertain") & other(UNCERTAIN_ACTIONS))
    errs = F.array(F.when(~among("verdict", VERDICTS), "verdict"), F.when(~among("category", CATEGORIES), "category"), F.when(F.length(F.trim(F.coalesce("comment", F.lit("")))) < 5, "comment"), F.when(bad, "actions"))
    return rows.select("event_id", "seq", F.array_join(F.filter(errs, lambda x: x.isNotNull()), ",").alias("errors"), F.array_join(F.array_distinct(given), ",").alias("actions"))


def usage(calls: DataFrame, by: str, value: str, total: str) -> DataFrame:
    """calls, ok, failed and a sum for each group, with the grand total."""
    return calls.rollup(by).agg(F.count("*").alias("calls"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"), F.sum(value).alias(total)).select(F.coalesce(by, F.lit("TOTAL")).alias(by), "calls", "ok", "failed", total)
