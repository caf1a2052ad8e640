"""Evaluation of binary detectors; curves are summed over distinct scores, never over rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lograil.operators.ranges import scan


def outcome(rows: DataFrame) -> DataFrame:
    o = F.when((F.col("label") == 1) & (F.col("predicted") == 1), "tp").when(F.col("label") == 1, "fn").when(F.col("predicted") == 1, "fp").otherwise("tn")
    return rows.withColumn("outcome", o)


def confusion(rows: DataFrame) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, accuracy, specificity; 0 where a divisor is."""
    c = outcome(rows).agg(*[F.count_if(F.col("outcome") == k).alias(k) for k in ("tp", "fp", "fn", "tn")])
    ratio = lambda a, b: F.coalesce(F.expr(f"({a}) / nullif({b}, 0)"), F.lit(0.0))
    c = c.withColumns({"precision": ratio("tp", "tp + fp"), "recall": ratio("tp", "tp + fn"), "accuracy": ratio("tp + tn", "tp + fp + fn + tn"), "specificity": ratio("tn", "tn + fp")})
    return c.withColumn("f1", ratio("2 * tp", "2 * tp + fp + fn"))


def curve(rows: DataFrame) -> DataFrame:
    """threshold, tp, fp, tpr, fpr, precision for each distinct score, most anomalous (lowest) first.

    Counts up to a threshold are prefix sums over ranges of scores, so no task holds all scores.
    """
    by = rows.groupBy(F.col("score").alias("threshold")).agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("q"))
    total = rows.agg(F.sum("label").alias("all_p"), F.sum(1 - F.col("label")).alias("all_q"))
    c = scan(by, [], ["threshold"], {"_p": ("sum", F.col("p"), "before"), "_q": ("sum", F.col("q"), "before")}).withColumns({"tp": F.col("_p") + F.col("p"), "fp": F.col("_q") + F.col("q")}).join(F.broadcast(total))
    return c.select("threshold", "p", "q", "tp", "fp", (F.col("tp") / F.col("all_p")).alias("tpr"), (F.col("fp") / F.col("all_q")).alias("fpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), "all_p", "all_q")


def auc(rows: DataFrame) -> DataFrame:
    """auc (label 1 has the lower scores), auc_as_reported (of the scores as they are), average_precision."""
    c = curve(rows)
    return c.agg(F.round(F.sum(F.col("q") * (F.col("tp") - F.col("p") / 2)) / F.max(F.col("all_p") * F.col("all_q")), 9).alias("auc"), F.round(F.sum(F.col("p") / F.col("all_p") * F.col("precision")), 9).alias("average_precision")).withColumn("auc_as_reported", F.round(1 - F.col("auc"), 9))


def histogram(rows: DataFrame, bins: int = 50) -> DataFrame:
    """label, bin (from 0), n, density over each class's range."""
    r = rows.groupBy("label").agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.count("*").alias("total"))
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("score") - F.col("lo")) / width), F.lit(bins - 1))).cast("int")
    j = rows.join(F.broadcast(r), "label").select("label", b.alias("bin"), "total", width.alias("width")).groupBy("label", "bin", "total", "width").agg(F.count("*").alias("n"))
    return j.select("label", "bin", "n", F.round(F.col("n") / (F.col("total") * F.col("width")), 6).alias("density"))
