"""Evaluation of retrieval and of agent trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def retrieval_metrics(golden: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, method, recall5, recall10, mrr, self5. golden: query_id, expected (array), self_id; hits: query_id, method, source_id, rank.

    An expected id that ends in :: stands for any id that starts with it.
    """
    want = golden.select("query_id", "self_id", F.explode(F.array_distinct("expected")).alias("want"))
    methods = hits.select("method").distinct()
    base = want.join(F.broadcast(methods))
    h = hits.select("query_id", "method", "source_id", "rank")
    match = F.when(F.col("want").endswith("::"), F.col("source_id").startswith(F.col("want"))).otherwise(F.col("source_id") == F.col("want"))
    best = base.join(h, ["query_id", "method"], "left").groupBy("query_id", "method", "want").agg(F.min(F.when(match, F.col("rank"))).alias("r"))
    out = best.groupBy("query_id", "method").agg((F.count_if(F.col("r") <= 5) / F.count("*")).alias("recall5"), (F.count_if(F.col("r") <= 10) / F.count("*")).alias("recall10"), F.coalesce(1 / F.min("r"), F.lit(0.0)).alias("mrr"))
    own = golden.where("self_id is not null").select("query_id", "self_id").join(h, "query_id").groupBy("query_id", "method").agg(F.max(((F.col("source_id") == F.col("self_id")) & (F.col("rank") <= 5)).cast("int")).alias("self5"))
    return out.join(own, ["query_id", "method"], "left")


def averages(metrics: DataFrame) -> DataFrame:
    """Means by method, overall and by category."""
    g = metrics.groupingSets([["method"], ["method", "category"]], "method", "category")
    means = [F.round(F.avg(c), 6).alias(c) for c in ("recall5", "recall10", "mrr", "self5")]
    return g.agg(F.count("*").alias("n"), *means).select("method", F.coalesce("category", F.lit("overall")).alias("category"), "n", "recall5", "recall10", "mrr", "self5")


def share(part: Column, whole: Column, none: float) -> Column:
    return F.when(F.size(whole) == 0, F.lit(none)).otherwise(F.size(part) / F.size(whole))


def correctness(text: Column, keys: Column) -> Column:
    """Share of the expected keywords in the text, whatever the case; none expected: 0."""
    return share(F.filter(keys, lambda k: F.contains(F.lower(text), F.lower(k))), keys, 0.0)


def overlap(found: Column, expected: Column) -> Column:
    """Share of the expected set that was found; nothing expected: 1."""
    return share(F.array_intersect(found, expected), F.array_distinct(expected), 1.0)


def case_metrics(calls: DataFrame, expected_tools: list[str]) -> DataFrame:
    """For each case: steps, wasted calls (failed or without ids), tool_recall, evidence, answer length."""
    e = F.array(*[F.lit(t) for t in expected_tools])
    by = calls.groupBy("case_id").agg(F.count("*").alias("steps"), F.count_if(~F.col("ok") | (F.col("source_id") == "")).alias("wasted"), F.collect_set("tool").alias("tools"), F.countDistinct(F.when(F.col("source_id") != "", F.col("source_id"))).alias("evidence"), F.max_by(F.length("text"), F.when(F.col("role") == "assistant", F.col("step"))).alias("answer_chars"))
    return by.select("case_id", "steps", "wasted", F.round(overlap(F.col("tools"), e), 6).alias("tool_recall"), "evidence", "answer_chars")


def decisions(rows: DataFrame, col: str = "actions") -> DataFrame:
    """Counts of replan, compact, continue (whatever the case), and whether the case finished."""
    n = lambda k: F.size(F.filter(col, lambda x: F.lower(x) == k)).alias(k)
    return rows.select("case_id", n("replan"), n("compact"), n("continue"), F.exists(col, lambda x: F.lower(x) == "finish").alias("finished"))


#: Means of a variant, and the share of finished cases.
MEANS = ("correctness", "evidence_coverage", "tool_recall", "wasted_calls", "steps_to_finish", "finish_rate", "replan", "compact")


def per_case(states: DataFrame, calls: DataFrame, golden: DataFrame) -> DataFrame:
    """One row for each case of golden (case_id, scenario, expected_keys, expected_source_ids, expected_tools).

    states: case_id, report, finish_reason, actions (of its decisions in order). calls: case_id, step, role, text, tool, ok,
    source_id. Without a report the answer is the last text of the assistant that is not empty. steps_to_finish is the number
    of calls. Cases without state or calls have found nothing; what is not expected counts as found, but no keyword at all
    is a correctness of 0.
    """
    said = F.when((F.col("role") == "assistant") & (F.col("text") != ""), F.col("step"))
    by = calls.groupBy("case_id").agg(
        F.count("tool").alias("steps"), F.count_if(F.col("tool").isNotNull() & (~F.col("ok") | (F.coalesce("source_id", F.lit("")) == ""))).alias("wasted"), F.collect_set("tool").alias("tools"),
        F.collect_set(F.when(F.col("source_id") != "", F.col("source_id"))).alias("found"), F.max_by("text", said).alias("last"),
    )
    j = golden.join(states, "case_id", "left").join(by, "case_id", "left")
    none = F.array().cast("array<string>")
    of = lambda name: F.coalesce(F.col(name), none)
    count = lambda k: F.size(F.filter(of("actions"), lambda x: F.lower(x) == k))
    answer = F.coalesce(F.when(F.col("report") != "", F.col("report")), F.col("last"), F.lit(""))
    return j.select(
        "case_id", "scenario", answer.alias("answer"), F.when(answer == "", 0.0).otherwise(correctness(answer, of("expected_keys"))).alias("correctness"), overlap(of("found"), of("expected_source_ids")).alias("evidence_coverage"), overlap(of("tools"), of("expected_tools")).alias("tool_recall"),
        F.coalesce("wasted", F.lit(0)).alias("wasted_calls"), F.coalesce("steps", F.lit(0)).alias("steps_to_finish"), count("replan").alias("replan"), count("compact").alias("compact"), count("continue").alias("continue"),
        F.exists(of("actions"), lambda x: F.lower(x) == "finish").alias("finished"), (F.coalesce("finish_reason", F.lit("")) != "").alias("has_finish_reason"),
    )


def averages_of_variants(cases: DataFrame, names: list[str]) -> DataFrame:
    """metric, and the mean of each named variant side by side, for MEANS and `count`; a variant without cases has zeros."""
    rows = cases.withColumn("finish_rate", F.col("finished").cast("double"))
    by = rows.groupBy("variant").agg(F.count("*").cast("double").alias("count"), *[F.round(F.avg(F.col(m).cast("double")), 6).alias(m) for m in MEANS])
    long = by.select("variant", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in ("count", *MEANS)])).alias("e")).select("variant", "e.*")
    every = long.sparkSession.createDataFrame([(m,) for m in ("count", *MEANS)], "metric string")
    return every.join(long.groupBy("metric").pivot("variant", names).agg(F.first("v")), "metric", "left").na.fill(0.0)


def variants(cases: DataFrame, names: list[str]) -> DataFrame:
    """metric, and a column of means for each variant, side by side."""
    means = cases.groupBy("variant").agg(*[F.round(F.avg(F.col(n).cast("double")), 6).alias(n) for n in names])
    long = means.select("variant", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("v")) for n in names])).alias("e")).select("variant", "e.*")
    return long.groupBy("metric").pivot("variant", ["baseline", "upgraded"]).agg(F.coalesce(F.first("v"), F.lit(0.0))).na.fill(0.0)


def gate(calls: DataFrame, budget: int, max_tokens: int = 8000, least: int = 2, hypotheses: int = 0) -> DataFrame:
    """case_id and the reasons for which a trajectory is looked at again, in fixed order.

    An evidence is an id, or without one the first 50 characters of its text, once for each case. risk_level, if calls has it,
    is that of a call's evidence. The budget is nearly spent with a fifth of it left, or one call.
    """
    w = Window.partitionBy("case_id").orderBy(F.desc("step"))
    back = F.max(F.col("ok").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    risk = F.col("risk_level") if "risk_level" in calls.columns else F.lit(None).cast("string")
    evidence = F.when(F.coalesce("source_id", F.lit("")) != "", F.col("source_id")).otherwise(F.substring("text", 1, 50))
    rows = calls.withColumns({"k": F.row_number().over(w), "trailing": (back == 0).cast("int"), "_risk": F.when(risk != "", risk), "_evidence": evidence})
    last = F.col("k") <= 2
    by = rows.groupBy("case_id").agg(
        F.max_by("ok", "step").alias("last_ok"), F.sum("trailing").alias("trail"), F.countDistinct("_evidence").alias("evidence"), F.max_by(F.coalesce("source_id", F.lit("")), "step").alias("last_id"), F.count("*").alias("steps"), F.sum("tokens").alias("tokens"),
        (F.count_if(last & (F.coalesce("args", F.lit("")) != "")) == 2).alias("two"), F.countDistinct(F.when(last, F.col("args"))).alias("different"), F.countDistinct("_risk").alias("risks"),
    )
    failed, conflict = ~F.col("last_ok") | (F.col("trail") >= 2), F.col("risks") > 1
    near = (budget - F.col("steps") <= max(1, int(budget * 0.2))) if budget else F.lit(True)
    why = [
        ("last_failed", ~F.col("last_ok")), ("repeated_failures", F.col("trail") >= 2), ("little_evidence", F.col("evidence") < least), ("conflict", conflict), ("budget", near), ("tokens", F.col("tokens") >= max_tokens),
        ("same_arguments", F.col("two") & (F.col("different") == 1)), ("no_ids", F.col("last_id") == ""), ("covered", F.lit(hypotheses > 0) & (F.col("evidence") >= hypotheses)), ("change_direction", conflict & failed),
    ]
    return by.select("case_id", F.array_join(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in why]), lambda x: x.isNotNull()), ",").alias("reasons"))
