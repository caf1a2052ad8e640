"""Retrieval: BM25, exact cosine search, rank fusion, evidence packs, and query texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lograil.operators.lexical import bm25, ranked
from lograil.operators.vectors import knn


def fuse(routes: list[DataFrame], k: int = 60, top: int = 10) -> DataFrame:
    """Reciprocal rank fusion: query_id, source_id, score, sources, rank; blank ids of different routes stay apart."""
    tagged = [r.select("query_id", "source_id", "rank", F.lit(i).alias("route")) for i, r in enumerate(routes)]
    rows = tagged[0]
    for t in tagged[1:]:
        rows = rows.unionByName(t)
    key = F.when(F.trim("source_id") == "", F.concat(F.lit("route:"), "route", F.lit(":"), "rank")).otherwise(F.col("source_id"))
    merged = rows.groupBy("query_id", key.alias("key")).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"), F.min_by("source_id", "route").alias("source_id"), F.array_sort(F.collect_set("route")).alias("sources"))
    return ranked(merged.drop("key"), top)


def hybrid(queries: DataFrame, lexical: DataFrame, dense: DataFrame, k: int) -> DataFrame:
    """Both routes: fused; one: that route; none: no rows. Candidates are the first 2k of each route; `fused` says which."""
    fused = fuse([lexical.where(f"rank <= {2 * k}"), dense.where(f"rank <= {2 * k}")], top=k)
    n = lexical.groupBy("query_id").agg(F.lit(1).alias("a")).join(dense.groupBy("query_id").agg(F.lit(1).alias("b")), "query_id", "full").select("query_id", (F.col("a").isNotNull() & F.col("b").isNotNull()).alias("fused"))
    return queries.select("query_id").join(fused, "query_id").join(n, "query_id")


def dual_pack(knowledge: DataFrame, cases: DataFrame, n_knowledge: int = 3, n_cases: int = 5) -> DataFrame:
    """Knowledge hits first, then cases, numbered in one list for each query."""
    both = knowledge.where(f"rank <= {n_knowledge}").select("query_id", "source_id", "rank", F.lit(0).alias("route")).unionByName(cases.where(f"rank <= {n_cases}").select("query_id", "source_id", "rank", F.lit(1).alias("route")))
    return both.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("route", "rank")))


def merge_evidence(old: DataFrame, new: DataFrame) -> DataFrame:
    """The first occurrence of each evidence stays; key: the id, else the first 50 characters of the text. Where the rows name
    their `sources`, an evidence has those of all its occurrences, in order, each once."""
    both = old.withColumn("_o", F.lit(0)).unionByName(new.withColumn("_o", F.lit(1)))
    key = F.when(F.coalesce(F.trim("source_id"), F.lit("")) != "", F.col("source_id")).otherwise(F.substring("content", 1, 50))
    names = [c for c in both.columns if c not in ("_o", "query_id", "sources")]
    found = [F.min_by(F.struct(*names), F.struct("_o", "rank")).alias("_first")]
    if "sources" in both.columns:
        listed = F.array_sort(F.collect_list(F.struct("_o", "rank", "sources")))
        found.append(F.array_distinct(F.flatten(F.transform(listed, lambda x: F.coalesce(x["sources"], F.array().cast("array<string>"))))).alias("sources"))
    out = both.groupBy("query_id", key.alias("_key")).agg(*found)
    return out.select("query_id", *[F.col("_first")[c].alias(c) for c in names], *(["sources"] if "sources" in both.columns else []))


def case_query(logs: DataFrame) -> DataFrame:
    """attack type, IP, method and path, status, and 100 characters of the agent."""
    return logs.select("event_id", F.concat_ws(" ", "attack_type", F.concat(F.lit("IP "), "ip"), F.concat_ws(" ", "method", "path"), F.concat(F.lit("status "), F.col("status").cast("string")), F.when(F.col("user_agent") != "", F.substring("user_agent", 1, 100))).alias("query"))


#: Search words by attack type; what a missing item may name; fields of a tool's record with their labels; names of its lists and ids.
TERMS = {"sql_injection": "SQL 注入", "xss": "XSS 跨站脚本", "command_injection": "命令注入 RCE", "path_traversal": "路径遍历", "sensitive_access": "敏感文件访问"}
KEYWORDS = ["SQL注入", "SQLi", "XSS", "路径遍历", "命令注入", "扫描", "爆破", "WebShell", "敏感访问"]
RECORD_FIELDS = [
    ("ip", "IP="), ("client_ip", "IP="), ("method", ""), ("path", ""), ("url", ""), ("status", "status="), ("status_code", "status="), ("attack_type", "attack="), ("matched_type", "matched="), ("risk_level", "risk="),
    ("severity", "severity="), ("timestamp", "ts="), ("time", "ts="),
]
LISTS, IDS = ["logs", "events", "reports", "items", "results"], ["event_id", "source_id", "_id", "id"]


def knowledge_query(logs: DataFrame) -> DataFrame:
    """The search words of the first attack type (or the type itself), and the path."""
    first = F.trim(F.get(F.split("attack_type", ","), F.lit(0)))
    words = F.create_map(*[F.lit(x) for kv in TERMS.items() for x in kv])
    named = F.coalesce(F.try_element_at(words, first), first)
    return logs.select("event_id", F.concat_ws(" ", F.when(named != "", named), F.when(F.col("path") != "", F.col("path"))).alias("query"))


def follow_up(logs: DataFrame, rnd: int, keywords: list[str] = KEYWORDS) -> DataFrame:
    """Round 0: ip, type and known keywords of what is missing; later rounds: ip, method, type and sqlmap, if the agent is; the path if there is nothing else."""
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    if rnd:
        parts = F.concat_ws(" ", some("ip"), some("method"), some("attack_type"), F.when(F.contains(F.lower("user_agent"), F.lit("sqlmap")), F.lit("sqlmap")))
    else:
        parts = F.concat_ws(" ", some("ip"), some("attack_type"), F.filter(F.array(*[F.lit(w) for w in keywords]), lambda w: F.contains(F.col("missing"), w)))
    return logs.select("event_id", F.when(parts != "", parts).otherwise(F.coalesce("path", F.lit(""))).alias("query"))


def tool_evidence(results: DataFrame) -> DataFrame:
    """The first 20 records of a tool's lists (arrays of structs of one type, in the order of LISTS) as evidence: call_id, i, source_id, content."""
    lists = [F.coalesce(F.col(c), F.array()) for c in LISTS if c in results.columns]
    each = results.select("call_id", F.posexplode(F.slice(F.concat(*lists), 1, 20)).alias("i", "r"))
    has = set(each.schema["r"].dataType.names)
    some = lambda k: F.when(~F.col(f"r.{k}").cast("string").isin("", "0"), F.col(f"r.{k}").cast("string"))
    text = F.concat_ws(" ", *[F.concat(F.lit(label), some(k)) for k, label in RECORD_FIELDS if k in has])
    return each.select("call_id", "i", F.coalesce(*[some(k) for k in IDS if k in has], F.lit("")).alias("source_id"), F.when(text != "", text).otherwise(F.substring(F.to_json("r"), 1, 200)).alias("content"))


def call_summary(calls: DataFrame) -> DataFrame:
    """Arguments (a map, in its order) as k=v text, and the outcome: ok(N records), ok for none, or FAIL: error."""
    args = F.array_join(F.transform(F.map_entries("args"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")
    good = F.when(F.col("n") > 0, F.concat(F.lit("ok("), F.col("n").cast("string"), F.lit(" records)"))).otherwise("ok")
    return calls.select("call_id", args.alias("args"), F.when(F.col("ok"), good).otherwise(F.concat(F.lit("FAIL: "), F.coalesce(F.when(F.col("error") != "", F.col("error")), F.lit("unknown error")))).alias("outcome"))


__all__ = ["bm25", "call_summary", "case_query", "dual_pack", "follow_up", "fuse", "hybrid", "knn", "merge_evidence", "ranked", "tool_evidence"]
