"""Small cases with known results."""

import math

import pytest
from pyspark.sql import functions as F

from lograil.functions.decode import canonical, decode_text, source_ids
from lograil.functions.times import relative_range
from lograil.operators import corpus, detect, features, iforest, normalize, retrieve, verify
from lograil.operators.logquery import QuerySpec
from lograil.operators.rules import LIBRARIES, Profile, validate
from lograil.sources import files, ledger
from lograil.streaming import jobs


def test_decoder():
    assert decode_text("%2527%20or%201+1") == "' or 1+1"
    assert decode_text("&lt;script&gt;") == "<script>"
    assert decode_text("\\u003cscript\\u003e") == "<script>"
    assert decode_text("\\u00") == "\\u00" and decode_text("%zz") == "%zz" and decode_text(None) is None


def test_canonical_json():
    assert canonical('{"b": 1, "a": "é"}') == '{"a":"é","b":1}'
    assert canonical("[NaN]") is None and canonical("x") is None


def test_ranges_and_specs():
    assert relative_range("1h", 7_200_000) == (3_600_000, 7_200_000) and relative_range("all", 5) == (0, 5)
    for bad in ({"port": 1}, {"status": 70000}, {"path": "x" * 1025}):
        with pytest.raises(ValueError):
            QuerySpec(0, 1, bad)


def test_rules_refuse_bad_packs():
    with pytest.raises(ValueError):
        validate([Profile("a", "a", "nothing")], LIBRARIES)
    with pytest.raises(ValueError):
        validate([Profile("a", "a", "xss"), Profile("a", "a", "xss")], LIBRARIES)


def test_pipeline_of_one_log(spark):
    raw = spark.createDataFrame([("1", "1.1.1.1", "get", "/q?x=%2527%2520or%25201=1", "200", "", "a", 5, "7"), ("2", None, "get", "/", "x", None, None, 5, ""), ("3", "1.1.1.1", "get", "/index", "200", None, None, 5, "")], "event_id string, ip string, method string, path string, status string, referrer string, user_agent string, ts_ms long, bytes string")
    rows = normalize.normalize(raw)
    got = {r["event_id"]: r for r in rows.collect()}
    assert got["1"]["path"] == "/q?x=' or 1=1" and got["1"]["bytes"] == 7 and got["2"]["error"] == "missing fields: ip" and got["3"]["error"] is None
    events = detect.security_events(rows.where("error is null"), "original_path").collect()
    assert [e["event_id"] for e in events] == ["1"] and events[0]["attack_type"] == "sql_injection" and events[0]["log_context"]["path"].startswith("/q?x=%2527")


def test_merge_replay_is_idempotent(spark):
    a = spark.createDataFrame([("r", 1, 1), ("s", 5, 1)], "record_id string, version int, off int")
    b = spark.createDataFrame([("r", 2, 2), ("s", 4, 2)], "record_id string, version int, off int")
    once = verify.merge(a, b)
    assert sorted(map(tuple, once.collect())) == [("r", 2, 2), ("s", 5, 1)] == sorted(map(tuple, verify.merge(once, b).collect()))


def test_anchored_sessions(spark):
    m = 60_000
    logs = spark.createDataFrame([("a", t * m, str(t), "GET", "/", 200) for t in (0, 4, 6, 8, 20)], "ip string, ts_ms long, event_id string, method string, path string, status int")
    got = sorted((r["start_ms"] // m, r["end_ms"] // m, r["n"]) for r in corpus.anchored_sessions(logs).collect())
    assert got == [(0, 4, 2), (6, 8, 2), (20, 20, 1)]


def test_forest_ignores_partitions_and_finds_the_odd_one(spark):
    rows = spark.range(400).select(F.col("id").cast("string").alias("event_id"), (F.col("id") % 7).cast("double").alias("x"), F.when(F.col("id") == 5, 99.0).otherwise((F.col("id") % 5).cast("double")).alias("y"))
    one = {r["event_id"]: r["score"] for r in iforest.score(rows, iforest.fit(rows, ["x", "y"], trees=20), ["x", "y"]).collect()}
    many = rows.repartition(7)
    two = {r["event_id"]: r["score"] for r in iforest.score(many, iforest.fit(many, ["x", "y"], trees=20), ["x", "y"]).collect()}
    assert one == pytest.approx(two) and min(one, key=one.get) == "5" and all(-1 <= v < 0 for v in one.values())


def test_source_ids(spark):
    df = spark.createDataFrame([('{"a": [{"event_id": "1"}, {"x": {"id": 2}}]}',), ("no",)], "j string")
    assert [r[0] for r in df.select(source_ids("j")).collect()] == [["1", "2"], []]


def test_streams_equal_batches(spark, tmp_path):
    src = spark.range(60).select(F.concat(F.lit("10.0.0."), (F.col("id") % 3).cast("string")).alias("ip"), F.timestamp_millis(F.col("id") * 600_000).alias("ts"))
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = jobs.hourly(stream).writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(n) from hours").first()[0] == 60 and spark.table("hours").count() == 10


def test_knn_takes_any_number_of_queries(spark):
    rows = spark.range(60_000).select(F.col("id").alias("query_id"), F.array(F.cos("id"), F.sin("id")).alias("embedding"))
    found = retrieve.knn(rows.where("query_id < 30").withColumnRenamed("query_id", "source_id"), rows, 3, chunk=8)
    got = found.groupBy("query_id").count().agg(F.count("*"), F.min("count"), F.max("count")).first()
    assert tuple(got) == (60_000, 3, 3)
    for q in (0, 17, 59_999):
        want = sorted((i for i in range(30) if i != q), key=lambda i: (-round((1 + math.cos(i - q)) / 2, 6), i))[:3]
        assert [r["source_id"] for r in found.where(f"query_id = {q}").orderBy("rank").collect()] == want


def test_csv_tables_in_and_out(spark, tmp_path):
    (tmp_path / "in.csv").write_text('Method,URI,User-Agent,Class\nGET,"/a?q=""x, y""",Mozilla,Valid\nPOST,/etc/passwd,curl,Anomalous\nGET,/b,,Other\n')
    rows = files.read_requests(spark, str(tmp_path / "in.csv"))
    assert [tuple(r) for r in rows.orderBy("path").collect()][0] == ("GET", '/a?q="x, y"', "Mozilla", "Valid")
    made = features.labelled(rows)
    files.write_table(made, str(tmp_path / "out"))
    back = spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "out"))
    assert back.columns == made.columns and {r["label_int"]: r["uri_length"] for r in back.collect()} == {0: 11, 1: 11}
    assert files.read_requests(spark, str(tmp_path / "out")).where("method is not null").isEmpty()


def test_future_notices_wait_for_their_time(spark, tmp_path):
    day, clock = 86_400_000, [100 * 86_400_000]
    events = spark.createDataFrame([("old", day), ("now", 99 * day), ("soon", 101 * day)], "record_id string, event_time long")
    schema = "notice_id long, record_id string"

    def turn(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        jobs.follow_corpus(stream, lambda: events, str(tmp_path / "out"), str(tmp_path / "ck"), lambda: clock[0]).awaitTermination()
        acts = events.select(F.lit(0).cast("long").alias("notice_id"), "record_id", F.lit("").alias("action")).schema
        return {(r["notice_id"], r["action"]) for r in ledger.read(spark, str(tmp_path / "out/actions"), acts).collect()}

    assert turn((1, "old"), (2, "now"), (3, "soon"), (4, "gone")) == {(1, "remove"), (2, "upsert"), (4, "remove")}
    clock[0] = 102 * day
    assert turn((5, "now")) == {(1, "remove"), (2, "upsert"), (4, "remove"), (3, "upsert"), (5, "upsert")}


def test_scores_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def run(frames):
        for pdf in frames:
            seen.add(len(pdf))
            yield pdf.assign(score=-pdf["id"] / 100.0)

    scored = spark.range(100).mapInPandas(run, "id long, score double")
    assert iforest.predict(scored).where("predicted = 1").count() == 9 and seen.value == 100


def test_patterns_are_tried_once_a_row(spark):
    logs = spark.range(3).selectExpr("id as event_id", "'/admin/' as path", "cast(id as string) as referrer").repartition(2)
    plan = detect.flat_matches(detect.detect(logs))._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "Filter" in line and "RLIKE" in line.upper()] and "RLIKE" in plan.upper()
    assert detect.detect(logs.withColumn("detections", F.lit(1))).columns.count("detections") == 1


def test_payload_is_written_once(monkeypatch):
    from lograil.functions import decode

    made = []
    monkeypatch.setattr(decode, "_dumped", lambda v: made.append(v) or "x")
    monkeypatch.setattr(decode.json, "dumps", lambda *a, **k: made.append(a))
    assert decode._payload('{"b": 1, "_storage": {"x": 2}}') == "x" and made == [{"b": 1}]
    monkeypatch.undo()
    assert decode._payload('{"b": [1.0, "\\u00e9"], "_storage": 5, "a": 1}') == '{"a":1,"b":[1.0,"é"]}'
    assert decode._payload('{"a": NaN}') is None and decode._payload("[1]") is None and decode._payload(None) is None
