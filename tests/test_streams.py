"""Sinks and continuous jobs: replays, new checkpoints, limits, gaps, late rows. File sources stand in for message topics."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lograil.operators import corpus
from lograil.sources import ledger
from lograil.sources.ledger import Batch
from lograil.streaming import jobs

ROW = "record_id string, version long, event_time long, kind string"
DAY = 86_400_000


def rows_of(spark, base, schema):
    return sorted(map(tuple, ledger.read(spark, str(base), spark.createDataFrame([], schema).schema).drop("ledger_part").collect()))


def append(spark, path, rows, schema, files=1):
    spark.createDataFrame(rows, schema).repartition(files).write.mode("append").parquet(str(path))


def test_put_takes_a_batch_once_and_shows_only_whole_ones(spark, tmp_path):
    base, schema = str(tmp_path / "t"), "k string, v long"
    df = lambda *r: spark.createDataFrame(list(r), schema)
    all_ = F.lit("x")
    assert ledger.put(df(("a", 1)), base, Batch("s", "r", 0), all_)
    assert not ledger.put(df(("a", 1)), base, Batch("s", "r", 0), all_)  # a replay
    assert ledger.put(df(("b", 2)), base, Batch("s", "r2", 0), all_)  # number 0 of another run is another batch
    df(("dead", 9)).withColumn("ledger_part", all_).write.partitionBy("ledger_part").parquet(f"{base}/data/ledger_folder=s-r-7")  # died before the ledger
    assert rows_of(spark, base, schema) == [("a", 1), ("b", 2)]
    assert ledger.put(df(("c", 3)), base, Batch("s", "r", 7), all_)
    assert rows_of(spark, base, schema) == [("a", 1), ("b", 2), ("c", 3)]
    assert ledger.put(df().limit(0), base, Batch("s", "r", 8), all_) and not ledger.put(df(("z", 1)), base, Batch("s", "r", 8), all_)
    assert rows_of(spark, str(tmp_path / "nothing"), schema) == []


def test_upsert_and_insert_only(spark, tmp_path):
    base, once, schema = str(tmp_path / "u"), str(tmp_path / "i"), "k string, v long, x string"
    steps = [(0, [("a", 1, "old"), ("b", 5, "b5"), ("b", 4, "b4")]), (3, [("a", 3, "new"), ("b", 2, "stale"), ("c", 1, None)]), (2, [("a", 3, "again")])]  # versions and numbers may be skipped
    for number, rows in steps:
        df = spark.createDataFrame(rows, schema)
        ledger.put(df, base, Batch("s", "r", number), ledger.key_bucket(["k"], 4), ["k"], ["v"])
        ledger.put(df, once, Batch("s", "r", number), ledger.key_bucket(["k"], 4), ["k"])
    assert rows_of(spark, base, schema) == [("a", 3, "again"), ("b", 5, "b5"), ("c", 1, None)]
    assert [r[0] for r in rows_of(spark, once, schema)] == ["a", "b", "c"] and ("a", 1, "old") in rows_of(spark, once, schema)
    before = rows_of(spark, base, schema)
    assert ledger.vacuum(spark, base) > 0 and ledger.vacuum(spark, base) == 0 and rows_of(spark, base, schema) == before
    for number, rows in steps:  # the same data under another checkpoint
        ledger.put(spark.createDataFrame(rows, schema), base, Batch("s", "other", number), ledger.key_bucket(["k"], 4), ["k"], ["v"])
        ledger.put(spark.createDataFrame(rows, schema), once, Batch("s", "other", number), ledger.key_bucket(["k"], 4), ["k"])
    assert rows_of(spark, base, schema) == before and len(rows_of(spark, once, schema)) == 3


def test_fan_out_completes_what_a_replay_finds_undone(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long")
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    ledger.put(df, a, Batch("s", "r", 0), F.lit("x"))  # the first sink was reached before the job died
    ledger.fan_out(df, Batch("s", "r", 0), {a: {"part": F.lit("x")}, b: {"part": F.lit("x"), "key": ["k"], "where": "v > 1"}})
    assert rows_of(spark, a, "k string, v long") == [("a", 1), ("b", 2)] and rows_of(spark, b, "k string, v long") == [("b", 2)]


def test_two_tiers_lose_and_double_nothing(spark, tmp_path):
    now, src, hot, cold = 30 * DAY, tmp_path / "in", tmp_path / "hot", tmp_path / "cold"
    run = lambda n, at: jobs.two_tiers(spark.readStream.schema(ROW).parquet(str(at)), str(hot), str(cold), str(tmp_path / f"ck{n}"), lambda: now).awaitTermination()
    append(spark, src, [("a", 1, 29 * DAY, "events"), ("b", 1, 2 * DAY, "raw"), ("b", 1, 2 * DAY, "raw")], ROW)
    run(1, src)
    append(spark, src, [("a", 2, 29 * DAY, "events"), ("c", 1, 28 * DAY, "raw")], ROW)
    run(1, src)
    run(1, src)
    whole = [("a", 1, 29 * DAY, "events"), ("a", 2, 29 * DAY, "events"), ("b", 1, 2 * DAY, "raw"), ("c", 1, 28 * DAY, "raw")]
    tier = [("a", 2, 29 * DAY, "events"), ("c", 1, 28 * DAY, "raw")]
    assert rows_of(spark, cold, ROW) == whole and rows_of(spark, hot, ROW) == tier
    run(2, src)  # the checkpoint was lost: the same rows come again
    assert rows_of(spark, cold, ROW) == whole and rows_of(spark, hot, ROW) == tier
    append(spark, tmp_path / "new", [("d", 1, 29 * DAY, "raw")], ROW)
    run(3, tmp_path / "new")  # a new checkpoint over new data, whose batch is number 0 too
    assert rows_of(spark, cold, ROW) == [*whole, ("d", 1, 29 * DAY, "raw")] and rows_of(spark, hot, ROW) == [*tier, ("d", 1, 29 * DAY, "raw")]


def test_limits_of_a_trigger(spark, tmp_path):
    append(spark, tmp_path / "in", [(str(i), 1, 1, "raw") for i in range(60)], ROW, files=6)
    seen = []
    for options in ({"files": 2}, {"size": "1"}, {}):
        stream = jobs.limited(spark.readStream.schema(ROW), "file", **options).parquet(str(tmp_path / "in"))
        sizes = []
        jobs.start(stream, lambda b, no, sizes=sizes: sizes.append(b.count()), str(tmp_path / f"ck{len(seen)}"), "s").awaitTermination()
        seen.append(sizes)
    assert [len(s) for s in seen] == [3, 6, 1] and all(sum(s) == 60 for s in seen)
    for bad in (("kafka", {"files": 1}), ("file", {"rows": 1}), ("file", {"files": 1, "size": "1"})):
        with pytest.raises(ValueError):
            jobs.limited(spark.readStream, bad[0], **bad[1])
    assert jobs.limited(spark.readStream, "kafka", rows=5) is not None


MESSAGE = "topic string, part long, off long, value string"


def test_a_bad_record_leaves_gap_and_quarantine_and_the_position_stays(spark, tmp_path):
    base, src = str(tmp_path / "out"), tmp_path / "in"
    broken = [True]

    def checked(batch):
        return batch.withColumn("error", F.when(F.expr("try_parse_json(value) is null") & F.lit(broken[0]), "no JSON"))

    def turn(strict):
        stream = spark.readStream.schema(MESSAGE).parquet(str(src))
        jobs.consumed(stream, checked, base, str(tmp_path / "ck"), strict, largest=40).awaitTermination()

    positions = lambda: rows_of(spark, f"{base}/positions", "topic string, part long, next_offset long")
    gaps = lambda: rows_of(spark, f"{base}/gaps", "topic string, part long, off long, resolved int")
    append(spark, src, [("t", 0, 5, '{"a": 1}'), ("t", 1, 7, "{}")], MESSAGE)
    turn(True)
    assert positions() == [("t", 0, 6), ("t", 1, 8)] and gaps() == []
    append(spark, src, [("t", 0, 6, "oops"), ("t", 0, 7, "{}"), ("t", 1, 8, "[" + "1," * 40 + "1]")], MESSAGE)
    for _ in range(2):  # the batch comes again and is refused again
        with pytest.raises(Exception, match="refused"):
            turn(True)
        assert positions() == [("t", 0, 6), ("t", 1, 8)] and gaps() == [("t", 0, 6, 0), ("t", 1, 8, 0)]
        assert len(rows_of(spark, f"{base}/rows", MESSAGE)) == 2
    kept = rows_of(spark, f"{base}/quarantine", "source string, raw string, error string, topic string, part string, off string")
    assert len(kept) == 2 and json.loads(kept[0][0])["off"] == 6 and {k[2] for k in kept} == {"no JSON", "the record is larger than 40 bytes"}
    broken[0] = False
    turn(False)  # lenient: what is valid goes on, the large one stays a gap
    assert positions() == [("t", 0, 8), ("t", 1, 9)] and gaps() == [("t", 0, 6, 1), ("t", 1, 8, 0)]
    assert [r[2] for r in rows_of(spark, f"{base}/rows", MESSAGE)] == [5, 6, 7, 7]


def test_lines_and_logs_go_to_two_sinks(spark, tmp_path):
    good = '10.0.0.1 - - [01/Jan/2024:00:00:01 +0000] "GET /a HTTP/1.1" 200 5 "-" "curl"'
    append(spark, tmp_path / "lines", [(1, good), (2, "broken")], "n long, line string")
    for n in (1, 1):
        jobs.parse_lines(spark.readStream.schema("n long, line string").parquet(str(tmp_path / "lines")), str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / f"p{n}")).awaitTermination()
    assert [len(rows_of(spark, tmp_path / t, "line string")) for t in ("ok", "bad")] == [1, 1]
    logs = "event_id string, ip string, method string, path string, status string, referrer string, user_agent string, ts_ms long, bytes string"
    append(spark, tmp_path / "logs", [("1", "1.1.1.1", "get", "/q?x=%27%20or%201=1", "200", "", "a", 5, "7"), ("2", "1.1.1.1", "get", "/index", "200", "", "a", 5, ""), ("3", None, "get", "/", "x", "", "a", 5, "")], logs)
    for n in (1, 2):
        jobs.detect_events(spark.readStream.schema(logs).parquet(str(tmp_path / "logs")), str(tmp_path / "events"), str(tmp_path / "dead"), str(tmp_path / f"d{n}"), lambda: 0).awaitTermination()
    assert rows_of(spark, tmp_path / "events", "event_id string, attack_type string") == [("1", "sql_injection")]
    assert {r[0] for r in rows_of(spark, tmp_path / "dead", "event_id string")} == {"3"}


def test_sessions_of_a_stream_with_late_rows_equal_the_batch(spark, tmp_path):
    rng, minute = random.Random(6), 60_000
    rows = [(rng.choice("ab"), DAY + rng.randrange(120) * minute) for _ in range(150)]
    rows.sort(key=lambda r: r[1] + rng.randrange(9) * minute)  # out of order, but never by the delay of 10 minutes
    for i in range(0, 150, 30):
        spark.createDataFrame(rows[i : i + 30], "ip string, t long").select("ip", F.timestamp_millis("t").alias("ts"), F.lit(i).alias("i")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([("c", 3 * DAY)], "ip string, t long").select("ip", F.timestamp_millis("t").alias("ts"), F.lit(999).alias("i")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ip string, ts timestamp, i int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = jobs.anchored_sessions(stream)
    q = out.writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = sorted(map(tuple, spark.table("late").collect()))
    logs = spark.createDataFrame([(ip, t, str(i), "GET", "/", 200) for i, (ip, t) in enumerate(rows)], "ip string, ts_ms long, event_id string, method string, path string, status int")
    assert got == sorted((r.ip, r.start_ms, r.end_ms, r.n) for r in corpus.anchored_sessions(logs).collect()) and len(got) > 20
