"""Readers, message shapes, the followed corpus and published versions."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from lograil.operators import corpus, logquery, normalize
from lograil.sources import files, ledger
from lograil.sources.ledger import Batch
from lograil.streaming import jobs

DAY = 86_400_000


def test_lines_and_json_messages(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\n\n   \ntwo \xff\n")
    lines = files.read_lines(spark, str(tmp_path / "a.log"))
    assert [r.line[:3] for r in lines.orderBy("line").collect()] == ["one", "two"]
    rows, bad = files.read_json(spark.createDataFrame([('{"a": 1}',), ("oops",), ('{"a": "x", "b": 2}',), (None,)], "value string"), "a int, b int")
    assert sorted((r.a, r.b) for r in rows.where("a is not null").collect()) == [(1, None)] and rows.count() == 2
    assert sorted(str(r[0]) for r in bad.collect()) == ["None", "oops"]


def test_golden_sets(spark, tmp_path):
    good = {"query": "q", "expected_source_ids": ["a"]}
    (tmp_path / "g.jsonl").write_text("\n".join(["", "# note", "  # note", json.dumps(good), json.dumps(good | {"category": "knowledge", "self_event_id": "e"}), "{broken", json.dumps({"query": "q"}), json.dumps(good | {"expected_source_ids": []})]))
    got = sorted(map(tuple, files.read_golden(spark, str(tmp_path / "g.jsonl")).select("query", "expected_source_ids", "self_event_id", "category").collect()), key=str)
    assert got == [("q", ["a"], "e", "knowledge"), ("q", ["a"], None, "case")]


def test_markdown_trees(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("---\ndoc_id: a\nattack_type: xss\n---\n# Title\n## One\nx\n## Two\ny\n")
    (tmp_path / "sub" / "b.md").write_text("# No front matter\n## One\n")
    pages = files.read_markdown(spark, str(tmp_path))
    assert sorted(r.file.rsplit("/", 1)[-1] for r in pages.collect()) == ["a.md", "b.md"]
    assert [r.source_id for r in corpus.markdown_chunks(pages).orderBy("source_id").collect()] == ["a::0", "a::1"]


def test_quarantine_and_keyed_messages_to_several_sinks(spark, tmp_path):
    bad = spark.createDataFrame([("t", 1, 5, "é\x00", "why")], "topic string, part int, off long, value string, error string")
    q = files.quarantine(bad).first()
    assert json.loads(q.source) == {"topic": "t", "part": 1, "off": 5} and base64.b64decode(q.raw).decode() == "é\x00" and q.error == "why"
    events = spark.createDataFrame([("e1", "xss"), ("e2", "sql")], "event_id string, attack_type string")
    messages = files.keyed_messages(events)
    topics = [str(tmp_path / t) for t in ("save", "notify")]
    for _ in range(2):
        ledger.fan_out(messages, Batch("send", "r", 0), {t: {"part": F.lit("all")} for t in topics})
    for t in topics:
        got = ledger.read(spark, t, messages.schema).orderBy("key").collect()
        assert [(r.key, json.loads(r.value)["attack_type"]) for r in got] == [("e1", "xss"), ("e2", "sql")]


def test_too_many_groups_are_an_error(spark):
    rows = spark.range(30).select((F.col("id") % 10).alias("ip"))
    assert logquery.counts(rows, "ip", most=10).count() == 10
    with pytest.raises(Exception, match="more than 9 groups"):
        logquery.counts(rows, "ip", most=9).collect()


def test_request_payloads(spark):
    rows = spark.createDataFrame([("1", "a", None), (None, "b", 5)], "event_id string, ip string, status int")
    got = normalize.request_payload(rows, ["ip", "status"]).collect()
    assert [(json.loads(r.inputs), r.user) for r in got] == [({"ip": "a", "status": "unknown"}, "log_1"), ({"ip": "b", "status": "5"}, "log_unknown")]


def test_the_corpus_follows_notices(spark, tmp_path):
    clock, base, archive = [100 * DAY], str(tmp_path / "out"), [("old", DAY, "x"), ("now", 99 * DAY, "first"), ("soon", 101 * DAY, "later")]
    events = lambda: spark.createDataFrame(archive, "record_id string, event_time long, path string")
    made = lambda rows: rows.select(F.col("record_id").alias("source_id"), F.lit("case").alias("source_type"), F.lit("xss").alias("attack_type"), F.col("path").alias("content"), F.col("event_time").alias("created_at"))
    schema = "notice_id long, record_id string"

    def turn(*rows, checkpoint="ck"):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.follow_corpus(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), events, base, str(tmp_path / checkpoint), lambda: clock[0], documents=made).awaitTermination()
        return {r.source_id: r.content for r in jobs.followed_corpus(spark, base, clock[0] - 90 * DAY).collect()}

    assert turn((1, "old"), (2, "now"), (3, "soon"), (4, "gone")) == {"now": "first"}
    archive[1] = ("now", 99 * DAY, "second")
    clock[0] = 102 * DAY
    assert turn((5, "now")) == {"now": "second", "soon": "later"}
    assert turn((6, "other"), checkpoint="new") == {"now": "second", "soon": "later"}  # all notices again
    del archive[1]
    assert turn((7, "now"), checkpoint="new") == {"soon": "later"}
    clock[0] = 300 * DAY
    assert turn((8, "x"), checkpoint="new") == {}  # expired


def test_published_versions(spark, tmp_path):
    base, df = str(tmp_path / "corpus"), spark.createDataFrame([("a", "x")], "source_id string, content string")
    assert corpus.pointed(spark, base) == 0
    assert corpus.publish(df.limit(0), base) == 0 and corpus.publish(df, base) == 3
    assert corpus.publish(df.limit(0), base) == 3 and corpus.publish(df, base) == 5
    cases = spark.createDataFrame([("a", "case", 5), ("b", "case", None), ("c", "knowledge", 1), ("d", "case", 9)], "source_id string, source_type string, created_at long")
    assert sorted(r.source_id for r in corpus.expired(cases, 9).collect()) == ["b", "c", "d"]
