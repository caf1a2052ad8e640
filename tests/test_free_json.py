"""Addresses, answers, storage records and ids of free JSON, and rule packs from files."""

import ipaddress
import json
import random

import pytest
from pyspark.sql import functions as F

from lograil.functions import addresses, answers
from lograil.functions.decode import source_ids
from lograil.operators import detect, logquery, normalize
from lograil.sources import packs


def test_addresses_equal_the_library(spark):
    rng = random.Random(8)
    texts = ["", "1.2.3.4", "01.2.3.4", "1.2.3.256", "1.2.3", "1.2.3.4\n", "::", "::1", "1::", ":::", "1:::2", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:8:9", "::1:2:3:4:5:6:7:8", "12345::", "g::", "FE80::1%eth0", "fe80::1%", "::1%a%b", "::ffff:1.2.3.4", "::FFFF:0:1", "::1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "::1.2.3.400", "1.2.3.4::", "0:0:1:0:0:1:0:0", "1::0:0", "x", " ::1", "::1 "]
    for _ in range(1500):
        parts = [rng.choice(["0", "0", "00", "1", "ab", "0DB8", "ffff", "", "10000"][: rng.choice([7, 9])]) for _ in range(rng.choice([3, 7, 8, 8, 8, 9]))]
        texts.append(":".join(parts) if rng.random() < 0.6 else "::".join([":".join(parts[: len(parts) // 2]), ":".join(parts[len(parts) // 2 + 1 :])]))

    def want(x):
        if x == "":
            return ""
        try:
            return str(ipaddress.ip_address(x))
        except ValueError:
            return None

    rows = spark.createDataFrame([(x,) for x in [*texts, None]], "x string").select("x", addresses.canonical_ip(F.col("x")).alias("y")).collect()
    assert [(r.x, r.y) for r in rows if r.y != (want(r.x) if r.x is not None else None)] == []
    assert sum(r.y is not None and ":" in r.y for r in rows) > 300


def extracted(response, fields):
    """The same by walking Python objects."""
    found = None
    try:
        r = json.loads(response)
    except (TypeError, ValueError):
        r = {}
    r = r if isinstance(r, dict) else {}
    for place in (r.get("data"), r):
        if found is None and isinstance(place, dict) and ("outputs" in place or place is not r):
            out = place.get("outputs", {})
            if isinstance(out, dict):
                found = out.get("structured_output", out)
    if found is None:
        found = r.get("result")
    if found is None:
        found = r.get("answer")
        if isinstance(found, str):
            try:
                found = json.loads(found)
            except ValueError:
                found = None
        elif not isinstance(found, dict):
            found = None
    out = []
    for names, default in fields.values():
        value = next((found[n] for n in names if n in found), default) if isinstance(found, dict) else default
        out.append(value if isinstance(value, str) or value is None else json.dumps(value, separators=(",", ":")))
    return tuple(out)


def test_answers_equal_a_walk(spark):
    own = {"threat_level": "high", "score": 7, "summary": None, "reasoning": ["a", {"b": 1}]}
    cases = [
        {"data": {"outputs": {"structured_output": own}}, "outputs": {"risk_level": "no"}}, {"data": {"outputs": own}}, {"data": {}}, {"data": {}, "result": own}, {"data": {"outputs": [1]}, "result": own}, {"data": {"outputs": {"structured_output": None}}, "answer": own},
        {"data": "text", "outputs": own}, {"outputs": {"structured_output": None}, "result": own}, {"outputs": 5, "answer": own}, {"result": None, "answer": json.dumps(own)}, {"answer": "no JSON"}, {"answer": "null"}, {"answer": "[1]"}, {"result": [own]}, {"answer": 5}, {}, [own], {"risk_level": "top"},
        {"result": {"risk_level": None, "threat_level": "x"}}, {"data": {"outputs": None}, "result": own},
    ]
    texts = [*map(json.dumps, cases), "no JSON", "", None]
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select("x", answers.answer_fields(F.col("x")).alias("a")).collect()
    assert [(r.x, tuple(r.a), extracted(r.x, answers.FIELDS)) for r in rows if tuple(r.a) != extracted(r.x, answers.FIELDS)] == []


def test_ids_in_nested_json(spark):
    nested = {"id": 1}
    for _ in range(12):
        nested = {"x": [nested, {"event_id": "e"}]}
    texts = ['{"record_id": "no", "_source.id": "s", "id": true}', json.dumps([{"id": i} for i in range(60)]), json.dumps(nested), '{"id": 1.5, "_id": {"id": "in"}}', "null", None, "x"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "x string").select(source_ids("x")).collect()]
    assert got[0] == ["s", "True"] and got[1] == [str(i) for i in range(50)] and set(got[2]) == {"e"} and got[3] == ["in"] and got[4:] == [[], [], []]


MESSAGES = "payload string, source_kind string, source_topic string, source_partition int, source_offset long, source_ms long, legacy_id string"


def record(spark, payload, kind="raw", source="kafka", offset=3, legacy=None, now=10_000_000):
    text = payload if isinstance(payload, str | None) else json.dumps(payload)
    return normalize.storage_record(spark.createDataFrame([(text, source, "t", 0, offset, 77, legacy)], MESSAGES), kind, now).first()


def test_storage_records(spark):
    good = {"event_id": "e", "@timestamp": 5, "ip": "::0001", "status": "200", "bytes": 2**64 - 1, "method": "GET", "attack_type": ["b ", "a", "", "b"], "detections": [{"rule_id": "z"}, {"rule_id": "a"}, {}, 3, {"rule_id": ""}]}
    r = record(spark, good)
    assert len(normalize.RECORD) == 25 and r.error is None and (r.record_id, r.ip, r.status, int(r.bytes), r.version, r.ingested_at, r.attack_types, r.rule_ids) == ("e", "::1", 200, 2**64 - 1, 5, 77, ["a", "b"], ["a", "z"])
    assert record(spark, dict(reversed(good.items())) | {"_storage": {"record_id": "q"}}).payload_hash == r.payload_hash  # key order and storage's own part change nothing
    inside = record(spark, {"event_id": "e", "log_context": {"timestamp": "1970-01-01T00:00:01Z", "ip": ""}, "ingested_at": 9}, kind="events")
    assert (inside.error, inside.event_time, inside.ip, inside.ingested_at, inside.status, inside.method) == (None, 1000, "", 9, None, "")
    refused = {
        "not a log object": ["[1]", "x", None, '{"a": NaN}'], "event id is missing": [{"@timestamp": 5}, {"event_id": 5, "@timestamp": 5}], "record id is too long": [good | {"event_id": "x" * 256}], "event time is invalid": [good | {"@timestamp": "2024-01-01"}, good | {"@timestamp": None}],
        "event time is in the future": [good | {"@timestamp": 10_300_001}], "ip is invalid": [good | {"ip": "1.2.3"}, good | {"ip": 5}], "status is invalid": [good | {"status": x} for x in (65536, -1, 1.5, True, "2.0", "x")], "bytes are invalid": [good | {"bytes": x} for x in (-1, 2**64)],
    }
    for why, payloads in refused.items():
        for p in payloads:
            assert record(spark, p).error == why, p
    assert record(spark, good | {"status": 200.0, "@timestamp": 10_300_000}).error is None
    assert record(spark, {"event_id": "e", "log_context": [1]}, kind="events").error == "log context is invalid"
    old = record(spark, {"@timestamp": 5}, source="es_backfill", legacy="legacy:i:1")
    assert (old.error, old.record_id, old.event_id, old.version) == (None, "legacy:i:1", "", 1)
    assert record(spark, {"@timestamp": 5}, legacy="legacy:i:1").error == "event id is missing" and record(spark, good, offset=-2).error == "source version is invalid"


def test_an_ip_filter_is_canonical():
    assert "::1" in str(logquery.QuerySpec(0, 1, {"ip": "0::1"}).condition())
    with pytest.raises(ValueError):
        logquery.QuerySpec(0, 1, {"ip": "1.2.3"})


def write_packs(folder, version, libraries, profiles):
    for kind, items in (("regex", libraries), ("profiles", profiles)):
        (folder / f"version={version}" / kind).mkdir(parents=True)
        for name, body in items.items():
            (folder / f"version={version}" / kind / f"{name}.json").write_text(body if isinstance(body, str) else json.dumps(body))


def test_rule_packs_from_files(spark, tmp_path):
    lib = lambda name, *rx: {"id": name, "patterns": [{"id": f"{name}{i}", "regex": r} for i, r in enumerate(rx)]}
    prof = lambda name, *libs, **more: {"id": name, "attack_type": name, "target_fields": ["path"], "matchers": [{"type": "regex", "library": x} for x in libs]} | more
    write_packs(tmp_path, 1, {"b": lib("two", r"(?i)passwd"), "a": lib("one", r"select", r"union")}, {"z": prof("last", "two"), "y": prof("first", "one", "two"), "x": prof("off", "one", enabled=False)})
    write_packs(tmp_path, 10, {"a": lib("one", "index")}, {"y": prof("first", "one")})
    assert packs.versions(spark, str(tmp_path)) == [1, 10]
    logs = spark.createDataFrame([("1", "/PASSWD"), ("2", "/union select"), ("3", "/index")], "event_id string, path string")
    found = lambda v: {r.event_id: (r.attack_type, [m.pattern_id for d in r.detections for m in d.matches]) for r in detect.detect(logs, *packs.load(spark, str(tmp_path), v)).collect()}
    assert found(1) == {"1": ("first,last", ["two0", "two0"]), "2": ("first", ["one0", "one1"])}
    assert found(None) == {"3": ("first", ["one0"])}  # a changed pack changes detection
    good = lib("one", "x"), prof("p", "one")
    bad = {
        "no id": ({"a": {"patterns": []}}, {"p": good[1]}), "no patterns": ({"a": {"id": "one"}}, {"p": good[1]}), "no regex": ({"a": {"id": "one", "patterns": [{"id": "q"}]}}, {"p": good[1]}), "twice": ({"a": good[0], "b": good[0]}, {"p": good[1]}), "list": ({"a": "[1]"}, {"p": good[1]}),
        "syntax": ({"a": "{"}, {"p": good[1]}), "unknown": ({"a": good[0]}, {"p": prof("p", "none")}), "no matcher": ({"a": good[0]}, {"p": prof("p")}), "type": ({"a": good[0]}, {"p": good[1] | {"matchers": [{"type": "glob", "library": "one"}]}}),
        "fields": ({"a": good[0]}, {"p": {k: v for k, v in good[1].items() if k != "target_fields"}}), "same profile": ({"a": good[0]}, {"p": good[1], "q": good[1]}), "same pattern": ({"a": {"id": "one", "patterns": [{"id": "q", "regex": "x"}, {"id": "q", "regex": "y"}]}}, {"p": good[1]}), "pattern": ({"a": lib("one", "(")}, {"p": good[1]}),
    }
    for name, (libraries, profiles) in bad.items():
        write_packs(tmp_path / name, 1, libraries, profiles)
        with pytest.raises(Exception, match="."):
            packs.load(spark, str(tmp_path / name))
