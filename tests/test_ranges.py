"""Scans over range partitions and what is built on them, against brute force."""

import random
from collections import Counter

from pyspark.sql import functions as F

from lograil.operators import corpus, evaluate, iforest, verify
from lograil.operators.ranges import scan


def test_scan_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice([*"aaaaaab", None]), i, rng.choice([None, 1, 5, 9])) for i in rng.sample(range(10_000), 700)]
    df = spark.createDataFrame(rows, "g string, o long, v long").repartition(5)
    found = scan(df, ["g"], ["o"], {"s": ("sum", F.col("v"), "before"), "m": ("max", F.col("v"), "before"), "n": ("min", F.col("o"), "after"), "t": ("sum", F.lit(1), "after")})
    for r in found.collect():
        before = [v for g, o, v in rows if g == r.g and o < r.o and v is not None]
        after = [o for g, o, _ in rows if g == r.g and o > r.o]
        assert (r.s, r.m, r.n, r.t) == (sum(before), max(before, default=None), min(after, default=None), len(after))
    assert scan(df.limit(0), ["g"], ["o"], {"s": ("sum", F.col("v"), "before")}).count() == 0


def chunks(rows, span):
    out = {}
    for ip in {r[0] for r in rows}:
        start = None
        for _, t, e in sorted((r for r in rows if r[0] == ip and r[1] is not None), key=lambda r: (r[1], r[2])):
            if start is None or t - start > span:
                start = t
                out[ip, start] = []
            out[ip, start].append((t, e))
    return out


def test_anchored_sessions_of_a_busy_ip_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [("busy", rng.randrange(40_000), str(i)) for i in range(3000)] + [(rng.choice(["x", "y", None]), rng.randrange(400_000), str(5000 + i)) for i in range(300)]
    rows += rows[:40] + [("x", None, "none"), ("busy", 1_000_000, "late"), ("busy", 1_000_300, "edge"), ("busy", 1_000_301, "next")]
    df = spark.createDataFrame([(*r, "GET", f"/{r[2]}", 200, "z") for r in rows], "ip string, ts_ms long, event_id string, method string, path string, status int, request string")
    want = chunks(rows, 300)
    got = corpus.anchored_sessions(df, 300).collect()
    assert {(r.ip, r.start_ms): (r.end_ms, r.n) for r in got} == {k: (v[-1][0], len(v)) for k, v in want.items()} and len(got) == len(want) > 150
    for r in got:
        shown = "; ".join(f"GET /{e} 200" for _, e in want[r.ip, r.start_ms][:5]) + (f"; ...(+{r.n - 5} more)" if r.n > 5 else "")
        assert r.content == f"ip={r.ip if r.ip else 'null'} 在 [{r.start_ms}~{r.end_ms}] 发起 {r.n} 次请求: {shown}"
    idle = {(r.ip, r.start_ms): (r.end_ms, r.n) for r in corpus.idle_sessions(df, 300).collect()}
    assert idle["busy", 1_000_000] == (1_000_301, 3) and sum(n for _, n in idle.values()) == len(rows) - 1
    assert corpus.anchored_sessions(df.limit(0), 300).count() == 0 == corpus.idle_sessions(df.limit(0), 300).count()


def test_no_plan_of_sessions_has_a_window_by_ip_alone(spark):
    df = spark.createDataFrame([("a", 1, "e", "GET", "/", 200)], "ip string, ts_ms long, event_id string, method string, path string, status int")
    assert "Pandas" not in corpus.anchored_sessions(df)._jdf.queryExecution().toString()


def test_manifest_tree(spark):
    rows = [(str(i), f"h{i % 7}") for i in range(3000)]
    df = spark.createDataFrame(rows, "record_id string, payload_hash string")
    assert verify.manifest(df).first() == verify.manifest(df.repartition(9)).first()
    twice = spark.createDataFrame([*rows, rows[5]], df.schema)
    both = spark.createDataFrame([*rows, rows[5], rows[5]], df.schema)
    assert len({verify.manifest(x).first().digest for x in (df, twice, both)}) == 3  # equal rows never cancel
    changed = spark.createDataFrame([*rows[1:], ("0", "other")], df.schema)
    differing = verify.manifest_differences(df, changed).collect()
    assert 1 <= len(differing) <= 2 and verify.manifest_differences(df, df).isEmpty()
    assert verify.manifest(df.limit(0)).first().n == 0


def test_split_takes_an_exact_share_of_each_label(spark):
    rows = [(str(i), "big" if i % 10 else "small" if i % 20 else None) for i in range(1001)]
    df = spark.createDataFrame(rows, "id string, label string")
    got = iforest.split(df.repartition(11), "id", "label").collect()
    again = {r.id for r in iforest.split(df.repartition(3), "id", "label").collect() if r.is_test}
    sizes, test = Counter(r.label for r in got), Counter(r.label for r in got if r.is_test)
    assert {k: test[k] for k in sizes} == {k: int(n * 0.3 + 0.5) for k, n in sizes.items()} and again == {r.id for r in got if r.is_test}


def test_curve_keeps_scores_apart_that_differ_little(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 1), -0.5 - rng.randrange(400) * 1e-9) for _ in range(2000)]
    df = spark.createDataFrame(rows, "label int, score double").repartition(6)
    got = evaluate.auc(df).first()
    p, q = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((a < b) + (a == b) / 2 for a in p for b in q) / (len(p) * len(q))
    assert abs(got.auc - want) < 1e-8 and evaluate.curve(df).count() == len({s for _, s in rows})


def test_chunks_come_from_one_range_shuffle_and_cross_partitions(spark, monkeypatch):
    rng, made = random.Random(6), []
    monkeypatch.setattr(corpus, "table", lambda df, name: made.append(df.repartitionByRange(9, "ip", "ts_ms", "event_id").withColumn("_pid", F.spark_partition_id()).localCheckpoint()) or made[-1])
    rows = [("busy", rng.choice([rng.randrange(9000), 40 * rng.randrange(200)]), f"{i:05}") for i in range(2000)] + [("z", 100 * i, f"z{i}") for i in range(400)] + [(None, 7, "n")]
    df = spark.createDataFrame([(*r, "GET", f"/{r[2]}", 200) for r in rows], "ip string, ts_ms long, event_id string, method string, path string, status int")
    for span in (0, 39, 300, 2500, 20_000):
        want = chunks(rows, span)
        got = corpus.anchored_sessions(df, span).collect()
        assert {(r.ip, r.start_ms): (r.end_ms, r.n) for r in got} == {k: (v[-1][0], len(v)) for k, v in want.items()} and len(got) == len(want)
        assert all("; ".join(f"GET /{e} 200" for _, e in want[r.ip, r.start_ms][:5]) in r.content for r in got)
    assert len(made) == 5 and made[0].select("_pid").distinct().count() == 9
