"""BM25 and cosine search against brute force: filters, id lists, blocks, ties, nulls, other lengths."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lograil.operators import lexical, vectors


def best(docs, queries, k, keep, hidden=lambda q, d: False):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    bags = [(d, Counter(words(t)), len(words(t))) for d, _, _, t in docs]
    n, average = len(bags), sum(x for *_, x in bags) / len(bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for q, text in queries:
        asked, hits = Counter(words(text)), []
        for (doc, bag, size), row in zip(bags, docs, strict=True):
            s = sum(c * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * bag[t] * 2.2 / (bag[t] + 1.2 * (0.25 + 0.75 * size / average)) for t, c in asked.items() if t in bag)
            if s > 0 and doc is not None and keep(row) and not hidden(q, doc):
                hits.append((-round(s, 6), doc))
        out += [(q, d, -s, r) for r, (s, d) in enumerate(sorted(hits)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("size", [6, 1 << 16])
def test_bm25_equals_brute_force(spark, monkeypatch, size):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(30)] + ["The", "the", "É", "x_y"]
    docs = [(f"d{i}", rng.choice("ab"), rng.choice(["xss", "sql", None]), " ".join(rng.choices(vocabulary, k=rng.randint(0, 30)))) for i in range(250)] + [("n", "a", "xss", None), (None, "a", "xss", "the w1"), ("t1", "a", "xss", "w1 w2"), ("t0", "a", "xss", "w2 w1")]
    queries = [(i, " ".join(rng.choices(vocabulary, k=4))) for i in range(15)] + [(90, ""), (91, "nowhere"), (92, None)]
    monkeypatch.setattr(lexical, "TERMS", size)
    monkeypatch.setattr(lexical, "CELLS", 300)
    c = spark.createDataFrame(docs, "source_id string, source_type string, attack_type string, content string")
    q = spark.createDataFrame([(*r, "d7") for r in queries], "query_id long, text string, own string")
    got = lambda **more: sorted(tuple(r) for r in lexical.bm25(c, q, 6, **more).select("query_id", "source_id", "score", "rank").collect())
    assert got() == best(docs, queries, 6, lambda r: True)
    ids = spark.createDataFrame([(f"d{i}",) for i in range(0, 250, 3)] + [("d0",)], "source_id string")
    assert got(source_type="a", attack_type="xss", ids=ids) == best(docs, queries, 6, lambda r: r[1] == "a" and r[2] == "xss" and r[0][1:].isdigit() and r[0][0] == "d" and int(r[0][1:]) % 3 == 0)
    assert got(exclude="own") == best(docs, queries, 6, lambda r: True, lambda q, d: d == "d7")
    assert lexical.bm25(c.limit(0), q, 6).count() == 0 == lexical.bm25(c, q.limit(0), 6).count()


def nearest(rows, queries, k, hidden):
    out = []
    for q, v in queries:
        if v is None or not any(v):
            continue
        hits = [(-round((1 + float(np.dot(v, x)) / (np.linalg.norm(v) * np.linalg.norm(x))) / 2, 6), i) for i, x in rows if x and len(x) == len(v) and any(x) and all(y is not None and math.isfinite(y) for y in x) and i != q and (q, i) not in hidden and i is not None]
        out += [(q, i, -s, r) for r, (s, i) in enumerate(sorted(hits)[:k], 1)]
    return sorted(out)


def test_knn_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + rng.normal(size=8) * 0.1).tolist()) for i in range(600)] + [(1000 + i, [1.0, float(i)]) for i in range(20)] + [(2000 + i, rows_[1]) for i, rows_ in enumerate([(0, [1.0] * 8)] * 60)]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 8), (3003, [float("nan")] * 8), (3004, [1.0, None] + [0.0] * 6), (None, [1.0] * 8), (3005, [1e300] * 8), (3006, [5.0])]
    queries = [(i, rows[i][1]) for i in range(0, 600, 50)] + [(1003, [1.0, 3.0]), (9000, [1.0] * 8), (9001, [0.0] * 8), (9002, None), (9003, [1.0, 2.0, 3.0])]
    hidden = {(0, 12), (0, 24), (50, 62)} | {(9000, 2000 + i) for i in range(30)}
    c = spark.createDataFrame(rows, "source_id long, embedding array<double>")
    q = spark.createDataFrame(queries, "query_id long, embedding array<double>")
    not_ = spark.createDataFrame(list(hidden), "query_id long, source_id long")
    for more in ({}, {"pivots": 5, "chunk": 20}):
        got = sorted((r.query_id, r.source_id, r.score, r["rank"]) for r in vectors.knn(c, q, 7, exclude=not_, **more).collect())
        assert got == nearest(rows, queries, 7, hidden)
    even = sorted((r.query_id, r.source_id, r.score, r["rank"]) for r in vectors.knn(c, q, 7, where=F.col("source_id") % 2 == 0).collect())
    assert even == nearest([r for r in rows if r[0] is not None and r[0] % 2 == 0], queries, 7, set())
    assert vectors.knn(c.limit(0), q, 3).count() == 0 == vectors.knn(c, q.limit(0), 3).count()


def test_bm25_parts_are_bounded_and_change_nothing(spark, monkeypatch):
    from lograil.operators import lexical

    assert list(lexical._parts(np.array([3, 0, 5]), 2)) == [(0, 2), (2, 3)]
    monkeypatch.setattr(lexical, "PAIRS", 10)
    assert list(lexical._parts(np.array([4, 6, 1, 99, 2, 2]), 100)) == [(0, 2), (2, 3), (3, 4), (4, 6)]
    docs = spark.createDataFrame([(f"d{i:03}", " ".join(f"w{j}" for j in range(i % 9 + 1)) + f" x{i % 4}") for i in range(300)], "source_id string, content string").repartition(2)
    asked = spark.createDataFrame([(q, f"w{q} x{q % 4} w0 w0") for q in range(12)], "query_id long, text string")
    few = sorted(map(tuple, lexical.bm25(docs, asked, 5).collect()))
    monkeypatch.undo()
    assert few == sorted(map(tuple, lexical.bm25(docs, asked, 5).collect())) and len(few) == 60
