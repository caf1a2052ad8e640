"""Toxicity: a logistic classifier of words and word beginnings, regularised by counterfactuals.

Features of a text are its different lower-cased words and their beginnings of 3 to 6 letters. How many toxic and other
documents hold each is counted over all training rows; the FEATURES that tell most (by log-likelihood ratio) are the model.
Its weights are fitted on a bounded sample of the training rows. In the sentences of the sample identity terms are swapped
for others of their kind; the squared change of the score's logit, times `penalty`, is added to the loss, so a group's
name cannot carry weight of its own and neutral mentions of a group are not marked.

Nulls and empty texts hold no feature: their score is that of the intercept. Rows without a label, or whose label's
document is missing, do not train; a document with several labels counts as toxic if one says so. Without training rows,
or with one class alone, no feature tells anything and the score is the share of toxic rows (0 without rows). Texts of
any length are read whole; repeated rows are scored alike; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lograil.llm._common import bounded_batches, materialize

#: Features of the model, and the labelled rows that its weights are fitted on at most (chosen by a hash).
FEATURES, SAMPLE = 2048, 16_384
#: Labels (12 bytes each) that are sent to all executors at most, so that texts need no shuffle; more of them are joined with one.
SENT = 1 << 22
#: Documents that must hold a feature.
LEAST = 3
BEGINNINGS = (3, 4, 5, 6)
ROUNDS = 200
RIDGE = 1e-4
PENALTY = 1.0

#: Identity terms by kind; a term is swapped for the others of its kind.
IDENTITIES = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "lesbian", "bisexual", "transgender", "straight"), ("black", "white", "asian", "latino", "indigenous"),
    ("africans", "americans", "asians", "europeans", "arabs", "mexicans"), ("african", "american", "european", "arab", "mexican"),
    ("immigrants", "refugees", "citizens"), ("immigrant", "refugee", "citizen"), ("disabled", "blind", "deaf"), ("old", "young", "elderly"),
)

_WORD = re.compile(r"[^\W\d_]+")


def features(words: set[str]) -> set[str]:
    """The words, marked by a final blank, and their beginnings."""
    out = {f"{w} " for w in words}
    for k in BEGINNINGS:
        out |= {w[:k] for w in words if len(w) >= k}
    return out


def swaps(words: set[str]) -> Iterator[tuple[set[str], set[str]]]:
    """Features that leave and enter a text of these words when an identity term in it is swapped for another of its kind."""
    for kind in IDENTITIES:
        for term in words.intersection(kind):
            whole, rest = features(words), features(words - {term})
            for other in kind:
                if other != term:
                    swapped = rest | features({other})
                    yield whole - swapped, swapped - whole


def labelled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, y) of the training rows: documents with a label whose crc32(doc_id) mod 5 is not 0."""
    own = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("y"))
    own = materialize(own, "labels")
    rows = documents.select("doc_id", "text").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    return rows.join(F.broadcast(own) if own.count() <= SENT else own, "doc_id")


def counted(rows: DataFrame) -> DataFrame:
    """(feature, toxic, other): documents of each kind that hold a feature; tasks sum before the shuffle and hold a bounded table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[int]] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v[1] for v in sums.values()], pa.int64()), pa.array([v[0] for v in sums.values()], pa.int64())], names=["feature", "toxic", "other"])
            sums.clear()
            return out

        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for f in features(set(_WORD.findall(text.as_py().lower()))):
                    sums.setdefault(f, [0, 0])[y] += 1
                if len(sums) > 500_000:
                    yield flush()
        if sums:
            yield flush()

    bounded_batches(rows.sparkSession)
    found = rows.where("text is not null").select("text", "y").mapInArrow(run, "feature string, toxic long, other long")
    return found.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def chosen(counts: DataFrame, toxic: int, other: int, most: int = FEATURES) -> list[str]:
    """The features with the largest log-likelihood ratio between the kinds, `most` at most; ties by feature."""
    n = toxic + other
    term = lambda held, size: F.when(held > 0, held * F.log(held * n / (F.lit(float(size)) * (F.col("toxic") + F.col("other"))))).otherwise(0.0)
    missed = lambda held, size: F.when(size - held > 0, (size - held) * F.log((size - held) * n / (F.lit(float(size)) * (n - F.col("toxic") - F.col("other"))))).otherwise(0.0)
    ratio = term(F.col("toxic"), toxic) + term(F.col("other"), other) + missed(F.col("toxic"), toxic) + missed(F.col("other"), other)
    best = counts.where(f"toxic + other >= {LEAST}").select("feature", ratio.alias("g")).where("g > 6.63")
    return [r[0] for r in best.orderBy(F.desc("g"), "feature").limit(most).collect()]


def fit(rows: DataFrame, n: int, names: list[str], sample: int = SAMPLE, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """Weights and intercept of the features, on about `sample` of the n training rows, never more.

    Tasks turn texts into feature numbers; the driver holds those of the bounded sample alone.
    """
    place = {f: i for i, f in enumerate(names)}
    numbers = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, gone, come = [], [], []
            for text in batch.column(0):
                words = set(_WORD.findall((text.as_py() or "").lower()))
                out.append(sorted(place[f] for f in features(words) if f in place))
                pairs = [([place[f] for f in sorted(a) if f in place], [place[f] for f in sorted(b) if f in place]) for a, b in swaps(words)]
                pairs = [p for p in pairs if p[0] or p[1]]
                gone.append([p[0] for p in pairs])
                come.append([p[1] for p in pairs])
            yield pa.RecordBatch.from_arrays([pa.array(out, numbers), batch.column(1), pa.array(gone, pa.list_(numbers)), pa.array(come, pa.list_(numbers))], names=["f", "y", "gone", "come"])

    some = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, 0.95 * sample / max(n, 1))))
    got = some.select("text", "y").mapInArrow(run, "f array<int>, y int, gone array<array<int>>, come array<array<int>>").limit(sample).toArrow().combine_chunks()
    y = got.column("y").to_numpy().astype(float)
    if not len(y):
        return np.zeros(len(names)), -np.inf

    def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of a column of lists, and the row that each stands in."""
        lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32), np.repeat(np.arange(len(lists), dtype=np.int32), np.diff(lists.offsets.to_numpy()))

    at, row = flat(got.column("f"))
    # a swap's change of the logit is the weights of what came less those of what went
    went, came = (got.column(x).combine_chunks().flatten() for x in ("gone", "come"))
    (g_at, g_row), (c_at, c_row) = flat(went), flat(came)
    s_at, s_row, s_sign, pairs = np.concatenate([g_at, c_at]), np.concatenate([g_row, c_row]), np.repeat([-1.0, 1.0], [len(g_at), len(c_at)]), len(went)
    share = y.mean()
    if share in (0.0, 1.0):
        return np.zeros(len(names)), np.inf if share else -np.inf
    w, b = np.zeros(len(names)), float(np.log(share / (1 - share)))
    # Adam: steps do not depend on how often a feature occurs
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, ROUNDS + 1):
        p = 1 / (1 + np.exp(-(np.bincount(row, w[at], len(y)) + b)))
        error = (p - y) / len(y)
        g = np.append(np.bincount(at, error[row], len(w)) + RIDGE * w, error.sum())
        if pairs:
            change = np.bincount(s_row, s_sign * w[s_at], pairs)
            g[:-1] += 2 * penalty * np.bincount(s_at, s_sign * change[s_row], len(w)) / pairs
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, b = w - move[:-1], b - float(move[-1])
    return w, b


def train(documents: DataFrame, labels: DataFrame, penalty: float = PENALTY) -> tuple[list[str], np.ndarray, float]:
    """Features, weights and intercept from the training rows."""
    rows = materialize(labelled(documents, labels), "labelled")
    toxic, n = rows.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count("*")).first()
    names = chosen(counted(rows), toxic, n - toxic) if 0 < toxic < n else []
    return names, *fit(rows, n, names, penalty=penalty)


def score(documents: DataFrame, names: list[str], weights: np.ndarray, intercept: float) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model = {f: float(w) for f, w in zip(names, weights, strict=True) if w}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, ...]] = {}  # the features of the model that a word holds
        for batch in batches:
            out = []
            for text in batch.column(2):
                held: set[str] = set()
                for w in set(_WORD.findall((text.as_py() or "").lower())):
                    own = known.get(w)
                    if own is None:
                        if len(known) > 200_000:
                            known.clear()
                        own = known[w] = tuple(f for f in features({w}) if f in model)
                    held.update(own)
                z = intercept + sum(model[f] for f in sorted(held))
                out.append(z)
            with np.errstate(over="ignore"):
                s = 1 / (1 + np.exp(-np.array(out, float)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    bounded_batches(documents.sparkSession)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", held.alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
