"""Language identification of texts that may mix languages.

A text is taken as a mixture of the learned languages, each a distribution over hashed character n-grams. Expectation
maximisation finds the proportions of a set of languages; the set grows by the language that helps most, as long as the
log-likelihood gains more than its penalty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lograil.llm._common import bounded_batches

#: Buckets of hashed trigrams for each language: bounds the model at BUCKETS numbers a language.
BUCKETS = 1 << 15
#: Gain of log-likelihood, in units of log(number of n-grams), that a further language must bring.
PENALTY = 8.0
ROUNDS = 12
UNKNOWN = "und"

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point, whether it is a letter; made once in each process."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def grams(text: str | None) -> np.ndarray:
    """Bucket of each trigram of the lower-cased text; runs of other characters than letters count as one space."""
    if not text:
        return np.empty(0, np.int64)
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[code]
    if not letter.any():
        return np.empty(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # a letter, or the first of a run of others behind one
    code, letter = code[keep], letter[keep]
    code = np.concatenate(([32], np.where(letter, code, 32), [32])).astype(np.uint64)
    mixed = code[:-2] * np.uint64(0x9E3779B97F4A7C15) + code[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + code[2:] * np.uint64(0x165667B19E3779F9)
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(49)).astype(np.int64) & (BUCKETS - 1)


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities [language, bucket], from counts over all rows with a text and a language.

    Each task sums its own counts; at most languages x BUCKETS rows reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(g := grams(text)):
                    own = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    own += np.bincount(g, minlength=BUCKETS)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])], names=["lang", "bucket", "n"])

    bounded_batches(labelled.sparkSession)
    kept = labelled.select(F.col(text_col).cast("string"), F.col(lang_col).cast("string")).dropna()
    rows = kept.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(rows.column("lang").to_pylist()), key=str.encode)
    table = np.full((len(names), BUCKETS), 0.5)
    place = {x: i for i, x in enumerate(names)}
    np.add.at(table, ([place[x] for x in rows.column("lang").to_pylist()], rows.column("bucket").to_numpy()), rows.column("n").to_numpy())
    return names, np.log(table / table.sum(axis=1, keepdims=True, initial=1e-300)) if names else table


def mixture(counts: np.ndarray, prob: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions that EM finds for a set of languages, and the log-likelihood. prob: [language, n-gram]."""
    share = np.full(len(prob), 1 / len(prob))
    for _ in range(ROUNDS if len(prob) > 1 else 0):
        joint = share[:, None] * prob
        now = (joint / joint.sum(axis=0)) @ counts / counts.sum()
        if np.abs(now - share).max() < 1e-4:
            share = now
            break
        share = now
    return share, float(counts @ np.log(share @ prob))


def infer(g: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Proportion of each learned language in a text's n-grams; zeros without n-grams or languages."""
    out = np.zeros(len(logs))
    if not len(g) or not len(logs):
        return out
    if len(g) > BUCKETS:  # a very long text costs no more than its different buckets
        counts = np.bincount(g, minlength=BUCKETS)
        g = np.flatnonzero(counts)
        counts = counts[g].astype(float)
    else:
        counts = np.ones(len(g))
    own = logs[:, g]
    single = own @ counts
    chosen = [int(single.argmax())]
    share, best = np.ones(1), float(single[chosen[0]])
    fine = PENALTY * np.log(max(counts.sum(), 2.0))
    shift = own.max(axis=0)
    room = float(counts @ shift) - best  # no mixture can gain more
    if room > fine and len(logs) > 1:
        prob, base = np.exp(own - shift), float(counts @ shift)
        while len(chosen) < len(logs):
            tries = [(mixture(counts, prob[[*chosen, k]]), k) for k in range(len(logs)) if k not in chosen]
            (more, value), k = max(tries, key=lambda t: (t[0][1], -t[1]))
            if value + base - best <= fine:
                break
            chosen, share, best = [*chosen, k], more, value + base
    out[chosen] = share
    return out


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The kept columns, lang_pred, score (its proportion) and mixture (array of lang, share above zero, largest first).

    A map over Arrow batches; the model is bounded by languages x BUCKETS and broadcast. Texts that are null, empty or
    without a letter, and all texts where nothing was learned, are `und` with score 0; ties go to the first language by
    code point; whole texts are read; repeated rows pass through.
    """
    names, logs = model
    shared = docs.sparkSession.sparkContext.broadcast((names, logs))
    bounded_batches(docs.sparkSession)
    kept = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, logs = shared.value
        for batch in batches:
            preds, scores, mixed = [], [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                share = infer(grams(text), logs)
                order = [i for i in np.argsort(-share, kind="stable") if share[i] > 0]
                preds.append(names[order[0]] if order else UNKNOWN)
                scores.append(float(min(1.0, share[order[0]])) if order else 0.0)
                mixed.append([{"lang": names[i], "share": float(share[i])} for i in order])
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(mixed, kind)], names=[*keep, "lang_pred", "score", "mixture"])

    fields = [f"`{c}` {t}" for c, t in docs.select(*keep).dtypes]
    return kept.mapInArrow(run, ", ".join([*fields, "lang_pred string, score double, mixture array<struct<lang:string,share:double>>"]))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, mixture: one row for each row of docs.

    Learns from text and language of rows whose crc32 of the id as text, mod 3, is not 1 (nulls are left out of learning and
    are not held out); predicts every row from its text alone. See `predict` for nulls, empty texts and ties.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = train(rows.where(part != 1))
    return predict(rows.withColumn("held_out", F.coalesce(part == 1, F.lit(False))), model, keep=("doc_id", "held_out"))


def keep_identified(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: float = 0.5) -> DataFrame:
    """docs whose text has a known language that makes up at least `least` of it; all columns are kept.

    Learns from all rows with a text and a language. Texts that are null, empty or without a letter go, as do all where
    nothing was learned; repeated rows stay or go together; extra columns stay as they are; an empty table gives no rows.
    """
    rows = docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("_t"))
    return predict(rows, train(docs, text_col, lang_col), "_t", keep=("_row",)).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("_row.*")
