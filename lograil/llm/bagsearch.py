"""Ranked lexical search with bag deduplication.

Of a document only the counts of terms that some item asks for can move its scores, and its length through m. Documents
that agree in both are one class: they are found by a hash of (m, counts), compared in full by the grouping, and scored
once. Scores are whole numbers, so equal ones are ties, in which the smaller doc_id comes first.

Items are taken in blocks of at most TERMS (item, term) pairs, so what a task holds of them is bounded; each block is a
pass over the documents. A task adds up the scores of a batch of classes for all items of the block and keeps the best k
of each item, so pairs of items and documents are never rows. Among the k best classes of an item, ordered by their
smallest doc_id where scores are equal, are all classes of its k best documents; of those at most k members with the
smallest ids are taken, cut in each task before the shuffle.

Nulls and texts without terms: such a document takes part in no count and is never found; an item without terms finds
nothing. Repeated rows are members of one class and found as often as they stand there; a null doc_id counts in the
statistics and is never found. Rows that repeat an item_id with different texts are asked as one item with the terms of
all. Empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lograil.llm._common import bounded_batches, materialize

#: A term is a maximal run of what is not among the ASCII characters outside 0-9, A-Z and a-z.
TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: Fixed values of the score: base, share of the length, scale of tf, weight of tf and of m.
BASE, SHARE, SCALE, TF, LENGTH = 50, 50, 1_000_000_000, 1000, 20
TOP = 50
#: (item, term) pairs of a block of items, and cells (class, item) that a task adds up at once.
TERMS, CELLS = 1 << 16, 1 << 21

#: Bytes of UTF-8: separators become a space, A-Z become a-z, the rest stays.
_FOLD = bytes(c if c >= 128 or chr(c).isalnum() and not chr(c).isupper() else c + 32 if chr(c).isupper() else 32 for c in range(256))


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (item_id, term) of items with an id, and the block of at most TERMS pairs that an item belongs to."""
    folded = F.translate(text_col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    pairs = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item_id"), F.explode(F.regexp_extract_all(folded, F.lit(TERM), F.lit(0))).alias("term")).distinct()
    return materialize(pairs, "item-terms")


def blocks_of(terms: DataFrame, most: int = TERMS) -> DataFrame:
    """(item_id, term, block): items dealt by a hash, so that a block has about half of `most` pairs and an item one block."""
    blocks = max(1, -(-2 * terms.count() // most))
    return terms.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int")) if blocks > 1 else terms.withColumn("block", F.lit(0))


def bags(documents: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, counts): number of terms of a document with one at least, and those of the vocabulary, by number,
    with their counts, as 4-byte little-endian numbers."""
    place = {t: i for i, t in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ns, terms, counts = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = text.as_buffer().to_pybytes().translate(_FOLD).split()
                if not words:
                    continue
                own = sorted((place[t], c) for t, c in Counter(words).items() if t in place)
                both = np.array(own, "<u4").reshape(-1, 2)
                ids.append(doc)
                ns.append(len(words))
                terms.append(both[:, 0].tobytes())
                counts.append(both[:, 1].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(ns, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())], names=["doc_id", "n", "terms", "counts"])

    bounded_batches(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.where(F.col("text").isNotNull()).select("doc_id", F.col("text").cast("binary"))
    return rows.mapInArrow(run, f"doc_id {kind}, n long, terms binary, counts binary")


def _numbers(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column of 4-byte numbers one after another, and how many each row has."""
    rows = [np.frombuffer(x.as_buffer(), "<u4") for x in batch.column(name)]
    return np.concatenate(rows).astype(np.int64), np.array([len(x) for x in rows])


def document_counts(found: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term of the vocabulary; a task sends at most one row a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, np.int64)
        for batch in batches:
            if batch.num_rows:
                sums += np.bincount(_numbers(batch, "terms")[0], minlength=size)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["term", "df"])

    rows = found.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(size, np.int64)
    df[rows.column("term").to_numpy()] = rows.column("df").to_numpy()
    return df


def best_classes(classes: DataFrame, items: list[object], asks: list[tuple[int, int]], weights: np.ndarray, k: int) -> DataFrame:
    """(item_id, score, h, first): the k best classes of each item among those of a task. asks: (term, item), by number."""
    asks = sorted(asks)
    asked = np.array([i for _, i in asks], np.int64)
    lows = np.searchsorted(np.array([t for t, _ in asks], np.int64), np.arange(len(weights) + 1))
    block = max(1, CELLS // max(1, len(items)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple[np.ndarray, ...]] = []  # of items, scores, hashes and first ids

        def cut() -> None:
            nonlocal own
            item, score, h, first = (np.concatenate(x) for x in zip(*own, strict=True))
            order = np.lexsort((h, first, -score, item))
            item = item[order]
            start = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1]))) if len(item) else item
            kept = order[np.arange(len(item)) - np.repeat(start, np.diff(np.append(start, len(item)))) < k]
            own = [(np.concatenate([x[0] for x in own])[kept], score[kept], h[kept], first[kept])]

        waiting = 0
        for whole in batches:
            for at in range(0, whole.num_rows, block):
                batch = whole.slice(at, block)
                (terms, sizes), (tf, _), m = _numbers(batch, "terms"), _numbers(batch, "counts"), batch.column("m").to_numpy()
                row = np.repeat(np.arange(len(sizes)), sizes)
                part = weights[terms] * ((SCALE * tf) // (TF * tf + LENGTH * m[row]))
                spread = lows[terms + 1] - lows[terms]
                ends = np.cumsum(spread)
                places = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - spread, spread) + np.repeat(lows[terms], spread)
                cells = np.repeat(row, spread) * len(items) + asked[places]
                # sums of whole numbers under 2 ** 53 are exact in doubles; larger ones are added as integers
                if (part.sum() if len(part) else 0) < 1 << 53:
                    scores = np.bincount(cells, np.repeat(part, spread), len(sizes) * len(items)).astype(np.int64)
                else:
                    scores = np.zeros(len(sizes) * len(items), np.int64)
                    np.add.at(scores, cells, np.repeat(part, spread))
                scores = scores.reshape(len(sizes), len(items))
                if len(scores) > k:  # below the k-th score of a batch no class is among the best
                    scores[scores < np.partition(scores, len(scores) - k, axis=0)[len(scores) - k]] = 0
                r, i = np.nonzero(scores)
                own.append((i, scores[r, i], batch.column("h").to_numpy()[r], batch.column("first").to_numpy()[r]))
                waiting += len(r)
                if waiting > CELLS:
                    cut()
                    waiting = len(own[0][0])
        if own:
            cut()
            item, score, h, first = own[0]
            for at in range(0, len(item), 1 << 16):
                some = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(item[some]), pa.array(score[some]), pa.array(h[some]), pa.array(first[some])], names=["item", "score", "h", "first"])

    scored = classes.select("h", "first", "m", "terms", "counts").mapInArrow(run, "item long, score long, h long, first long")
    best = Window.partitionBy("item").orderBy(F.desc("score"), "first", "h")
    return scored.withColumn("_r", F.row_number().over(best)).where(f"_r <= {k}").drop("_r")


def search(documents: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """The k documents (doc_id, text) with the highest scores above 0 for each item (item_id, text): item_id, rank, doc_id, score."""
    spark = documents.sparkSession
    terms = blocks_of(item_terms(items))
    kind, out = items.schema["item_id"].dataType.simpleString(), None
    for number in [r[0] for r in terms.select("block").distinct().collect()] or [0]:
        asked = terms.where(F.col("block") == number).select("item_id", "term").collect()  # at most a block of them
        ids, words = sorted({r[0] for r in asked}), sorted({r[1].encode() for r in asked})
        place, named = {t: i for i, t in enumerate(words)}, {x: i for i, x in enumerate(ids)}
        found = materialize(bags(documents, words), "bags")
        docs, length = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        m = F.expr(f"{100 - BASE} + (({SHARE} * n * {docs}L) div {max(length, 1)}L)")
        hashed = found.withColumn("m", m).withColumn("h", F.xxhash64("m", "terms", "counts"))
        classes = hashed.where("doc_id is not null and length(terms) > 0").groupBy("h", "m", "terms", "counts").agg(F.min("doc_id").alias("first"))
        weights = np.floor(1000 * np.log((2.0 * docs + 2) / (2.0 * document_counts(found, len(words)) + 1))).astype(np.int64)
        top = materialize(best_classes(classes, ids, [(place[r[1].encode()], named[r[0]]) for r in asked], weights, k), "best")
        # the hashes of the chosen classes are k an item of the block at most; classes that share a hash are told apart by their counts
        chosen = top.select("h").distinct()
        members = hashed.where("doc_id is not null").join(F.broadcast(chosen), "h")
        alike = Window.partitionBy("h", "m", "terms", "counts")
        members = members.withColumn("_r", F.row_number().over(alike.orderBy("doc_id"))).where(f"_r <= {k}").withColumn("first", F.min("doc_id").over(alike)).select("h", "first", "doc_id")
        ranked = top.join(members, ["h", "first"]).withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id", "h"))).where(f"rank <= {k}")
        names = spark.createDataFrame([(i, x) for x, i in named.items()], f"item long, item_id {kind}")
        part = ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionAll(part)
    return out
