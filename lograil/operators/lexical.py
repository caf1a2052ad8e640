"""BM25 over a corpus that is tokenised once for a block of queries.

A document is turned into the numbers and counts of the terms that the block asks for; all further steps read that table.
Scores are added up where the document lies, for all queries of the block at once, and a task passes on its k best for each
query, so neither the postings of a frequent term nor pairs of queries and documents are ever shuffled. Queries come in
blocks of at most TERMS (query, term) pairs, which bounds what a task holds of them; each block is one pass over the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lograil.sources.scratch import table

K1, B = 1.2, 0.75
#: (query, term) pairs of a block, and cells (document, query) that a task adds up at once.
TERMS, CELLS = 1 << 16, 1 << 21
#: Pairs of a document's terms and queries, and hits, that a task holds at once; documents whose terms are counted at once.
PAIRS, HITS, ROWS = 1 << 18, 1 << 17, 1000


def terms(col: str) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(col), F.lit(""))), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def ranked(rows: DataFrame, k: int, by: str = "score") -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(by), "source_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(f"rank <= {k}")


def counted(corpus: DataFrame, words: list[str], keep: list[str]) -> DataFrame:
    """keep, len (all terms of content), terms and counts (those among words, by number, as 4-byte numbers) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(words, pa.string())
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            lists = batch.column(len(keep))
            sizes = np.diff(lists.offsets.to_numpy())
            number = pc.index_in(lists.flatten(), value_set=known).fill_null(-1).to_numpy()
            row = np.repeat(np.arange(len(sizes)), sizes)
            cell, count = np.unique(row[number >= 0] * max(len(words), 1) + number[number >= 0], return_counts=True)
            own, ends = cell % max(len(words), 1), np.searchsorted(cell // max(len(words), 1), np.arange(len(sizes) + 1))
            packed = lambda x: pa.array([x[a:b].astype("<u4").tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(sizes.astype(np.int32)), packed(own), packed(count)], names=[*keep, "len", "terms", "counts"])

    kinds = dict(corpus.dtypes)
    rows = corpus.select(*keep, terms("content").alias("ts"))
    return rows.mapInArrow(run, ", ".join([*[f"{c} {kinds[c]}" for c in keep], "len int", "terms binary", "counts binary"]))


def _flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    rows = [np.frombuffer(x.as_buffer(), "<u4") for x in batch.column(name)]
    return np.concatenate(rows).astype(np.int64), np.array([len(x) for x in rows])


def _frequencies(docs: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term; a task sends one row a term at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, np.int64)
        for batch in batches:
            if batch.num_rows:
                sums += np.bincount(_flat(batch, "terms")[0], minlength=size)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["term", "df"])

    got = docs.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(size, np.int64)
    df[got.column("term").to_numpy()] = got.column("df").to_numpy()
    return df


def _parts(pairs: np.ndarray, rows: int) -> Iterator[tuple[int, int]]:
    """Ranges of at most `rows` documents with at most PAIRS pairs together; one with more is alone."""
    ends, lo = np.cumsum(pairs), 0
    while lo < len(pairs):
        hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, "right"))
        hi = min(lo + rows, max(lo + 1, hi))
        yield lo, hi
        lo = hi


def _scored(docs: DataFrame, weights: np.ndarray, average: float, asks: list[tuple[int, int, int]], queries: int, k: int) -> DataFrame:
    """q, source_id, score: the k best documents of a task for each query. asks: (term, query, times asked), by number."""
    asks = sorted(asks)
    asked, often = np.array([q for _, q, _ in asks], np.int64), np.array([n for *_, n in asks], float)
    lows = np.searchsorted(np.array([t for t, *_ in asks], np.int64), np.arange(len(weights) + 1))
    block = max(1, CELLS // max(1, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, ...]] = []  # queries, scores, documents
        kind = None

        def cut() -> None:
            nonlocal best
            q, score, doc = (np.concatenate(x) for x in zip(*best, strict=True))
            order = np.lexsort((doc, -score, q))
            start = np.flatnonzero(np.concatenate(([True], q[order][1:] != q[order][:-1]))) if len(q) else order
            kept = order[np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q)))) < k]
            best = [(q[kept], score[kept], doc[kept])]

        waiting = 0
        for whole in batches:
            kind = whole.column(0).type
            if not whole.num_rows:
                continue
            every, many = _flat(whole, "terms")
            pairs = np.bincount(np.repeat(np.arange(len(many)), many), lows[every + 1] - lows[every], len(many))
            for at, end in _parts(pairs, block):
                batch = whole.slice(at, end - at)
                (term, sizes), (tf, _) = _flat(batch, "terms"), _flat(batch, "counts")
                row, length = np.repeat(np.arange(len(sizes)), sizes), batch.column("len").to_numpy()
                part = weights[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[row] / average)) if len(term) else np.empty(0)
                spread = lows[term + 1] - lows[term]
                ends = np.cumsum(spread)
                place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - spread, spread) + np.repeat(lows[term], spread)
                score = np.bincount(np.repeat(row, spread) * queries + asked[place], np.repeat(part, spread) * often[place], len(sizes) * queries).reshape(len(sizes), queries)
                hit, score = score > 0, score.round(6)
                if len(score) > k:  # what is below the k-th of a batch is not among the best
                    hit &= score >= np.partition(score, len(score) - k, axis=0)[len(score) - k]
                r, q = np.nonzero(hit)
                names = batch.column(0).to_numpy(zero_copy_only=False)
                best.append((q, score[r, q], (names.astype(str) if names.dtype == object else names)[r]))
                waiting += len(r)
                if waiting > HITS:
                    cut()
                    waiting = len(best[0][0])
        if best:
            cut()
            q, score, doc = best[0]
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(doc.tolist(), kind), pa.array(score)], names=["q", "source_id", "score"])

    return docs.select("source_id", "len", "terms", "counts").mapInArrow(run, f"q long, source_id {dict(docs.dtypes)['source_id']}, score double")


def bm25(corpus: DataFrame, queries: DataFrame, k: int, source_type: str | None = None, attack_type: str | None = None, ids: DataFrame | None = None, exclude: str | None = None) -> DataFrame:
    """query_id, source_id, score, rank: the k best documents of each query; equal scores by source_id.

    Statistics are over the whole corpus; the filters (source_type, attack_type, and ids: a table of source_id) apply to the
    results alone. exclude names a column of queries with an id that the query does not find. Documents without an id count
    in the statistics and are not found; queries without a known term, empty ones and null ids find nothing.
    """
    asked = queries.where("query_id is not null").select("query_id", F.explode(terms("text")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))
    asked = table(asked, "asked")
    blocks = max(1, -(-2 * asked.count() // TERMS))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    kind, out = dict(queries.dtypes)["query_id"], None
    filters = {"source_type": source_type, "attack_type": attack_type}
    keep = ["source_id", *[c for c, v in filters.items() if v]]
    for number in range(blocks):
        own = asked.where(F.col("block") == number).collect()  # a block of them at most
        words, names = sorted({r.term for r in own}), sorted({r.query_id for r in own})
        place, named = {t: i for i, t in enumerate(words)}, {x: i for i, x in enumerate(names)}
        docs = table(counted(corpus, words, keep), "counted")
        n, average = docs.agg(F.count("*"), F.avg("len")).first()
        df = _frequencies(docs, len(words))
        weights = np.log(1 + (n - df + 0.5) / (df + 0.5))
        docs = docs.where("source_id is not null")
        for c, v in filters.items():
            docs = docs.where(F.col(c) == v) if v else docs
        if ids is not None:
            docs = docs.join(ids.select("source_id").distinct(), "source_id", "left_semi")
        asks = [(place[r.term], named[r.query_id], r.qf) for r in own]
        hits = _scored(docs, weights, average or 1.0, asks, len(names), k + bool(exclude))
        part = hits.join(F.broadcast(hits.sparkSession.createDataFrame([(i, x) for x, i in named.items()], f"q long, query_id {kind}")), "q").select("query_id", "source_id", "score")
        out = part if out is None else out.unionAll(part)
    if exclude:
        out = out.join(queries.select("query_id", F.col(exclude).alias("source_id")), ["query_id", "source_id"], "left_anti")
    return ranked(out, k)
