"""Exact cosine search that skips parts of the corpus by the triangle inequality.

Unit vectors lie at Euclidean distances sqrt(2 - 2 cos), a metric. Each vector of the corpus belongs to its nearest pivot and
there to a ring of distances; rings are cut into chunks of bounded size. The directory of rings (count, smallest and largest
distance) is PIVOTS x RINGS rows for each length of vectors, whatever the size of the corpus. A query searches the rings
around the pivots next to it that hold k vectors; the k-th score found there bounds how far a ring may be away that is
searched after them: one whose every point is farther is skipped, without loss.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograil.operators.lexical import ranked
from lograil.sources.scratch import table

PIVOTS, RINGS = 64, 32
#: Vectors of a chunk, queries that meet it at once, and lengths of vectors in one table.
CHUNK, BLOCK, LENGTHS = 4096, 512, 64


def _fine(c: str) -> Column:
    whole = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.col(c).isNotNull() & F.exists(c, lambda x: x != 0) & F.forall(c, whole)


def _units(lists: pa.Array, length: int) -> np.ndarray:
    """Rows of unit vectors; scaled by their largest number first, so that no square is lost."""
    x = lists.flatten().to_numpy().reshape(-1, length).astype(float)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_length(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    """(length, unit vectors, rows) for each length of vectors in a batch."""
    lengths = np.diff(batch.column(name).offsets.to_numpy())
    for length in np.unique(lengths).tolist():
        own = batch.filter(pa.array(lengths == length))
        yield length, _units(own.column(name), length), own


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ y.T), 0))


def _pivots(rows: DataFrame, most: int) -> dict[int, np.ndarray]:
    """Unit vectors of at most `most` rows of each length."""
    lengths = [r[0] for r in rows.select("length").distinct().limit(LENGTHS + 1).collect()]
    if len(lengths) > LENGTHS:
        raise ValueError(f"vectors of more than {LENGTHS} lengths")
    out = {}
    for length in lengths:
        few = rows.where(F.col("length") == length).orderBy("_h", "source_id").limit(most).select("embedding").toArrow().combine_chunks()
        out[length] = np.unique(_units(few.column("embedding").combine_chunks(), length), axis=0)
    return out


def knn(corpus: DataFrame, queries: DataFrame, k: int, where: Column | None = None, exclude: DataFrame | None = None, pivots: int = PIVOTS, chunk: int = CHUNK) -> DataFrame:
    """query_id, source_id, score = (1 + cosine) / 2 to six digits, rank: exact, over all rows but the query's own id.

    where chooses rows of the corpus before the search; exclude (query_id, source_id) are pairs that are not found. Vectors
    are compared with those of their length only. Vectors that are null, empty, zero or not finite take no part, nor do rows
    without an id; equal scores by source_id.
    """
    ids, names = dict(corpus.dtypes)["source_id"], dict(queries.dtypes)["query_id"]
    rows = (corpus if where is None else corpus.where(where)).where("source_id is not null").where(_fine("embedding"))
    rows = rows.select("source_id", F.col("embedding").cast("array<double>").alias("embedding"), F.size("embedding").alias("length"), F.xxhash64("source_id").alias("_h"))
    centres = _pivots(rows, pivots)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, x, own in _by_length(batch, "embedding"):
                d = _distances(x, centres[length])
                nearest = d.argmin(axis=1)
                d = d[np.arange(len(d)), nearest]
                yield pa.RecordBatch.from_arrays([own.column("source_id"), pa.array(np.full(len(x), length, np.int32)), pa.array((nearest * RINGS + np.minimum(d * RINGS / 2, RINGS - 1).astype(int)).astype(np.int32)), pa.array(d), pa.array([v.tobytes() for v in x], pa.binary())], names=["source_id", "length", "ring", "d", "v"])

    cells = table(rows.select("source_id", "embedding").mapInArrow(placed, f"source_id {ids}, length int, ring int, d double, v binary"), "cells")
    directory = cells.groupBy("length", "ring").agg(F.count("*").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi"))
    known = {length: [] for length in centres}
    for r in directory.collect():  # pivots x rings for each length at most
        known[r.length].append((r.ring, r.n, r.lo, r.hi))
    rings = {length: tuple(np.array(x) for x in zip(*sorted(v), strict=True)) for length, v in known.items() if v}

    asked = queries.where("query_id is not null").where(_fine("embedding")).select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    out = exclude.where("source_id is not null").groupBy("query_id").agg(F.collect_set(F.col("source_id").cast("string")).alias("not")) if exclude is not None else None
    asked = asked.join(out, "query_id", "left") if out is not None else asked.withColumn("not", F.lit(None).cast("array<string>"))
    asked = table(asked.withColumn("not", F.coalesce("not", F.array().cast("array<string>"))), "asked")

    def chosen(first: bool):
        """Pairs of queries and the rings that they search: first those next to them, then all that may hold a better one."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for length, x, own in _by_length(batch, "embedding"):
                    if length not in rings:
                        continue
                    ring, n, lo, hi = rings[length]
                    d = _distances(x, centres[length])[:, ring // RINGS]
                    far, near = d + hi, np.maximum(0, np.maximum(d - hi, lo - d))
                    order = np.argsort(far, axis=1, kind="stable")
                    hidden = np.array([len(e) for e in own.column("not").to_pylist()]) + k + 1
                    need = (np.cumsum(n[order], axis=1) - n[order]) < hidden[:, None]
                    home = np.zeros(need.shape, bool)
                    np.put_along_axis(home, order, need, axis=1)
                    if first:
                        take, bound = home, np.full(len(x), -1.0)
                    else:
                        bound = own.column("kth").to_numpy()
                        take = ~home & (near <= np.sqrt(np.maximum(4 - 4 * bound + 2e-6, 0))[:, None] + 1e-9)
                    q, r = np.nonzero(take)
                    v = [u.tobytes() for u in x]
                    yield pa.RecordBatch.from_arrays([own.column("query_id").take(pa.array(q)), pa.array(np.full(len(q), length, np.int32)), pa.array(ring[r].astype(np.int32)), pa.array(bound[q]), pa.array([v[i] for i in q], pa.binary()), own.column("not").take(pa.array(q))], names=["query_id", "length", "ring", "kth", "v", "not"])

        return run

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each chunk comes with its vectors first, then with the queries that search it."""
        cell, own, waiting = None, [], []
        kinds: list[pa.DataType] = []

        def found() -> Iterator[pa.RecordBatch]:
            if own and waiting:
                x, sources = np.array([np.frombuffer(v) for _, v in own]), np.array([s for s, _ in own])
                texts = sources.astype(str)
                scores = ((1 + np.array([np.frombuffer(w[2]) for w in waiting]) @ x.T) / 2).round(6)
                hits: list[list] = [[], [], []]
                for i, (query, kth, _, gone) in enumerate(waiting):
                    at = np.flatnonzero((scores[i] >= kth) & (sources != query) & ~np.isin(texts, gone))
                    at = at[np.lexsort((sources[at], -scores[i, at]))[:k]]
                    hits[0] += [query] * len(at)
                    hits[1] += sources[at].tolist()
                    hits[2] += scores[i, at].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(hits[0], kinds[0]), pa.array(hits[1], kinds[1]), pa.array(hits[2], pa.float64())], names=["query_id", "source_id", "score"])
            waiting.clear()

        for batch in batches:
            kinds[:] = batch.column("query_id").type, batch.column("source_id").type
            for length, ring, part, query, source, v, kth, gone in zip(*[batch.column(c).to_pylist() for c in ("length", "ring", "part", "query_id", "source_id", "v", "kth", "not")], strict=True):
                if (length, ring, part) != cell:
                    yield from found()
                    cell, own = (length, ring, part), []
                if source is not None:
                    own.append((source, v))
                else:
                    waiting.append((query, kth, v, gone))
                    if len(waiting) >= BLOCK:
                        yield from found()
        yield from found()

    parts = directory.select("length", "ring", F.ceil(F.col("n") / chunk).cast("int").alias("parts"))

    def searched(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(F.broadcast(parts), ["length", "ring"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        stored = cells.join(F.broadcast(parts), ["length", "ring"]).withColumn("part", F.pmod(F.xxhash64("source_id"), F.col("parts")).cast("int"))
        both = stored.select("length", "ring", "part", F.lit(0).alias("kind"), F.lit(None).cast(names).alias("query_id"), "source_id", "v", F.lit(None).cast("double").alias("kth"), F.lit(None).cast("array<string>").alias("not")).unionByName(
            pairs.select("length", "ring", "part", F.lit(1).alias("kind"), "query_id", F.lit(None).cast(ids).alias("source_id"), "v", "kth", "not"))
        return both.repartition("length", "ring", "part").sortWithinPartitions("length", "ring", "part", "kind").drop("kind").mapInArrow(met, f"query_id {names}, source_id {ids}, score double")

    kind = f"query_id {names}, length int, ring int, kth double, v binary, not array<string>"
    home = table(ranked(searched(asked.mapInArrow(chosen(True), kind)), k), "home")
    bounds = home.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    rest = asked.join(bounds, "query_id", "left").withColumn("kth", F.coalesce("kth", F.lit(-1.0)))
    return ranked(home.drop("rank").unionByName(searched(rest.mapInArrow(chosen(False), kind))), k)
