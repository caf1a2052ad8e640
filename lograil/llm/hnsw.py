"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard, shard results merged.

Equal vectors meet first, with the smallest ids that a result could need, so a vector that a third of all rows share is
one node. A shard is a bounded number of nodes; its graph is stored as flat arrays (vectors, neighbours by layer) in one
row of the index table. Queries go to the shards in blocks about as large as a shard, so a shard is sent once for each
4,096 queries.
"""

from __future__ import annotations

import heapq
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lograil.llm._common import materialize

#: Nodes of a shard; links of a node (twice as many on the ground layer); breadth of search while building and querying.
SHARD, LINKS, BUILD_BREADTH, BREADTH, BLOCK = 8192, 12, 64, 128, 4096


class Graph:
    """A navigable small-world graph over unit vectors; nearness is the inner product."""

    def __init__(self, vectors: np.ndarray, links: int = LINKS):
        self.x, self.links = np.ascontiguousarray(vectors, np.float32), links
        self.layers: list[dict[int, np.ndarray] | list[np.ndarray]] = []
        self.entry, self.top = -1, -1

    @classmethod
    def build(cls, vectors: np.ndarray, links: int = LINKS, breadth: int = BUILD_BREADTH, seed: int = 7) -> Graph:
        g, draw = cls(vectors, links), random.Random(seed)
        scale = 1 / np.log(links)
        levels = [int(-np.log(1 - draw.random()) * scale) for _ in range(len(vectors))]
        g.layers = [{} for _ in range(max(levels, default=-1) + 1)]
        for node, level in enumerate(levels):
            g._insert(node, level, breadth)
        return g

    def _insert(self, node: int, level: int, breadth: int) -> None:
        q = self.x[node]
        near = [(float(self.x[self.entry] @ q), self.entry)] if self.entry >= 0 else []
        for layer in range(self.top, -1, -1):
            if layer > level:
                near = self._search(q, near, layer, 1)
                continue
            near = self._search(q, near, layer, breadth)
            most = self.links * (2 if layer == 0 else 1)
            chosen = self._diverse(near, self.links)
            table = self.layers[layer]
            table[node] = np.array(chosen, np.int32)
            for other in chosen:
                have = np.append(table[other], np.int32(node))
                if len(have) > most:
                    sims = self.x[have] @ self.x[other]
                    have = np.array(self._diverse(sorted(zip(sims.tolist(), have.tolist(), strict=True), reverse=True), most), np.int32)
                table[other] = have
        for layer in range(self.top + 1, level + 1):
            self.layers[layer][node] = np.empty(0, np.int32)
        if level > self.top:
            self.entry, self.top = node, level

    def _diverse(self, near: list[tuple[float, int]], most: int) -> list[int]:
        """Of candidates, nearest first, those nearer to the node than to any chosen one; then the nearest left."""
        if len(near) <= most:
            return [i for _, i in near]
        own = self.x[[i for _, i in near]]
        between = own @ own.T
        chosen: list[int] = []
        for k, (sim, _) in enumerate(near):
            if not chosen or between[k, chosen].max() < sim:
                chosen.append(k)
                if len(chosen) == most:
                    break
        taken = set(chosen)
        chosen += [k for k in range(len(near)) if k not in taken][: most - len(chosen)]
        return [near[k][1] for k in chosen]

    def _search(self, q: np.ndarray, start: list[tuple[float, int]], layer: int, breadth: int) -> list[tuple[float, int]]:
        """Best-first search of one layer; (nearness, node), nearest first."""
        table, x = self.layers[layer], self.x
        seen = {i for _, i in start}
        todo = [(-s, i) for s, i in start]
        heapq.heapify(todo)
        best = list(start)
        heapq.heapify(best)
        while todo:
            far, i = heapq.heappop(todo)
            if len(best) >= breadth and -far < best[0][0]:
                break
            fresh = [n for n in table[i].tolist() if n not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for s, n in zip((x[fresh] @ q).tolist(), fresh, strict=True):
                if len(best) < breadth:
                    heapq.heappush(best, (s, n))
                    heapq.heappush(todo, (-s, n))
                elif s > best[0][0]:
                    heapq.heapreplace(best, (s, n))
                    heapq.heappush(todo, (-s, n))
        return sorted(best, reverse=True)

    def search(self, q: np.ndarray, breadth: int = BREADTH) -> list[int]:
        """Nodes found near q, nearest first."""
        if self.entry < 0:
            return []
        near = [(float(self.x[self.entry] @ q), self.entry)]
        for layer in range(self.top, 0, -1):
            near = self._search(q, near, layer, 1)
        return [i for _, i in self._search(q, near, 0, breadth)]

    def flat(self) -> bytes:
        """Neighbours of all layers as one int32 array: entry, layers, then for each layer nodes, and node, degree, links."""
        out = [self.entry, len(self.layers)]
        for table in self.layers:
            out.append(len(table))
            for node, have in sorted(table.items()):
                out += [node, len(have), *have.tolist()]
        return np.array(out, np.int32).tobytes()

    @classmethod
    def load(cls, vectors: np.ndarray, flat: bytes, links: int = LINKS) -> Graph:
        g, a = cls(vectors, links), np.frombuffer(flat, np.int32)
        g.entry, n, at = int(a[0]), int(a[1]), 2
        for _ in range(n):
            count, at, table = int(a[at]), at + 1, {}
            for _ in range(count):
                node, degree = int(a[at]), int(a[at + 1])
                table[node] = a[at + 2 : at + 2 + degree]
                at += 2 + degree
            g.layers.append(table)
        g.top = n - 1
        return g


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; scaled first, so that no square over- or underflows."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, v (array of doubles), dim: rows with an id whose vector is finite, without nulls and not zero."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(v.isNotNull() & F.col("vec_id").isNotNull()).where(fine).withColumn("dim", F.size("v"))


def build(vectors: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", shard: int = SHARD) -> DataFrame:
    """The index: one row for each shard with its dimension, nodes, ids of each node's copies, vectors and graph.

    Every usable row is indexed; of equal vectors the k + 1 smallest ids are kept, which is all that a result of k without
    the query can hold. Rows are limited before they are shuffled.
    """
    # -0.0 and 0.0 are one value
    rows = usable(vectors, id_col, vec_col).withColumn("v", F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)))
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(f"n <= {k + 1}")
    nodes = materialize(first.groupBy("v", "dim").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "nodes")
    shards = nodes.groupBy("dim").agg(F.ceil(F.count("*") / shard).alias("shards"))
    placed = nodes.join(F.broadcast(shards), "dim").withColumn("shard", F.pmod(F.xxhash64("v"), F.col("shards")).cast("int"))

    def one(key, table):
        dim, number = (x.as_py() for x in key)
        table = table.sort_by([("low", "ascending")])
        x = np.array(table.column("v").combine_chunks().flatten()).reshape(-1, dim)
        ids = table.column("ids").to_pylist()
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([number], pa.int32()), "ids": pa.array([ids], pa.list_(pa.list_(pa.int64()))), "vectors": pa.array([x.tobytes()], pa.binary()), "graph": pa.array([Graph.build(unit(x)).flat()], pa.binary())})

    low = placed.withColumn("low", F.element_at("ids", 1)).select("dim", "shard", "low", "v", "ids")
    return materialize(low.groupBy("dim", "shard").applyInArrow(one, "dim int, shard int, ids array<array<long>>, vectors binary, graph binary"), "index")


def search(index: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", breadth: int = BREADTH, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each usable query, without the query's own id.

    score is the cosine of the original vectors in double precision; ties go to the smaller vec_id. Only vectors of the
    query's dimension are candidates. Query blocks are matched to the shards of their dimension, and each shard returns k
    rows a query.
    """
    asked = usable(queries, id_col, vec_col).dropDuplicates(["vec_id"])
    count = asked.groupBy("dim").agg(F.ceil(F.count("*") / block).alias("blocks"))
    blocked = asked.join(F.broadcast(count), "dim").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
    blocks = materialize(blocked.groupBy("dim", "block").agg(F.collect_list(F.struct("vec_id", "v")).alias("asked")), "blocks")
    pairs = index.join(blocks, "dim").repartition("dim", "shard", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, raw = row["ids"], np.frombuffer(row["vectors"]).reshape(-1, row["dim"])
                own = unit(raw)
                graph = Graph.load(own, row["graph"])
                out: list[tuple[int, int, float]] = []
                for q in row["asked"]:
                    u = unit(np.array([q["v"]]))[0]
                    found = graph.search(u.astype(np.float32), breadth)
                    scores = np.clip(own[found] @ u, -1.0, 1.0)
                    near = sorted((-s, i) for s, n in zip(scores.tolist(), found, strict=True) for i in ids[n] if i != q["vec_id"])
                    out += [(q["vec_id"], i, -s) for s, i in near[:k]]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.float64())], names=["query_id", "vec_id", "score"])

    near = pairs.select("dim", "ids", "vectors", "graph", "asked").mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest of each row whose id is divisible by `every`, among all rows but itself.

    Vectors that are null, zero, or hold nulls or numbers that are not finite take no part, nor do rows without an id;
    rows that repeat an id and a vector are one candidate; fewer candidates than k are all returned; other columns are not
    read; an empty table gives no rows.
    """
    return search(build(vectors, k, id_col, vec_col), vectors.where(F.col(id_col) % every == 0), k, id_col, vec_col)
