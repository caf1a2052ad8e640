"""Isolation Forest: each tree from a bounded hash sample, scoring as a map over broadcast trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lograil.operators.ranges import scan
from lograil.sources.scratch import table

TREES, SAMPLE, CONTAMINATION, SEED = 100, 256, 0.1, 42
EULER = 0.5772156649


def path_norm(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + EULER) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow(x: np.ndarray, seed: int) -> list[tuple[int, float, int, int, float]]:
    """Nodes (feature or -1, split, left, right, depth + norm of a leaf)."""
    rng, limit, nodes, todo = np.random.default_rng(seed), int(np.ceil(np.log2(max(len(x), 2)))), [], [(np.arange(len(x)), 0, -1, 0)]
    while todo:
        rows, depth, parent, side = todo.pop()
        at = len(nodes)
        if parent >= 0:
            f, s, left, right, v = nodes[parent]
            nodes[parent] = (f, s, at if side == 0 else left, at if side == 1 else right, v)
        lo, hi = (x[rows].min(axis=0), x[rows].max(axis=0)) if len(rows) else (np.zeros(1), np.zeros(1))
        wide = np.flatnonzero(hi > lo)
        if depth >= limit or not len(wide):
            nodes.append((-1, 0.0, -1, -1, depth + float(path_norm(len(rows)))))
            continue
        f = int(rng.choice(wide))
        s = float(rng.uniform(lo[f], hi[f]))
        nodes.append((f, s, -1, -1, 0.0))
        goes = x[rows, f] < s
        todo += [(rows[~goes], depth + 1, at, 1), (rows[goes], depth + 1, at, 0)]
    return nodes


def fit(features: DataFrame, names: list[str], id_col: str = "event_id", trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """The forest as a table, one row for each tree. The sample of a tree is by hash of (id, tree, seed), whatever the partitions.

    Each task keeps its `sample` smallest hashes for each tree, so trees x sample rows a task are shuffled at most.
    """

    def pick(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of each tree the rows that are below its sample's largest hash so far join the sample; most rows join none."""
        most = np.iinfo(np.int64).max
        order, own, bound = [np.empty(0, np.int64)] * trees, [np.empty((0, len(names)))] * trees, [most] * trees
        for pdf in frames:
            key, x = pdf["_h"].to_numpy().astype(np.uint64), pdf[names].to_numpy(float)
            for t in range(trees):
                h = (key ^ np.uint64(t * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(31)
                o = (h >> np.uint64(1)).astype(np.int64)
                near = np.flatnonzero(o < bound[t])
                if len(near):
                    both, rows = np.concatenate((order[t], o[near])), np.concatenate((own[t], x[near]))
                    if len(both) > sample:
                        kept = np.argpartition(both, sample - 1)[:sample]
                        both, rows = both[kept], rows[kept]
                    order[t], own[t], bound[t] = both, rows, int(both.max()) if len(both) >= sample else most
        for t in range(trees):
            if len(order[t]):
                yield pd.DataFrame(own[t], columns=names).assign(_t=t, _o=order[t])[["_t", "_o", *names]]

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.nsmallest(sample, "_o")
        t = int(pdf["_t"].iloc[0])
        nodes = grow(pdf[names].to_numpy(float), seed * 1000 + t)
        return pd.DataFrame([{"tree": t, "rows": len(pdf), **{k: [n[i] for n in nodes] for i, k in enumerate(("feature", "split", "left_node", "right_node", "value"))}}])

    rows = features.select(F.xxhash64(F.col(id_col), F.lit(seed)).alias("_h"), *[F.col(n).cast("double").alias(n) for n in names])
    kept = rows.mapInPandas(pick, "_t int, _o long, " + ", ".join(f"{n} double" for n in names))
    return kept.groupBy("_t").applyInPandas(build, "tree int, rows int, feature array<int>, split array<double>, left_node array<int>, right_node array<int>, value array<double>")


def score(features: DataFrame, forest: DataFrame, names: list[str], keep: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """The kept columns and score in [-1, 0): lower is more anomalous. The forest is trees x 2 x sample nodes at most."""
    trees = [(np.array(r["feature"]), np.array(r["split"]), np.array(r["left_node"]), np.array(r["right_node"]), np.array(r["value"]), r["rows"]) for r in forest.orderBy("tree").collect()]
    shared = features.sparkSession.sparkContext.broadcast(trees)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            x, total = pdf[names].to_numpy(float), np.zeros(len(pdf))
            every = np.arange(len(pdf))
            for f, s, lo, hi, v, _ in shared.value:
                at = np.zeros(len(pdf), int)
                while (inner := f[at] >= 0).any():
                    rows = every[inner]
                    n = at[rows]
                    at[rows] = np.where(x[rows, f[n]] < s[n], lo[n], hi[n])
                total += v[at]
            norm = float(path_norm(max([t[5] for t in shared.value], default=2)))
            yield pdf[list(keep)].assign(score=-(2.0 ** (-total / max(len(shared.value), 1) / max(norm, 1e-9))))

    types = dict(features.dtypes)
    return features.select(*keep, *[F.col(n).cast("double").alias(n) for n in names]).mapInPandas(run, ", ".join([*[f"{k} {types[k]}" for k in keep], "score double"]))


def predict(scored: DataFrame, contamination: float = CONTAMINATION) -> DataFrame:
    """Adds predicted: 1 below the contamination quantile of the scores. These are written once, as they are read twice."""
    scored = table(scored, "scored")
    cut = scored.agg(F.percentile_approx("score", contamination, 10_000).alias("cut"))
    return scored.join(F.broadcast(cut)).select(*scored.columns, (F.col("score") < F.col("cut")).cast("int").alias("predicted"))


def split(rows: DataFrame, key: str, label: str | None = None, test: float = 0.3, seed: int = 42) -> DataFrame:
    """Adds is_test: of each label (null is one) exactly the rounded share `test` of its rows, those of the smallest hashes.

    The place of a row among its label's is a prefix sum over ranges of (label, hash), so no label is sorted in one task and
    the same rows are chosen whatever the partitions. Without a label all rows are one stratum.
    """
    named = rows.withColumns({"_label": F.col(label).cast("string") if label else F.lit(""), "_hash": F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))})
    placed = scan(named, ["_label"], ["_hash", key], {"_place": ("sum", F.lit(1), "before")})
    sizes = named.groupBy("_label").agg(F.floor(F.count("*") * test + 0.5).alias("_test")).select(F.col("_label").alias("_l"), "_test")
    return placed.join(F.broadcast(sizes), F.col("_label").eqNullSafe(F.col("_l"))).withColumn("is_test", F.col("_place") < F.col("_test")).drop("_label", "_hash", "_place", "_l", "_test")
