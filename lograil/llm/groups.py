"""Exact comparison inside groups of any size: members meet in blocks of bounded size, and only links leave a block."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lograil.llm._common import bounded_batches, components, materialize

#: Members of a block, and the bytes of its sets; a task holds two blocks at most.
BLOCK, BYTES = 1024, 1 << 24
#: Values of the common vocabulary that are multiplied at once.
_COLUMNS = 4096

#: Whether sets may be alike, from arrays of the common values and of both sizes.
Fits = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Check:
    """Further tests of sequences whose sets fit. `dense`: for rows of flags, which values of one sequence another has, whether
    they may be linked; `alike`: whether two sequences are."""

    dense: Callable[[np.ndarray], np.ndarray]
    alike: Callable[[np.ndarray, np.ndarray], bool]


def jaccard(similarity: float) -> Fits:
    return lambda common, x, y: (common >= similarity * (x + y - common)) & (common > 0)


def _columns(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values that several of some sorted sets have; and owner and number of the value for each of their occurrences, by value."""
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.concatenate(([True], flat[1:] != flat[:-1]))[: len(flat)]
    shared = np.bincount(np.cumsum(first) - 1, minlength=1) > 1
    kept = shared[np.cumsum(first) - 1] if len(flat) else first
    return flat[first][shared[: first.sum()]], owner[kept], (np.cumsum(shared) - 1)[(np.cumsum(first) - 1)[kept]]


def common_values(sets: list[np.ndarray]) -> np.ndarray:
    """Number of common values of each two of some sorted sets, by matrix products over the values that several sets have."""
    values, owner, column = _columns(sets)
    common = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, len(values), _COLUMNS):
        a, b = np.searchsorted(column, (lo, lo + _COLUMNS))
        part = np.zeros((len(sets), int(column[b - 1]) - lo + 1), np.float32)
        part[owner[a:b], column[a:b] - lo] = 1
        common += part @ part.T
    return common


def linked(sets: list[np.ndarray], fits: Fits, check: Check | None = None, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between the sets (by number) whose components are those of all links: one for each set that joins others.

    Without `check` the sets, which are sorted, are linked if they fit. With it they may be sequences, and of those with
    different labels so far the ones that fit are checked.
    """
    if len(sets) < 2:
        return []
    given = sets
    if check is not None:
        sets = [np.unique(s) for s in sets]
    sizes = np.array([len(s) for s in sets], np.float32)
    good = fits(common_values(sets), sizes[:, None], sizes[None, :])
    np.fill_diagonal(good, False)
    out: list[tuple[int, int]] = []
    if check is None:
        left = np.ones(len(sets), bool)
        for first in range(len(sets)):
            todo = [first] if left[first] else []
            left[first] = False
            while todo:
                i = todo.pop()
                near = np.flatnonzero(good[i] & left)
                left[near] = False
                out += [(i, j) for j in near.tolist()]
                todo += near.tolist()
        return out
    values, owner, column = _columns(sets)
    has = np.zeros((len(sets), len(values) + 1), bool)  # the last column: values of one set alone
    has[owner, column] = True
    label = np.arange(len(sets)) if label is None else np.unique(label, return_inverse=True)[1]
    for i in range(1, len(sets)):
        near = np.flatnonzero(good[i, :i] & (label[:i] != label[i]))
        if len(near):
            spot = np.searchsorted(values, given[i]).clip(max=max(len(values) - 1, 0))
            spot = np.where(values[spot] == given[i], spot, len(values)) if len(values) else np.full(len(given[i]), 0)
            near = near[check.dense(has[near[:, None], spot])]
        while len(near := near[label[near] != label[i]]):
            j, near = int(near[0]), near[1:]
            if check.alike(given[i], given[j]):
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each value of the first column, by which the batches are sorted."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if held and ids[lo] != last:
                yield pa.Table.from_batches(held)
                held = []
            last = ids[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _meet(dealt: DataFrame, sets: DataFrame | None, fits: Fits, check: Check | None) -> DataFrame:
    """Links (a, b) of the members (cell, id, root, and w or an id in sets) that meet in a cell."""
    rows = (dealt.join(sets, "id") if sets else dealt).select("cell", "id", "root", "w").repartition("cell").sortWithinPartitions("cell", "id")
    bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in cells(batches):
            ids = table.column("id").to_numpy()
            pairs = linked([np.frombuffer(x.as_buffer(), "<u4") for x in table.column("w")], fits, check, table.column("root").to_numpy())
            pairs = [(ids[i], ids[j]) for i, j in pairs if ids[i] != ids[j]]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([max(p) for p in pairs], pa.int64()), pa.array([min(p) for p in pairs], pa.int64())], names=["a", "b"])

    return materialize(rows.mapInArrow(run, "a long, b long").distinct(), "met")


def links_in_groups(members: DataFrame, sets: DataFrame | None, fits: Fits, check: Check | None = None, found: DataFrame | None = None) -> DataFrame:
    """Links (a, b), a > b, between ids of a common group, whose components, with those of found, are those of all such links.

    members: k (the group), id, root (its component so far), n (values in its set), and its set w, 4-byte little-endian
    values, unless sets (id, w) has it. Members are dealt over blocks of bounded number and bytes. First each block is
    compared in itself, in rows linear in the members. Where that leaves a group of several blocks in more than one
    component, those outside its largest one meet all its blocks; two of the largest need not meet.
    """
    own = members.groupBy("k").agg(F.count("*").alias("c"), F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") * 4 / BYTES)).cast("int").alias("blocks")).where("c > 1").drop("c")
    block = F.pmod(F.xxhash64("id", F.lit(7)), F.greatest("blocks", F.lit(1))).cast("int")
    dealt = materialize(members.join(own, "k").withColumn("block", block), "dealt")
    links = _meet(dealt.withColumn("cell", F.xxhash64("k", "block")), sets, fits, check)
    if (rest := dealt.where("blocks > 1")).isEmpty():
        return links
    named = rest.drop("root").join(components(links if found is None else links.unionAll(found)), F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id")).drop("node")
    named = materialize(named, "named")
    most = named.groupBy("k", "root").agg(F.count("*").alias("c")).groupBy("k").agg(F.max_by("root", F.struct("c", "root")).alias("most"), F.ceil((F.sum("c") - F.max("c")) / BLOCK).cast("int").alias("turns"), F.count("*").alias("roots"))
    open_ = materialize(named.join(most.where("roots > 1").drop("roots"), "k"), "open")
    turn = F.pmod(F.xxhash64("id", F.lit(13)), F.col("turns")).cast("int")
    some = open_.where("root <> most").withColumn("turn", turn).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    every = open_.withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    both = some.unionByName(every).withColumn("cell", F.xxhash64("k", "turn", "block"))
    return links.unionAll(_meet(both, sets, fits, check))
