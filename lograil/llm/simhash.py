"""Near duplicates by SimHash, found with the general pigeonhole principle.

Fingerprints at most `distance` bits apart agree within T_i bits in some partition i of their bits, for any thresholds
T_i >= -1 with sum(T) = distance - partitions + 1 (-1: the partition is not probed). Bits that go together are put into
one partition; the thresholds come from a dynamic program over the candidates and signatures that each would cost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lograil.llm._common import bounded_batches, components, materialize
from lograil.llm.groups import jaccard, links_in_groups

BITS = 64
#: Sampled fingerprints of a text, and shingles in each: texts alike by 0.8 share one with probability 0.9998.
SAMPLES, SIZE = 12, 3
_MIX = np.random.default_rng(7).integers(1, 1 << 63, (SAMPLES, 2), dtype=np.uint64) | np.uint64(1)


def digests(text: str | None, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of a text, repeats included: A-Z lowered, ASCII-white-space words; fewer words: the whole sequence."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(b" ".join(words), seed)], np.uint64)
    joined, n = b" ".join(words), len(words) - shingle + 1
    step = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(step) - 1
    starts = (ends - step + 1)[:n]
    return np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes; none: 0."""
    counts = np.zeros(BITS, np.int64)
    for lo in range(0, len(hashes), 1 << 15):
        part = hashes[lo : lo + (1 << 15)].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of a text, unsigned: shingles with repeats, strict majority; no words: 0."""
    return majority(digests(text, shingle, seed))


def sample_prints(distinct: np.ndarray) -> list[int]:
    """SimHashes of consistent samples of a shingle set: its three smallest under each of SAMPLES hash functions.

    Sets of Jaccard similarity s have a given sample, and thus its SimHash, in common with probability of about s ** 3. Sets
    of up to three shingles are alike by more than 0.75 only if they are equal, and have one print of the whole set.
    """
    if len(distinct) <= SIZE:
        return [majority(distinct)] if len(distinct) else []
    chosen = (distinct[np.argpartition((distinct ^ add) * mult, SIZE - 1)[:SIZE]] for add, mult in _MIX)
    return [(x & y) | (y & z) | (x & z) for x, y, z in (c.tolist() for c in chosen)]


def with_fingerprint(docs: DataFrame, text_col: str = "text", out: str = "fp", shingle: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """The kept columns and `out`, the fingerprint as a signed long. A map over Arrow batches."""
    bounded_batches(docs.sparkSession)
    kept = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(batch.num_columns - 1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps)], names=[*keep, out])

    fields = [f"`{c}` {t}" for c, t in docs.select(*keep).dtypes]
    return kept.mapInArrow(run, ", ".join([*fields, f"{out} long"]))


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j set: 64 x 64 sums, whatever the input's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            own = np.unpackbits(batch.column(0).to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total, n = total + own.T @ own, n + len(own)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1, dtype=np.int32)), pa.array([*total.ravel(), n], pa.float64())], names=["cell", "n"])

    rows = fps.select("fp").mapInArrow(run, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    cells = np.zeros(BITS * BITS + 1)
    for r in rows:
        cells[r["cell"]] = r["n"]
    return int(cells[-1]), cells[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, partitions: int) -> list[list[int]]:
    """Partitions of near-equal size; each takes the bit most correlated with those it has."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, groups = set(range(BITS)), []
    for k in range(partitions):
        size = len(left) // (partitions - k)
        group = [max(left, key=lambda b: (corr[b, sorted(left)].sum(), -b))]
        left.discard(group[0])
        while len(group) < size:
            b = max(left, key=lambda b: (corr[b, group].sum(), -b))  # noqa: B023
            group.append(b)
            left.discard(b)
        groups.append(sorted(group))
    return groups


def mask_of(bits: list[int]) -> int:
    return int(np.array([sum(1 << b for b in bits)], np.uint64).view(np.int64)[0])


def allocate(costs: list[list[float]], total: int) -> list[int]:
    """Thresholds of least cost with the given sum; costs[i][t + 1] is that of threshold t of partition i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t, x in enumerate(own, -1):
                if s + t not in step or c + x < step[s + t][0]:
                    step[s + t] = (c + x, [*ts, t])
        best = step
    return best[total][1]


def plan(fps: DataFrame, distance: int, partitions: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition, from statistics over all fingerprints."""
    n, both = bit_statistics(fps)
    groups = group_bits(n, both, partitions)
    keyed = fps.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(mask_of(g))).alias("key")) for i, g in enumerate(groups)])).alias("e"))
    pairs = {r["i"]: float(r["pairs"]) for r in keyed.groupBy("e.i", "e.key").agg(F.count("*").cast("double").alias("c")).groupBy("i").agg(F.sum(F.expr("c * (c - 1) / 2")).alias("pairs")).collect()}
    p = np.diag(both) / max(n, 1)
    odds = 2 * p * (1 - p) / np.maximum(1 - 2 * p * (1 - p), 1e-9)
    costs = []
    for i, g in enumerate(groups):
        sym = np.zeros(distance + 1)
        sym[0] = 1
        for b in g:  # elementary symmetric polynomials: pairs that differ in exactly k bits against those that differ in none
            sym[1:] += sym[:-1] * odds[b]
        own = [0.0]
        for t in range(distance + 1):
            own.append(max(pairs.get(i, 0.0), 1e-3) * sym[: t + 1].sum() + n * (1.0 + sum(math.comb(len(g), k) for k in range(t + 1))))
        costs.append(own)
    return list(zip(groups, allocate(costs, distance - partitions + 1), strict=True))


def variants(fp: Column, bits: list[int], most: int) -> Column:
    """Array of the values of fp, masked to bits, with at most `most` of these flipped."""
    masks = [0, *[mask_of(list(c)) for k in range(1, most + 1) for c in combinations(bits, k)]]
    return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: fp.bitwiseAND(F.lit(mask_of(bits))).bitwiseXOR(m))


def links(fps: DataFrame, distance: int = 2, partitions: int = 3, bucket: int = 64) -> DataFrame:
    """Pairs (a, b), a > b, of different fingerprints (one row each in fps) whose components are those of all links.

    Probe: signatures of the partitions' thresholds meet the keys of fingerprints by an equi-join; verify: the number of
    differing bits, in the join. Keys with more than `bucket` fingerprints would pair all of them; what touches such a key
    takes an exact linear way instead (`stars`), so that no link is lost and no group is paired out.
    """
    if distance != 2:
        raise ValueError("the way for large groups is exact for a distance of 2")
    parts = [(g, t) for g, t in plan(fps, distance, partitions) if t >= 0]
    entry = lambda i, key: F.struct(F.lit(i).alias("i"), key.alias("key"))
    probes = lambda i, g, t: F.transform(variants(F.col("fp"), g, t), lambda key: entry(i, key))
    data = fps.select("fp", F.explode(F.array(*[entry(i, F.col("fp").bitwiseAND(F.lit(mask_of(g)))) for i, (g, _) in enumerate(parts)])).alias("e")).select("fp", "e.*")
    probe = fps.select("fp", F.explode(F.concat(*[probes(i, g, t) for i, (g, t) in enumerate(parts)])).alias("e")).select(F.col("fp").alias("q"), "e.*")
    large = materialize(data.groupBy("i", "key").count().where(F.col("count") > bucket).select("i", "key"), "large")
    cold = data.join(large, ["i", "key"], "left_anti").withColumnsRenamed({"i": "_i", "key": "_key"})
    found = cold.join(probe, F.expr(f"i = _i and key = _key and fp < q and bit_count(fp ^ q) <= {int(distance)}")).select(F.col("q").alias("a"), F.col("fp").alias("b"))
    touching = probe.join(large, ["i", "key"], "left_semi").select(F.col("q").alias("fp")).distinct()
    return found.unionAll(stars(touching)).distinct()


def stars(fps: DataFrame) -> DataFrame:
    """Links of fingerprints at most 2 bits apart, in linear work: each gives itself and its 64 one-bit variants.

    Two share a value exactly if they are at most 2 bits apart, and all that share a value are so, both being within one
    bit of it; linking each to the smallest there keeps every component. At most 65 different ones share a value.
    """
    near = fps.select("fp", F.explode(variants(F.col("fp"), list(range(BITS)), 1)).alias("v"))
    low = near.groupBy("v").agg(F.min("fp").alias("b"), F.count("*").alias("c")).where("c > 1")
    return near.join(low, "v").where("fp > b").select(F.col("fp").alias("a"), "b")


def _roots(fps: DataFrame, distance: int, partitions: int) -> tuple[DataFrame, DataFrame]:
    """Distinct fingerprints, and (fp, root) of those that have links."""
    unique = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "unique")
    found = components(links(unique.select("fp"), distance, partitions))
    return unique, found.withColumnsRenamed({"node": "fp"})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 2, partitions: int = 3) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Copies meet as one fingerprint before any pair is formed. Null and empty texts and texts without words have
    fingerprint zero and link like any other; repeated rows are as many rows; a null id is never a component_id unless all
    of its component are null; other columns are not read; an empty table gives no rows.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    fps = materialize(with_fingerprint(ids, keep=("doc_id",)), "fps")
    unique, roots = _roots(fps, distance, partitions)
    linked = unique.join(roots, "fp")
    first = linked.groupBy("root").agg(F.min("first").alias("low"))
    named = unique.join(linked.join(first, "root").select("fp", "low"), "fp", "left").select("fp", F.when(F.col("low").isNull(), F.col("first")).otherwise(F.col("low")).alias("component_id"))
    return fps.join(materialize(named, "named"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2, partitions: int = 3) -> DataFrame:
    """docs without near duplicates: of each component the row with the smallest id (nulls last, then the smallest text) stays.

    All columns are kept, whatever their names. Row survivors are limited before they are shuffled, so a large group costs
    one row for each task.
    """
    rows = with_fingerprint(docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("_t")), "_t", "fp", shingle, keep=("_row",)).select("_row", "fp")
    fps = materialize(rows, "rows")
    unique, roots = _roots(fps.select("fp", F.col(f"_row.`{id_col}`").alias("doc_id")), distance, partitions)
    best = Window.partitionBy("_g").orderBy(F.col(f"_row.`{id_col}`").asc_nulls_last(), F.col(f"_row.`{text_col}`").asc_nulls_last())
    grouped = fps.join(roots, "fp", "left").withColumn("_g", F.coalesce("root", "fp"))
    return grouped.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("_row.*")


def with_prints(docs: DataFrame, text_col: str = "text", shingle: int = 5) -> DataFrame:
    """_row (all columns), fp (fingerprint), sid (hash of the shingle set), n (its size), keys (fp and the sampled ones), sh (the set, 4 bytes a shingle)."""
    bounded_batches(docs.sparkSession)
    kept = docs.select(F.struct("*").alias("_row"), F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sids, sizes, keys, sets = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                every = digests(text, shingle)
                distinct = np.unique(every)
                fp = majority(every)
                fps.append(fp)
                sids.append(xxhash.xxh64_intdigest(distinct.astype("<u8").tobytes()) if len(distinct) else 0)
                sizes.append(len(distinct))
                keys.append(np.array(list({fp, *sample_prints(distinct)}), np.uint64).view(np.int64))
                sets.append(np.unique((distinct >> np.uint64(32)).astype("<u4")).tobytes())
            signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fps, sids)]
            cols = [batch.column(0), *signed, pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["_row", "fp", "sid", "n", "keys", "sh"])

    return kept.mapInArrow(run, f"_row {kept.dtypes[0][1]}, fp long, sid long, n int, keys array<long>, sh binary")


def all_links(rows: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between alike shingle sets, whose components are those of all links; rows as of `with_prints`.

    Candidates have a sampled fingerprint in common, or whole fingerprints that `links` joins. Sets that share a sampled one
    are a group, of any size, in which all are compared, in blocks (see `groups`).
    """
    sets = materialize(rows.groupBy("sid").agg(F.first("n").alias("n"), F.min("fp").alias("fp"), F.min("keys").alias("keys")), "prints")
    keyed = sets.select(F.col("sid").alias("id"), F.col("sid").alias("root"), "n", F.explode("keys").alias("k"))
    often = keyed.groupBy("k").agg(F.count("*").alias("c")).where("c > 1").select("k")
    members = materialize(keyed.join(often, "k"), "members")
    named = materialize(rows.select("sid", "sh").join(members.select(F.col("id").alias("sid")).distinct(), "sid", "left_semi").groupBy("sid").agg(F.first("sh").alias("w")).withColumnRenamed("sid", "id"), "sets")
    first = materialize(sets.groupBy("fp").agg(F.min("sid").alias("sid")), "first")
    near = links(first.select("fp")).join(first.select(F.col("fp").alias("a"), F.col("sid").alias("c")), "a").join(first.select(F.col("fp").alias("b"), F.col("sid").alias("p")), "b")
    return links_in_groups(members, named, jaccard(similarity)).unionAll(alike(near.select("c", "p"), rows.select("sid", "sh"), similarity))


def alike(pairs: DataFrame, sets: DataFrame, similarity: float, salt: int = 1000) -> DataFrame:
    """The pairs (a, b) of `pairs` (c, p) whose sets (sid, sh) have at least the given Jaccard similarity.

    A c with more than `salt` pairs is dealt over as many keys as it takes; its set goes to each once.
    """
    own = materialize(pairs, "pairs")
    parts = own.groupBy("c").agg(F.ceil(F.count("*") / salt).cast("int").alias("parts"))
    named = own.select(F.explode(F.array("c", "p")).alias("sid")).distinct()
    kept = materialize(sets.join(named, "sid", "left_semi").groupBy("sid").agg(F.first("sh").alias("sh")), "sets")
    centre = kept.join(parts, kept.sid == parts.c).select("c", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("s"), F.col("sh").alias("x"))
    dealt = own.join(parts, "c").select("c", "p", F.pmod(F.xxhash64("p"), F.col("parts")).cast("int").alias("s"))
    both = dealt.join(centre, ["c", "s"]).join(kept.select(F.col("sid").alias("p"), F.col("sh").alias("y")), "p").select("c", "p", "x", "y")
    bounded_batches(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4")
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(common >= similarity * (len(x) + len(y) - common))
            yield batch.select([0, 1]).rename_columns(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def keep_one_alike(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without near duplicates, by the Jaccard similarity of their shingle sets; all columns are kept.

    A whole text's fingerprint lies some 10 bits from that of a text alike by 0.8, where no pigeonhole prunes. So SimHashes
    of consistent samples of the shingles are compared too, for equality, and every candidate is verified on the whole sets
    (see `all_links`). Of each component the row with the smallest id (nulls last, then the smallest text) stays. Texts
    without words have the empty set and are copies of each other; texts of fewer words than a shingle are alike if equal;
    equal sets meet before pairs are formed; an empty table gives no rows.
    """
    rows = materialize(with_prints(docs, text_col, shingle), "rows")
    roots = components(all_links(rows, similarity))
    grouped = rows.select("_row", "sid").join(roots.withColumnsRenamed({"node": "sid"}), "sid", "left").withColumn("_g", F.coalesce("root", "sid"))
    best = Window.partitionBy("_g").orderBy(F.col(f"_row.`{id_col}`").asc_nulls_last(), F.col(f"_row.`{text_col}`").asc_nulls_last())
    return grouped.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("_row.*")
