"""Substring dedup: near-duplicate passages by compact windows.

A text is its sequence of five-word shingles. Under one hash function, the subsequences of RUN shingles are grouped by
their minimum into compact windows (c, lo, hi): those that start in lo..hi have their minimum at c. These are the nodes of
the Cartesian tree of the hashes that span RUN shingles or more, cut to that length. Where the windows of the two functions
overlap (an interval join of the two lists), the pair of minima is a signature: all subsequences that start there share it.

Passages of at least 50 words that are alike by 0.8 or more differ in so few places that some RUN shingles in a row, 24
words, are the same in both (an unbroken run of 21 at least, as each place that differs takes four shingles or more).
Under every function these have the same minimum, so both texts have the signature: none is missed by chance. Texts that
share a signature are a group, and each is aligned with the group's text of smallest hash. What matters then is places: a
place (text, signature) that lies in a passage found is done. Other places are compared with all members of their group:

* in groups of few texts each with each, in those that fit a block by one matrix product of the shingles around;
* in larger ones by the LEAST shingles that passages alike by 0.8 have in common around such a run. Of two surroundings
  with LEAST in common, either both hold LEAST or more shingles that are frequent in the group, or they share one that is
  not: those pairs meet at rare shingles, each held by RARE members at most. So texts that share a frame of fewer words,
  and nothing else, are never paired, however many they are. Members with LEAST frequent shingles meet in blocks.

So every place with a near-duplicate passage around it is listed with one partner at least. The one exception are places
in groups of more than 1,024 members with LEAST frequent shingles each: members of one component count as done there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lograil.llm._common import WORD, bounded_batches, components, discard, materialize
from lograil.llm.groups import Check, links_in_groups

SHINGLE, WORDS, SIMILARITY = 5, 50, 0.8
WIDTH = WORDS - SHINGLE + 1
#: Hash functions, the shingles in a row that near-duplicate passages have in common, and those in WIDTH (0.8 / 1.8 of both).
HASHES, RUN, LEAST = 2, 20, 41
#: Shingles on each side of a signature's minimum that are compared: a passage's width and some more. Longest gap looked over.
AROUND, GAP = 64, 12
#: A text of at least 50 words; reads no more of it than these.
LONG = f"^(?:[\\x20\\x09-\\x0D]*+{WORD}+){{{WORDS}}}"
#: Texts with a common signature that are aligned each with each, those that are compared in one block, and members that hold a
#: shingle which is not frequent.
SMALL, ONE_BLOCK, RARE = 16, 1000, 64
_MIX = np.random.default_rng(11).integers(1, 1 << 63, (max(SHINGLE, HASHES), 3), dtype=np.uint64) | np.uint64(1)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MIX[k, 1]
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the five-word shingles of a whole text, A-Z lowered; fewer words have none."""
    words = (text or "").encode().lower().split()
    n = len(words) - SHINGLE + 1
    if n < 1:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        out += h[k : k + n] * _MIX[k, 0]
    return _mixed(out, 0)


def compact_windows(h: np.ndarray, width: int = RUN) -> np.ndarray:
    """Rows c, lo, hi: the subsequences of `width` that start in lo..hi have their minimum at c; of equal ones the leftmost.

    Hashes are compared by their upper 40 bits; the place below them makes the leftmost of equal ones the least, and minima
    of longer stretches are those of two shorter ones.
    """
    n = len(h) - width + 1
    if n < 1:
        return np.empty((3, 0), np.int64)
    low, mask = np.uint64(24), np.uint64((1 << 24) - 1)
    least, span = (h >> low << low) | (np.arange(len(h), dtype=np.uint64) & mask), 1
    while 2 * span <= width:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    start = np.arange(n, dtype=np.uint64)
    at = (start + ((np.minimum(least[:n], least[width - span : width - span + n]) - start) & mask)).astype(np.int64)
    lo = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return np.array([at[lo], lo, np.append(lo[1:], n) - 1], np.int64)


def signatures(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of a shingle sequence, and the place of the first function's minimum for each."""
    each = [(h, compact_windows(h)) for h in (_mixed(s * _MIX[f, 2], f) for f in range(HASHES))]
    cuts = np.unique(np.concatenate([w[1] for _, w in each]))
    found = [(h, w[0][np.searchsorted(w[1], cuts, "right") - 1]) for h, w in each]
    out = np.zeros(len(cuts), np.uint64)
    for f, (h, at) in enumerate(found):
        out = _mixed(out + h[at], f)
    return out, found[0][1]


def windows(docs: DataFrame, text_col: str) -> DataFrame:
    """sig, th (hash of the text), at: the signatures of each text of at least 50 words and their places, each text once in a batch."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs, places, ths, sizes = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [], []
            for th, text in dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)).items():
                s = shingles(text)
                if len(s) >= WIDTH:
                    own, at = signatures(s)
                    sigs.append(own)
                    places.append(at)
                    ths.append(th)
                    sizes.append(len(own))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.repeat(np.array(ths, np.int64), sizes)), pa.array(np.concatenate(places).astype(np.int32))], names=["sig", "th", "at"])

    rows = docs.select(F.xxhash64(text_col).alias("th"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "sig long, th long, at int")


def surroundings(rows: DataFrame) -> DataFrame:
    """k, id, at, n, root, w, s: the shingles around each of the places of rows (th, text, places: sig, at, root, huge), 4 bytes
    each: w in order, s the different ones, for places of huge groups. root is the place's own, or the group's if it is done."""
    bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 100) for b in batches for at in range(0, b.num_rows, 100)):
            cells: list[list] = [[], [], [], [], [], [], []]
            for th, places, text in zip(*[batch.column(c).to_pylist() for c in ("th", "places", "text")], strict=True):
                short = (shingles(text) >> np.uint64(32)).astype("<u4")
                for place in places:
                    w = short[max(0, place["at"] - AROUND) : place["at"] + AROUND]
                    for cell, v in zip(cells, (place["sig"], th, place["at"], len(w), place["root"], w.tobytes(), np.unique(w).astype(np.int64) if place["huge"] else None), strict=True):
                        cell.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, kinds, strict=True)], names=["k", "id", "at", "n", "root", "w", "s"])

    return rows.select("th", "places", "text").mapInArrow(run, "k long, id long, at long, n int, root long, w binary, s array<long>")


def _open(own: DataFrame, found: DataFrame) -> DataFrame:
    """sig, th, at, done, others of the groups in which a place is not done: all their members but the one that was aligned with
    all (others: their number)."""
    sides = [found.select(F.col(t).alias("th"), F.explode(F.transform("passages", lambda p: F.struct(p[f"{t}_start"].alias("start"), p[f"{t}_end"].alias("end")))).alias("p")) for t in "ab"]  # noqa: B023
    spans = sides[0].unionAll(sides[1]).distinct().groupBy("th").agg(F.collect_list("p").alias("spans"))
    inside = F.exists("spans", lambda p: (p["start"] <= F.col("at")) & (F.col("at") + SHINGLE - 1 <= p["end"]))
    rest = own.where("c > 2 and th <> low").join(spans, "th", "left").select("sig", "th", "at", F.coalesce(inside, F.lit(False)).alias("done"))
    rest = materialize(rest.repartition("sig"), "places")
    left = rest.groupBy("sig").agg(F.approx_count_distinct("th").alias("others"), F.min("th").alias("x"), F.max("th").alias("y"), F.bool_and("done").alias("all")).where("x <> y and not all").select("sig", "others")
    out = materialize(rest.join(left, "sig"), "open")
    discard(rest)
    return out


def _rare(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of texts that meet at rare shingles, may have LEAST in common with the frequent ones, and of which one is not
    done; and the members with LEAST frequent ones."""
    key = ["k", "id", "at"]
    each = members.select(*key, (F.col("root") != F.col("k")).alias("open"), F.explode("s").alias("x"))
    counts = each.groupBy("k", "x").agg(F.count("*").alias("c")).where("c > 1")
    shared = materialize(each.join(counts, ["k", "x"]), "shared-shingles")
    many = materialize(shared.where(f"c > {RARE}").groupBy(*key).agg(F.count("*").alias("f")), "frequent-shingles")
    few = shared.where(f"c <= {RARE}").join(many, key, "left").select(*key, "x", "open", F.coalesce("f", F.lit(0)).alias("f"))
    one, other = (few.select("k", "x", F.struct("id", "at", "open", "f").alias(n)) for n in ("p", "q"))
    met = one.join(other, ["k", "x"]).where("p.id < q.id and (p.open or q.open)").groupBy("k", "p", "q").agg(F.count("*").alias("c"))
    pairs = met.where(F.col("c") + F.least("p.f", "q.f") >= LEAST).select(F.col("p.id").alias("a"), F.col("q.id").alias("b")).distinct()
    return pairs, members.join(many.where(f"f >= {LEAST}"), key, "left_semi").drop("s")


def settled(docs: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of texts, whose components are those of all, and a, b and the passages of the linked pairs."""
    every = windows(docs, text_col).repartition("sig")
    # all columns are asked for on both sides, so the windows are made and shuffled once
    shared = every.groupBy("sig").agg(F.min("th").alias("low"), F.max("th").alias("high"), F.count("at").alias("c")).where("low <> high").drop("high")
    own = materialize(every.join(shared, "sig").distinct(), "signatures")
    texts = docs.select(F.xxhash64(text_col).alias("th"), F.col(text_col).cast("string").alias("text"))
    pairs = materialize(own.where("low < th").select(F.col("low").alias("a"), F.col("th").alias("b")).distinct(), "pairs")
    found = verified(pairs, texts)
    open_ = _open(own, found)
    discard(own)
    if open_.isEmpty():
        return found.select("a", "b"), found
    small = open_.where(f"others <= {SMALL}").select("sig", "th", "done").distinct()
    each = small.withColumnsRenamed({"th": "a", "done": "da"}).join(small.withColumnsRenamed({"th": "b", "done": "db"}), "sig").where("a < b and not (da and db)").select("a", "b").distinct()
    large, blocks = open_.where(f"others > {SMALL}"), None
    if not large.isEmpty():
        place = F.struct("sig", "at", F.when(F.col("done"), F.col("sig")).otherwise(F.xxhash64("sig", "th", "at")).alias("root"), (F.col("others") > ONE_BLOCK).alias("huge"))
        named = materialize(large.groupBy("th").agg(F.collect_list(place).alias("places")), "named")
        members = materialize(surroundings(named.join(_once(texts, named), "th")), "surroundings")
        rare, many = _rare(members.where("s is not null"))
        each, blocks = each.unionAll(rare).distinct(), materialize(members.where("s is null").drop("s").unionByName(many), "blocks")
        discard(members)
    each = materialize(each.join(pairs, ["a", "b"], "left_anti"), "pairs")
    discard(open_)
    found = found.unionAll(verified(each, texts))
    if blocks is not None:
        more = links_in_groups(blocks, None, lambda common, x, y: common >= LEAST, Check(dense, lambda x, y: bool(near(x, y))), found.select("a", "b"))
        discard(blocks)
        found = found.unionAll(verified(more.select(F.col("b").alias("a"), F.col("a").alias("b")).distinct().join(found.select("a", "b"), ["a", "b"], "left_anti"), texts))
    return found.select("a", "b"), found


def dense(hits: np.ndarray) -> np.ndarray:
    """For each row of hits (shingles of one text that others have): whether some WIDTH in a row begin in a hit, have LEAST - 1 of
    them, and go on to a hit at their end or shortly behind it. Passages alike by 0.8 do; much cheaper than to align."""
    if hits.shape[1] < WIDTH:
        return np.zeros(len(hits), bool)
    total = np.cumsum(hits, axis=1, dtype=np.int32)
    total = np.concatenate((np.zeros((len(hits), 1), np.int32), total, np.repeat(total[:, -1:], GAP, axis=1)), axis=1)
    n = hits.shape[1] - WIDTH + 1
    ends = total[:, WIDTH + GAP - 1 : WIDTH + GAP - 1 + n] > total[:, WIDTH - 1 : WIDTH - 1 + n]
    return (hits[:, :n] & ends & (total[:, WIDTH : WIDTH + n] - total[:, :n] >= LEAST - 1)).any(axis=1)


def near(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """`align` of two shingle sequences in both directions; once where no shingle that they share is repeated in either."""
    if not len(y):
        return []
    values = np.unique(y)
    common = values[np.searchsorted(values, x).clip(max=len(values) - 1)] == x
    if not dense(common[None, :])[0]:
        return []
    own = x[common]
    if len(values) == len(y) and len(np.unique(own)) == len(own):
        return sorted(align(x, y))
    return sorted({*align(x, y), *((p, q, i, j, v) for i, j, p, q, v in align(y, x))})


def stretch(hit: np.ndarray) -> tuple[int, int, int]:
    """Start, end and score of the stretch with the most hits over twice its misses."""
    total = np.concatenate(([0], np.cumsum(np.where(hit, 1, -2))))
    end = int((total - np.minimum.accumulate(total)).argmax())
    start = int(total[: end + 1].argmin())
    return start, end, int(total[end] - total[start])


def places(values: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of b, each apart from the others, that consist mostly of the given values (sorted)."""
    hit = values[np.searchsorted(values, b).clip(max=len(values) - 1)] == b
    found, todo = [], [(0, len(b))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo >= WIDTH:
            start, end, score = stretch(hit[lo:hi])
            if score >= WIDTH // 2:
                found.append((lo + start, lo + end))
                todo += [(lo, lo + start), (lo + end, hi)]
    return found


def align(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """Near-duplicate passages of two shingle sequences: first and last word in each, and the similarity.

    Stretches of a with many more shingles of b than others are verified by the Jaccard similarity of their shingle sets
    against every place of b that consists of theirs, so a passage that stands at several places is found at each.
    """
    values, where = np.unique(b, return_index=True)
    if not len(values):
        return []
    spot = np.searchsorted(values, a).clip(max=len(values) - 1)
    common = values[spot] == a
    place = np.where(common, where[spot], -1)
    found, todo = [], [(0, len(a))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < WIDTH:
            continue
        start, end, score = stretch(common[lo:hi])
        if score < WIDTH // 2:
            continue
        i, j = lo + start, lo + end  # passage a[i:j]
        spots = place[i:j][common[i:j]]
        k, m = int(np.sort(spots)[len(spots) // 2]), j - i
        near = spots[np.abs(spots - k) <= m]
        sa, alike = np.unique(a[i:j]), []
        for p, q in [*places(sa, b), (int(near.min()), int(near.max()) + 1)]:
            if q - p < WIDTH or any(p < end and start < q for _, _, start, end, _ in alike):
                continue
            sb = np.unique(b[p:q])
            both = len(np.intersect1d(sa, sb, assume_unique=True))
            jaccard = both / (len(sa) + len(sb) - both)
            if m >= WIDTH and jaccard >= SIMILARITY:
                alike.append((i, j, p, q, round(jaccard, 6)))
        if alike:
            found += alike
            todo += [(lo, i), (j, hi)]
        elif m > WIDTH:  # parts of it may still be alike, such as two passages that moved apart
            jump = np.abs(np.diff(np.where(common[i:j], place[i:j] - np.arange(i, j), np.iinfo(np.int64).min // 4)))
            jump[~(common[i + 1 : j] & common[i : j - 1])] = 0
            cut = i + 1 + int(jump.argmax()) if jump.max() > SHINGLE else (i + j) // 2
            todo += [(i, cut), (cut, j), (lo, i), (j, hi)]
        else:
            todo += [(lo, i), (j, hi)]
    return sorted((i, j + SHINGLE - 2, p, q + SHINGLE - 2, x) for i, j, p, q, x in found)


def _once(texts: DataFrame, named: DataFrame) -> DataFrame:
    """th, text: the texts that named has, each once."""
    return materialize(texts.join(named.select("th").distinct(), "th", "left_semi").groupBy("th").agg(F.first("text").alias("text")), "texts")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b and the passages of each of the pairs (a, b) of texts that has any."""
    texts = _once(texts, pairs.select(F.explode(F.array("a", "b")).alias("th")))
    # the last join leaves the pairs of an a together, so its shingles are made once
    both = pairs.join(texts.withColumnsRenamed({"th": "b", "text": "tb"}), "b").join(texts.withColumnsRenamed({"th": "a", "text": "ta"}), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("a_start", pa.int64()), ("a_end", pa.int64()), ("b_start", pa.int64()), ("b_end", pa.int64()), ("similarity", pa.float64())]))
        held: dict[int, np.ndarray] = {}  # shingles of the last texts, which pairs in a row share

        def hashed(th: int, text: str) -> np.ndarray:
            if th not in held:
                if len(held) >= 256:
                    held.pop(next(iter(held)))
                held[th] = shingles(text)
            return held[th]

        for batch in batches:
            cells: list[list] = [[], [], []]
            for a, b, ta, tb in zip(*[batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb")], strict=True):
                got = near(hashed(a, ta), hashed(b, tb))
                if got:
                    for cell, v in zip(cells, (a, b, [dict(zip(("a_start", "a_end", "b_start", "b_end", "similarity"), g, strict=True)) for g in got]), strict=True):
                        cell.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int64(), pa.int64(), kind), strict=True)], names=["a", "b", "passages"])

    kind = "array<struct<a_start:long,a_end:long,b_start:long,b_end:long,similarity:double>>"
    out = materialize(both.select("a", "b", "ta", "tb").mapInArrow(run, f"a long, b long, passages {kind}"), "verified")
    discard(texts)
    return out


def near_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, class_id, copy_of, n_passages and the passages.

    class_id is the smallest doc_id reachable over shared passages; copy_of the smallest doc_id with the same text (of 50
    words or more) if that is another. A passage has its first and last word (from 0), the smallest doc_id of the partner,
    its words there, and the similarity; a text has at least one for each of its near-duplicate passages, to the partners it
    was linked to. Texts of fewer than 50 words, null and empty ones have none and are a class of their own; rows that
    repeat an id and a text are as many rows; null ids are never a class_id unless all of a class are null; other columns
    are not read; an empty table gives no rows.
    """
    links, found = settled(docs, text_col)
    rows = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.coalesce(F.col(text_col).rlike(LONG), F.lit(False)).alias("long")), "rows")
    texts = materialize(rows.where("long").groupBy("th").agg(F.min("doc_id").alias("first")), "firsts")
    linked = components(links).withColumnsRenamed({"node": "th"}).join(texts, "th")
    named = linked.join(linked.groupBy("root").agg(F.min("first").alias("low")), "root").select("th", "low")
    flip = F.transform("passages", lambda p: F.struct(p["b_start"].alias("start"), p["b_end"].alias("end"), p["a_start"].alias("partner_start"), p["a_end"].alias("partner_end"), p["similarity"].alias("similarity")))
    keep = F.transform("passages", lambda p: F.struct(p["a_start"].alias("start"), p["a_end"].alias("end"), p["b_start"].alias("partner_start"), p["b_end"].alias("partner_end"), p["similarity"].alias("similarity")))
    sides = found.select(F.col("a").alias("th"), F.col("b").alias("other"), keep.alias("ps")).unionAll(found.select(F.col("b").alias("th"), F.col("a").alias("other"), flip.alias("ps")))
    partners = sides.join(texts.select(F.col("th").alias("other"), F.col("first").alias("partner")), "other").select("th", F.explode(F.transform("ps", lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.col("partner").alias("partner"), p["partner_start"].alias("partner_start"), p["partner_end"].alias("partner_end"), p["similarity"].alias("similarity")))).alias("p"))
    listed = partners.groupBy("th").agg(F.array_sort(F.collect_list("p")).alias("passages"))
    about = materialize(texts.join(named, "th", "left").join(listed, "th", "left"), "about")
    out = rows.join(about.withColumnRenamed("th", "_th"), (F.col("th") == F.col("_th")) & F.col("long"), "left")
    same = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("doc_id"))
    return out.select("doc_id", F.coalesce("low", "first", "doc_id").alias("class_id"), F.when(same, F.col("first")).alias("copy_of"), F.coalesce(F.size("passages"), F.lit(0)).alias("n_passages"), F.coalesce("passages", F.array()).alias("passages"))
