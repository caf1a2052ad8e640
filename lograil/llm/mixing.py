"""Mixing sources to target weights by systematic sampling.

Each document's expected copies are laid end to end within its source, one random offset is added, and the document is
emitted once for each integer boundary that its stretch crosses. Documents lie in order of size, so that every stretch of
a source has its share of words and the words taken come near the target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lograil.llm._common import exclusive_prefix, materialize, word_count

#: Fixed values of the production mix: weights by the source's place in code point order, share of all words, most copies.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target for each source of (source, size); nulls are one source, the last.

    Targets stop at cap times the source's size; the excess goes to the others by weight until none is above. That is one
    level L with target = min(cap * size, L * weight): in order of cap * size / weight, it is found at the first source
    whose own ratio is not below what is left for it and those behind, by weight. Sources are ranked and summed over
    range partitions, however many there are.
    """
    one = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("last", F.col("source").isNull())
    ranked = exclusive_prefix(one.withColumn("one", F.lit(1)), ["last", "source"], "one", "place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = ranked.select("source", "last", F.col("source_size").cast("double").alias("source_size"), weight.cast("double").alias("w"))
    weighed = materialize(weighed.withColumn("ratio", F.lit(cap) * F.col("source_size") / F.col("w")), "weighed")
    filled = exclusive_prefix(weighed, ["ratio", "last", "source"], "source_size", "size_before")
    filled = exclusive_prefix(filled, ["ratio", "last", "source"], "w", "w_before")
    total = weighed.agg(F.sum("source_size").alias("total"), F.sum("w").alias("w_total"))
    left = F.lit(share) * F.col("total") - F.lit(cap) * F.col("size_before")
    level = filled.join(F.broadcast(total)).withColumn("level", left / (F.col("w_total") - F.col("w_before"))).where("ratio >= level").agg(F.min_by("level", F.struct("ratio", F.col("last"), "source")).alias("level"))
    return weighed.join(F.broadcast(level)).select("source", F.col("source_size").cast("long").alias("source_size"), F.least(F.lit(cap) * F.col("source_size"), F.coalesce("level", F.lit(0.0)) * F.col("w")).alias("target"))


def mix_sizes(rows: DataFrame, seed: int = 17, **rule) -> DataFrame:
    """rows (source, size, and columns that make the order unique) with source_size, target and copies.

    rows must have columns source, size, k1, k2: ties of size are ordered by k1, then k2.
    """
    aims = materialize(targets(rows.select("source", "size"), **rule), "targets").withColumnRenamed("source", "_source")
    joined = rows.join(aims, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    placed = exclusive_prefix(joined.withColumns({"one": F.lit(1), "falling": -F.col("size")}), ["falling", "k1", "k2"], "one", "rank", group=["source"])
    offset = F.pmod(F.xxhash64(F.lit(seed), F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull()), F.lit(1 << 30)) / F.lit(float(1 << 30))
    upto = lambda r: F.floor(offset + expected * r)
    return placed.withColumn("copies", (upto(F.col("rank") + 1) - upto(F.col("rank"))).cast("long")).drop("one", "falling", "rank")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, **rule) -> DataFrame:
    """doc_id, size (words of the whole text), source_size, target (of the source) and taken (words, repeats counted).

    One row for each row of docs. Null texts have size 0, null sources are one source behind all others, null ids come
    first among documents of equal size. Repeated rows are documents of their own and, being alike, may take each other's
    place. Other columns are not read; an empty table gives no rows. The offset depends on the seed and the source alone,
    so reruns agree. A source of any size is dealt over many tasks.
    """
    sized = docs.select(F.col(id_col).cast("long").alias("k1"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("k2"))
    mixed = mix_sizes(materialize(sized, "sizes"), seed, **rule)
    return mixed.select(F.col("k1").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def emit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, **rule) -> DataFrame:
    """docs, each row as many times as the mix takes it, with all its columns.

    Copies are decided on ids, sizes and a hash of all columns, and joined back to the rows. So rows that differ in any
    column are documents of their own; only rows that are equal in all of them are one there, with the sum of their copies.
    Null texts have size 0, null sources are one source; an empty table gives no rows; extra columns stay as they are
    (none may be a map, which has no hash).
    """
    own = {"k1": F.col(id_col).cast("long"), "k2": F.xxhash64(*docs.columns), "source": F.col(source_col).cast("string")}
    rows = docs.select(F.struct("*").alias("_row"), *[c.alias(f"_{n}") for n, c in own.items()])
    sized = docs.select(*[c.alias(n) for n, c in own.items()], word_count(F.col(text_col)).alias("size"))
    chosen = mix_sizes(materialize(sized, "sizes"), seed, **rule).groupBy("source", "k1", "k2").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0")
    got = rows.join(materialize(chosen, "chosen"), F.col("_k1").eqNullSafe(F.col("k1")) & (F.col("_k2") == F.col("k2")) & F.col("_source").eqNullSafe(F.col("source")))
    once = got.where("rows > 1").groupBy("_k1", "_k2", "_source").agg(F.first("_row").alias("_row"), F.first("copies").alias("copies"))
    out = got.where("rows = 1").select("_row", "copies").unionByName(once.select("_row", "copies"))
    return out.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("_row.*")
