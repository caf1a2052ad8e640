"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lograil.sources.scratch import discard, scratch_dir
from lograil.sources.scratch import table as materialize

#: Words of every operator here: maximal runs of other bytes than ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"


def bounded_batches(spark: SparkSession) -> None:
    """Bound an Arrow batch by 16 MB instead of Spark's 64 MB, for batches of very long texts; a bound that was set stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) == "67108864b":
        spark.conf.set(name, "16m")


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def exclusive_prefix(df: DataFrame, order: Sequence[str], value: str, out: str, group: Sequence[str] = ()) -> DataFrame:
    """Add `out`: the sum of `value` over the rows before this one in its group, by `order` (which must be unique).

    Rows are range-partitioned by (group, order), so a group of any size is dealt over many tasks; only one sum for
    each group and partition travels further. Nulls in group columns form a group, nulls of `value` count as 0.
    """
    keys = [*group, *order]
    ranged = materialize(df.repartitionByRange(*keys).withColumn("_pid", F.spark_partition_id()), "prefix")
    sums = ranged.groupBy(*group, "_pid").agg(F.sum(value).alias("_s"))
    before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_pid").alias("_p"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off"))
    on = F.col("_pid") == F.col("_p")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    local = Window.partitionBy("_pid", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("_loc", F.coalesce(F.sum(value).over(local), F.lit(0)))
    return summed.join(offsets, on).withColumn(out, F.col("_off") + F.col("_loc")).drop("_pid", "_p", "_off", "_loc", *[f"_g{i}" for i in range(len(group))])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected edges (a, b) of longs: one row (node, root) for each node, root the smallest.

    Alternates large-star and small-star steps until the edges are a set of stars; each step is a grouped minimum with
    partial aggregation and a join, written to the shared folder, so that neither links nor components reach the driver.
    Self-loops and nulls are ignored; no edges give no rows.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m")), F.struct(F.col("b").alias("a"), F.col("m")))).alias("e"))
        before, now = now, materialize(small.select(F.col("e.a").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct(), "edges")
        discard(before)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


__all__ = ["WORD", "bounded_batches", "components", "discard", "exclusive_prefix", "materialize", "scratch_dir", "word_count"]
