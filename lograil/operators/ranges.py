"""Aggregates over what stands before or after a row in its group, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lograil.sources.scratch import table

_JOINED = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": F.greatest, "min": F.least}
_FUNCTION = {"sum": F.sum, "max": F.max, "min": F.min}


def scan(rows: DataFrame, group: list[str], order: list[str], found: dict[str, tuple[str, Column, str]]) -> DataFrame:
    """Adds columns {name: (sum, max or min, value, before or after)}: the aggregate over the rows of the group that stand
    before or after a row by `order`, itself not included; sums of nothing are 0, extremes of nothing null.

    Rows are range-partitioned by (group, order), so a group with a third of all rows lies over many tasks. A partition
    continues at most one group of the one before it and one of the one behind it, so what is carried over, and
    broadcast, is two rows a partition at most. Nulls in the group form a group; rows of equal order stand in one
    partition, in no defined order.
    """
    ranged = table(rows.repartitionByRange(*group, *order).withColumn("_pid", F.spark_partition_id()), "ranged")
    back = [F.desc_nulls_last(o) for o in order]
    for side, by_row, by_part in (("before", order, "_pid"), ("after", back, F.desc("_pid"))):
        own = {n: (fn, value) for n, (fn, value, s) in found.items() if s == side}
        if not own:
            continue
        parts = ranged.groupBy("_pid", *group).agg(*[_FUNCTION[fn](value).alias(f"_{n}") for n, (fn, value) in own.items()])
        earlier = Window.partitionBy(*group).orderBy(by_part).rowsBetween(Window.unboundedPreceding, -1)
        carried = parts.select(F.col("_pid").alias("_cpid"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.count("*").over(earlier).alias("_ck"), *[_FUNCTION[fn](f"_{n}").over(earlier).alias(f"_c{n}") for n, (fn, _) in own.items()])
        on = F.col("_pid") == F.col("_cpid")
        for i, g in enumerate(group):
            on &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
        here = Window.partitionBy("_pid", *group).orderBy(*by_row).rowsBetween(Window.unboundedPreceding, -1)
        ranged = ranged.withColumns({f"_l{n}": _FUNCTION[fn](value).over(here) for n, (fn, value) in own.items()}).join(F.broadcast(carried.where("_ck > 0")), on, "left")
        ranged = ranged.withColumns({n: _JOINED[fn](F.col(f"_l{n}"), F.col(f"_c{n}")) for n, (fn, _) in own.items()})
        ranged = ranged.drop("_cpid", "_ck", *[f"_g{i}" for i in range(len(group))], *[f"_{x}{n}" for n in own for x in "lc"])
    return ranged.drop("_pid")
