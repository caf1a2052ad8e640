"""Log queries: filters, latest versions, pages, look-ups and aggregations."""

from __future__ import annotations

import ipaddress
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = {"ip", "method", "status", "event_id", "path", "q", "attack_type"}


@dataclass(frozen=True)
class QuerySpec:
    """[start, end) in ms and filters; refuses unknown filters, long values and a status out of range."""

    start: int
    end: int
    filters: dict[str, object] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.end <= self.start or self.end - self.start > 90 * 86_400_000:
            raise ValueError("the range is empty or longer than 90 days")
        if unknown := set(self.filters) - FILTERS:
            raise ValueError(f"unknown filters: {sorted(unknown)}")
        if any(len(str(v)) > 1024 for v in self.filters.values()) or not 0 <= int(self.filters.get("status", 0)) <= 65535:
            raise ValueError("a filter value is out of range")
        if self.filters.get("ip"):
            ipaddress.ip_address(self.filters["ip"])

    def condition(self, time: str = "event_time", key: str = "record_id") -> Column:
        c = (F.col(time) >= self.start) & (F.col(time) < self.end)
        for name, v in self.filters.items():
            if name == "path":
                c &= F.col("path").contains(v)
            elif name == "q":
                c &= (F.col("ip") == v) | F.col("path").contains(v) | (F.col(key) == v)
            elif name == "attack_type":
                c &= F.array_contains("attack_types", v)
            elif name == "ip":
                c &= F.col("ip") == str(ipaddress.ip_address(v))  # rows are stored in canonical form
            else:
                c &= F.col(key if name == "event_id" else name) == v
        return c


def latest(rows: DataFrame, key: str = "record_id", version: str = "version", tie: str = "off") -> DataFrame:
    """The highest version of each record, by an aggregation with partial maxima instead of a window."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(version, tie)).alias("_r")).select(key, "_r.*")


def search(rows: DataFrame, spec: QuerySpec) -> DataFrame:
    """Latest versions first, then the filters."""
    return latest(rows).where(spec.condition())


def newest(rows: DataFrame, size: int, most: int, time: str, key: str) -> DataFrame:
    """The newest rows, at least one and at most `most`, each with the total of all. The total is one row, so it is broadcast."""
    shown = rows.orderBy(F.desc(time), key).limit(max(1, min(size, most)))
    return shown.join(F.broadcast(rows.agg(F.count("*").alias("total"))))


def investigate_events(events: DataFrame, start: int, end: int, attack_type: str = "all", ip: str | None = None, size: int = 50) -> DataFrame:
    """Security events (event_id, attack_type, detections, log_context) of [start, end) by attack type and ip, newest first:
    flattened, with their first detection and the total of all that match."""
    c, d = F.col("log_context"), F.get("detections", F.lit(0))
    kept = (c["timestamp"] >= start) & (c["timestamp"] < end)
    if attack_type and attack_type.lower() != "all":
        kept &= F.array_contains(F.split("attack_type", ","), attack_type)
    if ip:
        kept &= c["ip"] == ip
    flat = events.where(kept).select("event_id", c["timestamp"].alias("ts_ms"), c["ip"].alias("ip"), c["method"].alias("method"), c["path"].alias("path"), c["status"].alias("status"), "attack_type", d["rule_id"].alias("rule_id"), F.get(d["matches"], F.lit(0))["matched_value"].alias("matched_value"))
    return newest(flat, size, 200, "ts_ms", "event_id")


def investigate_reports(reports: DataFrame, start: int, end: int, risk_level: str = "all", ip: str | None = None, size: int = 20) -> DataFrame:
    """Reports of [start, end] (start 0: since ever) by risk and ip, newest first, with the total of all that match."""
    kept = (F.col("ts_ms") >= start) & (F.col("ts_ms") <= end)
    if risk_level and risk_level.lower() != "all":
        kept &= F.col("risk_level") == risk_level.lower()
    if ip:
        kept &= F.col("ip") == ip
    return newest(reports.where(kept), size, 100, "ts_ms", "event_id")


def page(rows: DataFrame, limit: int, cursor: tuple[int, str] | None = None, time: str = "event_time", key: str = "record_id") -> DataFrame:
    """The next limit + 1 rows (the last says that there are more) in falling order of (time, key), after a cursor."""
    if cursor:
        rows = rows.where((F.col(time) < cursor[0]) | ((F.col(time) == cursor[0]) & (F.col(key) < cursor[1])))
    return rows.orderBy(F.desc(time), F.desc(key)).limit(limit + 1)


def numbered_page(rows: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    if not (1 <= number <= 10 and 1 <= size <= 1000):
        raise ValueError("page or size is out of range")
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def tiers(hot: DataFrame, cold: DataFrame, boundary: int, time: str = "event_time") -> DataFrame:
    """Two disjoint segments: the hot tier from the boundary on, the cold one before it."""
    return hot.where(F.col(time) >= boundary).unionByName(cold.where(F.col(time) < boundary))


def lookup(asked: DataFrame, hot: DataFrame, cold: DataFrame, key: str = "record_id") -> DataFrame:
    """Each asked id with the tier that has it (hot preferred) or not_found."""
    tagged = hot.select(key, F.lit(0).alias("t"), "version").unionByName(cold.select(key, F.lit(1).alias("t"), "version"))
    best = asked.select(key).distinct().join(tagged, key).groupBy(key).agg(F.min_by("version", "t").alias("version"), F.min("t").alias("t"))
    return asked.join(best, key, "left").select(key, F.when(F.col("t").isNull(), "not_found").otherwise("found").alias("state"), F.when(F.col("t") == 0, "hot").when(F.col("t") == 1, "cold").alias("tier"), "version")


#: Groups that a count by a dimension may have.
MOST_GROUPS = 100_000


def counts(rows: DataFrame, dim: str, top: int | None = None, most: int = MOST_GROUPS) -> DataFrame:
    """Rows by a dimension (nulls excluded), most first, ties by the value as text; with more than `most` groups the query fails.

    The check is on a count of groups that goes no further than one above the limit, one row that is joined to all.
    """
    out = rows.where(F.col(dim).isNotNull()).groupBy(F.col(dim).cast("string").alias("value")).agg(F.count("*").alias("n"))
    size = out.limit(most + 1).agg(F.count("*").alias("_groups"))
    checked = F.when(F.col("_groups") > most, F.raise_error(F.lit(f"more than {most} groups of {dim}"))).otherwise(F.col("n"))
    out = out.join(F.broadcast(size)).select("value", checked.cast("long").alias("n"))
    return out.orderBy(F.desc("n"), "value").limit(top) if top else out


def all_counts(rows: DataFrame, dims: list[str]) -> DataFrame:
    """All dimensions and the total in one pass over grouping sets: dim, value, n."""
    typed = rows.select(*[F.col(d).cast("string").alias(d) for d in dims])
    out = typed.groupingSets([[d] for d in dims] + [[]], *dims).agg(F.count("*").alias("n"), F.grouping_id().alias("_g"))
    full = (1 << len(dims)) - 1
    code = {d: full ^ (1 << (len(dims) - 1 - i)) for i, d in enumerate(dims)}
    dim, value = F.lit("total"), F.lit(None).cast("string")
    for d in dims:
        dim, value = F.when(F.col("_g") == code[d], d).otherwise(dim), F.when(F.col("_g") == code[d], F.col(d)).otherwise(value)
    return out.select(dim.alias("dim"), value.alias("value"), "n").where("value is not null or dim = 'total'")


def top_each(counted: DataFrame, k: int) -> DataFrame:
    """The k most frequent values of each dimension."""
    w = Window.partitionBy("dim").orderBy(F.desc("n"), "value")
    return counted.where("dim <> 'total'").withColumn("rank", F.row_number().over(w)).where(f"rank <= {k}")


def hourly(rows: DataFrame, time: str = "event_time") -> DataFrame:
    return rows.groupBy((F.col(time) - F.col(time) % 3_600_000).alias("hour_ms")).agg(F.count("*").alias("n"))


def trend(rows: DataFrame, start: int, end: int, time: str = "event_time") -> DataFrame:
    """Hourly counts from the start's hour to before end, zero where there are none."""
    hours = rows.sparkSession.range(start - start % 3_600_000, end, 3_600_000).withColumnRenamed("id", "hour_ms")
    return hours.join(hourly(rows.where((F.col(time) >= start) & (F.col(time) < end)), time), "hour_ms", "left").select("hour_ms", F.coalesce("n", F.lit(0)).alias("n"))


def short_number(n: Column) -> Column:
    return F.when(n >= 1_000_000, F.concat(F.round(n / 1_000_000, 1).cast("string"), F.lit("M"))).when(n >= 1000, F.concat(F.round(n / 1000, 1).cast("string"), F.lit("K"))).otherwise(n.cast("string"))
