"""Archive integrity: identities, verdicts, manifests, offsets, gaps and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lograil.functions.decode import canonical_json
from lograil.operators.logquery import latest


def merge(existing: DataFrame, incoming: DataFrame, key: str = "record_id") -> DataFrame:
    """Upsert by key: a higher or equal version wins, stale writes are dropped; every record once."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    return latest(both, key, "version", "_new").drop("_new")


def merge_reports(old: DataFrame, new: DataFrame, business: list[str], kept: list[str], key: str = "event_id") -> DataFrame:
    """Report upsert: business columns from the new row where there is one, review columns from the old."""
    o, n = old.select(key, *[F.col(c).alias(f"_o_{c}") for c in [*business, *kept]], F.lit(True).alias("_o")), new.select(key, *[F.col(c).alias(f"_n_{c}") for c in [*business, *kept]], F.lit(True).alias("_n"))
    j = o.join(n, key, "full")
    return j.select(key, *[F.when(F.col("_n"), F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}")).alias(c) for c in business], *[F.when(F.col("_o"), F.col(f"_o_{c}")).otherwise(F.col(f"_n_{c}")).alias(c) for c in kept])


def conflicts(rows: DataFrame, raw: bool = False) -> DataFrame:
    """Rows of a record that contradict the one before them (by version, offset): the first reason. Raw rows never change
    their content; rows of a source_kind other than kafka, where there is that column, may come from elsewhere."""
    w = Window.partitionBy("record_id").orderBy("version", "off")
    streamed = F.col("source_kind") == "kafka" if "source_kind" in rows.columns else F.lit(True)
    rows = rows.withColumn("_streamed", F.coalesce(streamed, F.lit(False)))
    p = {c: F.lag(c).over(w) for c in ("event_time", "version", "payload_hash", "topic", "part", "_streamed")}
    other = p["payload_hash"] != F.col("payload_hash")
    moved = p["_streamed"] & F.col("_streamed") & ((p["topic"] != F.col("topic")) | (p["part"] != F.col("part")))
    reason = F.when(p["event_time"] != F.col("event_time"), "event time changed").when(F.lit(raw) & other, "raw content changed").when((p["version"] == F.col("version")) & other, "same version, other content").when(moved, "other source")
    return rows.select("record_id", "version", "off", reason.alias("reason")).where("reason is not null")


def existing(stored: DataFrame, keys: DataFrame) -> DataFrame:
    """Stored latest rows of a key set, and whether their event times conflict."""
    rows = stored.join(keys.select("record_id").distinct(), "record_id", "left_semi")
    times = rows.groupBy("record_id").agg((F.min("event_time") != F.max("event_time")).alias("conflict"))
    return latest(rows).join(times, "record_id")


def verdicts(expected: DataFrame, actual: DataFrame, events: bool = True, bounds: DataFrame | None = None) -> DataFrame:
    """Each expected row against the archive: missing, time differs, wrong source, verified, newer or mismatch.

    Rows without a source_kind are streamed ones. Other content proves a newer event only for events, from a streamed row:
    behind the expected offset of the same partition, or, where the expected row was backfilled, at or behind the
    partition's handoff in bounds (topic, part, handoff).
    """
    kind = lambda df: F.col("source_kind") if "source_kind" in df.columns else F.lit("kafka")
    a = actual.select("record_id", kind(actual).alias("a_kind"), *[F.col(c).alias(f"a_{c}") for c in ("event_time", "version", "payload_hash", "topic", "part", "off")])
    j = expected.withColumn("_kind", kind(expected)).join(a, "record_id", "left")
    edge = F.lit(None).cast("long")
    if bounds is not None:
        j = j.join(bounds.select(F.col("topic").alias("a_topic"), F.col("part").alias("a_part"), F.col("handoff").alias("_edge")), ["a_topic", "a_part"], "left")
        edge = F.col("_edge")
    same = (F.col("topic") == F.col("a_topic")) & (F.col("part") == F.col("a_part"))
    streamed, was = F.col("a_kind") == "kafka", F.col("_kind") == "kafka"
    equal = (F.col("payload_hash") == F.col("a_payload_hash")) & (F.col("a_version") >= F.col("version"))
    newer = F.lit(events) & streamed & F.when(was, same & (F.col("a_off") > F.col("off"))).otherwise(F.col("a_off") >= edge)
    v = F.when(F.col("a_version").isNull(), "missing").when(F.col("event_time") != F.col("a_event_time"), "time differs").when(equal & streamed & was & ~same, "wrong source").when(equal, "verified").when(newer, "newer").otherwise("mismatch")
    return j.select("record_id", "version", "off", v.alias("verdict"))


def rebuilt(stored: DataFrame) -> DataFrame:
    """Rows rebuilt from stored documents, and the first reason why the stored identity differs (null: none does).

    stored: record_id, version, payload_hash (all as stored), source_kind, off, payload (JSON). The content is hashed in its
    canonical form, without what storage itself has put into it.
    """
    kept = F.expr("to_json(map_filter(from_json(payload, 'map<string,string>'), (k, v) -> k <> '_storage'))")
    text = F.when(F.get_json_object("payload", "$._storage").isNull(), F.col("payload")).otherwise(kept)
    own = F.get_json_object("payload", "$.event_id")
    rows = stored.withColumn("_raw", canonical_json(text)).withColumn("_id", F.when(F.coalesce(own, F.lit("")) != "", own).when(F.col("source_kind") == "es_backfill", F.col("record_id")))
    rows = rows.withColumn("_version", F.when(F.col("source_kind") == "kafka", F.col("off") + 2).otherwise(1).cast("long")).withColumn("_hash", F.sha2("_raw", 256))
    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    reason = F.when(F.col("_raw").isNull(), "no document").when(F.col("_id").isNull(), "event id is missing").when(differs("_id", "record_id"), "record id differs").when(differs("_version", "version"), "version differs").when(differs("_hash", "payload_hash"), "content differs")
    return rows.select(F.col("_id").alias("record_id"), F.col("_version").alias("version"), F.col("_hash").alias("payload_hash"), reason.alias("reason"))


def manifest_buckets(rows: DataFrame, digits: int = 3) -> DataFrame:
    """The lower level of the hash tree: bucket, n, digest for each beginning of `digits` hex digits of the row hashes.

    A row's hash is that of "record_id:payload_hash". Equal rows become one with a count before anything is gathered, so
    a bucket holds different hashes, evenly spread: about rows / 16^digits, in order, with their counts.
    """
    each = rows.select(F.sha2(F.concat_ws(":", F.coalesce("record_id", F.lit("")), F.coalesce("payload_hash", F.lit(""))), 256).alias("h")).groupBy("h").agg(F.count("*").alias("c"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("h", "c"))), lambda x: F.concat_ws(":", x["h"], x["c"].cast("string"))), "\n")
    return each.groupBy(F.substring("h", 1, digits).alias("bucket")).agg(F.sum("c").alias("n"), F.sha2(listed, 256).alias("digest"))


def manifest(rows: DataFrame, digits: int = 3) -> DataFrame:
    """n and the root digest: the hash of "bucket:n:digest" of all buckets in order, at most 16^digits short lines."""
    line = F.concat_ws(":", "bucket", F.col("n").cast("string"), "digest")
    return manifest_buckets(rows, digits).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("digest"))


def manifest_differences(a: DataFrame, b: DataFrame, digits: int = 3) -> DataFrame:
    """Buckets in which two sets of rows differ, with their counts: only these need a comparison of rows."""
    x, y = manifest_buckets(a, digits), manifest_buckets(b, digits).select("bucket", F.col("n").alias("m"), F.col("digest").alias("other"))
    return x.join(y, "bucket", "full").where(~F.col("digest").eqNullSafe(F.col("other"))).select("bucket", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m"))


def cleanup_plan(rows: DataFrame, checkpoints: DataFrame, now_ms: int, days: int = 7) -> DataFrame:
    """Day partitions past the hot tier: expired ones are eligible if every source offset is behind its checkpoint."""
    day = (F.col("event_time") - F.col("event_time") % 86_400_000).alias("day_ms")
    top = rows.groupBy(day, "topic", "part").agg(F.max("off").alias("off"), F.count("*").alias("n"))
    j = top.join(checkpoints.select("topic", "part", "next_offset"), ["topic", "part"], "left")
    return j.groupBy("day_ms").agg(F.sum("n").alias("n"), F.bool_and(F.coalesce(F.col("off") < F.col("next_offset"), F.lit(False))).alias("behind")).where(F.col("day_ms") + 86_400_000 <= now_ms - days * 86_400_000).select("day_ms", "n", F.when(F.col("behind"), "ELIGIBLE").otherwise("BLOCKED").alias("state"))


def cleanup_proof(rows: DataFrame, archive: DataFrame, checkpoints: DataFrame, now_ms: int, days: int = 7) -> DataFrame:
    """Day partitions past the hot tier (rows have `day`, yyyy-MM-dd) and the first reason why one may not be dropped.

    A day is ELIGIBLE if all its rows are inside it, all are verified by the archive, and every source offset is behind its
    checkpoint. A plan only: nothing is deleted.
    """
    start = F.unix_millis(F.to_timestamp("day", "yyyy-MM-dd"))
    old = rows.withColumn("day_ms", start).where(F.col("day_ms") + 86_400_000 <= now_ms - days * 86_400_000)
    judged = verdicts(old, archive).select("record_id", "version", "off", F.col("verdict").isin("verified", "newer").alias("good"))
    whole = old.join(judged, ["record_id", "version", "off"]).withColumn("inside", (F.col("event_time") >= F.col("day_ms")) & (F.col("event_time") < F.col("day_ms") + 86_400_000))
    top = whole.groupBy("day", "topic", "part").agg(F.max("off").alias("off"), F.count("*").alias("n"), F.bool_and("inside").alias("inside"), F.bool_and("good").alias("good"))
    behind = F.coalesce(F.col("off") < F.col("next_offset"), F.lit(False))
    by = top.join(checkpoints.select("topic", "part", "next_offset"), ["topic", "part"], "left").groupBy("day").agg(F.sum("n").alias("n"), F.bool_and("inside").alias("inside"), F.bool_and("good").alias("good"), F.bool_and(behind).alias("behind"))
    reason = F.when(~F.col("inside"), "rows outside their day").when(~F.col("good"), "rows that the archive does not verify").when(~F.col("behind"), "offsets ahead of the checkpoint")
    return by.select("day", "n", F.when(reason.isNull(), "ELIGIBLE").otherwise("BLOCKED").alias("state"), reason.alias("reason"))


def certify(source: DataFrame, archive: DataFrame, start: int) -> DataFrame:
    """Whether all source rows are verified, none is before start, and the counts agree."""
    v = verdicts(source, archive).agg(F.count("*").alias("source_rows"), F.count_if(~F.col("verdict").isin("verified", "newer")).alias("bad"))
    t = source.agg(F.count_if(F.col("event_time") < start).alias("early"))
    return v.join(F.broadcast(t)).join(F.broadcast(archive.agg(F.count("*").alias("archive_rows")))).select("*", ((F.col("bad") == 0) & (F.col("early") == 0) & (F.col("source_rows") == F.col("archive_rows"))).alias("certified"))


def handoff(checkpoints: DataFrame, handoffs: DataFrame) -> DataFrame:
    """Each partition of either side: complete if initial <= handoff <= next."""
    j = checkpoints.join(handoffs, ["topic", "part"], "full")
    ok = F.coalesce(F.col("handoff").between(F.col("initial_offset"), F.col("next_offset")), F.lit(False))
    return j.select("topic", "part", "handoff", ok.alias("complete"))


def observe(checkpoints: DataFrame, observed: DataFrame) -> DataFrame:
    """Lag and status of each partition against the observed low and high offsets."""
    j = checkpoints.drop("observed_offset").join(observed, ["topic", "part"], "left")
    s = F.when(F.col("high").isNull(), "partition missing").when(F.col("next_offset") < F.col("low"), "retention loss").when(F.col("next_offset") > F.col("high"), "reset").otherwise("ok")
    return j.select("topic", "part", (F.col("high") - F.col("next_offset")).alias("lag"), s.alias("status"))


def observed(checkpoints: DataFrame, now: DataFrame, at_ms: int) -> DataFrame:
    """Checkpoints after a look at the topics (topic, part, low, high, partition_count, generation): status of each partition.

    Partitions that are new start at low. Where the status is ok, partition_count, observed_offset and checked_at are those
    of the look; elsewhere the checkpoint stays as it is and the first reason is the status.
    """
    n = now.select("topic", "part", "low", "high", F.col("partition_count").alias("_count"), F.col("generation").alias("_generation"))
    j = n.join(checkpoints, ["topic", "part"], "full")
    old = F.col("next_offset").isNotNull()
    status = (
        F.when(F.col("high").isNull(), "partition missing").when(old & (F.col("generation") != F.col("_generation")), "generation changed").when(old & (F.col("partition_count") != 0) & (F.col("partition_count") != F.col("_count")), "partition count changed")
        .when(F.col("next_offset") < F.col("low"), "retention loss").when(F.col("next_offset") > F.col("high"), "reset").otherwise("ok")
    )
    fresh = lambda new, kept: F.when(status == "ok", new).otherwise(F.col(kept))
    return j.select(
        "topic", "part", F.coalesce("initial_offset", "low").alias("initial_offset"), F.coalesce("next_offset", "low").alias("next_offset"), fresh(F.col("high"), "observed_offset").alias("observed_offset"), fresh(F.col("_count"), "partition_count").alias("partition_count"),
        fresh(F.lit(at_ms).cast("long"), "checked_at").alias("checked_at"), F.coalesce("generation", "_generation").alias("generation"), (F.col("high") - F.coalesce("next_offset", "low")).alias("lag"), status.alias("status"),
    )


def handoff_proof(checkpoints: DataFrame, handoffs: DataFrame, now_ms: int, most_lag_ms: int = 30_000) -> DataFrame:
    """Each topic: whether its partitions are those of the handoff, all lie within their checkpoints, none lags, all are fresh."""
    j = checkpoints.join(handoffs, ["topic", "part"], "full")
    both = F.coalesce(F.col("next_offset").isNotNull() & F.col("handoff").isNotNull(), F.lit(False))
    every = lambda c: F.bool_and(F.coalesce(c, F.lit(False)))
    by = j.groupBy("topic").agg(every(both).alias("exact"), every(F.col("handoff").between(F.col("initial_offset"), F.col("next_offset"))).alias("within"), every(F.col("next_offset") >= F.col("observed_offset")).alias("caught_up"), every(F.col("checked_at") >= now_ms - most_lag_ms).alias("fresh"))
    return by.withColumn("complete", F.col("exact") & F.col("within") & F.col("caught_up") & F.col("fresh"))


def hot_coverage(checkpoints: DataFrame, open_gaps: DataFrame, windows: DataFrame, now_ms: int, source: str, generation: str, most_lag_ms: int = 30_000) -> DataFrame:
    """Whether each topic's hot tier may be read, and the first reason why not.

    All partitions 0..count-1 are there, of this generation, checked within most_lag_ms and caught up; no gap is open; and
    a verified live window (topic, window_id, verified, live, source, generation, part, handoff: one row a partition) has a
    handoff within every partition's checkpoint.
    """
    ok = (F.col("generation") == generation) & (F.col("checked_at") >= now_ms - most_lag_ms) & (F.col("next_offset") >= F.col("observed_offset"))
    c = checkpoints.groupBy("topic").agg((F.count("*") == F.max("partition_count")).alias("n"), (F.countDistinct("part") == F.max("partition_count")).alias("d"), ((F.min("part") == 0) & (F.max("part") == F.max("partition_count") - 1)).alias("r"), F.bool_and(F.coalesce(ok, F.lit(False))).alias("ok"), F.count("*").alias("parts"))
    g = open_gaps.where("state = 'open'").select("topic").distinct().withColumn("_gap", F.lit(True))
    right = windows.where("verified and live").where((F.col("source") == source) & (F.col("generation") == generation)).select("topic", "window_id", "part", "handoff")
    held = right.join(checkpoints.select("topic", "part", "initial_offset", "next_offset"), ["topic", "part"]).where(F.col("handoff").between(F.col("initial_offset"), F.col("next_offset")))
    full = held.groupBy("topic", "window_id").agg(F.countDistinct("part").alias("held")).groupBy("topic").agg(F.max("held").alias("held"))
    reason = F.when(~(F.col("n") & F.col("d") & F.col("r")), "partitions are missing").when(~F.col("ok"), "consumers are behind or unavailable").when(F.col("_gap"), "unresolved gaps").when(F.coalesce("held", F.lit(0)) < F.col("parts"), "no certified live window")
    return c.join(g, "topic", "left").join(full, "topic", "left").select("topic", reason.isNull().alias("ready"), reason.alias("reason"))


def advance(checkpoints: DataFrame, written: DataFrame) -> DataFrame:
    """next_offset moved to behind the last row written; it never goes back."""
    top = written.groupBy("topic", "part").agg((F.max("off") + 1).alias("_top"))
    return checkpoints.join(top, ["topic", "part"], "left").select("topic", "part", F.greatest("next_offset", F.coalesce("_top", "next_offset")).alias("next_offset"))


def gaps(positions: DataFrame, written: DataFrame) -> DataFrame:
    """Registered gaps, each position once, open until it has been written."""
    key = ["topic", "part", "off"]
    w = written.select(*key).distinct().withColumn("_w", F.lit(True))
    return positions.select(*key).dropDuplicates(key).join(w, key, "left").select(*key, F.when(F.col("_w"), "resolved").otherwise("open").alias("state"))


def outbox(notices: DataFrame, written: DataFrame) -> DataFrame:
    """Notices of written positions that have none yet; running it again adds nothing."""
    key = ["topic", "part", "off"]
    return written.select(*key, "record_id").dropDuplicates(key).join(notices.select(*key), key, "left_anti")


def coverage(windows: DataFrame, start: int, end: int | None = None, now_ms: int | None = None, source: str | None = None) -> DataFrame:
    """For each kind, how far verified windows reach from start without a hole, and whether that is up to end.

    A kind whose first window begins later is covered up to start. Windows of another source (column source) do not count;
    live ones (column live) that are reached extend to now.
    """
    ordered = Window.partitionBy("kind").orderBy("start_ms", "end_ms")
    kinds = windows.select("kind").distinct()
    seen = windows.where("verified").where(F.col("end_ms") > start)
    if source is not None:
        seen = seen.where(F.col("source") == source)
    if now_ms is not None and "live" in windows.columns:
        seen = seen.withColumn("end_ms", F.when(F.col("live"), F.greatest("end_ms", F.lit(now_ms))).otherwise(F.col("end_ms")))
    upto = F.coalesce(F.max("end_ms").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(start))
    holes = seen.withColumn("hole", (F.col("start_ms") > F.greatest(upto, F.lit(start))).cast("int")).withColumn("island", F.sum("hole").over(ordered))
    reached = holes.where("island = 0").groupBy("kind").agg(F.max("end_ms").alias("covered_to"))
    out = kinds.join(reached, "kind", "left").withColumn("covered_to", F.coalesce("covered_to", F.lit(start)))
    return out if end is None else out.withColumn("complete", F.col("covered_to") >= end)


def hot_ready(checkpoints: DataFrame, open_gaps: DataFrame) -> DataFrame:
    """Whether each topic has all partitions, is caught up, and has no open gap."""
    g = open_gaps.where("state = 'open'").select("topic").distinct().withColumn("_g", F.lit(True))
    c = checkpoints.groupBy("topic").agg((F.count("*") == F.max("partition_count")).alias("complete"), F.bool_and(F.col("next_offset") >= F.col("observed_offset")).alias("caught_up"))
    return c.join(g, "topic", "left").select("topic", "complete", "caught_up", F.col("_g").isNull().alias("no_gap"), (F.col("complete") & F.col("caught_up") & F.col("_g").isNull()).alias("ready"))
