"""The retrieval corpus: chunks, sessions, quality gate, incremental pull."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lograil.operators.ranges import scan
from lograil.sources.scratch import table


def markdown_chunks(pages: DataFrame, col: str = "text") -> DataFrame:
    """One chunk for each H2 section: id doc::i, the H1 (or the doc id) in front, headings kept; pages without doc_id,
    attack_type or H2 go."""
    front = F.regexp_extract(col, r"(?s)^---\s*\n(.*?)\n---", 1)
    meta = lambda k: F.trim(F.regexp_extract(front, rf"(?m)^{k}:\s*(.*)$", 1))
    body = F.concat(F.lit("\n"), F.regexp_replace(col, r"(?s)^---\s*\n.*?\n---\s*\n?", ""))
    rows = pages.select(meta("doc_id").alias("doc_id"), meta("attack_type").alias("attack_type"), F.trim(F.regexp_extract(body, r"(?m)^#\s+(.*)$", 1)).alias("h1"), F.split(body, r"(?m)^(?=##\s+\S)").alias("parts"))
    kept = rows.where((F.col("doc_id") != "") & (F.col("attack_type") != "") & (F.size("parts") > 1))
    title = F.when(F.col("h1") == "", F.col("doc_id")).otherwise(F.col("h1"))
    each = kept.select("doc_id", "attack_type", title.alias("title"), F.posexplode(F.slice("parts", F.lit(2), F.size("parts") - 1)).alias("i", "part"))
    return each.select(F.concat("doc_id", F.lit("::"), F.col("i")).alias("source_id"), "attack_type", F.concat(F.lit("# "), "title", F.lit("\n\n"), F.trim("part", F.lit(" \n\r\t\f\x0b"))).alias("content"))


def _text(rows: DataFrame, name: str) -> Column:
    """A column as text, null where it is missing, blank or 0."""
    if name not in rows.columns:
        return F.lit(None).cast("string")
    kept = F.col(name).cast("string")
    return F.when(~kept.isin("", "0"), kept)


def described(rows: DataFrame) -> Column:
    """Parts of an event in fixed order: type, rule, value, ip, request, status, agent, time; else 200 characters of its title or summary."""
    part = lambda label, name: F.concat(F.lit(label), _text(rows, name))
    request = F.when(_text(rows, "method").isNotNull(), F.rtrim(F.concat(F.lit("request="), F.concat_ws(" ", _text(rows, "method"), _text(rows, "path")))))
    parts = F.concat_ws(" ", part("attack_type=", "attack_type"), part("rule_id=", "rule_id"), part("matched_value=", "matched_value"), part("ip=", "ip"), request, part("status=", "status"), part("ua=", "user_agent"), part("@", "ts_ms"))
    return F.when(parts != "", parts).otherwise(F.coalesce(F.substring(F.coalesce(_text(rows, "title"), _text(rows, "summary")), 1, 200), F.lit("")))


def event_evidence(events: DataFrame) -> DataFrame:
    """One text for each event (see `described`; columns that are missing count as blank); events without any part go."""
    return events.select(F.col("event_id").alias("source_id"), described(events).alias("content")).where("content <> ''")


def _times(logs: DataFrame, span_ms: int) -> DataFrame:
    """The distinct times of each ip (probe 0) and a span behind them (probe 1): ip, ts_ms, at, probe, and the times around at."""
    marks = F.explode(F.array(F.struct(F.col("ts_ms").alias("at"), F.lit(0).alias("probe")), F.struct((F.col("ts_ms") + span_ms).alias("at"), F.lit(1).alias("probe")))).alias("m")
    rows = logs.where("ts_ms is not null").select("ip", "ts_ms").distinct().select("ip", "ts_ms", marks).select("ip", "ts_ms", "m.*")
    time = F.when(F.col("probe") == 0, F.col("at"))
    return table(scan(rows, ["ip"], ["at", "probe"], {"earlier": ("max", time, "before"), "later": ("min", time, "after")}), "times")


def _islands(times: DataFrame, span_ms: int) -> DataFrame:
    """Times behind an idle gap longer than span, and the first of each ip."""
    return times.where(f"probe = 0 and (earlier is null or at - earlier > {span_ms})").select("ip", F.col("at").alias("start_ms"))


def _assigned(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """Rows with ip, ts_ms and event_id with the last start of their ip that is not behind them, as `start_ms`."""
    both = rows.withColumn("_row", F.lit(1)).unionByName(starts.select("ip", F.col("start_ms").alias("ts_ms"), F.lit(0).alias("_row")), allowMissingColumns=True)
    found = scan(both, ["ip"], ["ts_ms", "_row", "event_id"], {"start_ms": ("max", F.when(F.col("_row") == 0, F.col("ts_ms")), "before")})
    return found.where("_row = 1").drop("_row")


def idle_sessions(logs: DataFrame, gap_ms: int = 300_000) -> DataFrame:
    """Sessions of each ip cut at idle gaps: ip, start_ms, end_ms, n. Rows without a time belong to none."""
    rows = logs.where("ts_ms is not null").select("ip", "ts_ms", "event_id")
    return _assigned(rows, _islands(_times(logs, gap_ms), gap_ms)).groupBy("ip", "start_ms").agg(F.max("ts_ms").alias("end_ms"), F.count("*").alias("n"))


#: The text of a session, its requests and how many of them are shown.
SESSION_ID, SESSION_TEXT, SESSION_MORE, SESSION_SHOWN = "nginx_session::%s::%d::%d", "ip=%s 在 [%d~%d] 发起 %d 次请求: %s", "; ...(+%d more)", 5


def _exits(ranged: DataFrame, asked: list[int], through: set[int], span_ms: int) -> DataFrame:
    """Of the last ip of each asked partition, where chunks get to: _pid, at, exit (binary, 8-byte numbers).

    A chunk that comes in may begin the next one at any time of the first span or the first behind it; exit is the last
    start that is reached from there, and `at` the last of the times in a row with that exit. Chunks from different times
    soon meet, so these rows are short; there are as many numbers as distinct times in a span at most. Where the ip itself
    begins in the partition (not in `through`) its first time is the only way in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, limit, more, none = None, 0, True, np.empty(0, np.int64)
        times, way, now = none, none, none  # ways in, for each the number of its chunk, and the starts of these

        def found() -> Iterator[pa.RecordBatch]:
            if pid is not None:
                last = np.flatnonzero(np.append(np.diff(now[way]) != 0, True))
                yield pa.RecordBatch.from_arrays([pa.array([pid], pa.int32()), pa.array([times[last].tobytes()], pa.binary()), pa.array([now[way][last].tobytes()], pa.binary())], names=["_pid", "at", "exit"])

        for batch in batches:
            pids, ts = batch.column("_pid").to_numpy(), batch.column("ts_ms").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(pids)) + 1).tolist(), len(pids)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                t = ts[lo:hi]
                if pids[lo] != pid:
                    yield from found()
                    pid, limit, more, times, way, now = int(pids[lo]), int(t[0]) + span_ms, True, none, none, none
                if more:
                    new = np.unique(t[: np.searchsorted(t, limit, "right") + 1]) if pid in through else t[:1]
                    new = new[new > times[-1]] if len(times) else new
                    times, way, now = np.append(times, new), np.append(way, len(now) + np.arange(len(new))), np.append(now, new)
                    more = pid in through and bool(t[-1] <= limit)
                while True:
                    at = np.searchsorted(t, now + span_ms, "right")
                    moves = at < len(t)
                    if not moves.any():
                        break
                    now[moves] = t[at[moves]]
                now, number = np.unique(now, return_inverse=True)
                way = number[way]
        yield from found()

    wanted = ranged.sparkSession.createDataFrame([(p,) for p in asked], "_pid int")
    tail = ranged.groupBy("_pid").agg(F.max(F.struct("ip")).alias("tail")).join(F.broadcast(wanted), "_pid").select("_pid", F.col("tail.ip").alias("_tail"))
    rows = ranged.join(F.broadcast(tail), "_pid").where(F.col("ip").eqNullSafe(F.col("_tail"))).select("_pid", "ts_ms")
    return rows.repartition("_pid").sortWithinPartitions("_pid", "ts_ms").mapInArrow(run, "_pid int, at binary, exit binary")


def _carried(ranged: DataFrame, span_ms: int) -> dict[int, int]:
    """For each partition whose first ip goes on from the one before it the start of the chunk that comes in: a number a partition."""
    ends = ranged.groupBy("_pid").agg(F.min(F.struct("ip")).alias("head"), F.max(F.struct("ip")).alias("tail")).orderBy("_pid").collect()
    after = {a["_pid"]: b["_pid"] for a, b in zip(ends[:-1], ends[1:], strict=True) if a["tail"] == b["head"]}
    through = {r["_pid"] for r in ends if r["_pid"] in after.values() and r["head"] == r["tail"]}
    carried: dict[int, int] = {}
    for row in _exits(ranged, sorted(after), through, span_ms).orderBy("_pid").toLocalIterator() if after else ():
        at, exits = np.frombuffer(row["at"], np.int64), np.frombuffer(row["exit"], np.int64)
        start = carried.get(row["_pid"]) if row["_pid"] in through else None
        way = 0 if start is None else int(np.searchsorted(at, start + span_ms, "right"))
        carried[after[row["_pid"]]] = int(exits[way]) if way < len(at) else start
    return carried


def chunk_pieces(rows: DataFrame, span_ms: int, shown: int) -> DataFrame:
    """Chunks of rows (ip, ts_ms, event_id, request), if a request more than span behind the start of its chunk begins the
    next: ip, start_ms, end_ms, n, _pid, seq and the first `shown` requests; a chunk may come in several pieces, in the
    order of (_pid, seq).

    Rows are range-partitioned by (ip, ts_ms, event_id) once, so a busy ip lies over many tasks, and each task reads its
    part in order. What comes in from the part before it is known from `_carried`.
    """
    ranged = table(rows.repartitionByRange("ip", "ts_ms", "event_id").withColumn("_pid", F.spark_partition_id()), "ranged")
    carried = _carried(ranged, span_ms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, ip, start, seq = None, None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            pids, ts, ips = batch.column("_pid").to_numpy(), batch.column("ts_ms").to_numpy(), batch.column("ip")
            code = ips.dictionary_encode().indices.fill_null(-1).to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(pids) != 0) | (np.diff(code) != 0)) + 1).tolist(), len(pids)]
            heads, begins = [], []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                key = int(pids[lo]), ips[lo].as_py()
                if key != (pid, ip):
                    start = carried.get(key[0]) if key[0] != pid else None
                    pid, ip = key
                t = ts[lo:hi]
                at = 0 if start is None else int(np.searchsorted(t, start + span_ms, "right"))
                if at:
                    heads.append(lo)
                    begins.append(start)
                behind = np.searchsorted(t, t + span_ms, "right").tolist()
                while at < len(t):
                    start = int(t[at])
                    heads.append(lo + at)
                    begins.append(start)
                    at = behind[at]
            head = np.array(heads)
            n = np.diff(np.append(head, len(ts)))
            few = np.minimum(n, shown)
            ends = np.cumsum(few)
            listed = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), batch.column("request").take(pa.array(np.arange(ends[-1]) - np.repeat(ends - few, few) + np.repeat(head, few))))
            yield pa.RecordBatch.from_arrays([ips.take(pa.array(head)), pa.array(begins, pa.int64()), pa.array(ts[head + n - 1]), pa.array(n.astype(np.int64)), pa.array(pids[head]), pa.array(seq + np.arange(len(head))), listed], names=["ip", "start_ms", "end_ms", "n", "_pid", "seq", "first"])
            seq += len(head)

    ordered = ranged.repartition("_pid").sortWithinPartitions("_pid", "ip", "ts_ms", "event_id").select("_pid", "ip", "ts_ms", "request")
    return ordered.mapInArrow(run, "ip string, start_ms long, end_ms long, n long, _pid int, seq long, first array<string>")


def anchored_sessions(logs: DataFrame, span_ms: int = 300_000) -> DataFrame:
    """Chunks of each ip with their text: a new one when a request is more than span after the chunk's *start*.

    No window or group is by ip alone (see `chunk_pieces`); of a chunk only its first requests leave a task.
    """
    rows = logs.where("ts_ms is not null").select("ip", "ts_ms", "event_id", F.concat_ws(" ", "method", "path", F.col("status").cast("string")).alias("request"))
    listed = F.array_sort(F.collect_list(F.struct("_pid", "seq", "first")))
    both = chunk_pieces(rows, span_ms, SESSION_SHOWN).groupBy("ip", "start_ms").agg(F.max("end_ms").alias("end_ms"), F.sum("n").alias("n"), listed.alias("pieces"))
    both = both.withColumn("t", F.array_join(F.slice(F.flatten(F.transform("pieces", lambda p: p["first"])), 1, SESSION_SHOWN), "; "))
    more = F.when(F.col("n") > SESSION_SHOWN, F.format_string(SESSION_MORE, F.col("n") - SESSION_SHOWN)).otherwise("")
    return both.select(F.format_string(SESSION_ID, "ip", "start_ms", "end_ms").alias("source_id"), "ip", "start_ms", "end_ms", "n", F.concat(F.format_string(SESSION_TEXT, "ip", "start_ms", "end_ms", "n", "t"), more).alias("content"))


def fallback(rows: DataFrame) -> DataFrame:
    """Text and id of a hit: content, else its parts, else 200 characters of the record; event_id before source_id before _id, blank ones count as missing."""
    part = lambda label, name: F.concat(F.lit(label), _text(rows, name))
    request = F.when(_text(rows, "method").isNotNull(), F.concat_ws(" ", _text(rows, "method"), _text(rows, "path")))
    parts = F.concat_ws(" ", F.concat(F.lit("["), _text(rows, "attack_type"), F.lit("]")), part("rule=", "rule_id"), part("ip=", "ip"), request, part("status=", "status"), part("matched=", "matched_value"))
    record = F.substring(F.to_json(F.struct(*rows.columns)), 1, 200)
    ids = [F.when(F.col(c) != "", F.col(c)) for c in ("event_id", "source_id", "_id")]
    return rows.select(F.coalesce(*ids, F.lit("")).alias("source_id"), F.coalesce(_text(rows, "content"), F.when(parts != "", parts), record).alias("content"))


def gate(rows: DataFrame) -> DataFrame:
    """Adds `dropped`: the first reason for which a case is refused (no_attack_type, no_ip, no_timestamp, no_content), null if it stays."""
    why = F.when(_text(rows, "attack_type").isNull(), "no_attack_type").when(_text(rows, "ip").isNull(), "no_ip").when(F.col("ts_ms").isNull(), "no_timestamp").when(described(rows) == "", "no_content")
    return rows.withColumn("dropped", why)


def case_documents(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_id").alias("source_id"), F.lit("case").alias("source_type"), F.trim(F.get(F.split("attack_type", ","), F.lit(0))).alias("attack_type"), F.col("ts_ms").alias("created_at"))


def pull(rows: DataFrame, cursor: tuple[int, str], since: int) -> tuple[DataFrame, DataFrame]:
    """Rows behind the (time, id) cursor, and the next cursor as one row; it also moves past rows that are refused."""
    new = rows.where((F.col("ts_ms") > cursor[0]) | ((F.col("ts_ms") == cursor[0]) & (F.col("event_id") > cursor[1]))).where(F.col("ts_ms") >= since)
    return gate(new).where("dropped is null").drop("dropped"), new.agg(F.max(F.struct("ts_ms", "event_id")).alias("c")).select("c.*")


def follow(notices: DataFrame, events: DataFrame, snapshot: int | None, now_ms: int, oldest: int) -> DataFrame:
    """What each notice up to the snapshot (None: of all) does: upsert, wait (dated in the future) or remove (gone or expired)."""
    due = notices if snapshot is None else notices.where(F.col("notice_id") <= snapshot)
    j = due.join(events.select("record_id", "event_time"), "record_id", "left")
    return j.select("notice_id", "record_id", F.when(F.col("event_time").isNull() | (F.col("event_time") < oldest), "remove").when(F.col("event_time") > now_ms, "wait").otherwise("upsert").alias("action"))


def report_evidence(reports: DataFrame) -> DataFrame:
    """One text for each report: risk, type, summary; reports without any of them go."""
    part = lambda label, name: F.concat(F.lit(label), _text(reports, name))
    text = F.concat_ws(" ", part("risk=", "risk_level"), part("type=", "detect_type"), part("ip=", "ip"), _text(reports, "summary"))
    return reports.select(F.concat(F.lit("report::"), "event_id").alias("source_id"), text.alias("content")).where("content <> ''")


def union(events: DataFrame, logs: DataFrame, reports: DataFrame) -> DataFrame:
    """The corpus of all three kinds: source_id, source_type (event, session, report), content."""
    kinds = [(event_evidence(events), "event"), (anchored_sessions(logs).select("source_id", "content"), "session"), (report_evidence(reports), "report")]
    parts = [rows.select("source_id", F.lit(kind).alias("source_type"), "content") for rows, kind in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def expired(corpus: DataFrame, oldest: int, source_type: str = "case") -> DataFrame:
    """The corpus without its cases that are older than `oldest`; documents of other types and without a time stay."""
    return corpus.where(~F.coalesce((F.col("source_type") == source_type) & (F.col("created_at") < oldest), F.lit(False)))


def publish(corpus: DataFrame, base: str) -> int:
    """Write the next version of the corpus (from 2 on) and point to it if it has rows; returns the version pointed to (0: none).

    The pointer is one row in a table of its own, so readers see the old version until the new one is whole.
    """
    spark = corpus.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    have = [int(f.getPath().getName()[2:]) for f in (fs.listStatus(p) if fs.exists(p) else []) if f.getPath().getName().startswith("v=")]
    version = max([1, *have]) + 1
    corpus.write.parquet(f"{base}/v={version}")
    if not spark.read.schema(corpus.schema).parquet(f"{base}/v={version}").isEmpty():
        spark.createDataFrame([(version,)], "version int").coalesce(1).write.mode("append").parquet(f"{base}/pointer")
    return pointed(spark, base)


def pointed(spark: SparkSession, base: str) -> int:
    """The version that readers take: the last one pointed to, 0 if there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/pointer")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return 0
    return spark.read.schema("version int").parquet(f"{base}/pointer").agg(F.max("version")).first()[0] or 0
