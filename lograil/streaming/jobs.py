"""Continuous jobs. Each takes a streaming DataFrame (files in tests, Kafka in production) and a checkpoint folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader, StreamingQuery

from lograil.operators.corpus import expired, follow
from lograil.operators.detect import security_events
from lograil.operators.normalize import normalize
from lograil.operators.parse import parse_strict, split_parsed
from lograil.sources.files import archive, hot_rows, quarantine
from lograil.sources.ledger import Batch, key_bucket, put, read, run_of
from lograil.sources.scratch import discard, table


def limited(reader: DataStreamReader, source: str, files: int | None = None, size: str | None = None, rows: int | None = None) -> DataStreamReader:
    """A reader that admits so much to a micro-batch: files or their bytes (source files), or rows (source kafka)."""
    if source == "kafka":
        if files or size:
            raise ValueError("a Kafka source is limited by rows")
        return reader.option("maxOffsetsPerTrigger", rows) if rows else reader
    if rows or (files and size):
        raise ValueError("a file source is limited by files or by bytes")
    return reader.option("maxFilesPerTrigger", files) if files else reader.option("maxBytesPerTrigger", size) if size else reader


def start(rows: DataFrame, each: Callable[[DataFrame, Batch], None], checkpoint: str, stream: str, every: str | None = None) -> StreamingQuery:
    """Run a function on every micro-batch; offsets move on only after it has ended."""

    def named(batch: DataFrame, no: int) -> None:
        each(batch, Batch(stream, run_of(batch.sparkSession, checkpoint), no))

    w = rows.writeStream.foreachBatch(named).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def parse_lines(lines: DataFrame, good: str, bad: str, checkpoint: str) -> StreamingQuery:
    """Lines to structured rows and dead letters (tables of `ledger`)."""

    def each(batch: DataFrame, no: Batch) -> None:
        once = table(parse_strict(batch), "parsed")
        ok, failed = split_parsed(once)
        put(ok, good, no, F.lit("all"))
        put(failed, bad, no, F.lit("all"))
        discard(once)

    return start(lines, each, checkpoint, "parse")


def detect_events(logs: DataFrame, events: str, dead: str, checkpoint: str, now: Callable[[], int]) -> StreamingQuery:
    """Decoding, validation and detection: an event is inserted once by its id, what is refused goes to dead letters."""

    def each(batch: DataFrame, no: Batch) -> None:
        once = table(normalize(batch, now()), "normalized")
        found = security_events(once.where("error is null"), "original_path")
        put(found, events, no, F.date_format(F.timestamp_millis(F.col("log_context.timestamp")), "yyyy-MM-dd"), ["event_id"])
        put(once.where("error is not null"), dead, no, F.lit("all"))
        discard(once)

    return start(logs, each, checkpoint, "detect")


def two_tiers(rows: DataFrame, hot: str, cold: str, checkpoint: str, now: Callable[[], int], key: list[str] | None = None, version: list[str] | None = None) -> StreamingQuery:
    """All rows to the full history, those of the last days to the hot tier; late rows never reopen a hot day.

    key identifies a row of the history (record_id and version by default). The hot tier keeps the highest version of a
    record in its day, so running it again, from an old or a new checkpoint, changes nothing.
    """

    def each(batch: DataFrame, no: Batch) -> None:
        archive(batch, cold, no, key or ["record_id", "version"])
        recent = hot_rows(batch, now())
        put(recent, hot, no, F.col("day"), ["record_id"], version or ["version"])

    return start(rows, each, checkpoint, "tiers")


def deduplicated(rows: DataFrame, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Each (record, version) once, within the watermark."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(["record_id", "version"])


_POSITION, _GAP = ["topic", "part"], ["topic", "part", "off"]


def consumed(messages: DataFrame, checked: Callable[[DataFrame], DataFrame], base: str, checkpoint: str, strict: bool = True, largest: int = 5 << 20) -> StreamingQuery:
    """Messages (topic, part, off, value) to the table base/rows, with a register of positions, gaps and refused records.

    `checked` adds `error` (null: valid); a value of more than `largest` bytes is refused before it. A refused record goes
    to base/quarantine and its position to base/gaps as open. strict: nothing of its batch is written, the positions in
    base/positions stay and the stream stops, so the same batch comes again. Otherwise the valid rows are written, the
    position moves on, and the gap stays open. When a position of an open gap has been written, it is resolved.
    """
    where = lambda name: f"{base}/{name}"
    bucket = lambda key: key_bucket(key, 16)

    def each(batch: DataFrame, no: Batch) -> None:
        large = F.coalesce(F.octet_length("value") > largest, F.lit(False))
        refused = batch.where(large).withColumn("error", F.lit(f"the record is larger than {largest} bytes"))
        once = table(checked(batch.where(~large)).unionByName(refused, allowMissingColumns=True), "checked")
        bad, good = once.where("error is not null"), once.where("error is null")
        again = Batch(no.stream, no.run)  # registers are keyed by position: writing them again changes nothing
        if not bad.isEmpty():
            put(quarantine(bad).withColumns({c: F.get_json_object("source", f"$.{c}") for c in _GAP}), where("quarantine"), again, bucket(_GAP), _GAP)
            put(bad.select(*_GAP, F.lit(0).alias("resolved")), where("gaps"), again, bucket(_GAP), _GAP, ["resolved"])
            if strict:
                raise ValueError("a record was refused; the position stays")
        put(good.drop("error"), where("rows"), no, F.lit("all"))
        gaps = read(batch.sparkSession, where("gaps"), bad.select(*_GAP, F.lit(0).alias("resolved")).schema)
        filled = gaps.where("resolved = 0").select(*_GAP).join(good.select(*_GAP), _GAP, "left_semi")
        if not filled.isEmpty():
            put(filled.withColumn("resolved", F.lit(1)), where("gaps"), again, bucket(_GAP), _GAP, ["resolved"])
        moved = once.groupBy(*_POSITION).agg((F.max("off") + 1).alias("next_offset"))
        put(moved, where("positions"), again, bucket(_POSITION), _POSITION, ["next_offset"])
        discard(once)

    return start(messages, each, checkpoint, "consume")


def hourly(rows: DataFrame, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    return rows.withWatermark(time, delay).groupBy(F.window(time, "1 hour")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "n")


def idle_sessions(rows: DataFrame, time: str = "ts", gap: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    return rows.withWatermark(time, delay).groupBy(F.session_window(time, gap), "ip").agg(F.count("*").alias("n")).select("ip", F.col("session_window.start").alias("start"), "n")


def anchored_sessions(rows: DataFrame, time: str = "ts", span_ms: int = 300_000, delay: str = "10 minutes") -> DataFrame:
    """Chunks of each ip that end span after their start: ip, start_ms, end_ms, n, once no earlier row can come any more.

    Rows may come in any order within the watermark: they wait in the state, counted by time, until the watermark has
    passed them, and are only then given to a chunk. The state of an ip is one open chunk and the times of one delay.
    """

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        first, last, n, times, counts = state.get if state.exists else (None, None, 0, [], [])
        waiting = dict(zip(times, counts, strict=True))
        for f in frames:
            for t, c in f["ts_ms"].value_counts().items():
                waiting[int(t)] = waiting.get(int(t), 0) + int(c)
        passed, out = state.getCurrentWatermarkMs(), []
        for t in sorted(waiting):
            if t >= passed:
                break
            if first is not None and t - first > span_ms:
                out.append((key[0], first, last, n))
                first, n = None, 0
            first, last, n = (t if first is None else first), t, n + waiting.pop(t)
        if first is not None and first + span_ms < passed:  # later rows begin another chunk
            out.append((key[0], first, last, n))
            first, last, n = None, None, 0
        if waiting or first is not None:
            state.update((first, last, n, sorted(waiting), [waiting[t] for t in sorted(waiting)]))
            next_ = min([t + 1 for t in waiting] + ([first + span_ms + 1] if first is not None else []))
            state.setTimeoutTimestamp(max(next_, passed + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["ip", "start_ms", "end_ms", "n"])

    timed = rows.withWatermark(time, delay).select("ip", time, F.unix_millis(time).alias("ts_ms"))
    return timed.groupBy("ip").applyInPandasWithState(step, "ip string, start_ms long, end_ms long, n long", "first long, last long, n long, times array<long>, counts array<long>", "append", "EventTimeTimeout")


CORPUS = "source_id string, source_type string, attack_type string, content string, created_at long, notice_id long"


def follow_corpus(notices: DataFrame, events: Callable[[], DataFrame], base: str, checkpoint: str, now: Callable[[], int], days: int = 90, documents: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """The corpus follows archive notices (notice_id, record_id): what each one does goes to the table base/actions.

    events() gives the archive's latest rows at that time. Notices of events that lie in the future wait in base/waiting
    and are judged again with the next batch. Both are keyed by the notice, so a batch that is run again, or a new
    checkpoint over the same notices, repeats nothing; a notice that was acted upon waits no more.

    With `documents`, which makes rows of the corpus (source_id, source_type, attack_type, content, created_at) of rows of
    the archive, actions are applied to the table base/corpus, the latest notice of a record last: an upsert puts its
    document, a removal leaves one without content. `followed_corpus` reads it.
    """
    whose = ["notice_id"]

    def each(batch: DataFrame, no: Batch) -> None:
        spark, at = batch.sparkSession, now()
        schema = batch.select("notice_id", "record_id").withColumn("acted", F.lit(0)).schema
        old = read(spark, f"{base}/waiting", schema).where("acted = 0").select("notice_id", "record_id")
        due = batch.select("notice_id", "record_id").unionByName(old).dropDuplicates(whose)
        archive_now = events()
        acts = table(follow(due, archive_now, None, at, at - days * 86_400_000), "judged")
        again = Batch(no.stream, no.run)
        if documents is not None:
            last = acts.where("action <> 'wait'").groupBy("record_id").agg(F.max_by("action", "notice_id").alias("action"), F.max("notice_id").alias("notice_id"))
            put_ = documents(archive_now.join(last.where("action = 'upsert'").select("record_id", "notice_id"), "record_id"))
            put_ = put_.join(last.select(F.col("record_id").alias("source_id"), "notice_id"), "source_id").select("source_id", "source_type", "attack_type", "content", "created_at", "notice_id")
            gone = last.where("action = 'remove'").select(F.col("record_id").alias("source_id"), *[F.lit(None).cast("string").alias(c) for c in ("source_type", "attack_type", "content")], F.lit(None).cast("long").alias("created_at"), "notice_id")
            put(put_.unionByName(gone), f"{base}/corpus", again, key_bucket(["source_id"], 16), ["source_id"], ["notice_id"])
        put(acts.where("action <> 'wait'"), f"{base}/actions", again, key_bucket(whose, 16), whose)
        put(acts.select("notice_id", "record_id", (F.col("action") != "wait").cast("int").alias("acted")), f"{base}/waiting", again, key_bucket(whose, 16), whose, ["acted"])
        discard(acts)

    return start(notices, each, checkpoint, "follow")


def followed_corpus(spark: SparkSession, base: str, oldest: int) -> DataFrame:
    """The corpus that follow_corpus keeps, without what was removed and without cases older than `oldest`."""
    rows = read(spark, f"{base}/corpus", spark.createDataFrame([], CORPUS).schema).drop("ledger_part", "notice_id")
    return expired(rows.where("content is not null"), oldest)
