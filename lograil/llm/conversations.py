"""Conversation structure repair by Wagner-Fischer alignment to the grammar (s?(ua)+)? of role initials.

Turns are kept, reroled, deleted or inserted, so that the initials follow the grammar at the least cost. Up to BLOCK turns
are one alignment: the turns against the alternating string of every feasible length. Strings of one ending share their
suffixes, so one table, filled from the last turn on, holds all lengths; a first incumbent (all turns that need not go, on
the diagonal) bounds the band of insertions and deletions around it. The audits of all lengths of least cost are traced
and the ASCII-least stays.

A longer conversation is split into blocks, so that no task holds one: each block is aligned for every phase of the grammar
in which it may begin and end. Insertions come before a turn of the block, so of two audits of a block none is a prefix of
the other, and the cheapest and least audit of the whole is put together from those of the blocks: a fold over blocks
carries four costs and their order, with 16 small numbers a block.

Faults of a turn: blank (no word), duplicate (role and text stand earlier in the conversation), truncated (the last
character that is no white space is not one of .!?); the first that holds counts.

Nulls: roles and texts that are null count as one space, null turns come first, a null conversation id is a conversation
of its own. Equal turn numbers are ordered by role and text. Rows that repeat are duplicates. Empty tables give empty
results; further columns are ignored. Conversations of any length work: a task holds a block, or 16 bytes a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lograil.llm._common import WORD, bounded_batches, exclusive_prefix, materialize

#: Turns of a block.
BLOCK = 64
#: Costs.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLANK, DUPLICATE, CUT = 1, 2, 3
#: Phases of the grammar: nothing yet, s seen, u seen, a seen. What may end, and what must be inserted to end.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDING = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
NEVER = 1 << 30

Path = tuple[int, str, str]  # cost, audit, and the phase after each edit


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults put in by a checksum of conversation and turn: one in twenty each is
    dropped, emptied, stripped of its sentence ends, repeated or given to the user."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key) % 20).alias("_k"))
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.where("_k <> 0").withColumns({"text": text, "role": F.when(F.col("_k") == 4, "user").otherwise(F.col("role"))})
    return rows.withColumn("_copy", F.explode(F.when(F.col("_k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_k", "_copy")


def numbered(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, pos, turn, role, text, fault): place in the conversation from 0, and the first fault of each turn.

    Places come from prefix sums over ranges of (conversation, turn), and a duplicate is a place that is not the first of
    its role and text, so a conversation or a turn with a third of all rows is spread over tasks.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = rows.withColumns({"_one": F.lit(1), "_row": F.monotonically_increasing_id()})
    placed = materialize(exclusive_prefix(rows, ["turn", "role", "text", "_row"], "_one", "pos", ["conv_id"]).drop("_one", "_row"), "turns")
    first = placed.groupBy("conv_id", "role", F.sha2("text", 256).alias("_t")).agg(F.min("pos").alias("_p")).select(F.col("conv_id").alias("_c"), "_p")
    joined = placed.join(first, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("pos") == F.col("_p")), "left")
    fault = F.when(~F.col("text").rlike(WORD), BLANK).when(F.col("_p").isNull(), DUPLICATE).when(~F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*\\z"), CUT).otherwise(0)
    return materialize(joined.select("conv_id", "pos", "turn", "role", "text", fault.alias("fault")), "faults")


def align(initials: list[str], faults: list[int], entries: tuple[int, ...]) -> dict[tuple[int, int], Path]:
    """Cheapest edits of a block's turns, the ASCII-least of them, for each phase before it and each phase after it."""
    n = len(initials)
    must = [f in (BLANK, DUPLICATE) for f in faults]
    extra = [TRUNCATED if f == CUT else 0 for f in faults]
    found: dict[tuple[int, int], Path] = {}

    def offer(q: int, end: int, cost: int, audit: str) -> None:
        if (q, end) not in found or (cost, audit) < found[q, end][:2]:
            found[q, end] = cost, audit, ""

    systems = [r for r in range(n) if initials[r] == "s" and not must[r]] if START in entries else []
    for q in entries:
        if q in (START, SYSTEM):
            offer(q, q, DELETE * n, "D" * n)
    for r in systems:
        offer(START, SYSTEM, DELETE * (n - 1) + extra[r], "D" * r + "K" + "D" * (n - r - 1))
    for end, last in ((USER, "u"), (ASSISTANT, "a")):
        other = "a" if last == "u" else "u"
        # the incumbent: all turns that may stay, on the diagonal, and two insertions for the phase before them
        gone, incumbent, j = 0, 2 * INSERT, 0
        for r in range(n - 1, -1, -1):
            if must[r]:
                gone += 1
                continue
            j += 1
            incumbent += extra[r] + (0 if initials[r] == (last if j % 2 else other) else REROLE)
        wider, fewer = incumbent // INSERT, incumbent // DELETE  # insertions and optional deletions of a path within it
        table: list[list[int]] = [[0]]
        lows = [0]
        kept = 0
        for i in range(1, n + 1):
            r = n - i
            kept += not must[r]
            low, high = max(0, kept - fewer), kept + wider
            above, at = table[-1], lows[-1]
            row: list[int] = []
            for j in range(low, high + 1):
                best = above[j - at] + DELETE if 0 <= j - at < len(above) else NEVER
                if not must[r] and j and 0 <= j - 1 - at < len(above):
                    best = min(best, above[j - 1 - at] + extra[r] + (0 if initials[r] == (last if j % 2 else other) else REROLE))
                if row and row[-1] + INSERT < best:
                    best = row[-1] + INSERT
                row.append(best)
            table.append(row)
            lows.append(low)

        def cell(i: int, j: int) -> int:
            return table[i][j - lows[i]] if 0 <= j - lows[i] < len(table[i]) else NEVER  # noqa: B023

        def trace(i: int, j: int) -> str:
            """The least audit of the last i turns against the last j symbols."""
            out = []
            while i:
                now, r = cell(i, j), n - i
                if cell(i - 1, j) + DELETE == now:
                    out.append("D")
                    i -= 1
                elif j and cell(i, j - 1) + INSERT == now:
                    out.append("I")
                    j -= 1
                else:
                    out.append("K" if initials[r] == (last if j % 2 else other) else "R")  # noqa: B023
                    i, j = i - 1, j - 1
            return "".join(out)

        starts = {"u": 1 if last == "u" else 0, "a": 1 if last == "a" else 0}  # parity of the lengths that start with it
        lengths = range(lows[n], lows[n] + len(table[n]))
        for q in entries:
            parity = starts["a" if q == USER else "u"]
            fit = [j for j in lengths if (j % 2 == parity and j) or (j == 0 and q == end)]
            best = min((cell(n, j) for j in fit), default=NEVER)
            for j in fit:
                if cell(n, j) == best < NEVER:
                    offer(q, end, best, trace(n, j))
        for r in systems:  # s in front: what stands before it goes
            i = n - r - 1
            fit = [j for j in range(lows[i], lows[i] + len(table[i])) if j and j % 2 == starts["u"]]
            best = min((cell(i, j) for j in fit), default=NEVER)
            for j in fit:
                if cell(i, j) == best < NEVER:
                    offer(START, end, DELETE * r + extra[r] + best, "D" * r + "K" + trace(i, j))
    return {(q, end): (cost, audit, _phases(q, audit, initials)) for (q, end), (cost, audit, _) in found.items()}


def _phases(q: int, audit: str, initials: list[str]) -> str:
    """The phase after each edit of an audit, as digits."""
    out, r = [], 0
    for x in audit:
        if x != "D":
            q = SYSTEM if x == "K" and q == START and initials[r] == "s" else ASSISTANT if q == USER else USER
        r += x != "I"
        out.append(str(q))
    return "".join(out)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """(key, rows) for the runs of equal values of the first columns; the rows of a run must be read before the next."""
    rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
    ahead = next(rows, None)
    while ahead is not None:
        key = ahead[:keys]

        def own(key: tuple = key) -> Iterator[tuple]:
            nonlocal ahead
            while ahead is not None and ahead[:keys] == key:
                yield ahead
                ahead = next(rows, None)

        yield key, own()


def _batched(rows: Iterator[tuple], schema: pa.Schema, most: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def edits(rows: DataFrame, block_turns: int = BLOCK) -> DataFrame:
    """The cheapest edits of numbered rows: (conv_id, pos, sub, edit, role), one row for each letter of the audit.

    An edit belongs to the turn at pos; insertions before it have a smaller sub, those behind the last turn the next pos.
    role: of reroled and inserted turns.
    """
    kind, ids = rows.schema["conv_id"].dataType.simpleString(), pa.int64()
    if kind != "bigint":
        ids = pa.string() if kind == "string" else pa.int32()
    blocks = pa.schema([("conv_id", ids), ("block", pa.int64()), ("costs", pa.list_(pa.int32())), ("ranks", pa.list_(pa.int32())), ("audits", pa.list_(pa.string())), ("paths", pa.list_(pa.string()))])
    picks = pa.schema([("conv_id", ids), ("block", pa.int64()), ("pick", pa.int32()), ("tail", pa.int32())])
    letters = pa.schema([("conv_id", ids), ("pos", pa.int64()), ("sub", pa.int32()), ("edit", pa.string()), ("role", pa.string())])

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for (conv, block), turns in _runs(batches, 2):
                own = [(initial, fault) for *_, initial, fault in turns]
                found = align([x for x, _ in own], [f for _, f in own], (START, SYSTEM, USER, ASSISTANT) if block else (START,))
                cells = [found.get((q, end), (NEVER, "", "")) for q in range(4) for end in range(4)]
                order = {a: i for i, a in enumerate(sorted({x[1] for x in cells}))}
                yield conv, block, [x[0] for x in cells], [order[x[1]] for x in cells], [x[1] for x in cells], [x[2] for x in cells]

        return _batched(each(), blocks, 512)

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for (conv,), own in _runs(batches, 1):
                costs, order, came = [0, NEVER, NEVER, NEVER], [0, 0, 0, 0], bytearray()
                for _, _, step, ranks in own:
                    best = [min((costs[q] + step[4 * q + end], order[q], ranks[4 * q + end], q) for q in range(4)) for end in range(4)]
                    places = {x: i for i, x in enumerate(sorted({x[1:3] for x in best}))}
                    costs, order = [min(x[0], NEVER) for x in best], [places[x[1:3]] for x in best]
                    came += bytes(x[3] for x in best)
                end = min((q for q in range(4)), key=lambda q: (costs[q] + INSERT * ENDING[q], order[q]))
                tail, out = ENDING[end], []
                for block in range(len(came) // 4 - 1, -1, -1):
                    q = came[4 * block + end]
                    out.append(4 * q + end)
                    end = q
                for block, pick in enumerate(reversed(out)):
                    yield conv, block, pick, tail if block == len(out) - 1 else 0

        return _batched(each(), picks)

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                for conv, block, audit, path, tail, q in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    pos, sub = block * block_turns, 0
                    for x, phase in zip(audit, path, strict=True):
                        yield conv, pos, sub, x, ("assistant" if phase == str(ASSISTANT) else "user") if x in "RI" else None
                        pos, sub = (pos, sub + 1) if x == "I" else (pos + 1, 0)
                    for sub in range(tail):
                        yield conv, pos, sub, "I", "user" if int(path[-1] if path else q) == SYSTEM and not sub else "assistant"

        return _batched(each(), letters)

    narrow = rows.select("conv_id", F.floor(F.col("pos") / block_turns).alias("block"), "pos", F.substring("role", 1, 1).alias("initial"), "fault")
    dealt = narrow.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "pos")
    tables = materialize(dealt.mapInArrow(aligned, f"conv_id {kind}, block long, costs array<int>, ranks array<int>, audits array<string>, paths array<string>"), "aligned")
    small = tables.select("conv_id", "block", "costs", "ranks").repartition("conv_id").sortWithinPartitions("conv_id", "block")
    chosen = small.mapInArrow(folded, f"conv_id {kind}, block long, pick int, tail int").select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), "pick", "tail")
    both = tables.join(chosen, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b")))
    picked = both.select("conv_id", "block", F.col("audits")[F.col("pick")].alias("audit"), F.col("paths")[F.col("pick")].alias("path"), "tail", F.floor(F.col("pick") / 4).cast("int").alias("q"))
    return picked.mapInArrow(spelled, f"conv_id {kind}, pos long, sub int, edit string, role string")


def repair(turns: DataFrame, block_turns: int = BLOCK) -> DataFrame:
    """Every turn of (conv_id, turn, role, text) with its edit, and the inserted ones, in the order (pos, sub).

    Columns conv_id, pos, sub, edit (K, R, D or I), turn, role, text, initial (of the role that the turn came with) and
    fault (0, or BLANK, DUPLICATE, CUT). Without the rows of edit D this is the repaired conversation.
    """
    rows = numbered(turns)
    steps = edits(rows, block_turns).select(F.col("conv_id").alias("_c"), F.col("pos").alias("_p"), "sub", "edit", F.col("role").alias("_r"))
    own = F.col("edit") != "I"
    both = steps.join(rows, F.col("_c").eqNullSafe(F.col("conv_id")) & (F.col("_p") == F.col("pos")), "left")
    return both.select(
        F.col("_c").alias("conv_id"), F.col("_p").alias("pos"), "sub", "edit", F.when(own, F.col("turn")).alias("turn"), F.coalesce("_r", "role").alias("role"),
        F.when(own, F.col("text")).otherwise("").alias("text"), F.when(own, F.substring("role", 1, 1)).alias("initial"), F.when(own, F.col("fault")).alias("fault"),
    )


def reports(conversations: DataFrame, turns: DataFrame, block_turns: int = BLOCK) -> DataFrame:
    """One row for each conversation id of `conversations`: counts of faults in turns, cost, audit and the hash of the repaired text.

    The rows of a conversation stream through one task in order, as its hash needs them so; the task holds the audit.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()
    ids = {"bigint": pa.int64(), "string": pa.string()}.get(kind, pa.int32())
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = pa.schema([("_c", ids), *[(x, pa.int64()) for x in numbers], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for (conv,), steps in _runs(batches, 1):
                faults, illegal, cost, audit, sha = [0, 0, 0, 0], 0, 0, bytearray(), hashlib.sha256()
                low = high = before = None
                distinct, first = 0, True
                for _, edit, turn, role, text, initial, fault in steps:
                    audit += edit.encode()
                    cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit]
                    if edit != "I":
                        faults[fault] += 1
                        cost += TRUNCATED if fault == CUT and edit != "D" else 0
                        illegal += before is not None and before + initial not in ("su", "ua", "au")
                        before = initial
                        if turn is not None:
                            distinct += turn != high
                            low, high = turn if low is None else low, turn
                    if edit != "D":
                        sha.update(f"{'' if first else '\n'}{role}:{text}".encode())
                        first = False
                yield conv, 0 if high is None else high - low + 1 - distinct, *faults[1:], illegal, cost, audit.decode(), sha.hexdigest()

        return _batched(each(), schema, 256)

    bounded_batches(conversations.sparkSession)
    steps = repair(turns, block_turns).select("conv_id", "edit", "turn", "role", "text", "initial", "fault", "pos", "sub").repartition("conv_id").sortWithinPartitions("conv_id", "pos", "sub").drop("pos", "sub")
    done = steps.mapInArrow(run, f"_c {kind}, {', '.join(f'{x} long' for x in numbers)}, audit string, repaired_sha256 string")
    all_ids = conversations.select("conv_id").distinct()
    joined = all_ids.join(done, F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    nothing = hashlib.sha256().hexdigest()
    return joined.select("conv_id", *[F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in numbers], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
