"""BPE encoding and decoding with a tokenization automaton.

The merges are compiled, in their order, into a deterministic automaton over tokens that accepts exactly the correct
tokenizations. Before any merge it has one state for each base symbol and every arc. The gadget of merge k, (a, b) -> ab,
takes the arc b away after a and adds the token ab: its state starts as a copy of b's (what may follow ab is what may
follow b), and the arc ab leaves every state from which a and then b could be read. A token's state is thus described by
its gadget (left part, right part, k) and the arcs taken away, of which there are as many as merges; a dense table would
have tokens squared entries. `Automaton.arc` resolves one entry through the gadgets, newest first.

Over single symbols the arcs are strings, so a state of the deterministic automaton for reading is a set: for each place
where a token may end, the token state there and the part of the next token read since. Each prefix has exactly one correct
tokenization, so the set names the last token of the prefix too. Sets are made when they are first reached and kept as
states of the transition table, up to a stated number. A pre-split word is encoded by one table entry a symbol, without
search or way back; its tokens are then read off from the last one. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lograil.llm._common import bounded_batches

END = "\0"  # stands for the end-of-word suffix inside labels

#: Letters and numbers that Unicode 16 added to 15.1 (first and last code point), which the tokenizers library
#: knows and unicodedata does not.
NEW_LETTERS = (
    "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B-1138B 1138E-1138E 11390-113B5"
    " 113B7-113B7 113D1-113D1 113D3-113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF-18CFF 1E5D0-1E5ED 1E5F0-1E5F0"
)
NEW_NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"
#: Marks that the library's NFC takes for starters (combining class 0), its tables being older.
LATE_MARKS = (
    "7FD-7FD 898-89F 8CA-8D3 9FE-9FE C3C-C3C D3B-D3C EBA-EBA 1715-1715 1ABF-1ACE 1DF6-1DFA A82C-A82C 10D24-10D27 10EAB-10EAC"
    " 10EFD-10EFF 10F46-10F50 10F82-10F85 11070-11070 1133B-1133B 1145E-1145E 11839-1183A 11930-11930 1193D-1193E 11943-11943"
    " 119E0-119E0 11A34-11A34 11A47-11A47 11A99-11A99 11D42-11D42 11D44-11D45 11D97-11D97 11F41-11F42 16FF0-16FF1 1E08F-1E08F"
    " 1E130-1E136 1E2AE-1E2AE 1E2EC-1E2EF 1E4EC-1E4EF"
)
#: Capitals of Unicode 16 and 17 (first and last code point, small letter of the first), which it lowers too.
NEW_CAPITALS = (
    "1C89-1C89:1C8A A7CB-A7CB:264 A7CC-A7CC:A7CD A7CE-A7CE:A7CF A7D2-A7D2:A7D3 A7D4-A7D4:A7D5 A7DA-A7DA:A7DB A7DC-A7DC:19B"
    " 10D50-10D65:10D70 16EA0-16EB8:16EBB"
)


def _spans(spec: str) -> list[tuple[int, int]]:
    return [(int(lo, 16), int(hi, 16)) for lo, hi in (x.split("-") for x in spec.split())]


def _members(kind: str, new: str) -> str:
    """The code points of a general category in Unicode 16, as ranges for a character class."""
    inside = [unicodedata.category(chr(c))[0] == kind for c in range(sys.maxunicode + 1)]
    for lo, hi in _spans(new):
        inside[lo : hi + 1] = [True] * (hi - lo + 1)
    edges = [c for c, (a, b) in enumerate(zip([False, *inside], [*inside, False], strict=True)) if a != b]
    return "".join(f"\\U{lo:08x}-\\U{hi - 1:08x}" for lo, hi in zip(edges[::2], edges[1::2], strict=True))


_LETTER, _NUMBER, _SPACE = _members("L", NEW_LETTERS), _members("N", NEW_NUMBERS), "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Contractions, runs of letters, single numbers, runs of other characters.
SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")
_LOWER = {lo + i: int(small, 16) + i for span, small in (x.split(":") for x in NEW_CAPITALS.split()) for lo, hi in _spans(span) for i in range(hi - lo + 1)}
_LATE = re.compile("([" + "".join(f"\\U{lo:08x}-\\U{hi:08x}" for lo, hi in _spans(LATE_MARKS)) + "])")
_CAPITALS = re.compile("[" + "".join(map(chr, _LOWER)) + "]")
#: Separators for str.split() that are no white space in Unicode's property.
ODD = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class State(dict):
    """A state of the automaton over symbols: its transitions, made when first taken, and the last token of what was read."""

    __slots__ = ("auto", "live", "token", "size")

    def __missing__(self, symbol: str) -> State:
        found = self[symbol] = self.auto.step(self.live, symbol)
        return found


class Automaton:
    """The compiled merges of a tokenizer file, with its transition table.

    arc_limit: resolved arcs that are kept; state_limit: states of the transition table. Both are emptied when full; states
    only between words, so that a word adds one for each of its symbols at most.
    """

    def __init__(self, path: str, arc_limit: int = 1 << 16, state_limit: int = 1 << 17):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        inner = lambda t: t[: -len(suffix)] + END if suffix and t.endswith(suffix) and t != suffix else t
        self.labels: dict[int, str] = {i: t for t, i in model["vocab"].items()}
        self.special: dict[str, int] = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.labels.update({i: t for t, i in self.special.items()})
        tokens = {inner(t): i for t, i in model["vocab"].items()}
        self.size = max(self.labels) + 1
        self.made, self.left, self.right = [-1] * self.size, [-1] * self.size, [-1] * self.size
        self.taken: dict[int, int] = {}
        for k, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self._gadget(k, tokens[inner(a)], tokens[inner(b)], tokens[inner(a) + inner(b)])
        self._grow(tokens)
        self.arcs: dict[int, bool] = {}
        self.arc_limit, self.state_limit = arc_limit, state_limit
        self.end = END if suffix else ""
        self.symbols = dict(enumerate(byte_symbols()))
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.states: dict[tuple[int, ...], State] = {}
        self._restart()

    def _grow(self, tokens: dict[str, int]) -> None:
        """The parts of tokens as a tree: child[part << 9 | symbol] is a part, ends[part] the token that it is, open[part] whether it goes on."""
        self.child: dict[int, int] = {}
        self.ends, self.open, self.length = [-1], [True], [0]
        for text, token in tokens.items():
            part = 0
            for c in text:
                self.open[part] = True
                key = part << 9 | ord(c)
                part = self.child.setdefault(key, len(self.ends))
                if part == len(self.ends):
                    self.ends.append(-1)
                    self.open.append(False)
                    self.length.append(self.length[key >> 9] + 1)
            self.ends[part] = token

    def _gadget(self, k: int, a: int, b: int, ab: int) -> None:
        self.taken[a * self.size + b] = k
        self.made[ab], self.left[ab], self.right[ab] = k, a, b

    def arc(self, state: int, token: int) -> bool:
        """Whether `token` may be read in the state after `state`."""
        key = state * self.size + token
        found = self.arcs.get(key)
        if found is None:
            if len(self.arcs) >= self.arc_limit:
                self.arcs.clear()
            found = self.arcs[key] = self._resolve(state, token)
        return found

    def _resolve(self, u: int, v: int) -> bool:
        made, bound = self.made, 1 << 60
        while True:
            k = self.taken.get(u * self.size + v)
            if k is not None and k < bound:
                return False
            if made[u] < 0 and made[v] < 0:
                return True
            if made[u] > made[v]:  # u's state was copied from its right part's, before merge made[u]
                bound, u = made[u], self.right[u]
            else:  # v's arc came with that of its left part; at equal merges the left one goes first
                bound, v = made[v] + 1, self.left[v]

    def _state(self, live: tuple[int, ...], token: int, size: int) -> State:
        found = self.states.get(live)
        if found is None:
            found = self.states[live] = State()
            found.auto, found.live, found.token, found.size = self, live, token, size
        return found

    def empty(self) -> None:
        """Forget resolved arcs and the transition table."""
        self.arcs.clear()
        self._restart()

    def _restart(self) -> None:
        for state in self.states.values():
            state.clear()
        self.states.clear()
        self.start = self._state((self.size,), -1, 0)  # `size` stands for the state before any token

    def step(self, live: tuple[int, ...], symbol: str) -> State:
        """The state after one more symbol. live: for each place where a token may end, part * (size + 1) + token state."""
        base, code, out, last, size = self.size + 1, ord(symbol), [], -1, 0
        for cell in live:
            part, state = divmod(cell, base)
            part = self.child.get(part << 9 | code)
            if part is None:
                continue
            token = self.ends[part]
            if last < 0 <= token and (state == self.size or self.arc(state, token)):
                last, size = token, self.length[part]
            if self.open[part]:
                out.append(part * base + state)
        if last >= 0:
            out.append(last)
        return self._state(tuple(out), last, size)

    def word(self, symbols: str) -> list[int]:
        """Token ids of one pre-split word, given as byte symbols."""
        if len(self.states) >= self.state_limit:
            self._restart()
        state, path, ids = self.start, [], []
        for symbol in symbols + self.end:
            state = state[symbol]
            path.append(state)
        at = len(path)
        while at:
            state = path[at - 1]
            if not state.size:
                raise ValueError(f"no tokenization of {symbols!r}")
            ids.append(state.token)
            at -= state.size
        ids.reverse()
        return ids

    def spell(self, word: str) -> str:
        """A word of a normalised text as byte symbols."""
        return word.encode().decode("latin-1").translate(self.symbols)

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, joined as a tokenizer without decoder joins them."""
        return " ".join([self.labels[i] for i in ids if i in self.labels])


def normalize(text: str) -> str:
    """NFC, then the lower case of each character by itself."""
    if text.isascii():
        return text.lower()
    if not unicodedata.is_normalized("NFC", text):
        text = "".join([unicodedata.normalize("NFC", part) for part in _LATE.split(text)])
    text = text.replace("Σ", "σ").lower()
    return text.translate(_LOWER) if _CAPITALS.search(text) else text


class Encoder:
    """Whole texts to ids and labels.

    The encoding of white-space-delimited chunks is kept in two generations of about chunk_limit each: what is used of the
    older one moves to the newer one, and the rest goes when that is full.
    """

    def __init__(self, automaton: Automaton, chunk_limit: int = 1 << 17):
        self.automaton, self.chunk_limit = automaton, chunk_limit
        self.old: dict[str, tuple[bytes, bytes]] = {}
        encoder = self

        class Chunks(dict):
            def __missing__(self, chunk: str) -> tuple[bytes, bytes]:
                found = encoder.old.get(chunk) or encoder.chunk(chunk)
                self[chunk] = found
                return found

        self.fresh = Chunks
        self.new = Chunks()

    def empty(self) -> None:
        """Forget what was kept of texts; the compiled merges stay."""
        self.old, self.new = {}, self.fresh()
        self.automaton.empty()

    def chunk(self, chunk: str) -> tuple[bytes, bytes]:
        """ids and labels of a text without white space."""
        words = [chunk] if chunk.isalpha() else SPLIT.findall(chunk)
        if len(words) > 1:
            parts = [self.new[w] if len(w) < 64 else self.chunk(w) for w in words]
            return b"".join([i for i, _ in parts]), b" ".join([n for _, n in parts])
        auto = self.automaton
        ids = [i for w in words for i in auto.word(auto.spell(w))]
        return struct.pack(f"<{len(ids)}I", *ids), auto.decode(ids).encode()

    def _plain(self, text: str) -> tuple[bytes, bytes]:
        text = normalize(text)
        chunks = SPLIT.findall(text) if ODD.search(text) else text.split()
        out, names = [], []
        for lo in range(0, len(chunks), 1 << 14):
            if len(self.new) >= self.chunk_limit:
                self.old, self.new = self.new, self.fresh()
            found = list(map(self.new.__getitem__, chunks[lo : lo + (1 << 14)]))
            out.append(b"".join([i for i, _ in found]))
            names.append(b" ".join([n for _, n in found]))
        return b"".join(out), b" ".join(names)

    def encode(self, text: str | None) -> tuple[bytes, bytes]:
        """ids as little-endian unsigned 32-bit integers, and the decoded text in UTF-8."""
        if not text:
            return b"", b""
        cut = self.automaton.cut
        if cut is None or "<|" not in text:
            return self._plain(text)
        ids, names = [], []
        for part in cut.split(text):
            if part in self.automaton.special:
                ids.append(struct.pack("<I", self.automaton.special[part]))
                names.append(part.encode())
            elif part:
                i, n = self._plain(part)
                ids.append(i)
                names += [n] if n else []
        return b"".join(ids), b" ".join(names)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process and tokenizer file."""
    return Encoder(Automaton(path))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids as binary if with_ids.

    A map over Arrow batches: no shuffle, and a task holds one batch and its bounded tables, which are emptied at its end.
    Null and empty texts have no tokens and the hash of nothing; whole texts are read, however long; repeated rows and null
    ids pass through as they are; other columns are not read. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        try:
            for batch in (b.slice(at, 1000) for b in batches for at in range(0, max(b.num_rows, 1), 1000)):
                got = [enc.encode(t) for t in batch.column("text").to_pylist()]
                cols = [batch.column("doc_id"), pa.array([len(i) // 4 for i, _ in got], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i, _ in got], pa.string()), pa.array([hashlib.sha256(d).hexdigest() for _, d in got], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols.append(pa.array([i for i, _ in got], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)
        finally:  # idle workers live on beside the next stage's work
            enc.empty()

    return kept.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the decoded text of each row of ids (little-endian unsigned 32-bit integers); null ids give ''. Unknown ids are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = encoder(path).automaton
        for batch in batches:
            texts = [auto.decode(list(struct.unpack(f"<{len(x) // 4}I", x))) if x else "" for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")
