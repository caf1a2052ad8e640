"""Operators 11 to 13 against brute force, with nulls, ties, repeated rows, long texts, empty tables and clashing columns."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import pytest

from lograil.llm import bagsearch, conversations, mixing, toxicity

WS = "\x20\x09\x0a\x0b\x0c\x0d"


# ---- 13: conversations


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k:
            row = (conv, turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
            out += [row] * (2 if k == 3 else 1)
    return out


def brute(turns):
    """(cost, audit, repaired text) by trying every edit of every turn."""
    turns = sorted(turns, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    seen, rows, faults = set(), [], Counter()
    for _, role, text in turns:
        fault = "blank" if not text.strip(WS) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(WS)[-1] not in ".!?" else ""
        seen.add((role, text))
        rows.append((role, text, fault))
        faults[fault] += 1

    @lru_cache(None)
    def best(i, q, inserted):
        options = []
        if i == len(rows) and q in (0, 3):
            options.append((0, "", ()))
        after = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}[q]
        if inserted < 2:
            c, a, t = best(i, after[0], inserted + 1)
            options.append((c + 3, "I" + a, (after[1] + ":", *t)))
        if i < len(rows):
            role, text, fault = rows[i]
            c, a, t = best(i + 1, q, 0)
            options.append((c + 4, "D" + a, t))
            if fault in ("", "truncated"):
                more = 3 if fault else 0
                to = 1 if q == 0 and role[:1] == "s" else after[0] if role[:1] == after[1][0] else None
                if to is not None:
                    c, a, t = best(i + 1, to, 0)
                    options.append((c + more, "K" + a, (f"{role}:{text}", *t)))
                c, a, t = best(i + 1, after[0], 0)
                options.append((c + 3 + more, "R" + a, (f"{after[1]}:{text}", *t)))
        return min(options, default=(10**9, "", ()))

    cost, audit, texts = best(0, 0, 0)
    marks = [r[:1] for r, _, _ in rows]
    known = [t for t, _, _ in turns if t is not None]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(marks))
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(texts).encode()).hexdigest()


def conversation_rows(seed, convs, turns):
    rng, rows = random.Random(seed), []
    for conv in [*range(convs), None]:
        at = [*range(rng.randint(1, turns))]
        rng.shuffle(at)
        for turn in at[: rng.randint(1, turns)]:
            role = rng.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None])
            rows.append((conv, None if rng.random() < 0.05 else turn, role, rng.choice(["Hello.", "so", "Why? \n", " \t", "", None, "é!", "ok…", "Yes."])))
    return [*rows, *rows[:5]]


@pytest.mark.parametrize("block", [3, 64])
def test_conversations_equal_brute_force(spark, block):
    rows = conversation_rows(7, 60, 11)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, pos int, fault string")
    got = {r.conv_id: tuple(r)[1:] for r in conversations.reports(df, conversations.damage(df), block).collect()}
    own = {c: [] for c, *_ in rows}
    for conv, *rest in damaged(rows):
        own[conv].append(tuple(rest))
    assert got == {c: brute(t) for c, t in own.items()}


def test_blocks_and_whole_alignments_agree(spark):
    rng = random.Random(3)
    rows = [(1, i, rng.choice(["user", "assistant", "system"]), rng.choice(["a", "b", "c"]) * rng.randint(1, 4) + rng.choice([".", ".", ""])) for i in range(150)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [conversations.reports(df, df, b).collect() for b in (5, 32, 1000)]
    assert got[0] == got[1] == got[2]
    kept = conversations.repair(df, 16).where("edit <> 'D'").orderBy("pos", "sub").collect()
    assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in kept))


def test_conversations_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.reports(df, conversations.damage(df)).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(gone, 0, "user", "Hi.")], df.schema)
    assert [tuple(r) for r in conversations.reports(one, conversations.damage(one)).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


# ---- 12: search


def words(text):
    return re.findall("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, k):
    bags = [(d, Counter(words(t))) for d, t in docs if words(t)]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    asked = {}
    for i, text in items:
        if i is not None:
            asked.setdefault(i, set()).update(words(text))
    for i, terms in asked.items():
        found = []
        for doc, bag in bags:
            m = 50 + (50 * sum(bag.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 20 * m)) for t in terms if t in bag)
            if s > 0 and doc is not None:
                found.append((-s, doc))
        out += [(i, r, doc, -s) for r, (s, doc) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def search_rows():
    rng = random.Random(5)
    vocabulary = ["Zug", "ÄPFEL", "äpfel", "naïve", "x1", "1x", "日本", "the", "THE", "of", "a", "b", "c", "q"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 40)))) for i in range(300)]
    docs += [(1000 + i, docs[3][1]) for i in range(60)] + [(2000, None), (2001, ""), (2002, " .,-"), (None, "the of a"), (2003, "the " * 50_000)] + [docs[9]] * 3
    rng.shuffle(docs)
    items = [(i, " ".join(rng.sample(vocabulary, 4))) for i in range(12)] + [(20, None), (21, "nowhere"), (None, "the"), (22, docs[7][1])]
    return docs, items


@pytest.mark.parametrize("most", [8, 1 << 16])
def test_search_equals_brute_force(spark, monkeypatch, most):
    docs, items = search_rows()
    monkeypatch.setattr(bagsearch, "CELLS", 200)
    monkeypatch.setattr(bagsearch.blocks_of, "__defaults__", (most,))
    d = spark.createDataFrame([(*r, 5, "h") for r in docs], "doc_id long, text string, score int, h string")
    q = spark.createDataFrame([(*r, 5, "h") for r in items], "item_id long, text string, term int, h string")
    got = sorted(tuple(r) for r in bagsearch.search(d, q, 10).collect())
    assert got == ranked(docs, items, 10)


def test_search_of_nothing(spark):
    docs, items = search_rows()
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert bagsearch.search(d.limit(0), q).count() == 0
    assert bagsearch.search(d, q.limit(0)).count() == 0


# ---- 11: toxicity


def toxic_tables(spark, seed=1, n=900):
    """Sentences in which a group is named more often where they are toxic; what is toxic is said by three words."""
    rng, docs, labels = random.Random(seed), [], []
    for i in range(n):
        toxic = rng.random() < 0.3
        text = rng.choices("we went along to see some nice old places near here with all of them".split(), k=rng.randint(5, 30))
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(["idiot", "moron", "scum"]))
        if rng.random() < (0.8 if toxic else 0.05):
            text.insert(rng.randrange(len(text)), "muslims")
        docs.append((i, " ".join(text), "src"))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows_and_neutral_mentions(spark):
    docs, labels = toxic_tables(spark)
    rows = toxicity.score(docs, *toxicity.train(docs, labels)).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.toxic for r in held) / len(held) > 0.97
    neutral = spark.createDataFrame([(0, "some muslims went along to see places"), (1, "we went with christians to see them"), (2, "that idiot here")], "doc_id long, text string")
    plain = {r.doc_id: r.score for r in toxicity.score(neutral, *toxicity.train(docs, labels, penalty=0.0)).collect()}
    fair = {r.doc_id: r.score for r in toxicity.score(neutral, *toxicity.train(docs, labels)).collect()}
    assert fair[0] < plain[0] / 2 and fair[0] < 0.5 < fair[2]
    assert abs(math.log(fair[0] / (1 - fair[0])) - math.log(fair[1] / (1 - fair[1]))) < 0.5


def test_swaps_replace_a_term_by_the_others_of_its_kind():
    got = list(toxicity.swaps({"see", "women", "here"}))
    assert got == [({"women ", "wom", "wome", "women"}, {"men ", "men"})]
    assert not list(toxicity.swaps({"nobody"}))


def test_toxicity_of_odd_rows(spark):
    docs, labels = toxic_tables(spark, n=300)
    odd = spark.createDataFrame([(None, "idiot", "x"), (5000, None, "x"), (5001, "", "x"), (5002, "12 !?", "x"), (5003, "nice " * 100_000 + "scum", "x"), (5004, "Scum", "x"), (5004, "Scum", "x")], docs.schema)
    more = spark.createDataFrame([(None, 1), (5001, None), (7777, 1), (0, 1), (0, 1)], labels.schema)
    model = toxicity.train(docs.unionAll(odd), labels.unionAll(more))
    rows = toxicity.score(odd, *model).collect()
    assert len(rows) == 7 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    by = {r.doc_id: r.score for r in rows}
    assert by[5000] == by[5001] == by[5002] < 0.5 < by[5004]
    nothing = toxicity.train(docs.limit(0), labels)
    assert {r.score for r in toxicity.score(odd, *nothing).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), *nothing).count() == 0
    assert {r.predicted for r in toxicity.score(odd, *toxicity.train(docs, labels.where("toxic = 1"))).collect()} == {1}


# ---- 4: copies of rows that differ in other columns only


def test_emit_keeps_rows_apart_that_differ_in_any_column(spark):
    rows = [(1, "a b c", "s", i) for i in range(4)] + [(1, "a b c", "s", 9)] * 3 + [(i, "d e f", "t", None) for i in range(5)] + [(None, None, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, k1 int")
    got = [tuple(r) for r in mixing.emit(df).collect()]
    again = [tuple(r) for r in mixing.emit(df.repartition(5)).collect()]
    assert Counter(got) == Counter(again) and set(got) <= set(rows)  # s aims at 40.5 of 21 words, t at 13.5 of 15
    assert all(1 <= got.count((1, "a b c", "s", i)) <= 2 for i in range(4)) and 5 <= got.count(rows[4]) <= 6
    assert sum(r[2] == "s" for r in got) in (13, 14) and sum(r[2] == "t" for r in got) in (4, 5)
    assert mixing.emit(df.limit(0)).count() == 0
