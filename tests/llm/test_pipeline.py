"""The pipeline as a whole and its stages, and operators 4, 5 and 8, against brute force."""

import hashlib
import math
import random
import struct
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lograil.llm import langid, license, mixing

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"en": "the and ing tion er".split(), "fr": "eau oir ment ère ou".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus(rng):
    rows = []
    for i in range(60):
        lang = rng.choice(["en", "fr"])
        lines = [prose(rng, lang, rng.randint(12, 25)) for _ in range(rng.randint(1, 5))]
        rows.append([i, "\n".join(lines), lang if i % 7 else None, rng.choice(["a", "a", "a", "b", None]), 5])
    for i in range(60, 75):  # near copies, exact copies, repeated runs of lines
        own = rows[i - 60][1].split(" ")
        kind = i % 3
        text = rows[i - 60][1] if kind == 0 else " ".join([*own[:-1], "changed"]) if kind == 1 else rows[i - 59][1].split("\n")[0] + "\n" + prose(rng, "en", 20)
        rows.append([i, text, "en", "b", 5])
    return [tuple(r) for r in [*rows, (80, None, "en", "a", 0), (81, "", "en", "a", 0), (82, "12 34 !?", None, "c", 0), (None, prose(rng, "en", 30), "en", "a", 1), rows[4], (83, prose(rng, "fr", 3000), "fr", "b", 1)]]


def kept_lines(docs, ids):
    """Line dedup: later copies of lines of eight words or more, and of pairs of lines, go."""
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is not None, docs[i][0] or 0, docs[i][1] or ""))
    lines = {i: [x for x in (docs[i][1] or "").split("\n") if x.strip(" \t\n\x0b\f\r")] for i in order}
    seen, gone = set(), defaultdict(set)
    texts = set()
    for i in order:
        if (docs[i][0], docs[i][1]) in texts:  # rows that agree in id and text are one document
            gone[i] = next(gone[j] for j in order if docs[j][:2] == docs[i][:2])
            continue
        texts.add((docs[i][0], docs[i][1]))
        for p, x in enumerate(lines[i]):
            for key, places in (((x,), (p,)) if len(x.split()) >= 8 else (None, ()), ((x, lines[i][p + 1]), (p, p + 1)) if p + 1 < len(lines[i]) else (None, ())):
                if key is not None:
                    if key in seen:
                        gone[i].update(places)
                    seen.add(key)
    out = []
    for i in order:
        if not gone[i]:
            out.append(docs[i])
        elif text := "\n".join(x for p, x in enumerate(lines[i]) if p not in gone[i]):
            out.append((docs[i][0], text, *docs[i][2:]))
    return out


def near_kept(docs):
    """Near-dedup: the row of smallest id of each component of texts alike by 0.8 in five-word shingles."""
    words = [(t or "").encode().lower().split() for _, t, *_ in docs]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    root = list(range(len(docs)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if root[i] != root[j] and (a == b or len(a & b) >= 0.8 * len(a | b)):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    first = {}
    for i, r in enumerate(root):
        key = (docs[i][0] is None, docs[i][0] or 0, docs[i][1] or "")
        if r not in first or key < first[r][0]:
            first[r] = (key, docs[i])
    return [d for _, d in first.values()]


def test_every_stage_and_the_whole_run_equal_brute_force(spark, tmp_path):
    rows = corpus(random.Random(4))
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs, before = spark.read.parquet(str(tmp_path / "documents.parquet")), rows
    tuples = lambda df: [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["language ID", "line dedup", "near-dedup", "mixing", "tokenize"]
    for name in ("language ID", "line dedup", "near-dedup", "mixing"):
        docs = corpus_pipeline.materialize(steps[name](spark, docs, str(tmp_path)), "stage")
        assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
        now = tuples(docs)
        if name == "language ID":
            assert Counter(now) == Counter(r for r in rows if r[0] not in (80, 81, 82))
        if name == "line dedup":
            assert Counter(now) == Counter(kept_lines(before, None))
        if name == "near-dedup":
            assert Counter(now) == Counter(near_kept(before)) and len(now) < len(before)
        if name == "mixing":
            words = lambda x: len((x[1] or "").split())
            size, taken = Counter(), Counter()
            for r in before:
                size[r[3]] += words(r)
            for r in now:
                taken[r[3]] += words(r)
            assert set(now) <= set(before) and max(Counter(now).values()) <= 2
            aim = sum(size.values()) * 1.5
            assert abs(sum(taken.values()) - min(aim, 2 * sum(size.values()))) <= max(map(words, before)) * len(size)
        before = now
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in before:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want[r[0], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()] += 1
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want


def test_mixing_equals_systematic_sampling(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 1, 5, 40])), rng.choice(["a", "b", "ä", "c", None])) for i in range(300)] + [(None, "w w", "a"), (5, None, "b"), (5, None, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    hashed = df.withColumn("k2", F.xxhash64("text")).withColumn("off", F.pmod(F.xxhash64(F.lit(17), F.coalesce("source", F.lit("")), F.col("source").isNull()), F.lit(1 << 30)) / F.lit(float(1 << 30))).collect()
    size = Counter()
    for r in hashed:
        size[r.source] += len((r.text or "").split())
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight, target, left, open_ = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, {}, 1.5 * sum(size.values()), set(names)
    while open_:  # targets stop at twice a source's size, the rest is shared again
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > 2 * size[s]]
        for s in full or list(open_):
            target[s] = 2.0 * size[s] if full else left * weight[s] / total
            open_.discard(s)
        left -= sum(target[s] for s in full)
    want = Counter()
    for s in names:
        own = sorted((r for r in hashed if r.source == s), key=lambda r: (-len((r.text or "").split()), r.doc_id is not None, r.doc_id or 0, r.k2))
        step = target[s] / size[s] if size[s] else 0.0
        for i, r in enumerate(own):
            n = len((r.text or "").split())
            want[r.doc_id, n, size[s], round(target[s], 6), n * (math.floor(r.off + step * (i + 1)) - math.floor(r.off + step * i))] += 1
    got = Counter((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.mix(df).collect())
    assert got == want


def test_language_mixtures_equal_plain_em_and_held_out_rows_are_known(spark):
    rng, docs = random.Random(3), []
    for i in range(240):
        lang = rng.choice(["en", "fr"])
        docs.append((i, prose(rng, lang, rng.randint(5, 60)), lang, 1))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, lang_pred int")
    rows = {r.doc_id: r for r in langid.identify(df).collect()}
    assert all(rows[i].lang_pred == lang for i, _, lang, _ in docs if rows[i].held_out) and sum(r.held_out for r in rows.values()) > 50
    names, logs = langid.train(df)
    both = prose(rng, "en", 80) + " " + prose(rng, "fr", 40)
    g = langid.grams(both)
    p = np.exp(logs[:, g])
    share = np.array([0.5, 0.5])
    for _ in range(200):
        share = np.mean(share[:, None] * p / (share @ p), axis=1)
    assert names == ["en", "fr"] and np.allclose(langid.infer(g, logs), share, atol=0.02) and 0.5 < share[0] < 0.8
    odd = spark.createDataFrame([(None, "the", "en", 0), (1, None, "en", 0), (2, "", None, 0), (3, "12", "fr", 0), (3, "12", "fr", 0)], df.schema)
    assert langid.keep_identified(odd).count() == 1 and langid.keep_identified(odd.limit(0)).count() == 0


def test_licenses_of_odd_rows(spark):
    mit = "Released under the MIT license"
    rows = [(1, f"{mit}\nshort", "p/a/LICENSE", 0.5), (2, "no notice here", "p/a/b/x", 0.5), (3, "Copyright: nothing known", "p/c/y", 0.5), (4, f"{mit}\n" + "word " * 5000, "q/z", 0.5), (5, None, "p/a/n", 0.5), (6, "", None, 0.5), (7, mit, None, 0.5), (2, "no notice here", "p/a/b/x", 0.5), (None, "licensed under cc by 4.0", "r/x", 0.5), (8, "x", "r/deep/er/y", 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, path string, score double")
    got = license.scan(df).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.path): (r.license, r.origin, r.from_dir) for r in got}
    assert by[1, "p/a/LICENSE"] == ("MIT", "own", None) and by[2, "p/a/b/x"] == ("MIT", "inherited", "p/a") == by[5, "p/a/n"] and by[3, "p/c/y"] == (None, "none", None)
    assert by[4, "q/z"][:2] == ("MIT", "own") and by[6, None] == (None, "none", None) and by[7, None][:2] == ("MIT", "own") and by[8, "r/deep/er/y"][1:] == ("inherited", "r")
    assert license.scan(df.limit(0)).count() == 0


def test_licenses_that_no_single_line_shows(spark):
    mit = dict(license.TEXTS)["MIT"].split()
    file = "\n".join(" ".join(mit[i : i + 9]) for i in range(0, len(mit), 9))
    filler = "some words that speak of nothing at all"
    rows = [(1, f"{filler}\nReleased\nunder the\n\nMIT\nlicense", "a/x"), (2, filler, "a/y"), (3, f"MIT License\n\n{file}", "b/LICENSE"), (4, filler, "b/c/z"),
        (5, f"{filler}\nThis source code form is subject to the terms of the Mozilla public\n" + f"{filler}\n" * 30, "d/x"), (6, filler, "d/y"), (7, f"{filler}\n" * 2500 + "this work is licensed\nunder the GNU general\npublic license\nversion 3", "e/x")]
    by = {r.doc_id: (r.license, r.origin, r.from_dir) for r in license.scan(spark.createDataFrame(rows, "doc_id long, text string, path string")).collect()}
    assert by[1] == ("MIT", "own", None) and by[2] == ("MIT", "inherited", "a")  # wrapped
    assert by[3] == ("MIT", "own", None) and by[4] == ("MIT", "inherited", "b")  # a whole licence file
    assert by[5] == ("MPL-2.0", "own", None) and by[6] == (None, "none", None)  # no cue in the line
    assert by[7] == ("GPL-3.0", "own", None)  # far behind in a long text


def test_licenses_look_closer_at_texts_with_enough_of_a_template_only(spark, monkeypatch):
    held = []
    for name in ("wrapped", "whole"):
        step = getattr(license, name)
        monkeypatch.setattr(license, name, lambda keyed, *more, _step=step: held.append({r.doc_id for r in keyed.select("doc_id").collect()}) or _step(keyed, *more))
    bsd = dict(license.TEXTS)["BSD-3-Clause"].split()
    rows = [(i, f"a file in a library of {n} and other software\nor one of a public source without a name and a version", "a/x") for i, n in enumerate("pqrst")]
    rows += [(5, "filler\nreleased\nunder the mit\nlicense", "b/x"), (6, " ".join(bsd[: len(bsd) * 9 // 10]), "c/x"), (7, None, "d/x"), (8, "Released under the MIT license", "e/x"), (9, "", "f/x")]
    got = {r.doc_id: (r.license, r.origin) for r in license.scan(spark.createDataFrame(rows, "doc_id long, text string, path string")).collect()}
    assert held == [{5, 6, 8}, {5, 6, 8}]
    assert got == {**{i: (None, "none") for i in (0, 1, 2, 3, 4, 7, 9)}, 5: ("MIT", "own"), 6: ("BSD-3-Clause", "own"), 8: ("MIT", "own")}
