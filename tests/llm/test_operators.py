"""The operators against brute force on small tables, and on nulls, empty texts, repeats and empty tables."""

import hashlib
import random
import re
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lograil.llm import bpe, groups, hnsw, langid, linededup, mixing, passages, quality, simhash, warc

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " \n\t ", "the", "The THE the", "é ÉÉ ﬁ Σας", "x" * 5000, "a <|endoftext|> b", "1234 !?! it's"]


def words(rng, n):
    return " ".join(rng.choice(["ta", "ko", "mi", "re", "su", "va", "lo", "ne"]) + rng.choice(["ra", "li", "to", "ka", "ze", "pu"]) + rng.choice("abcdefgh") for _ in range(n))


def docs(spark, texts, extra=""):
    rng = random.Random(1)
    rows = [(i, t, rng.choice(["en", "de"]), rng.choice(["a", "b", None]), 0, 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "null id", None, None, 0, 1, 2)], "doc_id long, text string, lang string, source string, n_chars long, fp long, rank long")


def test_bpe_equals_library(spark):
    rng = random.Random(3)
    texts = [*ODD, *["".join(rng.choice("abeth inß's.,!?\n0é") for _ in range(rng.randint(0, 90))) for _ in range(300)]]
    t = Tokenizer.from_file(PATH)
    got = {r["doc_id"]: r for r in bpe.encode(docs(spark, texts), PATH, with_ids=True).collect()}
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(docs(spark, texts), PATH, with_ids=True), PATH).collect()}
    assert back[4] == "the</w> the</w> the</w>" and back[0] == ""


def test_bpe_equals_library_on_code_points():
    t, enc = Tokenizer.from_file(PATH), bpe.Encoder(bpe.Automaton(PATH), chunk_limit=1 << 10)
    points = [chr(c) for c in [*range(0x1FFFF), *range(0x31300, 0x323C0), *range(0xE0000, 0xE0200)] if not 0xD800 <= c < 0xE000]
    for form in ("a{0}b", "{0}{0}\u0301x", "a\u0301{0}\u0327 z{0}"):
        texts = [" ".join(form.format(c) for c in points[i : i + 500]) for i in range(0, len(points), 500)]
        for text, e in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True):
            assert enc.encode(text)[0] == struct.pack(f"<{len(e.ids)}I", *e.ids), ascii(text[:9])


def test_bpe_tables_that_are_full():
    rng = random.Random(17)
    small, large = bpe.Encoder(bpe.Automaton(PATH, arc_limit=8, state_limit=8), chunk_limit=2), bpe.Encoder(bpe.Automaton(PATH))
    for _ in range(20):
        text = "".join(rng.choice("abcdeth é.,'19") for _ in range(100))
        assert small.encode(text) == large.encode(text)


def test_bpe_leaves_nothing_of_texts_in_idle_workers(spark):
    rows = docs(spark, [f"word{i} and {i * i}" for i in range(400)]).repartition(8)
    assert bpe.encode(rows, PATH).where("n_tokens > 0").count() >= 400

    def held(batches):
        for batch in batches:
            enc = bpe.encoder(PATH)
            yield pa.RecordBatch.from_arrays([pa.array([len(enc.new) + len(enc.old) + len(enc.automaton.arcs) + len(enc.automaton.states) - 1])], names=["n"])

    assert {r["n"] for r in rows.select("doc_id").mapInArrow(held, "n long").collect()} == {0}


def test_blocks_link_as_pairs_do():
    rng = np.random.default_rng(3)
    for _ in range(60):
        sets = [np.unique(rng.integers(0, 30, rng.integers(0, 14))).astype("<u4") for _ in range(int(rng.integers(2, 14)))]
        label = list(range(len(sets)))
        for _ in sets:
            label = [min([label[i], *(label[j] for j, b in enumerate(sets) if len(np.intersect1d(a, b)) and len(np.intersect1d(a, b)) >= 0.5 * len(np.union1d(a, b)))]) for i, a in enumerate(sets)]
        own = list(range(len(sets)))
        for i, j in groups.linked(sets, groups.jaccard(0.5)):
            low, high = sorted((own[i], own[j]))
            own = [low if x == high else x for x in own]
        assert own == label


def test_simhash_components(spark):
    rng = random.Random(5)
    base = [words(rng, 400) for _ in range(40)]
    texts = [*ODD, *base, *base[:5], *[b.replace(" ", "  ", 1) + " zz" for b in base[:20]]]

    def fp(t):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    fps = [fp(t) for t in texts]
    label = list(range(len(texts)))
    for _ in texts:
        label = [min(label[j] for j in range(len(texts)) if bin(fps[i] ^ fps[j]).count("1") <= 2) for i in range(len(texts))]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs(spark, texts)).collect() if r["doc_id"] is not None}
    assert all(got[i]["fingerprint"] == f"{fps[i]:016x}" and got[i]["component_id"] == label[i] for i in range(len(texts)))
    assert simhash.keep_one(docs(spark, texts)).where("doc_id is not null").count() == len(set(label))


def test_stars_keep_all_links(spark):
    rng = random.Random(2)
    x = rng.getrandbits(63)
    fps = list({x, *[x ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for _ in range(150)]})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = simhash.components(simhash.links(df, bucket=8)).collect()
    assert {r["root"] for r in found} == {min(fps)} and len(found) == len(fps)


@pytest.mark.parametrize("block", [groups.BLOCK, 8])  # as in production; groups of many blocks
def test_keep_one_alike_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(groups, "BLOCK", block)
    rng = random.Random(8)
    base = [words(rng, 200).split() for _ in range(30)]
    passage = words(rng, 150)
    texts = [*ODD, "a b c", "A b  c", "a b d", *map(" ".join, base)]
    for changed in (1, 2, 3, 4, 8):  # alike by 0.95 down to 0.66
        for b in base:
            own = list(b)
            for at in rng.sample(range(0, 200, 6), changed):
                own[at] = "new" + str(rng.random())
            texts.append(" ".join(own))
    texts += [passage + " " + words(rng, n) for n in (5, 10, 20, 60, 90, 120) for _ in range(12)]  # more than a block of 8 share the passage

    def sets(t):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    own = [sets(t) for t in texts]
    label = list(range(len(texts)))
    like = [[j for j in range(len(texts)) if own[i] == own[j] or len(own[i] & own[j]) >= 0.8 * len(own[i] | own[j])] for i in range(len(texts))]
    for _ in texts:
        label = [min(label[j] for j in like[i]) for i in range(len(texts))]
    got = simhash.keep_one_alike(docs(spark, texts).withColumn("_row", F.lit(1)).withColumn("keys", F.lit("x")))
    assert "keys" in got.columns and "_row" in got.columns
    assert sorted(r["doc_id"] for r in got.where("doc_id is not null").collect()) == sorted(set(label))


def test_keep_one_alike_of_short_texts_with_a_frame(spark):
    rng = random.Random(13)
    frame, texts = words(rng, 8), []
    for _ in range(150):  # 5 shingles, and the same with one more word: alike by 5/6
        own = frame + " " + words(rng, 1) + str(rng.random())
        texts += [own, own + " " + words(rng, 1) + str(rng.random())]
    got = simhash.keep_one_alike(docs(spark, texts)).where("doc_id is not null").collect()
    assert sorted(r["doc_id"] for r in got) == list(range(0, 300, 2))


def test_quality_and_ablation(spark):
    texts = [*ODD, " ".join(f"word{i}" for i in range(80)), "a b c " * 40, "same line here\n" * 30]
    rows = {r["doc_id"]: r for r in quality.apply_policy(quality.ledger(docs(spark, texts)), 2).collect()}
    assert rows[0]["n_words"] == 0 and rows[0]["base_failed"] and not rows[0]["kept"]
    assert rows[9]["kept"] and rows[10]["n_repeat_words"] == 120 and rows[10]["base_failed"] and rows[11]["n_dup_lines"] == 29
    cut = {r["rule"]: r for r in quality.ablation(quality.ledger(docs(spark, texts)), 1).collect()}
    assert cut["too_few_words"]["failed"] == 10 and cut["repeated_windows"]["failed_alone"] == 2


def test_mixing_meets_targets(spark):
    rng = random.Random(4)
    d = docs(spark, [words(rng, rng.randint(1, 60)) for _ in range(600)])
    rows = mixing.mix(d).collect()
    by = {}
    for r in rows:
        by.setdefault(r["source_size"], [r["target"], 0])[1] += r["taken"]
    assert sum(t for t, _ in by.values()) == pytest.approx(1.5 * sum(by), rel=1e-9)
    assert all(abs(taken / target - 1) < 0.05 for target, taken in by.values()) and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(d.repartition(5)).collect()))
    assert mixing.emit(d).columns == d.columns and mixing.emit(d).select(F.sum(mixing.word_count(F.col("text")))).first()[0] == sum(r["taken"] for r in rows)


def test_language_id(spark):
    rng = random.Random(6)
    en, de = (lambda n: " ".join(rng.choice(["the", "and", "thing", "with", "of"]) for _ in range(n))), (lambda n: " ".join(rng.choice(["der", "und", "nicht", "schön", "auf"]) for _ in range(n)))
    rows = [(i, en(40) if i % 2 else de(40), "en" if i % 2 else "de") for i in range(200)] + [(900, None, "en"), (901, "123 !!", "de"), (902, en(60) + " " + de(60), None)]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[:200]) and got[900]["lang_pred"] == got[901]["lang_pred"] == "und"
    assert len(got[902]["mixture"]) == 2 and got[902]["mixture"][0]["share"] < 0.7


def test_line_dedup(spark):
    long = "one two three four five six seven eight nine"
    texts = [f"{long}\nshort\nnext", f"x\n{long}\ny", "short\nnext\nz", None, "", f"{long}\nshort\nnext"]
    got = {r["doc_id"]: r for r in linededup.dedup_lines(docs(spark, texts)).collect()}
    assert got[0]["n_removed"] == 0 and got[1]["text"] == "x\ny" and got[2]["text"] == "z" and got[3]["text"] is None and got[5]["text"] == "" and got[5]["longest_run"] == 3
    assert {r["doc_id"] for r in linededup.keep_deduped(docs(spark, texts)).collect()} == {0, 1, 2, 3, 4, None}


def test_hnsw_recall(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    rows = [(i, x[i].tolist()) for i in range(1500)] + [(2000 + i, x[0].tolist()) for i in range(30)] + [(3000, None), (3050, [0.0] * 16), (3100, [float("nan")] * 16)]
    got = hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(50, 1500, 50):
        want = {i for i in np.argsort(-(u @ u[q])) if i != q and i != 0}
        want = [i for i in np.argsort(-(u @ u[q])) if i != q][:5]
        hits += len(set(want) & {r["vec_id"] for r in got if r["query_id"] == q})
    assert hits / (29 * 5) >= 0.9
    assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == 0), key=lambda r: r["rank"])] == [2000, 2001, 2002, 2003, 2004]


def test_hnsw_recall_over_several_shards(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 24))
    rows = spark.createDataFrame([(i, x[i].tolist(), 1, "s") for i in range(3000)], "vec_id long, embedding array<double>, dim int, shard string")
    index = hnsw.build(rows, 5, shard=400)
    assert index.count() >= 7
    asked = rows.where("vec_id % 50 = 0")
    got = hnsw.search(index, asked, 5).collect()
    blocks = hnsw.search(index, asked, 5, block=16).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, blocks))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 3000, 50):
        want = {i for i in np.argsort(-(u @ u[q])).tolist()[:6] if i != q}
        near = {r["vec_id"]: r["score"] for r in got if r["query_id"] == q}
        assert all(abs(s - float(u[i] @ u[q])) < 1e-12 for i, s in near.items()) and len(near) == 5
        hits += len(want & set(near))
    assert hits / 300 >= 0.95
    assert hnsw.nearest(rows.limit(0)).count() == 0


def test_warc_round_trip_and_lookup(spark):
    big = "<p>" + "é" * 80 + "</p>"
    rows = [(1, "http://a.org/x", big), (2, "https://www.b.org/y?q=1#f", big), (3, None, None), (4, "http://a.org/x", "small"), (5, "http://c.org", "small"), (None, "http://d.org", "n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.archive(pages).collect()}
    assert got[1]["record_type"] == "response" and (got[2]["record_type"], got[2]["refers_to"], got[2]["payload_bytes"]) == ("revisit", 1, len(big.encode()))
    assert got[3]["payload_bytes"] == 0 and got[4]["record_type"] == got[5]["record_type"] == "response" and got[2]["payload_digest"] == hashlib.sha256(big.encode()).hexdigest()
    folder = warc.scratch_dir(spark, "warc")
    directory = warc.index(warc.write(warc.typed(pages), folder), folder, block=2)
    found = warc.find(spark.createDataFrame([("http://a.org/x",), ("http://no.org",)], "url string"), directory, folder).collect()
    assert {r["page_id"] for r in found} == {1, 4}
    assert [warc.url_key(u) for u in ("http://a.org:80/X?Q", "https://www.a.org/X?Q#f", "http://a.org:8080/X?Q", "http://a.org/x?q", None, "http://[")] == ["org,a)/X?Q", "org,a)/X?Q", "org,a:8080)/X?Q", "org,a)/x?q", ")/", "http://[)"]


def test_warc_lookup_in_many_blocks_and_files(spark):
    urls = ["http://hot.org/", *[f"http://h{i % 40}.org/p{i % 300}" for i in range(900)]]
    pages = spark.createDataFrame([(i, urls[0] if i % 3 == 0 else urls[i % 901], f"page {i % 7}" * 20, "x") for i in range(1800)], "page_id long, url string, html string, key string")
    folder = warc.scratch_dir(spark, "warc")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # several index files
    directory = warc.index(warc.write(warc.typed(pages), folder), folder, block=16)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert directory.count() > 1 and directory.agg({"captures": "sum"}).first()[0] == 1800
    own = pages.select("url", "page_id").collect()
    asked = spark.createDataFrame([(u,) for u in [*urls, "http://none.org/", None]], "url string")
    found = warc.find(asked, directory, folder).select("url", "page_id").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, own))
    again = pages.unionAll(pages)  # each row twice: as many rows back
    rows = warc.archive(again).collect()
    assert len(rows) == 3600 and {r["page_id"] for r in rows} == set(range(1800))
    assert warc.archive(pages.limit(0)).count() == 0


def test_passages(spark):
    rng = random.Random(8)
    p, near = words(rng, 90), None
    w = p.split()
    near = " ".join([*w[:44], "changed", *w[45:]])
    texts = [words(rng, 70) + " " + p, near + " " + words(rng, 300), words(rng, 120), p, p, "short " * 3, None, words(rng, 100) + " " + " ".join(w[:30])]
    got = {r["doc_id"]: r for r in passages.near_passages(docs(spark, texts)).collect()}
    assert [got[i]["class_id"] for i in range(8)] == [0, 0, 2, 0, 0, 5, 6, 7] and got[4]["copy_of"] == 3 and got[1]["n_passages"] >= 1


def test_passages_that_a_text_repeats(spark):
    rng = random.Random(9)
    p, q = words(rng, 80), words(rng, 60)
    head = " ".join(q.split()[:30])  # stands alone too, before the whole passage
    texts = [p + " " + words(rng, 200) + " " + p + " " + words(rng, 90), words(rng, 40) + " " + p, head + " " + words(rng, 70) + " " + q, words(rng, 20) + " " + q + " " + words(rng, 30) + " " + q]
    got = {r["doc_id"]: r for r in passages.near_passages(docs(spark, texts)).collect()}
    spans = lambda i: {(x["start"], x["end"]) for x in got[i]["passages"]}
    assert spans(0) == {(0, 79), (280, 359)} and spans(1) == {(40, 119)}
    assert spans(2) == {(100, 159)} and spans(3) == {(20, 79), (110, 169)}


@pytest.mark.parametrize("block", [groups.BLOCK, 8])
def test_passages_of_a_common_frame_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(groups, "BLOCK", block)
    rng = random.Random(12)
    frame, texts = words(rng, 42), []
    for _ in range(60):  # families of two, alike by over 0.8; different families share only the frame
        own = words(rng, 14).split()
        texts += [frame + " " + " ".join(own), frame + " " + " ".join([*own[:-1], "other"])]
    rng.shuffle(texts)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                label[i] = min(label[i], label[j])
    got = {r["doc_id"]: r["class_id"] for r in passages.near_passages(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == label and len(set(label)) == 60


def test_a_frame_pairs_nothing_and_large_groups_list_every_place(spark, monkeypatch):
    rng = random.Random(21)
    frame = words(rng, 30)
    texts = [words(rng, 40) + " " + frame + " " + words(rng, 40) for _ in range(150)]
    held = []
    rare = passages._rare
    monkeypatch.setattr(passages, "_rare", lambda m: held.append(rare(m)) or held[-1])
    monkeypatch.setattr(passages, "ONE_BLOCK", 20)
    links, _ = passages.settled(docs(spark, texts), "text")
    assert links.isEmpty() and held[0][0].isEmpty() and held[0][1].isEmpty()  # no pair is formed beyond one alignment a text
    # 40 texts with one passage each, in pairs alike, within the frame's group: each place of both is listed
    w = [words(rng, 60).split() for _ in range(20)]
    pairs = [" ".join([*x[:30], "changed", *x[31:]]) if k else " ".join(x) for x in w for k in (0, 1)]
    both = [*texts[:40], *[words(rng, 9 * (i % 3)) + " " + frame + " " + p for i, p in enumerate(pairs)]]
    got = {r["doc_id"]: r for r in passages.near_passages(docs(spark, both)).collect()}
    for i in range(40):
        partner = 40 + (i ^ 1)
        assert got[40 + i]["class_id"] == 40 + min(i, i ^ 1) and got[i]["class_id"] == i
        assert any(p["partner"] == partner and p["end"] - p["start"] >= 80 for p in got[40 + i]["passages"])


def test_empty_tables(spark):
    none = docs(spark, []).limit(0)
    assert simhash.near_duplicates(none).isEmpty() and mixing.mix(none).isEmpty() and langid.identify(none).isEmpty()
    assert linededup.dedup_lines(none).isEmpty() and simhash.keep_one_alike(none).isEmpty() and passages.near_passages(none).isEmpty() and quality.ledger(none).isEmpty() and bpe.encode(none, PATH).isEmpty()
