"""Each operator against a plain version, on small frames with nulls, empty and long texts, ties, repeated rows, and no rows."""

import json
import random
import re
import zlib

import numpy as np
import pytest
from brute import base_spans, repeated_passages, sha, shingles
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def rows(spark, values, ddl="doc_id long, text string"):
    return spark.createDataFrame(values, ddl)


def vocabulary(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Texts with copies, near copies, shared passages, and odd rows."""
    r, v = random.Random(5), vocabulary(1, 400)
    text = lambda n: " ".join(r.choice(v) for _ in range(n))
    shared = text(40)
    out = [(i, text(r.randint(1, 120))) for i in range(60)]
    out += [(100 + i, out[i][1]) for i in range(10)]
    for i in range(12):
        w = text(150).split() if i == 0 else base.copy()
        if i == 0:
            base = w
        else:
            for _ in range(3):
                w[r.randrange(len(w))] = "changed" + str(i)
        out.append((200 + i, " ".join(w)))
    out += [(300 + i, text(20) + "\n" + shared + "\t" + text(20)) for i in range(15)]
    out += [(400, None), (401, ""), (402, " \n "), (403, "one two three"), (404, "one two three"), (405, "a " * 5000), (405, "a " * 5000), (406, "x" * 20000), (None, shared)]
    return out


# --- 1 ------------------------------------------------------------------------------------------


def test_top_k(spark):
    from quarryline.llm.op1_topk import top_k

    r = np.random.default_rng(3)
    v = [(i, [float(x) for x in r.normal(size=8)]) for i in range(300)]
    v += [(1000 + i, v[100][1]) for i in range(40)]  # ties
    v += [(5, None), (6, [1.0, None] + [0.0] * 6), (7, [float("nan")] * 8), (8, []), (9, [float("inf")] * 8), (11, [1.0, 2.0]), (300, [3.0, 1.0]), (None, v[0][1]), v[200]]
    df = rows(spark, v, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    got = {(x.query_id, x.rank): (x.vec_id, x.score) for x in top_k(df, F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)), cell_bytes=512, query_bytes=128).collect()}
    good = {(i, tuple(np.floor(1024 * np.array(x)).astype(int).tolist())) for i, x in v if i is not None and x and None not in x and np.isfinite(x).all()}
    want = {}
    for q, a in good:
        if q % 100 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good if i != q and len(a) == len(b))[:10]
            want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(best)}
    assert got == want
    assert top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


# --- 2 ------------------------------------------------------------------------------------------


def test_packing(spark, corpus):
    from tokenizers import Tokenizer

    from quarryline.llm.op2_pack import pack_documents, tokenizer_path

    extra = [(500, "Ünïcode ΣΑΣ and <|endoftext|> it's I'LL 12 日本\x1c x!!, y., z…"), (501, "é combining"), (502, "İstanbul  nbsp")]
    df = rows(spark, corpus + extra).withColumn("piece", F.lit("clash"))
    got = pack_documents(df, with_ids=True).collect()
    t = Tokenizer.from_file(tokenizer_path())
    want = []
    for d, x in corpus + extra:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        want += [(d, k, a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((g.doc_id, g.piece, g.start, g.length, g.ids_crc32) for g in got), key=key) == sorted(want, key=key)
    bins = {}
    for g in got:
        assert zlib.crc32(np.array(g.ids, "<u4").tobytes()) == g.ids_crc32
        bins.setdefault(g.sequence_id, []).append((g.offset, g.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(w[3] for w in want) // 2048) + 1
    assert pack_documents(df.limit(0)).count() == 0


def test_packing_keeps_separators():
    """Every white space of str.split(), alone in plain text, gives the tokenizer's own ids."""
    from quarryline.llm.op2_pack import Encoder, tokenizer_path

    e = Encoder(tokenizer_path())
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    texts = [t for c in spaces for t in (f"ab{c}cd", f"ab {c} cd", f"{c}ab{c}{c}")]
    assert set("\x1c\x1d\x1e\x1f") <= set(spaces)
    assert e(texts) == [e.encode(t) for t in texts]


@pytest.mark.parametrize("seed", range(6))
def test_pack_plan(seed):
    from collections import Counter

    from quarryline.llm.op2_pack import pack_plan

    r = random.Random(seed)
    h = Counter(min(2048, 1 + int(r.expovariate(1 / r.choice([50, 300, 900])))) for _ in range(3000))
    used = Counter()
    plan = pack_plan(dict(h), groups=r.choice([1, 8, 512]))
    for content, n in plan:
        assert sum(content) <= 2048
        for x in content:
            used[x] += n
    assert used == h
    if seed < 2:
        assert sum(n for _, n in plan) <= 1.15 * -(-sum(k * v for k, v in h.items()) // 2048)


# --- 3 ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [1500, 5])
def test_jaccard(spark, corpus, block):
    from quarryline.llm.op3_jaccard import jaccard_classes

    data = [x for x in corpus if x[0] is not None and x[0] != 405]
    got = {x.doc_id: x for x in jaccard_classes(rows(spark, data).withColumn("class_id", F.lit(1)), block_texts=block).collect()}
    sets = {d: shingles(t) for d, t in data}
    links = {d: {e for e in sets if e != d and sets[d] and sets[e] and len(sets[d] & sets[e]) >= 0.8 * len(sets[d] | sets[e])} for d in sets}
    root = {}
    for d in sorted(sets):
        todo, group = [d], set()
        while todo:
            x = todo.pop()
            if x not in group:
                group.add(x)
                todo += links[x]
        root[d] = min(group)
    assert {d: g.n_links for d, g in got.items()} == {d: len(x) for d, x in links.items()}
    assert {d: g.class_id for d, g in got.items()} == root


def test_jaccard_odd_rows(spark, corpus):
    from quarryline.llm.op3_jaccard import jaccard_classes, least_agreements

    df = rows(spark, corpus)
    assert jaccard_classes(df).count() == len(corpus)
    assert jaccard_classes(df.limit(0)).count() == 0
    assert all(0 < m < k * 0.8 for k, m in least_agreements())


# --- 5 ------------------------------------------------------------------------------------------


def test_pii(spark):
    from quarryline.llm.op5_pii import _listed, masked, personal_data

    r = random.Random(2)
    chars = "01234567890123456789ab.@+-_% ()é\n🙂,:"
    parts = ["4337166598464399", "4337 1665 9846 4399", "a.b@c.d_x@e.f.g", "1.2.3.4.5.6.7.300", "+1 (222) 333-4444", "x@y", "999.1.1.1", "001.2.3.255", "+1"]
    data = [(i, "".join(r.choice(chars) for _ in range(r.randint(0, 60)))) for i in range(800)]
    data += [(1000 + i, " ".join(r.choice(parts) for _ in range(r.randint(1, 9)))) for i in range(300)]
    data += [(9000, None), (9001, ""), (9002, "7" * 20000), (9003, "a" * 50000), (9004, "1.2.3.4 " * 1000), (9006, "a@b." * 2000), (9006, "a@b." * 2000), (None, "a@b.cc")]
    df = rows(spark, data).withColumn("base", F.lit(1))
    got = personal_data(df).select("doc_id", "text", _listed(F.col("base")).alias("base"), masked(F.col("text"), F.col("spans")).alias("masked")).collect()
    assert len(got) == len(data)
    for g in got:
        assert g.base == ",".join(base_spans(g.text))
    assert {g.masked for g in got if g.doc_id is None} == {"<EMAIL>"}
    assert personal_data(df.limit(0)).count() == 0


def test_pii_discovers(spark):
    from quarryline.llm.op5_pii import _listed, personal_data

    data = [(i, f"word {i} please call me at +1 (222) 333-{4000 + i} now") for i in range(30)] + [(100 + i, f"others call me at 555x{i:03d}77 now") for i in range(5)] + [(200, "nothing of it 12345 there")]
    got = {x.doc_id: x.s for x in personal_data(rows(spark, data)).select("doc_id", _listed(F.col("spans")).alias("s")).collect()}
    assert all(got[100 + i] == "id:18:27" for i in range(5)) and got[200] == ""


def test_pii_discovers_words_without_digits(spark):
    from quarryline.llm.op5_pii import _listed, masked, personal_data

    names = ["annlee", "bo_ray", "Kim,"]
    data = [(i, f"word {i} please write to me at u{i}@mail.org today") for i in range(30)] + [(100 + i, f"x1 write to me at {w} today") for i, w in enumerate(names)]
    # contexts are whole though a word with digits stands right before, or the words are long
    data += [(110, "z1 me at 77 me 88 at"), (111, f"so me at q{'q' * 80} today"), (112, "é🙂 a@b.cc me at annlee today and me at bo_ray today")]
    got = {x.doc_id: (x.s, x.m) for x in personal_data(rows(spark, data)).select("doc_id", _listed(F.col("spans")).alias("s"), masked(F.col("text"), F.col("spans")).alias("m")).collect()}
    assert [got[100 + i][0] for i in range(3)] == ["id:18:24", "id:18:24", "id:18:21"]
    assert got[111] == (f"id:9:{9 + 81}", "so me at <ID> today")
    assert got[112] == ("email:3:9,id:16:22,id:39:45", "é🙂 <EMAIL> me at <ID> today and me at <ID> today")


def test_pii_counts_ordinary_words(spark):
    """A slot that seeds share with many ordinary words isn't sure."""
    from quarryline.llm.op5_pii import _listed, personal_data

    v = vocabulary(7, 60)
    data = [(i, f"{i} it came from u{i}@mail.org again") for i in range(20)] + [(100 + i, f"- it came from {w} again") for i, w in enumerate(v)] + [(200, "- it came from 4711x again")]
    got = {x.doc_id: x.s for x in personal_data(rows(spark, data)).select("doc_id", _listed(F.col("spans")).alias("s")).collect()}
    assert {got[d] for d in got if d >= 100} == {""}


# --- 6 ------------------------------------------------------------------------------------------


def test_licenses(spark):
    from quarryline.llm.op6_licenses import CONTAINED, TEMPLATES, licenses

    r, v = random.Random(4), vocabulary(9, 300)
    noise = lambda n: [r.choice(v) for _ in range(n)]
    data = []
    for i, name in enumerate(sorted(TEMPLATES) * 4):
        w = TEMPLATES[name].split()
        if i % 4 == 3 and len(w) > 30:
            w[len(w) // 2] = "changed"
        data.append((i, " ".join(noise(r.randint(0, 90)) + w + noise(r.randint(0, 90)))))
    data += [(900, None), (901, ""), (902, "Released under the"), (903, " ".join(noise(3000))), (903, " ".join(noise(5)))]
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    sets = {n: grams(word(t)) for n, t in TEMPLATES.items()}
    for x in licenses(rows(spark, data)).collect():
        w, want = word(x.text), set()
        for n, s in sets.items():
            size = len(word(TEMPLATES[n]))
            if any(len(grams(w[a : a + 2 * size]) & s) >= CONTAINED * len(s) for a in range(0, max(len(w), 1), size)):
                want.add(n)
        assert {f.license for f in x.found} == want
        assert all(0 <= f.start < f.end <= x.n_words for f in x.found)
    assert licenses(rows(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("inserted", [6, 9, 12, 18])
def test_licenses_at_all_offsets(spark, inserted):
    """A copy with words inserted in one place is found wherever it stands, and by no fewer shingles than any 2n words in a row hold."""
    from quarryline.llm.op6_licenses import CONTAINED, TEMPLATES, licenses

    w = re.findall("[a-z0-9]+", TEMPLATES["bsd-warranty"].lower())
    n = len(w)
    copy = w[: n // 2] + [f"new{i}" for i in range(inserted)] + w[n // 2 :]
    thin = w[: n // 4] + ["x"] + w[n // 4 : n // 2] + ["y"] + w[n // 2 : 3 * n // 4] + ["z"] + w[3 * n // 4 :]  # 0.625
    data = [(a + 1000 * j, " ".join([f"a{i}" for i in range(a)] + c + [f"b{i}" for i in range(50)])) for a in range(2 * n) for j, c in enumerate([copy, thin])]
    grams = lambda v: {tuple(v[i : i + 5]) for i in range(len(v) - 4)}
    for x in licenses(rows(spark, data)).collect():
        t = x.text.split()
        want = any(len(grams(t[a : a + 2 * n]) & grams(w)) >= CONTAINED * len(grams(w)) for a in range(len(t)))
        assert want == (x.doc_id < 1000)
        assert [(f.license, f.start, f.end) for f in x.found] == ([("bsd-warranty", x.doc_id, x.doc_id + n + inserted)] if want else [])


# --- 7 ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("hot", [2000, 3])
def test_passages(spark, corpus, hot, monkeypatch):
    from quarryline.llm import op7_passages as P

    monkeypatch.setattr(P.repeated_words, "__defaults__", ("doc_id", "text", hot, 500))
    data = [x for x in corpus if x[0] is not None and x[0] != 405] + [(405, "a " * 5000)]
    got = P.without_repeats(rows(spark, data).withColumn("gone", F.lit(1))).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("h")).collect()
    assert {x.doc_id: (x.n_words, x.n_removed, x.h) for x in got} == repeated_passages(data)
    odd = P.without_repeats(rows(spark, corpus)).collect()
    assert len(odd) == len(corpus) and {x.n_removed for x in odd if x.doc_id is None} == {0}
    assert P.without_repeats(rows(spark, corpus).limit(0)).count() == 0


def test_fm_index():
    from quarryline.llm.op7_passages import FmIndex

    r = np.random.default_rng(0)
    texts = [r.integers(1, 5, n) for n in (40, 1, 25, 60)]
    text = np.concatenate([np.append(x, 0) for x in texts])
    index = FmIndex(text, 6)
    for pattern in [r.integers(1, 5, k) for k in (1, 2, 3, 4, 5, 6) for _ in range(20)]:
        probe = np.concatenate([[0], pattern])
        length, low, high = index.matching(probe, np.array([len(probe) - 1]), len(pattern))
        have = [i for i in range(len(text) - len(pattern) + 1) if (text[i : i + len(pattern)] == pattern).all()]
        assert (sorted(index.suffixes[low[0] : high[0]].tolist()) == have) if length[0] == len(pattern) else not have


# --- 4 and 8 ------------------------------------------------------------------------------------


@pytest.mark.parametrize(("name", "label", "least"), [("op8_toxicity", "toxic", 0.97), ("op4_quality", "quality", 0.97)])
def test_held_out_accuracy(spark, name, label, least):
    import importlib

    folder = "/root/testdata/sf0.1"
    op = getattr(importlib.import_module(f"quarryline.llm.{name}"), name)
    got = op(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").select("predicted", F.col(label).alias("y")).toPandas()
    assert (got.predicted == got.y).mean() >= least
    assert (got.predicted[got.y == 1] == 1).mean() >= 0.9


def test_toxicity_finds_sentences(spark, corpus):
    from quarryline.llm.op8_toxicity import toxicity, train

    data = [(i, f"clean words {i} here. {'you foul thing' if i % 3 == 0 else 'nice day'} é! bye {i * 7}") for i in range(300)]
    labels = rows(spark, [(i, int(i % 3 == 0)) for i in range(300)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = train(rows(spark, data), labels)
    odd = [(1, None), (2, ""), (3, "A foul thing. ok"), (4, "fine, all fine"), (4, "fine, all fine")]
    got = toxicity(rows(spark, odd).withColumn("score", F.lit("x")), model).collect()
    assert [x.score >= 0.7 for x in got] == [False, False, True, False, False]
    assert [odd[2][1][s.start : s.end] for s in got[2].sentences] == ["A foul thing"]
    assert toxicity(rows(spark, odd).limit(0), model).count() == 0
    nothing = train(rows(spark, data), labels.limit(0))
    assert {x.score < 0.01 for x in toxicity(rows(spark, odd), nothing).collect()} == {True}


def test_quality_odd_rows(spark):
    from quarryline.llm.op4_quality import quality, train

    data = [(i, "plain words of a kind " * 5 if i % 2 else "JUNK!! | $$$ JUNK!! " * 5) for i in range(200)]
    model = train(rows(spark, data), rows(spark, [(i, i % 2) for i in range(200)], "doc_id long, quality int"))
    got = quality(rows(spark, [*data[:2], (5, None), (6, ""), (7, "x" * 100000)]).withColumn("score", F.lit("x")), model).collect()
    assert got[0].score < 0.3 < 0.7 < got[1].score and all(0 <= x.score <= 1 for x in got)
    assert quality(rows(spark, data).limit(0), model).count() == 0
    assert train(rows(spark, data), rows(spark, [], "doc_id long, quality int")).score(np.zeros((1, 15))) == pytest.approx(0.5)


# --- 9 ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [8 << 20, 60])
def test_contamination(spark, corpus, block):
    from quarryline.llm.op9_decontaminate import contamination

    shared = corpus[82][1].split("\n")[1].split("\t")[0]
    items = [(1, shared.upper()), (2, "one, two; THREE"), (3, shared), (10, None), (11, ""), (12, "a " * 20), (13, "never seen words")]
    got = contamination(rows(spark, corpus).withColumn("items", F.lit(1)), rows(spark, items, "item_id long, text string"), block_bytes=block).collect()
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = word(t)
        k = min(13, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[a : a + k]), set()).add(str(i))
    assert len(got) == len(corpus)
    for x in got:
        w, hit, ids = word(x.text), set(), set()
        for k in {len(g) for g in windows}:
            for a in range(len(w) - k + 1):
                if (own := windows.get(tuple(w[a : a + k]))) is not None:
                    hit.update(range(a, a + k))
                    ids |= own
        assert (x.n_words, x.n_hit, list(x["items"])) == (len(w), len(hit), sorted(ids))
        assert sum(s.end - s.start for s in x.spans) == len(hit)
    assert all(x.n_hit == 0 for x in contamination(rows(spark, corpus), rows(spark, [], "item_id long, text string")).collect())


# --- 10 -----------------------------------------------------------------------------------------


def test_contamination_of_equal_words_and_items():
    """A thousand equal items against a text of a hundred thousand equal words: fingerprints aren't paired."""
    import time

    import pyarrow as pa

    from quarryline.llm.op9_decontaminate import Index
    from quarryline.llm.wordhash import ALNUM_LOW, utf8, words

    index = Index([(i, "word " * 200) for i in range(1000)] + [(2000, "word " * 5), (2001, "other " * 30), (2002, None)])
    h, _, _, off = words(*utf8(pa.array(["word " * 100_000, None, "other " * 13 + "word " * 4])), ALNUM_LOW)
    start = time.perf_counter()
    a, z, sets = index.hits(h, off)
    assert time.perf_counter() - start < 5
    assert len(a) == 2 * 100_000 - 12 - 4 + 1 and z.max() == len(h) - 4
    assert sorted(len(s) for s in index.sets) == [1, 1, 1000] and {len(index.sets[s]) for s in set(sets.tolist())} == {1, 1000}


@pytest.mark.parametrize("block", [8 << 20, 40])
def test_contamination_with_nulls_and_names_that_clash(spark, block):
    """Null texts and ids on both sides, a clashing column, equal items and repeated words, against windows as sets."""
    from quarryline.llm.op9_decontaminate import contamination

    r = random.Random(8)
    text = lambda n: " ".join(r.choice("ab") for _ in range(n))
    items = [(i, text(r.choice([0, 1, 3, 12, 13, 14, 40]))) for i in range(30)] + [(100, "same " * 20), (101, "same " * 20), (None, "same " * 13), (102, None)]
    docs = [(i, text(r.randint(0, 60))) for i in range(30)] + [(50, "Same, " * 40), (51, None), (None, "same " * 12), (52, "same " * 13 + "x")]
    df = rows(spark, docs).withColumn("items", F.lit("clash")).withColumn("n_HIT", F.lit(1))
    got = contamination(df, rows(spark, items, "item_id long, text string"), block_bytes=block).collect()
    word = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    wanted = []
    for d, t in docs:
        w, hit, ids = word(t), set(), set()
        for i, x in items:
            y = word(x)
            k = min(13, len(y))
            windows = {tuple(y[j : j + k]) for j in range(len(y) - k + 1)} if y else set()
            for p in range(len(w) - k + 1) if k else ():
                if tuple(w[p : p + k]) in windows:
                    hit.update(range(p, p + k))
                    ids.add("" if i is None else str(i))
        wanted.append((d or -1, len(w), len(hit), sorted(ids)))
    assert sorted((x.doc_id or -1, x.n_words, x.n_hit, x["items"]) for x in got) == sorted(wanted)


@pytest.mark.parametrize("share", [None, 2])
def test_url_filter(spark, share):
    from datetime import date

    from quarryline.llm.op10_urls import url_filter

    day = lambda n: date(2024, 1, n)
    entries = rows(spark, [("host", "A.com", day(5), "add"), ("host", "a.com", day(9), "remove"), ("host", "a.com", day(5), "add"), ("domain", "b.org", day(3), "ADD"), ("host", None, day(1), "add"), ("host", "c.net", day(2), "add"), ("host", "c.net", day(2), "remove")], "kind string, key string, day date, action string")
    cases = [("http://a.com/x", 4, False), ("https://u:p@A.com:80/x", 5, True), ("http://a.com", 8, True), ("http://a.com", 9, False), ("http://x.y.b.org/", 3, True), ("http://xb.org/", 9, False), ("http://www.a.com/", 6, False), ("http://c.net/", 3, False), (None, 6, False), ("no url", 6, False), ("http://b.org", None, False), ("http://b.org", 20, True), ("http://b.org", 20, True)]
    # ways round a list
    cases += [(u, 6, True) for u in ("http://a.com./x", "http://user@x@a.com/", "\thttp://a.com", "//a.com", "http:\\\\a.com\\x", "ht\ntp://a.c\tom/", "HTTP://A.COM", "http://a.com?x@y", "https://b.org:1/" + "y" * 100_000)]
    cases += [("http://x@/", 6, False), ("http://a.com@z.com/", 6, False), ("http://[::1]:80/", 6, False), ("", 6, False)]
    captures = rows(spark, [(i, u, day(n) if n else None) for i, (u, n, _) in enumerate(cases)], "id long, url string, day date").withColumn("host", F.lit("clash"))
    captures = captures.withColumns({x: F.col("id") for x in ("active", "salt", "late", "holds", "c", "n")}).withColumn("a.b", F.col("id")).withColumn("Entries", F.lit(0))
    got = url_filter(captures, entries, share=share)
    assert {x.id: x.blocked for x in got.collect()} == {i: b for i, (_, _, b) in enumerate(cases)}
    assert all(x["a.b"] == x.id == x.active == x.c for x in got.collect()) and got.count() == len(cases)
    assert not any(x.blocked for x in url_filter(captures, entries.limit(0)).collect())
    assert url_filter(captures.limit(0), entries).count() == 0


# --- pipeline -----------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = rows(spark, [(90001, None), (90002, ""), (90003, "mail a@b.cc now")]).withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.lit(1).cast("long")})
    docs = docs.unionByName(odd)
    have = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        now = {r.doc_id: r.text for r in out.collect()}
        assert set(now) <= set(have) and {90001, 90002, 90003} <= set(now)
        if name == "near duplicates":
            sets = {d: shingles(t) for d, t in have.items()}
            gone = set(have) - set(now)
            assert gone and all(any(e < d and len(sets[d] & sets[e]) >= 0.5 * len(sets[d] | sets[e]) for e in have if sets[e]) for d in gone)
            left = [sets[d] for d in now if sets[d]]
            assert not any(len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(left) for b in left[:i])
        if name == "personal data":
            assert now[90003] == "mail <EMAIL> now"
            assert not any(base_spans(t) for t in now.values() if t)
        docs = spark.createDataFrame(out.collect(), out.schema)
        have = now
    assert {r.doc_id for r in p.pack(spark, docs, DATA).collect()} == set(have)


def test_entry_names():
    import __spark_entry__ as e

    names = e.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names} and "pipeline" in names
    assert set(e.oracle_sql()) <= set(names)
    assert json.dumps(sorted(names)) and sha("") == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


# --- 8, plain versions --------------------------------------------------------------------------


def test_noisy_or_and_gradient():
    """The noisy-or against a plain product, its gradient against differences of the loss, the calibration against a plain search."""
    from quarryline.llm.op8_toxicity import Model, best_threshold, calibration, fit, gradient, noisy_or

    r = np.random.default_rng(5)
    soff = np.array([0, 3, 3, 4, 9, 12])
    p, y = r.random(12), np.array([1, 0, 0, 1, 0])
    plain = [1 - np.prod(1 - p[a:b]) for a, b in zip(soff[:-1], soff[1:], strict=True)]
    assert noisy_or(p, soff) == pytest.approx(plain) and noisy_or(p[4:9], np.array([0, 5]))[0] == noisy_or(p, soff)[3]
    row, col = np.array([0, 0, 2, 3, 5, 5, 8, 11]), np.array([0, 1, 1, 2, 0, 2, 1, 2])
    w, bias, decay = r.normal(size=3), -1.0, 0.01

    def loss(v):
        z = v[3] + np.bincount(row, v[:3][col], 12)
        q = np.array([1 - np.prod(1 - 1 / (1 + np.exp(-z[a:b]))) for a, b in zip(soff[:-1], soff[1:], strict=True)])
        return -sum(np.log(q[d]) if y[d] else np.log(1 - q[d]) for d in range(5)) / 5 + 50 * decay * (v[:3] ** 2).sum() / 5

    at = np.append(w, bias)
    want = [(loss(at + e) - loss(at - e)) / 2e-5 for e in 1e-5 * np.eye(4)]
    assert gradient(w, bias, soff, row, col, y, decay) == pytest.approx(want, abs=1e-6)
    model = fit(np.arange(3, dtype=np.uint64), soff, row, col, y)
    assert loss(np.append(model.weights, model.bias)) < loss(np.append(np.zeros(3), -5.0))
    scores, labels = np.round(r.random(200), 2), r.integers(0, 2, 200)
    f1 = lambda t: 2 * labels[scores >= t].sum() / ((scores >= t).sum() + labels.sum())
    assert f1(best_threshold(scores, labels)) == pytest.approx(max(f1(t) for t in scores))
    m = Model(np.zeros(0, np.uint64), np.zeros(0), 0.0, 3.0)
    assert m.calibrated(np.array([0.0, 0.5, 1.0])).tolist() == [0.0, 0.75, 1.0]
    assert calibration(np.arange(3, dtype=np.uint64), soff, row, col, y, np.zeros(5, int)) == 1.0


def test_jaccard_null_and_repeated_ids(spark):
    """Rows are told apart by their keys: null ids and an id on several texts don't meet all rows of that id."""
    from quarryline.llm.op3_jaccard import jaccard_classes

    w = vocabulary(3, 60)
    near = [" ".join([*w[:40], f"x{i}", *w[40:]]) for i in range(40)]  # any two share 0.8 or less, but all are near copies of the plain one
    data = [(None, t) for t in near] + [(7, near[0]), (7, " ".join(w)), (7, "other words of its own entirely here"), (None, None)] + [(9, "again and again and again")] * 30
    got = jaccard_classes(rows(spark, data)).collect()
    assert len(got) == len(data)
    sets = {t: shingles(t) for _, t in data}
    links = lambda t: sum(1 for _, u in data if sets[t] and sets[u] and len(sets[t] & sets[u]) >= 0.8 * len(sets[t] | sets[u])) - 1
    assert sorted((x.doc_id or 0, x.n_links) for x in got) == sorted((d or 0, max(0, links(t))) for d, t in data)
    again = {(x.class_id, x.row_key == x.class_key, x.n_links) for x in got if x.doc_id == 9}
    assert again == {(9, True, 29)}


def test_pipeline_near_duplicates_by_row(spark):
    import corpus_pipeline as p

    docs = rows(spark, [(3, "a text of some words here"), (5, "a text of some words here"), (5, "another clean text with its words"), (6, ""), (6, ""), (8, "twice the same row of words"), (8, "twice the same row of words"), (None, "a text of some words here")])
    out = p.drop_near_duplicates(spark, docs, DATA)
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == [(3, "a text of some words here"), (5, "another clean text with its words"), (6, ""), (6, ""), (8, "twice the same row of words")]


@pytest.mark.parametrize("seed", range(8))
def test_packing_is_no_worse_than_best_fit(seed):
    """No more sequences than plain best fit in falling order, piece by piece."""
    from bisect import bisect_left, insort
    from collections import Counter

    from quarryline.llm.op2_pack import best_plan

    r = random.Random(seed)
    lengths = [min(2048, 1 + int(r.expovariate(1 / r.choice([50, 300, 900, 1500])))) for _ in range(r.choice([300, 4000]))]
    rooms, bins = [], 0
    for x in sorted(lengths, reverse=True):
        k = bisect_left(rooms, x)
        if k == len(rooms):
            bins += 1
            room = 2048
        else:
            room = rooms.pop(k)
        insort(rooms, room - x)
    plan = best_plan(dict(Counter(lengths)))
    used = Counter()
    for content, n in plan:
        assert sum(content) <= 2048
        for x in content:
            used[x] += n
    assert used == Counter(lengths) and sum(n for _, n in plan) <= bins


@pytest.mark.parametrize(("groups", "small"), [(512, 1 / 3), (8, 0.5), (1, 1.0), (512, 1.0)])
def test_packing_counts_full_pieces_once(groups, small):
    from quarryline.llm.op2_pack import pack_plan

    h = {2048: 1337, 2047: 3, 1024: 11, 700: 5, 1: 40}
    used = {}
    for content, n in pack_plan(h, groups=groups, small=small):
        for x in content:
            used[x] = used.get(x, 0) + n
    assert used == h


def test_packing_of_a_table_takes_as_few_sequences_as_its_ids_fill():
    """On sf0.1 the plan meets the bound that no packing can go below."""
    import pyarrow.parquet as pq

    from quarryline.llm.op2_pack import best_plan, encoder, tokenizer_path

    h = {}
    for x in encoder(tokenizer_path())([t or "" for t in pq.read_table("/root/testdata/sf0.1/documents.parquet")["text"].to_pylist()]):
        full, rest = divmod(len(x) // 4 + 1, 2048)
        h[2048] = h.get(2048, 0) + full
        h[rest] = h.get(rest, 0) + (rest > 0)
    h = {x: n for x, n in h.items() if x and n}
    assert sum(n for _, n in best_plan(h)) == -(-sum(x * n for x, n in h.items()) // 2048)


def test_licenses_and_packing_with_odd_columns(spark):
    """Names with backticks, dots and the results' own names; a very long text; rows that repeat; no rows."""
    from quarryline.llm.op2_pack import pack
    from quarryline.llm.op6_licenses import licenses

    data = [(1, "x " * 200_000 + "Released under the MIT License. " + "y " * 10), (2, None), (2, None)]
    df = rows(spark, data).withColumn("a`b.c", F.lit(5)).withColumn("Found", F.lit("clash")).withColumn("n_words", F.lit("clash"))
    got = licenses(df).collect()
    assert [[f.license for f in x.found] for x in got] == [["mit-line"], [], []] and all(x["a`b.c"] == 5 for x in got)
    assert licenses(df.limit(0)).count() == 0
    pieces = spark.createDataFrame([(1, 0, 0, 2000, 5), (1, 1, 2000, 48, 6), (None, 0, 0, 48, 7)], "doc_id long, piece int, start long, length long, ids_crc32 long").withColumn("a`b.c", F.lit(5))
    assert sorted((x.sequence_id, x.offset, x.length) for x in pack(pieces).collect())[:2] == [(0, 0, 2000), (0, 2000, 48)]


def test_odd_columns_pass_through(spark):
    """Names that operators use inside, names with dots and backticks, and the results' own names in other cases."""
    from quarryline.llm.op4_quality import quality
    from quarryline.llm.op4_quality import train as train_quality
    from quarryline.llm.op5_pii import personal_data
    from quarryline.llm.op7_passages import without_repeats
    from quarryline.llm.op9_decontaminate import contamination

    df = rows(spark, [(1, "some words a@b.cc here"), (2, None), (2, None)]).withColumn("a`b.c", F.lit(5))
    names = ["_email", "_key", "gone", "doc", "seeds", "id", "_m_card", "x", "_row_key", "w"]
    df = df.withColumns({n: F.lit(n) for n in names}).withColumns({"Base": F.lit(0), "SCORE": F.lit(0), "Kept": F.lit(0), "N_hit": F.lit(0)})
    bench = rows(spark, [(1, "some words")], "item_id long, text string")
    model = train_quality(rows(spark, []), rows(spark, [], "doc_id long, quality int"))
    for out in (personal_data(df), without_repeats(df), contamination(df, bench), quality(df, model)):
        got = out.collect()
        assert len(got) == 3 and all(r[n] == n for r in got for n in names) and all(r["a`b.c"] == 5 for r in got)


def test_pii_of_a_very_long_text(spark):
    import time

    from quarryline.llm.op5_pii import masked, personal_data

    text = " ".join(f"u{i}@mail.org" for i in range(100_000))
    begun = time.time()
    got = personal_data(rows(spark, [(1, text)])).select(F.size("base").alias("n"), F.length(masked(F.col("text"), F.col("spans"))).alias("m")).first()
    assert (got.n, got.m) == (100_000, 100_000 * 8 - 1) and time.time() - begun < 120


def test_pii_recall(spark):
    """Identifiers of other kinds, without digits, in the contexts that known kinds share: 0.9 of them or more are found, and ordinary words aren't."""
    from quarryline.llm.op5_pii import personal_data

    r, v = random.Random(11), vocabulary(12, 500)
    noise = lambda n: " ".join(r.choice(v) for _ in range(n))
    contexts = ["please contact me at {} today", "user = \"{}\" logged in", "reply to: {}", "my account {} was closed", "send it to <{}> soon", "signed up as {} yesterday", "the handle ({}) belongs to", "login: {} password"]
    seed = lambda i: r.choice([f"u{i}.x@mail.org", f"+1 (222) 333-{1000 + i}", f"10.0.{i % 250}.{i % 200}", f"n{i}@corp.example.com"])
    name = lambda: "".join(r.choice("klmnopqrst") for _ in range(9)) + r.choice(["", "_x", ".q"])
    data, want = [], {}
    for i in range(1200):
        known = i % 10 < 9  # a pattern that stands on one side alone is sure where 0.8 of its fillers are known
        x = seed(i) if known else name()
        data.append((i, f"{noise(r.randint(5, 60))} {r.choice(contexts).format(x)} {noise(r.randint(5, 60))}"))
        if not known:
            want[i] = x
    data += [(5000 + i, noise(80)) for i in range(300)]
    found = {x.doc_id: [x.text[s.s : s.e] for s in x.spans if s.k == 5] for x in personal_data(rows(spark, data)).collect()}
    hit = sum(found[i] == [x] for i, x in want.items())
    assert hit >= 0.9 * len(want)
    assert not any(found[i] for i in found if i >= 5000)


# --- 4, plain versions --------------------------------------------------------------------------


def test_gam_against_a_plain_one():
    """Scores by a loop over tables, the best cut by trying all, and boosting that lowers the loss."""
    from quarryline.llm.op4_quality import Gam, _cut, fit

    r = np.random.default_rng(2)
    x = r.normal(size=(400, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = fit(x, y, rounds=40)

    def plain(row):
        z = model.base
        bins = [sum(row[i] >= c for c in model.cuts[i]) for i in range(4)]
        z += sum(model.main[i][bins[i]] for i in range(4))
        z += sum(t[model.coarse[i][bins[i]]][model.coarse[j][bins[j]]] for i, j, t in model.pairs)
        return 1 / (1 + np.exp(-z))

    got = model.score(x)
    assert got == pytest.approx([plain(row) for row in x])
    flat = Gam(model.base, model.cuts, model.main, model.coarse, [])
    loss = lambda p: -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
    assert loss(got) < loss(flat.score(x)) < loss(np.full(400, y.mean())) + 1e-9  # the interaction is what tells here
    assert ((got > 0.5) == y).mean() > 0.9
    g, h = r.normal(size=9), r.random(9) + 0.1
    value = lambda a, b: g[a:b].sum() / (h[a:b].sum() + 2.0)
    worth = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 2.0)
    k = max(range(1, 9), key=lambda k: worth(0, k) + worth(k, 9))
    assert _cut(g, h, 2, 2.0) == pytest.approx([value(0, k)] * k + [value(k, 9)] * (9 - k))


def test_quality_of_repeated_rows(spark):
    """Equal rows score alike, and an id on several texts teaches once."""
    from quarryline.llm.labelled import training_rows
    from quarryline.llm.op4_quality import quality, train

    data = [(i, "plain words of a kind " * 5 if i % 2 else "JUNK!! | $$$ JUNK!! " * 5) for i in range(60)]
    labels = rows(spark, [(i, i % 2) for i in range(60)], "doc_id long, quality int")
    twice = data + data + [(1, "another text of that id")] * 3
    assert training_rows(rows(spark, twice), labels, "quality", F.lit(False), 50).count() == 50
    got = quality(rows(spark, twice), train(rows(spark, twice), labels)).collect()
    assert len(got) == len(twice) and len({(x.text, x.score) for x in got}) == len({x.text for x in got})


def test_pipeline_packing(spark):
    """The last stage against the tokenizer, document by document."""
    import corpus_pipeline as p
    from quarryline.llm.op2_pack import tokenizer_path
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    t = Tokenizer.from_file(tokenizer_path())
    want = []
    for d in docs.collect():
        ids = [*t.encode(d.text or "", add_special_tokens=False).ids, 0]
        want += [(d.doc_id, k, a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    got = p.pack(spark, docs, DATA).collect()
    assert sorted((g.doc_id, g.piece, g.start, g.length, g.ids_crc32) for g in got) == sorted(want)
    used = {}
    for g in sorted(got, key=lambda g: (g.sequence_id, g.offset)):
        assert g.offset == used.get(g.sequence_id, 0)
        used[g.sequence_id] = g.offset + g.length
    assert max(used.values()) <= 2048


def test_pii_query(spark):
    """The contract's columns against plain ones, over a whole table."""
    from quarryline.llm.op5_pii import KINDS, op5_pii

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = op5_pii(spark, DATA).collect()
    assert {x.doc_id for x in got} == set(texts)
    for x in got:
        want = base_spans(texts[x.doc_id])
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(s.startswith(k + ":") for s in want) for k in KINDS[:4]]
        assert x.base_sha256 == sha(",".join(want)) and set(want) <= set(x.spans.split(","))
