"""op11 to op13 against plain versions: nulls, empty and very long texts, ties, repeated rows, empty tables, names that clash."""

import random
import re

import pytest
from brute import fim, mixed, resampled, sha
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    r = random.Random(11)
    v = ["".join(r.choice("abcdefghiÄß日😀") for _ in range(r.randint(1, 7))) for _ in range(150)]
    text = lambda n: " ".join(r.choice(v) for _ in range(n))
    out = [(i, text(r.randint(1, 60)), r.choice(["a", "b", "b", "b", "b", "é", "Z", None])) for i in range(160)]
    out += [(200 + i, out[3][1], "b") for i in range(40)]  # copies
    out += [(300, None, "a"), (301, "", "b"), (302, " \n\x0b ", None), (303, None, "empty"), (304, text(30000), "long"), (305, "x" * 50000, "long"), (306, "tiny", "tiny"), (None, text(30), "b"), (None, None, None)]
    out += [(310, "same row " * 12, "c")] * 5 + [(311, "Upper CASE İ straße 10-20 " * 3, "c"), (311, "other text, one id", "c")]
    return out


def frame(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string, source string")
    return df.withColumn("Taken", F.lit("clash")).withColumn("weight", F.lit("clash")).withColumn("output", F.lit(1)).withColumn("a `b`.c", F.lit(7)).withColumn("_none", F.lit(8))


def key(x):
    return tuple((v is None, v) for v in x)


# --- 11 -----------------------------------------------------------------------------------------


@pytest.mark.parametrize(("broadcast", "share"), [(8 << 20, None), (0, 20)])
def test_mix(spark, texts, broadcast, share):
    from quarryline.llm.op11_mix import mix

    got = mix(frame(spark, texts), broadcast_bytes=broadcast, share=share)
    assert got.columns == ["doc_id", "text", "source", "weight", "output", "a `b`.c", "_none", "size", "source_size", "target", "taken"]
    want = mixed(texts)
    found = got.collect()
    assert len(found) == len(texts)
    for x in found:
        assert (x.size, x.source_size, x.target, x.taken) == want[x.doc_id, x.text, x.source], x.doc_id
        assert x.taken <= 3 * x.size


def test_mix_comes_near_its_targets(spark, texts):
    from quarryline.llm.op11_mix import mix

    by = {}
    for x in mix(frame(spark, texts).where("source in ('a', 'b', 'Z')")).collect():
        by.setdefault(x.source, []).append(x)
    for rows in by.values():
        assert abs(sum(x.taken for x in rows) - rows[0].target) <= max(x.size for x in rows)


def test_mix_of_few_hash_bits(spark, texts, monkeypatch):
    """All levels are gone through where hashes agree in their first bits."""
    from quarryline.llm import op11_mix

    same = lambda doc_id, text, seed: (F.lit((1 << 59) + (1 << 30)) + F.pmod(F.coalesce(doc_id, F.lit(0)), F.lit(7))).cast("long")
    monkeypatch.setattr(op11_mix, "hash_of", same)
    got = op11_mix.mix(frame(spark, [x for x in texts if x[2] == "b"] + [(1, "w " * 900, "d")])).where("source = 'b'").collect()
    assert {x.taken // x.size for x in got if x.size} <= {0, 1, 2, 3}
    assert len({(x.doc_id or 0) % 7 for x in got}) == 7
    for r in range(7):  # one fate for one hash
        assert len({x.taken // x.size for x in got if x.size and (x.doc_id or 0) % 7 == r}) == 1


def test_mix_of_nothing(spark, texts):
    from quarryline.llm.op11_mix import mix

    assert mix(frame(spark, texts).limit(0)).count() == 0
    empty = mix(spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")).collect()
    assert {(x.size, x.target, x.taken) for x in empty} == {(0, 0.0, 0)}


def test_mix_reruns_agree(spark):
    from quarryline.llm.queries import QUERIES

    runs = [sorted(map(tuple, QUERIES["op11_mix"](spark, DATA).repartition(n).collect())) for n in (1, 5)]
    assert runs[0] == runs[1]
    docs = [tuple(x) for x in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "source").collect()]
    assert {r[0]: r[1:] for r in runs[0]} == {k[0]: v for k, v in mixed(docs).items()}


def test_numbered(spark):
    from quarryline.llm.shared import numbered, written

    df = written(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), F.when(F.col("id") % 10 == 0, F.lit("x")).alias("at"), F.lit(1).alias("_n")), "t")
    assert {(x.v, x.place) for x in numbered(df, [F.col("v").desc()], "place").collect()} == {(v, 1000 - v) for v in range(1000)}
    assert numbered(df.limit(0), [F.col("v")], "place").count() == 0


# --- 12 -----------------------------------------------------------------------------------------


def test_fim(spark, texts):
    from quarryline.llm.op12_fim import fill_in_middle, restored

    odd = [(400 + i, x, "s") for i, x in enumerate(["<P>", "a <M> b", "<S", "<P" * 30, "M>" * 30, "<", ">", "é́" * 50, "👩‍👩‍👧" * 40, "<S<P<M>>>", "\r\n" * 9]) for _ in range(2)]
    df = frame(spark, texts + odd)
    made = fill_in_middle(df)
    assert made.columns == ["doc_id", "source", "Taken", "weight", "a `b`.c", "_none", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = sorted(((x.doc_id, x.n, x.form, x.prefix_chars, x.middle_chars, x.output) for x in made.collect()), key=key)
    assert got == sorted(((d, *fim(d, t)) for d, t, _ in texts + odd), key=key)
    back = restored(made).select("doc_id", "restored").collect()
    assert sorted(map(tuple, back), key=key) == sorted(((d, t or "") for d, t, _ in texts + odd), key=key)
    assert {x[2] for x in got} == {"plain", "psm", "spm"}
    assert fill_in_middle(df.limit(0)).count() == 0


@pytest.mark.parametrize("leaf", [1, 2, 3, 7, 4096])
@pytest.mark.parametrize("unit", [None, r"\s*\S+", r"[0-9]"])
def test_rope(leaf, unit):
    from quarryline.llm.op12_fim import Rope, inverted, rearranged

    r = random.Random(leaf)
    pattern = re.compile(unit) if unit else None
    for text in ["", "a", "1", "one two\n three ", "x1y22z", "日本 語 1😀", "".join(r.choice("ab 1é\n") for _ in range(200))]:
        ends = list(range(1, len(text) + 1)) if unit is None else [m.end() for m in pattern.finditer(text)]
        if text:
            ends = [*ends[:-1], len(text)]
        rope = Rope.of(text, pattern, leaf)
        assert (rope.units, rope.chars, str(rope)) == (len(ends), len(text), text)
        cuts = [0, *ends]
        for rank in range(rope.units + 1):
            a, b = rope.split(rank)
            assert (str(a), str(b)) == (text[: cuts[rank]], text[cuts[rank] :])
            assert (a.units, a.chars, b.units, b.chars) == (rank, cuts[rank], rope.units - rank, len(text) - cuts[rank])
        for _ in range(20):
            first, second = sorted(r.randint(0, rope.units) for _ in range(2))
            for form in ("psm", "spm"):
                made, p, m = rearranged(rope, form, first, second)
                assert (p, m) == (cuts[first], cuts[second] - cuts[first])
                assert inverted(str(made), form) == text


def test_rope_is_balanced_and_shared():
    from quarryline.llm.op12_fim import Rope

    depth = lambda x: 0 if x.left is None else 1 + max(depth(x.left), depth(x.right))
    rope = Rope.of("abc" * 200000, leaf=64)
    assert depth(rope) <= 14
    a, b = rope.split(123457)
    assert depth(a) <= 15 and depth(b) <= 15
    ours, theirs = {id(x) for x in _nodes(rope)}, [x for x in (*_nodes(a), *_nodes(b)) if x.left is None]
    assert sum(id(x) not in ours for x in theirs) <= 2  # the halves of one leaf


def _nodes(x):
    return [x] if x.left is None else [x, *_nodes(x.left), *_nodes(x.right)]


def test_fim_by_words(spark, texts):
    from quarryline.llm.op12_fim import fill_in_middle, restored

    made = fill_in_middle(frame(spark, texts), unit=r"\s*\S+", sentinels=("", "", ""))
    for x in restored(made, sentinels=("", "", "")).withColumn("output", F.lit("")).join(frame(spark, texts).select("doc_id", "text").distinct(), "doc_id").where("doc_id <> 311").collect():
        assert x.restored == (x.text or "")
        assert x.n == (len((x.text or "").split()) or int(bool(x.text)))


def test_fim_query(spark):
    from quarryline.llm.queries import QUERIES

    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    want = {d: (*(f := fim(d, t))[:4], sha(f[4]), sha(t or "")) for d, t in docs}
    assert {x[0]: tuple(x[1:]) for x in QUERIES["op12_fim"](spark, DATA).collect()} == want


# --- 13 -----------------------------------------------------------------------------------------


@pytest.mark.parametrize(("low", "high", "buckets"), [(1, 1, 10000), (1, 3, 500), (2, 2, 64), (3, 4, 64)])
def test_resample(spark, texts, low, high, buckets):
    from quarryline.llm.op13_resample import resample

    aim = [texts[3][1], texts[5][1] + " extra 7 words", None, "", texts[311 % len(texts)][1]]
    target = spark.createDataFrame([(x,) for x in aim], "text string")
    got = resample(frame(spark, texts), target, low, high, buckets, keep=["doc_id", "text", "Taken", "weight"])
    assert got.columns == ["doc_id", "text", "Taken", "n_features", "weight", "score", "rank"]
    rows = [(d, t) for d, t, _ in texts]
    want = resampled(rows, aim, low, high, buckets)
    assert sorted(((x.doc_id, x.text, x.n_features, x.weight, x.score) for x in got.collect()), key=key) == sorted((x[:5] for x in want), key=key)
    drawn = sorted((x.rank, x.doc_id, x.score) for x in got.where("rank is not null").collect())
    assert drawn == [(x[5], x[0], x[4]) for x in want if x[5]]
    assert resample(frame(spark, texts).limit(0), target, low, high, buckets).count() == 0
    assert resample(frame(spark, texts), target.limit(0), low, high, buckets).count() == len(texts)


def test_resample_hashes_a_tuple_once(monkeypatch):
    """Counts per text and bucket are those of a plain loop, and each distinct tuple is hashed once."""
    import zlib

    import numpy as np
    import pyarrow as pa

    from quarryline.llm import op13_resample as m

    seen = []
    monkeypatch.setattr(m, "zlib", type("Z", (), {"crc32": staticmethod(lambda x: seen.append(x) or zlib.crc32(x))}))
    column = pa.array(["a b a b", None, "", "B a-b", "é a"])
    off, bucket, times, length, total = m.counted(column, 1, 2, 50)
    assert sorted(seen) == sorted([b"a", b"b", "é".encode(), b"a b", b"b a", "é a".encode()])
    assert (length.tolist(), total.tolist()) == ([4, 0, 0, 3, 2], [7, 0, 0, 5, 3])
    for i, grams in enumerate([["a", "b", "a", "b", "a b", "b a", "a b"], [], [], ["b", "a", "b", "b a", "a b"], ["é", "a", "é a"]]):
        want = np.bincount([zlib.crc32(g.encode()) % 50 for g in grams], minlength=50)
        have = np.zeros(50, int)
        have[bucket[off[i] : off[i + 1]]] = times[off[i] : off[i + 1]]
        assert have.tolist() == want.tolist()


def test_resample_query(spark):
    from quarryline.llm.queries import QUERIES

    docs = [tuple(x) for x in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    aim = [x.text for x in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    want = {x[0]: x[2:] for x in resampled(docs, aim)}
    assert {x[0]: tuple(x[1:]) for x in QUERIES["op13_resample"](spark, DATA).collect()} == want
