"""Faults that showed at other sizes than those of the test data."""

import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from quarryline.operators import analytics as A
from quarryline.operators import extract as E
from quarryline.operators import lexical as L
from quarryline.operators import search as S
from quarryline.plans import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


def test_long_url_list(spark):  # F3
    """A list of 3,000 lines takes no square of its length."""
    lines = [x for i in range(1000) for x in (f"## S{i}", f"- http://x/{i % 900} | a, b | aka: Z", "* no")]
    df = spark.createDataFrame([("\n".join(lines),), ("",), ("- |x\n## y",), (None,)], "c string")
    start = time.perf_counter()
    got = [x.p for x in df.select(E.url_list_problems(F.col("c")).alias("p")).collect()]
    assert got[:3] == [["Found 100 duplicate URLs", "Large batch detected: 1000"], ["URL list is empty"], ["No valid URLs found in the list"]]
    assert time.perf_counter() - start < 20
    items = df.limit(1).select(E.url_items(F.col("c")).alias("u")).first().u
    assert [(x.url, x.section, x.key_terms, x.also_known_as) for x in items] == [(f"http://x/{i % 900}", f"S{i}", ["a", "b"], "Z") for i in range(1000)]


def plain_windows(html, most, header):
    """The windows by splitting, in code points."""
    if len(html) <= most:
        return [html]
    a, d = html.find('itemprop="abstract"'), html.find('itemprop="description"')
    m = re.search(r'(?i)<section[^>]*itemprop="claims"', html)
    c, head, out = m.start() if m else -1, html[:header], []
    out.append(html[: max(d if d > 0 else c, 0)] if a > 0 else head)
    t = html[d:c] if d > 0 and c > 0 else ""
    if len(t) > most:
        starts = [m.start() for m in re.finditer(r"(?i)(?=<heading[^>]*>[^<]+</heading>)", t) if m.start()]
        parts, groups, group = [t[i:j] for i, j in zip([0, *starts], starts, strict=False)], [], ""
        for p in parts:
            if len(group) + len(p) > most:
                groups, group = [*groups, group], p
            else:
                group += p
        out += [head + g for g in [*groups, *([group] if group else [])]]
    elif t:
        out.append(head + t)
    return out + ([head + html[c:]] if c > 0 else [])


@pytest.mark.parametrize("seed", range(3))
def test_windows_equal_a_split(spark, seed):  # F2
    """Also with characters beyond 16 bits before and between, headings of any case, and a first part that is too long."""
    import random

    r = random.Random(seed)
    pages = []
    for k in range(40):
        parts = [r.choice(["<heading>A</heading>", '<HEADING id="1">\U0001f600b</HEADING>', "<heading></heading>", ""]) + r.choice(["x", "é", "\U0001f600", "a\U0001f600"]) * r.randint(0, 60 if k % 4 else 300) for _ in range(r.randint(0, 14))]
        pages.append(r.choice(["", "\U0001f600"]) + '<section itemprop="abstract">' + r.choice(["", "\U0001f600 y"]) + '<section itemprop="description">' + "".join(parts) + r.choice(['<Section x itemprop="CLAIMS">', ""]) + "z" * r.randint(0, 80))
    df = spark.createDataFrame(list(enumerate(pages)), "i long, h string")
    got = {x.i: x.w for x in df.select("i", E.html_windows(F.col("h"), 200, 30).alias("w")).collect()}
    assert got == {i: plain_windows(p, 200, 30) for i, p in enumerate(pages)}
def compared(spark, name, folder, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    got = QUERIES[name](spark, str(folder))
    columns = ", ".join(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(f"SELECT {columns} FROM ({SQL[name]})").fetchall())


def test_routing_of_large_ids(spark, tmp_path):  # F5
    spark.read.parquet(f"{DATA}/pages.parquet").withColumn("page_id", F.col("page_id") + 89_990).write.parquet(str(tmp_path / "pages.parquet"))
    compared(spark, "url_routing", tmp_path, ["pages"])


def test_means_add_in_order_of_messages(spark):  # F4
    """Equal whatever the partitions; means of floats differ with their order."""
    ws = [0.1, 0.7, 0.2, 0.97, 0.03, 0.33, 0.61]
    total = 0.0
    for w in ws:
        total += w
    rows = [(c, c * 100 + i, w) for c in range(30) for i, w in enumerate([*ws, None])]
    none = spark.createDataFrame([], "message_id long, document_id long")
    for order in (F.col("message_id"), F.desc("message_id"), F.hash("message_id")):
        df = spark.createDataFrame(rows, "conversation_id long, message_id long, rag_weight double").coalesce(1).sortWithinPartitions(order)
        assert {x.avg_weight for x in A.conversation_weights(df, none).collect()} == {total / len(ws)}
    assert A.conversation_weights(spark.createDataFrame([(1, 1, None)], "conversation_id long, message_id long, rag_weight double"), none).first().avg_weight is None


def test_words_are_counted_in_their_rows(spark, tmp_path, monkeypatch):  # F7, F8
    """Tasks that sort postings grow in number with the index."""
    rows = [(1, "a", "b a b B"), (2, "a", ""), (3, "b", None), (4, "b", "\U0001f600 é é x")]
    words = S.counted_words(spark.createDataFrame(rows, "chunk_id long, doc_id string, text string"))
    got = {(x.term, x.chunk_id, x.tf, x.len) for x in S.postings(words).collect()}
    assert {x for x in got if x[1] == 1} == {("a", 1, 1, 4), ("b", 1, 3, 4)} and not any(x[1] in (2, 3) for x in got)
    monkeypatch.setattr(S, "POSTINGS_A_TASK", 10)
    many = spark.range(100).selectExpr("id as chunk_id", "'d' as doc_id", "concat('w', id, ' the the') as text")
    S.lexical_index(many, str(tmp_path / "index"))
    files = list((tmp_path / "index" / "postings").glob("*.parquet"))
    assert len(files) > 10 and spark.read.parquet(str(tmp_path / "index" / "postings")).where("term = 'the' and tf = 2").count() == 100


def test_index_shuffles_no_texts(spark, tmp_path):  # F9
    """Chunks that come twice, null ids too, count once, and texts of others aren't shuffled for it."""
    df = spark.createDataFrame([(1, "a", "x y"), (2, "a", "x"), (2, "b", "x x z"), (None, "c", "x"), (None, "c", "x")], "chunk_id long, doc_id string, text string")
    L.create(df, str(tmp_path / "index"))
    assert L.corpus(spark, str(tmp_path / "index")).first().n == 3
    assert L.live_postings(spark, str(tmp_path / "index"), ["x"]).count() == 3
    once = L._one_each(S.counted_words(df.where("chunk_id = 1")))
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString()


def test_pairs_are_compared_once(spark, tmp_path):  # F6
    """No shuffle of candidates: rows meet queries in one join, and sets are compared behind the signatures' condition."""
    L.trigram_index(spark.range(300).selectExpr("id", "concat('http://a.example.com/', id) as text"), str(tmp_path / "index"))
    asked = spark.range(3).selectExpr("id as query_id", "concat('http://a.example.com/', id) as text")
    got = L.trigram_matches(spark, str(tmp_path / "index"), asked, 0.45)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Aggregate" not in plan
    assert plan.index("bit_count") < plan.index("array_intersect", plan.index("Join"))
    assert got.count() == 900


def test_waiting_pieces_go_in_blocks():  # F1
    """A text in pieces of any order takes a few state calls a micro-batch, not some for each piece."""
    import random

    from quarryline.streaming import rewrite as R
    from test_streams import State, whole

    r = random.Random(3)
    text = "".join(r.choice(["\\(", "\\)", "\\[", "\\]", "x", " y"]) for _ in range(2000))
    pieces = [(i, text[3 * i : 3 * i + 3], 3 * i + 3 >= len(text)) for i in range(-(-len(text) // 3))]
    pieces += r.sample(pieces[:-1], 50)  # some come twice
    r.shuffle(pieces)
    state, rewriter, calls = State(), R.Rewriter(R.MATH, None, frames=False), []
    put = state.updateValue
    state.updateValue = lambda k, v: (calls.append(k), put(k, v))
    rewriter.init(state)
    out = [x.text for k in range(3) for x in rewriter.handleInputRows((1,), iter([(1, *p) for p in pieces[k::3]]), state)]
    assert "".join(out) == whole(text) and not state.map and not state.exists()
    assert 0 < len(calls) < len(pieces) / 10


def test_replays_write_on_all_cores(spark, tmp_path):  # F10, F11
    """A replay has as many micro-batches as it is asked for, each of several files; one without a number."""
    from quarryline.streaming import progress as P

    rows = spark.range(400).selectExpr("id % 7 as job_id", "timestamp_micros(id) as ts", "'pending' as status", "1.0D as current", "2.0D as total", "'m' as message")
    for files, folder in ((2, "two"), (None, "one")):
        log = P.replayed(rows, f"file://{tmp_path / folder}", P.tracked, files)
        assert len(list((tmp_path / folder / "in").glob("*.parquet"))) > (files or 1)
        assert {x.version for x in log.collect()} == set(range(1, (files or 1) + 1))
        assert {x.updated_at for x in P.view(log).collect()} == set(range(393, 400))
