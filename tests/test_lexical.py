"""The maintained lexical index against one built anew, and trigram search against a full scan."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from quarryline.functions import text as X
from quarryline.operators import lexical as L
from quarryline.operators.search import bm25_scores

DDL = "chunk_id long, doc_id string, text string"


def folder():
    return "file://" + tempfile.mkdtemp(prefix="lex-")


def test_changes_score_as_an_index_built_anew(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(12)]
    text = lambda: " ".join(r.choice(words) for _ in range(r.randint(0, 15)))
    now = {i: (f"d{i % 5}", text()) for i in range(40)} | {90: ("odd", None), 91: ("odd", "")}
    path = folder()
    rows = lambda ids: spark.createDataFrame([(i, *now[i]) for i in ids], DDL)
    L.create(rows(now), path)

    def same():
        want = {(x.chunk_id, x.doc_id): x.score for x in bm25_scores(rows(now).withColumn("text", F.coalesce("text", F.lit(""))), ["w1", "W3".lower(), "w7", "absent"]).collect()}
        got = {(x.chunk_id, x.doc_id): x.score for x in L.scores(spark, path, ["w1", "w3", "w7", "absent"]).collect()}
        assert got == want and got

    same()
    for step in range(4):
        gone = r.sample(sorted(now), 6)
        new = {i: (f"d{step}", text()) for i in [*r.sample(sorted(now), 5), 100 + step, 200 + step, gone[0]]}
        for i in gone:
            now.pop(i, None)
        now |= new
        ids = spark.createDataFrame([(i,) for i in [*gone, 7777, None]], "chunk_id long")
        L.change(spark, path, rows(new).unionByName(rows(list(new)[:2])), ids)  # rows that come twice count once
        if step == 2:
            L.compact(spark, path)
            L.vacuum(spark, path)
        if step != 1:
            same()
    L.change(spark, path, None, spark.createDataFrame([(i,) for i in list(now)[:3]], "chunk_id long"))
    for i in list(now)[:3]:
        del now[i]
    L.change(spark, path)  # nothing
    same()
    L.change(spark, path, None, spark.createDataFrame([(i,) for i in now], "chunk_id long"))
    assert L.scores(spark, path, ["w1"]).count() == 0 and L.corpus(spark, path).first().n == 0


def test_a_reader_keeps_its_generations(spark):
    path = folder()
    L.create(spark.createDataFrame([(1, "a", "x y"), (2, "a", "x")], DDL), path)
    before = L.live_postings(spark, path, ["x"])
    L.change(spark, path, None, spark.createDataFrame([(1,)], "chunk_id long"))
    assert before.count() == 2 and L.live_postings(spark, path, ["x"]).count() == 1


@pytest.fixture(scope="module")
def names():
    r = random.Random(9)
    base = ["small ring", "large ring", "blue widget", "red widget", "tiny gear", "Ärger im Büro", "", "a", "ab"]
    out = [(i, r.choice(base) + r.choice(["", "", " x", f" {r.randint(0, 30)}", "s"])) for i in range(300)]
    return [*out, (1000, None), (None, "small ring"), (1001, "ring " * 400)]


@pytest.mark.parametrize("limit", [0.1, 0.3, 0.5, 0.75, 1.0])
def test_trigrams_equal_the_full_scan(spark, names, limit):
    df = spark.createDataFrame(names, "id long, text string")
    path = folder()
    L.trigram_index(df, path)
    q = spark.createDataFrame([(1, "small rings"), (2, "a"), (3, ""), (4, "ärger"), (5, None), (6, "zzz qqq"), (7, "red widget 7")], "query_id long, text string")
    both = df.where("id is not null and text is not null").crossJoin(q.where("text is not null").withColumnRenamed("text", "q"))
    full = both.withColumn("s", X.trigram_similarity(F.col("text"), F.col("q"))).where(F.col("s") >= limit)
    want = sorted((x.query_id, x.id, round(x.s, 6)) for x in full.collect())
    assert sorted(map(tuple, L.trigram_matches(spark, path, q, limit).collect())) == want and want
    assert sorted(map(tuple, L.trigram_search(spark, path, "small rings", limit).collect())) == [x[1:] for x in want if x[0] == 1]
    assert L.trigram_matches(spark, path, q.limit(0), limit).count() == 0


def test_trigram_search_reads_few_postings(spark, names):
    """The scan's filter names the query's rarest trigrams and the sizes that can reach the limit."""
    path = folder()
    L.trigram_index(spark.createDataFrame(names, "id long, text string"), path)
    every = spark.read.parquet(f"{path}/postings").count()
    got = L.trigram_search(spark, path, "small rings", 0.75)
    plan = got._jdf.queryExecution().toString()
    assert any("In(gram" in x[:300] and "GreaterThanOrEqual(size" in x[:300] for x in plan.split("PushedFilters"))
    rare = [g for g in ("gs ", "ngs") if g in plan]
    read = spark.read.parquet(f"{path}/postings").where(F.col("gram").isin(rare) & F.col("size").between(8, 14)).count()
    assert rare and read < every / 20


def test_trigram_index_of_nothing(spark):
    path = folder()
    L.trigram_index(spark.createDataFrame([], "id long, text string"), path)
    assert L.trigram_search(spark, path, "x", 0.5).count() == 0
