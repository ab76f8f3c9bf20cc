"""The inverted file: recall against exact search, exhaustive probing equal to it, odd vectors, reading only what is probed."""

import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.operators import ann as N
from quarryline.operators.search import vector_top

DATA = "/root/testdata/sf0.1"


def plain(rows, queries, k=10):
    """{(query_id, rank): (chunk_id, score)} by brute force."""
    ids = np.array([i for i, _ in rows])
    m = np.array([v for _, v in rows], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    out = {}
    for qid, v in queries:
        s = np.round(m @ (np.array(v, float) / np.linalg.norm(v)), 6)
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != qid][:k]
        out |= {(qid, n + 1): (int(ids[i]), round(float(s[i]), 6)) for n, i in enumerate(order)}
    return out


def folder():
    return "file://" + tempfile.mkdtemp(prefix="ann-")


def test_recall_and_exhaustive_probing(spark):
    v = spark.read.parquet(f"{DATA}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")
    index = N.write_index(v, folder(), 64)
    rows = [(r.chunk_id, r.embedding) for r in v.collect()]
    asked = v.where("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id")
    want = plain(rows, [(i, e) for i, e in rows if i % 100 == 0])
    best = {}
    for (q, _), (i, _) in want.items():
        best.setdefault(q, set()).add(i)
    got = {}
    for r in N.search_all(spark, index, asked, query_bytes=1 << 12).collect():
        got.setdefault(r.query_id, set()).add(r.chunk_id)
    recall = np.mean([len(best[q] & got.get(q, set())) / len(best[q]) for q in best])
    assert recall >= 0.9 and index.probes < len(index.centroids)
    every = N.search_all(spark, index, asked, probes=len(index.centroids))
    assert {(r.query_id, r.rank): (r.chunk_id, round(r.score, 6)) for r in every.collect()} == want


def test_probing_reads_only_its_lists(spark):
    r = np.random.default_rng(2)
    middle = r.normal(size=(20, 16)) * 10
    rows = [(i, [float(x) for x in middle[i % 20] + r.normal(size=16) * 0.3]) for i in range(4000)]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<float>").withColumn("doc_id", F.col("chunk_id") % 7)
    index = N.write_index(df, folder(), 16, lists=20, sample_rows=500)
    assert N.open_index(spark, index.path).probes == index.probes <= 4
    got = N.search(spark, index, rows[5][1], 20)
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "list#" in plan.split("PartitionFilters: [")[1][:200]
    read = N.read_lists(spark, index, index.nearest(rows[5][1])).count()
    assert read < len(rows) * (index.probes + 1) / 10
    exact = vector_top(df, rows[5][1], 20)
    found, best = ({(x.chunk_id, x.doc_id, x.score) for x in y.collect()} for y in (got, exact))
    assert len(found & best) >= 18 and [x.rank for x in got.orderBy("rank").collect()] == list(range(1, 21))


def test_lists_split_over_files_and_cover_every_row(spark):
    """A third of all rows are one vector: they share a list, and come back whole."""
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else [float((i * 7 + j * j) % 11 + 1) for j in range(3)]) for i in range(900)]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    index = N.write_index(df, folder(), 3, lists=8)
    back = spark.read.parquet(f"{index.path}/lists")
    assert sorted(x.chunk_id for x in back.collect()) == list(range(900))
    got = N.search_all(spark, index, df.where("chunk_id = 3").withColumnRenamed("chunk_id", "query_id"), 5)
    assert [(x.rank, x.chunk_id, x.score) for x in got.orderBy("rank").collect()] == [(k + 1, i, 1.0) for k, i in enumerate([0, 6, 9, 12, 15])]


@pytest.mark.parametrize("some", [True, False])
def test_odd_vectors(spark, some):
    odd = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, float("inf")]), (6, [1.0, None]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    good = [(10, [1.0, 0.0]), (11, [1.0, 0.1]), (11, [1.0, 0.1])] if some else []
    df = spark.createDataFrame(odd + good, "chunk_id long, embedding array<double>")
    index = N.write_index(df, folder(), 2)
    got = N.search_all(spark, index, df.withColumnRenamed("chunk_id", "query_id")).collect()
    # a repeated row is a neighbour each time; a query without an id is its own
    assert sorted((x.query_id, x.chunk_id) for x in got) == ([(10, 11), (10, 11), (11, 10), (11, 10)] if some else [])
    assert N.search(spark, index, [1.0, 0.0] if some else [0.0, 0.0]).count() == (3 if some else 0)


def test_kept_index_follows_the_table(spark):
    from quarryline.sources.kept import kept

    path, built = folder(), []
    spark.range(3).write.parquet(f"{path}/t.parquet")
    ask = lambda: kept(spark, "test", f"{path}/t.parquet", built.append)
    assert ask() == ask() and len(built) == 1
    spark.range(4).write.mode("append").parquet(f"{path}/t.parquet")
    assert ask() == built[1] and ask() == built[1] != built[0]
