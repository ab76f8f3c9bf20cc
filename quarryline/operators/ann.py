"""Approximate nearest neighbours: an inverted file of vectors (V10).

Centroids come from spherical k-means over a bounded sample, one Spark job a round. Every vector is
written to the list of its nearest centroid, a partition of the table; a list that outgrows a file is
dealt over several. A search reads the lists of the query's `probes` nearest centroids alone, which
partition pruning keeps from ever opening the others, and ranks what they hold by exact cosine.

How many lists have to be probed for a wanted recall depends on the data, so it is measured: a few
sample rows are searched for in the sample, exactly and by lists, and the least number of probes that
finds the wanted share is kept. In the whole table neighbours are nearer than in the sample, so recall
there is that or better.

Vectors that are null, of another length, all zero, not finite or without a chunk_id are not indexed, and as queries find nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import vectors as V
from ..sources.scratch import written
from .search import SCORE_DIGITS, ranked

#: Rows that centroids are fitted on and probes measured with, at most; sample queries; bytes of queries that a task holds at once.
SAMPLE, TRIALS, QUERY_BYTES = 50_000, 256, 8 << 20


class InvertedFile(NamedTuple):
    path: str
    centroids: np.ndarray
    probes: int

    def nearest(self, vector: list[float], probes: int | None = None) -> list[int]:
        """The lists to read for a query, nearest first."""
        return np.argsort(-(self.centroids @ np.asarray(vector, float)), kind="stable")[: probes or self.probes].tolist()


def usable(embedding: str, dims: int):
    """Not null, of that length, finite, and not all zero."""
    return F.coalesce(V.is_valid(F.col(embedding), dims) & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _units(column: pa.Array, dims: int) -> np.ndarray:
    v = np.asarray(column.flatten()).astype(float).reshape(-1, dims)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _rounds(sample: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """Lloyd's rounds: each task sums its rows by nearest centroid, so a task returns a row for each list at most."""
    for _ in range(rounds):
        here = sample.sparkSession.sparkContext.broadcast(centroids)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = here.value  # noqa: B023
            total, count = np.zeros_like(c), np.zeros(len(c), np.int64)
            for b in batches:
                v = _units(b.column(0), c.shape[1])
                at = (v @ c.T).argmax(1)
                np.add.at(total, at, v)
                count += np.bincount(at, minlength=len(c))
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(list(total[some]), pa.list_(pa.float64()))], names=["list", "total"])

        new = centroids.copy()
        for r in sample.mapInArrow(sums, "list long, total array<double>").groupBy("list").agg(F.array(*(F.sum(F.get("total", F.lit(i))) for i in range(centroids.shape[1]))).alias("total")).collect():  # a row for each list
            norm = np.linalg.norm(r.total)
            if norm > 0:
                new[r.list] = np.array(r.total) / norm
        here.unpersist()
        if np.allclose(new, centroids):
            break
        centroids = new
    return centroids


def _kept(at: np.ndarray, ids: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Which rows are among the `most` best of their query; ties to the smaller id."""
    order = np.lexsort((ids, -score, at))
    first = np.flatnonzero(np.concatenate([[True], np.diff(at[order]) != 0])) if len(at) else np.zeros(0, np.int64)
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    return order[place < most]


def _matches(rows: DataFrame, dims: int, queries: list[tuple], lists: list[list[int]] | None, most: int, threshold: float) -> DataFrame:
    """(query_id, chunk_id, score, list): for each task the best rows of each query. rows: (chunk_id, embedding, list), read once; lists: those that each query may look into."""
    q = np.array([v for _, v in queries], float)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    asks: dict[int, list[int]] = {}
    for i, mine in enumerate(lists or []):
        for x in mine:
            asks.setdefault(x, []).append(i)
    shared = rows.sparkSession.sparkContext.broadcast((q, {x: np.array(i) for x, i in asks.items()} if lists is not None else None))

    kind = to_arrow_type(rows.schema["chunk_id"].dataType)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, asks = shared.value
        have = None  # (query, chunk_id, score, list)
        for b in batches:
            v, lists_, chunk = _units(b.column(1), dims), np.asarray(b.column(2)), b.column(0).to_numpy(zero_copy_only=False)
            have = have or (np.zeros(0, np.int64), chunk[:0], np.zeros(0), lists_[:0])
            for x in np.unique(lists_) if asks is not None else [None]:
                mine = np.arange(len(q)) if x is None else asks.get(int(x), np.zeros(0, np.int64))
                here = np.arange(len(v)) if x is None else np.flatnonzero(lists_ == x)
                if not len(mine) or not len(here):
                    continue
                s = np.round(v[here] @ q[mine].T, SCORE_DIGITS)
                least = np.partition(s, len(here) - most, axis=0)[len(here) - most] if len(here) > most else np.full(len(mine), threshold)
                r, c = np.nonzero(s >= np.maximum(least, threshold))  # each query's `most` best here, and what ties with them
                every = [np.concatenate(p) for p in zip(have, (mine[c], chunk[here[r]], s[r, c], lists_[here[r]]), strict=True)]
                keep = _kept(*every[:3], most)
                have = tuple(p[keep] for p in every)
        if have is not None:
            yield pa.RecordBatch.from_arrays([pa.array(have[0], pa.int64()), pa.array(have[1], kind), pa.array(have[2], pa.float64()), pa.array(have[3], pa.int32())], names=["query", "chunk_id", "score", "list"])

    schema = T.StructType([T.StructField("query", T.LongType()), rows.schema["chunk_id"], T.StructField("score", T.DoubleType()), T.StructField("list", T.IntegerType())])
    return rows.select("chunk_id", "embedding", "list").mapInArrow(score, schema)


def _measured(sample: DataFrame, centroids: np.ndarray, dims: int, recall: float, k: int, trials: int) -> int:
    """The least number of probes that finds the wanted share of the k nearest sample rows of each of `trials` of them."""
    asked = [(r.chunk_id, r.embedding) for r in sample.orderBy("_h").limit(trials).select("chunk_id", "embedding").collect()]
    if not asked:
        return 1
    found = _matches(sample, dims, asked, None, k + 1, -1.0)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "chunk_id")
    best = found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1).select("query", "chunk_id", "list").collect()  # trials * (k + 1) rows
    q = np.array([v for _, v in asked], float)
    place = np.argsort(np.argsort(-(q @ centroids.T), axis=1, kind="stable"), axis=1, kind="stable")
    needed = sorted(int(place[r.query, r.list]) + 1 for r in best if r.chunk_id != asked[r.query][0])
    return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))] if needed else 1


def _assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vectors with list, the nearest centroid."""
    here = vectors.sparkSession.sparkContext.broadcast(centroids)
    names = [*vectors.columns, "list"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = (_units(b.column("embedding"), here.value.shape[1]) @ here.value.T).argmax(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32())], names=names)

    return vectors.mapInArrow(assign, T.StructType([*vectors.schema.fields, T.StructField("list", T.IntegerType())]))


def write_index(vectors: DataFrame, path: str, dims: int, lists: int | None = None, recall: float = 0.95, k: int = 10, sample_rows: int = SAMPLE, trials: int = TRIALS, rounds: int = 8) -> InvertedFile:
    """Index vectors (chunk_id, embedding and any more) under path. lists: by default the square root of their number, 4,096 at most.

    recall: the share of the k nearest that the kept number of probes has to find in the sample of sample_rows rows.
    """
    spark = vectors.sparkSession
    good = vectors.where(usable("embedding", dims) & F.col("chunk_id").isNotNull())
    n = good.count()
    lists = max(1, min(lists or min(4096, round(n**0.5)), n or 1))
    keyed = good.select("chunk_id", "embedding", F.xxhash64("chunk_id", "embedding").alias("_h"))
    sample = written(keyed.orderBy("_h", "chunk_id").limit(sample_rows), "ann-sample")
    first = [r.embedding for r in sample.orderBy("_h", "chunk_id").limit(lists).select("embedding").collect()]  # lists rows
    centroids = np.array(first, float).reshape(-1, dims)
    if len(centroids):
        centroids = _rounds(sample.select("embedding"), centroids / np.linalg.norm(centroids, axis=1, keepdims=True), rounds)
        probes = _measured(written(_assigned(sample, centroids), "ann-sample"), centroids, dims, recall, k, trials)
        # lists are dealt whole to files, and split where they are larger than the others
        _assigned(good, centroids).hint("rebalance", "list").write.mode("overwrite").partitionBy("list").option("maxRecordsPerFile", 1_000_000).parquet(f"{path}/lists")
    else:
        probes = 1
        good.withColumn("list", F.lit(0)).write.mode("overwrite").parquet(f"{path}/lists")
    spark.createDataFrame([(json.dumps(centroids.tolist()), probes, dims)], "centroids string, probes int, dims int").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    return InvertedFile(path, centroids, probes)


def open_index(spark: SparkSession, path: str) -> InvertedFile:
    r = spark.read.parquet(f"{path}/centroids").first()
    return InvertedFile(path, np.array(json.loads(r.centroids), float).reshape(-1, r.dims), r.probes)


def read_lists(spark: SparkSession, index: InvertedFile, lists: list[int]) -> DataFrame:
    """The vectors of some lists; the other partitions aren't opened."""
    return spark.read.parquet(f"{index.path}/lists").where(F.col("list").isin(lists))


def search(spark: SparkSession, index: InvertedFile, query: list[float], limit: int = 20, threshold: float = 0.35, probes: int | None = None) -> DataFrame:
    """One query: as ``vector_top`` over the lists that are probed."""
    norm = float(np.linalg.norm(query)) if len(query) == index.centroids.shape[1] and np.isfinite(query).all() else 0.0
    rows = read_lists(spark, index, index.nearest(query, probes) if norm else [])
    score = F.round(V.similarity(1 - V.cosine(F.col("embedding"), F.array(*(F.lit(float(x)) for x in query))), False), SCORE_DIGITS)
    return ranked(rows.withColumn("score", score).drop("embedding", "list").where(F.col("score") >= threshold), limit)


def search_all(spark: SparkSession, index: InvertedFile, queries: DataFrame, limit: int = 10, threshold: float = -1.0, probes: int | None = None, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, chunk_id, score): the best rows of each query (query_id, embedding) but its own.

    Queries are a stated set and go in blocks of query_bytes; a block reads only the lists that its
    queries probe, once, and each task returns the best of each query.
    """
    dims = index.centroids.shape[1]
    asked = written(queries.where(usable("embedding", dims)).select("query_id", "embedding", F.xxhash64("query_id").alias("_h")), "ann-queries")
    blocks = max(1, -(-asked.count() * 8 * dims // query_bytes))
    kind = asked.schema["query_id"].dataType.simpleString()
    out = None
    for b in range(blocks):
        mine = [(r.query_id, r.embedding) for r in asked.where(F.pmod("_h", F.lit(blocks)) == b).collect()]  # query_bytes, about
        if not mine:
            continue
        lists = [index.nearest(v, probes) for _, v in mine]
        rows = read_lists(spark, index, sorted({x for y in lists for x in y}))
        found = _matches(rows, dims, mine, lists, limit + 1, threshold)
        names = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(mine)], f"query long, query_id {kind}")
        part = found.join(F.broadcast(names), "query").where("query_id <> chunk_id").select("query_id", "chunk_id", "score")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"query_id {kind}, rank int, chunk_id {kind}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")  # each task gave limit + 1 rows at most
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query_id", "rank", "chunk_id", "score")
