"""Exact top-k by inner product over vector-approximation files.

Each vector's integer components are quantised to one byte each over the range of their dimension, and
written once as an approximation file beside the exact vectors. Queries (a stated set) meet the bytes,
not the vectors, in cells of a grid that hold a bounded number of bytes of either. In a cell the bytes
give every candidate an upper and a lower bound of its score; those whose upper bound is below a
query's kth lower bound can't be among its k, neither in the cell nor, once cells are merged, of all.
The exact vectors of the rest are read in the order of their upper bounds (the lower bound of
distance): first the 4k best bounds of each query, then those whose bound the kth score found so far
doesn't rule out, after which the k are certain.

Of vectors that are equal, component by component, only the k + 1 with the smallest ids can be among
anyone's k (one of them may be the query's own), so no more of them go on: a vector that very many rows
share costs no more than others.

Defined results: vectors that are null or empty, or hold a null or a component that isn't finite, take
no part; vectors meet only those of the same length; equal rows (same id and vector) count once; rows
of one id and different vectors each take part, as query and as candidate, and a query never meets
rows of its own id; a null id takes no part; ties go to the smaller id; an empty table gives no rows.
Integer products beyond 64 bits wrap; beyond 2**26 in a component, bounds leave room for rounding.
Equal vectors are told by 128 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import written

#: Bytes of the approximation file, and of queries, in one cell of the grid; vectors looked at together in it.
CELL_BYTES, QUERY_BYTES, BLOCK = 32 << 20, 8 << 20, 4096


def integers(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component; null where the vector takes no part."""
    ok = vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(ok, F.transform(vector, lambda x: F.floor(scale * x.cast("double"))))


def _rows(lists: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """[(places, matrix)] of a column of lists, by length."""
    flat, size = np.asarray(lists.flatten()), np.asarray(lists.value_lengths()).astype(np.int64)
    start = np.cumsum(size) - size
    return [(at, flat[start[at][:, None] + np.arange(d)]) for d in np.unique(size) for at in [np.flatnonzero(size == d)]]


def ranges(vectors: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{length: (least, greatest) of each dimension}; two numbers a dimension come to the driver."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in _rows(batch.column("v")):
                j = np.arange(x.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), len(j), np.int32)), pa.array(j.astype(np.int32)), pa.array(x.min(0)), pa.array(x.max(0))], names=["d", "j", "lo", "hi"])

    found = vectors.select("v").mapInArrow(part, "d int, j int, lo long, hi long").groupBy("d", "j").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).toPandas().sort_values(["d", "j"])
    return {int(d): (x["lo"].to_numpy(np.float64), x["hi"].to_numpy(np.float64)) for d, x in found.groupby("d")}


def steps(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How many integers of each dimension one byte stands for."""
    return np.maximum(1.0, np.ceil((high - low + 1) / 256))


def approximations(vectors: DataFrame, limits: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """vectors (u, id, d, v) with code, a byte a component, in the place of v."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes: list = [b""] * batch.num_rows
            for at, x in _rows(batch.column("v")):
                low, high = limits[x.shape[1]]
                for i, c in zip(at.tolist(), ((x - low) // steps(low, high)).astype(np.uint8), strict=True):
                    codes[i] = c.tobytes()
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("u", "id", "d", "key", "more")), pa.array(codes, pa.binary())], names=["u", "id", "d", "key", "more", "code"])

    hashed = vectors.select("u", "id", "d", F.xxhash64("v").alias("key"), F.xxhash64(F.lit(1), "v").alias("more"), "v")
    return hashed.mapInArrow(code, "u long, id long, d int, key long, more long, code binary")


def bounds(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, codes: np.ndarray, low: np.ndarray, step: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(query row, candidate rows, lower, upper) of those candidates of a cell whose upper bound reaches the query's kth lower one."""
    qf = q.astype(np.float64)
    width = np.abs(qf) @ (step - 1)  # what the bytes leave open
    at_low = qf @ low
    slack = 1e-9 * (np.abs(qf) @ np.maximum(np.abs(low), np.abs(low + 256 * step))) + 1
    scaled = qf * step
    part = max(1, (1 << 22) // max(1, len(codes)))
    down = np.minimum(qf, 0) @ (step - 1)
    for a in range(0, len(q), part):
        s = slice(a, a + part)
        # sum of q * (low + code * step), then plus the most and the least that the rest of each cell can add
        floor = np.empty((len(qf[s]), len(codes)))
        for b in range(0, len(codes), BLOCK):
            floor[:, b : b + BLOCK] = scaled[s] @ codes[b : b + BLOCK].T.astype(np.float64)
        floor += at_low[s, None] + down[s, None] - slack[s, None]
        for r, lower in zip(range(a, a + len(floor)), floor, strict=True):
            lower[c_ids == q_ids[r]] = -np.inf
            upper = lower + width[r] + 2 * slack[r]
            n = min(k, len(lower))
            kth = np.partition(lower, len(lower) - n)[len(lower) - n]
            live = np.flatnonzero((upper >= kth) & (upper > -np.inf))
            yield r, live, lower[live], upper[live]


def _dot(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype="int64")
    size = np.array([len(x) for x in a])
    out = np.zeros(len(a), np.int64)
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        out[at] = np.einsum("ij,ij->i", np.stack(a.iloc[at].to_list()).astype(np.int64), np.stack(b.iloc[at].to_list()).astype(np.int64))
    return pd.Series(out)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", cell_bytes: int = CELL_BYTES, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors of highest inner product for every row that is_query holds for.

    Of the table only counts and the range of each dimension come to the driver.
    """
    spark = vectors.sparkSession
    v = vectors.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), integers(F.col(vector)).alias("v"), is_query.alias("q")).where("v is not null")
    exact = written(v.select(F.monotonically_increasing_id().alias("u"), "id", F.size("v").alias("d"), "q", "v"), "topk-vectors")
    limits = ranges(exact)
    once = approximations(exact, limits).groupBy("d", "key", "more", "id").agg(F.min("u").alias("u"), F.first("code").alias("code"))  # equal rows count once
    first_ids = F.row_number().over(Window.partitionBy("d", "key", "more").orderBy("id"))
    files = written(once.withColumn("n", first_ids).where(F.col("n") <= k + 1).select("u", "id", "d", "code"), "topk-approximations")
    queries = written(exact.where("q").groupBy("d", "id", "v").agg(F.min("u").alias("u")), "topk-queries")
    n, size = files.agg(F.count("*"), F.coalesce(F.sum("d"), F.lit(0))).first()
    asked = queries.agg(F.coalesce(F.sum("d"), F.lit(0))).first()[0]
    nc = max(1, -(-size // cell_bytes), min(-(-n // 2048), 2 * spark.sparkContext.defaultParallelism))
    nr = max(1, -(-8 * asked // query_bytes))
    left = queries.select("d", "u", "id", "v", F.pmod(F.xxhash64("u"), F.lit(nr)).cast("int").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(nc - 1))).alias("c"))
    right = files.select("d", "u", "id", "code", F.pmod(F.xxhash64("u"), F.lit(nc)).cast("int").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(nr - 1))).alias("r"))

    def cell(asking: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"qu": np.zeros(0, np.int64), "cu": np.zeros(0, np.int64), "lower": np.zeros(0), "upper": np.zeros(0)})]
        if len(asking) and len(candidates):
            d = int(asking["d"].iat[0])
            low, high = limits[d]
            q, codes = np.stack(asking["v"].to_numpy()).astype(np.int64), np.frombuffer(b"".join(candidates["code"]), np.uint8).reshape(-1, d)
            qu, cu = asking["u"].to_numpy(np.int64), candidates["u"].to_numpy(np.int64)
            for r, at, lower, upper in bounds(asking["id"].to_numpy(np.int64), q, candidates["id"].to_numpy(np.int64), codes, low, steps(low, high), k):
                out.append(pd.DataFrame({"qu": np.full(len(at), qu[r]), "cu": cu[at], "lower": lower, "upper": upper}))
        return pd.concat(out)

    found = written(left.groupBy("d", "c", "r").cogroup(right.groupBy("d", "c", "r")).applyInPandas(cell, "qu long, cu long, lower double, upper double"), "topk-bounds")
    kth = lambda df, by: df.select("qu", F.col(by).alias("kth"), F.row_number().over(Window.partitionBy("qu").orderBy(F.desc(by))).alias("n")).where(F.col("n") == k).select("qu", "kth")
    live = found.join(kth(found, "lower"), "qu", "left").where("kth is null or upper >= kth").select("qu", "cu", "upper")
    live = written(live.withColumn("n", F.row_number().over(Window.partitionBy("qu").orderBy(F.desc("upper"), "cu"))), "topk-live")
    dot = F.pandas_udf(_dot, "long")

    def scores(pairs: DataFrame) -> DataFrame:
        """The exact vectors of candidates, read by their numbers."""
        both = pairs.join(exact.select(F.col("u").alias("cu"), F.col("id").alias("vec_id"), "v"), "cu").join(queries.select(F.col("u").alias("qu"), F.col("id").alias("query_id"), F.col("v").alias("w")), "qu")
        return both.select("qu", "query_id", "vec_id", dot("v", "w").alias("score"))

    best = written(scores(live.where(F.col("n") <= 4 * k)), "topk-scores")
    rest = scores(live.where(F.col("n") > 4 * k).join(kth(best, "score"), "qu").where("upper >= kth"))
    w = Window.partitionBy("qu", "query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.unionByName(rest).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    # an id with several vectors asks several times: its best answers of all
    again = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return ranked.select("query_id", again.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)))


SQL = r"""
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
