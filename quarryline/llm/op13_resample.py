"""Importance resampling towards a target distribution, with hashed word n-grams.

Each task maps the distinct words of a bounded run of texts to integer ids (an exact dictionary), makes
n-grams of them as tuples of ids, one word longer at a time, and numbers the distinct tuples. Only those
are turned back into bytes and hashed, once each; the counts of (document, tuple) are then joined with
the tuples' buckets. So what is shuffled is one number for each bucket and task, never a feature.

A bucket's gain is the logarithm of its smoothed frequency in the target over that in the documents; a
document's weight is the sum of its features' gains. Adding Gumbel noise that depends on doc_id alone
and taking the highest scores draws without replacement in proportion to exp(weight / 1000). Only
narrow rows are sorted, in ranges.

Documents' bucket counts are written once and read for both the corpus's frequencies and the weights.

Defined results: a null text has no words and weight 0; a null doc_id hashes as an empty one and comes
last on a tie; rows of equal score and doc_id stand in any order; an empty target gives every bucket the
same frequency there; an empty table gives no rows. Columns named like the results are replaced, others
of any name pass through if they are kept.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import numbered, quoted, written
from .wordhash import ALNUM_LOW, owner, pieces, utf8, whole, words

RESULT = ("n_features", "weight", "score", "rank")


def dictionary(column: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(id of each word, the distinct words, n + 1 offsets of the texts): words in lower case (A-Z only), ids in order of first occurrence."""
    data, off = utf8(column)
    _, begin, end, woff = words(data, off, ALNUM_LOW)
    inside, low = ALNUM_LOW
    plain = low[data[inside[data]]]  # the words' bytes end to end
    ends = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int64)
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(plain)]).dictionary_encode()
    return np.asarray(coded.indices).astype(np.int64), coded.dictionary.to_pylist(), woff


def counted(column: pa.Array, low: int, high: int, buckets: int) -> tuple[np.ndarray, ...]:
    """(n + 1 offsets, bucket, times; words and features of each text): the bucket counts of each text, in order."""
    ids, names, woff = dictionary(column)
    n, own = len(woff) - 1, owner(woff)
    length = np.diff(woff)
    total, keys, times = np.zeros(n, np.int64), [], []
    grams, texts = ids, names  # the tuple that begins at each word, and the bytes of each distinct tuple
    for k in range(1, high + 1):
        if k > 1:  # one word longer: a pair of the shorter tuple's number and the next word's id
            pair = grams[:-1] * max(1, len(names)) + ids[k - 1 :]
            here = whole(woff, k, len(ids))
            distinct, number = np.unique(pair[here], return_inverse=True)
            texts = [texts[a] + b" " + names[b] for a, b in zip((distinct // max(1, len(names))).tolist(), (distinct % max(1, len(names))).tolist(), strict=True)]
            grams = np.zeros(len(pair), np.int64)
            grams[here] = number
        else:
            here = np.ones(len(ids), bool)
        if k < low:
            continue
        total += np.maximum(0, length - k + 1)
        bucket = np.fromiter((zlib.crc32(x) % buckets for x in texts), np.int64, len(texts))
        pairs, count = np.unique(own[: len(grams)][here] * max(1, len(texts)) + grams[here], return_counts=True)
        keys.append(pairs // max(1, len(texts)) * buckets + bucket[pairs % max(1, len(texts))])
        times.append(count)
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.bincount(at, np.concatenate(times), len(key)).astype(np.int64)
    return np.searchsorted(key, np.arange(n + 1) * buckets), key % buckets, sums, length, total


def features(documents: DataFrame, low: int, high: int, buckets: int, text: str = "text") -> DataFrame:
    """(doc, n_words, n_features, bucket, times) of rows (doc, text)."""
    schema = T.StructType([documents.schema["doc"], *T.StructType.fromDDL("n_words long, n_features long, bucket array<int>, times array<long>").fields])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                off, bucket, times, length, total = counted(part.column(text), low, high, buckets)
                lists = [pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(v, k)) for v, k in ((bucket, pa.int32()), (times, pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(length), pa.array(total), *lists], names=["doc", "n_words", "n_features", "bucket", "times"])

    return documents.mapInArrow(count, schema)


def bucket_sums(rows: DataFrame, buckets: int) -> np.ndarray:
    """How many features fall in each bucket: one array of that fixed length a task, summed."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros(buckets, np.int64)
        for batch in batches:
            np.add.at(have, np.asarray(batch.column("bucket").flatten()), np.asarray(batch.column("times").flatten()))
        some = np.flatnonzero(have)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(have[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in rows.select("bucket", "times").mapInArrow(add, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most `buckets` rows
        out[r.bucket] = r.n
    return out


def gains(ours: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the logarithm of each bucket's frequency in the target over ours, both smoothed by one, rounded down."""
    size, (s_all, t_all) = len(ours), (float(x.sum()) for x in (ours, target))
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + size) / ((s + 1) * (t_all + size)))) for s, t in zip(ours.astype(float).tolist(), target.astype(float).tolist(), strict=True)], np.int64)


def weighed(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc, n_words, n_features, weight)."""
    shared = rows.sparkSession.sparkContext.broadcast(gain)
    schema = T.StructType([rows.schema["doc"], *T.StructType.fromDDL("n_words long, n_features long, weight long").fields])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.asarray(batch.column("bucket").value_lengths()).astype(np.int64)
            total = np.concatenate([[0], np.cumsum(shared.value[np.asarray(batch.column("bucket").flatten())] * np.asarray(batch.column("times").flatten()))])
            end = np.cumsum(size)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("n_words"), batch.column("n_features"), pa.array(total[end] - total[end - size], pa.int64())], names=["doc", "n_words", "n_features", "weight"])

    return rows.mapInArrow(weigh, schema)


def resample(documents: DataFrame, target: DataFrame, low: int = 1, high: int = 2, buckets: int = 10000, percent: int = 10, least_words: int = 20, seed: str = "2024", text: str = "text", doc_id: str = "doc_id", target_text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """documents (the columns in keep; by default all but the text) with n_features, weight, score and rank: 1, 2, 3 ... for those drawn, null for others.

    Features are the runs of low to high words. Of documents of least_words words or more, percent % are drawn.
    """
    names = [c for c in ([c for c in documents.columns if c != text] if keep is None else keep) if c.lower() not in RESULT]
    key = F.coalesce(F.col(quoted(doc_id)).cast("string"), F.lit(""))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), key), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    doc = F.struct(F.struct(F.lit(None).cast("string").alias("none"), *(F.col(quoted(c)).alias(f"_{i}") for i, c in enumerate(names))).alias("kept"), F.col(quoted(doc_id)).alias("id"), noise.alias("noise"))
    rows = written(features(documents.select(doc.alias("doc"), F.col(quoted(text)).alias("text")), low, high, buckets), "resample-features")
    aimed = features(target.select(F.struct(F.lit(0).alias("x")).alias("doc"), F.col(quoted(target_text)).alias("text")), low, high, buckets)
    gain = gains(bucket_sums(rows, buckets), bucket_sums(aimed, buckets))
    scored = weighed(rows, gain).select("doc", "n_words", "n_features", "weight", (F.col("weight") + F.col("doc.noise")).alias("score"))
    scored = written(scored, "resample-scores")
    asked = F.col("n_words") >= least_words
    most = scored.where(asked).count() * percent // 100
    placed = numbered(scored.where(asked), [F.col("score").desc(), F.col("doc.id").asc_nulls_last()], "place")
    out = placed.withColumn("rank", F.when(F.col("place") <= most, F.col("place"))).drop("place").unionByName(scored.where(~asked).withColumn("rank", F.lit(None).cast("long")))
    return out.select(*(F.col(f"doc.kept._{i}").alias(c) for i, c in enumerate(names)), *RESULT)


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return resample(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"), low=1, high=1)


SQL = r"""
WITH RECURSIVE bits AS (SELECT i AS v, i AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT v, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY v) AS tab FROM bits WHERE k = 8),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+')) AS f FROM benchmark),
dw AS (SELECT doc_id, f, count(*) AS n FROM (SELECT doc_id, unnest(w) AS f FROM d) GROUP BY doc_id, f),
dict AS (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, 2 * octet_length(encode(f)), 2), lambda p: ('0x' || hex(encode(f))[p:p + 1])::BIGINT)), lambda c, x: xor(c >> 8, tab[xor(c & 255, x) + 1])), 4294967295) % 10000 AS k FROM (SELECT f FROM dw UNION SELECT f FROM b), tab),
s AS (SELECT k, sum(n)::DOUBLE AS s FROM dw JOIN dict USING (f) GROUP BY k),
t AS (SELECT k, count(*)::DOUBLE AS t FROM b JOIN dict USING (f) GROUP BY k),
z AS (SELECT coalesce((SELECT sum(s) FROM s), 0) AS sz, coalesce((SELECT sum(t) FROM t), 0) AS tz),
g AS (SELECT k, floor(1000 * ln((coalesce(t, 0) + 1) * (sz + 10000) / ((s + 1) * (tz + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (k), z),
w AS (SELECT doc_id, sum(n * gain)::BIGINT AS weight FROM dw JOIN dict USING (f) JOIN g USING (k) GROUP BY doc_id),
x AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id::VARCHAR)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN w USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM x WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * (SELECT count(*) FROM r) // 100 THEN place END::BIGINT AS rank FROM x LEFT JOIN r USING (doc_id)
"""
