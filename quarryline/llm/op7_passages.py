"""Removal of repeated passages with compressed FM-indexes.

A word goes if it lies in 13 consecutive words that also start in a document with a smaller doc_id.

The corpus is dealt into shards so that equal windows of 13 words meet: each window belongs to the
smallest of its 5-gram hashes (its anchor), and neighbouring windows with one anchor travel as one
segment. Only anchors that several documents have are of interest, and equal segments travel once,
with the smallest doc_id they have. Each shard's segments are indexed: suffixes sorted as deep as a
window asks for, their Burrows-Wheeler transform in a wavelet matrix of packed bits. All segments are
then streamed through backward search, which gives each window's matching length and the suffixes that
begin with it, and so the smallest document that has it.

An anchor that very many rows have would bring together all that surrounds it; its windows are dealt
by a hash of their own instead.

Defined results: a null, empty or blank text has no words; rows with a null doc_id neither lose words
nor make others lose them; rows of one doc_id are judged alike against smaller doc_ids only; equal rows
get equal results; an empty table gives no rows; other columns, of any name, pass through ``without_repeats``,
but for those named like its results. A row is known by a 64-bit hash of its id and text, a word within a
segment by 32 bits, and segments meet by 64-bit hashes of 5 words.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .op9_decontaminate import winnow
from .shared import boxed, parallelism, written
from .wordhash import SPACED, grams, mix, pieces, utf8, whole, words

WINDOW, GRAM = 13, 5
#: Rows from which an anchor's windows are dealt one by one; words in a shard's index, about.
HOT, SHARD_WORDS = 2000, 400_000


class WaveletMatrix:
    """Rank queries over a sequence of numbers: a row of packed bits and counts for each binary digit."""

    def __init__(self, sequence: np.ndarray, top: int):
        self.levels = max(1, int(top).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (sequence >> level & 1).astype(bool)
            packed = np.zeros(len(bit) // 64 + 1, "<u8")
            packed.view(np.uint8)[: -(-len(bit) // 8)] = np.packbits(bit, bitorder="little")
            self.bits.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int32)]).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            sequence = np.concatenate([sequence[~bit], sequence[bit]])

    def map(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position at ends up in the last row when only symbol is followed; a rank is the difference to that of position 0."""
        for k in range(self.levels):
            word = at >> 6
            ones = self.counts[k][word] + np.bitwise_count(self.bits[k][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            up = (symbol >> (self.levels - 1 - k) & 1).astype(bool)
            at = np.where(up, self.zeros[k] + ones, at - ones)
        return at


class FmIndex:
    """Over several texts of numbers from 1 on, for patterns of up to depth numbers."""

    def __init__(self, text: np.ndarray, depth: int):
        """text: numbers, 0 after each single text."""
        n = len(text)
        rank, have = text.astype(np.int64), 1
        while have < depth:  # prefix doubling, as far as depth
            ahead = np.zeros(n, np.int64)
            ahead[: max(0, n - have)] = rank[have:] + 1
            _, rank = np.unique(rank * (int(rank.max(initial=0)) + 2) + ahead, return_inverse=True)
            have *= 2
        self.suffixes = np.argsort(rank, kind="stable")
        top = int(text.max(initial=0))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.wavelet = WaveletMatrix(text[self.suffixes - 1], top)
        self.base = self.wavelet.map(np.arange(top + 1), np.zeros(top + 1, np.int64))
        self.n = n

    def matching(self, text: np.ndarray, last: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(length, low, high) for the patterns that end at the places last: how far back up to `most` numbers each can be read in the index, and the suffixes that begin with what was read."""
        low, high, length = np.zeros(len(last), np.int64), np.full(len(last), self.n, np.int64), np.zeros(len(last), np.int64)
        live = np.arange(len(last))
        for j in range(most):
            at = last[live] - j
            live, at = live[at >= 0], at[at >= 0]
            c = text[at]
            live, c = live[c > 0], c[c > 0]
            both = self.wavelet.map(np.concatenate([c, c]), np.concatenate([low[live], high[live]]))
            lo, hi = self.before[c] + both[: len(c)] - self.base[c], self.before[c] + both[len(c) :] - self.base[c]
            some = hi > lo
            live = live[some]
            low[live], high[live], length[live] = lo[some], hi[some], j + 1
        return length, low, high


def smallest_documents(contents: list[np.ndarray], doc: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """For each window of each content, the smallest doc of all contents that have it."""
    size = np.array([len(c) for c in contents])
    _, symbol = np.unique(np.concatenate(contents), return_inverse=True)
    text = np.zeros(int(size.sum() + len(size)), np.int64)
    owner = np.repeat(np.arange(len(size)), size)
    text[np.arange(len(symbol)) + owner] = symbol + 1
    index = FmIndex(text, window)
    begin = np.cumsum(size + 1) - size - 1
    count = np.maximum(size - window + 1, 0)
    last = np.repeat(begin, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + window - 1
    length, low, high = index.matching(text, last, window)
    assert (length == window).all()
    of = doc[np.minimum(np.searchsorted(begin, index.suffixes, "right") - 1, len(doc) - 1)]
    lows, which = np.unique(low, return_inverse=True)
    highs = np.zeros(len(lows), np.int64)
    highs[which] = high
    least = np.minimum.reduceat(np.append(of, 0), np.stack([lows, highs], axis=1).reshape(-1))[::2] if len(lows) else of[:0]
    return np.split(least[which], np.cumsum(count)[:-1])


def _segments(h: np.ndarray, woff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, windows) of the runs of windows that share an anchor."""
    w = WINDOW - GRAM + 1
    ok = np.flatnonzero(whole(woff, WINDOW, len(h)))
    if not len(ok):
        return np.zeros(0, np.uint64), ok, ok
    g = grams(h, GRAM)
    best, at = g[ok + w - 1].copy(), ok + w - 1
    for j in range(w - 2, -1, -1):
        x = g[ok + j]
        less = x < best
        best[less], at[less] = x[less], (ok + j)[less]
    new = np.append(True, (at[1:] != at[:-1]) | (ok[1:] != ok[:-1] + 1))
    first = np.flatnonzero(new)
    return best[first], ok[first], np.diff(np.append(first, len(ok)))


def _free(spark: SparkSession) -> None:
    """Let go of the shuffle files of what has been written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def repeated_words(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = HOT, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(_key, gone: array<int>) of rows that lose words: the first words of their windows that start in a document with a smaller doc_id. _key: xxhash64(doc_id, text)."""
    spark = documents.sparkSession
    docs = documents.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.xxhash64(doc_id, text).alias("_key"), F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "t"):
                h, _, _, woff = words(*utf8(part.column("t")), SPACED)
                fp, at = winnow(h, woff, WINDOW, GRAM)
                row = np.searchsorted(woff, at, "right") - 1
                order = np.lexsort((fp, row))
                fp, row = fp[order], row[order]
                new = np.ones(len(fp), bool)
                new[1:] = (fp[1:] != fp[:-1]) | (row[1:] != row[:-1])
                row = pa.array(row[new])
                yield pa.RecordBatch.from_arrays([pa.array(fp[new].view(np.int64)), part.column("d").take(row), part.column("_key").take(row)], names=["a", "d", "_key"])

    seen = docs.mapInArrow(anchors, "a long, d long, _key long")
    shared = written(seen.groupBy("a").agg(F.min("d").alias("x"), F.max("d").alias("y"), F.count("*").alias("n")).where("x < y").select("a", (F.col("n") > hot).alias("hot")), "anchors")
    _free(spark)
    marks = written(seen.select("a", "_key").join(shared, "a").groupBy("_key").agg(F.collect_set(F.when(~F.col("hot"), F.col("a"))).alias("cold"), F.collect_set(F.when(F.col("hot"), F.col("a"))).alias("hot")), "marks")
    _free(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "t", 1 << 20):
                h, _, _, woff = words(*utf8(part.column("t")), SPACED)
                anchor, first, n = _segments(h, woff)
                row = np.searchsorted(woff, first, "right") - 1
                small = mix(h).astype(np.uint32)
                for name, by_window in (("cold", False), ("hot", True)):
                    lists = part.column(name)
                    have = np.asarray(lists.flatten()).astype(np.int64).view(np.uint64)
                    rows = np.repeat(np.arange(part.num_rows), np.asarray(pc.list_value_length(lists)))
                    # (row, anchor) pairs as one number: anchors are hashes already
                    wanted = mix(have ^ mix(rows.astype(np.uint64)))
                    keep = np.isin(mix(anchor ^ mix(row.astype(np.uint64))), wanted)
                    r, f, k, key = row[keep], first[keep], n[keep], anchor[keep]
                    if by_window:
                        r, key = np.repeat(r, k), np.zeros(0, np.uint64)
                        f = np.repeat(f, k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                        k = np.ones(len(f), np.int64)
                        key = grams(h, WINDOW)[f] if len(f) else key
                    if not len(f):
                        continue
                    content = [small[a : a + c].tobytes() for a, c in zip(f.tolist(), (k + WINDOW - 1).tolist(), strict=True)]
                    take = pa.array(r)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(content, pa.binary()), part.column("d").take(take), part.column("_key").take(take), pa.array((f - woff[r]).astype(np.int32))], names=["s", "content", "d", "_key", "p"])

    segments = written(docs.join(marks, "_key").mapInArrow(cut, "s long, content binary, d long, _key long, p int"), "segments")
    _free(spark)
    contents = segments.groupBy("s", "content").agg(F.min("d").alias("d"))
    total = segments.agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0))).first()[0] // 4
    shards = max(parallelism(spark), -(-total // shard_words))

    def index(df: pd.DataFrame) -> pd.DataFrame:
        contents = [np.frombuffer(x, np.uint32) for x in df["content"]]
        least = smallest_documents(contents, df["d"].to_numpy(np.int64))
        return pd.DataFrame({"c": df["c"], "least": least})

    least = written(contents.select("content", "d", F.xxhash64("s", "content").alias("c"), F.pmod(F.xxhash64("s"), F.lit(shards)).alias("shard")).groupBy("shard").applyInPandas(index, "c long, least array<long>"), "least")
    _free(spark)
    hits = segments.select(F.xxhash64("s", "content").alias("c"), "d", "_key", "p").join(least, "c")
    gone = F.filter(F.transform("least", lambda x, i: F.when(x < F.col("d"), F.col("p") + i)), lambda x: x.isNotNull())
    hits = hits.select("_key", gone.alias("g")).where("size(g) > 0")
    out = written(hits.groupBy("_key").agg(F.flatten(F.collect_set("g")).alias("gone")), "gone")
    _free(spark)
    return out


def without_repeats(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """documents with n_words, n_removed and kept (the words that stay, joined by one space) added; columns of these names are replaced."""
    packed = boxed(documents, ["n_words", "n_removed", "kept"]).withColumn("_key", F.xxhash64(F.col("doc").getField(doc_id), F.col("doc").getField(text)))
    both = packed.join(repeated_words(documents, doc_id, text), "_key", "left").drop("_key")
    schema = T.StructType([packed.schema["doc"], *T.StructType.fromDDL("n_words long, n_removed long, kept string").fields])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [batch.column("doc").type.field(i).name for i in range(batch.column("doc").type.num_fields)]
            batch = batch.append_column("text", batch.column("doc").flatten()[names.index(text)])
            for part in pieces(batch, "text"):
                data, off = utf8(part.column("text"))
                _, s, e, woff = words(data, off, SPACED)
                lists = part.column("gone")
                n = np.asarray(pc.list_value_length(lists).fill_null(0)).astype(np.int64)
                at = np.asarray(lists.drop_null().flatten()).astype(np.int64) + np.repeat(woff[:-1], n)
                mark = np.zeros(len(s) + WINDOW + 1, np.int64)
                np.add.at(mark, at, 1)
                np.add.at(mark, at + WINDOW, -1)
                gone = np.cumsum(mark)[: len(s)] > 0
                raw = data.tobytes()
                kept, removed = [], []
                for d in range(part.num_rows):
                    a, z = woff[d], woff[d + 1]
                    g = gone[a:z]
                    removed.append(int(g.sum()))
                    if removed[-1] == 0:
                        kept.append(b" ".join(raw[off[d] : off[d + 1]].split()))
                    else:
                        kept.append(b" ".join(raw[i:j] for i, j in zip(s[a:z][~g].tolist(), e[a:z][~g].tolist(), strict=True)))
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(np.diff(woff)), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc", "n_words", "n_removed", "kept"])

    return both.mapInArrow(keep, schema).select("doc.*", "n_words", "n_removed", "kept")


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x{20}\x{09}-\x{0D}]+') AS w FROM documents),
p AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 12], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)),
f AS (SELECT g, min(doc_id) AS first FROM p GROUP BY g),
r AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS i FROM p JOIN f USING (g) WHERE first < doc_id),
l AS (SELECT doc_id, list(i) AS gone, count(*) AS n FROM r GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN l USING (doc_id)
"""
