"""Benchmark decontamination by winnowing.

Of each 13 consecutive words, the smallest of the nine 5-gram hashes is kept (the last one, on a
tie), on both sides. Two texts that share 13 words in a row therefore share a fingerprint inside
them, so looking up fingerprints and extending the hits finds every shared window: a fingerprint of a
document that the benchmark has, too, is extended to the nine windows of words that it can stand for,
and each is looked up among the benchmark's different windows. A fingerprint is marked once however
often the benchmark has it, and windows of the same items are one set of items, so equal texts on
both sides don't multiply.

Defined results: a null text has no words; an item without words matches nothing; an item of 1 to 12
words is one window of its own length; items with equal texts each count; a null item_id sorts and
prints as an empty string; a null doc_id is kept; repeated rows are judged each by itself; an empty
benchmark hits nothing; other columns pass through ``contamination`` untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import boxed, with_text
from .wordhash import ALNUM_LOW, grams, owner, pieces, utf8, whole, words

WINDOW, GRAM = 13, 5
#: Benchmark text that is sent to the workers at once; a larger benchmark goes in several blocks.
BLOCK_BYTES = 8 << 20


def winnow(h: np.ndarray, woff: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of the fingerprints of all texts: of the gram hashes in each window of words, the last smallest one."""
    g, w = grams(h, gram), window - gram + 1
    if len(h) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ok = np.flatnonzero(whole(woff, window, len(h)))
    best, at = g[ok + w - 1].copy(), ok + w - 1
    for j in range(w - 2, -1, -1):
        x = g[ok + j]
        less = x < best
        best[less], at[less] = x[less], (ok + j)[less]
    at = np.unique(at)
    return g[at], at


class Index:
    """Fingerprints and different windows of benchmark items, to be looked up by binary search; windows name sets of items."""

    def __init__(self, rows: list[tuple]):
        self.ids = ["" if i is None else str(i) for i, _ in rows]
        h, _, _, off = words(*utf8(pa.array([t for _, t in rows], pa.string())), ALNUM_LOW)
        n, own = np.diff(off), owner(off)
        self.fp = np.unique(winnow(h, off)[0])
        found = []  # (length, hash, item) of each window
        for k in range(1, WINDOW + 1):
            ok = np.flatnonzero(whole(off, k, len(h)))
            ok = ok[n[own[ok]] >= WINDOW] if k == WINDOW else ok[n[own[ok]] == k]
            if len(ok):
                found.append((k, grams(h, k)[ok], own[ok]))
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by length: the different hashes, and each one's set
        self.sets: list[list[int]] = []
        known: dict[bytes, int] = {}
        for k, g, item in found:
            order = np.lexsort((item, g))
            g, item = g[order], item[order]
            once = np.concatenate([[True], (np.diff(g) != 0) | (np.diff(item) != 0)])
            g, item = g[once], item[once].astype("<i8")
            first = np.flatnonzero(np.concatenate([[True], np.diff(g) != 0]))
            which = np.zeros(len(first), np.int64)
            for j, (a, z) in enumerate(zip(first.tolist(), [*first[1:].tolist(), len(g)], strict=True)):
                key = item[a:z].tobytes()
                if key not in known:
                    known[key] = len(self.sets)
                    self.sets.append(item[a:z].tolist())
                which[j] = known[key]
            self.windows[k] = (g[first], which)

    def _found(self, k: int, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, set) of the windows of k words that begin at the places at and are the benchmark's."""
        g, which = self.windows[k]
        x = grams(h, k)[at] if len(at) else np.zeros(0, np.uint64)
        i = np.minimum(np.searchsorted(g, x), len(g) - 1)
        same = np.flatnonzero(g[i] == x)
        return at[same], which[i[same]]

    def hits(self, h: np.ndarray, woff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, end word, set of items) of the windows that the texts share with the benchmark."""
        out = []
        for k in self.windows:
            if k == WINDOW:
                fp, at = winnow(h, woff)
                at = at[np.isin(fp, self.fp)] if len(fp) else at
                mark = np.zeros(len(h) + 1, np.int64)  # the windows that hold a marked fingerprint begin at most so far before it
                np.add.at(mark, np.maximum(at - (WINDOW - GRAM), 0), 1)
                np.add.at(mark, at + 1, -1)
                can = np.cumsum(mark)[:-1] > 0
                ok = whole(woff, k, len(h))
                p, s = self._found(k, h, np.flatnonzero(can[: len(ok)] & ok))
            else:
                p, s = self._found(k, h, np.flatnonzero(whole(woff, k, len(h))))
            out.append((p, p + k, s))
        return tuple(np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(3))


RESULT = [("n_words", "long"), ("n_hit", "long"), ("items", "array<string>"), ("spans", "array<struct<start:long,end:long>>")]


def contamination(documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """documents with n_words, n_hit, items (ids of the items of which a window occurs, sorted as strings) and spans (hit words, merged) added; columns of these names are replaced.

    The benchmark is a stated query set: it goes to the workers in blocks of at most block_bytes of
    text (or one item), one block at a time in memory, and every document meets every block.
    Documents aren't shuffled.
    """
    spark = documents.sparkSession
    b = benchmark.select(F.col(item).cast("string").alias("i"), F.col(item_text).alias("t")).where("t is not null")
    size = b.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = -(-size // block_bytes) or 1
    blocks = []
    for k in range(n):
        rows = b.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).orderBy("i", "t").collect()
        blocks.append(spark.sparkContext.broadcast(Index([tuple(r) for r in rows])))
    docs = boxed(documents, [x for x, _ in RESULT])
    schema = T.StructType(docs.schema.fields + T.StructType.fromDDL(", ".join(f"{a} {t}" for a, t in RESULT)).fields)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in with_text(batches, text):
            for part in pieces(batch, "text"):
                h, _, _, woff = words(*utf8(part.column("text")), ALNUM_LOW)
                found = []
                for k, block in enumerate(blocks):
                    index = block.value
                    a, z, sets = index.hits(h, woff)
                    each = np.unique((np.searchsorted(woff, a, "right") - 1) * max(1, len(index.sets)) + sets)  # a text's different sets
                    named = [(d, [index.ids[i] for i in index.sets[s]]) for d, s in zip((each // max(1, len(index.sets))).tolist(), (each % max(1, len(index.sets))).tolist(), strict=True)]
                    found.append((a, z, named))
                    if len(blocks) > 1:
                        del block._value
                a, z = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
                mark = np.zeros(len(h) + 1, np.int64)
                np.add.at(mark, a, 1)
                np.add.at(mark, z, -1)
                hit = np.cumsum(mark)[:-1] > 0
                n_hit = np.add.reduceat(np.append(hit, False).astype(np.int64), woff[:-1]) * (np.diff(woff) > 0) if len(h) else np.zeros(part.num_rows, np.int64)
                which: list = [set() for _ in range(part.num_rows)]
                for d, ids in (y for x in found for y in x[2]):
                    which[d].update(ids)
                spans: list = [[] for _ in range(part.num_rows)]
                for d in np.flatnonzero(n_hit).tolist():
                    x = np.diff(np.concatenate([[0], hit[woff[d] : woff[d + 1]].astype(np.int8), [0]]))
                    spans[d] = [{"start": s, "end": e} for s, e in zip(np.flatnonzero(x == 1).tolist(), np.flatnonzero(x == -1).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), pa.array(np.diff(woff)), pa.array(n_hit), pa.array([sorted(s) for s in which], pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    names=["doc", *(x for x, _ in RESULT)],
                )

    return docs.mapInArrow(score, schema).select("doc.*", *(x for x, _ in RESULT))


def verdict(n_hit: str = "n_hit", n_words: str = "n_words"):
    """Contaminated: a twentieth of the words or more are hit."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), verdict().alias("contaminated")
    )


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM benchmark),
k AS (SELECT DISTINCT least(len(w), 13) AS k FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM (SELECT item_id, w, least(len(w), 13) AS k, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, k WHERE len(w) >= k)),
m AS (SELECT doc_id, item_id, p, dw.k AS k FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS x FROM (SELECT DISTINCT doc_id, p, k FROM m)) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""
