"""Quality by a generalised additive model with pairwise interactions.

Every text becomes a few figures (shares of signs, capitals and digits, lengths, repetition ...).
Each figure is cut into bins at quantiles. Boosting goes round the figures again and again; each turn
fits one tree of a few leaves to what is left to explain and adds it to that figure's lookup table.
Then the pairs that explain most of the rest get tables of two dimensions in the same way. A score is
a sum of table entries, looked up for a whole batch at once.

The training sample is bounded: TRAIN labelled documents. Scoring reads every whole text.

Defined results: null and empty texts have the figures of a text of no words and are scored by them;
each row is scored by itself; without labels, or with labels of one kind only, all documents get the
share of label 1 (1/2 if there is none); other columns pass through ``quality`` untouched, but for one
named score, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labelled import held_out, training_rows
from .shared import boxed, with_text
from .wordhash import SPACED_LOW, grams, owner, pieces, utf8, whole, words

#: Labelled documents that are learned from, at most.
TRAIN = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6


def _kind(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(chars)] = 1
    return out


_COUNTED = {
    "capitals": _kind(bytes(range(65, 91))),
    "digits": _kind(b"0123456789"),
    "shouts": _kind(b"!?"),
    "bars": _kind(b"|"),
    "signs": _kind(b"#$%&*<>{}[]=\\/@~^_+"),
    "stops": _kind(b".,;:"),
    "lines": _kind(b"\n"),
    "foreign": _kind(bytes(range(0xC0, 0x100))),
}
FIGURES = ["log_words", "mean_word", "long_words", "short_words", *_COUNTED, "distinct", "repeated_grams", "repeated_lines"]


def _distinct(key: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """How many different keys each of n texts has."""
    if not len(key):
        return np.zeros(n)
    order = np.lexsort((key, text))
    k, t = key[order], text[order]
    first = np.append(True, (k[1:] != k[:-1]) | (t[1:] != t[:-1]))
    return np.bincount(t[first], minlength=n).astype(float)


def figures(column: pa.Array) -> np.ndarray:
    """One row for each text, one column for each of FIGURES."""
    data, off = utf8(column)
    n, size = len(off) - 1, np.diff(off).astype(float)
    h, s, e, woff = words(data, off, SPACED_LOW)
    text, length, n_words = owner(woff), (e - s).astype(float), np.diff(woff).astype(float)
    per_word, per_byte = 1 / np.maximum(n_words, 1), 1 / np.maximum(size, 1)
    out = [np.log1p(n_words), np.bincount(text, length, n) * per_word, np.bincount(text, length > 20, n) * per_word, np.bincount(text, length <= 3, n) * per_word]
    for table in _COUNTED.values():
        total = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
        out.append((total[off[1:]] - total[off[:-1]]) * per_byte)
    out.append(_distinct(h, text, n) * per_word)
    ok = np.flatnonzero(whole(woff, 3, len(h)))
    g, gt = (grams(h, 3)[ok], text[ok]) if len(ok) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    count = np.bincount(gt, minlength=n)
    out.append(1 - np.where(count > 0, _distinct(g, gt, n) / np.maximum(count, 1), 1))
    line = np.cumsum(data == 10)
    key = line[s] + text if len(s) else np.zeros(0, np.int64)
    new = np.append(True, (key[1:] != key[:-1]) | (text[1:] != text[:-1])) if len(key) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    sums = np.add.reduceat(h, at) if len(at) else np.zeros(0, np.uint64)
    lt = text[at]
    lines = np.bincount(lt, minlength=n)
    out.append(1 - np.where(lines > 0, _distinct(sums, lt, n) / np.maximum(lines, 1), 1))
    return np.stack(out, axis=1)


class Gam:
    """cuts: bin edges by figure; main: a table by figure; pairs: (i, j, table of two dimensions over coarser bins)."""

    def __init__(self, base: float, cuts: list[np.ndarray], main: list[np.ndarray], coarse: list[np.ndarray], pairs: list):
        self.base, self.cuts, self.main, self.coarse, self.pairs = base, cuts, main, coarse, pairs

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        bins = [np.searchsorted(c, x[:, i], "right") for i, c in enumerate(self.cuts)]
        for b, table in zip(bins, self.main, strict=True):
            z += table[b]
        for i, j, table in self.pairs:
            z += table[self.coarse[i][bins[i]], self.coarse[j][bins[j]]]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _cut(g: np.ndarray, h: np.ndarray, leaves: int, strength: float) -> np.ndarray:
    """Values of the best tree of at most so many leaves over ordered bins, for summed gradients g and curvatures h."""
    spans = [(0, len(g))]
    G, H = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    worth = lambda a, b: (G[b] - G[a]) ** 2 / (H[b] - H[a] + strength)
    for _ in range(leaves - 1):
        best = max(((worth(a, k) + worth(k, b) - worth(a, b), -k, i) for i, (a, b) in enumerate(spans) for k in range(a + 1, b)), default=(0, 0, 0))
        if best[0] <= 1e-9:
            break
        a, b = spans[best[2]]
        spans[best[2] : best[2] + 1] = [(a, -best[1]), (-best[1], b)]
    out = np.empty(len(g))
    for a, b in spans:
        out[a:b] = (G[b] - G[a]) / (H[b] - H[a] + strength)
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15, leaves: int = 3, strength: float = 2.0, bins: int = BINS, pair_bins: int = PAIR_BINS, pairs: int = PAIRS) -> Gam:
    p0 = (y.sum() + 0.5) / (len(y) + 1)
    base, width = float(np.log(p0 / (1 - p0))), x.shape[1] if len(x) else len(FIGURES)
    cuts = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for i in range(width)]
    main = [np.zeros(len(c) + 1) for c in cuts]
    coarse = [np.arange(len(c) + 1) * pair_bins // (len(c) + 1) for c in cuts]
    model = Gam(base, cuts, main, coarse, [])
    if not len(y) or y.min() == y.max():
        return model
    b = [np.searchsorted(c, x[:, i], "right") for i, c in enumerate(cuts)]
    z = np.full(len(y), base)

    def slopes():
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for i, table in enumerate(main):
            if len(table) > 1:
                g, h = slopes()
                step = rate * _cut(np.bincount(b[i], g, len(table)), np.bincount(b[i], h, len(table)), leaves, strength)
                table += step
                z += step[b[i]]
    c = [coarse[i][b[i]] for i in range(width)]
    g, h = slopes()

    def quadrants(i: int, j: int, g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        """The best tree with one cut in each direction: its worth and its values."""
        key = c[i] * pair_bins + c[j]
        G = np.bincount(key, g, pair_bins**2).reshape(pair_bins, pair_bins)
        H = np.bincount(key, h, pair_bins**2).reshape(pair_bins, pair_bins)
        best = (0.0, np.zeros((pair_bins, pair_bins)))
        for a in range(1, pair_bins):
            for k in range(1, pair_bins):
                parts = [(slice(0, a), slice(0, k)), (slice(0, a), slice(k, None)), (slice(a, None), slice(0, k)), (slice(a, None), slice(k, None))]
                sums = [(G[q].sum(), H[q].sum()) for q in parts]
                worth = sum(u * u / (v + strength) for u, v in sums)
                if worth > best[0] + 1e-12:
                    table = np.zeros((pair_bins, pair_bins))
                    for q, (u, v) in zip(parts, sums, strict=True):
                        table[q] = u / (v + strength)
                    best = (worth, table)
        return best

    ranked = sorted(((-quadrants(i, j, g, h)[0], i, j) for i, j in combinations(range(width), 2)))[:pairs]
    model.pairs = [(i, j, np.zeros((pair_bins, pair_bins))) for _, i, j in ranked]
    for _ in range(rounds // 4):
        for i, j, table in model.pairs:
            step = rate * quadrants(i, j, *slopes())[1]
            table += step
            z += step[c[i], c[j]]
    return model


def train(documents: DataFrame, labels: DataFrame, test=None, most: int = TRAIN, label: str = "quality") -> Gam:
    """Learn from at most `most` labelled documents outside test; the driver gathers one row of figures for each."""
    rows = training_rows(documents, labels, label, F.lit(False) if test is None else test, most)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(list(figures(part.column("text"))), pa.list_(pa.float64()))], names=["y", "x"])

    got = rows.mapInArrow(measure, "y int, x array<double>").toPandas()
    x = np.array([np.asarray(v) for v in got.x]).reshape(len(got), len(FIGURES))
    y = got.y.to_numpy(np.float64)
    order = np.lexsort((y, *x.T[::-1]))  # the order that rows arrive in mustn't matter
    return fit(x[order], y[order])


def quality(documents: DataFrame, model: Gam, text: str = "text") -> DataFrame:
    """documents with score, the likelihood of label 1, added."""
    held = documents.sparkSession.sparkContext.broadcast(model)
    docs = boxed(documents, ["score"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in with_text(batches, text):
            for part in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(held.value.score(figures(part.column("text"))))], names=["doc", "score"])

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])).select("doc.*", "score")


#: From this score on a document counts as good.
ACCEPT = 0.3


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out("doc_id", 5, 0))
    return quality(docs, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
