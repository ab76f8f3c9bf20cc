"""Toxicity by multiple-instance learning.

A document is a bag of sentences (what stands between full stops, exclamation and question marks and
line ends). A logistic model over hashed words and word beginnings scores each sentence; a document
is toxic unless every sentence is clean (noisy-or), and the likelihood of the document labels
trains the sentence weights. The same weights then point out the offending sentences.

Scores are calibrated on the training rows alone: of scores that FOLDS models give to rows they didn't
learn from, the threshold with the best F1 is moved to REJECT, by one factor on the odds.

The training sample is bounded: TRAIN labelled documents. So is the model: FEATURES words and word
beginnings, those that tell most in the sample. Scoring reads every whole text.

Defined results: null and empty texts and texts without a word score 0; rows are scored each by
itself (repeated rows alike); without any label, or with labels of one kind only, every document
scores 0 or that kind's share, as there is nothing to tell them apart by; other columns pass through
``toxicity`` untouched, but for those named like its results, which are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labelled import held_out, training_rows
from .shared import boxed, release, with_text, written
from .wordhash import ALNUM_LOW, pieces, utf8, words

#: Labelled documents that are learned from, at most, and features that get a weight.
TRAIN, FEATURES = 12_000, 4096
#: Models for the calibration; rounds and decay were chosen by folds inside the training rows.
FOLDS, ROUNDS, DECAY = 3, 150, 2e-3
#: From this score on a document counts as toxic.
REJECT = 0.7
PREFIXES = (4, 5, 6)
_END = np.zeros(256, bool)
_END[list(b".!?\n")] = True


def bags(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of texts into sentences, feature hashes by kind (one for each word), the sentence of each word, and each sentence's first and end byte; then the texts' bytes."""
    data, off = utf8(column)
    h, s, e, woff, *heads = words(data, off, ALNUM_LOW, PREFIXES)
    ends = np.cumsum(_END[data], dtype=np.int64)
    text = np.repeat(np.arange(len(off) - 1), np.diff(woff))
    key = ends[s] + text if len(s) else np.zeros(0, np.int64)  # a new text begins a new sentence too
    new = np.empty(len(key), bool)
    if len(key):
        new[0], new[1:] = True, (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    sentence = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    soff = np.searchsorted(text[first], np.arange(len(off)))
    return soff, [h, *heads], sentence, s[first], e[np.append(first[1:], len(key)) - 1] if len(first) else first, data


class Model:
    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float, odds: float = 1.0):
        order = np.argsort(features)
        self.features, self.weights, self.bias, self.odds = features[order], weights[order], bias, odds
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[(self.features >> np.uint64(46)).astype(np.int64)] = True

    def sentences(self, kinds: list[np.ndarray], sentence: np.ndarray, n: int) -> np.ndarray:
        """Probability of each of n sentences; a feature counts once in a sentence."""
        where, what = [], []
        for h in kinds:
            at = np.flatnonzero(self.maybe[(h >> np.uint64(46)).astype(np.int64)])
            k = np.minimum(np.searchsorted(self.features, h[at]), max(len(self.features) - 1, 0))
            ok = self.features[k] == h[at] if len(self.features) else np.zeros(len(at), bool)
            where.append(sentence[at[ok]])
            what.append(k[ok])
        pair = np.unique(np.concatenate(where) * max(1, len(self.features)) + np.concatenate(what))
        z = np.full(n, self.bias)
        if len(pair):
            np.add.at(z, pair // len(self.features), self.weights[pair % len(self.features)])
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


    def calibrated(self, p: np.ndarray) -> np.ndarray:
        """p with its odds multiplied; 0 and 1 stay."""
        return p * self.odds / (1 - p + p * self.odds)


def noisy_or(p: np.ndarray, soff: np.ndarray) -> np.ndarray:
    """1 - product of (1 - p) over each text's sentences, each text by itself."""
    out, some = np.zeros(len(soff) - 1), np.diff(soff) > 0
    if some.any():
        out[some] = np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-12)), soff[:-1][some])
    return np.clip(-np.expm1(out), 0, 1)


def telling(hashed: DataFrame, docs: int, toxic: int, most: int = FEATURES) -> np.ndarray:
    """The most features, sorted, with the greatest log-likelihood ratio against the share of toxic documents, of those in 5 documents or more."""
    share = toxic / docs
    seen = hashed.select("y", F.explode(F.array_distinct("h")).alias("h")).groupBy("h").agg(F.sum("y").alias("a"), F.count("*").alias("n")).where("n >= 5")
    p = (F.col("a") + 0.5) / (F.col("n") + 1)
    gain = F.col("a") * F.log(p / share) + (F.col("n") - F.col("a")) * F.log((1 - p) / (1 - share))
    best = seen.select("h", gain.alias("gain")).where("gain > 2").orderBy(F.desc("gain"), F.col("h").bitwiseXOR(F.lit(-(2**63)))).limit(most)
    return np.sort(np.array([r.h for r in best.select("h").collect()], np.int64).view(np.uint64))


def gradient(w: np.ndarray, bias: float, soff: np.ndarray, row: np.ndarray, col: np.ndarray, y: np.ndarray, decay: float) -> np.ndarray:
    """Of the mean negative log-likelihood of the noisy-or and 50 * decay * |w|**2 / len(y), by weights and then bias."""
    doc_of = np.repeat(np.arange(len(y)), np.diff(soff))
    ps = 1 / (1 + np.exp(-np.clip(bias + np.bincount(row, w[col], len(doc_of)), -30, 30)))
    pd = np.clip(noisy_or(ps, soff), 1e-9, 1)
    g = np.where(y == 1, -(1 - pd) / pd, 1.0)[doc_of] * ps / len(y)
    return np.append(np.bincount(col, g[row], len(w)) + 100 * decay * w / len(y), g.sum())


def fit(names: np.ndarray, soff: np.ndarray, row: np.ndarray, col: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = 0.1, decay: float = DECAY) -> Model:
    """Weights by full-batch Adam on the noisy-or likelihood. row, col: sentence and feature, one of each for a feature in a sentence."""
    w, bias = np.zeros(len(names)), -5.0
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for t in range(1, rounds + 1):
        grad = gradient(w, bias, soff, row, col, y, decay)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    return Model(names, w, float(bias))


def best_threshold(scores: np.ndarray, y: np.ndarray) -> float:
    """That of the best F1, halfway to the next score below."""
    order = np.argsort(-scores, kind="stable")
    s, hit = scores[order], np.cumsum(y[order])
    f = 2 * hit / (np.arange(1, len(s) + 1) + y.sum())
    f[:-1][s[1:] == s[:-1]] = 0  # equal scores fall on one side
    k = int(np.argmax(f))
    return float((s[k] + (s[k + 1] if k + 1 < len(s) else 0)) / 2)


def calibration(names: np.ndarray, soff: np.ndarray, row: np.ndarray, col: np.ndarray, y: np.ndarray, fold: np.ndarray) -> float:
    """The factor on the odds that takes the best threshold of held-out folds to REJECT. A fold's model has those of the features that tell in its own rows."""
    scores, doc_of = np.zeros(len(y)), np.repeat(np.arange(len(y)), np.diff(soff))
    pairs = np.unique(doc_of[row] * len(names) + col) if len(names) else np.zeros(0, np.int64)
    for k in np.unique(fold):
        own, rest = fold != k, fold == k
        if not 0 < y[own].sum() < own.sum():
            return 1.0
        d, c = pairs // len(names), pairs % len(names)
        n, a = np.bincount(c[own[d]], minlength=len(names)), np.bincount(c[own[d]], y[d[own[d]]], len(names))
        share, p = y[own].mean(), (a + 0.5) / (n + 1)
        tells = (n >= 5) & (a * np.log(p / share) + (n - a) * np.log((1 - p) / (1 - share)) > 2)
        for half in (own, rest):
            keep, number = tells[col] & half[doc_of[row]], np.cumsum(half[doc_of]) - 1
            part = np.concatenate([[0], np.cumsum(np.diff(soff)[half])]), number[row[keep]], col[keep]
            if half is own:
                model = fit(names, *part, y[own])
            else:
                z = model.bias + np.bincount(part[1], model.weights[part[2]], int(part[0][-1]))
                scores[rest] = noisy_or(1 / (1 + np.exp(-np.clip(z, -60, 60))), part[0])
    t = min(max(best_threshold(scores, y), 1e-6), 1 - 1e-6)
    return REJECT / (1 - REJECT) * (1 - t) / t


def train(documents: DataFrame, labels: DataFrame, test=None, most: int = TRAIN, label: str = "toxic") -> Model:
    """Learn from at most `most` labelled documents outside test. Executors turn texts into hashes and count them; the driver gathers those of the chosen features alone, which the sample bounds."""
    rows = training_rows(documents, labels, label, F.lit(False) if test is None else test, most)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                soff, kinds, sentence, *_ = bags(part.column("text"))
                span = np.searchsorted(sentence, soff)
                out = []
                for d in range(part.num_rows):
                    a, z = span[d], span[d + 1]
                    pair = np.unique(np.concatenate([np.stack([(sentence[a:z] - soff[d]).astype(np.uint64), h[a:z]]) for h in kinds], axis=1), axis=1)
                    out.append((pair[0].astype(np.int32), pair[1].view(np.int64), int(soff[d + 1] - soff[d])))
                yield pa.RecordBatch.from_arrays([part.column("y"), *(pa.array([x[i] for x in out], t) for i, t in enumerate((pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64())))], names=["y", "s", "h", "n"])

    bagged = written(rows.mapInArrow(hashed, "y int, s array<int>, h array<long>, n long"), "toxicity-bags")
    docs, toxic = bagged.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if toxic in (0, docs) or not bagged.where(F.size("h") > 0).head(1):
        return Model(np.zeros(0, np.uint64), np.zeros(0), -60.0 if not docs or 2 * toxic < docs else 60.0)
    names = telling(bagged, docs, toxic)
    held = documents.sparkSession.sparkContext.broadcast(names)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = held.value
        for batch in batches:
            out = []
            for s, h in zip(batch.column("s"), batch.column("h"), strict=True):
                s, h = s.values.to_numpy(zero_copy_only=False), h.values.to_numpy(zero_copy_only=False).view(np.uint64)
                k = np.minimum(np.searchsorted(names, h), max(len(names) - 1, 0))
                ok = names[k] == h if len(names) else np.zeros(len(h), bool)
                out.append((s[ok].astype("<u4").tobytes(), k[ok].astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("y"), *(pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)), batch.column("n")], names=["y", "s", "k", "n"])

    model = _learned(names, bagged.mapInArrow(chosen, "y int, s binary, k binary, n long"))
    release()
    return model


def _learned(names: np.ndarray, rows: DataFrame) -> Model:
    """Fits and calibrates on the rows (y, s, k, n) of the bounded sample; numbers of sentences and features are 32 bits."""
    got = sorted((bytes(r.k), bytes(r.s), r.n, r.y) for r in rows.toLocalIterator())  # the order that rows arrive in mustn't matter
    soff = np.concatenate([[0], np.cumsum([n for _, _, n, _ in got])]).astype(np.int64)
    row, col = np.empty(sum(len(s) for _, s, _, _ in got) // 4, np.int32), np.empty(sum(len(k) for k, *_ in got) // 4, np.int32)
    at = 0
    for (k, s, _, _), a in zip(got, soff, strict=False):
        row[at : at + len(s) // 4] = np.frombuffer(s, "<u4").astype(np.int64) + a
        col[at : at + len(k) // 4] = np.frombuffer(k, "<u4")
        at += len(s) // 4
    y, fold = np.array([y for *_, y in got], np.int64), np.array([zlib.crc32(k) % FOLDS for k, *_ in got])  # copies share a fold
    del got
    model = fit(names, soff, row, col, y)
    model.odds = calibration(names, soff, row, col, y, fold)
    return model


RESULT = [("score", "double"), ("sentences", "array<struct<start:long,end:long,score:double>>")]


def toxicity(documents: DataFrame, model: Model, text: str = "text", offending: float = 0.5) -> DataFrame:
    """documents with score and sentences (code points and scores of the sentences from `offending` on) added."""
    held = documents.sparkSession.sparkContext.broadcast(model)
    names = [x for x, _ in RESULT]
    docs = boxed(documents, names)
    schema = T.StructType(docs.schema.fields + T.StructType.fromDDL(", ".join(f"{a} {t}" for a, t in RESULT)).fields)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in with_text(batches, text):
            for part in pieces(batch, "text", 1 << 20):
                soff, kinds, sentence, first, end, data = bags(part.column("text"))
                raw = model.sentences(kinds, sentence, len(first))
                p = model.calibrated(raw)
                found: list = [[] for _ in range(part.num_rows)]
                if len(bad := np.flatnonzero(p >= offending)):
                    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    doc = np.searchsorted(soff, bad, "right") - 1
                    base = points[utf8(part.column("text"))[1][doc]]
                    for d, a, z, x in zip(doc.tolist(), (points[first[bad]] - base).tolist(), (points[end[bad]] - base).tolist(), p[bad].tolist(), strict=True):
                        found[d].append({"start": a, "end": z, "score": x})
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(model.calibrated(noisy_or(raw, soff))), pa.array(found, kind)], names=["doc", *(x for x, _ in RESULT)])

    return docs.mapInArrow(score, schema).select("doc.*", *(x for x, _ in RESULT))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out("doc_id", 3, 1))
    spans = F.array_join(F.transform("sentences", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return toxicity(docs, model).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"), spans.alias("sentences"))
