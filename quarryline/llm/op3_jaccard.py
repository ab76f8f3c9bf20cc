"""N-gram Jaccard join with Bayesian candidate pruning.

Texts become sets of 5-word shingles; equal sets are one class, of which one text goes on. Classes
that share a band of MinHash values are candidates. For each candidate pair the MinHash values are
compared a step at a time; a pair is dropped as soon as the posterior probability that its similarity
reaches the threshold, given the agreements so far and a uniform prior, is below a tolerance. The rest
is verified on the exact shingle sets. Links are counted, and grouped into connected components.

Candidates are never written as pairs: bands only connect each class to the smallest one of its
bucket, the components of that graph bound the work, and a component is searched in blocks of bounded
size, block against block where it is large.

A link is missed if its texts share no band, (1 - t**ROWS)**BANDS = 7e-6 at the threshold t = 0.8 and
less above, or if it is pruned although it is one (TOLERANCE). Classes are known by 64-bit hashes.

Defined results: words are what ASCII white space separates, unchanged; a text of 1 to 4 words is one
shingle; null, empty and blank texts have no shingle, no link and a class of their own each; repeated
rows are exact copies of each other; among rows with a null doc_id, a class is named by its smallest
doc_id that isn't null, if any; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import components, parallelism, written
from .wordhash import SPACED, grams, mix, pieces, utf8, words

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS, STEP, TOLERANCE = 30, 5, 30, 1e-6
#: Texts, and bytes of text, in one block of a component.
BLOCK_TEXTS, BLOCK_BYTES = 1500, 24 << 20


def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    seed = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seed[:n] | np.uint64(1), seed[n:]


def shingles(column: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Different shingle hashes, sorted within each text, and n + 1 offsets into them."""
    data, off = utf8(column)
    h, _, _, woff = words(data, off, SPACED)
    n = np.diff(woff)
    count = np.where(n > 0, np.maximum(n - k + 1, 1), 0)
    text = np.repeat(np.arange(len(n)), count)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(woff[:-1], count)
    out = np.zeros(len(start), np.uint64)
    full = np.repeat(n >= k, count)
    if full.any():
        out[full] = grams(h, k)[start[full]]
    for j in range(1, k):
        if len(some := np.flatnonzero(np.repeat(n == j, count))):
            out[some] = grams(h, j)[start[some]]
    order = np.lexsort((out, text))
    out, text = out[order], text[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (text[1:] != text[:-1])
    out, text = out[new], text[new]
    return out, np.searchsorted(text, np.arange(len(n) + 1))


def class_keys(sets: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 63-bit hash of each set (of no meaning for empty ones)."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(sets ^ np.uint64(0xA5A5A5A5)))])
    more = np.concatenate([[np.uint64(0)], np.cumsum(mix(sets + np.uint64(77)))])
    return (mix((sums[off[1:]] - sums[off[:-1]]) ^ mix((more[off[1:]] - more[off[:-1]]) + np.diff(off).astype(np.uint64))) >> np.uint64(1)).astype(np.int64)


def minhashes(sets: np.ndarray, off: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """n 32-bit MinHash values of each set that isn't empty, by row."""
    a, b = _factors(n)
    starts = off[:-1][np.diff(off) > 0]
    out = np.empty((len(starts), n), np.uint32)
    for j in range(n) if len(starts) else ():
        out[:, j] = np.minimum.reduceat(((sets * a[j] + b[j]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def least_agreements(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, step: int = STEP, n: int = BANDS * ROWS) -> list[tuple[int, int]]:
    """[(values compared, agreements below which a pair is dropped)].

    With a uniform prior, m agreements of k leave a Beta(m + 1, k - m + 1) posterior; its mass from
    the threshold on is the chance that k + 1 draws of that probability succeed at most m times.
    """
    out = []
    for k in range(step, n + 1, step):
        mass, m = 0.0, 0
        while True:
            mass += comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
            if mass >= tolerance:
                break
            m += 1
        out.append((k, m))
    return out


def links_in_block(sig: np.ndarray, sets: list[np.ndarray], copies: np.ndarray, side: np.ndarray | None, threshold: float, rule: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(copies linked to each text, smallest text that each is connected to), among all pairs or, with side, those of side 0 with side 1."""
    n, bands = len(sig), sig.shape[1] // ROWS
    band = np.ascontiguousarray(sig[:, : bands * ROWS]).reshape(n, bands, ROWS)
    band = grams(band.reshape(-1).astype(np.uint64), ROWS)[:: ROWS].reshape(n, bands)
    size = np.array([len(s) for s in sets])
    linked, root = np.zeros(n, np.int64), np.arange(n)

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    post = None
    for a in range(n - 1):
        others = np.arange(a + 1, n)
        if side is not None:
            others = others[side[others] != side[a]]
        others = others[np.minimum(size[others], size[a]) >= threshold * np.maximum(size[others], size[a]) - 1e-9]
        others = others[(band[others] == band[a]).any(axis=1)]
        agree, before = np.zeros(len(others), np.int64), 0
        for k, least in rule:
            if not len(others):
                break
            agree += (sig[others, before:k] == sig[a, before:k]).sum(axis=1)
            keep = agree >= least
            others, agree, before = others[keep], agree[keep], k
        if not len(others):
            continue
        if len(others) > 8:
            if post is None:  # the texts that hold each shingle
                every = np.concatenate(sets)
                _, name = np.unique(every, return_inverse=True)
                order = np.argsort(name, kind="stable")
                holder = np.repeat(np.arange(n), size)[order]
                ends = np.cumsum(np.bincount(name))
                post = (name, np.concatenate([[0], np.cumsum(size)]), holder, ends)
            name, at, holder, ends = post
            own = name[at[a] : at[a + 1]]
            lo = np.where(own > 0, ends[own - 1], 0)
            times = ends[own] - lo
            rows = holder[np.repeat(lo - np.cumsum(times) + times, times) + np.arange(times.sum())]
            common = np.bincount(rows, minlength=n)[others]
        else:
            common = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for b in others])
        good = others[common >= threshold * (size[a] + size[others] - common) - 1e-9]
        if len(good):
            linked[a] += copies[good].sum()
            linked[good] += copies[a]
            for b in good.tolist():
                x, y = top(a), top(b)
                if x != y:
                    root[max(x, y)] = min(x, y)
    return linked, np.array([top(i) for i in range(n)])


def row_key(doc_id: str, text: str) -> Column:
    """A hash of a row's id and text: equal rows share it."""
    return F.xxhash64(doc_id, text)


def jaccard_classes(documents: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text", block_texts: int = BLOCK_TEXTS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, class_id, copy_id, n_links, row_key, class_key) for every row.

    copy_id: smallest doc_id with the same shingle set; class_id: smallest doc_id of those connected
    by links; n_links: other rows whose similarity is the threshold or more, exact copies among them;
    row_key: ``row_key`` of the row; class_key: that of the row that stands for its class, null for a
    text without words.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("row_key", row_key("doc_id", "text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                sets, off = shingles(part.column("text"))
                some = np.diff(off) > 0
                sig = np.empty(part.num_rows, object)
                sig[:] = None
                sig[some] = [r.tobytes() for r in minhashes(sets, off)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row_key"), pa.array(class_keys(sets, off), mask=~some), pa.array(np.diff(utf8(part.column("text"))[1])), pa.array(sig.tolist(), pa.binary())], names=["doc_id", "row_key", "cls", "bytes", "sig"])

    signed = written(docs.mapInArrow(sign, f"doc_id {kind}, row_key long, cls long, bytes long, sig binary").withColumn("r", F.monotonically_increasing_id()), "jaccard-signed")
    named_row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")  # null ids come last
    classes = written(signed.where("cls is not null").groupBy("cls").agg(F.min(named_row).alias("copy"), F.count("*").alias("copies"), F.max("bytes").alias("bytes"), F.first("sig").alias("sig")), "jaccard-classes")
    buckets = classes.select("cls", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.expr("sig").substr(b * 4 * ROWS + 1, F.lit(4 * ROWS))))).alias("bucket"))
    least = buckets.groupBy("bucket").agg(F.min("cls").alias("least"), F.max("cls").alias("most")).where("least < most").select("bucket", "least")
    groups = components(buckets.join(least, "bucket").where("cls <> least").select(F.col("cls").alias("u"), F.col("least").alias("v")))
    members = written(groups.withColumnRenamed("node", "cls").join(classes, "cls"), "jaccard-members")
    size = members.groupBy("component").agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).withColumn("blocks", F.greatest(F.ceil(F.col("n") / block_texts), F.ceil(F.col("b") / block_bytes)).cast("int"))
    total = members.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    bins = max(parallelism(spark), -(-total[0] // block_texts), -(-total[1] // block_bytes))
    placed = members.join(size.select("component", "blocks"), "component").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    # a small component is searched in one bin with others, a large one block against block
    cells = F.when(F.col("blocks") == 1, F.array(F.struct(F.pmod(F.xxhash64("component"), F.lit(bins)).alias("g"), F.lit(-1).alias("i"), F.lit(-1).alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.col("component").alias("g"), F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")))
    )
    # one text for each class, by the key of its row; equal rows are one before they travel
    wanted = placed.select(F.col("copy.row_key").alias("row_key")).distinct()
    texts = docs.join(wanted, "row_key", "left_semi").groupBy("row_key").agg(F.first("text").alias("text"))
    work = placed.withColumn("row_key", F.col("copy.row_key")).join(texts, "row_key").select("component", "cls", "copies", "sig", "text", "block", F.explode(cells).alias("cell")).select("*", "cell.*").drop("cell")
    rule = least_agreements(threshold)

    def search(df: pd.DataFrame) -> pd.DataFrame:
        sets, off = shingles(pa.array(df["text"], pa.string()))
        true = class_keys(sets, off) == df["cls"].to_numpy()
        df = df.assign(_row=np.arange(len(df)))[true].drop_duplicates("cls").sort_values(["component", "cls"])
        out = []
        for _, part in df.groupby("component", sort=False):
            rows = part["_row"].to_numpy()
            i, j = int(part["i"].iat[0]), int(part["j"].iat[0])
            sig = np.stack([np.frombuffer(x, np.uint32) for x in part["sig"]])
            linked, root = links_in_block(sig, [sets[off[r] : off[r + 1]] for r in rows], part["copies"].to_numpy(), part["block"].to_numpy() if i != j else None, threshold, rule)
            cls = part["cls"].to_numpy()
            some = linked > 0
            out.append(pd.DataFrame({"cls": cls[some], "root": cls[root[some]], "links": linked[some]}))
        return pd.concat(out) if out else pd.DataFrame({"cls": [], "root": [], "links": []}).astype("int64")

    found = written(work.groupBy("g", "i", "j").applyInPandas(search, "cls long, root long, links long"), "jaccard-links")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("cls").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "cls")
    named = joined.join(classes.select("cls", "copy"), "cls").groupBy("component").agg(F.min("copy").alias("class"))
    of_class = joined.join(named, "component").select("cls", "class").join(links, "cls")
    # a class of very many copies is dealt over salts; at most total / share classes have more than one
    total = signed.count()
    share = max(500, -(-total // parallelism(spark)))
    salts = F.ceil(F.col("copies") / share).cast("int")
    info = classes.select("cls", "copy", "copies").join(of_class, "cls", "left").select("cls", "copy", F.coalesce("class", "copy").alias("class"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    hot = classes.where(F.col("copies") > share).select("cls", salts.alias("salts"))
    rows = signed.select("doc_id", "row_key", "cls", "r").join(F.broadcast(hot), "cls", "left").withColumn("salt", F.pmod(F.xxhash64("r"), F.coalesce("salts", F.lit(1))).cast("int"))
    own = F.when(F.col("cls").isNull(), F.col("doc_id"))
    return rows.join(info, ["cls", "salt"], "left").select(
        "doc_id", F.coalesce("class.doc_id", own).alias("class_id"), F.coalesce("copy.doc_id", own).alias("copy_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "row_key", F.col("class.row_key").alias("class_key")
    )


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row_key", "class_key")
