"""Retrieval: exact vector and BM25 top-k, reciprocal rank fusion, boosts, and the per-document cap (sections 2.3 to 2.5).

Ranked lists are DataFrames with chunk_id, doc_id, score. Scores are rounded to SCORE_DIGITS before they
are ranked, so that equal scores tie whatever the order of summation (N12).
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..sources.scratch import written

SCORE_DIGITS = 6
#: Ranks of the second list come after those of the first; no list has so many rows.
AFTER = 1 << 40


def ranked(df: DataFrame, limit: int, *more: str) -> DataFrame:
    """The best rows by score, then chunk_id, with their rank from 1. The limit is taken before the window, so the window sees few rows."""
    best = df.orderBy(F.desc("score"), *more, "chunk_id").limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), *more, "chunk_id")))


def vector_top(chunks: DataFrame, query: list[float], limit: int = 20, threshold: float = 0.35, halved: bool = False) -> DataFrame:  # V1, V2, P13, W1
    """chunks: chunk_id, embedding and any more, which stay. The query is a literal, so the scan is one narrow stage that keeps `limit` rows a task."""
    q = F.array(*(F.lit(float(x)) for x in query))
    score = F.round(V.similarity(1 - V.cosine(F.col("embedding"), q), halved), SCORE_DIGITS)
    return ranked(chunks.withColumn("score", score).drop("embedding").where(F.col("score") >= threshold), limit)


def vector_threshold(config: Column) -> Column:  # P13
    return F.coalesce(config["search"]["vector_threshold"], config["router"]["vector_threshold"], F.lit(0.35))


#: Postings that one task sorts and writes: their partitions grow with the index, and a task's memory doesn't.
POSTINGS_A_TASK = 1_000_000


def counted(words: Column) -> Column:
    """array<struct<term, tf>> of an array of words: sorted, equal ones stand together, so a text's words are counted in its row."""

    def runs(s: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        tf = lambda at, i, k: F.coalesce(F.get(at, k + 1), F.size(s)) - i
        return X.bound(begins, lambda at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("term"), tf(at, i, k).cast("long").alias("tf"))))

    return X.bound(F.sort_array(words), lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(F.array().cast("array<struct<term:string,tf:bigint>>")))


def counted_words(chunks: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, len, counts), a row a chunk, written: texts are split once."""
    words = chunks.select("chunk_id", "doc_id", X.tokens(F.col("text")).alias("w"))
    return written(words.select("chunk_id", "doc_id", F.size("w").alias("len"), counted(F.col("w")).alias("counts")), "words")


def postings(words: DataFrame) -> DataFrame:
    """(term, chunk_id, doc_id, len, tf) of what ``counted_words`` wrote: nothing is shuffled."""
    return words.select("chunk_id", "doc_id", "len", F.explode("counts").alias("x")).select("x.term", "chunk_id", "doc_id", "len", "x.tf")


def dealt(rows: DataFrame, n: int) -> DataFrame:
    """n postings dealt by ranges of term and chunk, and in order."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, n // POSTINGS_A_TASK + 1)
    return rows.repartitionByRange(parts, "term", "chunk_id").sortWithinPartitions("term", "chunk_id")


def lexical_index(chunks: DataFrame, path: str) -> None:
    """Postings and corpus statistics of chunks (chunk_id, doc_id, text), written once to be searched often.

    Postings are dealt by ranges of term and chunk, so a very common term spreads over files, and the
    files and row groups of other terms are skipped when a few terms are read.
    """
    words = counted_words(chunks)
    words.agg(F.count("*").alias("n"), F.avg("len").alias("mean")).write.mode("overwrite").parquet(f"{path}/stats")
    n = words.agg(F.sum(F.size("counts"))).first()[0] or 0
    dealt(postings(words), n).write.mode("overwrite").parquet(f"{path}/postings")


def bm25_of_index(spark: SparkSession, path: str, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:  # L1, L2
    """As ``bm25_scores``, from what ``lexical_index`` wrote: only the postings of the terms are read."""
    tf = spark.read.parquet(f"{path}/postings").where(F.col("term").isin(sorted(set(terms))))
    return _bm25(tf, spark.read.parquet(f"{path}/stats"), k1, b)


def bm25_scores(chunks: DataFrame, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:  # L1, L2
    """Okapi BM25 over chunks (chunk_id, doc_id, text) for a few query terms, without an index.

    Only the query's terms leave the scan, so what is shuffled is their postings; corpus size and mean
    length are a second scan, and the terms' document counts a third.
    """
    want = sorted(set(terms))
    words = chunks.select("chunk_id", "doc_id", X.tokens(F.col("text")).alias("w"))
    stats = words.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("mean"))
    hit = words.select("chunk_id", "doc_id", F.size("w").alias("len"), F.explode(F.filter("w", lambda t: t.isin(want))).alias("term"))
    return _bm25(hit.groupBy("term", "chunk_id", "doc_id", "len").agg(F.count("*").alias("tf")), stats, k1, b)


def _bm25(tf: DataFrame, stats: DataFrame, k1: float, b: float) -> DataFrame:
    df = tf.groupBy("term").agg(F.count("*").alias("df"))  # one row for each query term
    part = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    # stats is one row and df one row for each of the query's terms: both sizes are bounded
    scored = tf.join(F.broadcast(df), "term").join(F.broadcast(stats))
    return scored.groupBy("chunk_id", "doc_id").agg(F.round(F.sum(part), SCORE_DIGITS).alias("score"))


def bm25_top(scores: DataFrame, limit: int = 20, min_score: float = 0.1) -> DataFrame:  # L1, L4, P14
    return ranked(scores.where(F.col("score") >= min_score), limit, "doc_id")


def settled(results: DataFrame) -> DataFrame:
    """A ranked list, of `limit` rows at most, computed once and held as a local relation (by way of Arrow, so the planner knows its size), however often what follows uses it."""
    return results.sparkSession.createDataFrame(results.toArrow(), results.schema)


def settled_together(*lists: Callable[[], DataFrame]) -> list[DataFrame]:
    """Several ranked lists made and settled at once: they don't depend on each other, so their jobs share the cluster, those that their plans need too."""
    with ThreadPoolExecutor(len(lists)) as pool:
        return list(pool.map(lambda make: settled(make()), lists))


# Words too general to boost a metadata chunk.
GENERIC_WORDS = ["paper", "published", "all", "know"]


def metadata_boost(scored: DataFrame, metadata: DataFrame, terms: list[str], base: float = 0.01) -> DataFrame:  # L3
    """Chunks whose metadata text holds a specific query word score base at least. metadata: chunk_id, doc_id, text."""
    specific = [t for t in terms if t not in GENERIC_WORDS]
    hit = metadata.where(F.arrays_overlap(X.tokens(F.col("text")), F.array(*map(F.lit, specific)))).select("chunk_id", "doc_id") if specific else metadata.limit(0).select("chunk_id", "doc_id")
    joined = scored.join(hit.withColumn("hit", F.lit(True)), ["chunk_id", "doc_id"], "full_outer")
    return joined.select("chunk_id", "doc_id", F.when(F.col("hit"), F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(base))).otherwise(F.col("score")).alias("score"))


def rrf(vector: DataFrame, lexical: DataFrame, k: int = 60) -> DataFrame:  # F1, J7
    """(chunk_id, doc_id, score, vector_score, bm25_score, ins). ins is the order in which ties stay: vector results by rank, then the others by rank."""
    null = F.lit(None)
    v = vector.select("chunk_id", "doc_id", F.col("score").alias("vector_score"), null.cast("double").alias("bm25_score"), F.col("rank").alias("rv"), null.cast("int").alias("rb"))
    b = lexical.select("chunk_id", "doc_id", null.cast("double").alias("vector_score"), F.col("score").alias("bm25_score"), null.cast("int").alias("rv"), F.col("rank").alias("rb"))
    share = lambda r: F.coalesce(1.0 / (k + F.col(r)), F.lit(0.0))
    # a list names a chunk once, so a group has a row of each at most; grouping shuffles once where a full join shuffles both sides
    both = v.unionByName(b).groupBy("chunk_id").agg(*(F.max(c).alias(c) for c in ("vector_score", "bm25_score", "rv", "rb")), F.min_by("doc_id", F.col("rv").isNull()).alias("doc_id"))
    return both.select("chunk_id", "doc_id", F.round(share("rv") + share("rb"), SCORE_DIGITS).alias("score"), "vector_score", "bm25_score", F.coalesce(F.col("rv"), F.col("rb") + AFTER).alias("ins"))


def recently_cited(messages: DataFrame, citations: DataFrame, last: int = 2) -> DataFrame:  # F2
    """(conversation_id, document_id) cited in each conversation's last assistant messages."""
    w = Window.partitionBy("conversation_id").orderBy(F.desc("created_at"), F.desc("message_id"))
    recent = messages.where("role = 'assistant'").withColumn("n", F.row_number().over(w)).where(F.col("n") <= last).select("message_id", "conversation_id")
    return citations.where("document_id is not null").join(recent, "message_id").select("conversation_id", "document_id").distinct()


def citation_boost(fused: DataFrame, cited: DataFrame, factor: float = 1.15) -> DataFrame:  # F3, J8
    """cited: document_id. The fused list has at most two limits' rows, so of the cited documents only those in it are kept."""
    flag = cited.select(F.col("document_id").alias("doc_id")).join(F.broadcast(fused.select("doc_id").distinct()), "doc_id", "left_semi").distinct().withColumn("cited", F.lit(True))
    return fused.join(flag, "doc_id", "left").withColumn("score", F.round(F.when(F.col("cited"), F.col("score") * factor).otherwise(F.col("score")), SCORE_DIGITS)).drop("cited")


def flat_aliases(topics: Column) -> Column:  # F5
    return F.flatten(F.transform(topics, lambda t: F.coalesce(t["aliases"], F.array().cast("array<string>"))))


def tag_matches(tags: Column, query: Column, aliases: Column) -> Column:  # F4, J10, Q9
    low = F.lower(query)
    return F.exists(tags, lambda t: F.contains(low, F.lower(t)) | F.exists(aliases, lambda a: F.contains(F.lower(a), F.lower(t))))


def tag_boost(fused: DataFrame, docs: DataFrame, query: str, aliases: list[str], factor: float = 1.075) -> DataFrame:  # F4, J9
    """docs: doc_id, tags. Adds tag_boosted (null where it doesn't apply); nothing happens without aliases."""
    if not aliases:
        return fused.withColumn("tag_boosted", F.lit(None).cast("boolean"))
    # the fused list has two limits' rows at most
    hit = docs.join(F.broadcast(fused.select("doc_id").distinct()), "doc_id", "left_semi").where(tag_matches(F.col("tags"), F.lit(query), F.array(*map(F.lit, aliases)))).select("doc_id").distinct().withColumn("tag_boosted", F.lit(True))
    return fused.join(hit, "doc_id", "left").withColumn("score", F.round(F.when(F.col("tag_boosted"), F.col("score") * factor).otherwise(F.col("score")), SCORE_DIGITS))


def cap_per_document(fused: DataFrame, most: int = 3) -> DataFrame:  # F6, W2
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "ins")
    return fused.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def hybrid(vector: DataFrame, lexical: DataFrame, cited: DataFrame | None = None, docs: DataFrame | None = None, query: str = "", aliases: list[str] = (), most: int = 3, limit: int = 12) -> DataFrame:  # F7, F8
    """Fusion, citation boost (only with a conversation's citations), tag boost, cap, first rows; with the final rank. The fused list is settled, as each boost looks at it twice."""
    fused = settled(rrf(vector, lexical))
    if cited is not None:
        fused = citation_boost(fused, cited)
    if docs is not None:
        fused = tag_boost(fused, docs, query, list(aliases))
    best = cap_per_document(fused, most).orderBy(F.desc("score"), "ins").limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "ins")))


def by_document(results: DataFrame) -> DataFrame:  # F9
    return results.groupBy("doc_id").agg(F.count("*").alias("n"), F.min_by("score", "rank").alias("first_score"))


def context_refs(results: DataFrame) -> DataFrame:  # F10
    """results: rank, doc_id, doc_title, section_path, text; adds ref and section."""
    section = F.when(F.coalesce("section_path", F.lit("")).isin("") | (F.col("section_path") == F.col("doc_title")), "Main Content").otherwise(F.col("section_path"))
    return results.withColumn("ref", F.concat(F.lit("doc_"), F.col("rank").cast("string"))).withColumn("section", section)


def context_text(results: DataFrame) -> DataFrame:  # one row, the blocks in order
    block = F.concat(F.lit("[Reference: ^"), "ref", F.lit(":"), "section", F.lit("]\nDocument: "), "doc_title", F.lit("\nSection: "), "section", F.lit("\n\n"), "text")
    return context_refs(results).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("context"))


def patent_url(doc_id: Column) -> Column:  # F12
    number = F.upper(F.regexp_extract(doc_id, r"(?i)^(us\d{7,}[a-z]?\d?)", 1))
    return F.when(number != "", F.concat(F.lit("https://patents.google.com/patent/"), number))


def centroid(vectors: DataFrame, key: str) -> DataFrame:  # V9 vector_avg
    """(key, dims, centroid): averaged by position, so no group is gathered."""
    means = vectors.select(key, F.posexplode("embedding").alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(key).agg(F.count("*").alias("dims"), F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def embed(chunks: DataFrame, embedder, text: str = "text", batch: int = 100) -> DataFrame:  # V3, V4
    """chunks with embedding; embedder: list of texts -> list of vectors, called for batches of `batch`. A failed batch is retried three times."""

    def run(frames):
        import time

        for df in frames:
            out: list = []
            for a in range(0, len(df), batch):
                for attempt in range(4):
                    try:
                        out += embedder(df[text].iloc[a : a + batch].tolist())
                        break
                    except Exception:
                        if attempt == 3:
                            raise
                        time.sleep(2**attempt)
            yield df.assign(embedding=out)

    return chunks.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields) + ", embedding array<float>")


def lsh_candidates(chunks: DataFrame, dimension: int, tables: int = 8, bits: int = 12, seed: int = 7) -> DataFrame:  # V10: approximate, never the exact path
    """(chunk_id, bucket): random-hyperplane buckets; rows that share one are candidates."""
    import random

    r = random.Random(seed)
    planes = [[[r.gauss(0, 1) for _ in range(dimension)] for _ in range(bits)] for _ in range(tables)]
    signs = [F.concat(F.lit(f"{t}:"), *(F.when(V.dot(F.col("embedding"), F.array(*map(F.lit, p))) > 0, "1").otherwise("0") for p in planes[t])) for t in range(tables)]
    return chunks.select("chunk_id", F.explode(F.array(*signs)).alias("bucket"))
