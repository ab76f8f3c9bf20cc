"""A lexical index that is kept up as its documents change (L1, L2), and trigram search over postings (L5).

The index is a folder of generations. Each holds postings dealt by ranges of term and chunk, and the
lengths of its chunks; a change also leaves marks that say which chunks ended with it. A posting is alive
unless a later generation ended its chunk. Nothing that was written is touched, so a reader sees the
generations that the manifest named when it began; compaction writes the live rows as one generation.

Scores are those of an index built anew: a term's document count comes from its live postings, and
corpus size and mean length from sums that each change corrects by the lengths of the chunks it ended.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.scratch import written
from .search import _bm25, counted_words, dealt, postings


def _generations(spark: SparkSession, path: str) -> tuple[int, list[int]]:
    """(latest version, its generations): the manifest of the highest version counts."""
    last = spark.read.parquet(f"{path}/manifest").orderBy(F.desc("version")).first()
    return last.version, list(last.generations)


def _publish(spark: SparkSession, path: str, version: int, generations: list[int]) -> None:
    """One row, appended last: until then readers see the index as it was."""
    spark.createDataFrame([(version, generations)], "version long, generations array<long>").coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def _store(rows: DataFrame, path: str, g: int, n: int) -> None:
    """rows: n postings (term, chunk_id, doc_id, tf, len)."""
    dealt(rows, n).write.parquet(f"{path}/postings/generation={g}")


def _one_each(words: DataFrame) -> DataFrame:
    """One row of each chunk_id, any one. Ids are shuffled to find those that come again; only rows of such go along."""
    again = written(words.groupBy("chunk_id").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("chunk_id").alias("_again")), "again")
    if again.isEmpty():
        return words
    same = F.col("chunk_id").eqNullSafe(F.col("_again"))
    return words.join(again, same, "left_anti").unionByName(words.join(again, same, "left_semi").dropDuplicates(["chunk_id"]))


def _add(chunks: DataFrame, path: str, g: int) -> DataFrame:
    """Writes postings and lengths of a generation, and returns its lengths (chunk_id, doc_id, len)."""
    words = _one_each(counted_words(chunks.withColumn("text", F.coalesce("text", F.lit("")))))
    words.select("chunk_id", "doc_id", "len").write.parquet(f"{path}/lengths/generation={g}")
    _store(postings(words), path, g, words.agg(F.sum(F.size("counts"))).first()[0] or 0)
    return chunks.sparkSession.read.parquet(f"{path}/lengths/generation={g}")


def _read(spark: SparkSession, path: str, kind: str, generations: list[int]) -> DataFrame | None:
    if not generations:
        return None
    return spark.read.option("basePath", f"{path}/{kind}").parquet(*(f"{path}/{kind}/generation={g}" for g in generations))


def _alive(rows: DataFrame, marks: DataFrame | None) -> DataFrame:
    """rows (with chunk_id, generation) that no later generation ended."""
    if marks is None:
        return rows
    last = marks.groupBy("chunk_id").agg(F.max("generation").alias("_ended"))
    return rows.join(last, "chunk_id", "left").where(F.col("_ended").isNull() | (F.col("_ended") <= F.col("generation"))).drop("_ended")


def create(chunks: DataFrame, path: str) -> None:
    """An index of chunks (chunk_id, doc_id, text) as its first generation. chunk_id names a chunk: a repeated one is a later version of it, of which any one stays."""
    spark = chunks.sparkSession
    sums = _add(chunks, path, 0).agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total"))
    sums.coalesce(1).write.parquet(f"{path}/sums/generation=0")
    spark.createDataFrame([], chunks.select("chunk_id").schema).write.parquet(f"{path}/marks/generation=0")
    _publish(spark, path, 0, [0])


def change(spark: SparkSession, path: str, upserts: DataFrame | None = None, removed: DataFrame | None = None) -> None:
    """One generation more: chunks put in or replaced (chunk_id, doc_id, text), and chunk_ids removed. A chunk in both is put in. Work is in proportion to the change, and to a look at the lengths of what is there."""
    version, generations = _generations(spark, path)
    g = version + 1
    lengths = _read(spark, path, "lengths", generations)
    ids = [df.select(F.col("chunk_id").cast(lengths.schema["chunk_id"].dataType)) for df in (upserts, removed) if df is not None]
    if not ids:
        return
    marks = written(reduce(DataFrame.unionByName, ids).where("chunk_id is not null").distinct(), "marks")
    gone = _alive(lengths, _read(spark, path, "marks", generations)).join(marks, "chunk_id", "left_semi")
    if upserts is None:
        upserts = lengths.select("chunk_id", "doc_id", F.lit("").alias("text")).limit(0)
    new = _add(upserts.where("chunk_id is not null").select("chunk_id", "doc_id", "text"), path, g)
    added = new.agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total"))
    lost = gone.agg((-F.count("*")).alias("n"), F.coalesce(-F.sum("len"), F.lit(0)).alias("total"))
    added.unionByName(lost).agg(F.sum("n").alias("n"), F.sum("total").alias("total")).coalesce(1).write.parquet(f"{path}/sums/generation={g}")
    marks.write.parquet(f"{path}/marks/generation={g}")
    _publish(spark, path, g, [*generations, g])


def live_postings(spark: SparkSession, path: str, terms: list[str] | None = None) -> DataFrame:
    """(term, chunk_id, doc_id, tf, len); with terms, other terms' row groups are skipped."""
    _, generations = _generations(spark, path)
    rows = _read(spark, path, "postings", generations)
    if terms is not None:
        rows = rows.where(F.col("term").isin(sorted(set(terms))))
    return _alive(rows, _read(spark, path, "marks", generations)).drop("generation")


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """One row: n, mean."""
    _, generations = _generations(spark, path)
    return _read(spark, path, "sums", generations).agg(F.sum("n").alias("n"), F.try_divide(F.sum("total"), F.sum("n")).alias("mean"))


def scores(spark: SparkSession, path: str, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:  # L1, L2
    """As ``bm25_scores`` over the chunks that are there now."""
    return _bm25(live_postings(spark, path, terms), corpus(spark, path), k1, b)


def compact(spark: SparkSession, path: str) -> None:
    """The live rows as one generation, without marks. Older generations stay for readers that began before; ``vacuum`` them when none is left."""
    version, generations = _generations(spark, path)
    g = version + 1
    marks = _read(spark, path, "marks", generations)
    _store(live_postings(spark, path), path, g, _read(spark, path, "postings", generations).count())
    _alive(_read(spark, path, "lengths", generations), marks).drop("generation").write.parquet(f"{path}/lengths/generation={g}")
    spark.read.parquet(f"{path}/lengths/generation={g}").agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total")).coalesce(1).write.parquet(f"{path}/sums/generation={g}")
    spark.createDataFrame([], marks.select("chunk_id").schema).write.parquet(f"{path}/marks/generation={g}")
    _publish(spark, path, g, [g])


def vacuum(spark: SparkSession, path: str) -> None:
    """Deletes generations that the latest manifest doesn't name, through the store's own file system."""
    _, generations = _generations(spark, path)
    jvm = spark._jvm
    for kind in ("postings", "lengths", "sums", "marks"):
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}")
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        for f in fs.listStatus(folder):
            if f.getPath().getName() not in {f"generation={g}" for g in generations}:
                fs.delete(f.getPath(), True)


# --- trigrams ------------------------------------------------------------------------------------


#: Longs of a set's signature, and pairs that one task looks at.
SIGNATURE, PAIRS_A_TASK = 8, 500_000


def _signed(rows: DataFrame) -> DataFrame:
    """rows (with grams) with codes (each trigram's three characters as one number) and a signature, s0 to s7: the bit of each code's hash is set."""
    at = lambda g, i: F.ascii(g.substr(i, 1)).cast("long")
    rows = rows.withColumn("codes", F.transform("grams", lambda g: at(g, 1) * (1 << 42) + at(g, 2) * (1 << 21) + at(g, 3)))
    rows = rows.withColumn("_bits", F.transform("codes", lambda c: F.pmod(F.xxhash64(c), F.lit(64 * SIGNATURE)).cast("int")))
    one = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b % 64)
    word = lambda j: F.aggregate("_bits", F.lit(0).cast("long"), lambda a, b: F.when((b >= 64 * j) & (b < 64 * j + 64), a.bitwiseOR(one(b))).otherwise(a))
    return rows.select("*", *(word(j).alias(f"s{j}") for j in range(SIGNATURE))).drop("_bits")


def trigram_index(rows: DataFrame, path: str) -> None:  # L5
    """Index rows (id, text): each row's trigrams with their number, codes and signature, and postings of trigrams.

    Postings are dealt by ranges of trigram and number of trigrams, so a search reads only those row
    groups of its trigrams in which a row could still be similar enough.
    """
    sets = rows.where("id is not null and text is not null").select("id", X.trigrams(F.col("text")).alias("grams")).withColumn("size", F.size("grams"))
    _signed(sets).write.mode("overwrite").parquet(f"{path}/sets")
    spark = rows.sparkSession
    each = spark.read.parquet(f"{path}/sets").select("id", "size", F.explode("grams").alias("gram"))
    each.repartitionByRange("gram", "size", "id").sortWithinPartitions("gram", "size").write.mode("overwrite").parquet(f"{path}/postings")
    spark.read.parquet(f"{path}/postings").groupBy("gram").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/counts")


def trigram_matches(spark: SparkSession, path: str, queries: DataFrame, limit: float = 0.3) -> DataFrame:  # L5: the % operator and similarity()
    """(query_id, id, similarity) of all rows whose similarity (shared trigrams over all) is limit or more. queries: (query_id, text), without repeated ids.

    Many queries share their trigrams with most rows, so candidates by postings would be more than the
    pairs. Each pair is looked at once instead: sizes and signatures say how many trigrams the two can
    share at most (a bit that only one has is a trigram that the other lacks), and what may reach the
    limit is verified on whole sets. Nothing but rows and queries is sent, each to the tasks of its pairs;
    a task sees PAIRS_A_TASK pairs. limit is above 0.
    """
    asked = queries.where("query_id is not null and text is not null").select("query_id", X.trigrams(F.col("text")).alias("grams")).withColumn("a", F.size("grams"))
    signs = [f"s{j}" for j in range(SIGNATURE)]
    asked = written(_signed(asked).select("query_id", "a", F.col("codes").alias("theirs"), *(F.col(s).alias(f"q{s}") for s in signs)), "trigram-queries")
    sets = spark.read.parquet(f"{path}/sets").select("id", "size", "codes", *signs)
    sets = sets.repartition(sets.count() * asked.count() // PAIRS_A_TASK + 1)
    lacks = lambda x, y: reduce(Column.__add__, (F.bit_count(F.col(a).bitwiseAND(F.bitwise_not(F.col(b)))) for a, b in zip(x, y, strict=True)))
    theirs = [f"q{s}" for s in signs]
    fits = (F.col("size") >= F.lit(limit) * F.col("a") - 1e-9) & (F.col("size") <= F.col("a") / F.lit(limit) + 1e-9)
    least = F.lit(limit / (1 + limit)) * (F.col("a") + F.col("size")) - 1e-6
    shared = F.size(F.array_intersect("codes", "theirs"))
    similarity = shared / (F.col("size") + F.col("a") - shared)
    may = fits & (F.col("a") - lacks(theirs, signs) >= least) & (F.col("size") - lacks(signs, theirs) >= least)
    # one condition, so that sets are compared only where the signatures leave it open
    pairs = sets.join(asked, F.when(may, similarity >= limit).otherwise(F.lit(False)))
    return pairs.select("query_id", "id", F.round(similarity, 6).alias("similarity"))


def trigram_search(spark: SparkSession, path: str, text: str, limit: float = 0.3) -> DataFrame:  # L5
    """(id, similarity) for one text: its few postings are named in the scan's filter, so other row groups are skipped."""
    grams = sorted(spark.range(1).select(X.trigrams(F.lit(text)).alias("g")).first().g)
    counts = {r.gram: r.n for r in spark.read.parquet(f"{path}/counts").where(F.col("gram").isin(grams)).collect()}  # the query's trigrams
    need = -int(-(limit * len(grams) - 1e-9) // 1)
    rare = sorted(grams, key=lambda g: (counts.get(g, 0), g))[: len(grams) - need + 1]
    rows = spark.read.parquet(f"{path}/postings").where(F.col("gram").isin([g for g in rare if g in counts]) & F.col("size").between(need, int(len(grams) / limit + 1e-9)))
    sets = spark.read.parquet(f"{path}/sets").join(rows.select("id").distinct(), "id", "left_semi")
    shared = F.size(F.array_intersect("grams", F.array(*map(F.lit, grams))))
    return sets.withColumn("similarity", shared / (F.col("size") + len(grams) - shared)).where(F.col("similarity") >= limit).select("id", F.round("similarity", 6).alias("similarity"))
