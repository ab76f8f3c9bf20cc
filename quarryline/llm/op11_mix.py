"""Mixing sources to target weights by hash-threshold histograms, in DataFrame functions only.

Each source has a target of words. A source's documents are taken as many whole times as fit, and the
rest of the target by a threshold on a hash of the document: those below it are taken once more. The
threshold comes from nested histograms: words are summed by source and leading bits of the hash, the
bucket in which the budget runs out is found, and only that bucket is summed again by its next bits,
until it holds one hash. So no source is sorted, and the documents are filtered by comparing two
numbers. The boundary document is taken if that brings the source nearer to its target.

Targets: sources in order of code points (null last) have the weights 1, 2, 3, repeating. A target
stops at ``most`` times its source's size, and what is over is shared by weight among the others, until
none is above. As every round is a pair of sums over a table of sources, sources aren't gathered.

Defined results: a null text has size 0 and is taken 0 times; null sources are one source; a null doc_id
counts as an empty one; rows equal in doc_id and text share one hash and so one fate; a source without
words has target 0; an empty table gives no rows. Columns named like the results are replaced, others
of any name pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import numbered, parallelism, quoted, written

RESULT = ("size", "source_size", "target", "taken")
#: Bits of the hash, and of one level of the histogram.
HASH_BITS, LEVEL_BITS = 60, 10
#: Above so many bytes of sources, thresholds are joined over salts and no longer broadcast.
BROADCAST_BYTES = 8 << 20


def size_of(text: Column) -> Column:
    """Number of runs of signs other than ASCII white space; each becomes one sign, as an array of the words would be many times the text."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", "x")
    return F.length(F.translate(marks, " \t\n\x0b\f\r", "")).cast("long")


def hash_of(doc_id: Column, text: Column, seed: str) -> Column:
    """60 bits from 0 on."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """sources (source, source_size and more) with target. sources: a written table, a row for each."""
    cycle = F.array(*(F.lit(w).cast("long") for w in weights))
    place = numbered(sources, [F.col("source").asc_nulls_last()], "place")
    weighed = written(place.withColumn("weight", F.element_at(cycle, (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))).drop("place"), "mix-weights")
    total, weight = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    left, shares = total, weight
    while True:  # each round adds a source to those that stop at their most, or is the last
        above = F.expr(f"cast(weight as decimal(20, 0)) * cast({left} as decimal(18, 0)) > cast(source_size as decimal(19, 0)) * cast({most * shares} as decimal(19, 0))")
        full, theirs = weighed.where(above).agg(F.coalesce(F.sum(F.col("source_size") * most), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if (total - full, weight - theirs) == (left, shares):
            break
        left, shares = total - full, weight - theirs
    share = (F.col("weight") * F.lit(left)).cast("double") / F.lit(float(shares or 1))
    return weighed.withColumn("target", F.when(above, (F.col("source_size") * most).cast("double")).otherwise(share)).drop("weight")


def by_source(rows: DataFrame, sources: DataFrame, small: bool, share: int) -> DataFrame:
    """rows (with source and h) joined with their source's row. sources has n, a source's documents; a source of more than `share` is dealt over salts."""
    s = sources.withColumnRenamed("source", "_source")
    if small:
        return rows.join(F.broadcast(s), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    salts = F.ceil(F.col("n") / share).cast("int")
    # each has more than `share` of all documents, so there are fewer of them than there are partitions
    hot = s.where(F.col("n") > share).select(F.col("_source").alias("_hot"), salts.alias("_salts"))
    dealt = rows.join(F.broadcast(hot), F.col("source").eqNullSafe(F.col("_hot")), "left").withColumn("_salt", F.pmod("h", F.coalesce("_salts", F.lit(1))).cast("int"))
    copies = s.withColumn("_at", F.explode(F.sequence(F.lit(0), salts - 1)))
    return dealt.join(copies, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_salt") == F.col("_at"))).drop("_source", "_hot", "_salts", "_salt", "_at")


def thresholds(rows: DataFrame, sources: DataFrame, small: bool, share: int) -> DataFrame:
    """sources with whole (times all documents are taken) and below (documents of a smaller hash are taken once more). rows: written (source, size, h)."""
    size, target = F.col("source_size"), F.col("target")
    whole = F.when(size > 0, F.floor(target / size)).otherwise(0).cast("long")
    state = sources.withColumn("whole", whole).withColumn("rest", F.greatest(F.lit(0.0), target - F.col("whole") * size))
    open_ = F.col("below").isNull()
    state = written(state.select("*", F.lit(0).cast("long").alias("prefix"), F.when(F.col("rest") <= 0, F.lit(0)).cast("long").alias("below")), "mix-level")
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        going = state.where(open_)
        if going.isEmpty():
            break
        asked = by_source(rows.select("source", "size", "h"), going.select("source", "n", "rest", "prefix"), small, share).where(F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix"))
        sums = asked.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.min("h").alias("least"), F.max("h").alias("last"), F.first("rest").alias("rest"))
        order = Window.partitionBy("source").orderBy("bucket")  # at most 1,024 buckets of a source
        edge = sums.withColumn("upto", F.sum("words").over(order)).where("upto > rest").groupBy("source").agg(F.min(F.struct("bucket", F.col("upto").alias("upto"), "words", "least", "last")).alias("edge"))
        left = F.col("rest") - (F.col("edge.upto") - F.col("edge.words"))
        single = F.col("edge.least") == F.col("edge.last")
        with_it = (F.col("edge.words") - left < left).cast("long")
        found = edge.withColumnRenamed("source", "_source")
        on = going.join(found, F.col("source").eqNullSafe(F.col("_source")))
        ended = F.when(single, F.col("edge.least") + with_it)
        names = [c for c in state.columns if c not in ("rest", "prefix", "below")]
        new = on.select(*names, left.alias("rest"), F.col("edge.bucket").alias("prefix"), ended.alias("below"))
        state = written(state.where(~open_).unionByName(new), "mix-level")
    return state


def mix(documents: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: str = "2024", keep: list[str] | None = None, broadcast_bytes: int = BROADCAST_BYTES, share: int | None = None) -> DataFrame:
    """documents (the columns in keep, all by default) with size, source_size, target and taken, the words that the mix takes of each, repeats counted.

    share: documents of a source from which it is dealt over salts, where sources are too many to be
    broadcast; by default an even share of all.
    """
    names = [c for c in (documents.columns if keep is None else keep) if c.lower() not in RESULT]
    box = F.struct(F.lit(None).cast("string").alias("none"), *(F.col(quoted(c)).alias(f"_{i}") for i, c in enumerate(names)))
    body, key = F.col(quoted(text)), F.col(quoted(doc_id))
    rows = written(documents.select(box.alias("doc"), F.col(quoted(source)).cast("string").alias("source"), size_of(body).alias("size"), hash_of(key, body, seed).alias("h")), "mix-rows")
    sources = written(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "mix-sources")
    n, length, documents_ = sources.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("source")), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    small = 100 * n + length <= broadcast_bytes
    share = share or max(500, -(-documents_ // parallelism(documents.sparkSession)))
    state = thresholds(rows, targets(sources, weights, most), small, share)
    judged = by_source(rows, state.select("source", "n", "source_size", "target", "whole", "below"), small, share)
    taken = F.col("size") * (F.col("whole") + (F.col("h") < F.col("below")).cast("long"))
    return judged.select(*(F.col(f"doc._{i}").alias(c) for i, c in enumerate(names)), "size", "source_size", "target", taken.alias("taken"))


def op11_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"), keep=["doc_id"])


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, ('0x' || substr(md5('2024:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::HUGEINT AS z, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
a AS (SELECT *, sum(z) OVER () AS t, sum(w) OVER () AS v FROM s),
c AS (SELECT *, w * (t - coalesce(sum(3 * z) OVER o, 0)) > 3 * z * (v - coalesce(sum(w) OVER o, 0)) AS above FROM a WINDOW o AS (ORDER BY z * (6 // w), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT coalesce(sum(3 * z) FILTER (above), 0) AS kz, coalesce(sum(w) FILTER (above), 0) AS kw FROM c),
g AS (SELECT source, z, CASE WHEN above THEN (3 * z)::DOUBLE ELSE (w * (t - kz))::DOUBLE / greatest(v - kw, 1)::DOUBLE END AS target FROM c, k),
f AS (SELECT *, CASE WHEN z > 0 THEN floor(target / z::DOUBLE) ELSE 0 END AS whole FROM g),
r AS (SELECT *, greatest(0, target - whole * z::DOUBLE) AS rest FROM f),
u AS (SELECT doc_id, size, h, z, target, whole, rest, sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto, sum(size) OVER (PARTITION BY d.source, h) AS own FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, z::BIGINT AS source_size, target, (size * (whole + CASE WHEN rest > 0 AND (upto <= rest OR (upto - own <= rest AND own - (rest - (upto - own)) < rest - (upto - own))) THEN 1 ELSE 0 END))::BIGINT AS taken FROM u
"""
