"""Shared folder, materialised tables and connected components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import shared_dir, written

__all__ = ["boxed", "components", "numbered", "parallelism", "quoted", "release", "shared_dir", "spread", "with_text", "written"]


def quoted(name: str) -> str:
    """A column's name as it can be selected, whatever signs it holds."""
    return "`" + name.replace("`", "``") + "`"


def boxed(documents: DataFrame, results: Iterable[str]) -> DataFrame:
    """(doc): the columns of each row but for those named like the results, as one, so that no name of theirs can clash."""
    names = {x.lower() for x in results}
    return documents.select(F.struct(*(F.col(quoted(c)).alias(c) for c in documents.columns if c.lower() not in names)).alias("doc"))


def with_text(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Batches of boxed rows with the field of that name beside them, as column text."""
    for batch in batches:
        doc = batch.column("doc")
        names = [doc.type.field(i).name for i in range(doc.type.num_fields)]
        yield pa.RecordBatch.from_arrays([doc, doc.flatten()[names.index(text)]], names=["doc", "text"])


def release() -> None:
    """Give memory that this process has freed back to the machine: the allocators of C and Arrow keep it otherwise, and a driver has it for good."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores where it comes from fewer files than there are cores, as a small file is one task's work."""
    files, cores = len(df.inputFiles()), df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < files < cores else df


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u long, v long): (node, component), component the smallest node.

    Alternates large-star and small-star rounds (both replace an edge by one to the smallest
    neighbour). Each round is a grouped minimum, which combines map-side, and a join that adaptive
    execution may split where a node has very many edges; nothing is gathered per node. Stops when
    a round leaves the edge set as it was, which takes about the logarithm of the longest path. Nodes without an edge to another node don't appear.
    """
    e = edges.where("u <> v").select("u", "v").distinct()
    e = written(e, "cc")
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        lowest = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(lowest, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        e = written(small, "cc")
        now = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == seen:
            break
        seen = now
    star = e.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.col("m").alias("component"))
    return star.unionByName(star.select(F.col("component").alias("node"), "component").distinct())


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with column `name`: each row's place in that order, from 1; rows that are equal in it stand in any order.

    One shuffle into ranges and a sort of each; a row's place in its range and the range's number are
    its monotonic id, so that only a row count for each range has to be summed up in one task. df is
    read twice (once for the ranges' bounds): hand over a written table.
    """
    spark = df.sparkSession
    placed = df.repartitionByRange(parallelism(spark), *order).sortWithinPartitions(*order)
    placed = written(placed.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))  # a row for each range: as many as there are partitions
    place = F.col("_before") + (F.col("_at") - F.shiftleft("_part", 33)) + 1
    return placed.join(F.broadcast(offsets), part == F.col("_part")).select(*(F.col(quoted(c)) for c in df.columns), place.alias(name))
