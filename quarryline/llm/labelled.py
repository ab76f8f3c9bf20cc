"""Bounded training samples of labelled documents, and the fold of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written


def held_out(doc_id: str, folds: int, fold: int) -> Column:
    """crc32 of doc_id as text leaves the remainder fold; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def training_rows(documents: DataFrame, labels: DataFrame, label: str, test: Column, most: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, y) of at most `most` labelled ids outside `test`: those whose hashed ids are smallest.

    An id labelled several times counts once, with its largest label, and an id on several texts with
    one of them (that of the smallest hash); null ids and labels are left out. The sample of ids has a
    fixed bound, so it is broadcast.
    """
    chosen = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & ~test).groupBy(doc_id).agg(F.max(label).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64(doc_id), doc_id).limit(most)
    chosen = written(chosen, "labelled")
    again = documents.select(doc_id).join(F.broadcast(chosen), doc_id, "left_semi").groupBy(doc_id).count().where("count > 1").select(doc_id)
    rows = documents.select(F.col(doc_id), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), doc_id)
    # ids on several texts alone are gathered, those of one text stay where they are read; both lists have the sample's bound
    single = rows.join(F.broadcast(again), doc_id, "left_anti").select("text", "y")
    several = rows.join(F.broadcast(again), doc_id, "left_semi").groupBy(doc_id, "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return single.unionByName(several.select("text", "y"))
