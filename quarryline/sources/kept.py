"""Indexes kept for a session under the state of the table that they were built from."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .scratch import shared_dir

_paths: dict[tuple, str] = {}


def table_state(spark: SparkSession, path: str) -> tuple[int, int]:
    """(number of files, a digest of their paths, sizes and times): changes whenever the table is written. Files are listed, not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    return tuple(files.agg(F.count("*"), F.coalesce(F.expr("bit_xor(xxhash64(path, length, modificationTime))"), F.lit(0))).first())


def kept(spark: SparkSession, name: str, table: str, build: Callable[[str], object]) -> str:
    """The folder that build(folder) filled from the table at that path: built anew when a file of the table has changed, else the one of before."""
    key = (spark.sparkContext.applicationId, name, table, *table_state(spark, table))
    if key not in _paths:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        build(path)
        _paths[key] = path
    return _paths[key]
