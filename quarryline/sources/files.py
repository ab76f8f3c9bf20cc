"""Readers and writers of files (section 2.1)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.extract import flat_yaml, url_items

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:  # IO1
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def scan(spark: SparkSession, folder: str, names: list[str] | None = None, glob: str = "*", recursive: bool = True) -> DataFrame:  # IO2, IO3, IO4
    """(path, length, content, file_type); names: base names or whole paths to keep."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob).load(folder)
    if names is not None:
        df = df.where(F.regexp_extract("path", r"([^/]*)$", 1).isin(names) | F.regexp_replace("path", r"^file:(//)?", "").isin(names))
    return df.withColumn("file_type", X.file_type(F.col("path")))


def plain_text(spark: SparkSession, folder: str) -> DataFrame:  # IO5
    return spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def texts(files: DataFrame, pdf: Callable[[bytes], str] | None = None, docx: Callable[[bytes], str] | None = None) -> DataFrame:  # IO6 to IO10
    """files with text and error. PDF and DOCX need a library, given as a function; a file that fails has an error and no text, and others go on."""
    raw = F.col("content").cast("string")
    native = F.when(F.col("file_type") == "html", X.html_file_text(raw)).when(~F.col("file_type").isin("pdf", "docx"), raw)
    out = files.withColumn("text", native).withColumn("error", F.lit(None).cast("string"))
    if pdf is None and docx is None:
        return out.withColumn("error", F.when(F.col("file_type").isin("pdf", "docx"), F.concat(F.lit("no reader for "), F.col("file_type"))))

    def read(frames):
        for df in frames:
            for i, (kind, content) in enumerate(zip(df["file_type"], df["content"], strict=True)):
                reader = {"pdf": pdf, "docx": docx}.get(kind)
                if reader is not None:
                    try:
                        df.loc[df.index[i], "text"] = reader(bytes(content))
                    except Exception as e:
                        df.loc[df.index[i], "error"] = str(e)
            yield df

    return out.mapInPandas(read, out.schema)


def markdown(files: DataFrame, text: str = "text") -> DataFrame:  # IO11: with metadata (map) and body
    return files.withColumn("metadata", flat_yaml(X.frontmatter_block(F.col(text)))).withColumn("body", X.strip_frontmatter(F.col(text)))


def url_list(files: DataFrame, text: str = "text") -> DataFrame:  # IO13
    return files.select(*[c for c in files.columns if c != text], F.posexplode(url_items(F.col(text))).alias("n", "x")).select("*", "x.*").drop("x")


def append(df: DataFrame, path: str) -> None:  # IO14
    df.write.mode("append").parquet(path)


def replace_partitions(df: DataFrame, path: str, key: str) -> None:  # IO18, IO20: only the partitions that come anew are overwritten
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def download(df: DataFrame, key: str, value) -> list:  # IO22: one row by its key
    return df.where(F.col(key) == value).limit(1).collect()


def migrate(spark: SparkSession, folder: str, path: str, partition: str = "file_type") -> None:  # IO24
    texts(scan(spark, folder)).drop("content").write.mode("overwrite").partitionBy(partition).parquet(path)
