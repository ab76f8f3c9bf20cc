"""From raw documents to packed sequences: five stages, each written as Parquet and read by the next.

1. toxicity: documents scored as toxic go.
2. near duplicates: one document of each group of near or exact copies stays, the one with the smallest doc_id.
3. decontamination: documents of which benchmark passages make up a twentieth or more go.
4. personal data: found spans are replaced by their kind.
5. packing: what is left becomes token ids, packed into sequences; the last stage's rows are the pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.labelled import held_out
from quarryline.llm.op2_pack import pack_documents
from quarryline.llm.op3_jaccard import jaccard_classes, row_key
from quarryline.llm.op5_pii import masked, personal_data
from quarryline.llm.op8_toxicity import REJECT, toxicity, train
from quarryline.llm.op9_decontaminate import contamination, verdict
from quarryline.llm.shared import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from labelled rows of the whole corpus outside the held-out fold."""
    corpus = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(corpus, spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out("doc_id", 3, 1))
    return toxicity(docs, model).where(F.col("score") < REJECT).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each connected group, that with the smallest doc_id; equal rows of it count once. Texts without words stay."""
    classes = written(jaccard_classes(docs).where("class_key is not null").groupBy("row_key").agg(F.first("class_key").alias("class_key"), F.count("*").alias("n")), "pipeline-classes")
    keyed = docs.withColumn("_row_key", row_key("doc_id", "text"))
    kept = keyed.join(classes.where("row_key <> class_key").select(F.col("row_key").alias("_row_key")), "_row_key", "left_anti")
    again = classes.where("row_key = class_key and n > 1").select(F.col("row_key").alias("_row_key"))  # equal rows
    once = kept.join(again, "_row_key", "left_semi").dropDuplicates(["_row_key"])
    return kept.join(again, "_row_key", "left_anti").unionByName(once).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where(~verdict()).select(docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the new text."""
    found = personal_data(docs).withColumn("text", masked(F.col("text"), F.col("spans")))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return found.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal data", mask_personal_data),
    ("packing", pack),
]

#: SQL can't express the toxicity model or the tokenizer; test_pipeline in tests/llm/test_ops.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
