"""From raw documents to packed training sequences.

Quality classifier, near-dedup, benchmark decontamination, personal data, packing: each stage
works on all rows that the stage before it kept.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from mosarea.llm import decontam, minhash, packing, pii, quality
from mosarea.llm.maps import RESULT
from mosarea.llm.queries import site_columns
from mosarea.session import shared_folder


def _columns(docs: DataFrame) -> list:
    """The columns of a stage's input, whatever their names hold."""
    return [F.col(f"`{name}`") for name in docs.columns]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier and their site call good; texts without words go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    host, path = site_columns()
    judged = quality.classify(docs, labels, host, path)
    return judged.where("__good").select(_columns(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the group's smallest id; of repeated rows one stays.

    Shingles of five words, similarity 0.8 or more. Different texts with one id are documents of their own.
    """
    text = F.coalesce(F.md5("text"), F.lit(""))
    named = docs.where("doc_id is not null")
    node = F.col("doc_id")
    if not named.groupBy("doc_id").agg(F.min(text).alias("x"), F.max(text).alias("y")).where("x <> y").isEmpty():
        # ordered by id, then by 56 bits of the text's digest
        digest = F.coalesce(F.conv(F.substring(F.md5("text"), 1, 14), 16, 10), F.lit("0")).cast("decimal(18,0)")
        node = (node.cast("decimal(20,0)") * F.lit(1 << 56).cast("decimal(17,0)") + digest).cast("decimal(38,0)")
    named = named.withColumn("__node", node)
    kept = minhash.near_duplicates(named, doc_id="__node").where("kept").select("__node").distinct()
    named = named.join(kept, "__node", "left_semi").dropDuplicates(["__node"]).select(_columns(docs))
    return named.unionByName(docs.where("doc_id is null").select(_columns(docs)))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontam.find_contamination(docs, benchmark)
    return found.where(~decontam.contaminated(F.col(RESULT))).select(_columns(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; personal data is replaced by its kind in brackets, and ``n_chars`` follows."""
    found = pii.find_personal_data(docs)
    spans = F.col(RESULT)["spans"]
    touched = F.size(spans) > 0
    masked = F.when(touched, pii.mask(F.col("text"), spans)).otherwise(F.col("text"))
    return (
        found.withColumn("__masked", masked)
        .withColumn("n_chars", F.when(touched, F.length("__masked").cast("long")).otherwise(F.col("n_chars")))
        .withColumn("text", F.col("__masked"))
        .select(_columns(docs))
    )


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4,096 tokens, one row per piece of a document; the row at offset 0 has the sequence."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_sequences=True)


STAGES = [
    ("quality classifier", quality_classifier),
    ("near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("personal data", personal_data),
    ("packing", pack),
]

#: classifier, field and packing cannot be said in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
