"""From raw documents to packed batches: classifier, near-duplicate join, surrogates, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.llm import mixing, neardup, packing, pii, quality, wavelet
from aerolith.llm.common import table, word_count, workspace
from aerolith.llm.queries import SECRET, tokenizer_json


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling keeps."""
    return quality.kept_rows(docs, quality.resample(docs, table(spark, sf_dir, "labels")))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return neardup.one_of_each(docs)


def hide_persons(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates, and their new length."""
    hidden = pii.replace_entities(docs, SECRET).select(*docs.columns)
    return hidden.withColumn("n_chars", F.char_length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them."""
    return mixing.mixed_rows(docs, quality.row_hash(docs["doc_id"], docs["text"]), "doc_id", "source", word_count(docs["text"]))


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and place of every row, by its number of tokens."""
    packed = packing.pack(docs, "doc_id", wavelet.token_count(docs["text"], tokenizer_json(), special=True))
    return packed.withColumnRenamed("key", "doc_id").withColumnRenamed("length", "n_tokens")


STAGES = [
    ("quality classifier", classify),
    ("n-gram Jaccard join", one_of_near_copies),
    ("PII surrogates", hide_persons),
    ("source mixing", mix_sources),
    ("packing", pack_batches),
]
#: Min-hashing, surrogates and the bucket program are beyond SQL; tests/llm holds the stages against properties, and their functions against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = workspace(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        if k:
            docs.write.mode("overwrite").parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
        docs = stage(spark, docs, sf_dir)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
