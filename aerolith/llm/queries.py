"""The registered queries over the text tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.llm import mixing, neardup, oracles, packing, pii, quality, rules, sharding, vectors, warc, wavelet
from aerolith.llm.common import table, word_count

#: Key of the surrogates; a deployment passes its own.
SECRET = "surrogate key"
SHARD_DIMS = ["source", "lang", "n_chars"]


def op1_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return decided.select(F.col("key").alias("doc_id"), "n_features", "log_weight", "noisy", "kept")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.jaccard_classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), "class_id", "n_links", "n_shingles", (F.col("key") == F.col("class_id")).alias("kept"))


def op3_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    keep = [
        docs["doc_id"],
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
    ]
    placed = sharding.hilbert_shards(docs, SHARD_DIMS, 8, keep, ["doc_id", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, "doc_id", "source", word_count(docs["text"]))
    return mixed.select(F.col("key").alias("doc_id"), "size", "source_size", F.round("target", 6).alias("target"), "taken", "copies", "source")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("key", "vec_id")


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.replace_entities(docs, SECRET).select("doc_id", "text", "n_entities")


def tokenizer_json(tokenizer: str | None = None) -> str:
    """The tokenizer of op7, op10 and the pipeline."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    with open(tokenizer, encoding="utf-8") as f:
        return f.read()


def op7_wavelet_ids(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return wavelet.round_trip(table(spark, sf_dir, "documents"), tokenizer_json(tokenizer), special=True).withColumnRenamed("key", "doc_id")


def op8_warc_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("payload", "url").withColumnRenamed("key", "page_id")


def op9_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = rules.ledger(table(spark, sf_dir, "documents"), "doc_id", "text")
    base = sum(rules.bit(n) for n in rules.BASE)
    failed = F.col("fail_bits").bitwiseAND(base) != 0
    return book.select(
        F.col("key").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & rules.verdict("v2")).alias("kept"), "fail_bits", "n_lines", "n_upper_words", "n_alpha_words"
    )


def op10_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    packed = packing.pack(docs, "doc_id", wavelet.token_count(docs["text"], tokenizer_json(), special=True))
    return packed.withColumnRenamed("key", "doc_id").withColumnRenamed("length", "n_tokens")


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality_resampling, op2_jaccard_join, op3_hilbert_sharding, op4_source_mixing, op5_embedding_dedup, op6_pii_surrogates, op7_wavelet_ids, op8_warc_reader, op9_rule_ledger, op10_length_packing)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_jaccard_join": oracles.jaccard_sql(),
        "op3_hilbert_sharding": oracles.shards_sql(SHARD_DIMS),
        "op4_source_mixing": oracles.mix_sql(),
        "op5_embedding_dedup": oracles.vectors_sql(vectors.COSINE),
        "op8_warc_reader": oracles.archive_sql(),
        "op9_rule_ledger": oracles.ledger_sql(),
    }
