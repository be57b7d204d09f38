"""The numbered operators as queries over the given tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, chat, embed_dedup, lbl, mixing, quality, secrets, simhash, tokens, toxicity, whitening, winnow
from .common import table_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return quality.judged(docs, table(spark, sf_dir, "labels")).select("doc_id", "lang", "perplexity", "threshold", "keep")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embedding_groups(table(spark, sf_dir, "embeddings"))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table_path(spark, "token_ids")
    tokens.write_ids(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), out)
    return tokens.with_crc(tokens.read_ids(spark, out))


def quality_weights(labels: DataFrame) -> DataFrame:
    """Weights for the sampling keys: good documents 1, the others 0.25 (documents without a label: 1)."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0.25).otherwise(1.0).alias("weight"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix(table(spark, sf_dir, "documents"), quality_weights(table(spark, sf_dir, "labels")))
    return plan.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn int, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("int"), "role", "text")
    return chat.chat_report(rows.unionByName(extra))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.with_crc(tokens.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.edited_report(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lbl.language_scores(table(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.divergence(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


OPERATORS = [
    op1_quality, op2_toxicity, op3_embed_dedup, op4_token_ids, op5_mixing, op6_chat, op7_secrets, op8_packing, op9_winnowing, op10_simhash,
    op11_lm_scores, op12_divergence, op13_whitening,
]
QUERIES = {f.__name__: f for f in OPERATORS}
ORACLES: dict[str, str] = {"op12_divergence": audit.DIVERGENCE_SQL}
