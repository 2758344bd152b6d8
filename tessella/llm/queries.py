"""The subpackage's queries and, where SQL can say the same, their SQL.

Each query applies its operator with its production parameters to the whole
tables and derives the digest columns of its contract.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, common, embedding_dup, licenses, lines, mixing, near_dup, pii, rules, sharding, toxicity


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary file of this name is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = common.documents(spark, sf_dir), common.id_bucket(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs, common.labels(spark, sf_dir), ~held_out)
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", "near_ids", "features")


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(common.documents(spark, sf_dir))


def op3_embedding_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dup.near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(common.documents(spark, sf_dir), tokenizer_path())


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(spark, common.documents(spark, sf_dir), common.labels(spark, sf_dir))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(common.documents(spark, sf_dir))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_disguised")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = common.documents(spark, sf_dir), common.id_bucket(F.col("doc_id"), 3) == 1
    model = lines.fit(docs, common.labels(spark, sf_dir), ~held_out)
    scored = lines.score_documents(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", F.size("good_lines").alias("n_lines"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.assign_shards(common.documents(spark, sf_dir), 40)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(common.documents(spark, sf_dir)).drop("detections")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(common.documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_near_dup, op3_embedding_dup, op4_bpe, op5_quality_rules, op6_pii, op7_quality, op8_sharding, op9_licenses, op10_mixing)}


def oracle_sql() -> dict[str, str]:
    return {"op2_near_dup": near_dup.SQL, "op3_embedding_dup": embedding_dup.SQL, "op10_mixing": mixing.SQL}
