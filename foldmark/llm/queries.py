"""The operators as queries over whole tables, with production parameters; SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldmark.llm import decontaminate, line_dedup, mixing, near_dup, pii, secret_scan, sharding, token_store, topk_search, toxicity
from foldmark.llm._shared import table


def vocabulary() -> str:
    """The path of the tokenizer's vocabulary, from the package that holds the public files."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.read_segments(token_store.write_segments(table(spark, sf_dir, "documents"), vocabulary()))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix_documents(table(spark, sf_dir, "documents"))
    return rows.withColumn("shards", F.array_join(F.transform("shards", lambda x: x.cast("string")), ",")).drop("slots")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_query(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_topk_search, op2_secret_scan, op3_token_ids, op4_decontaminate, op5_toxicity, op6_sharding, op7_pii, op8_near_dup, op9_mixing, op10_line_dedup)}
ORACLE_SQL = {"op1_topk_search": topk_search.SQL, "op4_decontaminate": decontaminate.SQL, "op6_sharding": sharding.SQL, "op7_pii": pii.SQL, "op9_mixing": mixing.SQL, "op10_line_dedup": line_dedup.SQL}
