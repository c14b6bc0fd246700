"""The registered queries of the training-data operators: thin, whole-table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm import sql
from skarn.llm.best_fit import best_fit_packing
from skarn.llm.common import documents, fresh_path
from skarn.llm.exact_dedup import exact_dedup
from skarn.llm.language_mixture import languages
from skarn.llm.license_rules import recognise_licenses
from skarn.llm.line_quality import line_quality
from skarn.llm.lsa_knn import quality
from skarn.llm.prefix_trie import prefix_trie
from skarn.llm.secret_ledger import scan_secrets, secret_columns
from skarn.llm.shards import shard_documents
from skarn.llm.signature_join import linked_groups
from skarn.llm.token_files import read_token_files, write_token_files
from skarn.llm.trie_bpe import bpe_round_trip


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    write_token_files(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_token_files(spark, path)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir), carry={"text_sha256": F.sha2(F.col("__norm").cast("binary"), 256)})


def op3_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognise_licenses(documents(spark, sf_dir)).select("doc_id", "n_license_sentences", "license_ids", "licenses")


def op4_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_columns(scan_secrets(documents(spark, sf_dir), fresh_path(spark, "secret-ledger")))


def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality(documents(spark, sf_dir))


def op6_lsa_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = F.array_join(F.transform(F.array_sort(F.map_keys("lang_mix")), lambda k: k), ",")
    return languages(documents(spark, sf_dir)).withColumn("languages", mix).drop("lang_mix")


def op8_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op9_signature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_groups(documents(spark, sf_dir))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_license_rules": op3_license_rules,
    "op4_secret_ledger": op4_secret_ledger,
    "op5_line_quality": op5_line_quality,
    "op6_lsa_knn_quality": op6_lsa_knn_quality,
    "op7_language_mixture": op7_language_mixture,
    "op8_trie_bpe": op8_trie_bpe,
    "op9_signature_join": op9_signature_join,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_jump_shards": op12_jump_shards,
}

ORACLE_SQL = {
    "op2_exact_dedup": sql.DEDUP,
    "op3_license_rules": sql.LICENSES,
    "op4_secret_ledger": sql.SECRETS,
    "op5_line_quality": sql.LINES,
    "op11_prefix_trie": sql.TRIE,
    "op12_jump_shards": sql.SHARDS,
}
