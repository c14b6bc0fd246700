"""A cleaning pipeline over documents: quality, exact copies, near copies, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All stages but the last return the
columns of docs; the last returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm.best_fit import best_fit_packing
from skarn.llm.common import durable, fresh_path, split_by_key
from skarn.llm.exact_dedup import exact_dedup
from skarn.llm.lsa_knn import DECISION, fit, score_quality
from skarn.llm.secret_ledger import redacted, scan_secrets
from skarn.llm.signature_join import linked_groups

#: Near copies in the pipeline: five-word shingles, similarity 0.8 or more.
NEAR_WORDS, NEAR_NEED = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbour vote rejects go; the others keep all columns."""
    model, prior = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_quality(docs, model, prior, docs.columns, "__score")
    return scored.filter(F.col("__score") >= DECISION).select(*docs.columns)


def own_key() -> Column:
    """A 64-bit name of a row's doc_id and text; rows that share it are repeated rows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.xxhash64(F.col("doc_id").cast("string"), text, F.length(text))


def without(docs: DataFrame, gone: DataFrame, light: DataFrame) -> DataFrame:
    """docs without the rows whose key gone (__key) names, and each repeated row once. light holds the __key of every row.

    Only rows that go, repeated rows and few others are shuffled, whatever the ids are like.
    """
    repeated = light.groupBy("__key").count().filter("count > 1").select("__key")
    keys = durable(gone.select("__key").unionByName(repeated).distinct(), "gone-keys")
    sure, maybe = split_by_key(docs, own_key(), keys)
    return sure.unionByName(maybe.join(gone, "__key", "left_anti").dropDuplicates(["__key"]).drop("__key")).select(*docs.columns)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, also where rows share a doc_id or have none."""
    found = durable(exact_dedup(docs.select("doc_id", "text"), carry={"__own": own_key()}).select(F.col("__own").alias("__key"), "kept"), "dedup-verdicts")
    return without(docs, found.filter(~F.col("kept")).select("__key"), found)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows the first by doc_id (nulls last) stays, also where rows share a doc_id or have none."""
    light = durable(docs.select(own_key().alias("__key"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id").alias("__id")), "row-keys")
    groups = linked_groups(docs.select(own_key().alias("doc_id"), "text"), NEAR_WORDS, NEAR_NEED).select(F.col("doc_id").alias("__key"), "component_id").distinct()
    rows = light.dropDuplicates(["__key"]).join(groups, "__key").select("__key", "component_id", F.struct("__id", "__key").alias("__row"))
    first = rows.groupBy("component_id").agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    gone = rows.join(first, "component_id").filter(F.col("__row") != F.col("__first")).select("__key")
    return without(docs, durable(gone, "gone-near"), light)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; n_chars follows. No document goes."""
    found = scan_secrets(docs, fresh_path(spark, "secret-ledger")).filter(F.size("spans") > 0)
    found = durable(found.groupBy(F.col("blob").alias("__key")).agg(F.first("spans").alias("__spans")), "found-secrets")
    blob = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    clean, maybe = split_by_key(docs, blob, found.select("__key"))
    joined = maybe.join(found, "__key", "left")
    text = F.when(F.col("__spans").isNotNull(), redacted(F.col("text"), F.col("__spans"))).otherwise(F.col("text"))
    masked = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        masked = masked.withColumn("n_chars", F.when(F.col("__spans").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return clean.unionByName(masked.select(*docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents packed into sequences of 2048 tokens."""
    return best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_jaccard_join", near_dedup_stage),
    ("secret_scans", secrets_stage),
    ("best_fit_packing", packing_stage),
]

#: Trained scores decide the first stage, which SQL can't express; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
