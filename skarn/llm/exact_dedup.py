"""Operator 2: exact dedup by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when identical after all white space ([\\x20\\x09-\\x0D]) is deleted. Null text is an empty text, so
nulls, empty texts and white-space-only texts form one group. Of equal texts the row with most code points in the
original stays, then the smallest doc_id (a null doc_id sorts last), then the smallest hash of the original. Every
input row gets one output row; a repeated (doc_id, text) row shares its verdict, other rows of that doc_id do not. Extra
columns are ignored, or carried when named. An empty table gives no rows.

Plan: (1) one pass writes a light row a document: normalised length and prefix hash. (2) Lengths held by one row drop
out, then (length, prefix) pairs held by one row. (3) The surviving pairs become a bitmap, 16 bits a pair, that is
broadcast into the second pass, which hashes full texts of survivors only (and of the few rows that the bitmap marks
wrongly, which changes no result). Text is not shuffled while the bitmap has at most 2**bitmap_bits bits; beyond, the
second pass joins the documents with the surviving pairs. Groups are aggregated map-side; the join that hands the verdict
back is an equi-join of light rows whose hot keys AQE can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import MOST_BITS, durable, mark_keys, without_white

PREFIX = 64


def exact_dedup(docs: DataFrame, carry: dict[str, Column] | None = None, bitmap_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, *carry) of docs (doc_id, text, ...).

    carry: further columns to compute from docs in the second pass; they may use column __norm, the normalised text.
    """
    carry = carry or {}
    text = F.coalesce(F.col("text"), F.lit(""))
    size, prefix = F.octet_length("__norm").cast("long"), F.xxhash64(F.substring("__norm", 1, PREFIX))
    keyed = docs.withColumn("__norm", without_white(text)).withColumn("__len", size).withColumn("__pre", prefix)

    light = durable(keyed.select("__len", "__pre"), "dedup-light")
    lengths = light.groupBy("__len").count().filter("count > 1").select("__len")
    pairs = durable(light.join(lengths, "__len", "left_semi").groupBy("__len", "__pre").count().filter("count > 1"), "dedup-pairs")
    marked = mark_keys(keyed, F.struct("__len", "__pre"), pairs, "__survives", bitmap_bits)

    full = F.when(F.col("__survives"), F.unhex(F.sha2(F.col("__norm").cast("binary"), 256)))
    alone = F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")  # shorter than a hash, so never equal to one
    rows = durable(
        marked.select(
            F.col("doc_id"),
            F.coalesce(full, alone).alias("__key"),
            F.col("__survives"),
            F.struct((-F.length(text)).alias("less"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.when(F.col("__survives"), F.xxhash64(text)).alias("text")).alias("__row"),
            *[c.alias(k) for k, c in carry.items()],
        ),
        "dedup-rows",
    )
    groups = (
        rows.filter("__survives")
        .groupBy("__key")
        .agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__n"))
        .filter("__n > 1")
    )
    both = rows.join(groups, "__key", "left")
    keep = F.when(F.col("__first").isNotNull(), F.col("__first.id")).otherwise(F.col("doc_id"))
    return both.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("__n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("__first").isNull() | F.col("__first").eqNullSafe(F.col("__row"))).alias("kept"),
        *carry,
    )
