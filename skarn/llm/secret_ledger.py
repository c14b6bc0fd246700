"""Operator 4 [native]: secret scans through an incremental blob ledger.

Every version of a document is addressed by the SHA-256 of its text. The ledger holds one row a (blob, rule version)
pair that was scanned, with its findings (also none). A run scans only pairs that the ledger lacks, appends them, and
joins the findings back to every path (doc_id) that holds the blob.

Kinds, leftmost and non-overlapping each; matches that are too short are dropped:
    assign  a keyword, a colon or equals sign and a value of 8 characters or more
    access  AKIA and capitals or digits, 16 characters or more
    hex     lower-case hex digits, 32 or more
Spans are code points, end exclusive. Null text is an empty text without findings. Every input row gives one output
row, repeated rows equal ones; extra columns are ignored; an empty table gives no rows and leaves the ledger as it is.

Plan: a first pass writes (doc_id, blob). The first path of each unseen blob goes into a bitmap of fixed size that is
broadcast into the second pass, so only one path of a blob is scanned and no text is shuffled. Findings come back by an
equi-join of light rows in which AQE can split a hot blob. No Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm.common import durable, let, mark_keys, running

#: Fixed values of the rules: kind, pattern, group whose length counts, least length.
RULES = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),  # a run is maximal, so asking for 32 at once finds the same spans
]
VERSION = "base-1"
SPANS = "array<struct<start:int,kind:int,end:int>>"
LEDGER = f"blob binary, rule_version string, spans {SPANS}"


def kind_spans(text: Column, rule: int) -> Column:
    """Spans of one rule in a non-null text, from the gaps of split() and the matches between them."""
    _, pattern, group, least = RULES[rule]
    gap, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    found = F.arrays_zip(F.transform(F.slice(gap, 1, F.greatest(F.size(gap) - 1, F.lit(0))), F.length).alias("gap"), F.transform(whole, F.length).alias("n"), F.transform(value, lambda v: F.length(v) >= least).alias("ok"))

    def spans(rows):
        before = running(F.transform(rows, lambda r: r["gap"] + r["n"]))
        at = F.zip_with(rows, before, lambda r, b: F.struct((b + r["gap"]).alias("start"), F.lit(rule).alias("kind"), (b + r["gap"] + r["n"]).alias("end"), r["ok"].alias("ok")))
        return F.transform(F.filter(at, lambda x: x["ok"]), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))

    return F.when(text.rlike(pattern), let(found, spans)).otherwise(F.array().cast(SPANS))


def secret_spans(text: Column) -> Column:
    """All spans of a text in order of start, then kind."""
    text = F.coalesce(text, F.lit(""))
    return F.sort_array(F.concat(*[kind_spans(text, k) for k in range(len(RULES))]))


def spans_text(spans: Column) -> Column:
    names = F.array(*[F.lit(r[0]) for r in RULES])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at path, without rows when there is none yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.read.schema(LEDGER).parquet(path)
    return spark.createDataFrame([], LEDGER)


def scan_secrets(docs: DataFrame, ledger_path: str, version: str = VERSION) -> DataFrame:
    """(doc_id, blob, spans) of docs (doc_id, text, ...); brings the ledger up to date first.

    Two runs that scan the same blob at once both add it, with the same spans; a blob that is there twice is read once.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    blob = F.unhex(F.sha2(text.cast("binary"), 256))
    versions = durable(docs.select("doc_id", blob.alias("blob")), "blob-versions")
    seen = read_ledger(spark, ledger_path).filter(F.col("rule_version") == version)
    unseen = versions.groupBy("blob").agg(F.min("doc_id").alias("doc_id")).join(seen.select("blob"), "blob", "left_anti")
    unseen = durable(unseen, "blob-unseen")
    path = F.struct(F.col("blob"), F.col("doc_id"))
    at_blob = docs.select("doc_id", blob.alias("blob"), text.alias("__text"))
    due = mark_keys(at_blob, path, unseen, "__due").filter("__due")
    scanned = due.select("blob", secret_spans(F.col("__text")).alias("spans"))
    new = scanned.groupBy("blob").agg(F.first("spans").alias("spans")).join(seen.select("blob"), "blob", "left_anti")
    new.select("blob", F.lit(version).alias("rule_version"), "spans").write.mode("append").parquet(ledger_path)
    found = read_ledger(spark, ledger_path).filter((F.col("rule_version") == version) & (F.size("spans") > 0)).dropDuplicates(["blob"]).select("blob", "spans")
    return versions.join(found, "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def secret_columns(found: DataFrame) -> DataFrame:
    """The contract's digest columns from scan_secrets()."""
    joined = spans_text(F.col("spans"))
    of_kind = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{r[0]}") for k, r in enumerate(RULES)]
    return found.select("doc_id", *counts, F.sha2(joined.cast("binary"), 256).alias("base_sha256"), joined.alias("spans"))


def redacted(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """text with every span, overlapping ones merged, replaced by mask; spans in order of start."""

    def parts(found):
        before = running(F.transform(found, lambda s: s["end"]), lambda a, x: F.greatest(a, x))
        kept = F.zip_with(found, before, lambda s, b: F.when(s["start"] >= b, F.concat(F.substring(text, b + 1, s["start"] - b), F.lit(mask))).otherwise(""))
        last = F.array_max(F.transform(found, lambda s: s["end"]))
        return F.concat(F.array_join(kept, ""), F.substring(text, last + 1, F.length(text)))

    return F.when(F.size(spans) > 0, let(spans, parts)).otherwise(text)
