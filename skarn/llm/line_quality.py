"""Operator 5 [native]: quality rules, with cross-document line frequency as the verdict.

Per document: word and symbol counts, repeated lines, words inside repeated 5-word windows (base rules). Across
documents: lines with a word are normalised (lower case, trimmed, white space runs as one space) and hashed; for each
host the distinct documents that hold a line are counted. A document is a row's (doc_id, text), so repeated rows count
once and copies under other ids count each. A line that more than MIN_DOCS documents of its host hold is removed,
whatever the host's size; a document whose rest is below REST_WORDS words or a REST_SHARE share of its words is depleted
and rejected.

Two other rules can be asked for: with whole_documents off, exact copies of a text count once, so that a page that was
only copied is no boilerplate; a share sets a second limit that grows with the host.

Null text is an empty text (no words, so base_failed). A null host is a host of its own. Every input row gives one
output row, repeated rows equal ones. Extra columns are ignored. An empty table gives no rows.

Plan: one pass computes all per-text figures with array functions inside the row and writes light rows; only line
hashes are shuffled, counted map-side first. The lines above the limits come back by an equi-join on (host, line) in
which AQE splits hot lines. No Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import WHITE_RE, durable, let, without_white, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_DOCS = 20
REST_WORDS = 10
REST_SHARE = 0.3


def repeated_words(words: Column) -> Column:
    """Words covered by windows of WINDOW words that occur twice or more, in O(n log n) for a row."""

    def windows(h):
        each = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
        return F.when(F.size(h) >= WINDOW, each).otherwise(F.array().cast("array<bigint>"))

    def covered(places):
        step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last"))
        return F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), step, lambda acc: acc["n"])

    def among(s):
        same = lambda e, k: F.coalesce(F.get(s, k)["x"] == e["x"], F.lit(False))
        twice = F.filter(s, lambda e, k: same(e, k - 1) | same(e, k + 1))
        return covered(F.sort_array(F.transform(twice, lambda e: e["i"])))

    def count(w):
        ordered = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(ordered, among))

    return let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), count)


def text_figures(docs: DataFrame) -> DataFrame:
    """(doc_id, host, text_hash, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines) of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"),
        F.xxhash64(text, F.length(text)).alias("text_hash"),
        text.alias("__text"),
        words_of(text).alias("__words"),
        F.filter(F.split(text, "\n"), lambda x: without_white(x) != "").alias("__lines"),
    )
    plain = lambda x: F.trim(F.regexp_replace(F.lower(x), WHITE_RE + "+", " "))
    line = lambda x: F.struct(F.xxhash64(plain(x)).alias("h"), F.size(words_of(x)).alias("n"))
    return rows.select(
        "doc_id",
        "host",
        "text_hash",
        F.size("__words").cast("long").alias("n_words"),
        F.length(without_white(F.col("__text"))).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(_replaced(F.col("__text")))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("__words")).cast("long").alias("n_repeat_words"),
        F.transform("__lines", line).alias("lines"),
    )


def _replaced(text: Column) -> Column:
    for c in SYMBOLS:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def frequent_lines(rows: DataFrame, min_docs: int = MIN_DOCS, share: float = 0, whole_documents: bool = True) -> DataFrame:
    """(host, h) of lines that more than min_docs documents and more than a share of the host's documents hold; without
    whole_documents distinct texts count in their place."""
    unit = F.xxhash64("doc_id", "text_hash") if whole_documents else F.col("text_hash")
    rows = rows.select("host", unit.alias("unit"), "lines")
    lines = rows.select("host", "unit", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    held = lines.groupBy("host", "h").agg(F.countDistinct("unit").alias("n")).filter(F.col("n") > min_docs)
    if not share:
        return held.select("host", "h")
    hosts = rows.groupBy("host").agg(F.countDistinct("unit").alias("all"))
    return held.join(hosts, "host").filter(F.col("n") > F.col("all") * share).select("host", "h")


def line_quality(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = 0, whole_documents: bool = True) -> DataFrame:
    """The contract's columns plus n_removed_words long for docs (doc_id, text, source, ...)."""
    rows = durable(text_figures(docs), "line-figures")
    often = frequent_lines(rows, min_docs, share, whole_documents)
    once = rows.select("doc_id", "text_hash", "host", "lines").dropDuplicates(["doc_id", "text_hash", "host"])
    each = once.select("doc_id", "text_hash", "host", F.explode("lines").alias("x")).select("doc_id", "text_hash", "host", F.col("x.h").alias("h"), F.col("x.n").alias("n"))
    removed = each.join(often, ["host", "h"]).groupBy("doc_id", "text_hash", "host").agg(F.sum("n").alias("n_removed_words"))
    removed = removed.select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__text"), F.col("host").alias("__host"), "n_removed_words")
    same = (F.col("text_hash") == F.col("__text")) & (F.col("host") == F.col("__host")) & F.col("doc_id").eqNullSafe(F.col("__doc"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rest = F.col("n_words") - F.col("n_removed_words")
    depleted = (F.col("n_removed_words") > 0) & ((rest < REST_WORDS) | (rest < REST_SHARE * F.col("n_words")))
    return (
        rows.join(removed, same, "left")
        .withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)).cast("long"))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "n_removed_words")
    )
