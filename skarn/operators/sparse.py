"""Exact top-k over weighted terms with bounds, so that common terms make no row for every query and document.

The postings of a term lie in order of their impact, in blocks with a maximum each. A first probe of the best blocks of a few terms
gives every query the score that its k-th answer has at least. Terms whose bounds together stay below it are passive: a
document that has only such terms is no answer, so their lists are not read for candidates. Of the other terms only blocks
are read whose maximum, with the bounds of all other terms, may reach the threshold. Candidates are then scored exactly
with all terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skarn.functions.text import tokenize
from skarn.operators.ranks import ascending, numbered
from skarn.operators.retrieval import B, K1, postings, term_counts, top_k
from skarn.session import written

#: Postings of a block, and a query's terms of largest bound whose best blocks are probed first.
BLOCK = 128
PROBED = 6

#: What rounding may take from a bound; scores are compared to nine decimals.
SLACK = 1e-6


class Impacts:
    """Postings (doc_id, term, impact) in impact order: table (doc_id, term, impact, block), blocks (term, block, most)."""

    def __init__(self, rows: DataFrame):
        placed = numbered(rows.select("doc_id", "term", "impact"), ["term"], [F.col("impact").desc(), *ascending("doc_id")], "__at")
        self.table = written(placed.withColumn("block", F.floor((F.col("__at") - 1) / BLOCK)).drop("__at"), "impacts")
        self.blocks = written(self.table.groupBy("term", "block").agg(F.max("impact").alias("most"), F.count(F.lit(1)).alias("n")), "impact-blocks")
        self.terms = self.blocks.groupBy("term").agg(F.max("most").alias("top"), F.sum("n").alias("df"))


def scored(pairs: DataFrame, impacts: Impacts, weights: DataFrame) -> DataFrame:
    """(q_id, doc_id, score) of pairs (q_id, doc_id): the sum of weight times impact over all terms they share."""
    rows = pairs.join(impacts.table.select("doc_id", "term", "impact"), "doc_id").join(weights.select("q_id", "term", "w"), ["q_id", "term"])
    return rows.groupBy("q_id", "doc_id").agg(F.sum(F.col("w") * F.col("impact")).alias("score"))


def candidates(impacts: Impacts, weights: DataFrame, k: int) -> DataFrame:
    """(q_id, doc_id), once: all pairs that may be among the k best of weights (q_id, term, w), and others."""
    own = written(weights.join(impacts.terms, "term").withColumn("bound", F.col("w") * F.col("top")), "term-bounds")
    first = own.withColumn("__r", F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("bound"), "term"))).filter(F.col("__r") <= PROBED)  # the terms of one query
    near = first.select("q_id", "term").join(impacts.table.filter("block = 0").select("term", "doc_id"), "term").select("q_id", "doc_id").distinct()
    best = top_k(scored(near, impacts, weights).withColumn("__key", F.round("score", 9)), k, "__key")
    known = best.filter(F.col("rank") == k).select("q_id", F.col("score").alias("tau"))
    order = Window.partitionBy("q_id").orderBy(F.col("bound") / F.col("df"), "term")  # the terms of one query
    upto = own.withColumn("__upto", F.sum("bound").over(order)).withColumn("__all", F.sum("bound").over(Window.partitionBy("q_id")))
    active = upto.join(known, "q_id", "left").withColumn("need", F.coalesce("tau", F.lit(-1.0)) - SLACK).filter("__upto >= need")
    read = active.select("q_id", "term", "w", (F.col("need") - F.col("__all") + F.col("bound")).alias("least")).join(impacts.blocks.select("term", "block", "most"), "term").filter("w * most >= least")
    return read.select("q_id", "term", "block").join(impacts.table.select("term", "block", "doc_id"), ["term", "block"]).select("q_id", "doc_id").distinct()


def sparse_topk(impacts: Impacts, weights: DataFrame, k: int) -> DataFrame:
    """(q_id, doc_id, score, rank): the k best of each query; ties to nine decimals go by doc_id."""
    found = scored(written(candidates(impacts, weights, k), "term-candidates"), impacts, weights)
    return top_k(found.withColumn("__key", F.round("score", 9)), k, "__key").drop("__key")


def bm25_parts(docs: DataFrame, queries: DataFrame, tokens=tokenize, k1: float = K1, b: float = B, table: DataFrame | None = None) -> tuple[Impacts, DataFrame]:
    """The impacts of documents and the weights of queries under Okapi BM25. table: postings() of both, if at hand."""
    post = table if table is not None else postings(docs, queries, tokens)
    stats = post.filter("term = ''").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    real = post.filter("term <> ''")
    df = real.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weights = term_counts(queries, "q_id", tokens("text")).join(df, "term").join(F.broadcast(stats)).select("q_id", "term", (F.col("tf") * idf).alias("w"))  # stats: one row
    norm = k1 * (1 - b + b * F.col("dl") / F.greatest(F.col("avgdl"), F.lit(1.0)))
    impact = F.col("tf") * (k1 + 1) / (F.col("tf") + norm)
    return Impacts(real.join(F.broadcast(stats)).select("doc_id", "term", impact.alias("impact"))), written(weights, "term-weights")


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int, tokens=tokenize, table: DataFrame | None = None) -> DataFrame:
    """(q_id, doc_id, score, rank), the k best documents (doc_id, text) that share a term with a query (q_id, text)."""
    return sparse_topk(*bm25_parts(docs, queries, tokens, table=table), k)


def overlap_parts(docs: DataFrame, queries: DataFrame, tokens=tokenize, table: DataFrame | None = None) -> tuple[Impacts, DataFrame]:
    """Each shared distinct token counts one over the query's number of them."""
    post = table if table is not None else postings(docs, queries, tokens)
    q = queries.select("q_id", F.array_distinct(tokens("text")).alias("t")).select("q_id", (1 / F.size("t")).alias("w"), F.explode("t").alias("term"))
    return Impacts(post.filter("term <> ''").select("doc_id", "term", F.lit(1.0).alias("impact"))), written(q, "term-weights")


def overlap_topk(docs: DataFrame, queries: DataFrame, k: int, tokens=tokenize, table: DataFrame | None = None) -> DataFrame:
    """(q_id, doc_id, score, rank): shared distinct tokens over the query's distinct tokens, the k best."""
    return sparse_topk(*overlap_parts(docs, queries, tokens, table), k)
