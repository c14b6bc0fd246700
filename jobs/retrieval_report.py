"""Evaluation of retrievers over a corpus: ranked hits, figures of each question and a summary, written by system.

    python jobs/retrieval_report.py jobs/retrieval_report.json [--documents PATH] [--questions PATH] [--out PATH]

Questions (item_id, text) are asked of documents (doc_id, text, lang, ...). A document is gold for a question when it holds
the question's whole text. Three systems rank: BM25, keyword overlap, and both fused by reciprocal ranks. Output under
--out, by Spark's writers; a later run replaces it, over the same tables by the same rows:

    hits/system=S         q_id, doc_id, score, rank, gold
    questions/system=S    q_id, n_gold, first_rank, hit_1, hit_3, hit_5, reciprocal_rank, ndcg_5, top
    summary/system=S      lang (of the gold documents, 'all' for all), cases and the means of the figures

Questions without a gold document have hits but no figures. Ranks follow scores rounded to nine decimals, then doc_id.
"""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from skarn.operators import metrics as M
from skarn.operators import retrieval as R
from skarn.operators.matching import phrase_hits
from skarn.session import written

log = logging.getLogger("jobs.retrieval_report")

FIGURES = ["hit_1", "hit_3", "hit_5", "reciprocal_rank", "ndcg_5"]


def put(rows: DataFrame, path: str) -> DataFrame:
    """Replace the table at path by rows, as every run ranks with all systems; what stands there then."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("system").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def ranked(scored: DataFrame, k: int) -> DataFrame:
    top = R.top_k(scored.withColumn("key", F.round("score", 9)), k, "key")
    return top.select("q_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def hits_of(docs: DataFrame, questions: DataFrame, k: int, pool: int) -> DataFrame:
    """(system, q_id, doc_id, score, rank): the k best documents of each question by each system, fused from pools of `pool`."""
    scores = written(R.word_scores(docs, questions), "word-scores")
    single = {name: scores.select("q_id", "doc_id", F.col(c).alias("score")) for name, c in (("bm25", "score"), ("overlap", "overlap"))}
    single = {name: written(ranked(rows, pool), name) for name, rows in single.items()}
    single["fused"] = ranked(R.reciprocal_rank_fusion(list(single.values())).withColumnRenamed("rrf", "score"), k)
    named = [rows.filter(F.col("rank") <= k).withColumn("system", F.lit(name)) for name, rows in single.items()]
    return named[0].unionByName(named[1]).unionByName(named[2])


def retrieval_report(spark: SparkSession, documents: str, questions: str, out: str, k: int = 10, pool: int = 30) -> dict[str, int]:
    """Write hits, questions and summary under out; returns how many rows each has for the systems of this run."""
    rows = spark.read.parquet(documents)
    docs = rows.select("doc_id", "text")
    asked = spark.read.parquet(questions).select(F.col("item_id").alias("q_id"), "text")
    log.info("asking %s of %s", questions, documents)

    passages = asked.withColumnRenamed("text", "passage")
    gold = put(phrase_hits(docs, "doc_id", "text", passages, "passage").join(passages, "passage").select("q_id", "doc_id", F.lit("gold").alias("system")), f"{out}/gold").drop("system")
    marked = hits_of(docs, asked, k, pool).join(gold.withColumn("gold", F.lit(True)), ["q_id", "doc_id"], "left")
    hits = put(marked.withColumn("gold", F.coalesce("gold", F.lit(False))), f"{out}/hits")

    wanted = gold.crossJoin(F.broadcast(spark.createDataFrame([(s,) for s in ("bm25", "overlap", "fused")], "system string")))
    figures = M.ranking_metrics(hits.select("system", "q_id", "doc_id", "rank"), wanted, ["system", "q_id"])
    figures = figures.withColumns({c: F.round(c, 6) for c in ("reciprocal_rank", "ndcg_5")})
    sizes = gold.groupBy("q_id").agg(F.count(F.lit(1)).alias("n_gold"))
    tops = hits.groupBy("system", "q_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"].cast("string")), ",").alias("top"))  # k rows a group
    each = put(figures.join(sizes, "q_id").join(tops, ["system", "q_id"], "left").withColumn("top", F.coalesce("top", F.lit(""))), f"{out}/questions")

    langs = gold.join(rows.select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang")), "doc_id").select("q_id", "lang").distinct()
    split = each.join(langs, "q_id").unionByName(each.withColumn("lang", F.lit("all")))
    summary = put(M.metric_means(split, ["system", "lang"]).withColumns({c: F.round(c, 6) for c in FIGURES}), f"{out}/summary")

    result = {"documents": docs.count(), "questions": asked.count(), "hits": hits.count(), "scored": each.count(), "summary": summary.count()}
    log.info("read %(documents)d documents and %(questions)d questions; wrote %(hits)d hits, %(scored)d scored questions, %(summary)d rows of summary", result)
    return result


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    parser.add_argument("config", help="JSON file with the arguments of retrieval_report()")
    for name in ("documents", "questions", "out"):
        parser.add_argument(f"--{name}")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("retrieval_report").getOrCreate()
    with_settings = json.loads("".join(r.value for r in spark.read.text(args.config, wholetext=True).collect()))
    retrieval_report(spark, **(with_settings | {k: v for k, v in vars(args).items() if k != "config" and v}))
    spark.stop()


if __name__ == "__main__":
    main()
