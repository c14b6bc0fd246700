"""Incremental ingestion: new documents become cited chunks, each file of the feed once.

    python jobs/ingest_chunks.py jobs/ingest_chunks.json [--documents PATH] [--out PATH] [--checkpoint PATH]

The feed is a folder (or a glob) of Parquet files (doc_id, text, lang, ...) that grows. A file stream with a checkpoint takes the files
that no earlier run has taken and ends when there are none left. Output, by Spark's writers, under --out:

    chunks/batch=N/lang=L    doc_id, chunk_no, section_title, chunk_type, char_start, char_end, n_tokens, text
    papers/batch=N/lang=L    doc_id, text_sha256, n_words, n_chunks: one row for each document taken
    rejected/batch=N         documents without an id, which could not be cited, as they came

A document that comes again with the same text (in the same or a later file) is not taken again; with another text it is a
new version: its chunks stand in a later batch. Documents without words give no chunk and a row in papers. A null or empty
lang is written as 'und'. A batch that is run again, after a crash between its writes, say, overwrites its own partitions
alone and gives the same rows.
"""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from skarn.functions.text import tokenize
from skarn.operators.chunking import cut_pages

log = logging.getLogger("jobs.ingest_chunks")

FEED = "doc_id long, text string, lang string, source string, n_chars long"


def put(rows: DataFrame, path: str, *parts: str) -> None:
    """Overwrite the partitions that rows has, and no other one."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def taken_before(spark: SparkSession, papers: str, batch: int) -> DataFrame:
    """(doc_id, text_sha256) of earlier batches: two columns of the list of papers."""
    rows = spark.read.schema("doc_id long, text_sha256 string, batch long").parquet(papers)
    return rows.filter(F.col("batch") < batch).select("doc_id", "text_sha256")


def windows_of(words: Column, target: int, overlap: int) -> Column:
    """How many windows cut_pages() cuts a page of so many words into."""
    step = max(target - overlap, 1)
    more = F.ceil((words - target) / F.lit(step))
    return F.when(words > 0, 1 + F.greatest(more, F.lit(0))).otherwise(0).cast("long")


def ingest_batch(batch: DataFrame, number: int, out: str, target: int, overlap: int) -> int:
    """Chunk one batch of the feed and write its partitions; returns the rows read."""
    spark = batch.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    lang = F.coalesce(F.nullif(F.col("lang"), F.lit("")), F.lit("und"))
    fixed = {"lang": lang, "batch": F.lit(number).cast("long")}
    seen = Observation()
    lost = batch.observe(seen, F.count(F.lit(1)).alias("n")).filter("doc_id IS NULL")
    put(lost.withColumns({"text": text, **fixed}), f"{out}/rejected", "batch")

    n_words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("long")
    rows = batch.filter("doc_id IS NOT NULL").withColumns({"text": text, **fixed, "text_sha256": F.sha2(text.cast("binary"), 256), "n_words": n_words})
    new = rows.dropDuplicates(["doc_id", "text_sha256"])
    if number > 0:
        new = new.join(taken_before(spark, f"{out}/papers", number), ["doc_id", "text_sha256"], "left_anti")
    # one version of an id in a batch is a page and has chunk numbers of its own
    pages = new.select("doc_id", "text_sha256", F.lit(1).alias("page"), "text", "lang", "batch")
    chunks = cut_pages(pages, target, overlap).select(
        "doc_id",
        F.col("window").cast("long").alias("chunk_no"),
        "section_title",
        "chunk_type",
        F.col("char_start").cast("long").alias("char_start"),
        F.col("char_end").cast("long").alias("char_end"),
        F.size(tokenize("text")).cast("long").alias("n_tokens"),
        "text",
        "text_sha256",
        "batch",
        "lang",
    )
    put(chunks, f"{out}/chunks", "batch", "lang")
    papers = new.select("doc_id", "text_sha256", "n_words", "batch", "lang")
    put(papers.withColumn("n_chunks", windows_of(F.col("n_words"), target, overlap)), f"{out}/papers", "batch", "lang")
    return seen.get["n"]


def ingest_chunks(spark: SparkSession, documents: str, out: str, checkpoint: str, target: int = 200, overlap: int = 20, files_per_batch: int | None = None) -> dict[str, int]:
    """Take what is new under documents, a folder or glob of files; returns the numbers of rows read and written."""
    feed = spark.readStream.schema(FEED)
    if files_per_batch:
        feed = feed.option("maxFilesPerTrigger", files_per_batch)
    log.info("reading new files of %s", documents)
    read: dict[int, int] = {}

    def take(batch: DataFrame, number: int) -> None:
        read[number] = ingest_batch(batch, number, out, target, overlap)

    stream = feed.parquet(documents).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    result = {"batches": len(read), "read": sum(read.values())}
    for name in ("papers", "chunks", "rejected"):
        result[name] = spark.read.schema("batch long").parquet(f"{out}/{name}").filter(F.col("batch").isin(list(read))).count() if read else 0
    log.info("took %(read)d rows in %(batches)d batches; wrote %(papers)d papers, %(chunks)d chunks, %(rejected)d rejected rows", result)
    return result


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    parser.add_argument("config", help="JSON file with the arguments of ingest_chunks()")
    for name in ("documents", "out", "checkpoint"):
        parser.add_argument(f"--{name}")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("ingest_chunks").getOrCreate()
    with_settings = json.loads("".join(r.value for r in spark.read.text(args.config, wholetext=True).collect()))
    ingest_chunks(spark, **(with_settings | {k: v for k, v in vars(args).items() if k != "config" and v}))
    spark.stop()


if __name__ == "__main__":
    main()
