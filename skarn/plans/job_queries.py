"""The jobs of jobs/ as registered queries: each runs twice into a folder of its own, and its output is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobs.ingest_chunks import ingest_chunks
from jobs.retrieval_report import retrieval_report
from skarn.plans.base import tokens_sql
from skarn.plans.metric_queries import _GOLD_SQL
from skarn.plans.retrieval_queries import _OVERLAP, _bm25_sql
from skarn.session import lasting_folder

QUERIES, ORACLE_SQL = {}, {}

_WINDOWS = r"""p AS (SELECT doc_id, coalesce(nullif(lang, ''), 'und') AS lang, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda w: w <> '') AS w FROM documents),
    s AS (SELECT doc_id, lang, w, unnest(list_filter(range(0, len(w), 180), lambda s: s = 0 OR s - 180 + 200 < len(w))) AS s FROM p WHERE len(w) > 0),
    t AS (SELECT doc_id, lang, s, array_to_string(w[s + 1:s + 200], ' ') AS t, CASE WHEN s > 0 THEN length(array_to_string(w[1:s], ' ')) ELSE 0 END AS a FROM s)"""

ORACLE_SQL["job1_ingest_chunks"] = f"""
    WITH {_WINDOWS}
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS chunk_no, a AS char_start, a + length(t) AS char_end, CAST(len({tokens_sql('t')}) AS BIGINT) AS n_tokens, md5(t) AS text_md5,
           lang, CAST(0 AS BIGINT) AS batch, len(w) AS n_words, count(*) OVER (PARTITION BY doc_id) AS n_chunks, sha256(text) AS text_sha256
    FROM t JOIN p USING (doc_id, lang)
"""


def job1_ingest_chunks(spark, sf_dir):
    """Every chunk beside its paper's row; the second run finds nothing new."""
    out = lasting_folder(spark, "job1-ingest-chunks")
    for _ in range(2):
        ingest_chunks(spark, f"{sf_dir}/documents.parquet*", f"{out}/evidence", f"{out}/checkpoint", target=200, overlap=20)
    papers = spark.read.parquet(f"{out}/evidence/papers").select("doc_id", "text_sha256", "n_words", "n_chunks")
    chunks = spark.read.parquet(f"{out}/evidence/chunks").withColumn("text_md5", F.md5(F.col("text").cast("binary"))).drop("text")
    both = chunks.join(papers, ["doc_id", "text_sha256"])
    return both.select("doc_id", "chunk_no", "char_start", "char_end", "n_tokens", "text_md5", "lang", F.col("batch").cast("long").alias("batch"), "n_words", "n_chunks", "text_sha256")


QUERIES["job1_ingest_chunks"] = job1_ingest_chunks

_RANK = "row_number() OVER (PARTITION BY q_id ORDER BY round(score, 9) DESC, doc_id) AS rank"

ORACLE_SQL["job2_retrieval_report"] = f"""
    WITH {_bm25_sql(tokens_sql)}, {_OVERLAP}, {_GOLD_SQL},
    b30 AS (SELECT *, {_RANK} FROM bm QUALIFY rank <= 30), o30 AS (SELECT *, {_RANK} FROM ov QUALIFY rank <= 30),
    f AS (SELECT q_id, doc_id, sum(1.0 / (60 + rank)) AS score FROM (SELECT q_id, doc_id, rank FROM b30 UNION ALL SELECT q_id, doc_id, rank FROM o30) GROUP BY q_id, doc_id),
    h AS (SELECT 'bm25' AS system, q_id, doc_id, rank FROM b30 WHERE rank <= 10 UNION ALL SELECT 'overlap', q_id, doc_id, rank FROM o30 WHERE rank <= 10
          UNION ALL SELECT 'fused', q_id, doc_id, rank FROM (SELECT *, {_RANK} FROM f QUALIFY rank <= 10)),
    ng AS (SELECT system, q_id, count(*) AS n FROM gold, (SELECT unnest(['bm25', 'overlap', 'fused']) AS system) GROUP BY ALL),
    r AS (SELECT system, q_id, min(rank) AS fr, sum(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM h JOIN gold USING (q_id, doc_id) GROUP BY ALL),
    tops AS (SELECT system, q_id, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank) AS top FROM h GROUP BY ALL)
    SELECT system, q_id, n AS n_gold, fr AS first_rank, coalesce(CAST(fr <= 1 AS INT), 0) AS hit_1, coalesce(CAST(fr <= 3 AS INT), 0) AS hit_3, coalesce(CAST(fr <= 5 AS INT), 0) AS hit_5,
           round(coalesce(1 / fr, 0), 6) AS reciprocal_rank, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg_5, coalesce(top, '') AS top
    FROM ng LEFT JOIN r USING (system, q_id) LEFT JOIN tops USING (system, q_id)
"""


def job2_retrieval_report(spark, sf_dir):
    """The scored questions of each system as they stand after a second run over the same tables."""
    out = lasting_folder(spark, "job2-retrieval-report")
    for _ in range(2):
        retrieval_report(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", out, k=10, pool=30)
    return spark.read.parquet(f"{out}/questions").select("system", "q_id", "n_gold", "first_rank", "hit_1", "hit_3", "hit_5", "reciprocal_rank", "ndcg_5", "top")


QUERIES["job2_retrieval_report"] = job2_retrieval_report
