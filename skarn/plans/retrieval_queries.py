"""Registered retrieval queries over whole tables, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skarn.functions import text as T
from skarn.operators import retrieval as R
from skarn.operators import sparse as S
from skarn.operators import vectors as X
from skarn.plans.base import plain_tokens_sql, sql_list, tokens_sql
from skarn.session import table, written

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _bench(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q_id"), "text")


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _bm25_sql(tok) -> str:
    return f"""
    bq AS (SELECT q_id, term, count(*) AS qtf FROM (SELECT item_id AS q_id, unnest({tok('text')}) AS term FROM benchmark) GROUP BY ALL),
    bt AS (SELECT doc_id, {tok('text')} AS t FROM documents),
    bs AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM bt),
    bp AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM bt) WHERE term IN (SELECT term FROM bq) GROUP BY ALL),
    bd AS (SELECT term, count(*) AS df FROM bp GROUP BY term),
    bm AS (SELECT q_id, doc_id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.4) / (tf + 1.4 * (1 - 0.72 + 0.72 * dl / greatest(avgdl, 1)))) AS score
           FROM bq JOIN bd USING (term) JOIN bp USING (term) CROSS JOIN bs GROUP BY q_id, doc_id)"""


def _top_sql(src: str, k: int, extra: str = "") -> str:
    return f"SELECT q_id, doc_id, round(score, 6) AS score, rank{extra} FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM {src}) WHERE rank <= {k}"


def _top(scored, k):
    """Ranks on scores rounded to nine decimals, so that the order of summation can't decide a tie."""
    ranked = R.top_k(scored.withColumn("key", F.round("score", 9)), k, "key")
    return _ranked(ranked)


def _ranked(rows):
    return rows.select("q_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


#: CTEs that end in top (q_id, doc_id, score, rank), the ten best documents of each passage.
_BM25_TOP_SQL = f"{_bm25_sql(tokens_sql)}, top AS ({_top_sql('bm', 10)})"


@query("bm25_topk", f"WITH {_bm25_sql(tokens_sql)} {_top_sql('bm', 10)}")
def bm25_topk(spark, sf_dir):
    return _ranked(S.bm25_topk(_docs(spark, sf_dir), _bench(spark, sf_dir), 10))


@query("bm25_plain_topk", f"WITH {_bm25_sql(plain_tokens_sql)} {_top_sql('bm', 10)}")
def bm25_plain_topk(spark, sf_dir):
    return _ranked(S.bm25_topk(_docs(spark, sf_dir), _bench(spark, sf_dir), 10, T.tokenize_plain))


_OVERLAP = f"""
    oq AS (SELECT item_id AS q_id, list_distinct({tokens_sql('text')}) AS t FROM benchmark),
    od AS (SELECT doc_id, unnest(list_distinct({tokens_sql('text')})) AS term FROM documents),
    ov AS (SELECT q_id, doc_id, count(*) / max(n) AS score FROM (SELECT q_id, len(t) AS n, unnest(t) AS term FROM oq) JOIN od USING (term) GROUP BY q_id, doc_id)"""


@query("keyword_overlap_topk", f"WITH {_OVERLAP} {_top_sql('ov', 5)}")
def keyword_overlap_topk(spark, sf_dir):
    return _ranked(S.overlap_topk(_docs(spark, sf_dir), _bench(spark, sf_dir), 5))


def _fused(spark, sf_dir):
    docs, bench = _docs(spark, sf_dir), _bench(spark, sf_dir)
    scores = written(R.word_scores(docs, bench), "word-scores")
    return R.reciprocal_rank_fusion([R.top_k(scores.withColumn("key", F.round(c, 9)), 30, "key") for c in ("score", "overlap")])


@query(
    "rrf_fusion",
    f"""WITH {_bm25_sql(tokens_sql)}, {_OVERLAP},
    ch AS (SELECT q_id, doc_id, row_number() OVER (PARTITION BY q_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm QUALIFY rank <= 30
           UNION ALL SELECT q_id, doc_id, row_number() OVER (PARTITION BY q_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM ov QUALIFY rank <= 30),
    rf AS (SELECT q_id, doc_id, sum(1.0 / (60 + rank)) AS score FROM ch GROUP BY q_id, doc_id) {_top_sql('rf', 10)}""",
)
def rrf_fusion(spark, sf_dir):
    return _top(_fused(spark, sf_dir).withColumnRenamed("rrf", "score"), 10)


@query(
    "hybrid_page_boost",
    f"""WITH {_bm25_sql(tokens_sql)}, {_OVERLAP},
    ch AS (SELECT q_id, doc_id, row_number() OVER (PARTITION BY q_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm QUALIFY rank <= 30
           UNION ALL SELECT q_id, doc_id, row_number() OVER (PARTITION BY q_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM ov QUALIFY rank <= 30),
    rf AS (SELECT q_id, doc_id, sum(1.0 / (60 + rank)) + CASE WHEN doc_id % 7 = q_id % 7 THEN 0.05 ELSE 0 END AS score FROM ch GROUP BY q_id, doc_id) {_top_sql('rf', 5)}""",
)
def hybrid_page_boost(spark, sf_dir):
    fused = _fused(spark, sf_dir)
    hinted = fused.filter(F.col("doc_id") % 7 == F.col("q_id") % 7)
    return _top(R.page_boost(fused, hinted), 5)


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")


_VEC = """v AS (SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings)"""


@query(
    "cosine_topk",
    f"""WITH {_VEC}, c AS (SELECT a.doc_id AS q_id, b.doc_id, greatest(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 0) AS score
    FROM v a JOIN v b ON a.doc_id <> b.doc_id) {_top_sql('c', 10)}""",
)
def cosine_topk(spark, sf_dir):
    v = _vectors(spark, sf_dir).select("doc_id", "vector")
    return _ranked(X.cosine_topk(v, v, 10))


@query(
    "maxsim_topk",
    f"""WITH {_VEC}, p AS (SELECT doc_id, list_transform(range(0, 8), lambda i: e[i * 8 + 1:i * 8 + 8]) AS m FROM v),
    c AS (SELECT a.doc_id AS q_id, b.doc_id, list_sum(list_transform(a.m, lambda t: list_max(list_transform(b.m, lambda x: list_dot_product(t, x))))) / 8 AS score
    FROM p a JOIN p b ON a.doc_id <> b.doc_id WHERE a.doc_id % 50 = 0) {_top_sql('c', 10)}""",
)
def maxsim_topk(spark, sf_dir):
    patches = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("vector", i * 8 + 1, F.lit(8)))
    pages = _vectors(spark, sf_dir).select("doc_id", patches.alias("patches"))
    queries = pages.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("q_id"), F.col("patches").alias("tokens"))
    return _ranked(X.maxsim_topk(queries, pages, 10))


@query(
    "heuristic_rerank",
    r"""WITH r AS (
        SELECT b.item_id AS q_id, d.doc_id, lower(b.text) AS q, lower(d.text) AS t, d.doc_id % 5 = 0 AS tab, d.doc_id % 3 = 0 AS fig, d.doc_id % 11 = 0 AS br,
               CASE d.doc_id % 4 WHEN 0 THEN 'result' WHEN 1 THEN 'method' ELSE 'body' END AS ct
        FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)
    ), w AS (SELECT *, list_distinct(regexp_extract_all(q, '[\p{L}\p{N}_\p{M}]+')) AS qw, list_distinct(regexp_extract_all(t, '[\p{L}\p{N}_\p{M}]+')) AS tw FROM r)
    SELECT q_id, doc_id, round(least(1.0, 0.5 * len(list_intersect(qw, tw)) / greatest(len(list_distinct(list_concat(qw, tw))), 1) + 0.3 / (60 + doc_id % 30 + 1)
        + CASE WHEN br THEN 0.35 WHEN contains(q, 'table') AND tab THEN 0.2 WHEN (contains(q, 'figure') OR contains(q, 'plot')) AND fig THEN 0.2 ELSE 0 END
        + CASE WHEN regexp_matches(q, 'outperform|crossover|tradeoff|trade-off|threshold|input context|context length|scaling|better|degrade|versus|vs')
               AND (ct = 'result' OR regexp_matches(t, 'result|observation|evaluation|discussion|scaling')) THEN 0.25 ELSE 0 END), 6) AS rerank_score FROM w""",
)
def heuristic_rerank(spark, sf_dir):
    bench = table(spark, sf_dir, "benchmark")
    n = bench.agg(F.count(F.lit(1)).alias("n"))
    d = table(spark, sf_dir, "documents").join(F.broadcast(n))
    rows = d.join(bench.select("item_id", F.col("text").alias("query")), F.col("item_id") == F.col("doc_id") % F.col("n")).select(
        F.col("item_id").alias("q_id"),
        "doc_id",
        "query",
        "text",
        (1.0 / (60 + F.col("doc_id") % 30 + 1)).alias("rrf"),
        F.when(F.col("doc_id") % 4 == 0, "result").when(F.col("doc_id") % 4 == 1, "method").otherwise("body").alias("chunk_type"),
        F.lit("").alias("caption"),
        (F.col("doc_id") % 11 == 0).alias("is_bridged"),
        (F.col("doc_id") % 5 == 0).alias("is_table"),
        (F.col("doc_id") % 3 == 0).alias("is_figure"),
        F.lit(0.0).alias("image_boost"),
        F.lit(0.0).alias("page_boost"),
    )
    return R.heuristic_rerank(rows).select("q_id", "doc_id", F.round("rerank_score", 6).alias("rerank_score"))


@query(
    "bridge_edges",
    f"""WITH n AS (SELECT conv_id AS q_id, turn AS pos, role AS source, unnest(list_distinct(list_filter({tokens_sql('lower(text)')}, lambda w: length(w) >= 4 AND NOT list_contains({sql_list(R.BRIDGE_STOP)}, w)))) AS w FROM conversations)
    SELECT a.q_id, a.pos, b.pos AS pos2, count(*) AS shared, least(1.0, count(*) / 5.0) AS weight FROM n a JOIN n b ON a.q_id = b.q_id AND a.w = b.w AND a.pos < b.pos AND a.source <> b.source GROUP BY 1, 2, 3 HAVING count(*) >= 2""",
)
def bridge_edges(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return R.bridge_edges(c.select(F.col("conv_id").alias("q_id"), F.col("turn").alias("pos"), F.col("role").alias("source"), "text"))


_S = lambda t: f"list_filter(regexp_extract_all(lower({t}), '[a-z0-9]+'), lambda w: NOT list_contains({sql_list(T.SEARCH_STOP)}, w) AND length(w) > 1)"
_SS = lambda t: f"list_transform({_S(t)}, lambda w: CASE WHEN w LIKE '%s' AND length(w) > 3 THEN left(w, length(w) - 1) ELSE w END)"
_N = lambda t: f"trim(regexp_replace(lower({t}), '[^a-z0-9]+', ' ', 'g'))"


@query(
    "paper_relevance",
    f"""WITH q AS (SELECT p_size AS q_id, {_N('min(p_type)')} AS qn, list_distinct({_SS('min(p_type)')}) AS qt, len({_SS('min(p_type)')}) AS nt FROM part GROUP BY p_size),
    p AS (SELECT p_partkey AS doc_id, {_N('p_name')} AS tn, list_distinct({_SS('p_name')}) AS a, list_distinct({_SS('p_type')}) AS b, list_distinct({_SS('p_brand')}) AS c, list_distinct({_SS("'part'")}) AS d FROM part),
    h AS (SELECT q_id, doc_id, qn, tn, nt, greatest(len(qt), 1) AS n, len(list_intersect(qt, a)) AS ha, len(list_intersect(qt, b)) AS hb, len(list_intersect(qt, c)) AS hc, len(list_intersect(qt, d)) AS hd,
          len(list_intersect(qt, list_distinct(a || b || c || d))) AS m FROM p, q WHERE list_has_any(a || b || c || d, qt)),
    s AS (SELECT q_id, doc_id, m AS matched, CASE WHEN qn = tn THEN 200 WHEN qn <> '' AND contains(tn, qn) THEN 90 WHEN tn <> '' AND contains(qn, tn) THEN 70 ELSE 0 END
          + 14.0 * ha + 3.0 * hb + 8.0 * hc + 5.0 * hd + ha / n * 35.0 + m / n * 12.0 - CASE WHEN nt >= 2 AND m < 2 THEN 40 ELSE 0 END AS score FROM h)
    SELECT q_id, doc_id, matched, round(score, 6) AS score FROM s WHERE score >= 8 AND matched > 0""",
)
def paper_relevance(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    q = part.groupBy(F.col("p_size").alias("q_id")).agg(F.min("p_type").alias("text"))
    p = part.select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("title"), F.col("p_type").alias("summary"), F.col("p_brand").alias("authors"), F.lit("part").alias("category"))
    return R.paper_relevance(p, q, T.search_tokens, T.alphanumeric).withColumn("score", F.round("score", 6))


@query(
    "hashing_encoder",
    r"""WITH w AS (SELECT item_id AS doc_id, unnest(list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{L}\p{N}\p{M}_\s]', ' ', 'g'), '\s+'), lambda w: w <> '')) AS w FROM benchmark),
    f AS (SELECT doc_id, 'word' AS kind, w AS f, 1.0 AS x FROM w UNION ALL SELECT doc_id, 'trigram', w[i:i + 2], 0.5 FROM (SELECT doc_id, w, unnest(range(1, length(w) - 1)) AS i FROM w)),
    h AS (SELECT doc_id, sha256('sha256-signed-feature-hashing-v1' || chr(0) || kind || chr(0) || f) AS d, x FROM f),
    b AS (SELECT doc_id, CAST(CAST('0x' || left(d, 16) AS UBIGINT) % 384 AS INTEGER) AS bucket, sum(CASE WHEN CAST('0x' || d[18:18] AS INTEGER) % 2 = 0 THEN x ELSE -x END) AS v FROM h GROUP BY ALL)
    SELECT doc_id, bucket, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 9) AS value FROM b WHERE v <> 0""",
)
def hashing_encoder(spark, sf_dir):
    docs = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return R.hashing_encoder(docs).withColumn("value", F.round("value", 9))
