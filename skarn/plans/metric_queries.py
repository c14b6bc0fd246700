"""Registered metric queries over whole tables, with DuckDB SQL.

Bindings: labels and documents give paired judgements, orders and lineitem give scored runs, events give latencies.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skarn.operators import metrics as M
from skarn.operators.matching import gold_chunks, phrase_hits
from skarn.plans.base import quoted, tokens_sql
from skarn.plans.retrieval_queries import _BM25_TOP_SQL, bm25_topk
from skarn.functions.text import ASCII_PUNCTUATION
from skarn.session import table

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


_GOLD_SQL = "gold AS (SELECT b.item_id AS q_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def _gold(spark, sf_dir):
    """Documents that hold a whole benchmark passage."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q_id"), F.col("text").alias("passage"))
    hits = phrase_hits(table(spark, sf_dir, "documents"), "doc_id", "text", b, "passage")
    return hits.join(b, "passage").select("q_id", "doc_id")


_METRIC_SQL = f"""{_GOLD_SQL}, ng AS (SELECT q_id, count(*) AS n FROM gold GROUP BY q_id),
    h AS (SELECT q_id, min(rank) AS fr, sum(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM top JOIN gold USING (q_id, doc_id) GROUP BY q_id),
    m AS (SELECT q_id, fr AS first_rank, coalesce(CAST(fr <= 1 AS INT), 0) AS hit_1, coalesce(CAST(fr <= 3 AS INT), 0) AS hit_3, coalesce(CAST(fr <= 5 AS INT), 0) AS hit_5,
          coalesce(1 / fr, 0) AS reciprocal_rank, coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 1 / log2(i + 1))) AS ndcg_5 FROM ng LEFT JOIN h USING (q_id))"""


def _metrics(spark, sf_dir):
    return M.ranking_metrics(bm25_topk(spark, sf_dir), _gold(spark, sf_dir), ["q_id"])


@query("hit_mrr_ndcg", f"WITH {_BM25_TOP_SQL}, {_METRIC_SQL} SELECT q_id, first_rank, hit_1, hit_3, hit_5, round(reciprocal_rank, 6) AS reciprocal_rank, round(ndcg_5, 6) AS ndcg_5 FROM m")
def hit_mrr_ndcg(spark, sf_dir):
    return _rounded(_metrics(spark, sf_dir), "reciprocal_rank", "ndcg_5")


@query(
    "capability_breakdown",
    f"""WITH {_BM25_TOP_SQL}, {_METRIC_SQL} SELECT q_id % 3 AS capability, count(*) AS total_cases, count(*) FILTER (q_id % 5 <> 0) AS cases,
    {', '.join(f"round(avg(CASE WHEN q_id % 5 <> 0 THEN {c} END), 6) AS {c}" for c in ('hit_1', 'hit_3', 'hit_5', 'reciprocal_rank', 'ndcg_5'))} FROM m GROUP BY 1""",
)
def capability_breakdown(spark, sf_dir):
    rows = _metrics(spark, sf_dir).withColumn("capability", F.col("q_id") % 3)
    return _rounded(M.metric_means(rows, ["capability"], F.col("q_id") % 5 != 0), "hit_1", "hit_3", "hit_5", "reciprocal_rank", "ndcg_5")


@query(
    "page_order",
    "SELECT case_id, page, row_number() OVER (PARTITION BY case_id ORDER BY first, page) AS rank FROM (SELECT l_orderkey AS case_id, l_suppkey % 7 AS page, min(l_linenumber) AS first FROM lineitem GROUP BY ALL)",
)
def page_order(spark, sf_dir):
    hits = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), (F.col("l_suppkey") % 7).alias("page"), F.col("l_linenumber").alias("rank"))
    return M.distinct_pages(hits, ["case_id"]).withColumn("rank", F.col("rank").cast("long"))


_BOX = lambda a, b: f"({a} % 50) / 100.0 AS x0, ({a} % 50) / 100.0 + 0.4 AS x1, ({b} % 40) / 100.0 AS y0, ({b} % 40) / 100.0 + 0.5 AS y1"


@query(
    "region_recall_iou",
    f"""WITH c AS (SELECT l_orderkey AS case_id, l_linenumber % 3 AS page, {_BOX('l_partkey', 'l_suppkey')} FROM lineitem), g AS (SELECT o_orderkey AS case_id, o_custkey % 3 AS page, {_BOX('o_custkey', 'o_orderkey')} FROM orders),
    p AS (SELECT case_id, greatest(0, least(c.x1, g.x1) - greatest(c.x0, g.x0)) * greatest(0, least(c.y1, g.y1) - greatest(c.y0, g.y0)) AS i, (c.x1 - c.x0) * (c.y1 - c.y0) + (g.x1 - g.x0) * (g.y1 - g.y0) AS s FROM c JOIN g USING (case_id, page))
    SELECT g.case_id, coalesce(max(CAST(round(i / (s - i), 9) >= 0.5 AS INT)), 0) AS hit FROM g LEFT JOIN p USING (case_id) GROUP BY 1""",
)
def region_recall_iou(spark, sf_dir):
    def box(df, a, b):
        x, y = (F.col(a) % 50) / 100.0, (F.col(b) % 40) / 100.0
        return [x.alias("x0"), (x + 0.4).alias("x1"), y.alias("y0"), (y + 0.5).alias("y1")]

    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    c = li.select(F.col("l_orderkey").alias("case_id"), (F.col("l_linenumber") % 3).alias("page"), *box(li, "l_partkey", "l_suppkey"))
    g = o.select(F.col("o_orderkey").alias("case_id"), (F.col("o_custkey") % 3).alias("page"), *box(o, "o_custkey", "o_orderkey"))
    return M.region_recall(c, g, 0.5 - 5e-10)


def _turns(spark, sf_dir):
    """Each turn against the turn before it, as prediction against reference."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations")
    key = F.concat_ws(":", "conv_id", "turn").alias("key")
    return c.select(key, F.col("text").alias("prediction"), F.lag("text").over(w).alias("reference")).filter("reference IS NOT NULL")


_TURNS = "t AS (SELECT conv_id || ':' || turn AS key, text AS p, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations QUALIFY r IS NOT NULL)"
_SQ = lambda c: rf"list_filter(string_split_regex(translate(lower({c}), {quoted(ASCII_PUNCTUATION)}, ''), '\s+'), lambda w: NOT list_contains(['', 'a', 'an', 'the'], w))"


@query(
    "token_f1",
    f"""WITH {_TURNS}, w AS (SELECT key, {_SQ('p')} AS pw, {_SQ('r')} AS rw FROM t),
    a AS (SELECT key, w, count(*) AS np FROM (SELECT key, unnest(pw) AS w FROM w) GROUP BY ALL), b AS (SELECT key, w, count(*) AS nr FROM (SELECT key, unnest(rw) AS w FROM w) GROUP BY ALL),
    s AS (SELECT key, sum(least(np, nr)) AS s FROM a JOIN b USING (key, w) GROUP BY key),
    m AS (SELECT key, pw, rw, CASE WHEN len(pw) > 0 THEN coalesce(s, 0) / len(pw) ELSE 0 END AS p, CASE WHEN len(rw) > 0 THEN coalesce(s, 0) / len(rw) ELSE 0 END AS r FROM w LEFT JOIN s USING (key))
    SELECT key, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN len(pw) = 0 AND len(rw) = 0 THEN 1 WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, CAST(pw = rw AS INT) AS exact FROM m""",
)
def token_f1(spark, sf_dir):
    return _rounded(M.token_f1(_turns(spark, sf_dir), "key", True), "precision", "recall", "f1")


_LW = lambda c: rf"list_distinct(list_filter(string_split_regex(lower({c}), '\s+'), lambda w: w <> ''))"


_SET_F1 = f"""{_TURNS}, u AS (SELECT key, p, CASE WHEN length(p) % 5 = 0 THEN '' ELSE r END AS r, length(p) % 2 = 0 AS a, length(p) % 3 = 0 AS g FROM t), w AS (SELECT key, {_LW('p')} AS p, {_LW('r')} AS r, a, g FROM u),
    f AS (SELECT key, CASE WHEN len(r) = 0 AND a THEN 1.0 ELSE coalesce(2.0 * len(list_intersect(p, r)) / nullif(len(p) + len(r), 0), 0) END AS f1, CAST(g AS INT) AS evidence FROM w)"""


def _set_f1(spark, sf_dir):
    """A fifth of the turns has no reference; half abstain."""
    n = F.length("prediction")
    t = _turns(spark, sf_dir)
    return M.set_f1(t.select("key", "prediction", F.when(n % 5 == 0, "").otherwise(F.col("reference")).alias("reference"), (n % 2 == 0).alias("abstained"), (n % 3 == 0).alias("gold_page_found")), "key")


@query("set_f1", f"WITH {_SET_F1} SELECT key, round(f1, 6) AS f1, evidence FROM f")
def set_f1(spark, sf_dir):
    return _rounded(_set_f1(spark, sf_dir), "f1")


@query("set_f1_means", f"WITH {_SET_F1} SELECT round(avg(f1), 4) AS answer_f1, round(avg(evidence), 4) AS evidence_recall FROM f")
def set_f1_means(spark, sf_dir):
    return M.set_f1_means(_set_f1(spark, sf_dir))


_CL = lambda c: rf"list_filter(list_transform(string_split_regex({c}, '[,.;\n]'), lambda x: trim(x)), lambda x: len(regexp_extract_all(x, '\S+')) >= 3)"
_LONG = lambda c: f"list_filter({_SQ(c)}, lambda v: length(v) > 3)"


@query(
    "unit_overlap",
    f"""WITH {_TURNS}, c AS (SELECT key, CASE WHEN len({_CL('r')}) > 0 THEN {_CL('r')} ELSE [r] END AS u, {_CL('p')} AS pc, array_to_string({_SQ('p')}, ' ') AS pn, array_to_string({_SQ("r || ' ' || r")}, ' ') AS ge FROM t),
    m AS (SELECT key, len(list_filter(u, lambda x: len({_LONG('x')}) > 0 AND len(list_filter({_LONG('x')}, lambda w: contains(pn, w))) >= 0.5 * len({_LONG('x')}))) / len(u) AS recall,
          len(list_filter(pc, lambda x: len({_LONG('x')}) > 0 AND len(list_filter({_LONG('x')}, lambda w: contains(ge, w))) >= 0.4 * len({_LONG('x')}))) / greatest(len(pc), 1) AS precision FROM c)
    SELECT key, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM m""",
)
def unit_overlap(spark, sf_dir):
    return _rounded(M.unit_overlap(_turns(spark, sf_dir).withColumn("evidence", F.col("reference")), "key"), "precision", "recall", "f1")


@query(
    "abstention_prf",
    """WITH c AS (SELECT source, count(*) FILTER (toxic = 1 AND quality = 0) AS tp, count(*) FILTER (toxic = 1 AND quality <> 0) AS fp, count(*) FILTER (toxic <> 1 AND quality = 0) AS fn, count(*) FILTER (toxic <> 1 AND quality <> 0) AS tn FROM labels JOIN documents USING (doc_id) GROUP BY source),
    r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM c)
    SELECT source, tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM r""",
)
def abstention_prf(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return _rounded(M.confusion_prf(rows, F.col("toxic") == 1, F.col("quality") == 0, ["source"]), "precision", "recall", "f1")


@query(
    "label_kappa",
    """WITH j AS (SELECT lang, CAST(quality AS VARCHAR) AS a, CASE WHEN length(text) > 1000 THEN '1' ELSE '0' END AS b FROM labels JOIN documents USING (doc_id)),
    t AS (SELECT lang, count(*) AS n, count(*) FILTER (a = b) AS same FROM j GROUP BY lang),
    l AS (SELECT lang, a AS k, count(*) AS ca FROM j GROUP BY ALL), r AS (SELECT lang, b AS k, count(*) AS cb FROM j GROUP BY ALL), c AS (SELECT lang, sum(ca * cb) AS c FROM l JOIN r USING (lang, k) GROUP BY lang)
    SELECT lang, n, round(CASE WHEN coalesce(c, 0) / (n * n) = 1 THEN 1 ELSE (same / n - coalesce(c, 0) / (n * n)) / (1 - coalesce(c, 0) / (n * n)) END, 6) AS kappa FROM t LEFT JOIN c USING (lang)""",
)
def label_kappa(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.length("text") > 1000, "1").otherwise("0").alias("b"))
    rows = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("a")).join(d, "doc_id")
    return _rounded(M.cohens_kappa(rows, "a", "b", ["lang"]), "kappa")


@query(
    "pearson_by_segment",
    """SELECT c_mktsegment AS segment, count(*) AS n, round(avg(c_acctbal), 6) AS mean_x, round(stddev_pop(c_acctbal), 6) AS stdev_x, round(corr(c_acctbal, c_nationkey), 6) AS r FROM customer GROUP BY 1""",
)
def pearson_by_segment(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "segment")
    return _rounded(M.pearson(rows, "c_acctbal", "c_nationkey", ["segment"]), "mean_x", "stdev_x", "r")


@query(
    "spearman_ranks",
    """WITH k AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS rx,
    rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2 AS ry FROM lineitem)
    SELECT l_returnflag, count(*) AS n, round(corr(rx, ry), 6) AS r FROM k GROUP BY 1""",
)
def spearman_ranks(spark, sf_dir):
    return _rounded(M.spearman(table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount", ["l_returnflag"]), "r")


@query("friedman")
def friedman(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("t")).agg(F.round(F.avg("l_quantity")).alias("v"))
    return _rounded(M.friedman(rows, "s", "t", "v"), "q", "p_value")


@query(
    "holm_adjusted",
    """WITH p AS (SELECT p_brand, p_partkey, p_size / 1000.0 AS p FROM part), s AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY p_brand) - row_number() OVER (PARTITION BY p_brand ORDER BY p, p_partkey) + 1) * p) AS s FROM p)
    SELECT p_brand, p_partkey, p, round(max(s) OVER (PARTITION BY p_brand ORDER BY p, p_partkey ROWS UNBOUNDED PRECEDING), 6) AS p_adjusted FROM s""",
)
def holm_adjusted(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", (F.col("p_size") / 1000.0).alias("p"))
    return _rounded(M.holm(rows, "p", ["p_brand"]), "p_adjusted")


@query("cluster_bootstrap")
def cluster_bootstrap(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    return _rounded(M.cluster_bootstrap(rows, "lang", "source", "quality", draws=2000), "mean", "ci_low", "ci_high")


@query("paired_delta_bootstrap")
def paired_delta_bootstrap(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").withColumns({"g": F.col("s_nationkey") % 3, "a": F.col("s_acctbal"), "b": F.col("s_acctbal") * 0.9 + F.col("s_suppkey") % 5})
    return _rounded(M.paired_delta(rows, "g", "s_suppkey", "a", "b", draws=2000), "delta", "lo", "hi")


@query(
    "latency_order_stats",
    """SELECT event_type, p50, p95, round(mean, 6) AS mean FROM (SELECT event_type, list_sort(list(value)) AS v, avg(value) AS mean, v[least(len(v) - 1, CAST(floor(0.5 * len(v)) AS INT)) + 1] AS p50,
    v[least(len(v) - 1, CAST(floor(0.95 * len(v)) AS INT)) + 1] AS p95 FROM events WHERE value IS NOT NULL GROUP BY 1)""",
)
def latency_order_stats(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "value")
    both = M.order_statistics(e, "value", {"p50": 0.5, "p95": 0.95}, ["event_type"])
    return both.join(e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean")), "event_type")


@query(
    "random_floor",
    "SELECT conv_id, n, round(1.0 / n, 6) AS floor_r1, round(least(5, n) / n, 6) AS floor_r5, round(list_sum(list_transform(range(1, n + 1), lambda i: 1.0 / i)) / n, 6) AS floor_mrr FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)",
)
def random_floor(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return _rounded(M.random_floor(rows, "n"), "floor_r1", "floor_r5", "floor_mrr")


# Release runs bound to the star schema: systems are order priorities, models regions, seeds 0 to 2, cases parts.


def _axes(spark, sf_dir):
    o, r, p = table(spark, sf_dir, "orders"), table(spark, sf_dir, "region"), table(spark, sf_dir, "part")
    return (
        o.select(F.col("o_orderpriority").alias("system")).distinct(),
        r.select(F.col("r_name").alias("model")),
        spark.range(3).select(F.col("id").alias("seed")),
        p.select(F.col("p_partkey").alias("case_id")),
    )


_UNIVERSE = "u AS (SELECT s.system, r_name AS model, k.seed, p_partkey AS case_id FROM (SELECT DISTINCT o_orderpriority AS system FROM orders) s, region, range(0, 3) k(seed), part)"


@query("key_universe", f"WITH {_UNIVERSE} SELECT * FROM u")
def key_universe(spark, sf_dir):
    return M.key_universe(*_axes(spark, sf_dir))


def _runs(spark, sf_dir):
    """Actual runs: one for each order line, whose fields choose the key; so keys are missing, extra and repeated."""
    li, o, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"), table(spark, sf_dir, "region")
    rows = li.join(o, li["l_orderkey"] == o["o_orderkey"]).withColumn("rk", (F.col("o_custkey") % 5).cast("int"))
    return rows.join(F.broadcast(p), F.col("rk") == F.col("r_regionkey")).select(
        F.col("o_orderpriority").alias("system"),
        F.col("r_name").alias("model"),
        (F.col("l_linenumber") % 4).cast("long").alias("seed"),
        F.col("l_partkey").alias("case_id"),
        F.element_at(F.array(F.lit("SUCCESS"), F.lit("ABSTAINED"), F.lit("ERROR")), (F.col("l_suppkey") % 3 + 1).cast("int")).alias("status"),
        F.col("l_quantity").alias("value"),
        F.when(F.col("l_linenumber") > 2, F.col("l_linenumber")).cast("long").alias("weight"),
        F.col("l_linestatus").alias("metric"),
    )


_RUNS = """a AS (SELECT o_orderpriority AS system, r_name AS model, CAST(l_linenumber % 4 AS BIGINT) AS seed, l_partkey AS case_id, ['SUCCESS', 'ABSTAINED', 'ERROR'][l_suppkey % 3 + 1] AS status, l_quantity AS value,
    CASE WHEN l_linenumber > 2 THEN l_linenumber END AS weight, l_linestatus AS metric FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN region ON r_regionkey = o_custkey % 5)"""


@query(
    "expected_vs_actual",
    f"""WITH {_UNIVERSE}, {_RUNS}, h AS (SELECT system, model, seed, case_id, count(*) AS n FROM a GROUP BY ALL)
    SELECT u.*, 'missing' AS fault FROM u ANTI JOIN h USING (system, model, seed, case_id) UNION ALL SELECT system, model, seed, case_id, 'extra' FROM h ANTI JOIN u USING (system, model, seed, case_id)
    UNION ALL SELECT system, model, seed, case_id, 'repeated' FROM h WHERE n > 1""",
)
def expected_vs_actual(spark, sf_dir):
    return M.universe_gaps(M.key_universe(*_axes(spark, sf_dir)), _runs(spark, sf_dir))


@query("resume_missing_keys", f"WITH {_UNIVERSE}, {_RUNS} SELECT u.* FROM u ANTI JOIN (SELECT * FROM a WHERE status IN ('SUCCESS', 'ABSTAINED')) USING (system, model, seed, case_id)")
def resume_missing_keys(spark, sf_dir):
    return M.resume_keys(M.key_universe(*_axes(spark, sf_dir)), _runs(spark, sf_dir))


@query(
    "weighted_case_means",
    f"""WITH {_RUNS}, c AS (SELECT system, model, case_id, metric, sum(value * coalesce(weight, 1)) / sum(coalesce(weight, 1)) AS mean, sum(coalesce(weight, 1)) AS d, max(weight IS NOT NULL) AS w FROM a GROUP BY ALL),
    k AS (SELECT metric, max(w) AS w FROM c GROUP BY metric)
    SELECT system, model, metric, round(sum(mean * CASE WHEN k.w THEN d ELSE 1 END) / sum(CASE WHEN k.w THEN d ELSE 1 END), 6) AS mean, count(mean) AS n_cases FROM c JOIN k USING (metric) GROUP BY ALL""",
)
def weighted_case_means(spark, sf_dir):
    return _rounded(M.group_means(_runs(spark, sf_dir)), "mean")


@query("status_pivot", f"WITH {_RUNS} SELECT system, count(*) FILTER (status = 'SUCCESS') AS success, count(*) FILTER (status = 'ABSTAINED') AS abstained, count(*) FILTER (status = 'ERROR') AS error FROM a GROUP BY 1")
def status_pivot(spark, sf_dir):
    counts = _runs(spark, sf_dir).groupBy("system").pivot("status", ["SUCCESS", "ABSTAINED", "ERROR"]).count()
    return counts.select("system", *[F.coalesce(s, F.lit(0)).alias(s.lower()) for s in ("SUCCESS", "ABSTAINED", "ERROR")])


@query(
    "judge_distributions",
    "SELECT 'quality' AS field, CAST(quality AS VARCHAR) AS label, count(*) AS n FROM labels GROUP BY ALL UNION ALL SELECT 'toxic', CAST(toxic AS VARCHAR), count(*) FROM labels GROUP BY ALL UNION ALL SELECT 'violation', 'toxic_and_good', count(*) FROM labels WHERE toxic = 1 AND quality = 1",
)
def judge_distributions(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    long = lab.select(F.explode(F.map_from_arrays(F.array(F.lit("quality"), F.lit("toxic")), F.array(F.col("quality").cast("string"), F.col("toxic").cast("string")))).alias("field", "label"))
    bad = lab.filter("toxic = 1 AND quality = 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("violation").alias("field"), F.lit("toxic_and_good").alias("label"), "n")
    return long.groupBy("field", "label").agg(F.count(F.lit(1)).alias("n")).unionByName(bad)


@query(
    "must_include_recall",
    f"""WITH m AS (SELECT item_id, list_sort(list_distinct({tokens_sql('text')}))[1:5] AS must FROM benchmark), p AS (SELECT item_id, must, lower(text) AS a FROM m JOIN documents ON doc_id = item_id)
    SELECT item_id, round(len(list_filter(must, lambda w: contains(a, w))) / len(must), 6) AS recall FROM p WHERE len(must) > 0""",
)
def must_include_recall(spark, sf_dir):
    from skarn.functions.text import tokenize

    must = table(spark, sf_dir, "benchmark").select("item_id", F.slice(F.array_sort(F.array_distinct(tokenize("text"))), 1, 5).alias("must"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.lower("text").alias("a"))
    hit = F.size(F.filter("must", lambda w: F.col("a").contains(w))) / F.size("must")
    return must.join(d, "item_id").filter(F.size("must") > 0).select("item_id", F.round(hit, 6).alias("recall"))


@query(
    "gold_chunk_labels",
    r"""WITH c AS (SELECT item_id, item_id % 3 AS locus, list_filter(list_transform(string_split(text, '.'), lambda x: lower(trim(regexp_replace(x, '\s+', ' ', 'g')))), lambda x: length(x) >= 20) AS facts FROM benchmark),
    d AS (SELECT doc_id, doc_id % 3 AS page, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS t FROM documents),
    g AS (SELECT item_id, locus, doc_id, page FROM c JOIN d ON len(facts) > 0 AND len(list_filter(facts, lambda f: contains(t, f))) >= greatest(1, (len(facts) + 1) // 2))
    SELECT item_id AS case_id, doc_id AS chunk_id, row_number() OVER (PARTITION BY item_id ORDER BY page <> locus, doc_id) AS place FROM g""",
)
def gold_chunk_labels(spark, sf_dir):
    """Sentences of 20 characters or more as the facts of a passage, documents as chunks."""
    plain = lambda x: F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))
    facts = F.filter(F.split("text", r"\."), lambda x: F.length(plain(x)) >= 20)
    cases = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case_id"), facts.alias("facts"), (F.col("item_id") % 3).alias("locus"))
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 3).alias("page"), "text")
    return gold_chunks(cases, chunks)


@query("unanswerable_candidates", f"WITH {_GOLD_SQL} SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT q_id FROM gold)")
def unanswerable_candidates(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id").join(_gold(spark, sf_dir).select(F.col("q_id").alias("item_id")), "item_id", "left_anti")
