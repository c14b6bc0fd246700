"""Registered evidence and report queries over whole tables, with DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skarn.operators import evidence as V
from skarn.operators import reports as P
from skarn.operators.vectors import cosine_topk, maxsim_topk
from skarn.operators.verify import corrupted
from skarn.plans.base import quoted, sentences_sql
from skarn.plans.metric_queries import _RUNS, _SQ, _TURNS, _UNIVERSE, _axes, _runs, _turns
from skarn.plans.retrieval_queries import _N, _SS
from skarn.operators import metrics as M
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


def _chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    fig = F.col("doc_id") % 6 == 0
    return d.select(
        "doc_id",
        "source",
        F.col("doc_id").alias("ord"),
        (F.col("doc_id") % 9 + 1).alias("page"),
        "text",
        F.when(fig, F.concat(F.when(F.col("doc_id") % 12 == 0, "Table ").otherwise("Figure "), (F.col("doc_id") % 50).cast("string"))).alias("label"),
        F.when(fig, "score comparison").otherwise("").alias("caption"),
        F.lit("Results").alias("section"),
        F.when(F.col("doc_id") % 4 == 0, "result").otherwise("body").alias("chunk_type"),
        fig.alias("is_figure"),
        (F.col("doc_id") % 12 == 0).alias("is_table"),
    )


def _asked(spark, sf_dir):
    """Benchmark passages as questions, each with a cue from the question templates."""
    b = table(spark, sf_dir, "benchmark")
    cue = F.element_at(F.array(*[F.lit(x) for x in ("Compare Table 12 and Figure 6: ", "What outperforms the baseline versus ", "Explain page 3: ", "")]), (F.col("item_id") % 4 + 1).cast("int"))
    return b.select(F.col("item_id").alias("q_id"), F.concat(cue, "text").alias("text"))


#: Page units stand behind the documents' ids.
_PAGES_FROM = 10**9


def _page_units(spark, sf_dir):
    """A page for each embedding: the page of the document of that id, as a chunk of the page channel."""
    c = _chunks(spark, sf_dir).select("doc_id", "source", "page", "ord")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    fixed = {"text": "", "caption": "", "section": "Full-page visual", "chunk_type": "page_visual"}
    label = F.concat(F.lit("Page "), F.col("page").cast("string"))
    return c.join(e, "doc_id").select((F.col("doc_id") + _PAGES_FROM).alias("doc_id"), "source", "page", "ord", label.alias("label"), *[F.lit(v).alias(k) for k, v in fixed.items()], F.lit(True).alias("is_figure"), F.lit(False).alias("is_table"))


def _vectors_of_questions(spark, sf_dir):
    """The embedding of a question's own number stands for its vector."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return e, e.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id")), "doc_id")


def _patches(vector):
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(vector, i * 8 + 1, F.lit(8)))


def _page_hits(spark, sf_dir, k, least):
    vectors, asked = _vectors_of_questions(spark, sf_dir)
    pages = vectors.select((F.col("doc_id") + _PAGES_FROM).alias("doc_id"), _patches("vector").alias("patches")).join(_page_units(spark, sf_dir).select("doc_id"), "doc_id")
    return maxsim_topk(asked.select(F.col("doc_id").alias("q_id"), _patches("vector").alias("tokens")), pages, k, least)


@query(
    "page_channel",
    f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT vec_id, list_transform(range(0, 8), lambda i: e[i * 8 + 1:i * 8 + 8]) AS m FROM v),
    c AS (SELECT a.vec_id AS q_id, b.vec_id + {_PAGES_FROM} AS doc_id, list_sum(list_transform(a.m, lambda t: list_max(list_transform(b.m, lambda x: list_dot_product(t, x))))) / 8 AS score
          FROM p a JOIN benchmark ON item_id = a.vec_id CROSS JOIN p b JOIN documents d ON d.doc_id = b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM c WHERE score >= 0.12)
    SELECT q_id, r.doc_id, source, d.doc_id % 9 + 1 AS page, round(score, 6) AS score, rank FROM r JOIN documents d ON d.doc_id + {_PAGES_FROM} = r.doc_id WHERE rank <= 24""",
)
def page_channel(spark, sf_dir):
    """Page hits above the floor with their source and page, pages chosen by bounds on their patches."""
    hits = _page_hits(spark, sf_dir, 24, 0.12).join(_page_units(spark, sf_dir).select("doc_id", "source", "page"), "doc_id")
    return hits.select("q_id", "doc_id", "source", "page", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("full_retrieval")
def full_retrieval(spark, sf_dir):
    """D21 with all channels: words, modality, dense and image vectors, and pages."""
    chunks = _chunks(spark, sf_dir)
    vectors, asked = _vectors_of_questions(spark, sf_dir)
    known = vectors.join(chunks.select("doc_id", "is_figure"), "doc_id")
    dense = cosine_topk(asked, known.select("doc_id", "vector"), 48).select("q_id", "doc_id", "rank")
    images = V.image_channel(asked, known.filter("is_figure").select("doc_id", "vector"), k=36)
    return V.retrieve(chunks, _asked(spark, sf_dir), 6, dense, images, _page_hits(spark, sf_dir, 24, 0.12), _page_units(spark, sf_dir), image_floor=0.2, page_floor=0.12)


@query("multi_hop_retrieval")
def multi_hop_retrieval(spark, sf_dir):
    q = _asked(spark, sf_dir)
    parts = q.select("q_id", F.explode(F.array(F.struct(F.lit("SQ1").alias("sq"), F.col("text").alias("t")), F.struct(F.lit("SQ2").alias("sq"), F.concat(F.lit("ablation metrics "), "text").alias("t")))).alias("s"))
    return V.multi_hop(_chunks(spark, sf_dir), parts.select("q_id", "s.sq", F.col("s.t").alias("text")))


@query("evidence_items")
def evidence_items(spark, sf_dir):
    c, q = _chunks(spark, sf_dir), _asked(spark, sf_dir)
    items = V.evidence_items(V.retrieve(c, q, 6), c, q)
    return items.select("q_id", "item", "doc_id", F.md5(F.col("quote").cast("binary")).alias("quote"), F.round("score", 6).alias("score"))


@query(
    "expanded_references",
    """WITH c AS (SELECT doc_id, source, doc_id % 6 = 0 AS fig, CASE WHEN doc_id % 12 = 0 THEN 'table ' ELSE 'figure ' END || (doc_id // 20 % 10) AS l, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents WHERE source IS NOT NULL),
    s AS (SELECT * FROM c WHERE place <= 12), f AS (SELECT source, l, min(doc_id) AS doc_id FROM c WHERE fig GROUP BY ALL),
    w AS (SELECT source, place, 1 AS p, 'figure ' || (doc_id // 20 * 7 % 10) AS l FROM s WHERE NOT fig AND place <= 8 UNION ALL SELECT source, place, 2, 'table ' || (doc_id // 20 * 3 % 10) FROM s WHERE NOT fig AND place <= 8),
    n AS (SELECT source, l, min(place * 10 + p) AS first FROM w WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.fig AND s.source = w.source AND s.l = w.l) GROUP BY ALL),
    r AS (SELECT source AS q_id, doc_id, l, row_number() OVER (PARTITION BY source ORDER BY first, l) AS r FROM n JOIN f USING (source, l))
    SELECT q_id, doc_id, l FROM r WHERE r <= 2""",
)
def expanded_references(spark, sf_dir):
    """D30 over the first twelve chunks of every source, which name a figure and a table each."""
    n, k = F.col("doc_id"), F.floor(F.col("doc_id") / 20)
    c = _chunks(spark, sf_dir).filter("source IS NOT NULL").withColumn("text", F.concat(F.lit("see Figure "), (k * 7 % 10).cast("string"), F.lit(" and Table "), (k * 3 % 10).cast("string")))
    c = c.withColumn("label", F.when(n % 6 == 0, F.concat(F.when(n % 12 == 0, "Table ").otherwise("Figure "), (k % 10).cast("string"))))
    first = Window.partitionBy("source").orderBy("doc_id")
    selected = c.select(F.col("source").alias("q_id"), "doc_id", F.row_number().over(first).alias("place")).filter("place <= 12")
    return V.expand_references(selected, c, 2)


_IMP = " + ".join(f"CASE WHEN contains(lower(s), {quoted(w)}) THEN 2 ELSE 0 END" for w in V.IMPORTANT)
_IMPB = " OR ".join(f"contains(lower(s), {quoted(w)})" for w in V.IMPORTANT_BANNED)


@query(
    "important_sentences",
    f"""WITH e AS (SELECT doc_id, unnest(x) AS s, generate_subscripts(x, 1) AS p FROM (SELECT doc_id, list_filter(list_transform({sentences_sql("replace(text, chr(10), ' ')")}, lambda s: trim(s)), lambda s: length(s) > 45) AS x FROM documents)),
    c AS (SELECT *, CASE WHEN {_IMPB} THEN -1 ELSE {_IMP} + CASE WHEN regexp_matches(s, '\\d') THEN 1 ELSE 0 END END AS score FROM e), g AS (SELECT *, max(score) OVER (PARTITION BY doc_id) > 0 AS good FROM c),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN good THEN score ELSE 0 END DESC, p) AS rank FROM g)
    SELECT doc_id, rank, md5(left(s, 420)) AS sentence FROM r WHERE CASE WHEN good THEN score > 0 AND rank <= 8 ELSE rank <= 6 END""",
)
def important_sentences(spark, sf_dir):
    s = V.important_sentences(table(spark, sf_dir, "documents"))
    return s.select("doc_id", F.col("rank").cast("long").alias("rank"), F.md5(F.col("sentence").cast("binary")).alias("sentence"))


_GOAL = " + ".join(f"CASE WHEN contains(lower(text), {quoted(w)}) THEN 1 ELSE 0 END" for w in V.GOAL_TERMS)
_GOALP = " OR ".join(f"contains(lower(text), {quoted(w)})" for w in V.GOAL_PHRASES)


@query(
    "study_goal_chunks",
    f"""WITH n AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents), s AS (SELECT *, {_GOAL} + CASE WHEN i < 3 THEN 4 ELSE 0 END + CASE WHEN {_GOALP} THEN 3 ELSE 0 END AS score FROM n),
    r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN i < 3 THEN i ELSE 3 END, score DESC, i) AS place FROM s) SELECT * FROM r WHERE place <= 10""",
)
def study_goal_chunks(spark, sf_dir):
    return V.study_goal_chunks(_chunks(spark, sf_dir)).withColumn("place", F.col("place").cast("long"))


@query(
    "title_matches",
    f"""WITH q AS (SELECT p_size AS q_id, {_N('min(p_name)')} AS qn, list_distinct({_SS('min(p_name)')}) AS qt FROM part GROUP BY p_size), p AS (SELECT p_partkey AS doc_id, {_N('p_name')} AS tn, list_distinct({_SS('p_name')}) AS tt FROM part),
    m AS (SELECT q_id, doc_id, qn, tn, len(list_intersect(qt, tt)) / len(qt) AS a, len(list_intersect(qt, tt)) / len(tt) AS b FROM q, p WHERE len(qt) >= 2 AND len(tt) > 0)
    SELECT q_id, doc_id, round(a + b + CASE WHEN qn = tn THEN 10 WHEN contains(tn, qn) OR contains(qn, tn) THEN 4 ELSE 0 END, 6) AS score FROM m WHERE a >= 0.8 AND b >= 0.45""",
)
def title_matches(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    q = part.groupBy(F.col("p_size").alias("q_id")).agg(F.min("p_name").alias("text"))
    return _rounded(V.title_matches(part.select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("title")), q), "score")


@query(
    "image_channel",
    """WITH v AS (SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), c AS (SELECT a.doc_id AS q_id, b.doc_id, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS s FROM v a JOIN v b ON a.doc_id <> b.doc_id WHERE a.doc_id % 50 = 0)
    SELECT q_id, doc_id, round(s, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY s DESC, doc_id) AS rank FROM c WHERE s >= 0.2) WHERE rank <= 10""",
)
def image_channel(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return _rounded(V.image_channel(v.filter("doc_id % 50 = 0"), v), "score")


@query("candidate_regions")
def candidate_regions(spark, sf_dir):
    part = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("embedding", i * 4 + 1, F.lit(4)))
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label", part.alias("patches"))
    asked = v.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("q_id"), "label", F.col("patches").alias("tokens"))
    return _rounded(V.regions_by_label(asked, v, 4, 4), "score")


@query(
    "page_tiles",
    """WITH t(tile, x0, y0, x1, y1) AS (VALUES (0, 0.0, 0.0, 1.0, 1.0), (1, 0.0, 0.0, 0.58, 0.42), (2, 0.42, 0.0, 1.0, 0.42), (3, 0.0, 0.29, 0.58, 0.71), (4, 0.42, 0.29, 1.0, 0.71), (5, 0.0, 0.58, 0.58, 1.0), (6, 0.42, 0.58, 1.0, 1.0))
    SELECT page_id, width, height, tile, CAST(floor(width * CAST(x0 AS DOUBLE)) AS INT) AS x0, CAST(floor(height * CAST(y0 AS DOUBLE)) AS INT) AS y0, CAST(greatest(1, floor(width * CAST(x1 AS DOUBLE))) AS INT) AS x1, CAST(greatest(1, floor(height * CAST(y1 AS DOUBLE))) AS INT) AS y1
    FROM (SELECT page_id, 100 + page_id % 37 AS width, 90 + page_id % 41 AS height FROM pages), t""",
)
def page_tiles(spark, sf_dir):
    return V.page_tiles(table(spark, sf_dir, "pages").select("page_id", (100 + F.col("page_id") % 37).alias("width"), (90 + F.col("page_id") % 41).alias("height")))


@query("best_representatives", "SELECT source, image_file, doc_id FROM (SELECT source, 'i' || (doc_id % 7) AS image_file, doc_id, row_number() OVER (PARTITION BY source, doc_id % 7 ORDER BY CASE WHEN doc_id % 6 = 0 THEN 1 ELSE 0 END DESC, length(text) DESC, doc_id) AS r FROM documents) WHERE r = 1")
def best_representatives(spark, sf_dir):
    c = _chunks(spark, sf_dir).withColumn("image_file", F.concat(F.lit("i"), (F.col("doc_id") % 7).cast("string")))
    return V.best_representative(c).select("source", "image_file", "doc_id")


@query(
    "uninformative_answers",
    f"SELECT conv_id, turn, length(trim(text)) < 20 OR (NOT (contains(text, '| :---') OR contains(text, '**Structured Table**') OR contains(text, '**Row-by-Row Analysis')) AND regexp_matches(lower(string_split_regex(text, '(?i)\\*\\*(?:Limits|Limitations)\\*\\*')[1]), {quoted(V.FIGURE_REFUSALS)})) AS uninformative FROM conversations",
)
def uninformative_answers(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", V.is_uninformative(F.col("text")).alias("uninformative"))


@query(
    "evidence_identities",
    """SELECT doc_id, source, CASE doc_id % 3 WHEN 0 THEN 'chunk_id' WHEN 1 THEN 'evidence_id' ELSE 'content_sha256' END AS kind,
    CASE WHEN doc_id % 3 < 2 THEN CAST(doc_id AS VARCHAR) ELSE sha256('{"lang":' || to_json(lang) || ',"text":' || to_json(text) || '}') END AS id FROM documents""",
)
def evidence_identities(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    some = F.when(F.col("doc_id") % 3 == 0, F.col("doc_id"))
    other = F.when(F.col("doc_id") % 3 == 1, F.col("doc_id"))
    return d.select("doc_id", V.evidence_identity(some, other, F.lit(None), F.col("source"), F.lit("p"), [F.col("lang"), F.col("text")]).alias("i")).select("doc_id", "i.*")


@query(
    "binary_labels",
    """WITH l AS (SELECT l_orderkey, l_suppkey % 3 AS annotator, CASE WHEN l_linenumber % 5 = 4 THEN 'ADJUDICATION' ELSE 'INITIAL' END AS round, l_quantity > 25 AS value FROM lineitem),
    g AS (SELECT l_orderkey, count(DISTINCT CASE WHEN round = 'INITIAL' THEN annotator END) AS n, min(CASE WHEN round = 'INITIAL' THEN value END) AS lo, max(CASE WHEN round = 'INITIAL' THEN value END) AS hi, count(*) FILTER (round = 'ADJUDICATION') AS k, max(CASE WHEN round = 'ADJUDICATION' THEN value END) AS a FROM l GROUP BY 1)
    SELECT l_orderkey, CAST(CASE WHEN n < 2 THEN NULL WHEN lo = hi THEN CAST(lo AS INT) WHEN k = 1 THEN CAST(a AS INT) END AS DOUBLE) AS value, CASE WHEN n < 2 THEN 'too few annotators' WHEN lo = hi OR k = 1 THEN NULL ELSE 'disagreement without one adjudication' END AS reason FROM g""",
)
def binary_labels(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 3).alias("annotator"), F.when(F.col("l_linenumber") % 5 == 4, "ADJUDICATION").otherwise("INITIAL").alias("round"), (F.col("l_quantity") > 25).alias("value"))
    return P.binary_labels(li, ["l_orderkey"])


@query("paired_gate")
def paired_gate(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").filter("l_returnflag IN ('A', 'R')")
    s = li.groupBy(F.col("l_returnflag").alias("system"), F.col("l_suppkey").alias("pair")).agg((F.avg("l_quantity") / 50).alias("support"), F.avg("l_discount").alias("coverage"))
    return _rounded(P.paired_gate(s, "A", "R", 0.05, 0.02), "support_delta", "coverage_delta", "lo", "hi")


@query(
    "likert_by_model",
    "SELECT c_mktsegment AS model, count(*) AS n_answers, round(avg(c_acctbal), 6) AS mean_c_acctbal, round(stddev_pop(c_acctbal), 6) AS stdev_c_acctbal, count(c_acctbal) AS n_c_acctbal FROM customer GROUP BY 1",
)
def likert_by_model(spark, sf_dir):
    return _rounded(P.likert(table(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "model"), "model", ["c_acctbal"]), "mean_c_acctbal", "stdev_c_acctbal")


_G = "g AS (SELECT l_returnflag AS model, count(*) FILTER (l_suppkey % 4 = 0) AS supported, count(*) FILTER (l_suppkey % 4 = 1) AS partial, count(*) FILTER (l_suppkey % 4 = 2) AS unsupported, count(*) FILTER (l_suppkey % 4 = 3) AS missing FROM lineitem GROUP BY 1)"


@query(
    "citation_grades",
    f"""WITH {_G}, r AS (SELECT *, supported / (supported + partial + unsupported) AS ps, (supported + 0.5 * partial) / (supported + partial + unsupported) AS pl, (supported + partial) / (supported + partial + missing) AS rc FROM g)
    SELECT model, supported, partial, unsupported, missing, round(ps, 6) AS precision_strict, round(pl, 6) AS precision_lenient, round(rc, 6) AS recall, round(2 * ps * rc / (ps + rc), 6) AS f1 FROM r""",
)
def citation_grades(spark, sf_dir):
    k = F.col("l_suppkey") % 4
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("model"), *[(k == i).cast("int").alias(n) for i, n in enumerate(("supported", "partial", "unsupported", "missing"))])
    return _rounded(P.citation_grades(li, "model"), "precision_strict", "precision_lenient", "recall", "f1")


@query("first_places", "SELECT o_orderpriority AS model, count(*) FILTER (o_custkey % 5 = 1) AS first_place, round(avg(o_custkey % 5), 6) AS mean_rank, count(*) AS n_ranked FROM orders GROUP BY 1")
def first_places(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("model"), (F.col("o_custkey") % 5).alias("rank"))
    return _rounded(P.first_places(o, "model", "rank"), "mean_rank")


@query(
    "multihop_scores",
    f"""WITH {_TURNS}, g AS (SELECT key, p, unnest([r, lower(p)]) AS g, length(p) % 3 <> 0 AS ok, length(p) % 2 = 0 AS ab FROM t), w AS (SELECT *, {_SQ('p')} AS pw, {_SQ('g')} AS gw FROM g),
    f AS (SELECT key, p, ok, ab, CAST(pw = gw AS INT) AS em, list_sum(list_transform(list_distinct(pw), lambda x: least(len(list_filter(pw, lambda y: y = x)), len(list_filter(gw, lambda y: y = x))))) AS c, len(pw) AS np, len(gw) AS ng FROM w),
    b AS (SELECT key, p, ok, ab, max(em) AS em, max(CASE WHEN np = 0 AND ng = 0 THEN 1 ELSE coalesce(2.0 * c / nullif(np + ng, 0), 0) END) AS f1 FROM f GROUP BY key, p, ok, ab)
    SELECT round(coalesce(sum(em) FILTER (ok), 0) / greatest(count(*) FILTER (ok), 1), 6) AS exact_match, round(coalesce(sum(f1) FILTER (ok), 0) / greatest(count(*) FILTER (ok), 1), 6) AS f1, round(coalesce(avg(0.5) FILTER (ok), 0), 6) AS evidence_path_recall,
    round(coalesce(avg(CAST(ab OR contains(lower(p), 'insufficient') OR trim(p) = '' AS INT)) FILTER (NOT ok), 1), 6) AS abstention_accuracy FROM b""",
)
def multihop_scores(spark, sf_dir):
    t = _turns(spark, sf_dir)
    rows = t.select("key", "prediction", F.array("reference", F.lower("prediction")).alias("golds"), F.array(F.lit("a"), F.lit("b")).alias("gold_sources"), F.array(F.lit("a")).alias("sources"), (F.length("prediction") % 3 != 0).alias("answerable"), (F.length("prediction") % 2 == 0).alias("abstained"))
    return _rounded(P.multihop_scores(rows, "key"), "exact_match", "f1", "evidence_path_recall", "abstention_accuracy")


@query(
    "visual_scores",
    f"""WITH {_TURNS}, r AS (SELECT length(p) % 4 AS kind, array_to_string({_SQ('p')}, ' ') AS p, array_to_string({_SQ("string_split(r, ' ')[1]")}, ' ') AS g, nullif(length(r) % 8, 0) AS f FROM t)
    SELECT kind, count(*) AS n, round(avg(CAST(g <> '' AND contains(p, g) AS INT)), 6) AS accuracy, round(avg(CAST(p = g AS INT)), 6) AS exact_match, round(avg(coalesce(CAST(f <= 1 AS INT), 0)), 6) AS hit_1, round(avg(coalesce(CAST(f <= 3 AS INT), 0)), 6) AS hit_3,
    round(avg(coalesce(CAST(f <= 5 AS INT), 0)), 6) AS hit_5, round(avg(coalesce(1 / f, 0)), 6) AS mrr FROM r GROUP BY kind""",
)
def visual_scores(spark, sf_dir):
    rows = _turns(spark, sf_dir).select((F.length("prediction") % 4).alias("kind"), "prediction", F.split("reference", " ")[0].alias("reference"), F.nullif(F.length("reference") % 8, F.lit(0)).alias("first_rank"))
    return _rounded(P.visual_scores(rows, "kind"), "accuracy", "exact_match", "hit_1", "hit_3", "hit_5", "mrr")


@query("key_term_coverage")
def key_term_coverage(spark, sf_dir):
    return _rounded(P.key_term_coverage(_turns(spark, sf_dir).withColumn("evidence", F.col("reference")), "key"), "coverage")


@query("faithfulness_scores")
def faithfulness_scores(spark, sf_dir):
    """Every assistant turn against the user turns of its conversation, of which the first five count."""
    c = table(spark, sf_dir, "conversations")
    key = F.concat_ws(":", "conv_id", "turn")
    claims = c.filter("role = 'assistant'").select("conv_id", key.alias("key"), "text")
    said = c.filter("role = 'user'").select("conv_id", F.col("turn").alias("place"), F.col("text").alias("t"))
    chunks = claims.select("conv_id", "key").join(said, "conv_id").select("key", "place", F.col("t").alias("text"))
    return _rounded(P.faithfulness(claims.select("key", "text"), chunks, "key"), "strict", "soft")


@query(
    "semantic_entailment",
    """WITH v AS (SELECT vec_id, label AS key, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), u AS (SELECT vec_id, key, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM v),
    b AS (SELECT a.key, a.vec_id, max(list_dot_product(a.u, p.u)) AS m FROM u a JOIN u p ON a.key = p.key WHERE a.vec_id % 50 = 0 GROUP BY 1, 2), s AS (SELECT key, avg(m) AS score FROM b GROUP BY key)
    SELECT key, round(score, 6) AS score, CASE WHEN score >= 0.42 THEN 'ENTAILMENT' WHEN score >= 0.25 THEN 'NEUTRAL' ELSE 'CONTRADICTION' END AS label FROM s""",
)
def semantic_entailment(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    unit = F.transform("embedding", lambda x: x / F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, y: s + y.cast("double") * y)))
    u = v.select("vec_id", F.col("label").alias("key"), unit.alias("vector"))
    return _rounded(P.semantic_entailment(u.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "sentence"), u.select("key", "vector")), "score")


@query(
    "semantic_entailment_all",
    """WITH v AS (SELECT vec_id, label AS key, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), u AS (SELECT vec_id, key, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM v WHERE key IS NOT NULL),
    b AS (SELECT a.key, a.vec_id, coalesce(max(list_dot_product(a.u, p.u)), 0) AS m FROM u a LEFT JOIN u p ON a.key = p.key AND a.vec_id <> p.vec_id GROUP BY 1, 2), s AS (SELECT key, avg(m) AS score FROM b GROUP BY key)
    SELECT key, round(score, 6) AS score, CASE WHEN score >= 0.42 THEN 'ENTAILMENT' WHEN score >= 0.25 THEN 'NEUTRAL' ELSE 'CONTRADICTION' END AS label FROM s""",
)
def semantic_entailment_all(spark, sf_dir):
    """Every sentence against all others of its key; semantic_entailment takes every fiftieth, itself among its premises."""
    v = table(spark, sf_dir, "embeddings")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, y: s + y.cast("double") * y))
    u = v.withColumn("__norm", norm).select(F.col("label").alias("key"), F.col("vec_id").alias("sentence"), F.transform("embedding", lambda x: x / F.col("__norm")).alias("vector"))
    return _rounded(P.mutual_entailment(u), "score")


@query("answer_scores")
def answer_scores(spark, sf_dir):
    """Each assistant turn with a closing sentence that cites a page; the pages are the first turns of its conversation."""
    c = table(spark, sf_dir, "conversations")
    key = F.concat_ws(":", "conv_id", "turn")
    answers = c.filter("role = 'assistant'")
    first = F.regexp_extract("text", r"^[^.!?]{13,}", 0)
    mark = F.concat(F.col("text"), F.lit(" "), first, F.lit(" [p. "), (F.col("turn") % 5).cast("string"), F.lit("]."))
    rows = answers.select(key.alias("key"), mark.alias("answer"), F.lit(3).alias("n_pages"), (F.col("turn") % 4).cast("int").alias("gold_page"))
    shown = c.select("conv_id", F.col("turn").cast("int").alias("page"), F.col("text").alias("t")).filter("page BETWEEN 1 AND 3")
    pages = answers.select("conv_id", key.alias("key")).join(shown, "conv_id").select("key", "page", F.col("t").alias("text"))
    return P.answer_scores(rows, "key", pages)


@query(
    "macro_micro_support",
    "SELECT l_returnflag AS claim_type, count(*) AS n, round(avg(s / t), 6) AS macro, round(sum(s) / sum(t), 6) AS micro FROM (SELECT l_returnflag, l_orderkey, count(*) AS t, count(*) FILTER (l_quantity > 20) AS s FROM lineitem GROUP BY 1, 2) GROUP BY 1",
)
def macro_micro_support(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("claim_type"), "l_orderkey").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("l_quantity") > 20).alias("supported"))
    return _rounded(P.macro_micro(g, ["claim_type"]), "macro", "micro")


@query(
    "source_match",
    "WITH f AS (SELECT o_orderkey AS case_id, min(CASE WHEN l_suppkey % 5 = o_custkey % 5 THEN l_linenumber END) AS f FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) SELECT case_id, coalesce(CAST(f <= 1 AS INT), 0) AS hit_1, coalesce(CAST(f <= 5 AS INT), 0) AS hit_5, round(coalesce(1 / f, 0), 6) AS reciprocal_rank FROM f",
)
def source_match(spark, sf_dir):
    ranked = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("rank"), (F.col("l_suppkey") % 5).cast("string").alias("source"))
    expected = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), (F.col("o_custkey") % 5).cast("string").alias("source_id"), F.array().cast("array<string>").alias("keywords"))
    return _rounded(P.source_match(ranked, expected), "reciprocal_rank")


@query(
    "subset_means",
    "SELECT 'all' AS subset, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM lineitem UNION ALL SELECT 'large', count(*), round(avg(l_quantity), 6) FROM lineitem WHERE l_extendedprice > 1000 UNION ALL SELECT 'returned', count(*), round(avg(l_quantity), 6) FROM lineitem WHERE l_returnflag = 'R'",
)
def subset_means(spark, sf_dir):
    subsets = {"all": F.lit(True), "large": F.col("l_extendedprice") > 1000, "returned": F.col("l_returnflag") == "R"}
    return _rounded(P.subset_means(table(spark, sf_dir, "lineitem"), "l_quantity", subsets), "mean")


@query(
    "localisation",
    """WITH r AS (SELECT o_orderpriority AS system, nullif(o_custkey % 13, 0) AS rank, o_orderkey % 9 + 1 AS pool FROM orders) SELECT system, count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN rank <= 5 THEN 1 ELSE 0 END), 6) AS recall_5,
    round(avg(CASE WHEN rank <= 10 THEN 1 ELSE 0 END), 6) AS recall_10, round(avg(coalesce(1 / rank, 0)), 6) AS mrr, round(avg(list_sum(list_transform(range(1, pool + 1), lambda i: 1 / i)) / pool), 6) AS random_mrr FROM r GROUP BY 1""",
)
def localisation(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("system"), F.nullif(F.col("o_custkey") % 13, F.lit(0)).alias("rank"), (F.col("o_orderkey") % 9 + 1).alias("pool"))
    return _rounded(P.localisation(o, "system"), "recall_1", "recall_5", "recall_10", "mrr", "random_mrr")


@query("negative_control")
def negative_control(spark, sf_dir):
    """Passages with a number in every sentence against themselves, whole and corrupted: the corrupted ones must score lower."""
    bad = F.pandas_udf(lambda s: s.map(corrupted), "string")
    c = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace("text", r"\.", " near 12 percent.").alias("text"))
    own = c.select("item_id", F.lit(0).alias("place"), "text")
    true = P.faithfulness(c, own, "item_id").select("item_id", F.col("strict").alias("true_score"))
    false = P.faithfulness(c.withColumn("text", bad("text")), own, "item_id").select("item_id", F.col("strict").alias("corrupt_score"), F.col("n_contradicted").alias("corrupt_contradicted"))
    return _rounded(P.negative_control(true.join(false, "item_id")), "mean_true", "mean_corrupt", "separation", "caught_rate", "flagged_rate", "contradiction_rate")


@query(
    "evidence_sensitivity",
    """SELECT round(coalesce(avg(CAST(contains(replace(props, '1', '9'), '9') AS INT)) FILTER (user_id % 2 = 0), 0), 6) AS text_value_edit, round(coalesce(avg(CAST(contains(replace(props, '1', '9'), '9') AS INT)) FILTER (user_id % 2 <> 0), 0), 6) AS visual_value_edit FROM events""",
)
def evidence_sensitivity(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(F.when(F.col("user_id") % 2 == 0, "TEXT_VALUE_EDIT").otherwise("VISUAL_VALUE_EDIT").alias("kind"), P.perturbed(F.col("props"), F.lit("1"), F.lit("9")).alias("prediction"), F.lit("9").alias("new"))
    return _rounded(P.sensitivity(rows), "text_value_edit", "visual_value_edit")


@query(
    "telemetry_summary",
    """WITH r AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 100), g AS (SELECT list_sort(list(value)) AS v FROM r WHERE value > 0)
    SELECT (SELECT count(*) FROM events) AS total_traces, v[len(v) // 2 + 1] AS p50_latency_ms, len(v) AS sample_size, (SELECT count(*) FROM r) AS total_claims, (SELECT count(*) FROM r WHERE user_id % 2 = 0) AS supported_claims,
    round(100.0 * (SELECT count(*) FROM r WHERE user_id % 2 = 0) / (SELECT count(*) FROM r), 6) AS support_rate_pct FROM g""",
)
def telemetry_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("trace_id"), "ts", F.col("value").alias("latency_ms"), F.array(F.when(F.col("user_id") % 2 == 0, "SUPPORTED").otherwise("PARTIAL")).alias("labels"))
    return _rounded(P.telemetry(e), "support_rate_pct")


@query("split_overlaps", "SELECT source AS paper_id, count(DISTINCT lang) AS n FROM documents GROUP BY 1 HAVING count(DISTINCT lang) > 1")
def split_overlaps(spark, sf_dir):
    return P.split_overlaps(table(spark, sf_dir, "documents").select(F.col("source").alias("paper_id"), F.col("lang").alias("split")))


@query(
    "release_faults",
    f"""WITH {_UNIVERSE}, {_RUNS}, h AS (SELECT system, model, seed, case_id, count(*) AS n FROM a GROUP BY ALL), k AS (SELECT DISTINCT system, model, seed, case_id FROM a WHERE status <> 'ERROR'),
    f AS (SELECT 'raw missing' AS fault, count(*) AS n FROM (SELECT * FROM u ANTI JOIN h USING (system, model, seed, case_id)) UNION ALL SELECT 'raw extra', count(*) FROM (SELECT * FROM h ANTI JOIN u USING (system, model, seed, case_id)) UNION ALL SELECT 'raw repeated', count(*) FROM h WHERE n > 1
    UNION ALL SELECT 'not scored', count(*) FROM (SELECT * FROM a ANTI JOIN k USING (system, model, seed, case_id))) SELECT * FROM f WHERE n > 0""",
)
def release_faults(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    return P.release_faults(M.key_universe(*_axes(spark, sf_dir)), runs, runs.filter("status <> 'ERROR'"))


@query(
    "scored_rows",
    f"""WITH {_RUNS}, r AS (SELECT * EXCLUDE (metric), case_id % 2 = 0 AS ok FROM a QUALIFY row_number() OVER (PARTITION BY system, model, seed, case_id ORDER BY status, value) = 1), s(metric, er, ab, needs) AS (VALUES ('recall', 0.0, 0.0, TRUE), ('abstained', NULL, 1.0, FALSE), ('latency', NULL, NULL, NULL)),
    v AS (SELECT metric, status, CASE WHEN needs IS NULL OR needs = ok THEN CASE status WHEN 'ERROR' THEN er WHEN 'ABSTAINED' THEN ab ELSE CASE metric WHEN 'recall' THEN value / 50 WHEN 'latency' THEN value END END END AS v FROM r, s)
    SELECT metric, status, count(v) AS n, count(*) AS n_all FROM v GROUP BY ALL""",
)
def scored_rows(spark, sf_dir):
    specs = spark.createDataFrame([("recall", 0.0, 0.0, True), ("abstained", None, 1.0, False), ("latency", None, None, None)], "metric string, on_error double, on_abstain double, needs_answerable boolean")
    first = Window.partitionBy(*M.KEY).orderBy("status", "value")
    runs = _runs(spark, sf_dir).withColumn("r", F.row_number().over(first)).filter("r = 1")
    rows = runs.select(*M.KEY, "status", (F.col("case_id") % 2 == 0).alias("answerable"), F.create_map(F.lit("recall"), F.col("value") / 50, F.lit("latency"), F.col("value")).alias("values"))
    return P.scored_rows(rows, specs).groupBy("metric", "status").agg(F.count("value").alias("n"), F.count(F.lit(1)).alias("n_all"))


@query(
    "citation_scores",
    """WITH c AS (SELECT l_orderkey AS case_id, l_suppkey % 3 AS source, l_partkey AS id, l_linenumber % 4 AS page FROM lineitem), h AS (SELECT DISTINCT l_orderkey AS case_id, l_partkey AS id, l_linenumber % 4 AS page FROM lineitem WHERE l_quantity > 25)
    SELECT c.case_id, count(*) AS n, round(avg(CAST(c.source = o_custkey % 3 AND c.page IN (1, 2) AS INT)), 6) AS precision, round(avg(CAST(h.id IS NOT NULL AS INT)), 6) AS page_accuracy
    FROM c JOIN orders ON o_orderkey = c.case_id AND o_orderkey % 2 = 0 LEFT JOIN h ON h.case_id = c.case_id AND h.id = c.id AND h.page = c.page GROUP BY 1""",
)
def citation_scores(spark, sf_dir):
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    cites = li.select(F.col("l_orderkey").alias("case_id"), (F.col("l_suppkey") % 3).alias("source"), F.col("l_partkey").alias("id"), (F.col("l_linenumber") % 4).alias("page"))
    cases = o.select(F.col("o_orderkey").alias("case_id"), (F.col("o_custkey") % 3).alias("paper_id"), F.array(F.lit(1), F.lit(2)).alias("gold_pages"), (F.col("o_orderkey") % 2 == 0).alias("answerable"))
    hits = li.filter("l_quantity > 25").select(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("id"), (F.col("l_linenumber") % 4).alias("page"))
    return _rounded(P.citation_scores(cites, cases, hits), "precision", "page_accuracy")


@query(
    "row_digests",
    """SELECT s_suppkey, sha256('{' || chr(10) || CASE WHEN s_nationkey % 3 = 0 THEN '' ELSE '  "nation": ' || s_nationkey || ',' || chr(10) END || '  "options": {' || chr(10) || '    "k": null,' || chr(10) || '    "name": "' || s_name || '"' || chr(10) || '  },' || chr(10)
    || '  "s_suppkey": ' || s_suppkey || chr(10) || '}' || chr(10)) AS digest FROM supplier""",
)
def row_digests(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    options = F.struct(F.col("s_name").alias("name"), F.lit(None).cast("int").alias("k"))
    return P.row_digest(s.select("s_suppkey", F.when(F.col("s_nationkey") % 3 != 0, F.col("s_nationkey")).alias("nation"), options.alias("options")), ["s_suppkey"])


@query("unanswerable_controls")
def unanswerable_controls(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case_id"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("paper_id"), F.regexp_extract("text", "[A-Za-z]{6,}", 0).alias("fact"))
    return P.unanswerable_controls(b, table(spark, sf_dir, "documents").select(F.col("source").alias("paper_id"), "text"))


@query(
    "abstention_rates",
    """SELECT role, count(*) AS n, round(count(*) FILTER (turn % 3 = 0) / count(*), 3) AS abstention_rate, round(count(*) FILTER (turn % 3 <> 0) / count(*), 3) AS fabrication_rate,
    count(*) FILTER (turn % 3 <> 0 AND contains(text, 'the')) AS fabricated_with_citation FROM conversations GROUP BY 1""",
)
def abstention_rates(spark, sf_dir):
    gone = F.col("turn") % 3 == 0
    return P.abstention_rates(table(spark, sf_dir, "conversations").select("role", gone.alias("abstained"), (~gone & F.col("text").contains("the")).alias("answered_with_citation")), ["role"])


@query(
    "parser_means",
    """SELECT 'P' || (o_custkey % 5) AS config_id, round(avg(o_orderkey % 97), 2) AS mean_ms_per_page, round(avg(o_orderkey % 7), 2) AS mean_tables_extracted, round(avg(o_orderkey % 11), 2) AS mean_sections_extracted, round(avg(o_orderkey % 301), 2) AS mean_evidence_blocks
    FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1""",
)
def parser_means(spark, sf_dir):
    part = lambda n: F.col("o_orderkey") % n
    error = F.when(F.col("o_orderstatus") == "F", "failed")
    runs = table(spark, sf_dir, "orders").select(F.concat(F.lit("P"), (F.col("o_custkey") % 5).cast("string")).alias("config_id"), part(97).alias("ms_per_page"), part(7).alias("tables"), part(11).alias("sections"), part(301).alias("blocks"), error.alias("error"))
    return P.parser_means(runs)


@query("citing_chunks")
def citing_chunks(spark, sf_dir):
    """Passages as the references of a source and their first long words as its entities, cited by all documents."""
    word = F.regexp_extract("text", r"([A-Za-z]{5,})", 1)
    b = table(spark, sf_dir, "benchmark").withColumn("source", F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")))
    refs = b.select("source", F.col("item_id").cast("int").alias("number"), "text", F.lower(word).alias("author"))
    return V.citing_chunks(refs, b.select("source", F.col("item_id").alias("place"), word.alias("entity")), _chunks(spark, sf_dir))


@query(
    "multi_level_sentences",
    """WITH s AS (SELECT conv_id AS q_id, text AS s, min(turn) AS o, length(text) AS n FROM conversations GROUP BY conv_id, text), a AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY n DESC, o) <= 2),
    b AS (SELECT * FROM s ANTI JOIN a USING (q_id, s) QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY n % 17 DESC, o) <= 2), c AS (SELECT * FROM (SELECT * FROM s ANTI JOIN a USING (q_id, s)) x ANTI JOIN b USING (q_id, s) QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY -n DESC, o) <= 2)
    SELECT q_id, 'problem' AS level, row_number() OVER (PARTITION BY q_id ORDER BY n DESC, o) AS place, md5(s) AS s FROM a UNION ALL SELECT q_id, 'derivation', row_number() OVER (PARTITION BY q_id ORDER BY n % 17 DESC, o), md5(s) FROM b
    UNION ALL SELECT q_id, 'empirical', row_number() OVER (PARTITION BY q_id ORDER BY -n DESC, o), md5(s) FROM c""",
)
def multi_level_sentences(spark, sf_dir):
    s = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("q_id"), F.col("text").alias("s")).agg(F.min("turn").alias("ord"))
    s = s.withColumns({"score_problem": F.length("s"), "score_derivation": F.length("s") % 17, "score_empirical": -F.length("s")})
    out = V.multi_level(s, ["problem", "derivation", "empirical"])
    return out.select("q_id", "level", F.col("place").cast("long").alias("place"), F.md5(F.col("s").cast("binary")).alias("s"))
