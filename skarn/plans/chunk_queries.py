"""Registered chunking, geometry and dialogue queries over whole tables, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skarn.functions import geometry as G
from skarn.operators import chunking as C
from skarn.plans.base import quoted
from skarn.session import table

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _pages(spark, sf_dir):
    """Sources are papers, documents their pages."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("paper_id"), F.col("doc_id").alias("page"), "text")


@query(
    "page_windows",
    r"""WITH p AS (SELECT source AS paper_id, doc_id AS page, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS w FROM documents),
    s AS (SELECT paper_id, page, w, unnest(list_filter(range(0, len(w), 180), lambda s: s = 0 OR s - 180 + 200 < len(w))) AS s FROM p WHERE len(w) > 0),
    t AS (SELECT paper_id, page, s, array_to_string(w[s + 1:s + 200], ' ') AS t, CASE WHEN s > 0 THEN length(array_to_string(w[1:s], ' ')) ELSE 0 END AS a FROM s)
    SELECT paper_id, page, 'chunk_' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS chunk_id, a AS char_start, a + length(t) AS char_end, md5(t) AS text_md5
    FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY page, s) AS n FROM t)""",
)
def page_windows(spark, sf_dir):
    c = C.page_windows(_pages(spark, sf_dir), 200, 20)
    return c.select("paper_id", "page", "chunk_id", F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(
    "fixed_chunks",
    """WITH p AS (SELECT conv_id AS paper_id, turn AS page, text, length(text) AS n FROM conversations), e AS (SELECT *, sum(n + 1) OVER (PARTITION BY paper_id ORDER BY page) - 1 AS e FROM p),
    f AS (SELECT paper_id, string_agg(text, chr(10) ORDER BY page) AS t FROM p GROUP BY 1), s AS (SELECT paper_id, t, unnest(list_filter(range(0, length(t), 250), lambda s: s = 0 OR s - 250 + 300 < length(t))) AS s FROM f WHERE length(t) > 0),
    m AS (SELECT *, CAST(floor((s + least(s + 300, length(t))) / 2) AS BIGINT) AS mid, row_number() OVER (PARTITION BY paper_id ORDER BY s) AS chunk_no FROM s)
    SELECT m.paper_id, chunk_no, md5(substr(t, s + 1, 300)) AS text_md5, coalesce((SELECT min(page) FROM e WHERE e.paper_id = m.paper_id AND m.mid < e.e), (SELECT max(page) FROM e WHERE e.paper_id = m.paper_id)) AS page FROM m""",
)
def fixed_chunks(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("paper_id"), F.col("turn").alias("page"), "text")
    out = C.fixed_chunks(c, 300, 50)
    return out.select("paper_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.md5(F.col("text").cast("binary")).alias("text_md5"), F.col("page").cast("long").alias("page"))


@query(
    "figure_chunks",
    """SELECT 'fig_' || p_partkey AS chunk_id, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE p_brand || ': ' || p_type END || CASE WHEN p_size % 2 = 0 THEN '' ELSE chr(10) || p_name END AS text,
    CASE WHEN p_size % 5 = 0 THEN 'table' ELSE 'figure' END AS chunk_type, p_size % 5 = 0 AS is_table_chunk FROM part""",
)
def figure_chunks(spark, sf_dir):
    f = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("figure_id"),
        F.col("p_brand").alias("label"),
        F.when(F.col("p_size") % 3 == 0, " ").otherwise(F.col("p_type")).alias("caption"),
        F.when(F.col("p_size") % 2 == 1, F.col("p_name")).alias("body_text"),
        F.when(F.col("p_size") % 5 == 0, "table").alias("figure_type"),
    )
    return C.figure_chunks(f).select("chunk_id", "text", "chunk_type", "is_table_chunk")


@query(
    "merge_figures",
    """WITH c AS (SELECT s_nationkey AS source, 'c' || s_suppkey AS chunk_id, CASE WHEN s_suppkey % 2 = 0 THEN 'i' || s_suppkey END AS image_file, s_suppkey AS figure_id, 'old' AS caption FROM supplier),
    f AS (SELECT s_nationkey AS source, 'f' || s_suppkey AS chunk_id, 'i' || s_suppkey AS image_file, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey ELSE -s_suppkey END AS figure_id, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE s_name END AS caption FROM supplier),
    j AS (SELECT c.*, coalesce(f.chunk_id, g.chunk_id) AS met, coalesce(nullif(coalesce(f.caption, g.caption), ''), c.caption) AS cap FROM c LEFT JOIN f ON c.source = f.source AND c.image_file = f.image_file
          LEFT JOIN f g ON f.chunk_id IS NULL AND c.source = g.source AND c.figure_id = g.figure_id)
    SELECT source, chunk_id, image_file, figure_id, cap AS caption FROM j UNION ALL SELECT * FROM f WHERE (source, chunk_id) NOT IN (SELECT source, met FROM j WHERE met IS NOT NULL)""",
)
def merge_figures(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    key, no = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    c = s.select(F.col("s_nationkey").alias("source"), F.concat(F.lit("c"), no).alias("chunk_id"), F.when(key % 2 == 0, F.concat(F.lit("i"), no)).alias("image_file"), key.alias("figure_id"), F.lit("old").alias("caption"))
    f = s.select(F.col("s_nationkey").alias("source"), F.concat(F.lit("f"), no).alias("chunk_id"), F.concat(F.lit("i"), no).alias("image_file"), F.when(key % 3 == 0, key).otherwise(-key).alias("figure_id"), F.when(key % 5 == 0, "").otherwise(F.col("s_name")).alias("caption"))
    return C.merge_figures(c, f)


@query(
    "layout_blocks",
    r"""WITH b AS (SELECT doc_id AS paper_id, unnest(x) AS t, generate_subscripts(x, 1) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)), s AS (SELECT paper_id, n, trim(t) AS t FROM b WHERE length(trim(t)) >= 10),
    h AS (SELECT *, CASE WHEN regexp_matches(t, '^(?:[0-9]+(?:[.][0-9]+)*|[A-Z][a-z]+)\s+[A-Z]') AND length(t) < 80 THEN t END AS h FROM s),
    w AS (SELECT *, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY paper_id ORDER BY n), 'Body') AS section, lead(n) OVER (PARTITION BY paper_id ORDER BY n) AS nx FROM h)
    SELECT paper_id, count(*) AS n_blocks, count(*) FILTER (contains(t, '|') OR contains(t, chr(9)) OR contains(left(t, 15), 'Table ')) AS n_tables, count(DISTINCT section) AS n_sections, count(nx) AS n_next FROM w GROUP BY 1""",
)
def layout_blocks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), F.posexplode(F.split("text", "\n")).alias("block_no", "text"))
    return C.layout_blocks(d).groupBy("paper_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.count_if("is_table").alias("n_tables"), F.countDistinct("section").alias("n_sections"), F.count("next").alias("n_next"))


def _first_pages(spark, sf_dir):
    """Pages with a head: every text behind a title, an author mark and an abstract that an introduction ends in one of two."""
    p = _pages(spark, sf_dir)
    end = F.when(F.col("page") % 2 == 0, " 1 Introduction and ever more").otherwise("")
    return p.select("paper_id", "page", F.concat(F.lit("A study of\n  "), "paper_id", F.lit(" documents\nAuthor list\n ABSTRACT  "), "text", end).alias("text"))


@query(
    "inferred_metadata",
    r"""WITH f AS (SELECT source AS paper_id, min_by(text, doc_id) AS t, min(doc_id) AS d FROM documents GROUP BY 1), x AS (SELECT paper_id, trim(regexp_replace(t, '\s+', ' ', 'g')) AS t FROM f),
    y AS (SELECT *, trim(regexp_extract(t || ' 1 Introduction', '(?i)^(.*?)(?:\b1\s+introduction\b|\bintroduction\b|\bkeywords\b)', 1)) AS ab FROM x)
    SELECT paper_id, 'A study of ' || paper_id || ' documents' AS title, CASE WHEN ab = '' THEN 'Custom PDF uploaded for local study.' ELSE left(ab, 1800) END AS abstract FROM y""",
)
def inferred_metadata(spark, sf_dir):
    return C.inferred_metadata(_first_pages(spark, sf_dir))


@query(
    "figure_captions",
    r"""WITH e AS (SELECT source AS paper_id, doc_id AS page, unnest(m) AS c, generate_subscripts(m, 1) AS p FROM (SELECT source, doc_id, regexp_extract_all(text, '(?i)(?:^|\n)\s*((?:figure|fig\.?|table)\s*\d+(?:\.\d+)?[.:]?[^\n]*)', 1) AS m FROM documents)),
    n AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY page, p) AS figure_no FROM e)
    SELECT paper_id, page, figure_no, CASE WHEN lower(c) LIKE 'table%' THEN 'table' ELSE 'figure' END AS kind, regexp_extract(c, '\d+(?:\.\d+)?') AS number, trim(c) AS caption FROM n WHERE figure_no <= 80""",
)
def figure_captions(spark, sf_dir):
    return C.figure_captions(_pages(spark, sf_dir))


@query(
    "bibliography",
    r"""WITH p AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS r, substr(source, 4) AS k FROM documents),
    t AS (SELECT source, k, string_agg(text || chr(10) || CASE WHEN CAST(k AS INT) % 2 = 0 THEN '[' || (doc_id % 100) || '] Numbered entry of page ' || doc_id || chr(10) || (doc_id % 100 + 1) || '. Another entry' ELSE 'Writer, A. B. (2019). Long title of page ' || doc_id || '.' END, ' ' ORDER BY doc_id) AS t FROM p WHERE r <= 6 GROUP BY 1, 2),
    n AS (SELECT source, unnest(regexp_extract_all(t, '(?m)^\s*\[?(\d{1,3})\]?[.\s]+([A-Z].{8,})', 1)) AS number, unnest(regexp_extract_all(t, '(?m)^\s*\[?(\d{1,3})\]?[.\s]+([A-Z].{8,})', 2)) AS x, generate_subscripts(regexp_extract_all(t, '(?m)^\s*\[?(\d{1,3})\]?[.\s]+([A-Z].{8,})', 2), 1) AS i FROM t),
    o AS (SELECT source, CAST(number AS INT) AS number, min_by(left(x, 120), i) AS reference FROM n GROUP BY 1, 2),
    few AS (SELECT t.source, t, (SELECT count(*) FROM o WHERE o.source = t.source) AS c FROM t),
    y AS (SELECT source, unnest(regexp_extract_all(t, '([A-Z][a-z]+(?:,\s+[A-Z]\.?)+.*?\(\d{4}\)[.,]\s+)([A-Z][^.]{10,}\.)', 2)) AS x, generate_subscripts(regexp_extract_all(t, '([A-Z][a-z]+(?:,\s+[A-Z]\.?)+.*?\(\d{4}\)[.,]\s+)([A-Z][^.]{10,}\.)', 2), 1) AS i FROM few WHERE c = 0)
    SELECT source AS paper_id, number, reference FROM o UNION ALL SELECT source, CAST(2 * i - 1 AS INT), left(x, 120) FROM y""",
)
def bibliography(spark, sf_dir):
    """Sources of an even number have numbered references at the end of each page, the others author-year ones."""
    p = _pages(spark, sf_dir)
    n = F.col("page") % 100
    numbered = F.concat(F.lit("["), n.cast("string"), F.lit("] Numbered entry of page "), F.col("page").cast("string"), F.lit("\n"), (n + 1).cast("string"), F.lit(". Another entry"))
    named = F.concat(F.lit("Writer, A. B. (2019). Long title of page "), F.col("page").cast("string"), F.lit("."))
    entry = F.when(F.substring("paper_id", 4, 10).cast("int") % 2 == 0, numbered).otherwise(named)
    return C.bibliography(p.select("paper_id", "page", F.concat("text", F.lit("\n"), entry).alias("text")))


@query("even_spread", "WITH k AS (SELECT DISTINCT source FROM documents), n AS (SELECT greatest(1, count(*) // 25) AS s FROM k) SELECT source FROM (SELECT source, row_number() OVER (ORDER BY source) - 1 AS r FROM k), n WHERE r % s = 0 AND r < 25 * s")
def even_spread(spark, sf_dir):
    return C.even_spread(table(spark, sf_dir, "documents"), "source")


_CASE_ENDS = ["?", ".", " does?", "?"]
_CASE_ANSWERS = ["it is {p}, the gradient", "Not explicitly stated", "short", "the value of {p} is known", "This does not mention it", "it is {p} in steel"]


@query(
    "valid_cases",
    rf"""WITH c AS (SELECT p_partkey AS case_id, ['text', 'math', 'figure'][p_partkey % 3 + 1] AS kind, CASE WHEN p_partkey % 11 = 0 THEN 'What does the table show?' WHEN p_partkey % 13 = 0 THEN 'Which part, by Smith et al, is it?' WHEN p_partkey % 17 = 0 THEN 'Its ISBN is which?' ELSE 'What is ' || p_brand || ' of size ' || p_size || {'[' + ', '.join(quoted(x) for x in _CASE_ENDS) + ']'}[p_size % {len(_CASE_ENDS)} + 1] END AS q,
        replace({'[' + ', '.join(quoted(x) for x in _CASE_ANSWERS) + ']'}[p_partkey % {len(_CASE_ANSWERS)} + 1], '{{p}}', p_brand) AS a, p_brand, p_name, p_type FROM part),
    g AS (SELECT *, (CASE WHEN case_id % 2 = 0 THEN 1 ELSE 0 END) + 1 AS hits, CASE WHEN case_id % 7 = 0 THEN 0 ELSE 4 END AS n FROM c),
    v AS (SELECT * FROM g WHERE length(q) >= 12 AND q LIKE '%?' AND length(a) >= 8 AND NOT regexp_matches(lower(a), 'does not mention|not explicitly|cannot be determined|not specified') AND NOT regexp_matches(q, '(?i:isbn)|by Smith et al')
        AND NOT (kind = 'math' AND NOT regexp_matches(lower(q || ' ' || a), 'gradient|=|loss|\blog\b')) AND NOT (kind = 'figure' AND q = 'What does the table show?') AND n = 4 AND hits >= 2)
    SELECT min(case_id) AS case_id, q AS question FROM v GROUP BY q""",
)
def valid_cases(spark, sf_dir):
    """Cases over part: of four facts the brand always, the word "steel" in every other passage, and two never occur."""
    key = F.col("p_partkey")
    pick = lambda values, c: F.element_at(F.array(*[F.lit(v) for v in values]), (c % len(values) + 1).cast("int"))
    asked = F.concat(F.lit("What is "), "p_brand", F.lit(" of size "), F.col("p_size").cast("string"), pick(_CASE_ENDS, F.col("p_size")))
    question = F.when(key % 11 == 0, "What does the table show?").when(key % 13 == 0, "Which part, by Smith et al, is it?").when(key % 17 == 0, "Its ISBN is which?").otherwise(asked)
    facts = F.when(key % 7 == 0, F.array(F.lit(" "))).otherwise(F.array("p_brand", F.lit(" STEEL "), F.lit("tee"), F.lit("nowhere"), F.col("p_brand")))
    passage = F.concat_ws(" ", F.lower("p_brand"), F.when(key % 2 == 0, "(steel)").otherwise("steely"))
    rows = table(spark, sf_dir, "part").select(
        key.alias("case_id"), pick(["text", "math", "figure"], key).alias("kind"), question.alias("question"), F.replace(pick(_CASE_ANSWERS, key), F.lit("{p}"), F.col("p_brand")).alias("answer"), facts.alias("facts"), passage.alias("passage")
    )
    return C.valid_cases(rows).select("case_id", "question")


@query(
    "conversation_referents",
    rf"""WITH c AS (SELECT conv_id, turn, lower(role) AS role, trim(text) AS t FROM conversations),
    w AS (SELECT *, coalesce(last_value(CASE WHEN role = 'user' THEN nullif(t, '') END IGNORE NULLS) OVER p, last_value(nullif(t, '') IGNORE NULLS) OVER p) AS x FROM c WINDOW p AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
    h AS (SELECT *, regexp_matches(t, '(?i)\b(it|its|they|them|their|this|that|these|those)\b') OR len(list_filter(regexp_extract_all(t, '(?i)\bthe\s+(?:model|method|approach|architecture|authors?)\b(\s+(?:of|in|for|from|described|proposed|named)\b)?', 1), lambda y: coalesce(y, '') = '')) > 0
        OR {' OR '.join(f"starts_with(lower(t), {quoted(e)})" for e in C.ELLIPTIC)} AS has FROM w WHERE role = 'user'),
    b AS (SELECT *, trim(regexp_replace(regexp_replace(x, {quoted(C.QUESTION_LEAD)}, ''), '^[? .!]+|[? .!]+$', '', 'g')) AS bare, trim(regexp_replace(x, '^[? .!]+|[? .!]+$', '', 'g')) AS whole FROM h),
    p AS (SELECT *, list_filter(string_split_regex(CASE WHEN bare <> '' THEN bare ELSE whole END, '\s+'), lambda y: y <> '') AS ws, CASE WHEN bare <> '' THEN bare ELSE whole END AS plain FROM b)
    SELECT conv_id, turn, CASE WHEN has AND x IS NOT NULL AND plain <> '' THEN t || ' (context: ' || CASE WHEN len(ws) > 8 THEN array_to_string(ws[1:8], ' ') ELSE plain END || ')' ELSE t END AS resolved FROM p""",
)
def conversation_referents(spark, sf_dir):
    return C.resolved_queries(table(spark, sf_dir, "conversations"))


_B = "least(a, c) AS x0, least(b, d) AS y0, greatest(a, c) AS x1, greatest(b, d) AS y1"


@query(
    "box_scalars",
    """WITH e AS (SELECT vec_id, round(greatest(0, least(1, CAST(embedding[1] AS DOUBLE) / 4 + 0.5)), 4) AS a, round(greatest(0, least(1, CAST(embedding[2] AS DOUBLE) / 4 + 0.5)), 4) AS b, round(greatest(0, least(1, CAST(embedding[3] AS DOUBLE) / 4 + 0.5)), 4) AS c,
        round(greatest(0, least(1, CAST(embedding[4] AS DOUBLE) / 4 + 0.5)), 4) AS d FROM embeddings),
    b AS (SELECT vec_id, least(a, c) AS x0, least(b, d) AS y0, greatest(a, c) AS x1, greatest(b, d) AS y1 FROM e),
    i AS (SELECT *, (x1 - x0) * (y1 - y0) AS s, greatest(0, least(x1, 0.75) - greatest(x0, 0.25)) * greatest(0, least(y1, 0.75) - greatest(y0, 0.25)) AS m FROM b)
    SELECT vec_id, round(s, 6) AS area, round(CASE WHEN s + 0.25 - m > 0 THEN m / (s + 0.25 - m) ELSE 0 END, 6) AS iou, x0 >= 0.25 AND y0 >= 0.25 AND x1 <= 0.75 AND y1 <= 0.75 AS inside FROM i""",
)
def box_scalars(spark, sf_dir):
    v = lambda i: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("embedding")[i].cast("double") / 4 + 0.5)), 4)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", G.box(v(0), v(1), v(2), v(3)).alias("b"), G.box(F.lit(0.25), F.lit(0.25), F.lit(0.75), F.lit(0.75)).alias("q"))
    b, q = F.col("b"), F.col("q")
    return rows.select("vec_id", F.round(G.area(b), 6).alias("area"), F.round(G.iou(b, q), 6).alias("iou"), G.contains(q, b).alias("inside"))


@query("page_text", rf"SELECT page_id, length(trim(regexp_replace(regexp_replace(html, {quoted('<[^>]*>')}, ' ', 'g'), '\s+', ' ', 'g'))) AS n_chars FROM pages")
def page_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.length(F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"\s+", " "))).cast("long").alias("n_chars"))
