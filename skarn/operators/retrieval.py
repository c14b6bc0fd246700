"""Ranking operators: DataFrame in, DataFrame out, keyed by query; every window ends in a unique tie-break.

Conventions: documents have doc_id, queries have q_id; ranks count from 1; scores stay unrounded until the caller
rounds. Nulls in text count as empty text and never match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.functions.text import tokenize
from skarn.session import dealt, written

K1, B = 1.4, 0.72
RRF_K = 60


def term_counts(rows: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, term, tf), counted map-side before the shuffle."""
    return rows.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def postings(docs: DataFrame, queries: DataFrame, tokens=tokenize) -> DataFrame:
    """(doc_id, dl, term, tf) of the documents' terms that a query has, and for each document a row of the empty term.

    The corpus is tokenised once and this table is written: bm25() and keyword_overlap() read it as often as they need.
    Only matching terms are shuffled, by document; dl is the document's number of tokens.
    """
    terms = queries.select(F.explode(tokens("text")).alias("term")).distinct().unionByName(docs.sparkSession.createDataFrame([("",)], "term string"))
    terms = written(terms, "terms")  # of the queries: Spark sees that they are few, and leaves the documents' tokens where they are
    each = docs.select("doc_id", tokens("text").alias("t")).select("doc_id", F.size("t").alias("dl"), F.explode(F.array_append("t", F.lit(""))).alias("term"))
    return written(each.join(terms, "term", "left_semi").groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf")), "postings")


def word_scores(docs: DataFrame, queries: DataFrame, tokens=tokenize, k1: float = K1, b: float = B, table: DataFrame | None = None) -> DataFrame:
    """D1 and D5 in one sum: (q_id, doc_id, score, overlap) for pairs that share a term: BM25, and shared distinct tokens over
    the query's distinct tokens. table: postings() of the same docs and queries, if at hand.

    Postings are dealt by document before they meet the queries' terms, so where those are small enough to be broadcast
    the sums need no shuffle of pairs, and a following top_k() limits each partition first.
    """
    post = table if table is not None else postings(docs, queries, tokens)
    stats = post.filter("term = ''").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    real = post.filter("term <> ''")
    df = real.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weights = term_counts(queries, "q_id", tokens("text")).join(df, "term").join(F.broadcast(stats))  # stats: one row
    sizes = queries.select("q_id", F.size(F.array_distinct(tokens("text"))).alias("terms"))
    weights = weights.select("q_id", "term", "avgdl", (F.col("tf") * idf).alias("w")).join(sizes, "q_id")
    weights = written(weights, "term-weights")  # of the queries: Spark sees that it is small
    norm = k1 * (1 - b + b * F.col("dl") / F.greatest(F.col("avgdl"), F.lit(1.0)))
    part = F.col("w") * (F.col("tf") * (k1 + 1)) / (F.col("tf") + norm)
    return dealt(real, "doc_id").join(weights, "term").groupBy("q_id", "doc_id").agg(F.sum(part).alias("score"), (F.count(F.lit(1)) / F.max("terms")).alias("overlap"))


def bm25(docs: DataFrame, queries: DataFrame, tokens=tokenize, k1: float = K1, b: float = B, table: DataFrame | None = None) -> DataFrame:
    """(q_id, doc_id, score) for pairs that share a term, as word_scores() has them."""
    return word_scores(docs, queries, tokens, k1, b, table).select("q_id", "doc_id", "score")


def keyword_overlap(docs: DataFrame, queries: DataFrame, tokens=tokenize, table: DataFrame | None = None) -> DataFrame:
    """(q_id, doc_id, score): shared distinct tokens over the query's distinct tokens. table: as for bm25()."""
    post = table if table is not None else postings(docs, queries, tokens)
    q = queries.select("q_id", F.array_distinct(tokens("text")).alias("t")).select("q_id", F.size("t").alias("n"), F.explode("t").alias("term"))
    shared = dealt(post.filter("term <> ''").select("doc_id", "term"), "doc_id").join(q, "term")
    return shared.groupBy("q_id", "doc_id").agg((F.count(F.lit(1)) / F.max("n")).alias("score"))


def page_hints(scored: DataFrame, docs: DataFrame, hints: DataFrame, boost: float, tokens=tokenize) -> DataFrame:
    """D3 (boost 0.3 on bm25) and D5 (0.15 on keyword_overlap): (q_id, doc_id, score) with boost more for each document
    with a token whose page is among the query's hints (q_id, page), also where the score was 0."""
    on_page = docs.filter(F.size(tokens("text")) > 0).select("doc_id", "page").join(hints.select("q_id", "page").distinct(), "page")
    more = on_page.select("q_id", "doc_id", F.lit(float(boost)).alias("score"))
    return scored.select("q_id", "doc_id", "score").unionByName(more).groupBy("q_id", "doc_id").agg(F.sum("score").alias("score"))


def with_zeros(scored: DataFrame, docs: DataFrame, queries: DataFrame, tokens=tokenize) -> DataFrame:
    """(q_id, doc_id, score) where every document with a token is ranked for every query, at 0 when no term is shared.

    All pairs are the result, so its size is queries times documents."""
    every = docs.filter(F.size(tokens("text")) > 0).select("doc_id").crossJoin(queries.select("q_id").distinct())
    return every.join(scored.select("q_id", "doc_id", "score"), ["q_id", "doc_id"], "left").select("q_id", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def top_k(scored: DataFrame, k: int, score: str = "score", by: str = "q_id", tie: str = "doc_id") -> DataFrame:
    """The k best rows of each query with their rank; Spark limits each partition before the shuffle."""
    order = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(tie))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def reciprocal_rank_fusion(channels: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """Channels (q_id, doc_id, rank) -> (q_id, doc_id, rrf). The order of channels does not matter."""
    all_rows = channels[0].select("q_id", "doc_id", "rank")
    for c in channels[1:]:
        all_rows = all_rows.unionByName(c.select("q_id", "doc_id", "rank"))
    return all_rows.groupBy("q_id", "doc_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"))


def list_key() -> Column:
    """The order of a scored list (q_id, doc_id, score, later, ord): best score first, then later, ord and doc_id, nulls first."""
    return F.struct((-F.col("score")).alias("least"), "later", "ord", "doc_id")


def list_top(rows: DataFrame, depth: int) -> DataFrame:
    """The first `depth` rows of each query of a scored list, with their rank; Spark limits each partition before the shuffle.

    Rows are counted by score first, so that only those of scores that reach the first `depth` are put in order.
    """
    level = F.floor(F.col("score") * 32)
    counts = rows.groupBy("q_id", level.alias("__level")).agg(F.count(F.lit(1)).alias("__n"))
    better = F.sum("__n").over(Window.partitionBy("q_id").orderBy(F.col("__level").desc())) - F.col("__n")  # a row a score
    levels = counts.withColumn("__better", better).filter(F.col("__better") < depth).groupBy("q_id").agg(F.min("__level").alias("__level"))
    rows = rows.join(written(levels, "list-levels"), "q_id").filter(level >= F.col("__level")).drop("__level")
    order = Window.partitionBy("q_id").orderBy("__list")
    return rows.withColumn("__list", list_key()).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= depth).drop("__list")


def fusion_depth(lists: int, n: int, k: int = RRF_K) -> int:
    """Rows behind so many of each of the lists add up to less than 1 / (k + n), which the n-th row of one list alone has."""
    return lists * (k + n) - k


def ranks_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(q_id, doc_id, rank): the places in a scored list of wanted (q_id, doc_id), once each, a bounded number a query.

    Every row of the list is put between the wanted ones of its query by halving, and rows are counted by interval where they
    lie: the list is neither sorted nor moved.
    """
    rows = rows.select("q_id", list_key().alias("__list"), "doc_id")
    some = rows.join(wanted.select("q_id", "doc_id"), ["q_id", "doc_id"], "left_semi")
    marks = written(some.groupBy("q_id").agg(F.array_sort(F.collect_list("__list")).alias("__marks")), "rank-marks")
    most = marks.agg(F.max(F.size("__marks"))).first()[0] or 0
    at = rows.select("q_id", "__list").join(marks, "q_id").withColumn("__at", F.lit(0))
    for half in (1 << i for i in reversed(range(most.bit_length()))):
        at = at.withColumn("__at", F.when(F.get("__marks", F.col("__at") + (half - 1)) < F.col("__list"), F.col("__at") + half).otherwise(F.col("__at")))
    counts = at.groupBy("q_id", "__at").agg(F.count(F.lit(1)).alias("__n"))
    upto = counts.withColumn("rank", F.sum("__n").over(Window.partitionBy("q_id").orderBy("__at")))  # a row a wanted one
    placed = marks.select("q_id", F.posexplode("__marks").alias("__at", "__mark"))
    return placed.join(upto, ["q_id", "__at"]).select("q_id", F.col("__mark.doc_id").alias("doc_id"), "rank")


def best_fused(long: list[tuple[DataFrame, DataFrame]], short: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """(q_id, doc_id, rrf) of all that may be among the n best of the fused lists, with exact ranks, and of others.

    long: scored lists of any length, each with its list_top() of fusion_depth(len(long), n); short: lists (q_id, doc_id, rank)
    that are bounded as they are. What is in none of the tops and short lists is no answer, so the rest is ranked by
    ranks_of() for these candidates alone.
    """
    found = None
    for rows in [*(top for _, top in long), *short]:
        keys = rows.select("q_id", "doc_id")
        found = keys if found is None else found.unionByName(keys)
    found = written(found.distinct(), "fusion-candidates")
    return reciprocal_rank_fusion([*(ranks_of(rows, found) for rows, _ in long), *short], k)


def page_boost(fused: DataFrame, pages: DataFrame, boost: float = 0.05) -> DataFrame:
    """Fused (q_id, doc_id, rrf) with `boost` for documents that pages (q_id, doc_id) names."""
    marked = pages.select("q_id", "doc_id").distinct().withColumn("hit", F.lit(True))
    return fused.join(marked, ["q_id", "doc_id"], "left").select("q_id", "doc_id", (F.col("rrf") + F.when(F.col("hit"), boost).otherwise(0.0)).alias("score"))


def rank_prior(rank: Column, most: float) -> Column:
    """A prior that falls with the square root of the rank."""
    return F.when(rank > 0, F.least(F.lit(most), most / F.sqrt(rank.cast("double")))).otherwise(0.0)


# Cue words of the reranker, and stop words of bridges.
COMPARATIVE_WORDS = "outperform|crossover|tradeoff|trade-off|threshold|input context|context length|scaling|better|degrade|versus|vs"
RESULT_SECTIONS = "result|observation|evaluation|discussion|scaling"
CAPTION_WORDS = "comparison|scaling|degrade|performance|score|versus|vs"
BRIDGE_STOP = "this that with from were been have more also then into their paper section model".split()


def heuristic_rerank(rows: DataFrame) -> DataFrame:
    """Rows (query, text, rrf, chunk_type, caption, is_bridged, is_table, is_figure, image_boost, page_boost) with
    rerank_score: half the Jaccard similarity of words, 0.3 of the fusion score and the boosts, at most 1."""
    q, t = F.lower("query"), F.lower("text")
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?U)\w+"), F.lit(0)))
    qw, tw = words(q), words(t)
    jaccard = F.size(F.array_intersect(qw, tw)) / F.greatest(F.size(F.array_union(qw, tw)), F.lit(1))
    modal = (
        F.when(F.col("is_bridged"), 0.35)
        .when(q.contains("table") & F.col("is_table"), 0.2)
        .when((q.contains("figure") | q.contains("plot")) & F.col("is_figure"), 0.2)
        .otherwise(0.0)
    )
    comparative = q.rlike(COMPARATIVE_WORDS)
    section = F.when(comparative & (F.col("chunk_type").isin("result", "experiment") | t.rlike(RESULT_SECTIONS)), 0.25).otherwise(0.0)
    caption = F.when(comparative & F.col("is_figure") & F.lower("caption").rlike(CAPTION_WORDS), 0.25).otherwise(0.0)
    score = 0.5 * jaccard + 0.3 * F.col("rrf") + modal + F.col("image_boost") + F.col("page_boost") + section + caption
    return rows.withColumn("rerank_score", F.least(F.lit(1.0), score))


def bridge_edges(nodes: DataFrame) -> DataFrame:
    """Nodes (q_id, pos, source, text): pairs of different sources that share two tokens of four letters or more.

    Pairs meet on (query, token), so nothing is compared that shares no token.
    """
    words = F.array_distinct(F.filter(tokenize(F.lower("text")), lambda w: (F.length(w) >= 4) & ~w.isin(*BRIDGE_STOP)))
    each = nodes.select("q_id", "pos", "source", F.explode(words).alias("w"))
    other = each.select("q_id", "w", F.col("pos").alias("pos2"), F.col("source").alias("source2"))
    pairs = each.join(other, ["q_id", "w"]).filter((F.col("pos") < F.col("pos2")) & (F.col("source") != F.col("source2")))
    counted = pairs.groupBy("q_id", "pos", "pos2").agg(F.count(F.lit(1)).alias("shared")).filter("shared >= 2")
    return counted.withColumn("weight", F.least(F.lit(1.0), F.col("shared") / 5.0))



def merge_unique(primary: DataFrame, secondary: DataFrame, key: str, order: str, limit: int) -> DataFrame:
    """Primary rows, then secondary ones, first of each key, at most `limit`."""
    both = primary.withColumn("__src", F.lit(0)).unionByName(secondary.withColumn("__src", F.lit(1)))
    first = both.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy("__src", order))).filter("__r = 1")
    return first.orderBy("__src", order).limit(limit).drop("__src", "__r")


def paper_relevance(papers: DataFrame, queries: DataFrame, search_tokens, normalized) -> DataFrame:
    """(q_id, doc_id, matched, score) of papers (doc_id, title, summary, authors, category) that share a term."""
    fields = ["title", "summary", "authors", "category"]
    weight = {"title": 14.0, "summary": 3.0, "authors": 8.0, "category": 5.0}
    q = written(queries.select("q_id", normalized("text").alias("qn"), F.array_distinct(search_tokens("text")).alias("qt"), F.size(search_tokens("text")).alias("n_tokens")), "paper-queries")
    p = dealt(papers.select("doc_id", *fields), "doc_id").select("doc_id", normalized("title").alias("tn"), *[F.array_distinct(search_tokens(f)).alias(f) for f in fields])
    p = p.withColumn("terms", F.array_distinct(F.concat(*fields)))
    met = p.withColumn("w", F.explode("terms")).join(q.withColumn("w", F.explode("qt")), "w")
    rows = met.filter(F.col("w") == F.get(F.array_intersect("qt", "terms"), F.lit(0)))  # a pair is kept where its first term met
    hits = {f: F.array_intersect("qt", f) for f in fields}
    matched = F.size(F.array_distinct(F.concat(*hits.values())))
    n = F.greatest(F.size("qt"), F.lit(1))
    exact = F.when(F.col("qn") == F.col("tn"), 200.0).when((F.col("qn") != "") & F.col("tn").contains(F.col("qn")), 90.0).when((F.col("tn") != "") & F.col("qn").contains(F.col("tn")), 70.0).otherwise(0.0)
    score = exact + sum(F.size(hits[f]) * weight[f] for f in fields) + F.size(hits["title"]) / n * 35.0 + matched / n * 12.0
    score = score - F.when((F.col("n_tokens") >= 2) & (matched < 2), 40.0).otherwise(0.0)
    return rows.select("q_id", "doc_id", matched.cast("long").alias("matched"), score.alias("score")).filter("score >= 8 AND matched > 0")


def hashing_encoder(docs: DataFrame, dim: int = 384, version: str = "sha256-signed-feature-hashing-v1") -> DataFrame:
    """(doc_id, bucket, value): signed feature hashing of words and half-weight trigrams, unit length.

    Only Catalyst functions; the sparse form is kept, since most of the dim buckets of a short text are zero.
    """
    clean = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"(?U)[^\w\s]", " ")
    words = docs.select("doc_id", F.explode(F.filter(F.split(clean, r"\s+"), lambda w: w != "")).alias("w")).groupBy("doc_id", "w").agg(F.count(F.lit(1)).alias("n"))
    tri = F.when(F.length("w") >= 3, F.transform(F.sequence(F.lit(1), F.length("w") - 2), lambda i: F.struct(F.lit("trigram").alias("kind"), F.substring(F.col("w"), i, F.lit(3)).alias("f"), F.lit(0.5).alias("x"))))
    both = F.concat(F.array(F.struct(F.lit("word").alias("kind"), F.col("w").alias("f"), F.lit(1.0).alias("x"))), F.coalesce(tri, F.array().cast("array<struct<kind:string,f:string,x:double>>")))
    each = words.select("doc_id", "n", F.explode(both).alias("e")).groupBy("doc_id", "e.kind", "e.f").agg(F.sum(F.col("n") * F.col("e.x")).alias("x"))
    digest = F.sha2(F.concat(F.lit(version), F.lit("\0"), F.col("kind"), F.lit("\0"), F.col("f")).cast("binary"), 256)
    bucket = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % dim
    sign = F.when(F.conv(F.substring(digest, 18, 1), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    summed = each.select("doc_id", bucket.cast("int").alias("bucket"), (sign * F.col("x")).alias("v")).groupBy("doc_id", "bucket").agg(F.sum("v").alias("v"))
    length = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("doc_id")))
    return summed.withColumn("value", F.when(length > 1e-9, F.col("v") / length).otherwise(F.col("v"))).filter("v <> 0").select("doc_id", "bucket", "value")
