"""Registered queries of the text functions, each over a whole table, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skarn.functions import text as T
from skarn.plans.base import QUESTIONS_SQL, plain_tokens_sql, questions, quoted, sentences_sql, sql_list, tokens_sql
from skarn.session import table

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


@query("tokenize_counts", f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, coalesce(t[1], '') AS first_token FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents)")
def tokenize_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.tokenize("text").alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.coalesce(F.get("t", F.lit(0)), F.lit("")).alias("first_token"))


_SEARCH_SQL = f"list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: NOT list_contains({sql_list(T.SEARCH_STOP)}, w) AND length(w) > 1)"


@query(
    "tokenizer_variants",
    f"""SELECT doc_id, len({plain_tokens_sql('text')}) AS n_plain,
        len(list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9-]*'), lambda w: NOT list_contains({sql_list(T.NLI_STOP)}, w) AND length(w) > 1)) AS n_nli,
        len(list_distinct({tokens_sql("lower(translate(text, '/-', '  '))")})) AS n_slash_set, len({_SEARCH_SQL}) AS n_search,
        length(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS n_alphanumeric FROM documents""",
)
def tokenizer_variants(spark, sf_dir):
    size = lambda c, n: F.size(c).cast("long").alias(n)
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        size(T.tokenize_plain("text"), "n_plain"),
        size(T.tokenize_nli("text"), "n_nli"),
        size(T.token_set_slashes("text"), "n_slash_set"),
        size(T.search_tokens("text"), "n_search"),
        F.length(T.alphanumeric("text")).cast("long").alias("n_alphanumeric"),
    )


@query(
    "squad_normalized",
    rf"SELECT item_id, array_to_string(list_filter(string_split_regex(translate(lower(text), {quoted(T.ASCII_PUNCTUATION)}, ''), '\s+'), lambda w: NOT list_contains(['', 'a', 'an', 'the'], w)), ' ') AS normalized FROM benchmark",
)
def squad_normalized(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.squad_normalized("text").alias("normalized"))


_BOILER = " OR ".join(f"contains(lower(s), {quoted(b)})" for b in T.BOILERPLATE)


@query(
    "sentence_splits",
    rf"""WITH d AS (SELECT doc_id, trim(text) AS t, {sentences_sql('text')} AS s FROM documents),
    e AS (SELECT doc_id, t, s, list_filter(list_transform({sentences_sql('t')}, lambda x: trim(x)), lambda x: len(regexp_extract_all(x, '\S+')) >= 4) AS g FROM d)
    SELECT doc_id, len(s) AS n_sentences, CASE WHEN len(g) > 0 THEN len(g) ELSE 1 END AS n_long,
        len(list_filter(list_transform(s, lambda x: trim(x)), lambda x: length(x) > 55)) AS n_candidates,
        coalesce(md5(left(list_filter(list_transform(s, lambda x: trim(x)), lambda x: length(x) > 55)[1], 500)), '') AS first_candidate FROM e""",
)
def sentence_splits(spark, sf_dir):
    c = T.candidate_sentences("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.size(T.sentences("text")).cast("long").alias("n_sentences"),
        F.size(T.long_sentences("text")).cast("long").alias("n_long"),
        F.size(c).cast("long").alias("n_candidates"),
        F.coalesce(F.md5(F.get(c, F.lit(0)).cast("binary")), F.lit("")).alias("first_candidate"),
    )


_REPAIRED = "text"
for _a, _b in T.LIGATURES:
    _REPAIRED = f"replace({_REPAIRED}, {quoted(_a)}, {quoted(_b)})"
_REPAIR_SQL = rf"replace(regexp_replace({_REPAIRED}, '(\w+)-\s+(\w+)', '\1\2', 'g'), chr(10), ' ')"


@query(
    "atom_splits",
    rf"""WITH d AS (SELECT doc_id, text, trim(text) AS t FROM documents), g AS (SELECT doc_id, text, t, list_filter(list_transform({sentences_sql('t')}, lambda x: trim(x)), lambda x: len(regexp_extract_all(x, '\S+')) >= 4) AS g FROM d),
    l AS (SELECT doc_id, text, CASE WHEN len(g) > 0 THEN g ELSE [t] END AS g FROM g), a AS (SELECT doc_id, text, len(list_filter(flatten(list_transform(g, lambda x: string_split(regexp_replace(x, '\s+and\s+([A-Z]|the\b|it\b|they\b|this\b)', chr(1) || '\1', 'g'), chr(1)))), lambda x: len(regexp_extract_all(x, '\S+')) >= 3)) AS n FROM l)
    SELECT doc_id, CASE WHEN n > 0 THEN n ELSE 1 END AS n_atoms, len(list_filter(list_transform({sentences_sql(_REPAIR_SQL)}, lambda x: trim(x)), lambda s: length(s) > 30 AND NOT ({_BOILER}))) AS n_key_sentences FROM a""",
)
def atom_splits(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.atoms("text")).cast("long").alias("n_atoms"), F.size(T.key_sentences("text")).cast("long").alias("n_key_sentences"))


_HINTS = " || ".join(
    f"CASE WHEN regexp_matches(lower(question), {quoted(words)})" + (f" OR regexp_matches(lower(question), {quoted(T.COMPARATIVE)})" if "result" in names else "") + f" THEN {sql_list(names)} ELSE [] END" for names, words in T.SECTION_HINTS
)


@query(
    "question_signals",
    rf"""SELECT q_id,
        array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(question, '(?i)\b(?:figure|fig\.?|table)\s*\.?\s*\d+(?:\.\d+)?\b'),
            lambda s: CASE WHEN lower(s) LIKE 'table%' THEN 'table ' ELSE 'figure ' END || regexp_extract(s, '\d+(?:\.\d+)?$')))), ',') AS figure_refs,
        array_to_string(list_sort(list_distinct(flatten(list_transform(regexp_extract_all(lower(question), '\bpages?\s+([0-9,\sand]+)', 1), lambda r: regexp_extract_all(r, '\d+'))))), ',') AS page_hints,
        array_to_string(list_sort(list_distinct({_HINTS})), ',') AS section_hints,
        regexp_matches(lower(question), {quoted(T.VISUAL_TERMS)}) OR regexp_matches(lower(question), {quoted(T.VISUAL_CUES)}) AS visual_intent,
        regexp_matches(lower(question), {quoted(T.METRIC_CUES)}) OR contains(lower(question), 'table') OR contains(lower(question), 'tabular') AS tabular_intent
        FROM {QUESTIONS_SQL}""",
)
def question_signals(spark, sf_dir):
    q = F.col("question")
    return questions(spark, sf_dir).select(
        "q_id",
        F.array_join(T.figure_refs(q), ",").alias("figure_refs"),
        F.array_join(F.array_sort(T.page_hints(q)), ",").alias("page_hints"),
        F.array_join(T.section_hints(q), ",").alias("section_hints"),
        T.visual_intent(q).alias("visual_intent"),
        T.tabular_intent(q).alias("tabular_intent"),
    )


_TYPES = " ".join(f"WHEN regexp_matches(b, {quoted(p)}) THEN {quoted(n)}" for n, p in T.SECTION_TYPES)
_RESULTS = " OR ".join(f"contains(b, {quoted(w)})" for w in T.RESULT_WORDS)


@query(
    "chunk_types",
    f"""SELECT doc_id, CASE WHEN p = 1 AND contains(b, 'abstract') THEN 'abstract' {_TYPES} WHEN {_RESULTS} THEN 'result' ELSE 'body' END AS chunk_type
    FROM (SELECT doc_id, doc_id % 3 + 1 AS p, lower(source || ' ' || left(text, 900)) AS b FROM documents)""",
)
def chunk_types(spark, sf_dir):
    page = F.col("doc_id") % 3 + 1
    return table(spark, sf_dir, "documents").select("doc_id", T.chunk_type("text", F.col("source"), page).alias("chunk_type"))


@query("section_titles")
def section_titles(spark, sf_dir):
    page = F.col("doc_id") % 3 + 1
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.section_title("text", page).alias("section_title"), F.array_join(T.section_path("text", page), " > ").alias("section_path"), F.size(T.headings("text")).cast("long").alias("n_headings"))


@query(
    "paragraph_previews",
    rf"""SELECT doc_id, md5(left(trim(array_to_string({sentences_sql(r"trim(regexp_replace(text, '\s+', ' ', 'g'))")}[1:5], ' ')), 900)) AS preview FROM documents""",
)
def paragraph_previews(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.paragraph_preview("text").cast("binary")).alias("preview"))


@query(
    "labels_and_ids",
    r"""SELECT p_partkey, regexp_replace(trim(lower(p_name || '  ' || p_type)), '\s+', ' ', 'g') AS label,
        coalesce(nullif(regexp_replace(regexp_replace(p_name || '/' || p_brand || '#_', '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), ''), 'paper') AS paper_id FROM part""",
)
def labels_and_ids(spark, sf_dir):
    both = F.concat(F.col("p_name"), F.lit("/"), F.col("p_brand"), F.lit("#_"))
    return table(spark, sf_dir, "part").select("p_partkey", T.label_normalized(F.concat(F.col("p_name"), F.lit("  "), F.col("p_type"))).alias("label"), T.paper_id_sanitized(both).alias("paper_id"))


_CELLS = [("$1,{n}.5% (±0.3)", "a"), ("{n}.25 +/- 0.1", "b"), ("−", "c"), ("{n}e2 [12]", "d"), ("**{n}**†", "e"), ("n/a", "f"), ("-.{n} (best)", "g")]


def _cell_sql() -> str:
    return f"replace({sql_list([c for c, _ in _CELLS])}[p_partkey % {len(_CELLS)} + 1], '{{n}}', CAST(p_size AS VARCHAR))"


@query(
    "numbers_cleaned",
    rf"""SELECT p_partkey, TRY_CAST(nullif(regexp_extract(translate(string_split(string_split(regexp_replace(regexp_replace({_cell_sql()}, '[\$\\^\*†‡§]', '', 'g'), '\[.*?\]|\(.*?\)', '', 'g'), '±')[1], '+/-')[1], ',%', ''),
        '[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?'), '') AS DOUBLE) AS value FROM part""",
)
def numbers_cleaned(spark, sf_dir):
    cell = F.element_at(F.array(*[F.lit(c) for c, _ in _CELLS]), (F.col("p_partkey") % len(_CELLS) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", T.number_cleaned(F.replace(cell, F.lit("{n}"), F.col("p_size").cast("string"))).alias("value"))


@query(
    "number_sets",
    rf"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(regexp_replace(text, {quoted(T.STRUCTURAL_NUMBER)}, '', 'g'), {quoted(T.NUMBER)}))), ',') AS numbers FROM documents""",
)
def number_sets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.number_set("text"), ",").alias("numbers"))


@query(
    "answer_filters",
    rf"""SELECT conv_id, turn, regexp_matches(lower(text), {quoted("|".join(f"(?:{p})" for p in T.DISCLAIMERS))}) AS disclaimer,
        len(list_filter(list_transform({sentences_sql("replace(text, chr(10), ' ')")}, lambda s: trim(s)), lambda s: length(s) > 40 AND NOT regexp_matches(s, {quoted(T.REFUSALS)}))) AS n_substantive FROM conversations""",
)
def answer_filters(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_disclaimer("text").alias("disclaimer"), F.size(T.substantive_sentences("text")).cast("long").alias("n_substantive"))


@query(
    "short_quotes",
    rf"""WITH q AS (SELECT item_id, {tokens_sql('text')} AS t FROM benchmark), n AS (SELECT count(*) AS n FROM benchmark),
    s AS (SELECT doc_id, text, list_filter({sentences_sql('text')}, lambda x: list_has_any({tokens_sql('x')}, t)) AS hit FROM documents, n JOIN q ON item_id = doc_id % n)
    SELECT doc_id, trim(left(coalesce(hit[1], text), 220)) AS quote FROM s""",
)
def short_quotes(spark, sf_dir):
    """Each document quoted for one of the passages, dealt out in turn."""
    b = table(spark, sf_dir, "benchmark")
    n = b.agg(F.count(F.lit(1)).alias("n"))  # one row
    d = table(spark, sf_dir, "documents").join(F.broadcast(n)).withColumn("item_id", F.col("doc_id") % F.col("n"))
    return d.join(b.select("item_id", T.tokenize("text").alias("t")), "item_id").select("doc_id", T.short_quote(F.col("text"), F.col("t")).alias("quote"))
