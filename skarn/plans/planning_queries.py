"""Registered planning and verification queries over whole tables, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skarn.functions.text import DISCLAIMERS, NUMBER, STRUCTURAL_NUMBER, tokenize
from skarn.operators import planning as P
from skarn.operators import verify as V
from skarn.plans.base import QUESTIONS_SQL, questions, quoted, sql_list, tokens_sql
from skarn.plans.retrieval_queries import _BM25_TOP_SQL, bm25_topk
from skarn.session import table

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


_M = lambda p: f"regexp_matches(q, {quoted(p)})"
_ANY = lambda ps: "(" + " OR ".join(_M(p) for p in ps) + ")"
_HAS = lambda ws: "(" + " OR ".join(f"contains(q, {quoted(w)})" for w in ws) + ")"
_Q = f"q AS (SELECT q_id, lower(trim(question)) AS q FROM {QUESTIONS_SQL})"
_ROUTE = f"""CASE WHEN {_M(P.CODE)} THEN 'CODE_ALGORITHM' WHEN {_M(P.LOOKUP)} THEN 'DIRECT_LOOKUP' WHEN {_M(P.VISUAL)} AND {_M(P.CALCULATION)} THEN 'CHART_NUMERIC'
    WHEN {_M(P.VISUAL)} AND ({_M(P.COMPARISON)} OR contains(q, 'and')) THEN 'MIXED_TEXT_VISUAL' WHEN {_M(P.VISUAL)} THEN 'FIGURE_VISUAL'
    WHEN {_M(P.TABLE)} OR ({_M(P.CALCULATION)} AND contains(q, 'table')) THEN 'TABLE_NUMERIC' WHEN {_M(P.COMPARISON)} THEN 'COMPARISON' WHEN {_HAS(P.EXPLAIN_WORDS)} THEN 'EXPLANATION'
    WHEN {_HAS(P.OVERALL_WORDS)} THEN 'MULTI_SECTION' ELSE 'EXPLANATION' END"""


@query("route_distribution", f"WITH {_Q} SELECT {_ROUTE} AS route, count(*) AS n FROM q GROUP BY 1")
def route_distribution(spark, sf_dir):
    return questions(spark, sf_dir).groupBy(P.route("question").alias("route")).agg(F.count(F.lit(1)).alias("n"))


_BUDGET_ROWS = ", ".join(f"({quoted(k)}, {v[0]}, {v[1]}, {v[2]}, {v[5]})" for k, v in P.BUDGETS.items())


@query(
    "route_budgets",
    f"""WITH {_Q}, r AS (SELECT q_id, {_ROUTE} AS route, q_id % 2 = 0 AS vision FROM q), b(route, text_top_k, visual_items, max_rounds, needs) AS (VALUES {_BUDGET_ROWS})
    SELECT q_id, route, text_top_k + CASE WHEN needs AND NOT vision THEN 2 ELSE 0 END AS text_top_k, CASE WHEN needs AND NOT vision THEN 0 ELSE visual_items END AS visual_items, max_rounds, needs AND NOT vision AS capability_fallback FROM r JOIN b USING (route)""",
)
def route_budgets(spark, sf_dir):
    rows = P.route_budgets(questions(spark, sf_dir), "question", F.col("q_id") % 2 == 0)
    return rows.select("q_id", "route", "text_top_k", "visual_items", "max_rounds", "capability_fallback")


@query(
    "reasoning_levels",
    f"""WITH {_Q}, f AS (SELECT q_id, q, {_ANY(P.LEVEL_ARITHMETIC)} AS ar, {_ANY(P.LEVEL_VISUAL)} AS vi, {_ANY(P.LEVEL_COMPARATIVE)} AS co, {_ANY(P.LEVEL_TABLE)} OR {_ANY(P.LEVEL_ARITHMETIC)} AS ta FROM q)
    SELECT q_id, CASE WHEN {_M(P.LOOKUP)} THEN 'L1' WHEN co AND (ta OR vi OR contains(q, 'why')) THEN 'L5' WHEN ta OR vi THEN 'L4' WHEN {_HAS(P.CROSS_SECTION_WORDS)} AND co THEN 'L3'
        WHEN {_HAS(['why', 'how', 'explain', 'reason'])} THEN 'L2' ELSE 'L1' END AS level,
        CASE WHEN ta AND vi THEN 'MULTIMODAL,TABLE,FIGURE' WHEN ta THEN 'TEXT,TABLE' WHEN vi THEN 'TEXT,FIGURE' ELSE 'TEXT' END AS modalities, ar AS requires_arithmetic, vi AS requires_visual FROM f""",
)
def reasoning_levels(spark, sf_dir):
    return questions(spark, sf_dir).select("q_id", P.levels("question").alias("a")).select("q_id", "a.*")


@query("question_decomposition")
def question_decomposition(spark, sf_dir):
    return questions(spark, sf_dir).select("q_id", F.array_join(P.decompose("question"), " | ").alias("subqueries"))


@query(
    "hardware_budgets",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 40 < 12 THEN '8GB' WHEN s_suppkey % 40 < 24 THEN '16GB' ELSE '32GB+' END AS tier,
    CASE WHEN s_suppkey % 40 < 12 THEN 4 WHEN s_suppkey % 40 < 24 THEN 6 ELSE 10 END AS max_blocks, CASE WHEN s_suppkey % 40 < 12 THEN 2048 WHEN s_suppkey % 40 < 24 THEN 4096 ELSE 8192 END AS max_context_tokens FROM supplier""",
)
def hardware_budgets(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").withColumn("tier", P.hardware_tier(F.col("s_suppkey") % 40))
    return rows.join(F.broadcast(P.tier_budgets(spark)), "tier").select("s_suppkey", "tier", "max_blocks", "max_context_tokens")


_ROLES = ["method_definition", "ablation_support", "final_result", "primary_evidence"]
_MODS = ["text", "table", "visual", "text", "text"]


def _nodes(spark, sf_dir):
    """An evidence graph a query: its order is the query, its lines the nodes."""
    li = table(spark, sf_dir, "lineitem")
    pick = lambda values, c: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(c) % len(values) + 1).cast("int"))
    return li.select(
        F.col("l_orderkey").alias("q_id"),
        F.concat(F.lit("E"), F.col("l_linenumber").cast("string"), F.lit("_"), F.col("l_partkey").cast("string")).alias("node_id"),
        F.col("l_linenumber").alias("pos"),
        pick(_MODS, "l_partkey").alias("modality"),
        pick(_ROLES, "l_suppkey").alias("role"),
        (F.col("l_suppkey") % 6).alias("page"),
        (F.col("l_quantity") / 50).alias("score"),
    )


_NODES = f"""n AS (SELECT l_orderkey AS q_id, 'E' || l_linenumber || '_' || l_partkey AS node_id, l_linenumber AS pos, {sql_list(_MODS)}[l_partkey % {len(_MODS)} + 1] AS modality,
    {sql_list(_ROLES)}[l_suppkey % {len(_ROLES)} + 1] AS role, l_suppkey % 6 AS page, l_quantity / 50 AS score FROM lineitem)"""
_ORDER = "CASE role WHEN 'method_definition' THEN 1 WHEN 'ablation_support' THEN 2 WHEN 'final_result' THEN 3 ELSE 4 END, page, pos, node_id"


@query(
    "budget_pruning",
    f"""WITH {_NODES}, p AS (SELECT *, CASE WHEN modality IN ('table', 'visual') THEN modality ELSE 'text' END AS k, CASE role WHEN 'method_definition' THEN 10 WHEN 'ablation_support' THEN 9 WHEN 'final_result' THEN 8 ELSE 5 END + score AS w FROM n),
    f AS (SELECT *, count(*) OVER g <= 4 AND count(*) FILTER (k = 'table') OVER g <= 1 AND count(*) FILTER (k = 'visual') OVER g <= 1 AS fits, row_number() OVER (PARTITION BY q_id, k ORDER BY w DESC, pos, node_id) AS r FROM p WINDOW g AS (PARTITION BY q_id)),
    s AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY CASE WHEN fits THEN 0 ELSE w END DESC, pos, node_id) AS step FROM f WHERE fits OR k = 'text' OR r <= 1)
    SELECT q_id, node_id, step FROM s WHERE fits OR step <= 4""",
)
def budget_pruning(spark, sf_dir):
    return P.prune_to_budget(_nodes(spark, sf_dir), 4, 1, 1).select("q_id", "node_id", F.col("step").cast("long").alias("step"))


@query(
    "evidence_edges",
    f"""WITH {_NODES}, r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY {_ORDER}) AS i FROM n),
    e AS (SELECT a.q_id, a.node_id AS source_id, b.node_id AS target_id, CASE WHEN a.role = 'method_definition' AND b.role = 'ablation_support' THEN 'ABLATION_EVIDENCE' WHEN a.role = 'ablation_support' AND b.role = 'final_result' THEN 'EXPLAINS_RESULT'
        WHEN a.modality = 'text' AND b.modality IN ('table', 'visual') THEN 'CROSS_MODAL_GROUNDING' WHEN abs(a.page - b.page) <= 1 THEN 'SECTION_SEQUENCE' END AS relation FROM r a JOIN r b ON a.q_id = b.q_id AND a.i < b.i)
    SELECT * FROM e WHERE relation IS NOT NULL""",
)
def evidence_edges(spark, sf_dir):
    return P.evidence_edges(_nodes(spark, sf_dir))


@query(
    "reasoning_labels",
    f"""WITH {_NODES}, r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY {_ORDER}) AS step, count(*) OVER (PARTITION BY q_id) AS steps, q_id % 2 = 0 AS ar FROM n)
    SELECT q_id, node_id, step, CASE role WHEN 'method_definition' THEN CASE WHEN modality = 'visual' THEN 'RECALL' WHEN step = 1 THEN 'PROBLEM_UNDERSTANDING' ELSE 'RECALL' END WHEN 'ablation_support' THEN 'CASE_ANALYSIS'
        WHEN 'final_result' THEN CASE WHEN step = steps THEN 'SYNTHESIS' WHEN modality = 'table' AND ar THEN 'CALCULATION' ELSE 'DERIVATION' END
        ELSE CASE WHEN modality = 'table' AND ar THEN 'CALCULATION' WHEN modality = 'visual' THEN 'VERIFICATION' WHEN step = 1 AND steps > 1 THEN 'PROBLEM_UNDERSTANDING' WHEN step = steps AND steps > 2 THEN 'SYNTHESIS' ELSE 'DERIVATION' END END AS mode FROM r""",
)
def reasoning_labels(spark, sf_dir):
    return P.reasoning_labels(_nodes(spark, sf_dir), F.col("q_id") % 2 == 0).select("q_id", "node_id", F.col("step").cast("long").alias("step"), "mode")


@query(
    "plan_faults",
    """WITH RECURSIVE e AS (SELECT l_orderkey AS plan_id, CAST(l_linenumber AS VARCHAR) AS a, CAST(l_suppkey % 9 AS VARCHAR) AS b FROM lineitem), n AS (SELECT l_orderkey AS plan_id, CAST(l_linenumber AS VARCHAR) AS a FROM lineitem),
    r AS (SELECT plan_id, a AS start, b FROM e UNION SELECT r.plan_id, r.start, e.b FROM r JOIN e ON e.plan_id = r.plan_id AND e.a = r.b)
    SELECT plan_id, 'repeated id' AS fault FROM n GROUP BY plan_id, a HAVING count(*) > 1 UNION SELECT plan_id, 'unknown dependency' FROM e WHERE (plan_id, b) NOT IN (SELECT plan_id, a FROM n) UNION SELECT DISTINCT plan_id, 'cycle' FROM r WHERE start = b""",
)
def plan_faults(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    nodes = li.select(F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").cast("string").alias("node_id"))
    edges = li.select(F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").cast("string").alias("node_id"), (F.col("l_suppkey") % 9).cast("string").alias("depends_on"))
    return P.plan_faults(edges, nodes)


@query(
    "sufficiency_gate",
    f"""WITH {_BM25_TOP_SQL}, t AS (SELECT q_id, list_distinct(flatten(list({tokens_sql('text')}))) AS top FROM top JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY q_id),
    q AS (SELECT item_id AS q_id, list_distinct({tokens_sql('text')}) AS qt FROM benchmark), o AS (SELECT q_id, len(qt) AS n, len(list_intersect(qt, top)) / greatest(len(qt), 1) AS o FROM q JOIN t USING (q_id))
    SELECT q_id, NOT (o < 0.15 AND n >= 3) OR n = 0 AS is_sufficient, round(CASE WHEN n = 0 THEN 0.8 WHEN o < 0.15 AND n >= 3 THEN o ELSE greatest(0.5, o) END, 3) AS score FROM o""",
)
def sufficiency_gate(spark, sf_dir):
    top = bm25_topk(spark, sf_dir).filter("rank <= 3").join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    tokens = top.select("q_id", F.explode(F.array_distinct(tokenize("text"))).alias("t")).groupBy("q_id").agg(F.collect_set("t").alias("top"))
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q_id"), F.array_distinct(tokenize("text")).alias("qt"))
    return q.join(tokens, "q_id").select("q_id", P.sufficiency(F.col("qt"), F.col("top")).alias("s")).select("q_id", "s.is_sufficient", "s.score")


_OPS = ["difference", "percent_change", "ratio", "sum", "mean", "min", "max"]


@query(
    "numeric_plans",
    f"""WITH c AS (SELECT l_orderkey, l_linenumber, {sql_list(_OPS)}[l_linenumber % 7 + 1] AS op, l_quantity AS a, round(l_extendedprice, 2) AS b, CAST(l_suppkey % 3 AS DOUBLE) AS z FROM lineitem),
    r AS (SELECT *, CASE op WHEN 'difference' THEN a - z WHEN 'percent_change' THEN coalesce((a - z) / abs(nullif(z, 0)) * 100, 0) WHEN 'ratio' THEN coalesce(a / nullif(z, 0), 0) WHEN 'sum' THEN a + z + b WHEN 'mean' THEN (a + z + b) / 3 WHEN 'min' THEN least(a, z, b) ELSE greatest(a, z, b) END AS v FROM c)
    SELECT l_orderkey, l_linenumber, op, round(v, 6) AS value, op NOT IN ('percent_change', 'ratio') OR z <> 0 AS exact,
        CASE WHEN op IN ('percent_change', 'ratio') AND z = 0 THEN 'Undefined (division by zero)' WHEN op = 'ratio' THEN printf('%.3fx', v) WHEN op IN ('percent_change', 'difference') AND v > 0 THEN '+' ELSE '' END
        || CASE WHEN op = 'percent_change' AND z <> 0 THEN printf('%.3f%%', v) WHEN op = 'difference' THEN printf('%.4g', v) ELSE '' END AS formatted FROM r""",
)
def numeric_plans(spark, sf_dir):
    op = F.element_at(F.array(*[F.lit(o) for o in _OPS]), (F.col("l_linenumber") % 7 + 1).cast("int"))
    cell = lambda c: F.format_string("%s%%", F.col(c).cast("string"))
    rows = table(spark, sf_dir, "lineitem").withColumn("b", F.round("l_extendedprice", 2)).withColumn("z", (F.col("l_suppkey") % 3).cast("double"))
    money = F.concat(F.lit("$"), F.format_number("b", 2), F.lit(" (±1)"))
    planned = rows.select("l_orderkey", "l_linenumber", op.alias("op"), F.array(cell("l_quantity"), cell("z"), money).alias("cells"))
    told = F.when(F.col("op").isin("difference", "percent_change", "ratio"), F.col("r.formatted")).otherwise("")
    done = planned.select("l_orderkey", "l_linenumber", "op", P.numeric_plan(F.col("op"), F.col("cells")).alias("r"))
    return done.select("l_orderkey", "l_linenumber", "op", F.round("r.value", 6).alias("value"), "r.exact", told.alias("formatted"))


@query(
    "table_arithmetic",
    """WITH n AS (SELECT n_nationkey, n_regionkey AS r, n_nationkey * 2 + 0.5 AS s, CASE n_nationkey % 3 WHEN 0 THEN 'percent_change' WHEN 1 THEN 'difference' ELSE 'ratio' END AS op FROM nation)
    SELECT n_nationkey, CAST(round(CASE op WHEN 'percent_change' THEN (s - 4) / 4 * 100 WHEN 'difference' THEN s - 4 ELSE s / 4 END, 6) AS DOUBLE) AS by_score, CAST(round(CASE op WHEN 'percent_change' THEN (r - 7) / 7.0 * 100 WHEN 'difference' THEN r - 7 ELSE r / 7.0 END, 6) AS DOUBLE) AS by_first, true AS missing FROM n""",
)
def table_arithmetic(spark, sf_dir):
    """Every nation against a baseline row: by the column of a metric, by the first number, and with an entity that isn't there."""
    n = F.col
    score = F.concat((n("n_nationkey") * 2).cast("string"), F.lit(".5%"))
    rows = F.concat(F.lit("| the "), n("n_name"), F.lit(" row | "), n("n_regionkey").cast("string"), F.lit("* | "), score, F.lit(" |\n|Base LINE| n/a | - |\n| base line | $7 (a) | 4.0 ± 0.2 [b] |\n"))
    md = F.concat(F.lit("A caption without a bar\n| Name | Region | Score (%) |\n|---|:--|---|\n"), rows)
    op = F.when(n("n_nationkey") % 3 == 0, "percent_change").when(n("n_nationkey") % 3 == 1, "difference").otherwise("ratio")
    t = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", md.alias("md"), op.alias("op"))
    of = lambda entity, metric: P.table_arithmetic(n("md"), n("n_name"), F.lit(entity), n("op"), F.lit(metric))
    return t.select("n_nationkey", F.round(of("base line", "score")["value"], 6).alias("by_score"), F.round(of("base line", "")["value"], 6).alias("by_first"), of("nowhere", "score").isNull().alias("missing"))


_TURNS = "t AS (SELECT conv_id, turn, trim(regexp_replace(text, {c}, '', 'g')) AS c, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS raw, trim(regexp_replace(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), {c}, '', 'g')) AS e FROM conversations QUALIFY raw IS NOT NULL)".format(c=quoted("(?i)" + V.CITATION))
#: Words of a-z and apostrophes between borders of Unicode words, which RE2 has no border for.
_W = lambda c: rf"list_distinct(list_filter(regexp_extract_all(lower({c}), '[\p{{L}}\p{{M}}\p{{N}}_]+(?:''+[\p{{L}}\p{{M}}\p{{N}}_]+)*'), lambda w: regexp_full_match(w, '[a-z'']+')))"
_MINUS = lambda a, ws: f"list_filter({a}, lambda x: NOT list_contains({sql_list(ws)}, x))"
_STEM = lambda a: f"list_distinct(list_transform(list_filter({a}, lambda x: length(x) >= 4), lambda x: left(x, 4)))"
_SHARE = lambda a, b: f"(len(list_intersect({a}, {b})) / greatest(len({a}), 1))"


def _support_sql(src: str, to: str) -> str:
    """CTEs that add label and confidence to the rows of src, which have a claim c and evidence e, both without citations."""
    return f"""{to}_w AS (SELECT *, list_distinct({tokens_sql('c')}) AS ct, list_distinct({tokens_sql('e')}) AS et, {_W('c')} AS cw, {_W('e')} AS ew,
        list_distinct(regexp_extract_all(regexp_replace(c, {quoted(STRUCTURAL_NUMBER)}, '', 'g'), {quoted(NUMBER)})) AS cn, list_distinct(regexp_extract_all(e, {quoted(NUMBER)})) AS en FROM {src}),
    {to}_x AS (SELECT *, {_MINUS('cw', V.NEGATIONS)} AS cc, {_MINUS('ew', V.NEGATIONS)} AS ec, {_SHARE('ct', 'et')} AS o FROM {to}_w),
    {to}_y AS (SELECT *, {_MINUS('cc', V.SUPPORT_STOP)} AS cs, {_MINUS('ec', V.SUPPORT_STOP)} AS es FROM {to}_x),
    {to}_z AS (SELECT *, greatest(o, CASE WHEN len(cs) > 0 THEN {_SHARE('cs', 'es')} ELSE o END, CASE WHEN len({_STEM('cs')}) > 0 THEN {_SHARE(_STEM('cs'), _STEM('es'))} ELSE 0 END) AS b FROM {to}_y),
    {to}_l AS (SELECT *, CASE WHEN trim(e) = '' THEN 'UNSUPPORTED' WHEN len(ct) = 0 THEN 'SUPPORTED'
        WHEN (len(cc) < len(cw)) <> (len(ec) < len(ew)) AND CASE WHEN len(cc) > 0 THEN {_SHARE('cc', 'ec')} ELSE 0 END >= 0.45 THEN 'CONTRADICTED'
        WHEN len(list_filter(cn, lambda v: NOT list_contains(en, v))) > 0 AND o >= 0.35 THEN 'CONTRADICTED' WHEN b >= 0.5 THEN 'SUPPORTED' WHEN b >= 0.25 THEN 'PARTIAL' ELSE 'UNSUPPORTED' END AS label FROM {to}_z),
    {to} AS (SELECT *, CASE WHEN trim(e) = '' THEN 0.0 WHEN len(ct) = 0 THEN 1.0 WHEN label = 'CONTRADICTED' THEN 0.95 ELSE b END AS confidence FROM {to}_l)"""


@query("lexical_support", f"WITH {_TURNS}, {_support_sql('t', 's')} SELECT conv_id, turn, label FROM s")
def lexical_support(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lag("text").over(w).alias("before")).filter("before IS NOT NULL")
    return rows.select("conv_id", "turn", V.support(F.col("text"), F.col("before"))["label"].alias("label"))


_KEYS = ["conv_id", "turn"]


def _answers(spark, sf_dir):
    """(answers, evidence): every assistant turn with a marker before each final mark; all turns of its conversation, of
    which every fourth is known by its pixels alone."""
    c = table(spark, sf_dir, "conversations")
    marker = F.concat(F.lit(" [E"), (F.col("turn") % 4).cast("string"), F.lit("]$1$2"))
    answers = c.filter("role = 'assistant'").select(*_KEYS, F.regexp_replace(F.col("text"), F.lit(r"([.!?])(\s|$)"), marker).alias("answer"))
    origin = F.when(F.col("turn") % 4 == 3, V.PIXELS).otherwise(V.TEXT)
    return answers, c.select("conv_id", F.concat(F.lit("E"), F.col("turn").cast("string")).alias("ref"), F.col("turn").alias("ord"), "text", origin.alias("origin"))


def _labelled(spark, sf_dir):
    answers, evidence = _answers(spark, sf_dir)
    return V.labelled(V.parse_claims(answers, _KEYS, "answer"), evidence, _KEYS, "conv_id"), answers, evidence


#: Markers of the answers, and of answers whose citations were remapped.
_CITED = r"(?i)\[E\d+\]"
_RECITED = r"(?i)\[E?\d+\]"


def _claims_sql(answers: str, n: str = "", keys: str = "conv_id, turn", cited: str = _CITED) -> str:
    """CTEs of the claims of rows (keys, answer) of `answers`, ending in ct{n}: lines are cut after marks before white space;
    these texts have no fences, headings, tables and abbreviations. ev{n}: claim c and evidence e; cites: the turn cited."""
    return rf"""li{n} AS (SELECT {keys}, unnest(string_split(answer, chr(10))) AS line, generate_subscripts(string_split(answer, chr(10)), 1) AS i FROM {answers}),
    lo{n} AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY {keys} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base, regexp_extract_all(line, '(?:.*?[.!?](?:\s|$))|.+$') AS xs FROM li{n}),
    se{n} AS (SELECT {keys}, i, base, unnest(xs) AS raw, generate_subscripts(xs, 1) AS j FROM lo{n}),
    so{n} AS (SELECT *, base + coalesce(sum(length(raw)) OVER (PARTITION BY {keys}, i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(raw) - length(regexp_replace(raw, '^\s+', '')) AS start, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS t FROM se{n}),
    cl{n} AS (SELECT {keys}, 'C' || row_number() OVER (PARTITION BY {keys} ORDER BY i, j) AS claim_id, CAST(start AS BIGINT) AS start, CAST(start + length(t) AS BIGINT) AS "end", t, regexp_extract_all(t, {quoted(cited)}) AS marks FROM so{n} WHERE t NOT IN ('', '-', '*')),
    ct{n} AS (SELECT *, CASE WHEN regexp_matches(lower(regexp_replace(t, {quoted(cited)}, '', 'g')), {quoted('|'.join(DISCLAIMERS))}) THEN 'disclaimer' ELSE 'factual' END AS claim_type,
        CASE WHEN len(marks) > 0 THEN CAST(regexp_extract(marks[1], '\d+') AS BIGINT) END AS cited FROM cl{n}),
    ev{n} AS (SELECT ct{n}.*, trim(regexp_replace(t, {quoted(cited)}, '', 'g')) AS c, CASE WHEN v.turn % 4 <> 3 THEN coalesce(trim(v.text), '') ELSE '' END AS e, v.turn IS NOT NULL AS cites, coalesce(v.turn % 4 = 3, FALSE) AS pixels
        FROM ct{n} LEFT JOIN conversations v ON v.conv_id = ct{n}.conv_id AND v.turn = ct{n}.cited)"""


def _labelled_sql(n: str = "") -> str:
    """CTE la{n}: the claims of ev{n} with label and confidence."""
    return f"""{_support_sql(f'ev{n}', f'lb{n}')}, la{n} AS (SELECT * REPLACE (CASE WHEN claim_type <> 'factual' THEN 'SUPPORTED' WHEN pixels THEN 'UNVERIFIED_VISUAL' ELSE label END AS label,
        CASE WHEN claim_type <> 'factual' THEN 1.0 WHEN pixels THEN 0.0 ELSE confidence END AS confidence) FROM lb{n})"""


_ANSWERS = r"a AS (SELECT conv_id, turn, regexp_replace(text, '([.!?])(\s|$)', ' [E' || (turn % 4) || ']\1\2', 'g') AS answer FROM conversations WHERE role = 'assistant')"
_CLAIMS = f"{_ANSWERS}, {_claims_sql('a')}"
_LABELLED = f"{_CLAIMS}, {_labelled_sql()}"


@query("claim_parser", f"""WITH {_CLAIMS} SELECT conv_id, turn, claim_id, start, "end", claim_type, array_to_string(list_transform(marks, lambda m: upper(m[2:-2])), ',') AS "references" FROM ct""")
def claim_parser(spark, sf_dir):
    claims = V.parse_claims(_answers(spark, sf_dir)[0], _KEYS, "answer")
    return claims.select(*_KEYS, "claim_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "claim_type", F.array_join("references", ",").alias("references"))


@query(
    "verification_report",
    f"""WITH {_LABELLED}, n AS (SELECT conv_id, turn, count(*) AS total_claims, count(*) FILTER (claim_type = 'factual') AS factual_claims, {', '.join(f"count(*) FILTER (claim_type = 'factual' AND label = '{x}') AS {x.lower()}_count" for x in ('SUPPORTED', 'PARTIAL', 'UNSUPPORTED', 'CONTRADICTED', 'UNVERIFIED_VISUAL'))},
        count(*) FILTER (label = 'UNVERIFIED_VISUAL') AS visual, count(*) FILTER (label = 'SUPPORTED') AS supported_claims FROM la GROUP BY 1, 2),
    g AS (SELECT conv_id, turn, count(DISTINCT cites) FILTER (cites) / 2 AS share FROM la GROUP BY 1, 2),
    r AS (SELECT a.conv_id, a.turn, coalesce(total_claims, 0) AS total_claims, coalesce(factual_claims, 0) AS factual_claims, coalesce(supported_count, 0) AS supported_count, coalesce(partial_count, 0) AS partial_count, coalesce(unsupported_count, 0) AS unsupported_count, coalesce(contradicted_count, 0) AS contradicted_count, coalesce(unverified_visual_count, 0) AS unverified_visual_count, coalesce(visual / nullif(total_claims, 0), 0) AS u,
        coalesce(supported_claims, 0) AS supported_claims, coalesce(supported_claims / nullif(total_claims, 0), 1) AS p, CASE WHEN coalesce(total_claims, 0) = 0 THEN 1 ELSE share END AS q FROM a LEFT JOIN n USING (conv_id, turn) LEFT JOIN g USING (conv_id, turn))
    SELECT * EXCLUDE (p, q, u), round(p, 6) AS citation_precision, round(q, 6) AS citation_recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 6) AS citation_f1, round(1 - p - u, 6) AS unsupported_claim_rate, round(u, 6) AS unverified_visual_claim_rate,
        partial_count + unsupported_count + contradicted_count + unverified_visual_count = 0 AS overall_supported, factual_claims > 0 AND supported_count + unverified_visual_count = 0 AS abstains FROM r""",
)
def verification_report(spark, sf_dir):
    """Gold citations of an answer: the turn that its markers name, and one that doesn't exist."""
    labelled, answers, _ = _labelled(spark, sf_dir)
    gold = answers.select(*_KEYS, F.explode(F.array(F.concat(F.lit("E"), (F.col("turn") % 4).cast("string")), F.lit("E999"))).alias("ref"))
    r = V.verification_report(answers, labelled, _KEYS, gold)
    return r.withColumns({c: F.round(c, 6) for c in ("citation_precision", "citation_recall", "citation_f1", "unsupported_claim_rate", "unverified_visual_claim_rate")})


@query(
    "citation_remap",
    f"""WITH {_LABELLED}, pa AS (SELECT u.conv_id, u.turn, claim_id, t, c, v.turn AS ord, trim(v.text) AS e FROM (SELECT conv_id, turn, claim_id, t, c, CASE WHEN cites THEN cited END AS cited FROM la WHERE label = 'UNSUPPORTED' AND claim_type = 'factual') u JOIN conversations v ON v.conv_id = u.conv_id AND v.turn % 4 <> 3 AND v.turn IS DISTINCT FROM u.cited), {_support_sql('pa', 'ps')}
    SELECT conv_id, turn, claim_id, 'E' || ord AS new_ref, label, round(confidence, 6) AS confidence,
        CASE WHEN regexp_matches(t, {quoted(_CITED)}) THEN regexp_replace(t, {quoted(_CITED)}, '[' || ord || ']') ELSE t || ' [' || ord || ']' END AS remapped
    FROM ps WHERE label IN ('SUPPORTED', 'PARTIAL') QUALIFY row_number() OVER (PARTITION BY conv_id, turn, claim_id ORDER BY confidence DESC, ord) = 1""",
)
def citation_remap(spark, sf_dir):
    labelled, _, evidence = _labelled(spark, sf_dir)
    return V.remap(labelled, evidence, _KEYS, "conv_id").withColumn("confidence", F.round("confidence", 6)).drop("new_number")


@query(
    "claim_narrowing",
    rf"""WITH {_LABELLED}, pb AS (SELECT conv_id, turn, claim_id, e, marks, regexp_extract(bare, '[.!?]$') AS final, regexp_replace(bare, '[.!?]$', '') AS body FROM (SELECT *, regexp_replace(t, {quoted(_CITED)}, '', 'g') AS bare FROM la WHERE label = 'PARTIAL' AND claim_type = 'factual' AND cites)),
    pc AS (SELECT *, unnest(xs) AS x, generate_subscripts(xs, 1) AS p FROM (SELECT *, string_split_regex(body, {quoted(V.CLAUSE)}) AS xs FROM pb)),
    pd AS (SELECT conv_id, turn, claim_id, e, p, rtrim(x, ' ,;') || ' ' || array_to_string(marks, '') || final AS piece, rtrim(x, ' ,;') || final AS c FROM pc WHERE trim(x, ' ,;') <> '' AND trim(rtrim(x, ' ,;')) <> trim(body)), {_support_sql('pd', 'pe')}
    SELECT conv_id, turn, claim_id, piece FROM pe WHERE label IN ('SUPPORTED', 'PARTIAL') QUALIFY row_number() OVER (PARTITION BY conv_id, turn, claim_id ORDER BY length(piece) DESC, p) = 1""",
)
def claim_narrowing(spark, sf_dir):
    return V.narrow(_labelled(spark, sf_dir)[0], _KEYS)


_REMAPPED = f"""pa AS (SELECT u.conv_id, u.turn, claim_id, t, c, v.turn AS ord, trim(v.text) AS e FROM la u JOIN conversations v ON v.conv_id = u.conv_id AND v.turn % 4 <> 3 AND NOT (u.cites AND v.turn = u.cited) WHERE label = 'UNSUPPORTED' AND claim_type = 'factual'), {_support_sql('pa', 'ps')},
    mv AS (SELECT conv_id, turn, claim_id, ord AS new_number, CASE WHEN regexp_matches(t, {quoted(_CITED)}) THEN regexp_replace(t, {quoted(_CITED)}, '[' || ord || ']') ELSE t || ' [' || ord || ']' END AS remapped
        FROM ps WHERE label IN ('SUPPORTED', 'PARTIAL') QUALIFY row_number() OVER (PARTITION BY conv_id, turn, claim_id ORDER BY confidence DESC, ord) = 1)"""
_NARROWED = rf"""pb AS (SELECT conv_id, turn, claim_id, e, marks, regexp_extract(bare, '[.!?]$') AS final, regexp_replace(bare, '[.!?]$', '') AS body FROM (SELECT *, regexp_replace(t, {quoted(_CITED)}, '', 'g') AS bare FROM la WHERE label = 'PARTIAL' AND claim_type = 'factual' AND cites)),
    pc AS (SELECT *, unnest(xs) AS x, generate_subscripts(xs, 1) AS p FROM (SELECT *, string_split_regex(body, {quoted(V.CLAUSE)}) AS xs FROM pb)),
    pd AS (SELECT conv_id, turn, claim_id, e, p, rtrim(x, ' ,;') || ' ' || array_to_string(marks, '') || final AS piece, rtrim(x, ' ,;') || final AS c FROM pc WHERE trim(x, ' ,;') <> '' AND trim(rtrim(x, ' ,;')) <> trim(body)), {_support_sql('pd', 'pe')},
    nw AS (SELECT conv_id, turn, claim_id, piece FROM pe WHERE label IN ('SUPPORTED', 'PARTIAL') QUALIFY row_number() OVER (PARTITION BY conv_id, turn, claim_id ORDER BY length(piece) DESC, p) = 1)"""
_MODES = ["NONE", "CITATION_REMAP_ONLY", "SELECTIVE"]
#: Every answer in each mode with its edits: ed has a row a claim, n its edits; fi a row an answer.
_EDITED = rf"""{_REMAPPED}, {_NARROWED}, md AS (SELECT unnest({sql_list(_MODES)}) AS mode),
    ed AS (SELECT mode, la.*, new_number, CASE
            WHEN mode = 'NONE' THEN t
            WHEN claim_type <> 'factual' THEN CASE WHEN mode = 'SELECTIVE' THEN regexp_replace(t, '(?i)\s?\[E\d+\]', '', 'g') ELSE t END
            WHEN label = 'PARTIAL' AND mode = 'SELECTIVE' THEN coalesce(piece, t)
            WHEN label = 'UNSUPPORTED' THEN coalesce(remapped, CASE WHEN mode = 'SELECTIVE' THEN '' ELSE t END)
            WHEN label = 'CONTRADICTED' AND mode = 'SELECTIVE' THEN '' ELSE t END AS new,
            lag("end", 1, 0) OVER (PARTITION BY mode, conv_id, turn ORDER BY start) AS before
        FROM la CROSS JOIN md LEFT JOIN mv USING (conv_id, turn, claim_id) LEFT JOIN nw USING (conv_id, turn, claim_id)),
    jo AS (SELECT mode, a.conv_id, a.turn, any_value(answer) AS answer, string_agg(substr(answer, before + 1, start - before) || new, '' ORDER BY start) || substr(any_value(answer), max("end") + 1) AS text,
            sum(CASE WHEN claim_type <> 'factual' AND mode = 'SELECTIVE' THEN len(marks) WHEN new <> t THEN 1 ELSE 0 END) AS n, count(*) FILTER (claim_type = 'factual') AS had, arg_min(label, start) AS first_status
        FROM a JOIN ed USING (conv_id, turn) GROUP BY 1, 2, 3),
    fi AS (SELECT mode, conv_id, turn, a.answer, coalesce(n, 0) AS n, coalesce(had, 0) AS had, first_status, CASE WHEN text IS NULL OR text = a.answer THEN a.answer ELSE trim(regexp_replace(regexp_replace(text, '(?m)^\s*[-*+]\s*$\n?', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), chr(10) || chr(9) || ' ') END AS final
        FROM a CROSS JOIN md LEFT JOIN jo USING (mode, conv_id, turn)),
    fa AS (SELECT mode, conv_id, turn, final AS answer FROM fi), {_claims_sql('fa', '2', 'mode, conv_id, turn', _RECITED)}, {_labelled_sql('2')},
    hs AS (SELECT mode, conv_id, turn, count(*) FILTER (claim_type = 'factual' AND label IN ('SUPPORTED', 'PARTIAL')) AS has, count(*) FILTER (claim_type = 'factual' AND label = 'UNVERIFIED_VISUAL') AS unseen FROM la2 GROUP BY ALL),
    up AS (SELECT fi.*, coalesce(has, 0) AS has, mode <> 'NONE' AND had > 0 AND coalesce(has, 0) + coalesce(unseen, 0) = 0 AS abstained FROM fi LEFT JOIN hs USING (mode, conv_id, turn))"""


def _repair(spark, sf_dir):
    answers, evidence = _answers(spark, sf_dir)
    modes = F.explode(F.array(*[F.lit(m) for m in _MODES]))
    return V.Repair(answers.withColumn("mode", modes), evidence, _KEYS, "conv_id")


@query(
    "repair_policy",
    f"""WITH {_LABELLED}, {_EDITED} SELECT conv_id, turn, mode, CASE WHEN abstained THEN {quoted(V.ABSTENTION)} ELSE final END AS final_answer, CAST(CASE WHEN abstained THEN 1 ELSE n END AS BIGINT) AS n_edits, abstained,
        mode <> 'NONE' AND has > 0 AS reverified FROM up""",
)
def repair_policy(spark, sf_dir):
    """Every answer in each of the three modes."""
    return _repair(spark, sf_dir).outcomes()


@query(
    "repair_records",
    rf"""WITH {_LABELLED}, {_EDITED}, own AS (SELECT e.* FROM ed e JOIN up u USING (mode, conv_id, turn) WHERE NOT u.abstained)
    SELECT conv_id, turn, mode, claim_id, CASE WHEN label = 'PARTIAL' THEN 'CLAIM_NARROWING' WHEN new = '' THEN 'CLAIM_DELETION' ELSE 'CITATION_REMAP' END AS action, start, "end", t AS original_text, new AS replacement_text, label AS initial_status,
        CASE WHEN new <> '' THEN 'SUPPORTED' END AS second_pass_status, label = 'UNSUPPORTED' AS remap_attempted FROM own WHERE claim_type = 'factual' AND new <> t
    UNION ALL SELECT conv_id, turn, mode, claim_id, 'CITATION_REMAP', start + instr(t, m) - 1, start + instr(t, m) - 1 + length(m), m, '', 'SUPPORTED', 'SUPPORTED', FALSE
        FROM (SELECT *, unnest(regexp_extract_all(t, '(?i)\s?\[E\d+\]')) AS m FROM own WHERE claim_type <> 'factual' AND mode = 'SELECTIVE')
    UNION ALL SELECT conv_id, turn, mode, 'ABSTAIN', 'ABSTAIN', 0, length(answer), answer, {quoted(V.ABSTENTION)}, coalesce(first_status, 'UNSUPPORTED'), NULL,
        EXISTS (SELECT 1 FROM ed e WHERE e.mode = up.mode AND e.conv_id = up.conv_id AND e.turn = up.turn AND claim_type = 'factual' AND label = 'UNSUPPORTED' AND new <> t) FROM up WHERE abstained""",
)
def repair_records(spark, sf_dir):
    """the record of every edit, in code points of the original answer."""
    e = _repair(spark, sf_dir).edits().drop("original_refs", "resolved_refs")
    return e.withColumns({c: F.col(c).cast("long") for c in ("start", "end")})


@query(
    "final_citations",
    f"""WITH {_LABELLED}, {_EDITED}, fin AS (SELECT l.* FROM la2 l JOIN up u USING (mode, conv_id, turn) WHERE mode <> 'NONE' AND NOT u.abstained),
    nums AS (SELECT mode, conv_id, turn, label, confidence, unnest(list_distinct(list_transform(list_filter(marks, lambda m: regexp_matches(m, '^\\[\\d')), lambda m: CAST(m[2:-2] AS INTEGER)))) AS ref_id FROM fin),
    moved AS (SELECT DISTINCT mode, conv_id, turn, CAST(new_number AS INTEGER) AS ref_id FROM ed WHERE mode <> 'NONE' AND label = 'UNSUPPORTED' AND claim_type = 'factual' AND new_number IS NOT NULL)
    SELECT n.conv_id, n.turn, n.mode, n.ref_id, 'E' || n.ref_id AS ref, CASE WHEN bool_and(label = 'SUPPORTED') THEN 'SUPPORTED' WHEN bool_and(label = 'UNVERIFIED_VISUAL') THEN 'UNVERIFIED_VISUAL' ELSE 'UNSUPPORTED' END AS verification,
        round(min(confidence), 6) AS confidence, CASE WHEN bool_or(m.ref_id IS NOT NULL) THEN 'REMAPPED' END AS repair_origin
    FROM nums n JOIN conversations v ON v.conv_id = n.conv_id AND v.turn = n.ref_id LEFT JOIN moved m ON m.mode = n.mode AND m.conv_id = n.conv_id AND m.turn = n.turn AND m.ref_id = n.ref_id GROUP BY 1, 2, 3, 4""",
)
def final_citations(spark, sf_dir):
    """what the repaired answers cite by number, with the label of their second pass."""
    return _repair(spark, sf_dir).citations().withColumn("confidence", F.round("confidence", 6))


@query("text_edits", "SELECT doc_id, md5(left(text, 2) || '<a>' || substr(text, 5, 3) || '<b>' || substr(text, 10)) AS edited FROM documents WHERE length(text) >= 10")
def text_edits(spark, sf_dir):
    edit = lambda a, b, new: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(new).alias("new"))
    d = table(spark, sf_dir, "documents").filter(F.length("text") >= 10)
    return d.select("doc_id", F.md5(V.apply_edits(F.col("text"), F.array(edit(2, 4, "<a>"), edit(7, 9, "<b>"))).cast("binary")).alias("edited"))
