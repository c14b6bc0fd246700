"""Question analysis, routing, budgets, evidence graphs and table arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skarn.functions.text import four_digits, has_any, let, number_text, text_of
from skarn.operators.ranks import by_key
from skarn.session import written

# Cue patterns and budgets that decide routes and levels.
CODE = r"\b(algorithm|pseudo-?code|code snippet|implementation|forward pass|pytorch|tensor|complexity|function|pseudocode|algorithm \d+|routine|subroutine)\b"
VISUAL = (
    r"\b(figure|fig\.?|plot|chart|graph|diagram|heatmap|curve|bar chart|scatterplot|depicted|illustrated|shown in figure|loss curve|attention distribution|"
    r"attention map|architecture diagram|pipeline structure)\b"
)
TABLE = (
    r"\b(table|tbl\.?|row|column|accuracy|bleu|rouge|meteor|f1|f1-score|perplexity|error rate|percentage|flops|gflops|tflops|latency|throughput|parameters|"
    r"param count|speedup|learning rate|warmup|dropout|d_model|d_ff|hidden size|batch size|increase by|decrease by|outperform|tabular|leaderboard|benchmark results|ablation)\b"
)
COMPARISON = r"\b(compare|comparison|versus|vs\.?|difference between|better than|tradeoff|relative to)\b"
CALCULATION = r"\b(how much|how many|what percentage|ratio|difference|sum|average|mean|gain of)\b"
LOOKUP = r"\b(what learning rate|which optimizer|batch size|how many epochs|what dataset|who are the authors|github url|code available)\b"
EXPLAIN_WORDS = ["how does", "explain", "why", "architecture", "mechanism", "workflow"]
OVERALL_WORDS = ["overall", "throughout the paper", "from start to finish", "across sections"]
#: route: text_top_k, visual_items, max_rounds, needs_decomposition, use_numeric_executor, requires_native_vision
BUDGETS = {
    "DIRECT_LOOKUP": (4, 1, 1, False, False, False),
    "EXPLANATION": (5, 2, 1, False, False, False),
    "COMPARISON": (6, 2, 2, True, False, False),
    "MULTI_SECTION": (6, 2, 2, True, False, False),
    "TABLE_NUMERIC": (4, 2, 1, False, True, True),
    "FIGURE_VISUAL": (3, 4, 2, False, False, True),
    "CHART_NUMERIC": (3, 4, 2, False, True, True),
    "MIXED_TEXT_VISUAL": (4, 3, 2, True, False, True),
    "CODE_ALGORITHM": (6, 1, 1, False, False, False),
    "POTENTIALLY_UNANSWERABLE": (6, 1, 1, False, False, False),
}
LEVEL_ARITHMETIC = [
    r"\b(percentage|percent|%|difference|ratio|margin|increase|decrease|drop|gain|how much (better|faster|higher|lower)|speedup)\b",
    r"\b(compare (accuracy|bleu|f1|score|loss|latency)|outperform by)\b",
]
LEVEL_VISUAL = [
    r"\b(figure|fig\.?|plot|chart|curve|loss curve|diagram|attention map|heatmap|visual|schematic|architecture diagram)\b",
    r"\b(shown in figure|illustrated in|visualize|attention distribution|convergence curve|pipeline structure|tradeoff)\b",
]
LEVEL_TABLE = [
    r"\b(table|tab\.?|row|column|benchmark results|leaderboard|ablation table|score in table)\b",
    r"\b(bleu|rouge|meteor|f1|f1-score|perplexity|error rate|accuracy|flops|gflops|tflops|latency|throughput|parameters|param count)\b",
    r"\b(learning rate|warmup|warmup steps|weight decay|dropout|attention dropout|d_model|d_ff|d_k|d_v|hidden size|batch size)\b",
    r"\b(wmt|glue|superglue|squad|imagenet|cifar|coco|mmlu|gsm8k|ptb|penn treebank)\b",
]
LEVEL_COMPARATIVE = [
    r"\b(why\s+(?:does|do|is|are)|how\s+(?:does|do|is|are)|compare|comparing|comparison|contrast|trade-?off|advantages? over|difference between|versus|vs\.?)\b",
    r"\b(outperform|ablation|support the (?:claim|hypothesis|main claim)|connect .+ with|based on)\b",
]
CROSS_SECTION_WORDS = ["method", "experiment", "result", "ablation", "limitation", "conclusion"]
SECOND_QUESTION = r"(?i)\s*,\s*(?:and|while|whereas)\s+(?:what|how|why|does|which|where)\s+"
QUESTION_HEAD = r"(?i)^(?:how does|what is|why does|how do|what are)\s+"
COMPARED = r"(?i)(?:compare|comparison between|difference between|tradeoff between|versus|vs\.?)\s+([^,]+?)\s+(?:and|with|versus|vs\.?)\s+([^,?.!]+)(?:\?|\.|$)"
COMPARED_HEAD = r"(?i)^(?:the|what is|how does|what are)\s+"
COMPARED_TO = r"(?i)(?:how does|how do)\s+(.+?)\s+compare\s+(?:to|with)\s+(.+?)(?:\s+in terms of\s+([^,?.!]+))?(?:,\s*(?:and|while|whereas|\?|\.|$)|$)"
SAME_KIND = r"(?i)\b([a-zA-Z_]+)\s+(\d+|[A-Z])\s+(?:and|vs\.?|with)\s+(?:\1\s+)?(\d+|[A-Z])\b"
#: tier: least RAM in GB, context tokens, evidence blocks, tables, visual crops
TIERS = {"8GB": (0, 2048, 4, 1, 1), "16GB": (12, 4096, 6, 2, 2), "32GB+": (24, 8192, 10, 4, 4)}
ROLE_ORDER = {"method_definition": 1, "ablation_support": 2, "final_result": 3, "primary_evidence": 4}
ROLE_WEIGHT = {"method_definition": 10.0, "ablation_support": 9.0, "final_result": 8.0, "primary_evidence": 5.0}


def route(question: Column | str) -> Column:
    """The first rule that fits decides."""
    q = F.lower(F.trim(text_of(question)))
    visual, calc, comp = q.rlike(VISUAL), q.rlike(CALCULATION), q.rlike(COMPARISON)
    return (
        F.when(q.rlike(CODE), "CODE_ALGORITHM")
        .when(q.rlike(LOOKUP), "DIRECT_LOOKUP")
        .when(visual & calc, "CHART_NUMERIC")
        .when(visual & (comp | q.contains("and")), "MIXED_TEXT_VISUAL")
        .when(visual, "FIGURE_VISUAL")
        .when(q.rlike(TABLE) | (calc & q.contains("table")), "TABLE_NUMERIC")
        .when(comp, "COMPARISON")
        .when(has_any(q, EXPLAIN_WORDS), "EXPLANATION")
        .when(has_any(q, OVERALL_WORDS), "MULTI_SECTION")
        .otherwise("EXPLANATION")
    )


def route_budgets(rows: DataFrame, question: str, can_vision: Column) -> DataFrame:
    """Rows with route and its budget; without vision, images go and two more texts come."""
    names = ["route", "text_top_k", "visual_items", "max_rounds", "needs_decomposition", "use_numeric_executor", "requires_native_vision"]
    budgets = rows.sparkSession.createDataFrame([(k, *v) for k, v in BUDGETS.items()], names)  # ten rows
    joined = rows.withColumn("route", route(question)).join(F.broadcast(budgets), "route")
    fallback = F.col("requires_native_vision") & ~can_vision
    return joined.withColumns({
        "capability_fallback": fallback,
        "text_top_k": F.col("text_top_k") + F.when(fallback, 2).otherwise(0),
        "visual_items": F.when(fallback, F.lit(0)).otherwise(F.col("visual_items")),
    })


def _any(q: Column, patterns: list[str]) -> Column:
    return q.rlike("|".join(f"(?:{p})" for p in patterns))


def levels(question: Column | str) -> Column:
    """struct<level, modalities, requires_arithmetic, requires_visual>."""
    q = F.lower(F.trim(text_of(question)))
    arithmetic, visual, comparative = _any(q, LEVEL_ARITHMETIC), _any(q, LEVEL_VISUAL), _any(q, LEVEL_COMPARATIVE)
    tab = _any(q, LEVEL_TABLE) | arithmetic
    level = (
        F.when(q.rlike(LOOKUP), "L1")
        .when(comparative & (tab | visual | q.contains("why")), "L5")
        .when(tab | visual, "L4")
        .when(has_any(q, CROSS_SECTION_WORDS) & comparative, "L3")
        .when(has_any(q, ["why", "how", "explain", "reason"]), "L2")
        .otherwise("L1")
    )
    modalities = F.when(tab & visual, "MULTIMODAL,TABLE,FIGURE").when(tab, "TEXT,TABLE").when(visual, "TEXT,FIGURE").otherwise("TEXT")
    return F.struct(level.alias("level"), modalities.alias("modalities"), arithmetic.alias("requires_arithmetic"), visual.alias("requires_visual"))


def decompose(question: Column | str) -> Column:
    """Array of subqueries; the first pattern that fits decides, the whole question when none does."""
    q = F.trim(text_of(question))
    low = F.lower(q)
    all_of = lambda c, p, g=0: F.regexp_extract_all(c, F.lit(p), F.lit(g))

    def numbered(kind, words):
        direct = all_of(low, rf"\b(?:{words})\s*(\d+)\b", 1)
        span = all_of(F.regexp_extract(low, rf"\b(?:{words})\s+([0-9\s,andvswith\&\.\-]+)", 1), r"\b\d+\b")
        name = lambda a: F.transform(F.slice(a, 1, 4), lambda n: F.concat(F.lit(kind + " "), n))
        return F.when(F.size(direct) >= 2, name(direct)).when(F.size(span) >= 2, name(span))

    pieces = F.split(q, SECOND_QUESTION)
    clean = F.transform(F.slice(pieces, 1, 3), lambda p: F.regexp_replace(F.regexp_replace(F.trim(p), QUESTION_HEAD, ""), r"[?. ]+$", ""))
    parts = F.filter(clean, lambda p: F.length(p) > 10)
    pair = COMPARED
    side = lambda g: F.trim(F.regexp_replace(F.trim(F.regexp_extract(q, pair, g)), COMPARED_HEAD, ""))
    to = COMPARED_TO
    suffix = F.trim(F.regexp_extract(q, to, 3))
    named = lambda g: F.trim(F.concat_ws(" ", F.trim(F.regexp_extract(q, to, g)), F.when(suffix != "", suffix)))
    same = SAME_KIND
    item = lambda g: F.concat_ws(" ", F.regexp_extract(q, same, 1), F.regexp_extract(q, same, g))
    return F.coalesce(
        numbered("Figure", r"figures?|figs?\.?"),
        numbered("Table", r"tables?|tbls?\.?"),
        F.when((F.size(pieces) >= 2) & (F.size(parts) >= 2), parts),
        F.when((F.length(side(1)) > 1) & (F.length(side(2)) > 1), F.array(side(1), side(2))),
        F.when(q.rlike(to), F.array(named(1), named(2))),
        F.when(q.rlike(same), F.array(item(2), item(3))),
        F.array(q),
    )


def hardware_tier(ram_gb: Column) -> Column:
    """The tier by memory."""
    return F.when(ram_gb < 12, "8GB").when(ram_gb < 24, "16GB").otherwise("32GB+")


def tier_budgets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v[1:]) for k, v in TIERS.items()], "tier string, max_context_tokens int, max_blocks int, max_tables int, max_visuals int")


def _by(values: dict, column: str, other) -> Column:
    out = F.lit(other)
    for k, v in values.items():
        out = F.when(F.col(column) == k, F.lit(v)).otherwise(out)
    return out


def prune_to_budget(nodes: DataFrame, max_blocks: int, max_tables: int, max_visuals: int) -> DataFrame:
    """Nodes (q_id, node_id, pos, modality, role, score) kept by role weight and score under quotas a modality.

    A graph within all quotas stays as it is, in the order of pos; else step follows weight. Quotas are independent, so
    ranks a modality and then overall give what a greedy walk gives.
    """
    w = Window.partitionBy("q_id")
    visual, tab = F.col("modality").isin("visual", "figure", "image"), F.col("modality") == "table"
    kind = F.when(tab, "table").when(visual, "visual").otherwise("text")
    order = [F.col("__p").desc(), F.col("pos"), F.col("node_id")]
    n = nodes.withColumn("__k", kind).withColumn("__p", _by(ROLE_WEIGHT, "role", 1.0) + F.col("score"))
    n = n.withColumns({"__n": F.count(F.lit(1)).over(w), "__t": F.count_if(tab).over(w), "__v": F.count_if(visual).over(w)})
    n = n.withColumn("__fits", (F.col("__n") <= max_blocks) & (F.col("__t") <= max_tables) & (F.col("__v") <= max_visuals))
    n = n.withColumn("__r", F.row_number().over(Window.partitionBy("q_id", "__k").orderBy(*order)))
    quota = F.when(F.col("__k") == "table", max_tables).when(F.col("__k") == "visual", max_visuals).otherwise(2**31 - 1)
    some = n.filter(F.col("__fits") | (F.col("__r") <= quota))
    order = [F.when(F.col("__fits"), 0.0).otherwise(F.col("__p")).desc(), F.col("pos"), F.col("node_id")]
    some = some.withColumn("step", F.row_number().over(Window.partitionBy("q_id").orderBy(*order)))
    return some.filter(F.col("__fits") | (F.col("step") <= max_blocks)).select(*nodes.columns, "step")


def evidence_edges(nodes: DataFrame) -> DataFrame:
    """Nodes (q_id, node_id, role, modality, page, pos): edges from each node to later ones, first rule wins.

    Pairs form inside a query only, whose nodes a budget bounds.
    """
    ranked = nodes.withColumn("i", F.row_number().over(Window.partitionBy("q_id").orderBy(_by(ROLE_ORDER, "role", 5), "page", "pos", "node_id")))
    a = ranked.select("q_id", *[F.col(c).alias(f"s_{c}") for c in ("node_id", "role", "modality", "page", "i")])
    b = ranked.select("q_id", *[F.col(c).alias(f"t_{c}") for c in ("node_id", "role", "modality", "page", "i")])
    relation = (
        F.when((F.col("s_role") == "method_definition") & (F.col("t_role") == "ablation_support"), "ABLATION_EVIDENCE")
        .when((F.col("s_role") == "ablation_support") & (F.col("t_role") == "final_result"), "EXPLAINS_RESULT")
        .when((F.col("s_modality") == "text") & F.col("t_modality").isin("table", "visual"), "CROSS_MODAL_GROUNDING")
        .when(F.abs(F.col("s_page") - F.col("t_page")) <= 1, "SECTION_SEQUENCE")
    )
    pairs = a.join(b, "q_id").filter("s_i < t_i").withColumn("relation", relation).filter("relation IS NOT NULL")
    return pairs.select("q_id", F.col("s_node_id").alias("source_id"), F.col("t_node_id").alias("target_id"), "relation")


def reasoning_labels(nodes: DataFrame, requires_arithmetic: Column) -> DataFrame:
    """Nodes in order with step, mode; the mode follows from role, modality and place."""
    w = Window.partitionBy("q_id")
    n = nodes.withColumns({"step": F.row_number().over(w.orderBy(_by(ROLE_ORDER, "role", 5), "page", "pos", "node_id")), "steps": F.count(F.lit(1)).over(w)})
    first, last, tab = F.col("step") == 1, F.col("step") == F.col("steps"), F.col("modality") == "table"
    method = F.when(F.col("modality") == "visual", "RECALL").when(first, "PROBLEM_UNDERSTANDING").otherwise("RECALL")
    result = F.when(last, "SYNTHESIS").when(tab & requires_arithmetic, "CALCULATION").otherwise("DERIVATION")
    other = (
        F.when(tab & requires_arithmetic, "CALCULATION")
        .when(F.col("modality").isin("visual", "figure"), "VERIFICATION")
        .when(first & (F.col("steps") > 1), "PROBLEM_UNDERSTANDING")
        .when(last & (F.col("steps") > 2), "SYNTHESIS")
        .otherwise("DERIVATION")
    )
    mode = F.when(F.col("role") == "method_definition", method).when(F.col("role") == "ablation_support", "CASE_ANALYSIS").when(F.col("role") == "final_result", result).otherwise(other)
    return n.withColumn("mode", mode)


#: Rows of a plan, of nodes and edges, up to which it is looked at whole.
SMALL_PLAN = 128


def plan_faults(edges: DataFrame, nodes: DataFrame, small: int = SMALL_PLAN) -> DataFrame:
    """(plan_id, fault) of plans with repeated ids, unknown dependencies or cycles.

    edges (plan_id, node_id, depends_on). Nodes whose dependencies are all settled are removed round by round; what is
    left when nothing can be removed lies on or behind a cycle. A plan of at most `small` rows is an array, whose rounds
    are made where it lies; the larger ones are joined, and what a round leaves is written before the next.
    """
    e, n = (edges.select("plan_id", "node_id", "depends_on", F.lit(True).alias("__edge")), nodes.select("plan_id", "node_id", F.lit(None).alias("depends_on"), F.lit(False).alias("__edge")))
    rows = e.unionByName(n)
    large = written(rows.groupBy("plan_id").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > small), "large-plans")
    n_large = large.count()
    if not n_large:
        return _faults_of_small(rows)
    sized = by_key(rows, large, ["plan_id"], n_large)
    some = written(sized.filter("__n IS NOT NULL"), "large-plan-rows")
    few = _faults_of_small(sized.filter("__n IS NULL"))
    return few.unionByName(_faults_of_large(some.filter("__edge").drop("__edge", "__n"), some.filter("NOT __edge").select("plan_id", "node_id")))


def _faults_of_small(rows: DataFrame) -> DataFrame:
    node, edge = F.struct("node_id"), F.struct("node_id", "depends_on")
    plans = rows.groupBy("plan_id").agg(F.collect_list(F.when(~F.col("__edge"), node)).alias("nodes"), F.collect_set(F.when(F.col("__edge"), edge)).alias("edges"))  # of at most SMALL_PLAN rows
    ids = lambda xs: F.array_distinct(F.transform(xs, lambda x: x["node_id"]))
    some_plan = F.col("plan_id").isNotNull()  # rows without a plan know no dependency of one another
    inside = lambda e, known: F.coalesce(F.array_contains(known, e["depends_on"]), F.lit(False)) & some_plan
    unknown = let(ids(F.col("nodes")), lambda known: F.exists("edges", lambda e: ~inside(e, known)))
    # a round that removes nothing is followed by none that does
    left = F.aggregate("edges", F.col("edges"), lambda acc, _: F.when(F.size(acc) == 0, acc).otherwise(let(ids(acc), lambda known: F.filter(acc, lambda e: inside(e, known)))))
    faults = F.array(
        F.when(F.size("nodes") > F.size(ids(F.col("nodes"))), "repeated id"),
        F.when(unknown, "unknown dependency"),
        F.when(F.size(left) > 0, "cycle"),
    )
    return plans.select("plan_id", F.explode(F.array_compact(faults)).alias("fault"))


def _faults_of_large(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    repeated = nodes.groupBy("plan_id", "node_id").count().filter("count > 1").select("plan_id", F.lit("repeated id").alias("fault")).distinct()
    known = nodes.select("plan_id", F.col("node_id").alias("depends_on")).distinct()
    unknown = edges.join(known, ["plan_id", "depends_on"], "left_anti").select("plan_id", F.lit("unknown dependency").alias("fault")).distinct()
    left = written(edges.distinct(), "open-edges")
    count = left.count()
    while count:
        open_nodes = left.select("plan_id", F.col("node_id").alias("depends_on")).distinct()
        left = written(left.join(open_nodes, ["plan_id", "depends_on"], "left_semi"), "open-edges")
        now = left.count()
        if now == count:
            break
        count = now
    return repeated.unionByName(unknown).unionByName(left.select("plan_id", F.lit("cycle").alias("fault")).distinct())


def sufficiency(query_tokens: Column, top_tokens: Column) -> Column:
    """E5: struct<is_sufficient, score, reason_code> of a query against the tokens of its top three chunks."""
    n, both = F.size(query_tokens), F.size(F.array_intersect(query_tokens, top_tokens))
    overlap = both / F.greatest(n, F.lit(1))
    fails = (overlap < 0.15) & (n >= 3)
    score = F.when(n == 0, 0.8).when(fails, overlap).otherwise(F.greatest(F.lit(0.5), overlap))
    return F.struct((~fails | (n == 0)).alias("is_sufficient"), F.round(score, 3).alias("score"), F.when(fails & (n > 0), "INSUFFICIENT_TEXT_EVIDENCE").alias("reason_code"))


def numeric_plan(operation: Column, cells: Column) -> Column:
    """struct<value, exact, formatted> of an operation over an array of table cells.

    Cells are decimals of 26 and 12 digits, so sums and differences are exact; a number beyond them is taken as a double's
    decimal. formatted holds the reason where there is no result.
    """
    decimal = lambda c: let(number_text(c), lambda x: F.coalesce(x.try_cast("decimal(38,12)"), x.try_cast("double").try_cast("decimal(38,12)")))
    real = lambda c: c.cast("double")
    two, divides = operation.isin("difference", "percent_change", "ratio"), operation.isin("percent_change", "ratio")

    def result(v):
        n, a, b = F.size(v), F.get(v, F.lit(0)), F.get(v, F.lit(1))
        total = F.aggregate(v, F.lit("0").cast("decimal(38,12)"), lambda s, x: (s + x).cast("decimal(38,12)"))
        value = (
            F.when(n == 0, 0.0)
            .when(operation == "difference", F.when(n >= 2, real(a - b)).otherwise(real(a)))
            .when(operation == "percent_change", F.when((n >= 2) & (b != 0), F.try_divide(real(a - b), real(F.abs(b))) * 100).otherwise(0.0))
            .when(operation == "ratio", F.when((n >= 2) & (b != 0), F.try_divide(real(a), real(b))).otherwise(0.0))
            .when(operation == "sum", real(total))
            .when(operation == "mean", F.try_divide(real(total), n))
            .when(operation == "min", real(F.array_min(v)))
            .when(operation == "max", real(F.array_max(v)))
            .otherwise(0.0)
        )
        exact = (n > 0) & F.when(two, (n >= 2) & (~divides | (b != 0))).otherwise(operation.isin("sum", "mean", "min", "max"))
        fault = F.when(n == 0, "N/A").when(two & (n < 2), "Error: Arity < 2").when(divides & (b == 0), "Undefined (division by zero)").when(~exact, "Unsupported")
        return F.struct(value.alias("value"), exact.alias("exact"), fault.alias("fault"))

    def told(r):
        x = r["value"]
        shown = F.when(operation == "percent_change", F.format_string("%.3f%%", x)).when(operation == "ratio", F.format_string("%.3fx", x)).otherwise(four_digits(x))
        sign = F.when((x > 0) & operation.isin("difference", "percent_change"), "+").otherwise("")
        return F.struct(x.alias("value"), r["exact"].alias("exact"), F.coalesce(r["fault"], F.concat(sign, shown)).alias("formatted"))

    return let(let(F.filter(F.transform(cells, decimal), lambda x: x.isNotNull()), result), told)


def table_arithmetic(markdown: Column, first: Column, second: Column, operation: Column, metric: Column) -> Column:
    """numeric_plan() over the numbers of two entities of a markdown table; null unless both are found.

    An entity's rows are those that name it anywhere, letter case aside. Its number is that of the column whose head
    contains `metric`, else the first number after the first cell; the first such row that has one counts.
    """
    lines = F.filter(F.transform(F.split(markdown, "\n"), lambda x: F.trim(x)), lambda x: x.contains("|"))  # the first holds the heads
    parts = lambda x: F.filter(F.transform(F.split(x, r"\|"), lambda c: F.trim(c)), lambda c: c != "")

    def numbers(lines):
        at = F.array_position(F.transform(parts(F.get(lines, F.lit(0))), lambda h: F.lower(h).contains(F.lower(metric))), F.lit(True))
        at = F.when((metric != "") & (at > 0), at.cast("int") - 1)
        body = F.filter(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: ~F.trim(F.replace(x, F.lit("|"), F.lit(""))).rlike("^[-:]*$"))

        def of_row(cells):
            rest = F.filter(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))), lambda c: number_text(c) != "")
            return F.coalesce(F.get(F.filter(F.array(F.get(cells, at)), lambda c: number_text(c) != ""), F.lit(0)), F.get(rest, F.lit(0)))

        def number(entity):
            named = F.filter(body, lambda x: F.lower(x).contains(F.lower(entity)))
            return F.get(F.filter(F.transform(named, lambda x: let(parts(x), of_row)), lambda c: c.isNotNull()), F.lit(0))

        return F.filter(F.array(number(first), number(second)), lambda c: c.isNotNull())

    return let(let(lines, numbers), lambda v: F.when(F.size(v) == 2, numeric_plan(operation, v)))
