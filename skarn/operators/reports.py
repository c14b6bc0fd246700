"""Scores of answers, annotations and releases: grouped plans with named denominators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.functions import text as T
from skarn.operators import metrics as M
from skarn.operators.matching import phrase_hits
from skarn.session import written
from skarn.sources.tables import canonical_json


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def f1_of(p: Column, r: Column) -> Column:
    """The harmonic mean; 0 when both are 0, null when one is null."""
    return F.when(p.isNotNull() & r.isNotNull(), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))


def citation_scores(citations: DataFrame, cases: DataFrame, hits: DataFrame) -> DataFrame:
    """(case_id, n, precision, page_accuracy): citations (case_id, source, id, page) on gold pages of the right source,
    and of (id, page) pairs that were retrieved. Only answerable cases with a citation count."""
    gold = cases.filter("answerable").select("case_id", F.col("paper_id").alias("source"), F.explode("gold_pages").alias("page")).distinct().withColumn("good", F.lit(1))
    seen = hits.select("case_id", "id", "page").distinct().withColumn("met", F.lit(1))
    rows = citations.join(cases.filter("answerable").select("case_id"), "case_id", "left_semi")
    rows = rows.join(gold, ["case_id", "source", "page"], "left").join(seen, ["case_id", "id", "page"], "left")
    return rows.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("good", F.lit(0))).alias("precision"), F.avg(F.coalesce("met", F.lit(0))).alias("page_accuracy"))


def unique_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows as they are; the job that reads them fails when a key occurs twice."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*key))
    said = F.concat(F.lit("repeated key: "), F.to_json(F.struct(*key)))
    return rows.withColumn("__n", n).filter(F.when(F.col("__n") > 1, F.raise_error(said).cast("boolean")).otherwise(True)).drop("__n")


def abstention_rates(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows (*by, abstained, answered_with_citation): n, the rates of abstentions and of answers to three digits, and
    the number of answers that cite."""
    g = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if("abstained").alias("k"), F.count_if("answered_with_citation").alias("fabricated_with_citation"))
    rate = lambda c: F.round(c / F.col("n"), 3)
    return g.select(*by, "n", rate(F.col("k")).alias("abstention_rate"), rate(F.col("n") - F.col("k")).alias("fabrication_rate"), "fabricated_with_citation")


def parser_means(runs: DataFrame) -> DataFrame:
    """Runs (config_id, ms_per_page, tables, sections, blocks, error) -> means to two digits of each configuration
    over runs without an error; configurations without such a run are left out."""
    mean = lambda c, name: F.round(F.avg(c), 2).alias(name)
    good = runs.filter("error IS NULL")
    return good.groupBy("config_id").agg(mean("ms_per_page", "mean_ms_per_page"), mean("tables", "mean_tables_extracted"), mean("sections", "mean_sections_extracted"), mean("blocks", "mean_evidence_blocks"))


def scored_rows(rows: DataFrame, specs: DataFrame) -> DataFrame:
    """Rows (key columns, status, answerable, metric values map) times specs (metric, on_error, on_abstain,
    needs_answerable): one row a key and metric. Errors and abstentions take the spec's value, null keeps them out, and a
    spec may ask for answerable or unanswerable cases only. specs is a short table of the caller's. A repeated key fails."""
    both = unique_keys(rows, M.KEY).join(F.broadcast(specs))
    value = F.when(F.col("status") == "ERROR", F.col("on_error")).when(F.col("status") == "ABSTAINED", F.col("on_abstain")).otherwise(F.try_element_at(F.col("values"), F.col("metric")))
    eligible = F.col("needs_answerable").isNull() | (F.col("needs_answerable") == F.col("answerable"))
    return both.select(*M.KEY, "status", "metric", F.when(eligible, value).alias("value"), F.lit(None).cast("long").alias("weight"))


def binary_labels(labels: DataFrame, by: list[str], least: int = 2) -> DataFrame:
    """Labels (*by, annotator, round, value) -> (*by, value, reason): unanimous initial labels of enough annotators,
    else exactly one adjudication."""
    first = F.col("round") == "INITIAL"
    g = labels.groupBy(*by).agg(
        F.countDistinct(F.when(first, F.col("annotator"))).alias("n"),
        F.min(F.when(first, F.col("value"))).alias("lo"),
        F.max(F.when(first, F.col("value"))).alias("hi"),
        F.count_if(F.col("round") == "ADJUDICATION").alias("k"),
        F.max(F.when(F.col("round") == "ADJUDICATION", F.col("value"))).alias("a"),
    )
    value = F.when(F.col("n") < least, F.lit(None)).when(F.col("lo") == F.col("hi"), F.col("lo").cast("double")).when(F.col("k") == 1, F.col("a").cast("double"))
    reason = F.when(F.col("n") < least, "too few annotators").when(value.isNull(), "disagreement without one adjudication")
    return g.select(*by, value.alias("value"), reason.alias("reason"))


def paired_gate(scores: DataFrame, control: str, treatment: str, least_gain: float, most_loss: float, draws: int = 2000, seed: int = 2027) -> DataFrame:
    """Scores (system, pair, support, coverage) -> one row with decision PASS, FAIL or BLOCKED, deltas and interval.

    BLOCKED when a pair lacks a system or a score."""
    p = scores.filter(F.col("system").isin(control, treatment)).groupBy("pair").pivot("system", [control, treatment]).agg(F.max("support").alias("s"), F.max("coverage").alias("c"))
    d = p.select("pair", (F.col(f"{treatment}_s") - F.col(f"{control}_s")).alias("ds"), (F.col(f"{treatment}_c") - F.col(f"{control}_c")).alias("dc"))
    total = d.agg(F.count(F.lit(1)).alias("pairs"), F.count(F.col("ds") + F.col("dc")).alias("n"), F.avg("ds").alias("support_delta"), F.avg("dc").alias("coverage_delta")).withColumn("g", F.lit(0))
    one = d.withColumns({"g": F.lit(0), "zero": F.lit(0.0)})
    ci = M.paired_delta(one, "g", "pair", "ds", "zero", draws, seed).select("g", "lo", "hi")
    both = total.join(ci, "g", "left")
    whole = (F.col("n") == F.col("pairs")) & (F.col("n") > 0)
    passed = (F.col("support_delta") >= least_gain) & (F.col("lo") > 0) & (F.col("coverage_delta") >= -most_loss)
    return both.select(F.when(~whole, "BLOCKED").when(passed, "PASS").otherwise("FAIL").alias("decision"), "n", "support_delta", "coverage_delta", "lo", "hi")


def likert(rows: DataFrame, by: str, dims: list[str]) -> DataFrame:
    """Means, population deviations and counts of rating columns by model."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n_answers"), *[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("mean", F.avg), ("stdev", F.stddev_pop), ("n", F.count))])


def citation_grades(rows: DataFrame, by: str) -> DataFrame:
    """Counts (supported, partial, unsupported, missing) -> strict and lenient precision, recall and F1 by group."""
    g = rows.groupBy(by).agg(*[F.sum(c).alias(c) for c in ("supported", "partial", "unsupported", "missing")])
    n = F.col("supported") + F.col("partial") + F.col("unsupported")
    strict, lenient = ratio(F.col("supported"), n), ratio(F.col("supported") + 0.5 * F.col("partial"), n)
    recall = ratio(F.col("supported") + F.col("partial"), F.col("supported") + F.col("partial") + F.col("missing"))
    return g.select("*", strict.alias("precision_strict"), lenient.alias("precision_lenient"), recall.alias("recall"), f1_of(strict, recall).alias("f1"))


def first_places(rows: DataFrame, by: str, rank: str) -> DataFrame:
    """G26."""
    return rows.groupBy(by).agg(F.count_if(F.col(rank) == 1).alias("first_place"), F.avg(rank).alias("mean_rank"), F.count(rank).alias("n_ranked"))


def multihop_scores(rows: DataFrame, key: str) -> DataFrame:
    """Rows (key, prediction, golds array, gold_sources array, sources array, answerable, abstained) -> one row of exact
    match, F1, evidence path recall over supervised rows and abstention accuracy."""
    each = rows.filter("answerable").select(key, "prediction", F.posexplode("golds").alias("g", "reference"))
    pairs = each.withColumn("pair", F.concat_ws("#", F.col(key).cast("string"), F.col("g").cast("string")))
    best = M.token_f1(pairs.select("pair", "prediction", "reference"), "pair", True).join(pairs.select("pair", key), "pair").groupBy(key).agg(F.max("exact").alias("em"), F.max("f1").alias("f1"))
    wanted, got = F.array_distinct(F.filter("gold_sources", lambda s: s != "")), F.array_distinct("sources")
    path = F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, got)) / F.size(wanted))
    ok = F.col("abstained") | F.lower("prediction").contains("insufficient") | (F.trim("prediction") == "")
    r = rows.join(best, key, "left")
    n = F.greatest(F.count_if("answerable"), F.lit(1))
    asked = F.col("answerable") & (F.size("golds") > 0)
    return r.agg(
        (F.coalesce(F.sum("em"), F.lit(0)) / n).alias("exact_match"),
        (F.coalesce(F.sum("f1"), F.lit(0.0)) / n).alias("f1"),
        F.coalesce(F.avg(F.when(asked, path)), F.lit(0.0)).alias("evidence_path_recall"),
        F.coalesce(F.avg(F.when(~F.col("answerable"), ok.cast("int"))), F.lit(1.0)).alias("abstention_accuracy"),
    )


def visual_scores(rows: DataFrame, by: str) -> DataFrame:
    """Rows (by, prediction, reference, first_rank): containment accuracy, exact match, hit rates and MRR."""
    p, r = T.squad_normalized("prediction"), T.squad_normalized("reference")
    hit = lambda k: F.avg(F.coalesce((F.col("first_rank") <= k).cast("int"), F.lit(0))).alias(f"hit_{k}")
    return rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(((r != "") & p.contains(r)).cast("int")).alias("accuracy"), F.avg((p == r).cast("int")).alias("exact_match"), hit(1), hit(3), hit(5), F.avg(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))).alias("mrr")
    )


def key_term_coverage(rows: DataFrame, key: str) -> DataFrame:
    """0.4 token F1 + 0.4 unit recall + 0.2 share of the reference's numbers, between 0 and 1."""
    f1 = M.token_f1(rows, key, False).select(key, F.col("f1").alias("tf1"))
    units = M.unit_overlap(rows, key).select(key, F.col("recall").alias("ur"))
    numbers = lambda c: F.regexp_extract_all(T.text_of(c), F.lit(r"\b\d+(?:\.\d+)?\b"), F.lit(0))
    pn = numbers("prediction")
    met = F.size(F.filter(numbers("reference"), lambda n: F.array_contains(pn, n)))
    share = F.when(F.size(numbers("reference")) > 0, met / F.size(numbers("reference"))).otherwise(1.0)
    score = 0.4 * F.col("tf1") + 0.4 * F.col("ur") + 0.2 * F.col("ns")
    return rows.select(key, share.alias("ns")).join(f1, key).join(units, key).select(key, F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("coverage"))


def entailment_label(score: Column, high: float = 0.60, low: float = 0.30) -> Column:
    """The label of a lexical score."""
    return F.when(score >= high, "ENTAILMENT").when(score >= low, "NEUTRAL").otherwise("CONTRADICTION")


def lexical_entailment(claim: Column, premise: Column) -> Column:
    """The share of the claim's distinct tokens that the premise has; 1 without tokens."""
    h, p = F.array_distinct(T.tokenize_nli(claim)), F.array_distinct(T.tokenize_nli(premise))
    return F.when(F.size(h) == 0, 1.0).otherwise(F.size(F.array_intersect(h, p)) / F.size(h))


def number_downgraded(label: Column, score: Column, claim: Column, premise: Column) -> Column:
    """struct<label, score>: entailment falls to neutral when the claim's numbers do not occur in the premise."""
    pattern = F.lit(r"\b\d+(?:[.,]\d+)?(?:%|B|M|K|k|billion|million|trillion)?\b")
    h, p = (F.array_distinct(F.regexp_extract_all(T.text_of(c), pattern, F.lit(0))) for c in (claim, premise))
    ent = label == "ENTAILMENT"
    none, other = (F.size(h) > 0) & (F.size(p) == 0), (F.size(h) > 0) & (F.size(p) > 0) & ~F.arrays_overlap(h, p)
    factor = F.when(ent & other, 0.7).when(ent & none, 0.85).otherwise(1.0)
    return F.struct(F.when(ent & (other | none), "NEUTRAL").otherwise(label).alias("label"), (score * factor).alias("score"))


def semantic_entailment(claims: DataFrame, premises: DataFrame) -> DataFrame:
    """Claims (key, sentence, vector), premises (key, vector), unit vectors: (key, score, label), the mean over the
    claim's sentences of the best premise of the same key; 0.42 and 0.25 decide."""
    from skarn.operators.retrieval import dot

    best = claims.join(premises.select("key", F.col("vector").alias("pv")), "key").groupBy("key", "sentence").agg(F.max(dot(F.col("vector"), F.col("pv"))).alias("m"))
    return best.groupBy("key").agg(F.avg("m").alias("score")).withColumn("label", entailment_label(F.col("score"), 0.42, 0.25))


def mutual_entailment(vectors: DataFrame, cell: int = 2048) -> DataFrame:
    """G36/F2 over whole keys: vectors (key, sentence, vector), unit vectors: (key, score, label), where every sentence is
    a claim and all other sentences of its key are its premises; one without premises scores 0.

    A key's sentences are dealt into cells of about `cell` rows and each pair of cells is one matrix product, so that a hot
    key is many tasks. Only keys above one cell are broadcast: at most rows / cell of them.
    """
    v = vectors.filter(F.col("key").isNotNull())
    large = v.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / cell).cast("int").alias("cells")).filter("cells > 1")
    v = v.join(F.broadcast(large), "key", "left").withColumn("cells", F.coalesce("cells", F.lit(1)))
    v = v.withColumn("mine", F.pmod(F.xxhash64("sentence"), "cells").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    claims = v.select("key", F.col("mine").alias("i"), F.col("other").alias("j"), "sentence", "vector", F.lit(True).alias("claim"))
    premises = v.select("key", F.col("other").alias("i"), F.col("mine").alias("j"), "sentence", "vector", F.lit(False).alias("claim"))

    def best(both):
        import numpy as np

        a, b = both[both["claim"]], both[~both["claim"]]
        m = np.full(len(a), -np.inf)
        if len(a) and len(b):
            s = np.stack(a["vector"].to_numpy()) @ np.stack(b["vector"].to_numpy()).T
            s[a["sentence"].to_numpy()[:, None] == b["sentence"].to_numpy()[None, :]] = -np.inf
            m = s.max(axis=1)
        return a[["key", "sentence"]].assign(m=m)

    schema = f"key {v.schema['key'].dataType.simpleString()}, sentence {v.schema['sentence'].dataType.simpleString()}, m double"
    each = claims.unionByName(premises).groupBy("key", "i", "j").applyInPandas(best, schema).groupBy("key", "sentence").agg(F.max("m").alias("m"))
    found = F.when(F.col("m") > float("-inf"), F.col("m")).otherwise(0.0)
    return each.groupBy("key").agg(F.avg(found).alias("score")).withColumn("label", entailment_label(F.col("score"), 0.42, 0.25))


def judged(rows: DataFrame, claim: str, premise: str) -> DataFrame:
    """Rows with r, struct<label, score>: how far the premise entails the claim, numbers checked."""
    with_score = rows.withColumn("__s", lexical_entailment(F.col(claim), F.col(premise)))
    return with_score.withColumn("r", number_downgraded(entailment_label(F.col("__s")), F.col("__s"), F.col(claim), F.col(premise))).drop("__s")


def faithfulness(claims: DataFrame, chunks: DataFrame, key: str, first: int = 5) -> DataFrame:
    """Claims (key, text), chunks (key, place, text): (key, n_atoms, n_entailed, n_contradicted, strict, soft, label).

    Each atom takes its best of the first chunks by place; with all scores 0 it stays a contradiction."""
    atoms = claims.select(key, F.posexplode(T.atoms("text")).alias("a", "atom"))
    order = Window.partitionBy(key).orderBy("place")
    near = chunks.select(key, "place", F.col("text").alias("premise")).withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= first).drop("__r")
    down = judged(atoms.join(near, key, "left"), "atom", "premise")
    best = down.groupBy(key, "a").agg(F.max_by("r", F.struct(F.col("r.score"), -F.col("place"))).alias("r"))
    label = F.when(F.coalesce(F.col("r.score"), F.lit(0.0)) > 0, F.col("r.label")).otherwise("CONTRADICTION")
    g = best.withColumn("label", label).groupBy(key).agg(F.count(F.lit(1)).alias("n_atoms"), F.count_if(F.col("label") == "ENTAILMENT").alias("n_entailed"), F.count_if(F.col("label") == "CONTRADICTION").alias("n_contradicted"))
    strict = F.col("n_entailed") / F.col("n_atoms")
    return g.select("*", strict.alias("strict"), (1 - F.col("n_contradicted") / F.col("n_atoms")).alias("soft"), F.when(strict >= 0.5, "FAITHFUL").when(strict >= 0.25, "PARTIAL").otherwise("UNFAITHFUL").alias("label"))


def cited_sentences(rows: DataFrame, key: str) -> DataFrame:
    """(key, p, sentence, ids): sentences of more than twelve characters with markers [1], [E1, E4] or [p. 3]."""
    joined = F.regexp_replace(T.text_of("answer"), r"(?i)\[\s*p\.?\s*(\d+)\s*\]", "[p.$1]")
    each = rows.select(key, F.posexplode(T.sentences(F.replace(joined, F.lit("\n"), F.lit(" ")))).alias("p", "s"))
    marks = F.regexp_extract_all("s", F.lit(r"\[\s*(?:p\.|E_?)?\d+(?:\s*[,;&]\s*E?_?\d+)*\s*\]"), F.lit(0))
    ids = F.flatten(F.transform(marks, lambda m: F.transform(F.regexp_extract_all(m, F.lit(r"\d+"), F.lit(0)), lambda n: n.cast("int"))))
    clean = F.trim(F.regexp_replace("s", r"\[[^\]]*\]", ""))
    return each.select(key, "p", clean.alias("sentence"), ids.alias("ids")).filter((F.size("ids") > 0) & (F.length("sentence") > 12))


def answer_scores(rows: DataFrame, key: str, pages: DataFrame | None = None) -> DataFrame:
    """Rows (key, answer, n_pages, gold_page): citations, invalid page rate, cited share of substantive sentences and
    whether the gold page is cited.

    With pages (key, page, text) also citation precision (the share of citations whose page entails their sentence), F1 with
    the cited share, and hallucination rate; null where there are no citations. Shares have three decimals.
    """
    c = cited_sentences(rows, key).select(key, "p", "sentence", F.explode("ids").alias("page")).join(rows.select(key, "n_pages", "gold_page"), key)
    invalid = (F.col("page") < 1) | (F.col("page") > F.col("n_pages"))
    supported = F.lit(None).cast("int")
    if pages is not None:
        shown = pages.select(key, "page", F.col("text").alias("premise"))
        c = judged(c.join(shown, [key, "page"], "left"), "sentence", "premise")
        supported = (~invalid & F.col("premise").isNotNull() & (F.col("r.score") > 0) & (F.col("r.label") == "ENTAILMENT")).cast("int")
    g = c.groupBy(key).agg(F.count(F.lit(1)).alias("n_citations"), F.round(F.avg(invalid.cast("int")), 3).alias("invalid_page_rate"), F.max((F.col("page") == F.col("gold_page")).cast("int")).alias("gold_cited"), F.avg(F.coalesce(supported, F.lit(0)) if pages is not None else supported).alias("share"))
    s = T.substantive_sentences("answer")
    cited = F.size(F.filter(s, lambda x: x.rlike(r"\[\s*(?:p\.?\s*|E_?)?\d+")))
    base = rows.select(key, "gold_page", F.size(s).alias("n_substantive"), F.round(ratio(cited, F.size(s)), 3).alias("citation_recall"))
    out = base.join(g, key, "left").withColumn("citation_precision", F.round("share", 3))
    shown = [F.coalesce("n_citations", F.lit(0)).alias("n_citations"), "invalid_page_rate", "n_substantive", "citation_recall", F.when(F.col("gold_page").isNotNull(), F.coalesce("gold_cited", F.lit(0))).alias("gold_cited")]
    if pages is None:
        return out.select(key, *shown)
    p, r = F.col("citation_precision"), F.col("citation_recall")
    f1 = F.when((p > 0) & (r > 0), F.round(2 * p * r / (p + r), 3)).when(p.isNotNull() & r.isNotNull(), 0.0)
    return out.select(key, *shown, "citation_precision", f1.alias("citation_f1"), F.round(1 - F.col("share"), 3).alias("hallucination_rate"))


def macro_micro(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mean of row rates and rate of the sums; rows without a count leave the macro mean."""
    rate = F.try_divide("supported", "total")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(rate).alias("macro"), ratio(F.sum("supported"), F.sum("total")).alias("micro"))


def source_match(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """Ranked (case_id, rank, source), expected (case_id, source_id, keywords): hit at 1 and 5 and reciprocal rank of
    a source that equals the id or holds all keywords."""
    rows = expected.join(ranked, "case_id", "left")
    ok = F.coalesce(F.col("source") == F.col("source_id"), F.lit(False)) | ((F.size("keywords") > 0) & F.forall("keywords", lambda k: F.lower("source").contains(F.lower(k))))
    g = rows.groupBy("case_id").agg(F.min(F.when(ok, F.col("rank"))).alias("first"))
    return g.select("case_id", *[F.coalesce((F.col("first") <= k).cast("int"), F.lit(0)).alias(f"hit_{k}") for k in (1, 5)], F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"))


def subset_means(rows: DataFrame, value: str, subsets: dict[str, Column]) -> DataFrame:
    """(subset, n, mean) of overlapping subsets in one pass: each row is sent to the subsets it is in."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in subsets.items()]))
    return rows.select(F.explode(names).alias("subset"), value).groupBy("subset").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def localisation(rows: DataFrame, by: str) -> DataFrame:
    """Rows (by, rank, pool): recall at 1, 5 and 10, MRR and the random MRR of the pools."""
    floor = M.random_floor(rows, "pool")
    at = lambda k: F.avg(F.coalesce((F.col("rank") <= k).cast("int"), F.lit(0))).alias(f"recall_{k}")
    return floor.groupBy(by).agg(F.count(F.lit(1)).alias("n"), at(1), at(5), at(10), F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"), F.avg("floor_mrr").alias("random_mrr"))


def negative_control(rows: DataFrame) -> DataFrame:
    """Rows (true_score, corrupt_score, corrupt_contradicted): means, separation and rates below 0.5."""
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("true_score").alias("mean_true"),
        F.avg("corrupt_score").alias("mean_corrupt"),
        (F.avg("true_score") - F.avg("corrupt_score")).alias("separation"),
        F.avg((F.col("corrupt_score") < 0.5).cast("int")).alias("caught_rate"),
        F.avg((F.col("true_score") < 0.5).cast("int")).alias("flagged_rate"),
        F.avg((F.col("corrupt_contradicted") > 0).cast("int")).alias("contradiction_rate"),
    )


def perturbed(text: Column, old: Column, new: Column) -> Column:
    """Every literal occurrence replaced."""
    return F.replace(text, old, new)


def sensitivity(rows: DataFrame) -> DataFrame:
    """Rows (kind, prediction, new): the share of predictions that follow the altered value, by kind; 0 without rows."""
    follow = F.lower("prediction").contains(F.lower("new")).cast("int")
    kinds = ["TEXT_VALUE_EDIT", "VISUAL_VALUE_EDIT"]
    return rows.agg(*[F.coalesce(F.avg(F.when(F.col("kind") == k, follow)), F.lit(0.0)).alias(k.lower()) for k in kinds])


def telemetry(traces: DataFrame, last: int = 100) -> DataFrame:
    """Traces (trace_id, ts, latency_ms, labels array): counts over all, the upper median latency and support rate in per
    cent over the latest `last`."""
    recent = traces.orderBy(F.col("ts").desc(), F.col("trace_id").desc()).limit(last)
    good = recent.filter("latency_ms > 0")
    n = good.agg(F.count(F.lit(1)).alias("n"))
    ranked = good.withColumn("r", F.row_number().over(Window.orderBy("latency_ms", "trace_id")) - 1).join(F.broadcast(n))  # at most `last` rows
    p50 = ranked.filter(F.col("r") == F.floor(F.col("n") / 2)).agg(F.first("latency_ms").alias("p50_latency_ms"), F.first("n").alias("sample_size"))
    claims = recent.select(F.explode("labels").alias("l")).agg(F.count(F.lit(1)).alias("total_claims"), F.count_if(F.col("l") == "SUPPORTED").alias("supported_claims"))
    count = traces.agg(F.count(F.lit(1)).alias("total_traces"))
    return count.join(p50).join(claims).withColumn("support_rate_pct", F.try_divide(100.0 * F.col("supported_claims"), F.col("total_claims")))


def split_overlaps(manifest: DataFrame) -> DataFrame:
    """Papers that more than one split holds; no row means disjoint splits."""
    return manifest.groupBy("paper_id").agg(F.countDistinct("split").alias("n")).filter("n > 1")


def release_faults(expected: DataFrame, raw: DataFrame, scored: DataFrame) -> DataFrame:
    """(fault, n) of a release: universe gaps, keys that raw and scored do not share, statuses and values out of range."""
    bad = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    keys = M.sums_by_key(
        expected.select(*M.KEY, F.lit(1).alias("expected")),
        raw.select(*M.KEY, F.lit(1).alias("actual"), bad(~F.col("status").isin("SUCCESS", "ABSTAINED", "ERROR")).alias("unknown")),
        scored.select(*M.KEY, F.lit(1).alias("scored"), bad((F.col("value") < 0) | F.isnan("value")).alias("outside")),
    )
    none = lambda c: (F.col(c) == 0) | ~F.col("whole")
    found = {
        "raw missing": F.when(none("actual"), F.col("expected")),
        "raw extra": F.when((F.col("actual") > 0) & none("expected"), 1),
        "raw repeated": F.when(F.col("actual") > 1, 1),
        "not scored": F.when(none("scored"), F.col("actual")),
        "scored without raw": F.when((F.col("scored") > 0) & none("actual"), 1),
        "value out of range": F.col("outside"),
        "unknown status": F.col("unknown"),
    }
    sums = keys.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in found.items()])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(name).alias("fault"), F.col(name).alias("n")) for name in found])).alias("f")).select("f.*").filter("n > 0")


def row_digest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, digest): the SHA-256 of each row as the canonical JSON file that holds it, keys included, null columns
    left out, so that a column added later without a value changes no digest."""
    named = rows.select("*", *[F.col(k).alias(f"__{k}") for k in keys])
    lines = canonical_json(named, indent=2, drop_nulls="top", name="__json", keep=[f"__{k}" for k in keys])
    return lines.select(*[F.col(f"__{k}").alias(k) for k in keys], F.sha2(F.col("__json").cast("binary"), 256).alias("digest"))


def unanswerable_controls(cases: DataFrame, papers: DataFrame, cap: int = 3, seed: int = 20260712, bucket: int = 8) -> DataFrame:
    """Cases (case_id, paper_id, fact), papers (paper_id, text), any number of texts a paper: (case_id, paper_id,
    target): each case goes to another paper whose texts all lack its fact, at most `cap` a paper.

    In place of a walk that ends when a cap is full, papers lie in hashed buckets of about `bucket`, and a case proposes
    to the first open paper that lacks its fact in the buckets it looks at; a paper takes proposals by a seeded hash. A
    case without such a paper looks at twice as many buckets next. That ends when every case is placed or has seen all
    papers, so a case stays out only if no open paper lacks its fact. Facts are looked up by phrase_hits(), not pair by pair.
    """
    facts = cases.select("case_id", "paper_id", F.lower("fact").alias("fact"))
    lower = papers.select(F.col("paper_id").alias("target"), F.lower("text").alias("t"))
    held = written(phrase_hits(lower, "target", "t", facts, "fact", each_row=False), "held-facts")
    ids = papers.select(F.col("paper_id").alias("target")).distinct()
    buckets = max(1, ids.count() // bucket)
    dealt = written(ids.withColumn("b", F.pmod(F.xxhash64(F.lit(seed), "target"), F.lit(buckets)).cast("int")), "paper-buckets")
    left = written(facts.withColumns({"lo": F.lit(0), "w": F.lit(1)}), "open-cases")
    taken = None
    while not left.isEmpty():
        start = F.pmod(F.xxhash64(F.lit(seed), "case_id"), F.lit(buckets))
        look = left.withColumn("step", F.explode(F.sequence(F.col("lo"), F.least(F.col("lo") + F.col("w"), F.lit(buckets)) - 1)))
        look = look.withColumn("b", F.pmod(start + F.col("step"), F.lit(buckets)).cast("int"))
        seen = look.join(dealt, "b").filter(F.col("target") != F.col("paper_id")).join(held, ["target", "fact"], "left_anti")
        used = dealt.select("target").withColumn("used", F.lit(0)) if taken is None else taken.groupBy("target").agg(F.count(F.lit(1)).cast("int").alias("used"))
        room = seen.join(used, "target", "left").withColumn("used", F.coalesce("used", F.lit(0))).filter(F.col("used") < cap)
        first = room.groupBy("case_id", "paper_id").agg(F.min(F.struct("step", F.xxhash64(F.lit(seed), "case_id", "target").alias("h"), "target", "used")).alias("x")).select("case_id", "paper_id", "x.h", "x.target", "x.used")
        first = written(first.withColumn("k", F.row_number().over(Window.partitionBy("target").orderBy("h", "case_id"))), "proposals")
        won = first.filter(F.col("k") + F.col("used") <= cap).select("case_id", "paper_id", "target")
        taken = written(won if taken is None else taken.unionByName(won), "placed-cases")
        rest = left.join(won.select("case_id"), "case_id", "left_anti").join(first.select("case_id", F.lit(True).alias("saw")), "case_id", "left")
        wide = rest.select("case_id", "paper_id", "fact", F.when(F.col("saw"), F.col("lo")).otherwise(F.col("lo") + F.col("w")).alias("lo"), F.when(F.col("saw"), F.col("w")).otherwise(2 * F.col("w")).alias("w"))
        left = written(wide.filter(F.col("lo") < buckets), "open-cases")
    return taken if taken is not None else facts.select("case_id", "paper_id", F.col("paper_id").alias("target")).limit(0)
