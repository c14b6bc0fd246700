"""Evaluation aggregates: ranking, text, agreement and interval metrics as grouped DataFrame plans.

Only the seeded bootstraps use Python, in parts of a group's draws, because these follow Python's generator; everything
else is built-in aggregation.
"""

from __future__ import annotations

import math
import pickle
import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.functions.text import squad_normalized
from skarn.operators.ranks import ascending, by_key, mean_ranks, numbered, running
from skarn.session import dealt, written


def ranking_metrics(ranked: DataFrame, gold: DataFrame, by: list[str]) -> DataFrame:
    """Ranked (*by, doc_id, rank), gold (*by, doc_id) -> first_rank, hit_1, hit_3, hit_5, reciprocal_rank, ndcg_5.

    Cases without a ranked row keep zeros; gold decides which cases exist.
    """
    g = gold.select(*by, "doc_id").distinct()
    n_gold = g.groupBy(*by).agg(F.count(F.lit(1)).alias("n_gold"))
    hits = ranked.join(g, [*by, "doc_id"], "left_semi").groupBy(*by).agg(F.min("rank").alias("first_rank"), F.sum(F.when(F.col("rank") <= 5, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_gold"), F.lit(5)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    first = F.col("first_rank")
    return n_gold.join(hits, by, "left").select(
        *by,
        first,
        *[F.coalesce((first <= k).cast("int"), F.lit(0)).alias(f"hit_{k}") for k in (1, 3, 5)],
        F.coalesce(1 / first, F.lit(0.0)).alias("reciprocal_rank"),
        (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg_5"),
    )


def metric_means(rows: DataFrame, by: list[str], eligible: Column | None = None) -> DataFrame:
    """Means of the ranking metrics by retriever (and capability); rows that are not eligible are left out."""
    ok = F.lit(True) if eligible is None else eligible
    mean = lambda c: F.avg(F.when(ok, F.col(c))).alias(c)
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("total_cases"), F.count_if(ok).alias("cases"), *[mean(c) for c in ("hit_1", "hit_3", "hit_5", "reciprocal_rank", "ndcg_5")])


def distinct_pages(hits: DataFrame, by: list[str]) -> DataFrame:
    """Hits (*by, page, rank) -> (*by, page, rank): pages once, at the place of their first hit."""
    first = hits.filter("page IS NOT NULL").groupBy(*by, "page").agg(F.min("rank").alias("at"))
    return first.select(*by, "page", F.row_number().over(Window.partitionBy(*by).orderBy("at", "page")).alias("rank"))


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two boxes (x0, y0, x1, y1); 0 without area."""
    zero = F.lit(0.0)
    both = F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def region_recall(candidates: DataFrame, gold: DataFrame, least: float = 0.5) -> DataFrame:
    """(case_id, hit): whether a candidate box of the case meets a gold box of the same page."""
    box = lambda p: [F.col(f"{p}{c}") for c in ("x0", "y0", "x1", "y1")]
    g = gold.select("case_id", "page", *[F.col(c).alias(f"g{c}") for c in ("x0", "y0", "x1", "y1")])
    valid = (F.col("x0") >= 0) & (F.col("x0") < F.col("x1")) & (F.col("x1") <= 1) & (F.col("y0") >= 0) & (F.col("y0") < F.col("y1")) & (F.col("y1") <= 1)
    met = candidates.filter(valid).join(g, ["case_id", "page"]).groupBy("case_id").agg(F.max((iou(box(""), box("g")) >= least).cast("int")).alias("hit"))
    return gold.select("case_id").distinct().join(met, "case_id", "left").select("case_id", F.coalesce("hit", F.lit(0)).alias("hit"))


def words_of(text: Column | str) -> Column:
    return F.filter(F.split(squad_normalized(text), " "), lambda w: w != "")


def token_f1(rows: DataFrame, key: str, empty_is_equal: bool) -> DataFrame:
    """(key, precision, recall, f1, exact) of prediction against reference on multisets of words.

    When both sides are empty f1 is 1 with empty_is_equal, else 0; one empty side gives 0.
    """
    t = rows.select(key, words_of("prediction").alias("p"), words_of("reference").alias("r"), (squad_normalized("prediction") == squad_normalized("reference")).alias("same"))
    tag = lambda c, n: t.select(key, F.explode(c).alias("w")).groupBy(key, "w").agg(F.count(F.lit(1)).alias(n))
    both = tag("p", "np").join(tag("r", "nr"), [key, "w"]).groupBy(key).agg(F.sum(F.least("np", "nr")).alias("same_words"))
    p, r = F.coalesce(F.try_divide("same_words", F.size("p")), F.lit(0.0)), F.coalesce(F.try_divide("same_words", F.size("r")), F.lit(0.0))
    f1 = F.when((F.size("p") == 0) & (F.size("r") == 0), 1.0 if empty_is_equal else 0.0).otherwise(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))
    return t.join(both, key, "left").select(key, p.alias("precision"), r.alias("recall"), f1.alias("f1"), F.col("same").cast("int").alias("exact"))


def set_f1(rows: DataFrame, key: str) -> DataFrame:
    """(key, f1, evidence) of rows (key, prediction, reference, abstained, gold_page_found).

    f1 goes by sets of lower-cased words. Without reference words an abstention is right and counts 1; else an empty side
    counts 0. evidence is 1 where the gold page was found.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != ""))
    flag = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    t = rows.select(key, words("prediction").alias("p"), words("reference").alias("r"), flag("abstained").alias("a"), flag("gold_page_found").alias("g"))
    t = t.withColumn("n", F.size(F.array_intersect("p", "r")))
    f1 = F.when((F.size("r") == 0) & F.col("a"), 1.0).otherwise(F.coalesce(F.try_divide(2.0 * F.col("n"), F.size("p") + F.size("r")), F.lit(0.0)))
    return t.select(key, f1.alias("f1"), F.col("g").cast("int").alias("evidence"))


def set_f1_means(scored: DataFrame) -> DataFrame:
    """One row (answer_f1, evidence_recall) over set_f1(), both 0 without rows."""
    mean = lambda c, name: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4).alias(name)
    return scored.agg(mean("f1", "answer_f1"), mean("evidence", "evidence_recall"))


def clauses(text: Column | str) -> Column:
    """Pieces of three words or more between commas, stops, semicolons and line feeds; the whole text without one."""
    return F.filter(F.transform(F.split(text, r"[,.;\n]"), lambda x: F.trim(x)), lambda c: F.size(F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0))) >= 3)


def _grounded(parts: Column, whole: Column, share: float) -> Column:
    """Clauses of which a share of the words of more than three letters occurs in whole, as substrings."""

    def one(c):
        words = F.filter(words_of(c), lambda w: F.length(w) > 3)
        return (F.size(words) > 0) & (F.size(F.filter(words, lambda w: whole.contains(w))) >= share * F.size(words))

    return F.size(F.filter(parts, one))


def unit_overlap(rows: DataFrame, key: str) -> DataFrame:
    """(key, precision, recall, f1) of prediction against clauses of evidence and reference."""
    found = clauses("evidence")
    units = F.when(F.size(found) > 0, found).otherwise(F.array("evidence"))
    t = rows.select(key, units.alias("u"), clauses("prediction").alias("pc"), squad_normalized("prediction").alias("pn"), squad_normalized(F.concat_ws(" ", "reference", "evidence")).alias("ge"))
    m = t.select(key, (_grounded(F.col("u"), F.col("pn"), 0.5) / F.size("u")).alias("recall"), (_grounded(F.col("pc"), F.col("ge"), 0.4) / F.greatest(F.size("pc"), F.lit(1))).alias("precision"))
    return m.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def confusion_prf(rows: DataFrame, predicted: Column, actual: Column, by: list[str]) -> DataFrame:
    """Tp, fp, fn, tn, precision, recall and f1; ratios without a denominator are 0."""
    zero = F.lit(0.0)
    c = rows.groupBy(*by).agg(F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & actual).alias("fn"), F.count_if(~predicted & ~actual).alias("tn"))
    p, r = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), zero), F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), zero)
    return c.select("*", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), zero).alias("f1"))


def pearson(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(*by, n, mean_x, stdev_x, r); r is null for a constant column or fewer than two rows."""
    some = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    s = some.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean_x"), F.stddev_pop(x).alias("stdev_x"), F.stddev_pop(y).alias("sy"), F.covar_pop(x, y).alias("cov"))
    return s.select(*by, "n", "mean_x", "stdev_x", F.when((F.col("stdev_x") > 0) & (F.col("sy") > 0), F.col("cov") / (F.col("stdev_x") * F.col("sy"))).alias("r"))


def average_ranks(rows: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """Ranks from 1 with ties averaged, in groups that a task can hold; ranks.mean_ranks() is for groups of any size."""
    w = Window.partitionBy(*by)
    return rows.withColumn(name, F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2)


def spearman(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    some = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return pearson(mean_ranks(mean_ranks(some, by, x, "__rx"), by, y, "__ry"), "__rx", "__ry", by).select(*by, "n", "r")


def cohens_kappa(rows: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """(*by, n, kappa) from label pairs; empty labels are left out; full chance agreement gives 1."""
    ok = rows.filter((F.coalesce(F.col(a), F.lit("")) != "") & (F.coalesce(F.col(b), F.lit("")) != ""))
    cells = ok.groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("c"))
    total = cells.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("same"))
    left = cells.groupBy(*by, F.col("a").alias("k")).agg(F.sum("c").alias("ca"))
    right = cells.groupBy(*by, F.col("b").alias("k")).agg(F.sum("c").alias("cb"))
    chance = left.join(right, [*by, "k"]).groupBy(*by).agg(F.sum(F.col("ca") * F.col("cb")).alias("chance"))
    both = total.join(chance, by, "left")
    pe = F.coalesce("chance", F.lit(0)) / (F.col("n") * F.col("n"))
    return both.select(*by, "n", F.when(pe == 1, 1.0).otherwise(F.try_divide(F.col("same") / F.col("n") - pe, 1 - pe)).alias("kappa"))


def chi2_tail(x: float, df: int) -> float:
    """Upper tail of the chi-square distribution."""
    if x <= 0:
        return 1.0
    a, h = df / 2, x / 2
    if h < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-15 * abs(total):
            k += 1
            term *= h / k
            total += term
        return max(0.0, 1 - total * math.exp(a * math.log(h) - h - math.lgamma(a)))
    value = 0.0  # continued fraction from its tail on
    for i in range(300, 0, -1):
        value = i * (i - a) / (h + 2 * i + 1 - a - value)
    return max(0.0, math.exp(a * math.log(h) - h - math.lgamma(a)) / (h + 1 - a - value))


def friedman(rows: DataFrame, subject: str, treatment: str, value: str) -> DataFrame:
    """One row (q, df, p_value, n): Friedman's test with tie correction over subjects that have every treatment."""
    k = rows.select(treatment).distinct().agg(F.count(F.lit(1)).alias("k"))
    full = rows.filter(F.col(value).isNotNull()).groupBy(subject).agg(F.count(F.lit(1)).alias("m")).join(F.broadcast(k)).filter("m = k").select(subject, "k")
    some = average_ranks(rows.join(full, subject), value, [subject], "rank")
    ties = some.groupBy(subject, value).agg(F.count(F.lit(1)).alias("t")).agg(F.sum(F.col("t") ** 3 - F.col("t")).alias("ties"))
    sums = some.groupBy(treatment).agg(F.sum("rank").alias("s"), F.count(F.lit(1)).alias("n"), F.first("k").alias("k")).agg(F.sum(F.col("s") ** 2).alias("ss"), F.max("n").alias("n"), F.max("k").alias("k"))
    n, kk = F.col("n"), F.col("k")
    q = 12 / (n * kk * (kk + 1)) * F.col("ss") - 3 * n * (kk + 1)
    factor = 1 - F.col("ties") / (n * (kk**3 - kk))
    one = sums.join(F.broadcast(ties)).select(F.when(factor > 0, q / factor).otherwise(q).alias("q"), (kk - 1).cast("long").alias("df"), n.alias("n"))

    def tail(batches):
        for pdf in batches:
            pdf["p_value"] = [chi2_tail(x, d) for x, d in zip(pdf["q"], pdf["df"])]
            yield pdf

    return one.mapInPandas(tail, "q double, df long, n long, p_value double")


def holm(rows: DataFrame, p: str, by: list[str]) -> DataFrame:
    """Holm's step-down adjustment, (*rows, p_adjusted); ties keep the order of the other columns."""
    placed = written(numbered(rows, by, ascending(p, *[c for c in rows.columns if c != p and c not in by]), "__i"), "holm-places")
    sized = by_key(placed, placed.groupBy(*by).agg(F.count(F.lit(1)).alias("__m")), by)
    stepped = F.least(F.lit(1.0), (F.col("__m") - F.col("__i") + 1) * F.col(p))
    return running(sized, by, ascending("__i"), stepped, F.max, "p_adjusted").drop("__i", "__m")


#: Draws that one task makes from a stored state of the generator.
DRAWS_AT_ONCE = 250


def bootstrap_means(values: DataFrame, by: str, draws: int, seed: int, at_once: int | None = None) -> DataFrame:
    """(by, draw, mean) of values (by, place, v): the means of `draws` resamples of each group, and as draw -1 its own mean.

    The draws are those of one Python generator a group, seeded with seed, over the group's values in order of place. How far
    the generator is after a number of draws depends on the group's size alone: one light pass a size stores its state every
    at_once draws, and tasks resume from there, so a group's draws are made in many tasks. A task holds the values of one group.
    """
    at_once = at_once or DRAWS_AT_ONCE
    kind = values.schema[by].dataType.simpleString()
    groups = values.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "v"))), lambda x: x["v"]).alias("vs"))  # the clusters or cases of a group
    groups = written(groups.withColumn("n", F.size("vs")), "bootstrap-groups")

    def states(batches):
        for pdf in batches:
            for n in pdf["n"].tolist():
                rng = random.Random(seed)
                for first in range(0, draws, at_once):
                    yield pd.DataFrame({"n": [n], "first": [first], "state": [pickle.dumps(rng.getstate())]})
                    for _ in range(at_once * n):
                        rng.randrange(n)

    def resample(batches):
        for pdf in batches:
            for group, vs, first, state in zip(pdf[by], pdf["vs"], pdf["first"], pdf["state"]):
                vs, rng = vs.tolist(), random.Random()
                rng.setstate(pickle.loads(state))
                many = range(first, min(first + at_once, draws))
                means = [sum(rng.choice(vs) for _ in vs) / len(vs) for _ in many]
                whole = [(-1, sum(vs) / len(vs))] if first == 0 else []
                rows = [*zip(many, means), *whole]
                yield pd.DataFrame({by: [group] * len(rows), "draw": [d for d, _ in rows], "mean": [m for _, m in rows]}).astype({"draw": "int64"})

    sizes = groups.select("n").distinct().repartition("n")
    known = written(sizes.mapInPandas(states, "n int, first int, state binary"), "generator-states")
    parts = groups.join(known, "n")
    spread = parts.repartition(shuffle_partitions(values), F.xxhash64(by, "first"))
    return written(spread.select(by, "vs", "first", "state").mapInPandas(resample, f"`{by}` {kind}, draw long, mean double"), "resampled")


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def interval(means: DataFrame, by: str, low: int, high: int) -> DataFrame:
    """(by, mean, lo, hi) of bootstrap_means(): the group's mean, and its resamples' means at two places of their order."""
    order = Window.partitionBy(by).orderBy("mean")  # the draws of one group, a parameter
    placed = means.filter("draw >= 0").withColumn("at", F.row_number().over(order) - 1)
    ends = placed.groupBy(by).agg(F.max(F.when(F.col("at") == low, F.col("mean"))).alias("lo"), F.max(F.when(F.col("at") == high, F.col("mean"))).alias("hi"))
    own = means.filter("draw = -1").select(F.col(by).alias("__g"), "mean")
    return ends.join(own, F.col(by).eqNullSafe(F.col("__g"))).select(by, "mean", "lo", "hi")


def cluster_bootstrap(rows: DataFrame, by: str, cluster: str, value: str, draws: int = 10_000, seed: int = 2027) -> DataFrame:
    """(by, mean, ci_low, ci_high, clusters): percentile interval of the mean of cluster means, in order of cluster."""
    means = written(rows.filter(F.col(value).isNotNull()).groupBy(by, cluster).agg(F.avg(value).alias("v")).select(by, F.col(cluster).alias("place"), "v"), "cluster-means")
    found = interval(bootstrap_means(means, by, draws, seed), by, int(0.025 * draws), min(int(0.975 * draws), draws - 1))
    sizes = means.groupBy(F.col(by).alias("__by")).agg(F.count(F.lit(1)).alias("clusters"))
    return found.join(sizes, F.col(by).eqNullSafe(F.col("__by"))).select(by, "mean", F.col("lo").alias("ci_low"), F.col("hi").alias("ci_high"), "clusters")


def paired_delta(rows: DataFrame, by: str, case: str, a: str, b: str, draws: int = 10_000, seed: int = 20260715) -> DataFrame:
    """(by, delta, lo, hi, n, significant): bootstrap of the mean paired difference, in order of case."""
    some = written(rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(by, F.col(case).alias("place"), (F.col(a) - F.col(b)).alias("v")), "paired-differences")
    found = interval(bootstrap_means(some, by, draws, seed), by, int(0.025 * draws), int(0.975 * draws))
    sizes = some.groupBy(F.col(by).alias("__by")).agg(F.count(F.lit(1)).alias("n"))
    both = found.join(sizes, F.col(by).eqNullSafe(F.col("__by")))
    return both.select(by, F.col("mean").alias("delta"), "lo", "hi", "n", ((F.col("lo") > 0) | (F.col("hi") < 0)).alias("significant"))


def order_statistic(rows: DataFrame, value: str, q: float, by: list[str]) -> DataFrame:
    """(*by, value): the element at index min(n - 1, floor(q * n)) of the sorted values, without collecting a group."""
    return order_statistics(rows, value, {value: q}, by)


def order_statistics(rows: DataFrame, value: str, qs: dict[str, float], by: list[str]) -> DataFrame:
    """(*by, one column for each of qs): values are put in order once, whatever the number of quantiles."""
    placed = written(numbered(rows.filter(F.col(value).isNotNull()).select(*by, value), by, ascending(value), "__i"), "order-statistics")
    sizes = placed.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    at = lambda q: F.least(F.col("__n") - 1, F.floor(F.lit(q) * F.col("__n"))) + 1
    picked = by_key(placed, sizes, by)
    wanted = F.lit(False)
    for q in qs.values():
        wanted = wanted | (F.col("__i") == at(q))
    return picked.filter(wanted).groupBy(*by).agg(*[F.max(F.when(F.col("__i") == at(q), F.col(value))).alias(k) for k, q in qs.items()])


def random_floor(rows: DataFrame, n: str) -> DataFrame:
    """Expected recall at 1 and 5 and reciprocal rank of a guess among n sources."""
    size = F.col(n)
    harmonic = F.aggregate(F.sequence(F.lit(1), F.greatest(size, F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / i)
    some = lambda c: F.when(size > 0, c).otherwise(0.0)
    return rows.withColumns({"floor_r1": some(1.0 / size), "floor_r5": some(F.least(F.lit(5), size) / size), "floor_mrr": some(harmonic / size)})


# Release scoring: rows (system, model, seed, case_id, status, metric, value, weight)


def key_universe(systems: DataFrame, models: DataFrame, seeds: DataFrame, cases: DataFrame) -> DataFrame:
    """Every (system, model, seed, case_id); the product is the result, and the three small axes are broadcast.

    Cases are dealt before they are multiplied, so the product is made in many tasks and lies by case_id."""
    return dealt(cases.select("case_id"), "case_id").join(F.broadcast(systems.select("system"))).join(F.broadcast(models.select("model"))).join(F.broadcast(seeds.select("seed")))


KEY = ["system", "model", "seed", "case_id"]


def sums_by_key(*tables: DataFrame) -> DataFrame:
    """(*KEY, whole, the sum of each number column) of tables (*KEY, number columns), one row a key; a column that a table
    lacks counts 0. whole: no part of the key is null, so that it can meet its like in another table.

    All tables meet by case_id in one exchange; what lies by case_id already, as a universe does, is not moved.
    """
    rows = None
    for t in tables:
        part = dealt(t, "case_id")
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    whole = F.lit(True)
    for k in KEY:
        whole = whole & F.col(k).isNotNull()
    names = [c for c in rows.columns if c not in KEY]
    return rows.groupBy(*KEY).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).withColumn("whole", whole)


def gaps(keys: DataFrame) -> DataFrame:
    """keys of sums_by_key() with columns expected and actual, a row for each fault: missing as often as expected."""
    fault = F.concat(
        F.when((F.col("actual") == 0) | ~F.col("whole"), F.array_repeat(F.lit("missing"), F.col("expected").cast("int"))).otherwise(F.array()),
        F.when((F.col("actual") > 0) & ((F.col("expected") == 0) | ~F.col("whole")), F.array(F.lit("extra"))).otherwise(F.array()),
        F.when(F.col("actual") > 1, F.array(F.lit("repeated"))).otherwise(F.array()),
    )
    return keys.select(*KEY, F.explode(fault).alias("fault"))


def universe_gaps(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Keys that are missing, extra or repeated, with the kind of fault; no row means a whole release."""
    return gaps(sums_by_key(expected.select(*KEY, F.lit(1).alias("expected")), actual.select(*KEY, F.lit(1).alias("actual"))))


def resume_keys(expected: DataFrame, raw: DataFrame, terminal: tuple[str, ...] = ("SUCCESS", "ABSTAINED")) -> DataFrame:
    """Keys still to run."""
    return expected.join(raw.filter(F.col("status").isin(*terminal)), KEY, "left_anti")


def case_means(rows: DataFrame) -> DataFrame:
    """G11, first levels: weighted means over the seeds of a case, with the summed weights."""
    some = F.col("value").isNotNull()
    w = F.coalesce(F.col("weight"), F.lit(1)).cast("double")
    return rows.groupBy("system", "model", "case_id", "metric").agg(
        F.try_divide(F.sum(F.when(some, F.col("value") * w)), F.sum(F.when(some, w))).alias("mean"),
        F.coalesce(F.sum(F.when(some, w)), F.lit(0.0)).alias("denominator"),
        F.max(F.col("weight").isNotNull()).alias("weighted"),
    )


def group_means(rows: DataFrame) -> DataFrame:
    """(system, model, metric, mean, n_cases): case means averaged, weighted only for metrics that carry weights."""
    cases = case_means(rows)
    weighted = cases.groupBy("metric").agg(F.max("weighted").alias("__w"))
    w = F.when(F.col("__w"), F.col("denominator")).otherwise(1.0)
    some = F.col("mean").isNotNull()
    return cases.join(F.broadcast(weighted), "metric").groupBy("system", "model", "metric").agg(
        F.try_divide(F.sum(F.when(some, F.col("mean") * w)), F.sum(F.when(some, w))).alias("mean"), F.count_if(some).alias("n_cases")
    )
