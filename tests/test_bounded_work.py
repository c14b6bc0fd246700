"""Work that must not grow faster than the input: plans without extra shuffles, counted ranks, keys that meet in one exchange."""

import random

import pytest
from pyspark.sql import functions as F

from skarn.operators import chunking as C
from skarn.operators import evidence as E
from skarn.operators import metrics as M
from skarn.operators import reports as P
from skarn.operators import retrieval as R
from skarn.operators.matching import phrase_hits
from skarn.plans.base import questions

LIST = "q_id int, doc_id int, score double, later boolean, ord int"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]  # once, also after a run


def lists(seed, n=500):
    """Two lists a query with ties and nulls in ord; query 2 has a short second list, query 3 none."""
    rng = random.Random(seed)
    one = [(q, d, rng.randrange(6) / 2, rng.random() < 0.3, None if d % 50 == 0 else d * 7 % n) for q in (1, 2, 3) for d in range(n) if rng.random() < 0.7]
    two = [(q, d, rng.randrange(4) / 2, False, d) for q, m in ((1, n), (2, 9)) for d in range(m)]
    return one, two


def ranked(rows):
    out = {}
    for q in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[3], r[4] is not None, r[4] or 0, r[1]))
        out |= {(q, r[1]): i for i, r in enumerate(mine, 1)}
    return out


@pytest.mark.parametrize("seed,n", [(1, 3), (2, 25)])
def test_best_fused_equals_ranking_all(spark, seed, n):
    one, two = lists(seed)
    short = [(q, d, i) for q in (1, 3) for i, d in enumerate((499, 3, 77), 1)]
    rrf = {}
    for places in (ranked(one), ranked(two), {(q, d): i for q, d, i in short}):
        for key, place in places.items():
            rrf[key] = rrf.get(key, 0.0) + 1 / (60 + place)
    long = [spark.createDataFrame(rows, LIST) for rows in (one, two)]
    depth = R.fusion_depth(2, n)
    got = R.best_fused([(rows, R.list_top(rows, depth)) for rows in long], [spark.createDataFrame(short, "q_id int, doc_id int, rank int")]).collect()
    assert all(abs(rrf[r.q_id, r.doc_id] - r.rrf) < 1e-12 for r in got)
    for q in (1, 2, 3):
        best = lambda rows: [d for d, s in sorted(rows, key=lambda x: (-round(x[1], 12), x[0]))[:n]]
        assert best([(r.doc_id, r.rrf) for r in got if r.q_id == q]) == best([(d, s) for (p, d), s in rrf.items() if p == q])
        assert n > 3 or len([r for r in got if r.q_id == q]) < 200


def test_pairs_by_cue_are_not_shuffled(spark):
    queries = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["c"]), (3, [])], "q_id int, cues array<string>")
    chunks = spark.createDataFrame([(1, ["b", "a"]), (2, ["c", "x"]), (3, ["x"])], "doc_id int, cues array<string>")
    met = E.met_by_cue(queries, chunks)
    assert sorted((r.q_id, r.doc_id) for r in met.collect()) == [(1, 1), (2, 2)]
    assert "HashAggregate" not in plan(met)


def test_a_universe_is_not_shuffled(spark):
    axes = [spark.createDataFrame([(x,) for x in v], s) for v, s in ((["s", "t"], "system string"), (["m"], "model string"), ([0, 1], "seed long"), ([1, 2, None], "case_id long"))]
    actual = spark.createDataFrame([("s", "m", 0, 1), ("s", "m", 0, 1), ("u", "m", 0, 2), ("s", "m", 0, None)], "system string, model string, seed long, case_id long")
    gaps = M.universe_gaps(M.key_universe(*axes), actual)
    found = sorted((tuple(r) for r in gaps.collect()), key=str)
    want = [(s, "m", k, c, "missing") for s in "st" for k in (0, 1) for c in (1, 2, None) if (s, k, c) != ("s", 0, 1)]
    want += [("s", "m", 0, 1, "repeated"), ("u", "m", 0, 2, "extra"), ("s", "m", 0, None, "extra")]
    assert found == sorted(want, key=str)
    assert plan(gaps).count("REPARTITION_BY_NUM") == 2 and "SortMergeJoin" not in plan(gaps)


def test_release_faults_read_each_table_once(spark):
    kind = "system string, model string, seed long, case_id long, status string, value double"
    raw = spark.createDataFrame([("s", "m", 0, 1, "SUCCESS", 1.0), ("s", "m", 0, 1, "ERROR", None), ("s", "m", 0, 3, "odd", -1.0), ("s", "m", 0, None, None, 1.0)], kind)
    scored = spark.createDataFrame([("s", "m", 0, 1, "SUCCESS", -1.0), ("s", "m", 0, 2, "SUCCESS", float("nan"))], kind)
    expected = spark.createDataFrame([("s", "m", 0, 1), ("s", "m", 0, 2)], "system string, model string, seed long, case_id long")
    faults = P.release_faults(expected, raw, scored)
    assert {r.fault: r.n for r in faults.collect()} == {"raw missing": 1, "raw extra": 2, "raw repeated": 1, "not scored": 2, "scored without raw": 1, "value out of range": 2, "unknown status": 1}
    assert plan(faults).count("LogicalRDD") + plan(faults).count("ExistingRDD") + plan(faults).count("LocalTableScan") <= 3


def test_rows_of_a_small_file_are_dealt(spark, sf):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    q = questions(spark, sf)
    assert q.rdd.getNumPartitions() == n
    titles = spark.createDataFrame([(i, f"deep learning {i}") for i in range(50)], "doc_id int, title string").coalesce(1)
    asked = spark.createDataFrame([(1, "deep learning 7"), (2, "learning 8")], "q_id int, text string")
    met = E.title_matches(titles, asked)
    assert met.count() > 0 and "HashAggregate" not in plan(met)
    papers = titles.withColumns({"summary": F.col("title"), "authors": F.lit("a"), "category": F.lit("c")})
    assert "HashAggregate" not in plan(R.paper_relevance(papers, asked, lambda c: F.split(F.col(c), " "), F.col))


def test_titles_are_read_once_a_page(spark):
    text = "Introduction\n" + " ".join(f"w{i}" for i in range(1000))
    pages = spark.createDataFrame([("p", 1, text), ("p", 2, ""), ("p", 3, None), ("p", 4, "a  b")], "paper_id string, page int, text string")
    cut = C.cut_pages(pages, 100, 20)
    words = text.split()
    for r in cut.filter("page = 1").collect():
        start = (r.window - 1) * 80
        assert r.text == " ".join(words[start : start + 100]) and r.char_start == (len(" ".join(words[:start])) if start else 0) and r.char_end == r.char_start + len(r.text)
    assert [(r.window, r.text) for r in cut.filter("page <> 1").collect()] == [(1, "a b")]
    lines = plan(cut).splitlines()
    assert not any("related work" in x.lower() for x in lines[: next(i for i, x in enumerate(lines) if "Generate posexplode" in x)])


def test_word_phrases_are_not_looked_up_in_texts_again(spark):
    texts = spark.createDataFrame([("k", "some words here"), ("k", "words words"), ("l", "sword"), (None, "words")], "k string, t string")
    phrases = spark.createDataFrame([("word",), ("words here",), ("none",)], "p string")
    got = lambda each: sorted(((r.k, r.p) for r in phrase_hits(texts, "k", "t", phrases, "p", each_row=each).collect()), key=str)
    assert got(True) == sorted([("k", "word"), ("k", "word"), ("l", "word"), (None, "word"), ("k", "words here")], key=str)
    assert got(False) == sorted([("k", "word"), ("l", "word"), (None, "word"), ("k", "words here")], key=str)


def test_chunks_of_one_kind_meet_a_question_once(spark, monkeypatch):
    kind = "doc_id int, ord int, text string, is_figure boolean, is_table boolean, label string, caption string, section string, chunk_type string, page int"
    kinds = [(False, False, None, "", "Results", "result", 3), (True, False, "Figure 6", "score comparison", "Results", "body", 1), (True, True, "Table 12", "", None, None, None)]
    chunks = spark.createDataFrame([(i, i % 7, f"text {i}", *kinds[i % 3]) for i in range(60)], kind)
    asked = spark.createDataFrame([(1, "Compare Table 12 and Figure 6 on page 3", "table"), (2, "What results outperform the baseline", None)], "q_id int, text string, first string")
    labels = spark.createDataFrame([(1, "table 12"), (2, "figure 6")], "q_id int, label string")
    met, real = [], E.met_by_cue
    monkeypatch.setattr(E, "met_by_cue", lambda q, c: (met.append(c.count()), real(q, c))[1])
    few = sorted(map(str, E.modality_list(chunks, E.signals(asked), labels).collect()))
    monkeypatch.setattr(E, "KINDS", 0, raising=False)
    assert few == sorted(map(str, E.modality_list(chunks, E.signals(asked), labels).collect())) and len(few) > 40
    assert met == [3, 60]


def test_tops_put_few_rows_in_order_and_terms_are_broadcast(spark):
    rows = spark.createDataFrame([(q, d, d % 5 - 2.0, False, d % 3) for q in (1, 2) for d in range(200)], LIST)
    want = {q: [r.doc_id for r in sorted((r for r in rows.collect() if r.q_id == q), key=lambda r: (-r.score, r.later, r.ord, r.doc_id))[:7]] for q in (1, 2)}
    top = R.list_top(rows, 7)
    assert {q: [r.doc_id for r in sorted(top.filter(f"q_id = {q}").collect(), key=lambda r: r["rank"])] for q in (1, 2)} == want
    assert "__level" in plan(top)
    docs = spark.createDataFrame([(i, f"alpha beta{i} gamma alpha") for i in range(50)], "doc_id int, text string")
    seen, real = [], R.written
    R.written, kept = lambda df, label: (seen.append((label, df)), real(df, label))[1], real
    try:
        assert R.postings(docs, docs.filter("doc_id < 3").selectExpr("doc_id AS q_id", "text")).count() == 50 + 50 * 2 + 3
    finally:
        R.written = kept
    assert "BroadcastHashJoin" in dict(seen)["postings"]._jdf.queryExecution().executedPlan().toString()
