"""Operators on small fixtures against brute force."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from skarn.operators import chunking as C
from skarn.operators import metrics as M
from skarn.operators import planning as P
from skarn.operators import retrieval as R
from skarn.operators import verify as V
from skarn.sources import tables as S


def test_page_windows_follow_the_loop(spark):
    for n, target, overlap in [(0, 5, 2), (1, 5, 2), (5, 5, 2), (6, 5, 2), (23, 5, 2), (9, 3, 3), (10, 4, 0)]:
        text = " ".join(f"w{i}" for i in range(n))
        want, start = [], 0
        words = text.split()
        while start < len(words):
            end = min(start + target, len(words))
            want.append(" ".join(words[start:end]))
            if end >= len(words):
                break
            start = max(end - overlap, start + 1)
        rows = C.page_windows(spark.createDataFrame([("p", 1, text)], "paper_id string, page int, text string"), target, overlap).orderBy("chunk_no").collect()
        assert [r.text for r in rows] == want
        assert all(r.char_end - r.char_start == len(r.text) and " ".join(words)[: r.char_start] == " ".join(words)[: r.char_start].rstrip() for r in rows)


def test_rrf_ignores_channel_order(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "q_id int, doc_id int, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "q_id int, doc_id int, rank int")
    one = {r.doc_id: r.rrf for r in R.reciprocal_rank_fusion([a, b]).collect()}
    two = {r.doc_id: r.rrf for r in R.reciprocal_rank_fusion([b, a]).collect()}
    assert one == two and one[11] == pytest.approx(1 / 61 + 1 / 62)


def test_bm25_is_positive_and_handles_empty(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "gamma"), (3, None), (4, "")], "doc_id int, text string")
    q = spark.createDataFrame([(1, "alpha beta"), (2, "zeta"), (3, None)], "q_id int, text string")
    got = R.bm25(docs, q).collect()
    assert [(r.q_id, r.doc_id) for r in got] == [(1, 1)] and got[0].score > 0
    assert R.bm25(docs.limit(0), q).count() == 0


def test_claims_slice_back():
    text = "Fig. 2 shows 28.4 points [E1]. It holds, e.g. here [E2; 3]!\n# Head\n| a |\n```\ncode.\n```\n- Last one"
    for c in V.claims_of(text):
        assert text[c["start"] : c["end"]] == c["text"]
    assert [c["references"] for c in V.claims_of(text)] == [["E1"], ["E2", "3"], []]
    assert V.claims_of(None) == [] and V.claims_of("") == []


@pytest.mark.parametrize(
    "claim,evidence,label",
    [
        ("The model improves accuracy on translation", "Our model improves accuracy on translation tasks", "SUPPORTED"),
        ("The model improves accuracy", "The model never improves accuracy", "CONTRADICTED"),
        ("The model reaches 91.5 accuracy on translation", "The model reaches 88.0 accuracy on translation", "CONTRADICTED"),
        ("Quantum chemistry explains birds", "The model improves accuracy", "UNSUPPORTED"),
        ("anything", "", "UNSUPPORTED"),
        ("of a", "some evidence", "SUPPORTED"),
    ],
)
def test_support(spark, claim, evidence, label):
    df = spark.createDataFrame([(claim, evidence)], "c string, e string")
    assert df.select(V.support(F.col("c"), F.col("e"))["label"]).first()[0] == label


def test_corrupted_and_citations():
    assert V.corrupted("gets 2 of 10") == "gets 13 of 37" and "not" in V.corrupted("it is good")
    assert V.normalize_citations("A [E1, E4] b [E9] [p. 3]. c [E4]", ["E1", "E4"]) == "A [1][2] b. c [2]"


def test_chi2_tail():
    assert M.chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert M.chi2_tail(7.814728, 3) == pytest.approx(0.05, abs=1e-6)
    assert M.chi2_tail(2.0, 2) == pytest.approx(math.exp(-1), abs=1e-9)
    assert M.chi2_tail(0, 3) == 1.0


def test_friedman_with_ties(spark):
    data = {1: (1, 2, 3), 2: (2, 2, 3), 3: (1, 3, 3), 4: (1, 2, 2)}
    rows = spark.createDataFrame([(s, t, float(v)) for s, vs in data.items() for t, v in enumerate(vs)] + [(9, 0, 1.0)], "s int, t int, v double")
    rank_sums, ties = [0.0] * 3, 0
    for vs in data.values():
        ranks = [sum(x < v for x in vs) + (sum(x == v for x in vs) + 1) / 2 for v in vs]
        rank_sums = [a + b for a, b in zip(rank_sums, ranks)]
        ties += sum(k**3 - k for k in (ranks.count(r) for r in set(ranks)))
    q = (12 / (4 * 3 * 4) * sum(x * x for x in rank_sums) - 3 * 4 * 4) / (1 - ties / (4 * 24))
    got = M.friedman(rows, "s", "t", "v").first()
    assert got.q == pytest.approx(q) and got.df == 2 and got.n == 4


def test_bootstrap_draws_like_python(spark):
    rows = [("a", p, float((p * 7 + i) % 5)) for p in range(6) for i in range(3)]
    got = M.cluster_bootstrap(spark.createDataFrame(rows, "g string, p int, v double"), "g", "p", "v", draws=300).first()
    means = [sum(v for _, q, v in rows if q == p) / 3 for p in range(6)]
    rng = random.Random(2027)
    boot = sorted(sum(rng.choice(means) for _ in means) / 6 for _ in range(300))
    assert (got.ci_low, got.ci_high, got.clusters) == (boot[7], boot[292], 6)


def test_constant_columns_have_no_correlation(spark):
    df = spark.createDataFrame([("g", 1.0, 2.0), ("g", 1.0, 3.0)], "g string, x double, y double")
    assert M.pearson(df, "x", "y", ["g"]).first().r is None
    assert M.spearman(df, "x", "y", ["g"]).first().r is None


def test_kappa(spark):
    df = spark.createDataFrame([("g", a, b) for a, b in [("x", "x"), ("x", "y"), ("y", "y"), ("y", "y"), ("", "x"), (None, "y")]], "g string, a string, b string")
    assert M.cohens_kappa(df, "a", "b", ["g"]).first().kappa == pytest.approx((0.75 - (0.5 * 0.25 + 0.5 * 0.75)) / (1 - 0.5))


def test_pruning_is_the_greedy_walk(spark):
    rng = random.Random(3)
    for _ in range(3):
        nodes = [(1, f"n{i}", i, rng.choice(["text", "table", "visual"]), rng.choice(list(P.ROLE_WEIGHT)), rng.random()) for i in range(9)]
        kept, used = [], {"table": 0, "visual": 0}
        for n in sorted(nodes, key=lambda n: -(P.ROLE_WEIGHT[n[4]] + n[5])):
            if len(kept) >= 4:
                break
            if n[3] in used:
                if used[n[3]] >= 1:
                    continue
                used[n[3]] += 1
            kept.append(n[1])
        got = P.prune_to_budget(spark.createDataFrame(nodes, "q_id int, node_id string, pos int, modality string, role string, score double"), 4, 1, 1)
        assert {r.node_id for r in got.collect()} == set(kept)


@pytest.mark.parametrize(
    "question,parts",
    [
        ("Compare figure 1 and figure 2", ["Figure 1", "Figure 2"]),
        ("Tables 1, 2 and 3", ["Table 1", "Table 2", "Table 3"]),
        ("Difference between the encoder and the decoder?", ["encoder", "decoder"]),
        ("How does A1 compare to B2 in terms of latency", ["A1 latency", "B2 latency"]),
        ("approach A and approach B", ["approach A", "approach B"]),
        ("What is attention?", ["What is attention?"]),
    ],
)
def test_decompose(spark, question, parts):
    assert spark.createDataFrame([(question,)], "q string").select(P.decompose("q")).first()[0] == parts


def test_plan_faults(spark):
    nodes = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (3, "a")], "plan_id int, node_id string")
    edges = spark.createDataFrame([(1, "b", "a"), (2, "a", "b"), (2, "b", "a"), (3, "a", "z")], "plan_id int, node_id string, depends_on string")
    assert {(r.plan_id, r.fault) for r in P.plan_faults(edges, nodes).collect()} == {(2, "cycle"), (3, "repeated id"), (3, "unknown dependency")}


def test_plan_faults_rounds_do_not_pile_up(spark):
    nodes = [(p, str(i)) for p in (1, 2) for i in range(9)] + [(None, "a"), (3, None), (3, None), (4, "a")]
    edges = [(1, str(i), str(i - 1)) for i in range(1, 9)] + [(2, str(i), str((i + 1) % 9)) for i in range(9)] + [(None, "a", "a"), (3, "a", None), (4, "a", "a"), (4, "a", "a")]
    n = spark.createDataFrame(nodes, "plan_id int, node_id string")
    e = spark.createDataFrame(edges, "plan_id int, node_id string, depends_on string")
    want = [(None, "unknown dependency"), (2, "cycle"), (3, "repeated id"), (3, "unknown dependency"), (4, "cycle")]
    for small in (0, 10, P.SMALL_PLAN):
        got = P.plan_faults(e, n, small)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str), small
        assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 3  # not one a round


def test_universe_gaps(spark):
    axis = lambda c, vs: spark.createDataFrame([(v,) for v in vs], f"{c} {'int' if isinstance(vs[0], int) else 'string'}")
    expected = M.key_universe(axis("system", ["s"]), axis("model", ["m"]), axis("seed", [0, 1]), axis("case_id", [1, 2]))
    actual = spark.createDataFrame([("s", "m", 0, 1), ("s", "m", 0, 1), ("s", "m", 1, 2), ("t", "m", 0, 1)], "system string, model string, seed int, case_id int")
    got = {(r.system, r.seed, r.case_id, r.fault) for r in M.universe_gaps(expected, actual).collect()}
    assert got == {("s", 0, 2, "missing"), ("s", 1, 1, "missing"), ("t", 0, 1, "extra"), ("s", 0, 1, "repeated")}


def test_referents(spark):
    turns = [(1, 0, "user", "What is the Transformer model?"), (1, 1, "assistant", "An architecture."), (1, 2, "user", "How does it scale?"), (2, 0, "user", "it"), (3, 0, "user", "Plain question here")]
    got = {(r.conv_id, r.turn): r.resolved for r in C.resolved_queries(spark.createDataFrame(turns, "conv_id int, turn int, role string, text string")).collect()}
    assert got == {(1, 0): "What is the Transformer model?", (1, 2): "How does it scale? (context: the Transformer model)", (2, 0): "it", (3, 0): "Plain question here"}


def test_grounded(spark):
    df = spark.createDataFrame([(["alpha", "b.c", "zeta"], "Alpha uses b.c here")], "f array<string>, p string")
    assert df.select(C.grounded(F.col("f"), F.col("p"))).first()[0]


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([("p", 1), ("q", 2)], "paper_id string, n int")
    S.write_generation(a, f"{tmp_path}/g", "paper_id")
    S.write_generation(spark.createDataFrame([("p", 7)], "paper_id string, n int"), f"{tmp_path}/g", "paper_id")
    assert {(r.paper_id, r.n) for r in spark.read.parquet(f"{tmp_path}/g").collect()} == {("p", 7), ("q", 2)}
    path = S.publish(a, f"{tmp_path}/v", "1", [("rows", lambda d: d.count() == 2)])
    assert S.load_if_complete(spark, path, spark.createDataFrame([("p", 1), ("q", 1)], "paper_id string, n int")) is not None
    assert S.load_if_complete(spark, path, spark.createDataFrame([("p", 2)], "paper_id string, n int")) is None
    with pytest.raises(ValueError, match="rows"):
        S.publish(a, f"{tmp_path}/v", "2", [("rows", lambda d: d.count() == 3)])
    (tmp_path / "x.jsonl").write_text('{"k": 1}\n{"k": 2}\n')
    assert S.read_json_lines(spark, f"{tmp_path}/x.jsonl", "k int", ["k"]).count() == 2
    for bad in ('{"k": 1}', '{"k": 1}\n\n{"k": 2}\n', '{"k": 1}\n{"k": 1}\n'):
        (tmp_path / "y.jsonl").write_text(bad)
        with pytest.raises(ValueError):
            S.read_json_lines(spark, f"{tmp_path}/y.jsonl", "k int", ["k"])
    assert S.sql(spark, "SELECT n FROM {t} WHERE paper_id = :p", {"p": "q"}, t=a).first().n == 2
    assert S.canonical_json(spark.createDataFrame([(None, 1)], "b double, a int")).first().json == '{"a":1,"b":null}'
    assert "a \\& b" in S.latex_table(iter([{"x": "a & b"}]), ["x"])


def test_edits(spark):
    df = spark.createDataFrame([("héllo wörld", [(0, 1, "H"), (6, 7, "W")])], "t string, e array<struct<start:int,end:int,new:string>>")
    assert df.select(V.apply_edits(F.col("t"), F.col("e"))).first()[0] == "Héllo Wörld"


def test_order_statistic_and_merge(spark):
    rows = spark.createDataFrame([("g", float(v)) for v in range(1, 21)] + [("g", None)], "g string, v double")
    assert M.order_statistic(rows, "v", 0.95, ["g"]).first().v == 20.0
    a, b = (spark.createDataFrame(x, "k string, o int") for x in ([("x", 1), ("y", 2)], [("y", 0), ("z", 1)]))
    assert [r.k for r in R.merge_unique(a, b, "k", "o", 3).collect()] == ["x", "y", "z"]


def test_region_iou(spark):
    boxes = [(1, 1, 0.0, 0.0, 0.5, 0.5), (2, 1, 0.6, 0.6, 0.9, 0.9)]
    gold = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.5, 0.6), (2, 1, 0.0, 0.0, 0.3, 0.3), (3, 1, 0.0, 0.0, 0.1, 0.1)], "case_id int, page int, x0 double, y0 double, x1 double, y1 double")
    got = {r.case_id: r.hit for r in M.region_recall(spark.createDataFrame(boxes, gold.schema), gold).collect()}
    assert got == {1: 1, 2: 0, 3: 0}


def test_bridges_are_all_pairs(spark):
    texts = ["alpha beta gamma", "alpha beta zeta", "gamma delta alpha", "other words only"]
    nodes = [(1, i, i % 2, t) for i, t in enumerate(texts)]
    got = {(r.pos, r.pos2): r.shared for r in R.bridge_edges(spark.createDataFrame(nodes, "q_id int, pos int, source int, text string")).collect()}
    want = {}
    for a, b in itertools.combinations(nodes, 2):
        n = len(set(a[3].split()) & set(b[3].split()))
        if a[2] != b[2] and n >= 2:
            want[a[1], b[1]] = n
    assert got == want


def test_mutual_entailment(spark):
    from skarn.operators.reports import mutual_entailment

    rng = random.Random(3)
    rows = []
    for i in range(120):
        x = [rng.gauss(0, 1) + (2 if i % 3 == 0 else 0) for _ in range(6)]
        n = math.sqrt(sum(a * a for a in x))
        rows.append((i % 3, i, [a / n for a in x]))
    rows += [(7, 200, [1.0] + [0.0] * 5), (8, 201, [1.0] + [0.0] * 5), (8, 202, [0.0, 1.0] + [0.0] * 4), (None, 203, [1.0] * 6)]
    want = {}
    for k in {r[0] for r in rows} - {None}:
        own = [r for r in rows if r[0] == k]
        want[k] = sum(max((sum(a * b for a, b in zip(r[2], p[2])) for p in own if p[1] != r[1]), default=0.0) for r in own) / len(own)
    df = spark.createDataFrame(rows, "key int, sentence int, vector array<double>")
    for cell in (7, 2048):  # cells of a key change no result
        got = {r.key: r for r in mutual_entailment(df, cell).collect()}
        assert set(got) == set(want) and all(abs(got[k].score - want[k]) < 1e-9 for k in want)
        assert got[7].label == got[8].label == "CONTRADICTION" and got[0].label == "ENTAILMENT" and got[0].score < 1


def test_page_hints_and_zero_scores(spark):
    docs = spark.createDataFrame([(1, 1, "alpha beta gamma"), (2, 2, "delta words here"), (3, 2, "alpha alpha"), (4, 2, ""), (5, 3, "other text")], "doc_id int, page int, text string")
    queries = spark.createDataFrame([(1, "alpha gamma"), (2, "nothing shared")], "q_id int, text string")
    hints = spark.createDataFrame([(1, 2), (1, 2), (2, 3)], "q_id int, page int")
    table = lambda df: {(r.q_id, r.doc_id): r.score for r in df.collect()}
    for score, boost in ((R.bm25, 0.3), (R.keyword_overlap, 0.15)):
        plain = table(score(docs, queries))
        assert set(plain) == {(1, 1), (1, 3)}
        got = table(R.page_hints(score(docs, queries), docs, hints, boost))
        want = {(1, 1): plain[1, 1], (1, 2): boost, (1, 3): plain[1, 3] + boost, (2, 5): boost}  # an empty chunk gets no boost
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    plain, all_pairs = table(R.bm25(docs, queries)), table(R.with_zeros(R.bm25(docs, queries), docs, queries))
    assert all_pairs == {(q, d): plain.get((q, d), 0.0) for q in (1, 2) for d in (1, 2, 3, 5)}
