"""The corpus pipeline: each stage on its own input, and run() against a brute-force version."""

import re

import pytest

import corpus_pipeline as P
from skarn.llm import entry
from tests.llm.test_llm import dedup_want, groups_want, secret_want

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf01():
    return "/root/testdata/sf0.01"


def as_rows(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def test_stage_names():
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "exact_dedup", "ngram_jaccard_join", "secret_scans", "best_fit_packing"]


def test_stages_on_hard_rows(spark, docs, rows, sf01):
    plain = docs.select(*COLUMNS)
    distinct = list(dict.fromkeys(rows))
    kept = {w[0] for w in dedup_want(distinct) if w[3]}
    out = P.exact_dedup_stage(spark, plain, sf01)
    assert out.columns == COLUMNS and sorted(r[0] for r in as_rows(out)) == sorted(kept)
    near = P.near_dedup_stage(spark, out, sf01)
    left = [r for r in distinct if r[0] in kept]
    assert sorted(r[0] for r in as_rows(near)) == sorted(w[0] for w in groups_want(left, 5, 80) if w[0] == w[2])
    masked = {r[0]: r for r in as_rows(P.secrets_stage(spark, near, sf01))}
    for r in as_rows(near):
        new = masked[r[0]]
        assert secret_want(new[1]) == "" and (new == r) == (secret_want(r[1]) == "")
        assert new[4] == (len(new[1]) if secret_want(r[1]) else r[4])


def test_one_row_of_a_group_stays_whatever_the_ids(spark, sf01):
    text = lambda k, n=60: " ".join(f"w{k}x{i}" for i in range(n))
    rows = [(1, text("a")), (2, text("a") + " more"), (2, text("b")), (None, text("c")), (None, text("c") + " more"), (None, text("d")), (3, text("d") + " more"), (4, text("e")), (4, text("e"))]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    near = [(r[0], r[1]) for r in as_rows(P.near_dedup_stage(spark, docs, sf01))]
    assert len(near) == 5 and {(1, text("a")), (2, text("b")), (3, text("d") + " more"), (4, text("e"))} < set(near)
    assert sum(t.startswith("wcx") for _, t in near) == 1
    same = [(5, "one two"), (5, "one  two"), (None, "three"), (None, "thr ee"), (6, "four"), (6, "four"), (6, "five")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in same], "doc_id long, text string, lang string, source string, n_chars long")
    left = [(r[0], r[1]) for r in as_rows(P.exact_dedup_stage(spark, docs, sf01))]
    assert sorted(left, key=str) == sorted([(5, "one  two"), (None, "thr ee"), (6, "four"), (6, "five")], key=str)


def test_empty_tables(spark, empty, sf01):
    for _, stage in P.STAGES:
        assert stage(spark, empty, sf01).count() == 0


def test_run_equals_brute_force(spark, sf01):
    """run() keeps exactly what the quality scores, then plain Python dedup and joins, keep; and packs all of it."""
    docs = spark.read.parquet(f"{sf01}/documents.parquet")
    good = {r.doc_id for r in entry.op6_lsa_knn_quality(spark, sf01).filter("predicted = 1").collect()}
    rows = [r for r in as_rows(docs) if r[0] in good]
    kept = {w[0] for w in dedup_want(rows) if w[3]}
    rows = [r for r in rows if r[0] in kept]
    # only texts that share a shingle can link: compare those of equal first or last words' shingles
    seen, pairs = {}, set()
    for r in rows:
        words = [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", r[1])]
        for i in range(len(words) - 4):
            other = seen.setdefault(tuple(words[i : i + 5]), r[0])
            if other != r[0]:
                pairs.update((other, r[0]))
    some = [r for r in rows if r[0] in pairs]
    gone = {w[0] for w in groups_want(some, 5, 80) if w[0] != w[2]}
    want = {r[0] for r in rows} - gone
    got = P.run(spark, sf01)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == want
