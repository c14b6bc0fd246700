"""Top-k over terms with bounds equals the exhaustive ranking, and reads far fewer pairs."""

import random

import pytest
from pyspark.sql import functions as F

from skarn.operators import retrieval as R
from skarn.operators import sparse as S


def corpus(spark, seed, n=600):
    """Common words in nearly every text, rare ones in few; nulls, empty texts and copies."""
    rng = random.Random(seed)
    rare = [f"rare{i}" for i in range(150)]
    texts = [" ".join(rng.choices(["model", "data", "the", "paper", "train"], k=rng.randrange(3, 20)) + rng.choices(rare, k=rng.randrange(0, 4))) for _ in range(n)]
    texts += [None, "", texts[3], texts[3], "model " * 200]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    asked = [(i, " ".join(rng.choices(rare, k=2) + ["model", "data", "paper"])) for i in range(9)] + [(100, "model"), (101, "model data"), (102, None), (103, "unseen"), (104, "rare1 rare1 rare2")]
    return docs, spark.createDataFrame(asked, "q_id int, text string")


def rows(df):
    return {(r.q_id, r["rank"], r.doc_id, round(r.score, 6)) for r in df.collect()}


@pytest.mark.parametrize("k,block", [(5, 16), (3, 128), (2000, 16)])
def test_equal_to_all_pairs(spark, k, block, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", block)
    docs, asked = corpus(spark, k)
    every = lambda scored: rows(R.top_k(scored.withColumn("key", F.round("score", 9)), k, "key"))
    assert rows(S.bm25_topk(docs, asked, k)) == every(R.bm25(docs, asked))
    assert rows(S.overlap_topk(docs, asked, k)) == every(R.keyword_overlap(docs, asked))


def test_common_terms_make_few_pairs(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 16)
    docs, asked = corpus(spark, 1, 3000)
    asked = asked.filter("q_id < 9")
    impacts, weights = S.bm25_parts(docs, asked)
    pairs, all_pairs = S.candidates(impacts, weights, 5).count(), R.bm25(docs, asked).count()
    assert all_pairs > 9 * 2500 and pairs < 0.1 * all_pairs


def test_empty_tables(spark):
    docs, asked = corpus(spark, 2, 20)
    for f in (S.bm25_topk, S.overlap_topk):
        assert f(docs.limit(0), asked, 3).count() == 0 and f(docs, asked.limit(0), 3).count() == 0
