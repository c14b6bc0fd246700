"""Phrases in texts against Python's `in`, for phrases that start and end inside words, short ones, blanks and nulls."""

import random

import pytest

from skarn.operators.matching import phrase_hits


def cut(rng, text):
    a = rng.randrange(len(text))
    return text[a : a + rng.choice([1, 2, 3, 5, 9, 17, 40, 90])]


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_substrings(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randrange(1, 6)))
    texts = [(i, "".join(word() + rng.choice([" ", " ", "  ", "\n", "\t", "."]) for _ in range(rng.randrange(1, 40)))) for i in range(120)]
    texts += [(200, None), (201, ""), (202, "   "), (None, "abc abc abc abc abc abc"), (203, texts[0][1])]
    phrases = {cut(rng, rng.choice(texts[:120])[1]) for _ in range(150)} | {"a", "ab", "é", "zz", "b b", "abc abc abc abc abc", " abc ", "no such phrase is in any of them"}
    want = {(k, p) for k, t in texts for p in phrases if t and p.strip() and p in t}
    rows = [(p, 1) for p in phrases] + [(None, 1), ("", 1), (" \n", 1), ("a", 2)]
    got = phrase_hits(spark.createDataFrame(texts, "id int, body string").repartition(3), "id", "body", spark.createDataFrame(rows, "p string, q int"), "p")
    assert got.columns == ["id", "p"]
    found = [tuple(r) for r in got.collect()]
    assert set(found) == want and len(found) == len(want)


def test_empty_tables(spark):
    texts, phrases = spark.createDataFrame([(1, "a b c d e f")], "id int, body string"), spark.createDataFrame([("b c d",), ("a",)], "p string")
    assert phrase_hits(texts.limit(0), "id", "body", phrases, "p").count() == 0
    assert phrase_hits(texts, "id", "body", phrases.limit(0), "p").count() == 0
    assert phrase_hits(texts, "id", "body", phrases, "p").count() == 2
