"""Answer scores with cited pages, faithfulness over the first chunks, and the entity that a reference is matched by."""

from skarn.operators import evidence as E
from skarn.operators import reports as R

FACT = "The encoder reaches high accuracy on the translation benchmark with dropout"


def test_answer_scores_with_pages(spark):
    rows = [(1, f"{FACT} [p. 1]. {FACT} [2]. Orchids bloom in jungles during warm and rainy months there [9].", 3, 1), (2, "Nothing is cited here although the sentence is long enough to count.", 3, None), (3, "", 3, 2)]
    pages = [(1, 1, FACT + " of the layers."), (1, 2, "Violins play quiet songs for nobody."), (2, 1, FACT)]
    got = {r.k: r for r in R.answer_scores(spark.createDataFrame(rows, "k int, answer string, n_pages int, gold_page int"), "k", spark.createDataFrame(pages, "k int, page int, text string")).collect()}
    a = got[1]
    assert (a.n_citations, a.invalid_page_rate, a.citation_precision, a.hallucination_rate, a.citation_recall, a.citation_f1, a.gold_cited) == (3, 0.333, 0.333, 0.667, 0.667, 0.444, 1)  # "[p. 1]" ends a sentence at its stop, so that one counts as uncited
    assert (got[2].n_citations, got[2].citation_precision, got[2].citation_recall, got[2].citation_f1, got[2].hallucination_rate, got[2].gold_cited) == (0, None, 0.0, None, None, None)
    assert (got[3].n_substantive, got[3].citation_recall, got[3].citation_f1, got[3].gold_cited) == (0, None, None, 0)


def test_faithfulness_takes_the_first_five_chunks(spark):
    claims = spark.createDataFrame([(1, FACT + ".")], "k int, text string")
    chunks = lambda at: spark.createDataFrame([(1, p, FACT if p == at else "violins play quiet songs") for p in range(8)], "k int, place int, text string")
    label = lambda at: R.faithfulness(claims, chunks(at), "k").first().label
    assert label(4) == "FAITHFUL" and label(5) == "UNFAITHFUL"


def test_a_reference_is_matched_by_the_first_entity_in_order(spark):
    refs = spark.createDataFrame([("s", 1, "alpha and zeta nets", "smith")], "source string, number int, text string, author string")
    entities = spark.createDataFrame([("s", 1, " Zeta "), ("s", 2, "alpha"), ("s", 0, "no")], "source string, place int, entity string")
    chunks = spark.createDataFrame([("s", 1, 1, "alpha alone"), ("s", 2, 2, "by zeta here"), ("s", 3, 3, "see [1]"), ("s", 4, 4, "Smith says")], "source string, doc_id int, ord int, text string")
    got = E.citing_chunks(refs, entities, chunks).collect()
    assert sorted((r.doc_id, r.entity, r.place) for r in got) == [(2, "zeta", 1), (3, "zeta", 2), (4, "zeta", 3)]
