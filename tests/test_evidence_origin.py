"""Evidence origin through verification, numbering of evidence, repair records and final citations, case by case."""

import pytest

from skarn.operators import verify as V

DOTS = "The Transformer uses scaled dot-product attention"
BERT = "BERT pre-trains deep bidirectional representations"
FIELDS = "d int, ref string, ord int, text string, evidence_id string, origin string, chunk_type string, is_page boolean, observed_by_model boolean, imputed boolean, is_table boolean"


def evidence(spark, rows):
    """rows: dicts of the fields."""
    names = [c.split()[0] for c in FIELDS.split(", ")]
    return spark.createDataFrame([tuple({"d": 1, **r}.get(n) for n in names) for r in rows], FIELDS)


def outcome(spark, answer, rows, mode="SELECTIVE", abstain=True):
    answers = spark.createDataFrame([(1, answer, mode)], "d int, answer string, mode string")
    done = V.Repair(answers, evidence(spark, rows), ["d"], "d", abstain)
    edits = sorted(done.edits().collect(), key=lambda r: r.start)
    cited = {r.ref_id: r for r in done.citations().collect()}
    return done.outcomes().first(), edits, cited, done


def labels(spark, answer, rows):
    answers = spark.createDataFrame([(1, answer)], "d int, answer string")
    claims = V.labelled(V.parse_claims(answers, ["d"], "answer"), evidence(spark, rows), ["d"], "d")
    return [(r.label, r.origins) for r in sorted(claims.collect(), key=lambda r: r.start)], V.verification_report(answers, claims, ["d"]).first()


@pytest.mark.parametrize(
    "fields,origin",
    [
        ({}, V.TEXT), ({"chunk_type": "Table"}, V.TABLE), ({"is_table": True, "is_page": True}, V.TABLE), ({"is_page": True}, V.PIXELS), ({"observed_by_model": True}, V.PIXELS),
        ({"imputed": True}, V.IMPUTED), ({"origin": "SOURCE_PIXELS", "chunk_type": "table"}, V.PIXELS), ({"origin": "nonsense", "imputed": True}, V.IMPUTED), ({"origin": V.OBSERVED}, V.OBSERVED),
    ],
)
def test_origin_and_text(spark, fields, origin):
    r = V.prepared(evidence(spark, [{"ref": "1", "ord": 1, "text": "said", **fields}]), "d").first()
    assert r.origin == origin and r.text == ("said" if origin in (V.TEXT, V.TABLE) else "")


def test_pixels_alone_are_neither_support_nor_its_absence(spark):
    page = {"ref": "1", "ord": 1, "text": "a model saw dot-product attention", "is_page": True}
    found, report = labels(spark, f"{DOTS} [1].", [page])
    assert found == [("UNVERIFIED_VISUAL", [V.PIXELS])]
    assert (report.unverified_visual_count, report.unverified_visual_claim_rate, report.unsupported_claim_rate, report.abstains, report.overall_supported) == (1, 1.0, 0.0, False, False)
    text = {"ref": "2", "ord": 2, "text": DOTS}
    found, report = labels(spark, f"{DOTS} [1][2].", [page, text])
    assert found == [("SUPPORTED", [V.PIXELS, V.TEXT])] and report.overall_supported
    found, _ = labels(spark, f"{DOTS} [1].", [{**page, "origin": V.OBSERVED}])
    assert found[0][0] == "UNSUPPORTED", "what a model has seen is no evidence, and no pixels to look at either"


def test_visual_claims_are_left_alone_and_hold_back_abstention(spark):
    page, text = {"ref": "1", "ord": 1, "text": "", "is_page": True}, {"ref": "2", "ord": 2, "text": BERT}
    answer = "The curve rises after epoch nine [1]. Violins play quiet songs for nobody [2]."
    done, edits, cited, _ = outcome(spark, answer, [page, text])
    assert done.final_answer == "The curve rises after epoch nine [1]." and not done.abstained and not done.reverified
    assert [(e.action, e.initial_status) for e in edits] == [("CLAIM_DELETION", "UNSUPPORTED")]
    assert (cited[1].verification, cited[1].confidence, cited[1].repair_origin) == ("UNVERIFIED_VISUAL", 0.0, None)


def test_evidence_is_numbered_in_order(spark):
    rows = [{"ref": r, "ord": i, "text": t, "evidence_id": e} for i, (r, t, e) in enumerate([("1", "a", "x"), ("1", "b", "y"), ("2", "c", "z"), (None, "d", None), ("7", "e", "x"), ("1", "a", "x"), ("E_3", "f", "w"), ("odd", "g", None)])]
    got = [(r.ref, r.ref_id, r.text) for r in sorted(V.prepared(evidence(spark, rows), "d").collect(), key=lambda r: r.ord)]
    assert got == [("x", 1, "a"), ("y", 2, "b"), ("z", 3, "c"), ("E_3", 4, "d"), ("x", 7, "e"), ("w", 8, "f"), ("odd", 9, "g")]
    answers = spark.createDataFrame([(1, "One [E_x]. Two [3]. Three [E3].")], "d int, answer string")
    rows = [{"ref": "1", "ord": 1, "text": "first", "evidence_id": "E_x"}, {"ref": "2", "ord": 2, "text": "second", "evidence_id": "E_x"}, {"ref": "3", "ord": 3, "text": "third", "evidence_id": "q"}]
    found = V.resolve(V.parse_claims(answers, ["d"], "answer"), evidence(spark, rows), ["d"], "d").collect()
    assert {r.claim_id: (r.evidence, r.numbers) for r in found} == {"C1": ("second", [2]), "C2": ("third", [3]), "C3": ("third", [3])}, "of one name the last row is meant"


def test_supported_claims_stay(spark):
    done, edits, cited, _ = outcome(spark, f"{DOTS} [1].", [{"ref": "1", "ord": 1, "text": f"{DOTS}."}])
    assert done.final_answer == f"{DOTS} [1]." and not edits and done.reverified and cited[1].verification == "SUPPORTED"


def test_no_repair_changes_nothing_and_remap_only_just_remaps(spark):
    rows = [{"ref": "1", "ord": 1, "text": f"{BERT}."}, {"ref": "2", "ord": 2, "text": "Photosynthesis turns light to sugar."}]
    answer = f"{BERT} [2]."
    done, edits, cited, _ = outcome(spark, answer, rows, "NONE")
    assert (done.final_answer, edits, cited, done.reverified) == (answer, [], {}, False)
    done, edits, cited, _ = outcome(spark, answer, rows, "CITATION_REMAP_ONLY")
    assert done.final_answer == f"{BERT} [1]."
    (e,) = edits
    assert (e.action, e.original_text, e.replacement_text, e.initial_status, e.second_pass_status, e.original_refs, e.resolved_refs, e.remap_attempted) == ("CITATION_REMAP", answer, f"{BERT} [1].", "UNSUPPORTED", "SUPPORTED", ["2"], ["1"], True)
    assert (cited[1].verification, cited[1].repair_origin) == ("SUPPORTED", "REMAPPED")


def test_partial_claims_are_narrowed_to_their_own_words(spark):
    answer = f"{DOTS} and quantum violins sing opera during foggy lunar weekends abroad yearly beyond remote galaxies [1]."
    done, edits, _, _ = outcome(spark, answer, [{"ref": "1", "ord": 1, "text": DOTS}])
    assert done.final_answer == f"{DOTS} [1]."
    assert [(e.action, e.initial_status, e.second_pass_status, e.start, e.end) for e in edits] == [("CLAIM_NARROWING", "PARTIAL", "SUPPORTED", 0, len(answer))]
    assert set(edits[0].replacement_text.split()) <= set(answer.split()) | {"attention", "[1]."}


def test_unsupported_and_contradicted_claims_go_and_a_lonely_one_ends_in_abstention(spark):
    rows = [{"ref": "1", "ord": 1, "text": f"{DOTS}. The model reaches 28.4 BLEU on translation."}]
    done, edits, _, _ = outcome(spark, f"{DOTS} [1]. Photosynthesis feeds orchids in jungles [1].", rows)
    assert done.final_answer == f"{DOTS} [1]." and [e.action for e in edits] == ["CLAIM_DELETION"] and done.reverified
    done, edits, _, _ = outcome(spark, "The model reaches 28.4 BLEU on translation [1]. The model reaches 99.5 BLEU on translation [1].", rows)
    assert "28.4" in done.final_answer and "99.5" not in done.final_answer and edits[0].initial_status == "CONTRADICTED"
    done, edits, cited, work = outcome(spark, "Photosynthesis feeds orchids in jungles [1].", rows)
    assert done.final_answer == V.ABSTENTION and done.abstained and [(e.action, e.claim_id, e.start, e.end) for e in edits] == [("ABSTAIN", "ABSTAIN", 0, 44)] and not cited
    done, edits, _, _ = outcome(spark, "Photosynthesis feeds orchids in jungles [1].", rows, abstain=False)
    assert done.final_answer == "" and not done.abstained and [e.action for e in edits] == ["CLAIM_DELETION"]


def test_every_record_changes_the_text_it_names(spark):
    rows = [{"ref": "1", "ord": 1, "text": f"{DOTS}."}, {"ref": "2", "ord": 2, "text": f"{BERT}."}]
    answer = f"- {DOTS} [2].\n- The paper does not mention bananas [1].\n- Orchids bloom in jungles.\n\n{BERT} [2]."
    done, edits, _, _ = outcome(spark, answer, rows)
    assert all(answer[e.start : e.end] == e.original_text != e.replacement_text for e in edits) and len(edits) == done.n_edits == 3
    assert done.final_answer == f"- {DOTS} [1].\n- The paper does not mention bananas.\n\n{BERT} [2]."


def test_answers_without_evidence_and_empty_tables(spark):
    done, edits, cited, _ = outcome(spark, "", [])
    assert done.final_answer == "" and not done.abstained and not edits and not cited
    done, edits, _, _ = outcome(spark, "Orchids bloom.", [])
    assert done.abstained and [e.action for e in edits] == ["ABSTAIN"]
    nothing = V.Repair(spark.createDataFrame([], "d int, answer string, mode string"), evidence(spark, []), ["d"], "d")
    assert nothing.outcomes().count() == nothing.edits().count() == nothing.citations().count() == 0
