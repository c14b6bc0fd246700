"""Cases of the training-data operators that random rows seldom hold."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skarn.llm import common, exact_dedup, folds, language_mixture, license_rules, lsa_knn, secret_ledger, signature_join


def test_one_row_of_a_repeated_id_is_kept(spark):
    rows = [(5, "abc"), (5, "a b c"), (5, "a b c"), (6, "a b c"), (7, "other"), (None, "a b c"), (None, "only")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for bits in (0, 16, 28):  # by a join, a small bitmap and a large one
        got = exact_dedup.exact_dedup(d, carry={"t": F.col("text")}, bitmap_bits=bits).collect()
        assert sorted((r.doc_id, r.t, r.keep_id, r.group_size) for r in got if r.kept and r.doc_id) == [(5, "a b c", 5, 5), (5, "a b c", 5, 5), (7, "other", 7, 1)]
        assert [(r.t, r.keep_id) for r in got if r.doc_id is None and r.kept] == [("only", None)]


def test_marked_keys_are_the_same_by_bitmap_and_join(spark):
    d = spark.range(2000).withColumn("x", F.col("id").cast("string"))
    keys = spark.range(0, 2000, 7).select(F.col("id").cast("string").alias("x"))
    for bits in (0, 28):
        got = {r.id for r in common.mark_keys(d, F.col("x"), keys, "hit", bits).filter("hit").collect()}
        assert set(range(0, 2000, 7)) <= got and len(got) < 600
    assert common.mark_keys(d, F.col("x"), keys.limit(0), "hit").filter("hit").count() == 0


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 3000])
def test_running_sums_and_maxima(spark, n):
    v = np.random.default_rng(n).integers(0, 50, n).tolist()
    d = spark.createDataFrame([(v,)], "v array<int>")
    got = d.select(common.running(F.col("v")).alias("s"), common.running(F.col("v"), F.greatest).alias("m")).first()
    assert got.s == [sum(v[:i]) for i in range(n)] and got.m == [max(v[:i], default=0) for i in range(n)]


def test_a_text_of_very_many_secrets(spark):
    n = 20_000
    text = "".join(f"token={i:08d} " for i in range(n))
    d = spark.createDataFrame([(text,)], "text string")
    got = d.select(F.size(secret_ledger.secret_spans(F.col("text"))).alias("n"), secret_ledger.redacted(F.col("text"), secret_ledger.secret_spans(F.col("text"))).alias("t")).first()
    assert got.n == n and got.t == "[secret] " * n
    long = "\n".join(["Released under the MIT License.", "And more of it."] * 3000)
    found = license_rules.recognise_licenses(spark.createDataFrame([(1, long, "mine")], "doc_id long, text string, licenses string")).first()
    assert found.n_license_sentences == 3000 and found.licenses == "MIT" and found.license_ids.endswith("5998:mit-name")


def test_smallest_hashes_are_the_smallest(spark):
    d = spark.range(30_000).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    sizes = {r.y: r["count"] for r in d.groupBy("y").count().collect()}
    got = folds.smallest_hashes(d, "y", sizes, 500).collect()
    hashed = d.select("doc_id", "y", F.xxhash64("doc_id").alias("h")).collect()
    for y in (0, 1):
        want = sorted((r.h, r.doc_id) for r in hashed if r.y == y)[:500]
        assert {r.doc_id for r in got if r.y == y} == {i for _, i in want}


def test_quality_equals_plain_neighbours(spark):
    """The query's scores from the labelled texts themselves: features by hand, dense vectors, sorted neighbours; the latent
    directions hold nearly what the best possible ones, of numpy's SVD, hold."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in lsa_knn.quality(docs, labels).collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    y = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None and not got[r.doc_id].held_out}
    ids = sorted(y, key=str)

    def letters(word):
        return bytes(c for c in word if chr(c).isascii() and chr(c).isalpha() or c >= 128)

    def dense(t):
        """Hashed features of a text, one word after another."""
        v, words, lines = np.zeros(lsa_knn.BUCKETS), t.split(), t.split(b"\n")
        for w in words:
            core = letters(w.lower())
            marks = bytes(c for c in w if not (chr(c).isascii() and chr(c).isalpha() or c >= 128))
            marks = bytes(sorted(set(marks)))
            caps = "l" if w.lower() == w else "U" if core and len(w) > 1 and w.upper() == w else "t"
            for name in (b"w" + core if len(core) < 5 else b"e" + core[-3:], f"s{caps}{min(len(core), 12)}|".encode() + marks, b"m" + marks, b"c" + caps.encode(), b"n%d" % min(len(w), 15)):
                v[zlib.crc32(name) % lsa_knn.BUCKETS] += 1
        if words:
            for name in (f"ratio{min(9, 10 * len(set(words)) // len(words))}", f"same{min(9, 10 * len(set(lines)) // len(lines))}"):
                v[zlib.crc32(name.encode()) % lsa_knn.BUCKETS] += 2 * len(words)
        return np.log1p(v)

    a = np.array([dense(texts[i]) for i in ids])
    idf = np.log((1 + len(ids)) / (1 + (a > 0).sum(0))) + 1
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    model, _ = lsa_knn.fit(docs, labels)
    assert np.allclose(model.idf, idf, atol=1e-5)
    best = np.linalg.svd(unit(a * idf), compute_uv=False)[: model.axes.shape[1]]
    assert np.allclose(model.axes.T @ model.axes, np.eye(model.axes.shape[1]), atol=1e-3)
    assert (np.linalg.norm(unit(a * idf) @ model.axes) ** 2) > 0.97 * (best**2).sum()
    known = unit(unit(a * idf) @ model.axes)
    assert np.allclose(np.abs(known @ known.T), np.abs(model.vectors @ model.vectors.T), atol=1e-4)
    weight = np.array([len(ids) / (2 * sum(v == y[i] for v in y.values())) for i in ids])
    label = np.array([y[i] for i in ids])
    for doc, text in list(texts.items()):
        if not text.split():
            continue
        sims = (unit(unit((dense(text) * idf)[None]) @ model.axes) @ known.T)[0]
        top = np.argsort(-sims, kind="stable")[: lsa_knn.NEIGHBOURS]
        power = np.exp(lsa_knn.SHARPNESS * (sims[top] - sims.max())) * weight[top]
        assert got[doc].score == pytest.approx(((power * label[top]).sum() / power.sum()) ** lsa_knn.EXPONENT, abs=2e-3)


def test_languages_equal_plain_expectation_maximisation(spark):
    """The mixture of every text by loops over its trigrams, which are cut and hashed here, from models counted here."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumns({"key": F.lit(1), "lang_pred": F.lit("x")})
    rows = docs.collect()
    got = {r.doc_id: r for r in language_mixture.languages(docs).collect()}
    langs = sorted({r.lang for r in rows if r.lang and not got[r.doc_id].held_out})

    def grams_of(text):
        low = "".join(c.lower() if c.isalpha() else c if ord(c) >= 128 and not (0x80 <= ord(c) < 0xC0 or c in "×÷" or 0x2000 <= ord(c) < 0x2070) else " " for c in text or "")
        raw = b" " + b" ".join(low.encode().split(b" ")) + b" "
        raw = b" " + b" ".join(x for x in raw.split(b" ") if x) + b" "
        return [((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761 % 2**32) >> 17 for i in range(len(raw) - 2)]

    counts = np.zeros((1 << language_mixture.BITS, len(langs)))
    for r in rows:
        if r.lang and not got[r.doc_id].held_out:
            np.add.at(counts, (grams_of(r.text), langs.index(r.lang)), 1)
    p = (counts + 0.05) / (counts + 0.05).sum(0)
    for r in rows:
        grams = np.array(grams_of(r.text), int)
        if not len(grams) or not re.search(r"[^\W\d_]", r.text):
            assert got[r.doc_id].lang_pred == "und"
            continue
        logs = np.log(p[grams]).sum(0)
        chosen, w, best = [int(np.argmax(logs))], np.ones(1), logs.max()
        while len(chosen) < len(langs):
            mixed = p[grams][:, chosen] @ w
            rest = [k for k in range(len(langs)) if k not in chosen]
            trial = [*chosen, max(rest, key=lambda k: (p[grams, k] / mixed).sum())]
            new = np.append(w * (1 - 1 / len(trial)), 1 / len(trial))
            for _ in range(language_mixture.ROUNDS):
                part = p[grams][:, trial] * new
                new = (part / part.sum(1, keepdims=True)).mean(0)
            value = np.log(p[grams][:, trial] @ new).sum()
            if value - best <= language_mixture.PENALTY * np.log(len(grams) + 1):
                break
            chosen, w, best = trial, new, value
        assert got[r.doc_id].lang_pred == langs[chosen[int(np.argmax(w))]]
        assert {k: pytest.approx(v, abs=1e-6) for k, v in got[r.doc_id].lang_mix.items()} == dict(zip((langs[k] for k in chosen), w))


def test_many_languages(spark):
    """450 languages with words of their own are told apart; a model of very many keeps its size by coarser trigrams."""
    word = lambda k: "".join(chr(97 + k // 26**i % 26) * 2 for i in range(3))
    rows = [(k * 12 + j, " ".join([word(k), word(k) + "s", f"x{word(k)}"] * 3), f"l{k:03d}") for k in range(450) for j in range(12)]
    got = language_mixture.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).join(spark.createDataFrame(rows, "doc_id long, text string, lang string").select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == len(rows) and sum(r.lang == r.lang_pred for r in got) > 0.95 * len(rows)
    bits = [language_mixture.bits_for(n) for n in (0, 400, 401, 801, 50_000, 10**7)]
    assert bits == [15, 15, 14, 13, 8, 8]


def test_a_blob_that_is_twice_in_the_ledger_counts_once(spark, tmp_path):
    d = spark.createDataFrame([(1, "password = abcdefgh1"), (2, "password = abcdefgh1"), (3, "clean")], "doc_id long, text string")
    ledger = f"file://{tmp_path}/ledger"
    first = sorted(map(str, secret_ledger.scan_secrets(d, ledger).collect()))
    spark.read.parquet(ledger).write.mode("append").parquet(f"{ledger}-twice")
    for _ in range(2):  # as two runs at once would leave it
        spark.read.parquet(f"{ledger}-twice").write.mode("append").parquet(ledger)
    assert sorted(map(str, secret_ledger.scan_secrets(d, ledger).collect())) == first and len(first) == 3


def test_language_of_repeated_and_very_long_rows(spark):
    long = "the house and the garden with a tree " * 20_000
    rows = [(i, f"the house and the garden {i}" if i % 2 else f"la maison et le jardin {i}", "en" if i % 2 else "fr") for i in range(40)]
    d = spark.createDataFrame([*rows, rows[0], (99, long, None)], "doc_id long, text string, lang string").withColumns({"held_out": F.lit(1), "score": F.lit("x")})
    got = language_mixture.languages(d).collect()
    assert len(got) == 42 and [r.lang_pred for r in got if r.doc_id == 99] == ["en"] and len({(r.lang_pred, r.score) for r in got if r.doc_id == 0}) == 1


def test_a_new_link_joins_two_groups(spark):
    comp = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5), (9, 9)], "key long, comp long")
    got = {r.key: r.comp for r in signature_join.joined(comp, spark.createDataFrame([(2, 6), (7, 8), (6, 5)], "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 5: 1, 6: 1, 7: 7, 8: 7, 9: 9}


@pytest.mark.parametrize("texts", [["a b c d e", "a b c d e f"], ["a b c d"], ["a b c d", "a b c d", None, "x"], ["x"] * 3 + ["y"], [None, ""]])
def test_joins_of_few_texts(spark, texts):
    """Corpora in which every shingle is shared, none is, or there is none."""
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in signature_join.linked_groups(d).collect()}
    same = {i: min(j for j, u in enumerate(texts) if u == t) if t and t.split() else i for i, t in enumerate(texts)}
    assert {i: c for i, (_, c) in got.items()} == same
