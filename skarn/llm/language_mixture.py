"""Operator 7: language identification by multilingual mixture inference.

A language is a distribution over hashed character trigrams (UTF-8 bytes of the lower-cased letters, words padded with
blanks). A text is a mixture of languages: expectation-maximisation estimates the proportions from the trigram
likelihoods. The language set grows one language at a time while the likelihood, penalised by PENALTY * log(trigrams)
for each language, improves. The prediction is the language with the largest
proportion; score is its proportion times how sure the set's first language is against the runner-up, from 0 to 1.

`und` with score 0 where the text is null or has no letter, or nothing was learnt. Learning uses at most MAX_TEXTS
whole texts of each language, those with the smallest hash of doc_id outside the held-out fold, a documented bound; a
language that occurs only in the held-out fold or is null is not learnt. Every input row gives one output row; extra
columns are ignored; an empty table gives no rows.

Plan: learning counts trigrams in one distributed map with partial sums; the model is broadcast. It has 2**BITS buckets a
language, and fewer from 401 languages on, so that it stays below some 100 MB up to 51,200 languages. Scoring is one map
over the scan without a shuffle of the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.folds import held_out, smallest_hashes
from skarn.llm.word_ids import slices

BITS = 15
MAX_TEXTS = 2000
PENALTY = 4.0
ROUNDS = 12
NUMBERS = 400 << BITS  # a model of more numbers has fewer trigram buckets a language, LEAST_BITS at least
LEAST_BITS = 8
BROADCAST_ROWS = 1_000_000  # light rows of labelled texts; more are joined

#: ASCII letters to lower case, other ASCII to blanks, all other bytes as they are.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: The same on the level of whole characters that are not ASCII, for texts that have such marks.
SMALL = {**{c: c + 32 for c in range(0xC0, 0xDF) if c != 0xD7}, **{c: " " for c in (*range(0x80, 0xAA), *range(0xAB, 0xB5), *range(0xB6, 0xBA), *range(0xBB, 0xC0), 0xD7, 0xF7, *range(0x2000, 0x2070))}}


def bits_for(languages: int) -> int:
    """Bits of a trigram id: BITS for up to 400 languages, then one less each time their number doubles."""
    bits = BITS
    while bits > LEAST_BITS and languages << bits > NUMBERS:
        bits -= 1
    return bits


def trigrams(text: bytes | None, bits: int = BITS) -> np.ndarray:
    """Hashed trigram ids of a whole text; empty when it has no letter."""
    if not text:
        return np.zeros(0, np.int64)
    if not text.isascii():
        text = text.decode("utf-8", "replace").translate(SMALL).encode()
    raw = b" " + b" ".join(text.translate(FOLD).split()) + b" "
    if len(raw) < 3:
        return np.zeros(0, np.int64)
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    return (((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(32 - bits)).astype(np.int64)


#: ASCII bytes that are no letters.
NO_LETTER = bytes(c for c in range(128) if not (65 <= c <= 90 or 97 <= c <= 122))


def has_letter(text: bytes | None) -> bool:
    """Whether a character of the text is a letter."""
    rest = (text or b"").translate(None, NO_LETTER)
    return bool(rest) and (not rest.translate(None, HIGH) == b"" or any(c.isalpha() for c in rest.decode("utf-8", "replace")))


HIGH = bytes(range(128, 256))


class Mixture:
    """languages, their prior and log-likelihoods [bucket, language]."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts + 0.05
        self.p = (smooth / smooth.sum(0, keepdims=True)).astype(np.float64)

    @classmethod
    def of(cls, state: dict) -> Mixture:
        found = cls.__new__(cls)
        vars(found).update(state)
        return found

    def infer(self, text: bytes | None) -> tuple[str, float, dict[str, float]]:
        """(language, score, proportions of the chosen set)."""
        if not self.languages or not has_letter(text):
            return "und", 0.0, {}
        bits = len(self.p).bit_length() - 1
        ids = trigrams(text, bits)
        if not len(ids):  # letters that leave no trigram
            ids = trigrams(b"e", bits)
        n = np.bincount(ids, minlength=len(self.p))
        at = np.flatnonzero(n)
        like, n = self.p[at], n[at].astype(np.float64)
        total = n.sum()
        logs = n @ np.log(like)
        order = np.argsort(-logs, kind="stable")
        chosen, weights, best = [int(order[0])], np.ones(1), logs[order[0]]
        cost = PENALTY * np.log(total + 1)
        while len(chosen) < len(self.languages):
            # the language that explains best what the set explains badly
            mixed = like[:, chosen] @ weights
            gain = (n / mixed) @ like
            gain[chosen] = -1.0
            trial = [*chosen, int(np.argmax(gain))]
            w = np.append(weights * (1 - 1 / len(trial)), 1 / len(trial))
            for _ in range(ROUNDS):  # expectation and maximisation in one step
                part = like[:, trial] * w
                w = (n[:, None] * part / part.sum(1, keepdims=True)).sum(0) / total
            value = n @ np.log(like[:, trial] @ w)
            if value - best <= cost:
                break
            chosen, weights, best = trial, w, value
        top = int(np.argmax(weights))
        others = np.delete(logs, chosen[top])
        margin = (logs[chosen[top]] - others.max()) / np.sqrt(total) if len(others) and len(chosen) == 1 else 1.0
        sure = 1 / (1 + np.exp(-np.clip(4 * margin, -30, 30)))
        return self.languages[chosen[top]], float(weights[top] * sure), {self.languages[k]: float(x) for k, x in zip(chosen, weights)}


def fit(docs: DataFrame, most: int = MAX_TEXTS) -> Mixture:
    """Trigram models of the languages of docs (doc_id, text, lang), from rows outside the held-out fold."""
    rows = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    bits = bits_for(len(sizes))
    chosen = smallest_hashes(rows, "lang", sizes, most)  # `most` light rows a language
    texts = docs.select("doc_id", F.col("lang").alias("l"), F.col("text").cast("binary").alias("raw"))
    same = (texts["doc_id"] == chosen["doc_id"]) & (texts["l"] == chosen["lang"])
    side = F.broadcast(chosen) if len(sizes) * most <= BROADCAST_ROWS else chosen
    taken = texts.join(side, same, "left_semi").select("l", "raw")

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = np.bincount(trigrams(raw, bits), minlength=1 << bits)
                sums[lang] = sums[lang] + n if lang in sums else n
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], ["lang", "bucket", "n"])

    sums = taken.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = sums.groupBy("lang").agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n")).orderBy("lang").collect()
    counts = np.zeros((1 << bits, len(got)))
    for k, r in enumerate(got):
        counts[r.bucket, k] = r.n
    return Mixture([r.lang for r in got], counts)


def languages(docs: DataFrame, model: Mixture | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, lang_mix map<string, double>) of docs (doc_id, text, lang)."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model or fit(docs)))

    def run(batches):
        mixture = Mixture.of(shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                lang, score, mix = zip(*(mixture.infer(t) for t in texts[a:b]))
                cols = [batch.column(0).slice(a, b - a), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array([list(m.items()) for m in mix], pa.map_(pa.string(), pa.float64()))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "lang_pred", "score", "lang_mix"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", F.col("text").cast("binary").alias("raw")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, lang_mix map<string,double>")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "lang_mix")
