"""Operator 6: quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text becomes a bag of hashed features over its words: the letters of a word below five letters, else the last three
bytes of its letters, its shape, marks, capitals and length; a longer word is no feature as a whole. Then logarithmic
counts times inverse document frequency, projected on the first latent directions of the labelled texts (truncated SVD)
and scaled to length one. The labelled vectors are broadcast; every document's cosine products with all of them are
computed exactly, block by block, and the NEIGHBOURS nearest vote with a weight that grows with similarity.

The score is the weighted share of label 1, each class weighed by its inverse frequency, raised to the power that puts
a balanced vote at the decision score 0.3: 0 to 1, and higher where label 1 is likelier. Texts without words (null,
empty, white space) get the share of label 1 among all labels.
Learning uses at most MAX_LABELLED labelled texts of each label, those with the smallest hash of doc_id among rows
outside the held-out fold, a documented bound that keeps the broadcast (2 * MAX_LABELLED * RANK floats) fixed; nulls in
quality are no labels. Without any label every score is 0.5. Every input row gives one output row; extra columns are
ignored; an empty table gives no rows.

Plan: the labelled rows are found by a bound on their hash, then a top-k each label of the few that are left; their counted
features (at most BUCKETS a text, however long) go to the driver. Then one map over the scan scores all documents: no
shuffle of the corpus.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import trimmed
from skarn.llm.folds import held_out, smallest_hashes
from skarn.llm.word_ids import slices

MAX_LABELLED = 1500
BUCKETS = 1 << 14
RANK = 48
NEIGHBOURS = 31
SHARPNESS = 12.0
BLOCK = 1024
DECISION = 0.3
EXPONENT = float(np.log(DECISION) / np.log(0.5))  # a balanced vote scores exactly DECISION


LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
MARKS = bytes(set(range(256)) - set(LETTERS))
PER_WORD = 5


class Bags:
    """Whole texts -> feature counts. Word features are memoised in a table that starts anew when it is full."""

    def __init__(self, buckets: int = BUCKETS, entries: int = 200_000):
        self.buckets, self.entries, self.known = buckets, entries, {}

    def _features(self, word: bytes) -> bytes:
        low = word.lower()
        core, marks, size = low.translate(None, MARKS), word.translate(None, LETTERS), len(word)
        caps = b"l" if low == word else b"U" if core and size > 1 and word.upper() == word else b"t"
        marks = bytes(sorted(set(marks))) if marks else marks
        names = (b"w" + core if len(core) < 5 else b"e" + core[-3:], b"s%s%d|%s" % (caps, min(len(core), 12), marks), b"m" + marks, b"c" + caps, b"n%d" % min(size, 15))
        return np.array([zlib.crc32(x) % self.buckets for x in names], np.int32).tobytes()

    def counts(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, counts) of a text's features."""
        words = (text or b"").split()
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.float32)
        known, lines, seen = self.known, text.split(b"\n"), Counter(words)
        if len(known) > self.entries:
            known.clear()
        for w in set(seen).difference(known):
            known[w] = self._features(w)
        ids = np.frombuffer(b"".join(map(known.__getitem__, seen)), np.int32)
        times = np.repeat(np.fromiter(seen.values(), np.float64, len(seen)), PER_WORD)
        total = np.bincount(ids, times, self.buckets)
        # how repetitive the text is, as pseudo features that grow with its length
        ratio = min(9, 10 * len(seen) // len(words))
        same = min(9, 10 * len(set(lines)) // len(lines))
        for name in (b"ratio%d" % ratio, b"same%d" % same):
            total[zlib.crc32(name) % self.buckets] += 2 * len(words)
        at = np.flatnonzero(total)
        return at, total[at].astype(np.float32)


def _rows(bags: Bags, texts: list[bytes | None], idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    return _weighted([bags.counts(t) for t in texts], idf)


def _weighted(found: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weighted features of length one."""
    out = []
    for b, n in found:
        v = np.log1p(n) * idf[b]
        norm = np.sqrt((v * v).sum())
        out.append((b, (v / norm).astype(np.float32) if norm else v.astype(np.float32)))
    return out


def _projected(rows, axes: np.ndarray) -> np.ndarray:
    """Latent vectors of length one; rows without features are zero."""
    out = np.zeros((len(rows), axes.shape[1]), np.float32)
    for i, (b, v) in enumerate(rows):
        if len(b):
            out[i] = v @ axes[b]
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=out, where=norm > 0)


class LatentVoters:
    """The fitted model: idf, latent axes, labelled vectors and their labels. Size is bounded by the parameters."""

    def __init__(self, texts: list[bytes | None], labels: list[int], rank: int = RANK, neighbours: int = NEIGHBOURS):
        bags = Bags()
        self._fit([bags.counts(t) for t in texts], labels, rank, neighbours)

    @classmethod
    def of_counts(cls, found: list[tuple[np.ndarray, np.ndarray]], labels: list[int]) -> LatentVoters:
        voters = cls.__new__(cls)
        voters._fit(found, labels, RANK, NEIGHBOURS)
        return voters

    def _fit(self, found: list[tuple[np.ndarray, np.ndarray]], labels: list[int], rank: int, neighbours: int) -> None:
        n = max(1, len(found))
        df = np.bincount(np.concatenate([b for b, _ in found] or [np.zeros(0, np.int64)]), minlength=BUCKETS)
        self.idf = np.log((1 + n) / (1 + df)).astype(np.float32) + 1
        rows = _weighted(found, self.idf)
        rank = min(rank, n)
        rng = np.random.default_rng(7)
        axes = rng.standard_normal((BUCKETS, rank)).astype(np.float32)
        for _ in range(5):  # subspace iteration on A'A, with A sparse by rows
            y = np.zeros((BUCKETS, rank), np.float64)
            for b, v in rows:
                if len(b):
                    y[b] += v[:, None] * (v @ axes[b])[None, :]
            axes = np.linalg.qr(y)[0].astype(np.float32)
        self.axes = axes
        self.labels = np.array(labels, np.float32)
        self.vectors = _projected(rows, axes)
        self.neighbours = min(neighbours, len(found))
        ones = float(self.labels.sum())
        self.weight = np.where(self.labels == 1, n / max(1.0, 2 * ones), n / max(1.0, 2 * (n - ones))).astype(np.float32)

    @classmethod
    def of(cls, state: dict) -> LatentVoters:
        found = cls.__new__(cls)
        vars(found).update(state)
        return found

    def score(self, texts: list[bytes | None], bags: Bags, prior: float) -> np.ndarray:
        out = np.full(len(texts), prior)
        if not len(self.labels):
            return out
        rows = _rows(bags, texts, self.idf)
        some = np.array([len(b) > 0 for b, _ in rows], bool)
        if not some.any():
            return out
        near = _projected(rows, self.axes)[some]
        k = self.neighbours
        best = np.full((len(near), 0), 0, np.float32)
        who = np.zeros((len(near), 0), np.int64)
        for a in range(0, len(self.labels), BLOCK):  # exact, a block of labelled vectors at a time
            sims = near @ self.vectors[a : a + BLOCK].T
            best = np.concatenate([best, sims], 1)
            who = np.concatenate([who, np.broadcast_to(np.arange(a, a + sims.shape[1]), sims.shape)], 1)
            if best.shape[1] > k:
                top = np.argpartition(-best, k - 1, axis=1)[:, :k]
                best, who = np.take_along_axis(best, top, 1), np.take_along_axis(who, top, 1)
        power = np.exp(SHARPNESS * (best - best.max(1, keepdims=True))) * self.weight[who]
        share = (power * self.labels[who]).sum(1) / power.sum(1)
        out[some] = share**EXPONENT
        return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MAX_LABELLED) -> tuple[LatentVoters, float]:
    """The model and the share of label 1, from rows of docs that labels covers, outside the held-out fold."""
    named = labels.filter(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    prior = {r.y: r.n for r in named.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = smallest_hashes(named, "y", prior, most)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min(F.col("text").cast("binary")).alias("raw"))

    def counted(batches):
        bags = Bags()
        for batch in batches:
            at, n = zip(*map(bags.counts, batch.column(2).to_pylist())) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), pa.array([x.astype("<i4").tobytes() for x in at], pa.binary()), pa.array([x.astype("<f4").tobytes() for x in n], pa.binary())], ["doc_id", "y", "at", "n"])

    found = texts.mapInArrow(trimmed(counted), "doc_id string, y int, at binary, n binary")
    got = sorted(((r.doc_id, r.y, np.frombuffer(r.at, "<i4").astype(np.int64), np.frombuffer(r.n, "<f4")) for r in found.toLocalIterator()), key=lambda r: r[:2])
    total = sum(prior.values())
    return LatentVoters.of_counts([r[2:] for r in got], [r[1] for r in got]), (prior.get(1, 0) / total if total else 0.5)


def score_quality(docs: DataFrame, model: LatentVoters, prior: float, keep: list[str], name: str = "score") -> DataFrame:
    """keep columns of docs plus double `name`, the score of column text."""
    shared = docs.sparkSession.sparkContext.broadcast((vars(model), prior))  # plain arrays, whatever executors have installed

    def run(batches):
        state, base = shared.value
        voters, bags = LatentVoters.of(state), Bags()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for a, b in slices(texts):
                scores = pa.array(voters.score(texts[a:b], bags, base), pa.float64())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(keep))), scores], [*keep, name])

    rows = docs.select(*keep, F.col("text").cast("binary").alias("__raw"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return rows.mapInArrow(trimmed(run), f"{schema}, `{name}` double")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of docs (doc_id, text, ...), learnt from labels (doc_id, quality, ...)."""
    model, prior = fit(docs, labels)
    scored = score_quality(docs, model, prior, ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= DECISION).cast("int").alias("predicted"))
