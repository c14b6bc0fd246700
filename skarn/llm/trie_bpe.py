"""Operator 8: byte-level BPE encoding by prefix-sharing trie traversal, and decoding.

The encoding of a prefix ends in exactly one token; what precedes it is the encoding of the shorter prefix, and two
neighbouring tokens are compatible when the merge rules, run on their bytes, give back just these two. So every prefix
needs one state, its last token, and the states of a word give its encoding backwards. The distinct words of a batch
are put in a trie, here in its array form: words in byte order are the trie's leaves in depth-first order, and a stack
holds the states along the current path. What two neighbours share is computed once.

Texts are cut into words by the pattern of byte-level BPE after the special token's string has been taken out; that
string is the special id, as in the tokenizers library with add_special_tokens=False. Decoding joins the bytes of the
ids, special ones included, and reads them as UTF-8 with replacement characters for what is not.

Null or empty text: no ids. Every input row gives one output row; extra columns are ignored; an empty table gives no
rows. Plan: one map over the scan, no shuffle; words already met by a Python worker stay in a bounded table.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.word_ids import slices

#: Fixed value: the word pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TABLE_BYTES = 160 << 20


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabulary files: itself where printable, else the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class TrieBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = {c: b for b, c in enumerate(byte_letters())}
        vocab = spec["model"]["vocab"]
        self.size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        self.bytes = [b""] * self.size
        for token, i in vocab.items():
            self.bytes[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        names = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {}  # (left id, right id) -> rank of the merge
        self.made = {}  # id -> (rank, left id, right id) of the merge that makes it
        for r, (a, b) in enumerate(names):
            left, right, both = vocab[a], vocab[b], vocab[a + b]
            self.rank[left, right] = r
            self.made.setdefault(both, (r, left, right))
        self.ids = {self.bytes[i]: i for i in vocab.values() if i not in self.special.values()}
        self.longest = max(map(len, self.ids))
        self.size_of = [len(b) for b in self.bytes]
        self.fits: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.words = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else None
        self.known: dict[str, bytes] = {}
        self.held = 0

    @classmethod
    def for_worker(cls, path: str) -> TrieBpe:
        """One encoder a Python worker and path, kept between tasks."""
        import regex

        kept = regex.__dict__.setdefault("_skarn_kept", {})
        if path not in kept:
            kept[path] = cls(path)
        return kept[path]

    def compatible(self, a: int, b: int) -> bool:
        """Whether tokens a and b, each whole, stay side by side under the merge rules.

        The merges inside both are undone from the last to the first; at each moment the pair at the border must not
        have a merge that comes before the one undone. Of equal ranks the left one comes first.
        """
        key = a * self.size + b
        known = self.fits.get(key)
        if known is None:
            before = (len(self.rank), 1)
            known = True
            while True:
                r = self.rank.get((a, b))
                if r is not None and (r, 0) < before:
                    known = False
                    break
                x, y = self.made.get(a), self.made.get(b)
                if x and (not y or x[0] > y[0]):
                    before, a = (x[0], -1), x[2]  # an equal rank at the border lies to the right, so later
                elif y:
                    before, b = (y[0], 1), y[1]  # an equal rank at the border lies to the left, so earlier
                else:
                    break
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            self.fits[key] = known
        return known

    def is_whole(self, t: int) -> bool:
        """Whether the bytes of token t are encoded as t."""
        known = self.whole.get(t)
        if known is None:
            m = self.made.get(t)
            known = self.size_of[t] == 1 if m is None else self._plain(self.bytes[t]) == [t]
            self.whole[t] = known
        return known

    def _plain(self, word: bytes) -> list[int]:
        """The merge rules applied step by step; for single tokens only."""
        parts = [self.ids[word[i : i + 1]] for i in range(len(word))]
        while len(parts) > 1:
            r, at = min((self.rank.get((parts[i], parts[i + 1]), len(self.rank)), i) for i in range(len(parts) - 1))
            if r == len(self.rank):
                break
            parts[at : at + 2] = [self.ids[self.bytes[parts[at]] + self.bytes[parts[at + 1]]]]
        return parts

    def encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids (little-endian uint32) of distinct words, by depth-first traversal of their trie."""
        out, last, before = {}, [0], b""  # last[i]: last token of the encoding of the first i bytes of the path
        find, size_of, compatible, is_whole = self.ids.get, self.size_of, self.compatible, self.is_whole
        for word in sorted(words):
            n, shared = len(word), 0
            most = min(n, len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :]
            for i in range(shared + 1, n + 1):
                start = max(0, i - self.longest)
                while True:
                    t = find(word[start:i])
                    if t is not None and is_whole(t) and (start == 0 or compatible(last[start], t)):
                        last.append(t)
                        break
                    start += 1
            ids, i = [], n
            while i:
                t = last[i]
                ids.append(t)
                i -= size_of[t]
            out[word] = np.array(ids[::-1], "<u4").tobytes()
            before = word
        return out

    def _pieces(self, text: str) -> list[str]:
        if self.cut is None or not any(s in text for s in self.special):
            return self.words(text)
        parts = self.cut(text)
        return [w for k, part in enumerate(parts) for w in ([part] if k % 2 else self.words(part))]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts as little-endian uint32."""
        pieces = [self._pieces(t) if t else [] for t in texts]
        new = set().union(*pieces).difference(self.known) if pieces else set()
        if new:
            if self.held > TABLE_BYTES:
                self.known.clear()
                self.held = 0
                new = set().union(*pieces)
            special = {s: np.array([self.special[s]], "<u4").tobytes() for s in new if s in self.special}
            raw = {w: w.encode() for w in new if w not in special}
            coded = self.encode_words(list(raw.values()))
            self.known.update((w, coded[b]) for w, b in raw.items())
            self.known.update(special)
            self.held += 230 * len(new) + 6 * sum(map(len, new))
        get = self.known.__getitem__
        return [b"".join(map(get, p)) for p in pieces]

    def decode(self, ids: bytes) -> str:
        """The text of little-endian uint32 ids."""
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def bpe_round_trip(docs: DataFrame, tokenizer_path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) of docs (doc_id, text, ...)."""

    def run(batches):
        coder = TrieBpe.for_worker(tokenizer_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                ids = coder.encode(texts[a:b])
                back = [coder.decode(x) for x in ids]
                cols = [
                    batch.column(0).slice(a, b - a),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()),
                ]
                if with_ids:
                    cols += [pa.array([np.frombuffer(x, "<u4").astype(np.int64).tolist() for x in ids], pa.list_(pa.int64())), pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(cols)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>, decoded string" if with_ids else "")
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
