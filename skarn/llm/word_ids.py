"""Whole-text encoding with a public word tokenizer, one library call per distinct white-space chunk.

The tokenizer's normaliser folds white space and its pre-tokenizer never lets a piece cross it, so a text's ids are
the ids of its chunks in order. Frequent chunks are looked up; the rest go to the library in batches.
"""

from __future__ import annotations

import os
import re

import numpy as np


#: Letters whose case folding and composition concern one character alone: A-Z, a-z and the Latin-1 letters.
PLAIN = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+"
#: Marks that may close a chunk: one run of them is a piece of its own.
CLOSING = b".,;:!?|()#$%&*-"
JOINED = 64
SHARED = 250_000


class ChunkEncoder:
    """bytes of UTF-8 text -> bytes of little-endian uint32 ids.

    The lookup tables hold about `budget` bytes and start anew beyond that, so memory stays bounded whatever the
    vocabulary of the corpus. They live as long as a task, as idle workers would otherwise hold a table each, or with
    `keep` as long as the Python worker, which then learns a word once for all its tasks. The library's tokenizer and the
    first SHARED plain words that it met stay with the worker in any case.
    """

    def __init__(self, path: str, budget: int = 200 << 20, keep: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        kept = tokenizers.__dict__.setdefault("_skarn_kept", {})
        if path not in kept:
            tok = tokenizers.Tokenizer.from_file(path)
            tok.no_padding()
            tok.no_truncation()
            vocab = tok.get_vocab(with_added_tokens=False)
            ends = np.zeros(max(vocab.values()) + 1, bool)  # tokens that end a word
            ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
            kept[path] = tok, ends, {}, self._tables()
        self.tok, self.ends, self.shared, tables = kept[path]
        self.plain = re.compile(PLAIN).fullmatch
        self.budget, self.tables = budget, tables if keep else self._tables()
        self.ids, self.cores = self.tables["ids"], self.tables["cores"]

    @staticmethod
    def _tables() -> dict:
        return {"ids": {}, "cores": {b"": b""}, "held": 0}

    def _each(self, chunks: list[bytes]) -> list[bytes]:
        found = []
        for at in range(0, len(chunks), 4096):
            texts = [c.decode("utf-8", "replace") for c in chunks[at : at + 4096]]
            found += [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        return found

    def _plain(self, cores: list[bytes]) -> list[bytes]:
        """Ids of words of plain letters: JOINED of them in a call, cut again at the tokens that end a word."""
        groups = [cores[at : at + JOINED] for at in range(0, len(cores), JOINED)]
        found = []
        for at in range(0, len(groups), 256):
            part = groups[at : at + 256]
            for words, e in zip(part, self.tok.encode_batch_fast([b" ".join(g).decode() for g in part], add_special_tokens=False)):
                ids = np.array(e.ids, "<u4")
                cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
                if len(cuts) != len(words) or cuts[-1] != len(ids):
                    found += self._each(words)
                    continue
                raw = ids.tobytes()
                found += [raw[4 * a : 4 * b] for a, b in zip([0, *cuts], cuts)]
        return found

    def _learn(self, chunks: set[bytes]) -> None:
        """Ids of new chunks. Most are a plain word and closing marks, and the word is often known in another form."""
        cores, shared, ids, later = self.cores, self.shared, self.ids, []
        for c in chunks:
            core = c.rstrip(CLOSING)
            got = shared.get(core) or cores.get(core)
            if got is None:
                later.append((c, core))
            elif len(core) == len(c):
                ids[c] = got
            elif (tail := cores.get(c[len(core) :])) is None:
                later.append((c, core))
            else:
                ids[c] = got + tail
        cores.update((core, shared[core]) for _, core in later if core in shared)
        plain = [(c, core) for c, core in later if core in cores or self.plain(core)]
        odd = list({c for c, _ in later}.difference(c for c, _ in plain))
        fresh = list({core for _, core in plain}.difference(cores))
        coded = self._plain(fresh)
        cores.update(zip(fresh, coded))
        if len(shared) < SHARED:
            shared.update((core, got) for core, got in zip(fresh, coded) if len(core) <= 64)
        tails = list({c[len(core) :] for c, core in plain}.difference(cores))
        cores.update(zip(tails, self._each(tails)))
        ids.update(zip(odd, self._each(odd)))
        ids.update((c, cores[core] + cores[c[len(core) :]]) for c, core in plain)
        self.tables["held"] += sum(map(len, chunks)) * 3 + 160 * len(chunks) + 160 * len(fresh)

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        if self.tables["held"] > self.budget:
            self.tables["held"] = 0
            self.ids.clear()
            self.cores.clear()
            self.cores[b""] = b""
        # the tokenizer lower-cases anyway; a special token's string must not come about by it
        chunks = [(t if b"<|" in t else t.lower()).split() if t else [] for t in texts]
        new = set().union(*chunks).difference(self.ids)
        if new:
            self._learn(new)
        get = self.ids.__getitem__
        return [b"".join(map(get, c)) for c in chunks]


#: Rows and bytes of text that are encoded at once: what they touch stays in a core's cache.
ROWS, SIZE = 48, 1 << 20


def slices(texts: list, rows: int = 512, size: int = 4 << 20):
    """(start, end) runs of texts of at most `rows` rows and about `size` bytes, one text at least."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if i > start and (i - start >= rows or held > size):
            yield start, i
            start, held = i, 0
        held += len(t or b"")
    if start < len(texts):
        yield start, len(texts)
