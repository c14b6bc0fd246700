"""Operator 10: packing of token pieces into sequences by bounded-space online best-fit.

A document's ids get end id 0 appended. Only documents longer than the sequence length are cut, into whole-length
pieces and a rest. Whole-length pieces are sequences of their own. The others arrive one by one; a shard keeps a fixed
number of open bins in a bitset keyed by free space. A piece goes to the open bin with the least free space that holds
it; with none, a bin is opened, and when all are open the fullest closes first.

Null text is an empty text: one piece, the end id. Repeated rows are packed like any others (they get the same piece
numbers). Other columns are ignored. An empty table gives no rows.

Plan: one pass encodes whole texts to light rows, written to the shared folder; only these rows are shuffled, by a
hash of the piece, to shards of about SHARD pieces. Shards see a mix of all documents in a fixed order, so the result
is the same when tasks are run again, and one shard leaves at most OPEN bins partly filled.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import durable, trimmed
from skarn.llm.word_ids import ROWS, SIZE, ChunkEncoder, slices

OPEN = 512
SHARD = 1 << 17


class OpenBins:
    """A fixed number of open bins; bit f of `bits` is set when an open bin has f free tokens."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit, self.bits, self.open, self.made = capacity, limit, 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        stack = self.bins[free]
        found = stack.pop()
        if not stack:
            self.bits ^= 1 << free
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """(bin number, offset in it) of the next piece. A piece of whole length is a sequence of its own and closes no bin."""
        if length >= self.capacity:
            self.made += 1
            return self.made - 1, 0
        room = self.bits >> length
        if room:
            free = length + (room & -room).bit_length() - 1
            number = self._take(free)
        else:
            if self.open >= self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, number = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            self.bins[left].append(number)
            self.bits |= 1 << left
            self.open += 1
        return number, self.capacity - free


def pieces(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's pieces."""

    def run(batches):
        coder, tail = ChunkEncoder(tokenizer_path, budget=96 << 20), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts, ROWS, SIZE):
                doc, piece, start, size, crc = [], [], [], [], []
                for d, x in zip(ids[a:b], coder.encode(texts[a:b])):
                    x += tail
                    for k, at in enumerate(range(0, len(x), 4 * length)):
                        part = x[at : at + 4 * length]
                        doc.append(d), piece.append(k), start.append(at // 4), size.append(len(part) // 4), crc.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"))
    return rows.mapInArrow(trimmed(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_pieces(found: DataFrame, capacity: int = 2048, open_bins: int = OPEN, shard: int = SHARD) -> DataFrame:
    """found (doc_id, piece, start, length, ids_crc32) plus sequence_id and offset. found is read twice."""
    shards = max(1, -(-found.count() // shard))

    def run(batches):
        bins, base = OpenBins(capacity, open_bins), None
        for batch in batches:
            if base is None:
                base = batch.column(5)[0].as_py() << 40
            number, offset = zip(*map(bins.place, batch.column(3).to_pylist())) if batch.num_rows else ((), ())
            cols = [batch.column(i) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.array(number, np.int64) + base), pa.array(offset, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    mix = F.xxhash64("doc_id", "piece", "ids_crc32")
    return (
        found.withColumn("__shard", F.pmod(mix, F.lit(shards)).cast("int"))
        .withColumn("__mix", F.xxhash64(F.lit(7), "doc_id", "piece", "ids_crc32"))
        .repartitionById(shards, F.col("__shard"))
        .sortWithinPartitions("__mix", "doc_id", "piece", "ids_crc32")
        .select("doc_id", "piece", "start", "length", "ids_crc32", "__shard")
        .mapInArrow(trimmed(run), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    )


def best_fit_packing(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 0, open_bins: int = OPEN) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of docs (doc_id, text, ...)."""
    return pack_pieces(durable(pieces(docs, tokenizer_path, length, end_id), "pieces"), length, open_bins)
