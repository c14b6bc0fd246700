"""Operator 1: token ids of whole documents in Simple-8b files, in ascending doc_id order.

Layout of a token folder: Parquet files written by Spark's committer (a lost executor's task is simply run again, and
any Hadoop store will do). Each row is a block of whole documents:

    part int        file group; all doc_ids of a part are below those of the next
    block int       position in the part
    first long      ids of the part before this block
    n_ids long      ids in the block
    doc_ids array<long>     documents of the block, ascending, nulls first
    offsets array<int>      where each document's payload begins in `payload`, plus the end
    payload binary          the documents' Simple-8b payloads one after another

Blocks decode independently and documents within them by offset. A document's place in the whole corpus is
(ids of earlier parts) + first + (ids of earlier documents of its block).

Plan: one pass over the text encodes and packs each document where it lies; only packed ids are shuffled, once, by
ranges of doc_id taken from the doc_id column. Null text is an empty text (just the end id). Repeated doc_ids stay
separate documents, in the order of their payloads. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import shuffle_partitions, trimmed
from skarn.llm.simple8b import n_values, pack_all, unpack_all
from skarn.llm.word_ids import ROWS, SIZE, ChunkEncoder, slices

BLOCK_IDS = 1 << 16


def packed_ids(docs: DataFrame, tokenizer_path: str, end_id: int, bounds: list[int]) -> DataFrame:
    """(part, doc_id, payload): each document's ids with end_id appended, packed; part by the ascending bounds."""
    cuts = np.array(bounds, np.int64)

    def run(batches):
        coder, tail = ChunkEncoder(tokenizer_path, budget=320 << 20, keep=True), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            part = np.where(known, np.searchsorted(cuts, ids.fill_null(0).to_numpy(), side="right"), 0).astype(np.int32)
            for a, b in slices(texts, ROWS, SIZE):
                coded = [x + tail for x in coder.encode(texts[a:b])]
                rows = pack_all(np.frombuffer(b"".join(coded), "<u4"), np.array([len(x) // 4 for x in coded]))
                yield pa.RecordBatch.from_arrays([pa.array(part[a:b]), ids.slice(a, b - a), pa.array(rows, pa.binary())], ["part", "doc_id", "payload"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"))
    return rows.mapInArrow(trimmed(run), "part int, doc_id long, payload binary")


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, parts: int | None = None) -> None:
    """Encode docs (doc_id, text, ...) and write the token folder at path. An empty table gives an empty folder."""
    parts = parts or shuffle_partitions(docs.sparkSession)
    probs = [i / parts for i in range(1, parts)]
    cuts = (docs.select(F.percentile_approx(F.col("doc_id").cast("long"), probs, 10_000).alias("q")).first().q or []) if probs else []

    def run(batches):
        held, state = [], {"part": None, "block": 0, "first": 0, "n": 0}

        def flush():
            offsets = np.cumsum([0] + [len(p) for _, p in held]).astype(np.int32)
            row = {"part": [state["part"]], "block": [state["block"]], "first": [state["first"]], "n_ids": [state["n"]], "doc_ids": [[d for d, _ in held]], "offsets": [offsets.tolist()], "payload": [b"".join(p for _, p in held)]}
            state.update(block=state["block"] + 1, first=state["first"] + state["n"], n=0)
            held.clear()
            return pa.RecordBatch.from_pydict(row, schema=block_schema)

        block_schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int32())), ("payload", pa.binary())])
        for batch in batches:
            for part, doc, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if held and (part != state["part"] or state["n"] >= BLOCK_IDS):
                    yield flush()
                if part != state["part"]:
                    state.update(part=part, block=0, first=0, n=0)
                held.append((doc, payload))
                state["n"] += n_values(payload)
        if held:
            yield flush()

    rows = packed_ids(docs, tokenizer_path, end_id, sorted(set(cuts)))
    blocks = (
        rows.repartitionById(parts, F.col("part"))
        .sortWithinPartitions("part", "doc_id", "payload")
        .mapInArrow(run, "part int, block int, first long, n_ids long, doc_ids array<long>, offsets array<int>, payload binary")
    )
    blocks.write.option("compression", "uncompressed").parquet(path)


def read_token_files(spark, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the token folder, decoded from its payloads.

    start counts the ids of all documents before it; the part totals that it needs come from the part and n_ids columns
    alone: one small row a file group.
    """
    blocks = spark.read.parquet(path)
    totals = {r.part: r.n for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    base, before = {}, 0
    for part in sorted(totals):
        base[part], before = before, before + totals[part]

    def run(batches):
        for batch in batches:
            for part, first, docs, offsets, payload in zip(*(batch.column(i).to_pylist() for i in range(5))):
                flat, n = unpack_all([payload[a:b] for a, b in zip(offsets, offsets[1:])])
                ids = np.split(flat.astype("<u4"), np.cumsum(n)[:-1])
                cols = [pa.array(docs, pa.int64()), pa.array(base[part] + first + np.cumsum(n) - n), pa.array(n), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())]
                if with_ids:
                    cols.append(pa.array([x.astype(np.int64).tolist() for x in ids], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return blocks.select("part", "first", "doc_ids", "offsets", "payload").mapInArrow(run, schema)
