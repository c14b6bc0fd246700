"""Operator 11: the trie of conversation prefixes, from globally sorted turn arrays.

A conversation is the array of its turns in order of `turn` (null first; equal ones by role, then by the hash of role and
text; repeated rows are repeated turns). Null role or text is the empty string. Rows without conv_id belong to no
conversation and are ignored, as are other columns. An empty table gives no node, not even the root. conv_id must be of
an integer type.

Plan: a turn becomes 120 bits of its SHA-256 and its length where it lies, so no text is shuffled. One exchange by
conv_id - conv_id % 100 brings a conversation together with the one it borrows its first turns from (at most 199 ids
meet). The turn arrays are sorted globally by one range exchange, ties by conv_id, so that copies of a conversation, however
many, spread over ranges. A sweep over each range keeps the nodes of the last array on a stack: the common prefix
(LCP) with the next array says which of them end, and what ends is a node with all its figures. Nodes on the first array
of a range or still open at its end may go on in the neighbours: these are written as partial nodes under the digest of
their prefix, twice a range and level at most, added up over ranges, and their subtrees' sums are stitched from the
deepest up. Ids that end at such a node are written in chunks of about CHUNK bytes and hashed in order as a stream.

Memory: a sweep holds the stack (the longest array), HELD finished nodes that wait for their parent's smallest member,
and CHUNK bytes of ids a node; a task holds one conversation, 24 bytes a turn. The stitching task streams over the
partial nodes and remembers sums of one level.
"""

from __future__ import annotations

import hashlib
import os

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.llm.common import durable, fresh_path
from skarn.operators.ranks import by_key

#: Conversation c borrows the first crc32(c) % BORROWED turns of conversation c - c % GROUP.
GROUP, BORROWED = 100, 6

#: Characters that name a turn: 120 bits in base 64.
NAME = 20

HELD = 50_000
CHUNK = 1 << 16

NODE = "kind int, key binary, parent_key binary, depth long, size long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, part int, seq long, ids binary"
DONE, LACKING, PARTIAL, IDS, NAMED = range(5)
ROOT = bytes(16)


def turn_arrays(conversations: DataFrame, group: Column) -> DataFrame:
    """(group, conv_id, turns array<struct<name, size>>): each conversation's turns in order, dealt by group."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, NAME * 3 // 4)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct("turn", role.alias("role"), digest.alias("digest"), F.length(text).alias("size")).alias("turn"),
    ).filter("conv_id IS NOT NULL")
    dealt = rows.withColumn("group", group).repartition("group")
    turns = F.transform(F.sort_array(F.collect_list("turn")), lambda t: F.struct(F.base64(t["digest"]).alias("name"), t["size"].alias("size")))
    return dealt.groupBy("group", "conv_id").agg(turns.alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, sizes): the first h turns of conversation conv_id - conv_id % 100 (all if fewer, none if absent),
    then the conversation's own turns after its first h; h is the CRC-32 of the decimal conv_id modulo 6."""
    own = turn_arrays(conversations, F.col("conv_id") - F.col("conv_id") % GROUP)
    first = F.when(F.col("conv_id") == F.col("group"), F.slice("turns", 1, BORROWED))
    lent = F.first(first, ignorenulls=True).over(Window.partitionBy("group"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % BORROWED).cast("int")
    empty = F.slice("turns", 1, 0)
    both = F.concat(F.slice(F.coalesce("lent", empty), F.lit(1), h), F.slice(F.col("turns"), h + 1, F.size("turns")))
    turns = own.withColumn("lent", lent).select("conv_id", both.alias("turns"))
    return turns.select("conv_id", F.array_join(F.transform("turns", lambda t: t["name"]), "").alias("path"), F.transform("turns", lambda t: t["size"]).alias("sizes"))


class Node:
    """A node on the stack; what it adds up is of its range alone, children and below only when they have ended."""

    __slots__ = ("key", "size", "edge", "n", "least", "kids", "leaves", "saved", "ids", "chunks", "waiting", "named")

    def __init__(self, key: bytes, size: int, edge: bool):
        self.key, self.size, self.edge = key, size, edge
        self.n, self.least, self.kids, self.leaves, self.saved = 0, None, 0, 0, 0
        self.ids, self.chunks, self.waiting, self.named = bytearray(), 0, [], False


class Sweep:
    """Nodes of one range of sorted arrays; rows collects what is to be written."""

    def __init__(self, part: int, held: int = HELD, chunk: int = CHUNK):
        self.part, self.most, self.chunk, self.held = part, held, chunk, 0
        self.stack, self.names, self.rows, self.fresh = [Node(ROOT, 0, True)], [], [], True

    def emit(self, kind: int, **values) -> None:
        self.rows.append(values | {"kind": kind})

    def add(self, names: list[str], sizes: list[int], conv_id: int) -> None:
        same = os.path.commonprefix([self.names, names])  # the LCP with the array before
        while len(self.stack) - 1 > len(same):
            self.close()
        for name, size in zip(names[len(same) :], sizes[len(same) :]):
            self.stack.append(Node(hashlib.blake2b(self.stack[-1].key + name.encode(), digest_size=16).digest(), size, self.fresh))
        self.names, self.fresh, node = names, False, self.stack[-1]
        node.n += 1
        node.least = conv_id if node.least is None else min(node.least, conv_id)
        node.ids += b",%d" % conv_id
        if len(node.ids) >= self.chunk:
            self.write_ids(node)

    def write_ids(self, node: Node) -> None:
        self.emit(IDS, key=node.key, part=self.part, seq=node.chunks, ids=bytes(node.ids))
        node.ids.clear()
        node.chunks += 1

    def let_go(self, node: Node) -> None:
        """Write the waiting children of a node whose smallest member isn't known yet."""
        for row in node.waiting:
            self.emit(LACKING, parent_key=node.key, **row)
        self.held -= len(node.waiting)
        node.named = node.named or bool(node.waiting)
        node.waiting = []

    def close(self, over: bool = False) -> None:
        """Take the deepest node off the stack; over: it may go on in the next range."""
        node, depth = self.stack.pop(), len(self.stack)
        up = self.stack[-1] if self.stack else None
        if up:
            up.n += node.n
            up.least = node.least if up.least is None else min(up.least, node.least)
        if node.ids and (node.chunks or node.edge or over):
            self.write_ids(node)
        if node.edge or over:
            self.let_go(node)
            self.emit(PARTIAL, key=node.key, parent_key=up.key if up else None, depth=depth, size=node.size, conv_id=node.least, n_convs=node.n, n_children=node.kids, n_leaves=node.leaves, saved_tokens=node.saved)
            return
        for row in node.waiting:
            self.emit(DONE if row["ends_sha256"] else LACKING, parent_conv_id=node.least, **row)
        self.held -= len(node.waiting)
        if node.named:
            self.emit(NAMED, key=node.key, conv_id=node.least)
        leaves, saved = node.leaves or 1, node.saved + (node.n - 1) * node.size
        up.kids, up.leaves, up.saved = up.kids + 1, up.leaves + leaves, up.saved + saved
        digest = None if node.chunks else hashlib.sha256(node.ids[1:]).hexdigest()
        up.waiting.append({"key": node.key, "depth": depth, "conv_id": node.least, "n_convs": node.n, "n_children": node.kids, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": digest})
        self.held += 1
        if up.edge or self.held >= self.most:
            self.let_go(up)

    def finish(self) -> None:
        while self.stack:
            self.close(over=True)


def as_batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def swept(paths: DataFrame, held: int = HELD, chunk: int = CHUNK) -> DataFrame:
    """Rows of NODE from paths (conv_id, path, sizes), a written table, by the sweep of each range."""

    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in NODE.split(", "))])

    def run(batches):
        sweep = None
        for batch in batches:
            for path, sizes, conv_id in zip(*(batch.column(i).to_pylist() for i in range(3))):
                sweep = sweep or Sweep(TaskContext.get().partitionId(), held, chunk)
                sweep.add([path[i : i + NAME] for i in range(0, len(path), NAME)], sizes, conv_id)
                if len(sweep.rows) >= 4096:
                    yield as_batch(sweep.rows, schema)
                    sweep.rows.clear()
        if sweep:
            sweep.finish()
            yield as_batch(sweep.rows, schema)

    return paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").select("path", "sizes", "conv_id").mapInArrow(run, NODE)


def stitched(partial: DataFrame) -> DataFrame:
    """Rows of whole nodes from the partial ones: figures of a node added over ranges, then subtrees from the deepest up."""
    total = lambda c: F.sum(c).alias(c)
    nodes = partial.groupBy("key").agg(F.first("parent_key").alias("parent_key"), F.first("depth").alias("depth"), F.first("size").alias("size"), F.min("conv_id").alias("conv_id"), *map(total, ("n_convs", "n_children", "n_leaves", "saved_tokens")))

    def run(batches):
        below: dict[int, dict[bytes, list[int]]] = {}
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                for deeper in [d for d in below if d > r["depth"] + 1]:
                    del below[deeper]
                kids, leaves, saved = below.get(r["depth"] + 1, {}).pop(r["key"], (0, 0, 0))
                r["n_children"] += kids
                r["n_leaves"] = r["n_leaves"] + leaves if r["n_children"] else 1
                r["saved_tokens"] += saved + (r["n_convs"] - 1) * r["size"]
                up = below.setdefault(r["depth"], {}).setdefault(r["parent_key"], [0, 0, 0])
                for i, x in enumerate((1, r["n_leaves"], r["saved_tokens"])):
                    up[i] += x
            yield pa.RecordBatch.from_pylist(rows, batch.schema)

    return nodes.repartition(1).sortWithinPartitions(F.desc("depth"), "key").mapInArrow(run, nodes.schema)


def hashed_ids(chunks: DataFrame) -> DataFrame:
    """(key, ends): the hash of each node's ids from chunks (key, part, seq, ids), read as a stream in order."""

    def run(batches):
        at, state = None, None
        for batch in batches:
            done = []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != at:
                    if state:
                        done.append((at, state.hexdigest()))
                    at, state, ids = key, hashlib.sha256(), ids[1:]
                state.update(ids)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([h for _, h in done], pa.string())], ["key", "ends"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends"])

    ordered = chunks.select("key", "part", "seq", "ids").repartition("key").sortWithinPartitions("key", "part", "seq")
    return ordered.select("key", "ids").mapInArrow(run, "key binary, ends string")


def trie_nodes(paths: DataFrame, held: int = HELD, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one row a node."""
    spark, place = paths.sparkSession, fresh_path(paths.sparkSession, "trie-nodes")
    swept(durable(paths, "paths"), held, chunk).write.partitionBy("kind").parquet(place)
    rows = spark.read.schema(NODE).parquet(place)
    spine = durable(stitched(rows.filter(F.col("kind") == PARTIAL)), "trie-spine")
    known = spine.select("key", "conv_id").unionByName(rows.filter(F.col("kind") == NAMED).select("key", "conv_id"))
    known = durable(known.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("__parent")), "trie-parents")
    ends = durable(hashed_ids(rows.filter(F.col("kind") == IDS)), "trie-ends")

    figures = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    lacking = rows.filter(F.col("kind") == LACKING).select("key", "parent_key", *figures)
    lacking = lacking.unionByName(spine.select("key", "parent_key", *figures[:2], F.lit(None).cast("long").alias("parent_conv_id"), *figures[3:-1], F.lit(None).cast("string").alias("ends_sha256")))
    found = by_key(by_key(lacking, known, ["parent_key"]), ends, ["key"])
    none = F.lit(hashlib.sha256().hexdigest())
    whole = found.withColumns({"parent_conv_id": F.coalesce("parent_conv_id", "__parent"), "ends_sha256": F.coalesce("ends_sha256", "ends", none)})
    return rows.filter(F.col("kind") == DONE).select(*figures).unionByName(whole.select(*figures))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of rebuilt conversations (conv_id, turn, role, text, ...), as trie_nodes() gives them."""
    return trie_nodes(rebuilt(conversations))
