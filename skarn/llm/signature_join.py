"""Operator 9: exact n-gram Jaccard self-join with signature trees, down to linked groups.

A document's set holds the 64-bit hashes of its distinct 4-word shingles (A-Z lower-cased; words [^\\x20\\x09-\\x0D]+;
a text of fewer words is one shingle). Two documents link when 100 * intersection >= 85 * union. The result names each
document's group: component_id, the smallest doc_id reachable by links, itself included. Null or empty text, or text
without words: an empty set, linked with nothing. Equal sets are one vertex, so copies are never paired. Repeated
doc_ids keep one output row an input row; null doc_ids are no candidates for a group's smallest doc_id. Extra columns
are ignored; an empty table gives no rows. Sets are told apart by a 64-bit hash of their contents, shingles by a 64-bit
hash of their words.

How pairs are found, without a cap and without listing the pairs of a group:

1. Two linked sets share one of their first n - ceil(0.85 n) + 1 shingles (for 0.85) in any common order. The order puts
   shingles first that are in one set only, then goes by hash. Which are is counted exactly for the shingles of the lowest
   hashes (region()), enough of them to fill the prefix of a text of its own: every task sums its sets up, packed by hash
   ranges, and one exchange settles them, so the volume grows with the corpus and no faster. Shared shingles go back to
   their sets, packed again, which cut their prefixes. Single shingles are sent no further.
2. Sets with a shared shingle in the prefix are compared with one set that is the smallest of many of these shingles (size
   and signature bounds first, then the exact sets); components of these links are built.
3. Shingles with the same smallest set form one group of all their sets, each once; two sets that share a shingle share
   such a group. A group of several components gets a signature tree over its members: nodes hold OR-combined shingle
   bitmaps and size ranges. A dual traversal drops node pairs of one component, of sizes that can't link, and those whose
   largest possible overlap is too small. Each component's most promising pair is checked, round by round while that
   links something (a growing forest: as many pairs as members); then every pair left. A group with more members than
   CELL is dealt out in cells, pairs of member chunks, so no task gets a whole group.
4. Checked pairs get their exact sets, which are written once, in a second pass over one document of each set that step 1
   did not rule out. Tables that are no longer needed are deleted at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import durable, forget, mark_keys, shuffle_partitions, trimmed
from skarn.llm.word_ids import slices

WORDS, NEED = 4, 85  # words of a shingle; least similarity in hundredths
OF = 100
FLUSH = 1_000_000  # shingles that a task holds before it passes them on
LIGHT, ONCE, TWICE, PAIRS, SIZES = range(5)  # kinds of rows
PROFILE = "part int, kind int, doc_id long, n long, key long, hash long, tokens binary, keys binary"
COLUMNS = [c.split()[0] for c in PROFILE.split(", ")]
MIN_BITS, MAX_BITS = 1 << 9, 1 << 16
CELL = 4000
FANOUT = 6
BEST_ROUNDS = 4  # then every pair left, however many rounds there were


class Shingler:
    """Whole texts -> sorted distinct shingle hashes (uint64)."""

    def __init__(self, n_words: int = WORDS, entries: int = 200_000):
        import xxhash

        self.digest, self.n_words, self.entries, self.known = xxhash.xxh3_64_intdigest, n_words, entries, {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known, digest = self.known, self.digest
        try:
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > self.entries:
                known.clear()
            known.update((w, digest(w)) for w in set(words).difference(known))
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(self.n_words, len(h))
        mixed = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i]
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(27)
        mixed.sort()
        return mixed[np.concatenate([[True], mixed[1:] != mixed[:-1]])]

    def key(self, tokens: np.ndarray) -> int:
        """Signed 64-bit name of a set."""
        return int(np.array(self.digest(tokens.tobytes()), np.uint64).view(np.int64))


def signature(tokens: np.ndarray) -> bytes:
    """Bitmap of 12 to 24 bits a shingle (fewer for very long texts), little-endian; bit (hash mod bits)."""
    bits = MIN_BITS
    while bits < 12 * len(tokens) and bits < MAX_BITS:
        bits *= 2
    flags = np.zeros(bits, np.uint8)
    flags[(tokens & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def folded(bitmap: int, bits: int, to: int) -> int:
    """A bitmap of `bits` bits as one of `to` bits: halves OR-combined."""
    while bits > to:
        bits //= 2
        bitmap = (bitmap & ((1 << bits) - 1)) | (bitmap >> bits)
    return bitmap


def can_link(low_a: int, high_a: int, low_b: int, high_b: int, overlap: int, need: int = NEED) -> bool:
    """Whether sets of these sizes can link when they share at most `overlap` shingles."""
    overlap = min(overlap, high_a, high_b)
    return OF * high_a >= need * low_b and OF * high_b >= need * low_a and (need + OF) * overlap >= need * (low_a + low_b)


class Node:
    """A tree node over members; bitmap: their signatures OR-combined; slack: most shingles of a member that share a bit."""

    __slots__ = ("bitmap", "bits", "low", "high", "slack", "comp", "parts", "member")

    def __init__(self, parts=(), member=None):
        self.parts, self.member = parts, member
        if member is not None:
            key, self.comp, size, bitmap, self.bits = member
            self.bitmap, self.low, self.high, self.slack = bitmap, size, size, size - bitmap.bit_count()
            return
        self.bits = min(p.bits for p in parts)
        self.bitmap = 0
        for p in parts:
            self.bitmap |= folded(p.bitmap, p.bits, self.bits)
        self.low, self.high = min(p.low for p in parts), max(p.high for p in parts)
        comps = {p.comp for p in parts}
        self.comp = comps.pop() if len(comps) == 1 else None
        # folding makes more shingles share a bit: count the slack again from the smallest bitmaps
        self.slack = max(p.high - folded(p.bitmap, p.bits, self.bits).bit_count() if p.member is not None else p.slack if p.bits == self.bits else p.high for p in parts)


def tree(members: list[tuple]) -> Node:
    """Members (key, comp, size, bitmap, bits) in a tree of fanout FANOUT, neighbours in component and size together."""
    level = [Node(member=m) for m in sorted(members, key=lambda m: (m[4], m[1], m[2], m[0]))]
    while len(level) > 1:
        level = [Node(level[i : i + FANOUT]) for i in range(0, len(level), FANOUT)]
    return level[0]


def may_link(a: Node, b: Node, need: int = NEED) -> int:
    """The largest possible overlap of a member of a and one of b, or -1 when none of them can link."""
    if a.comp is not None and a.comp == b.comp:
        return -1
    if OF * a.high < need * b.low or OF * b.high < need * a.low:
        return -1
    bits = min(a.bits, b.bits)
    x, y = folded(a.bitmap, a.bits, bits), folded(b.bitmap, b.bits, bits)
    sa = a.slack if a.bits == bits else a.high - x.bit_count() if a.member is not None else a.high
    sb = b.slack if b.bits == bits else b.high - y.bit_count() if b.member is not None else b.high
    both = x & y
    most = both.bit_count() + min(sa, sb)
    if a.member is not None:
        most = min(most, a.high - (x ^ both).bit_count())  # a bit of a that b lacks is a shingle that b lacks
    if b.member is not None:
        most = min(most, b.high - (y ^ both).bit_count())
    return min(most, a.high, b.high) if can_link(a.low, a.high, b.low, b.high, most, need) else -1


def traverse(first: Node, second: Node, best_only: bool, need: int = NEED) -> list[tuple]:
    """Pairs of members that may link, of different components; best_only: for each component only the most promising."""
    found: list[tuple] = []
    best: dict[int, tuple] = {}
    stack = [(first, second)]
    while stack:
        a, b = stack.pop()
        if a is b:
            if a.member is None and a.comp is None:
                stack += [(p, q) for i, p in enumerate(a.parts) for q in a.parts[i:]]
            continue
        most = may_link(a, b, need)
        if most < 0:
            continue
        if a.member is not None and b.member is not None:
            pair = (min(a.member[0], b.member[0]), max(a.member[0], b.member[0]))
            if not best_only:
                found.append(pair)
                continue
            rank = (most / (a.high + b.high), pair)
            for comp in (a.comp, b.comp):
                if comp not in best or rank > best[comp]:
                    best[comp] = rank
        elif b.member is not None or (a.member is None and len(a.parts) and a.high >= b.high):
            stack += [(p, b) for p in a.parts]
        else:
            stack += [(a, q) for q in b.parts]
    return found + list({pair for _, pair in best.values()})


def region(need: int) -> np.uint64:
    """Shingles below this hash are counted: the prefix share of all hashes and 0.15 more."""
    return np.uint64(int(min(1.0, 1 - need / OF + 0.15) * (2**64 - 1)))


def prefix_size(n, need: int):
    """How many first shingles of a set of n can hold all that a linked set shares: one of them is shared."""
    return n - (need * n + OF - 1) // OF + 1


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, raw, hash) of documents; hash names the text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"), F.xxhash64("text").alias("hash"))


def part_bits(spark) -> int:
    """2**bits parts, of hashes and of keys: some eight for each shuffle partition."""
    return max(3, (8 * shuffle_partitions(spark) - 1).bit_length())


def blocks(kind: int, part: np.ndarray, tokens: np.ndarray, keys: np.ndarray | None = None) -> pa.RecordBatch:
    """A row (part, kind, tokens, keys) for each run of equal parts; tokens and keys are 64-bit numbers of the run's entries."""
    heads = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])[: len(part)])
    cuts = np.append(heads, len(part))
    packed = lambda x: pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((8 * cuts).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])
    m = len(heads)
    none = pa.nulls(m, pa.int64())
    own = pa.nulls(m, pa.binary()) if keys is None else packed(keys)
    return pa.RecordBatch.from_arrays([pa.array(part[heads].astype(np.int32)), pa.array(np.full(m, kind, np.int32)), none, none, none, none, packed(tokens), own], COLUMNS)


def by_key(kind: int, bits: int, tokens: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    """blocks() dealt by key."""
    part = keys.view(np.uint64) & np.uint64((1 << bits) - 1)
    order = np.argsort(part, kind="stable")
    return blocks(kind, part[order], tokens[order], keys[order])


def turned(tokens: np.ndarray) -> np.ndarray:
    """Hashes with their halves swapped: the low bits, which decide the part, first."""
    return (tokens << np.uint64(32)) | (tokens >> np.uint64(32))


def profile(docs: DataFrame, bits: int, n_words: int = WORDS, need: int = NEED) -> DataFrame:
    """One pass over whole texts: a LIGHT row (doc_id, n, key, hash) a document, and packed rows of the shingles that may be
    in a prefix: those of region() and, where these are fewer than the prefix, as many more as it takes.

    Every FLUSH shingles are sorted and summed up, a set once a task: ONCE, dealt by shingle, has those of one set with its
    key; TWICE those of several sets, without keys, however many sets these are; PAIRS, dealt by key, the shingles and keys
    of the latter; SIZES the size of each set and its count in region().
    """

    def run(batches):
        shingles, low, met, held, keys, sizes, inside, row = Shingler(n_words), region(need), set(), [], [], [], [], 0

        def flush():
            tokens, own = turned(np.concatenate(held)), np.repeat(np.array(keys, np.int64), [len(s) for s in held])
            order = np.argsort(tokens, kind="stable")
            tokens, own = tokens[order], own[order]
            heads = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
            times = np.diff(np.append(heads, len(tokens)))
            alone, part = np.repeat(times == 1, times), tokens >> np.uint64(64 - bits)
            many, back = heads[times > 1], turned(tokens)
            yield blocks(ONCE, part[alone], back[alone], own[alone])
            if len(many):
                yield blocks(TWICE, part[many], back[many])
                yield by_key(PAIRS, bits, back[~alone], own[~alone])
            yield by_key(SIZES, bits, np.array(sizes, np.uint64) << np.uint64(32) | np.array(inside, np.uint64), np.array(keys, np.int64))
            for x in (held, keys, sizes, inside):
                x.clear()

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices(texts):
                m, count, names = b - a, [], []
                for t in texts[a:b]:
                    s = shingles(t)
                    n = len(s)
                    key = shingles.key(s) if n else None
                    count.append(n)
                    names.append(key)
                    if n and key not in met:
                        met.add(key)
                        r = int(np.searchsorted(s, low))
                        held.append(s[: max(r, prefix_size(n, need))])
                        keys.append(key), sizes.append(n), inside.append(r)
                part = (np.arange(row, row + m) % (1 << bits)).astype(np.int32)
                row += m
                none = pa.nulls(m, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(m, LIGHT, np.int32)), ids.slice(a, m), pa.array(count, pa.int64()), pa.array(names, pa.int64()), batch.column(2).slice(a, m), none, none], COLUMNS)
                if sum(map(len, held)) > FLUSH:
                    yield from flush()
        if held:
            yield from flush()

    return _rows(docs).mapInArrow(trimmed(run), PROFILE)


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(shuffle_partitions(rows.sparkSession), "part").sortWithinPartitions("part")


def settled(rows: DataFrame, bits: int) -> DataFrame:
    """profile() with ONCE and TWICE exchanged for PAIRS: which shingles several sets hold is counted a part at a time.

    A shingle has one entry a flush at most, however many sets hold it.
    """

    def run(batches):
        found, held, at = [], [], None

        def flush():
            out = by_key(PAIRS, bits, *(np.concatenate(c) for c in zip(*found)))
            found.clear()
            return out

        def count():
            once = [x for x in held if x[0] == ONCE]
            tokens = np.frombuffer(b"".join(x[1] for x in once) + b"".join(x[1] for x in held if x[0] == TWICE), np.uint64)
            own = np.frombuffer(b"".join(x[2] for x in once), np.int64)
            several = np.arange(len(tokens)) >= len(own)
            own = np.concatenate([own, np.zeros(len(tokens) - len(own), np.int64)])
            order = np.argsort(tokens, kind="stable")
            tokens, own, several = tokens[order], own[order], several[order]
            heads = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
            shared = np.logical_or.reduceat(several, heads) | (np.minimum.reduceat(own, heads) != np.maximum.reduceat(own, heads))
            keep = np.repeat(shared, np.diff(np.append(heads, len(tokens)))) & ~several
            if keep.any():
                found.append((tokens[keep], own[keep]))
            held.clear()

        for batch in batches:
            kinds = batch.column(1).to_numpy()
            counted = (kinds == ONCE) | (kinds == TWICE)
            yield batch.filter(pa.array(~counted))
            rest = batch.filter(pa.array(counted))
            for part, kind, tokens, own in zip(*(rest.column(i).to_pylist() for i in (0, 1, 6, 7))):
                if part != at and held:
                    count()
                    if sum(len(x[0]) for x in found) > FLUSH:
                        yield flush()
                at = part
                held.append((kind, tokens, own))
        if held:
            count()
        if found:
            yield flush()

    return _dealt(rows).mapInArrow(trimmed(run), PROFILE)


def prefixes(rows: DataFrame, need: int = NEED) -> DataFrame:
    """(token, key, n): the shared shingles in each set's prefix, from rows PAIRS and SIZES of settled().

    The prefix holds the set's single shingles of region() first, which can't be shared, then the others by hash.
    """

    def run(batches):
        low, pairs, sizes, at = region(need), [], [], None

        def cut():
            join = lambda c, kind: np.frombuffer(b"".join(c), kind)
            known, first = np.unique(join((x[1] for x in sizes), np.int64), return_index=True)
            size = join((x[0] for x in sizes), np.uint64)[first]
            n, r = (size >> np.uint64(32)).astype(np.int64), (size & np.uint64(0xFFFFFFFF)).astype(np.int64)
            tokens, keys = join((x[0] for x in pairs), np.uint64), join((x[1] for x in pairs), np.int64)
            pairs.clear(), sizes.clear()
            order = np.lexsort((tokens, keys))
            tokens, keys = tokens[order], keys[order]
            new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (tokens[1:] != tokens[:-1])])  # a set of several tasks
            tokens, keys = tokens[new], keys[new]
            heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            of = np.searchsorted(known, keys[heads])
            room = prefix_size(n[of], need) - r[of] + np.add.reduceat((tokens < low).astype(np.int64), heads)
            times = np.diff(np.append(heads, len(keys)))
            keep = np.arange(len(keys)) - np.repeat(heads, times) < np.repeat(room, times)
            return pa.RecordBatch.from_arrays([pa.array(tokens[keep].view(np.int64)), pa.array(keys[keep]), pa.array(np.repeat(n[of], times)[keep].astype(np.int32))], ["token", "key", "n"])

        for batch in batches:
            for part, kind, tokens, own in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if part != at:
                    if pairs:
                        yield cut()
                    pairs.clear(), sizes.clear()
                    at = part
                (pairs if kind == PAIRS else sizes).append((tokens, own))
        if pairs:
            yield cut()

    packed = rows.filter(F.col("kind").isin(PAIRS, SIZES)).select("part", "kind", "tokens", "keys")
    return _dealt(packed).mapInArrow(trimmed(run), "token long, key long, n int")


def exact_sets(docs: DataFrame, n_words: int = WORDS) -> DataFrame:
    """(key, n, sig, tokens) of the sets of docs (doc_id, raw, ...), once a task."""

    def run(batches):
        shingles, met = Shingler(n_words), set()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts, size=1 << 20):
                sets = {shingles.key(s): s for s in map(shingles, texts[a:b]) if len(s)}
                sets = {k: s for k, s in sets.items() if k not in met}
                met.update(sets)
                yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.int64()), pa.array([len(s) for s in sets.values()], pa.int32()), pa.array([signature(s) for s in sets.values()], pa.binary()), pa.array([s.tobytes() for s in sets.values()], pa.binary())], ["key", "n", "sig", "tokens"])

    return docs.mapInArrow(trimmed(run), "key long, n int, sig binary, tokens binary").dropDuplicates(["key"])


def exact_links(sets: DataFrame, pairs: DataFrame, need: int = NEED) -> DataFrame:
    """The written pairs (a, b) whose sets (key, tokens) link. Only sets that a pair names are shuffled."""

    def check(batches):
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(OF * both >= need * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ends = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key")))
    some = mark_keys(sets.select("key", "tokens"), F.col("key"), ends, "__named").filter("__named")
    both = pairs.join(some.select(F.col("key").alias("b"), F.col("tokens").alias("y")), "b").join(some.select(F.col("key").alias("a"), F.col("tokens").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(trimmed(check), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(key, comp): for each end of an edge (a, b) the smallest key it is connected with.

    Labels go along edges and jump to their own label each round, so a chain takes a number of rounds that grows with the
    logarithm of its length. Each round is written to the shared folder; only a count comes to the driver.
    """
    both = durable(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = durable(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "key"), "cc")
    while True:
        near = both.join(labels.withColumnRenamed("key", "b"), "b").groupBy(F.col("a").alias("key")).agg(F.min("comp").alias("near"))
        # a label's own smaller neighbour is told to the label as well (hooking), then labels jump
        told = labels.join(near, "key").select(F.col("comp").alias("key"), "near").groupBy("key").agg(F.min("near").alias("near"))
        all_near = near.unionByName(told).groupBy("key").agg(F.min("near").alias("near"))
        stepped = labels.join(all_near, "key", "left").select("key", F.col("comp").alias("was"), F.least("comp", F.coalesce("near", "comp")).alias("comp"))
        jump = labels.select(F.col("key").alias("comp"), F.col("comp").alias("far"))
        new = durable(stepped.join(jump, "comp", "left").select("key", "was", F.least("comp", F.coalesce("far", "comp")).alias("comp")), "cc")
        done = new.filter("comp <> was").isEmpty()
        forget(labels)
        labels = new
        if done:
            forget(both)
            return labels.select("key", "comp")


def joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """components() of what comp (key, comp) already connects and of links (a, b): only links between its groups are followed."""
    ends = links.select(F.col("a").alias("key")).unionByName(links.select(F.col("b").alias("key")))
    every = durable(comp.unionByName(ends.distinct().join(comp, "key", "left_anti").select("key", F.col("key").alias("comp"))), "cc-all")
    of = lambda c: every.select(F.col("key").alias(c), F.col("comp").alias(f"of_{c}"))
    between = links.join(of("a"), "a").join(of("b"), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).filter("a <> b")
    to = components(between).select(F.col("key").alias("comp"), F.col("comp").alias("to"))
    out = durable(every.join(to, "comp", "left").select("key", F.coalesce("to", "comp").alias("comp")), "cc-joined")
    forget(every)
    return out


def tree_pairs(rows: DataFrame, sigs: DataFrame, best_only: bool, need: int = NEED, cell: int = CELL) -> DataFrame:
    """Distinct pairs (a, b) of rows (lead, key, n, comp) that may link, by one signature tree a group (lead) and cell."""
    many = rows.groupBy("lead").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m")).filter("lo < hi").select("lead", "m")
    parts = F.ceil(F.col("m") / cell).cast("int")
    mine = F.pmod(F.xxhash64("key"), parts).cast("int")
    dealt = rows.join(many, "lead").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.select("lead", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "key", "comp", "n").join(sigs, "key")

    def run(batches):
        group, at = [], None

        def pairs():
            if at[1] == at[2]:
                top = tree([m for _, m in group])
                return traverse(top, top, best_only, need)
            left, right = ([m for side, m in group if side == s] for s in at[1:])
            return traverse(tree(left), tree(right), best_only, need) if left and right else []

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], ["a", "b"])

        for batch in batches:
            out: set[tuple] = set()
            for lead, i, j, side, key, comp, n, sig in zip(*(batch.column(c).to_pylist() for c in range(8))):
                if (lead, i, j) != at:
                    if len(group) > 1:
                        out.update(pairs())
                    group, at = [], (lead, i, j)
                group.append((side, (key, comp, n, int.from_bytes(sig, "little"), 8 * len(sig))))
            yield batch_of(out)
        if len(group) > 1:
            yield batch_of(pairs())

    columns = ["lead", "i", "j", "mine", "key", "comp", "n", "sig"]
    cells = dealt.select(*columns).repartition(shuffle_partitions(rows.sparkSession), "lead", "i", "j").sortWithinPartitions("lead", "i", "j", "key")
    return cells.mapInArrow(trimmed(run), "a long, b long").distinct()


def linked_groups(docs: DataFrame, n_words: int = WORDS, need: int = NEED) -> DataFrame:
    """(doc_id, n_shingles, component_id) of docs (doc_id, text, ...), for n_words and a similarity of need hundredths."""
    bits = part_bits(docs.sparkSession)
    first = durable(settled(profile(docs, bits, n_words, need), bits), "join-settled")
    light = first.filter(F.col("kind") == LIGHT).select("doc_id", "n", "key", "hash")
    prefix = durable(prefixes(first, need), "join-prefixes")
    # the exact sets of those with a shared shingle in their prefix, from one document each
    one = light.join(prefix.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min(F.struct("doc_id", "hash")).alias("x"))
    one = durable(one.select("x.doc_id", "x.hash"), "join-one")
    due = mark_keys(_rows(docs), F.struct("doc_id", "hash"), one, "__due").filter("__due").select("doc_id", "raw")
    sets = durable(exact_sets(due, n_words), "join-sets")

    leads = prefix.groupBy("token").agg(F.min(F.struct("key", "n")).alias("x"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    leads = leads.select("token", F.col("x.key").alias("lead"), F.col("x.n").alias("lead_n"))
    groups = durable(prefix.join(leads, "token").groupBy("lead", "lead_n", "key", "n").agg(F.count(F.lit(1)).alias("c")), "join-groups")
    forget(prefix, one)
    size = OF * F.least("n", "lead_n") >= need * F.greatest("n", "lead_n")
    star = groups.filter((F.col("key") != F.col("lead")) & size).groupBy(F.col("key").alias("b")).agg(F.max_by("lead", F.struct("c", "lead")).alias("a"))
    sigs = sets.select("key", "sig")
    pairs = durable(promising(star.select("a", "b"), sets.select("key", "n", "sig"), need), "join-star")
    links = durable(exact_links(sets, pairs, need), "join-links")
    forget(pairs)
    comp, rounds, best_only = components(links), 0, True
    while True:
        rows = groups.select("lead", "key", "n").join(comp, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
        pairs = durable(tree_pairs(rows, sigs, best_only, need), "join-pairs")
        if pairs.isEmpty():
            break
        links = durable(exact_links(sets, pairs, need), "join-links")
        none = links.isEmpty()
        comp = comp if none else joined(comp, links)
        forget(pairs, links)
        if not best_only:
            break
        rounds += 1
        best_only = rounds < BEST_ROUNDS and not none
    forget(groups, sets)
    # groups: the smallest document of each linked component, then of each set
    linked = light.filter("n > 0").join(comp, "key")
    smallest = linked.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    alone = light.filter("n > 0").join(comp.select("key"), "key", "left_anti")
    copies = alone.groupBy("key").agg(F.min("doc_id").alias("component_id"))
    out = linked.join(smallest, "comp").select("doc_id", "n", "component_id").unionByName(alone.join(copies, "key").select("doc_id", "n", "component_id"))
    none = light.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return out.unionByName(none).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def promising(pairs: DataFrame, sigs: DataFrame, need: int = NEED) -> DataFrame:
    """The pairs (a, b) whose signatures leave room for a link."""

    def run(batches):
        for batch in batches:
            a, b, na, nb, x, y = (batch.column(i).to_pylist() for i in range(6))
            leaf = lambda key, n, sig: Node(member=(key, key, n, int.from_bytes(sig, "little"), 8 * len(sig)))
            keep = [may_link(leaf(*p), leaf(*q), need) >= 0 for p, q in zip(zip(a, na, x), zip(b, nb, y))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_a = pairs.join(sigs.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("sig").alias("x")), "a")
    with_b = with_a.join(sigs.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("y")), "b")
    return with_b.select("a", "b", "na", "nb", "x", "y").mapInArrow(trimmed(run), "a long, b long")
