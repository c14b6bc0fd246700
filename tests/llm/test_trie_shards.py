"""Operators 11 and 12 against brute force, their SQL, and hard small tables."""

import hashlib
import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skarn.llm import entry
from skarn.llm import prefix_trie as T
from skarn.llm import shards as S

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """Nodes of the rebuilt conversations by plain prefixes."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            name = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append(((turn is not None, turn or 0), role, name, text))
    own = {c: [(r, t) for _, r, _, t in sorted(x)] for c, x in own.items()}
    new = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        new[c] = own.get(c - int(np.fmod(c, 100)), [])[:h] + turns[h:]
    members, ends = {}, {}
    for c, turns in new.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def below(p):
        out, todo = [], [p]
        while todo:
            x = todo.pop()
            out.append(x)
            todo += kids.get(x, [])
        return out

    rows = []
    for p, m in members.items():
        sub = below(p)
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in sub if x)
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        rows.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), sum(x not in kids for x in sub), saved, digest))
    return sorted(rows, key=str)


def made(seed, n=260):
    """Shared first turns, copies of a whole conversation, a hot conversation, turnless ones, nulls, ties, repeated rows."""
    rng = random.Random(seed)
    rows = []
    for c in range(-105, n, 1):
        if rng.random() < 0.2:
            continue
        turns = [("system", "be kind")] if rng.random() < 0.6 else []
        turns += [(rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "ab", "", None, "naïve 😀"])) for _ in range(rng.randrange(7))]
        if rng.random() < 0.3:
            turns = [("user", "copy"), ("assistant", "of it"), ("user", "all")]
        rows += [(c, k, *t) for k, t in enumerate(turns)]
    rows += [(7, k, "user", f"long {k}") for k in range(300)]  # one long conversation, with ties of turn
    rows += [(9, None, "user", "no turn"), (9, None, "user", "none"), (None, 1, "user", "no conversation"), rows[5], rows[5]]
    return rows


@pytest.mark.parametrize("parts,held,chunk", [(1, 50_000, 1 << 16), (9, 3, 40), (23, 50_000, 1 << 16)])
def test_trie_equals_brute_force(spark, parts, held, chunk):
    rows = made(parts)
    table = spark.createDataFrame([(*r, 1, "x", 0.5) for r in rows], "conv_id long, turn long, role string, text string, depth int, path string, key double")
    was = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = T.trie_nodes(T.rebuilt(table), held, chunk)
        assert got.columns == COLUMNS
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was[1])


def test_trie_of_the_tables(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, entry.op11_prefix_trie(spark, sf).collect()), key=str) == brute(rows)


def test_trie_of_empty_and_turnless_tables(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert T.prefix_trie(spark.createDataFrame([], kind)).count() == 0
    assert T.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], kind)).count() == 0
    rows = [(c, 0, "user", "only") for c in range(1, 60)]  # no conversation 0: many lose their only turn and borrow none
    got = sorted(map(tuple, T.prefix_trie(spark.createDataFrame(rows, kind)).collect()), key=str)
    assert got == brute(rows) and any(r[1] == 0 and r[7] != hashlib.sha256().hexdigest() for r in got)


def test_memory_of_a_sweep_is_bounded():
    """Nodes that wait for their parent and ids in hand stay below their bounds, whatever the number of children."""
    sweep = T.Sweep(0, held=50, chunk=100)
    for i in range(5000):
        sweep.add(["A" * T.NAME] if i % 2 == 0 and i < 2000 else ["B" * T.NAME, f"{i:020d}"], [3] if i % 2 == 0 and i < 2000 else [3, 4], i)
        assert sweep.held <= 50 and all(len(n.ids) <= 120 for n in sweep.stack)


def jump_by_hand(key, shards):
    at, ahead = -1, 0
    while ahead < shards:
        at = ahead
        key = (key * 2862933555777941757 + 1) % 2**64
        ahead = int((at + 1) * (2.0**31 / ((key >> 33) + 1)))
    return at


def seed_by_hand(doc_id):
    return int(hashlib.md5(("null" if doc_id is None else str(doc_id)).encode()).hexdigest()[:15], 16)


def test_jump_equals_the_published_loop():
    seeds = np.array([random.Random(i).randrange(2**60) for i in range(400)], np.int64)
    for n in (1, 2, 8, 9, 1000):
        assert S.jump(seeds, n).tolist() == [jump_by_hand(int(k), n) for k in seeds]
    assert len(S.jump(np.array([], np.int64), 8)) == 0


def test_growth_moves_rows_into_the_new_shard_alone():
    seeds = np.array([seed_by_hand(i) for i in range(20_000)], np.int64)
    for n in (1, 7, 8, 50):
        old, new = S.jump(seeds, n), S.jump(seeds, n + 1)
        moved = old != new
        assert set(new[moved].tolist()) == {n} and abs(moved.mean() - 1 / (n + 1)) < 0.02


def test_shards_equal_brute_force(spark, docs, rows):
    more = [(None, f"text {i % 40}", "en", "s", 1) for i in range(300)]  # a hot null key, with copies
    table = docs.select("doc_id", "text", "kept", "key", "count").unionByName(spark.createDataFrame([(d, t, True, "k", 1) for d, t, *_ in more], "doc_id long, text string, kept boolean, key string, count int"))
    got = [tuple(r) for r in S.shard_documents(table).collect()]
    places = {}
    for d, size, crc, law, shard, slot, grown in got:
        assert law == "key" and shard == jump_by_hand(seed_by_hand(d), 8) and grown == jump_by_hand(seed_by_hand(d), 9)
        places.setdefault(shard, []).append(((d is not None, d or 0), crc, size, slot))
    for x in places.values():
        x.sort(key=lambda r: r[3])
        assert [r[3] for r in x] == list(range(len(x))) and [r[:3] for r in x] == sorted(r[:3] for r in x)
    want = sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in [*rows, *more])
    assert sorted((str(r[0]), r[1], r[2]) for r in got) == want


def test_shards_of_an_empty_table_and_bad_counts(spark, empty):
    assert S.shard_documents(empty).count() == 0
    with pytest.raises(ValueError):
        S.jump_shard(F.col("doc_id"), 0)


def test_written_shards_keep_all_rows_and_columns(spark, docs, tmp_path):
    S.write_shards(docs, f"file://{tmp_path}/out", 8)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert sorted(map(str, back.drop("shard").collect())) == sorted(map(str, docs.collect()))
    assert back.filter(F.col("shard") != S.jump_shard(F.col("doc_id"), 8)).count() == 0


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_jump_shards"])
def test_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{sf}/{t}'")
    got = entry.QUERIES[name](spark, sf)
    want = con.execute(entry.ORACLE_SQL[name])
    assert sorted(d[0] for d in want.description) == sorted(got.columns)
    at = [[d[0] for d in want.description].index(c) for c in got.columns]
    assert sorted((tuple(str(r[i]) for i in at) for r in want.fetchall())) == sorted(tuple(map(str, r)) for r in got.collect())
