"""The jobs: runs over growing input, after a crash, again, from the command line, and on hard rows."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs.ingest_chunks import FEED, ingest_chunks, windows_of
from jobs.retrieval_report import retrieval_report

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def words(n, start=0):
    return " ".join(f"w{i}" for i in range(start, start + n))


@pytest.fixture
def at(tmp_path):
    return lambda name: f"file://{tmp_path}/{name}"


def add(spark, rows, path):
    spark.createDataFrame([(*r, "s", 1) for r in rows], FEED).coalesce(1).write.mode("append").parquet(path)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def chunks_of(spark, out):
    return sorted((r.doc_id, r.chunk_no, r.text, r.batch, r.lang) for r in spark.read.parquet(f"{out}/chunks").collect())


def by_hand(doc_id, text, batch, lang, target, overlap):
    w, step, out, s = text.split(), max(target - overlap, 1), [], 0
    while w:
        out.append((doc_id, len(out) + 1, " ".join(w[s : s + target]), batch, lang))
        if s + target >= len(w):
            break
        s += step
    return out


def test_growing_feed(spark, at, tmp_path):
    run = lambda: ingest_chunks(spark, at("feed"), at("out"), at("mark"), target=20, overlap=5)
    add(spark, [(1, words(50), "en"), (2, words(20), None), (3, None, "fr"), (4, "  ", ""), (5, words(21), "fr"), (5, words(21), "fr"), (None, "no id", "en")], at("feed"))
    first = run()
    assert first == {"batches": 1, "read": 7, "papers": 5, "chunks": 6, "rejected": 1}
    want = by_hand(1, words(50), 0, "en", 20, 5) + by_hand(2, words(20), 0, "und", 20, 5) + by_hand(5, words(21), 0, "fr", 20, 5)
    assert chunks_of(spark, at("out")) == sorted(want)
    before = files(tmp_path / "out")
    assert run() == {"batches": 0, "read": 0, "papers": 0, "chunks": 0, "rejected": 0} and files(tmp_path / "out") == before

    # a second file: one paper again, one with another text, a new one
    add(spark, [(1, words(50), "en"), (2, words(30, 7), "de"), (6, words(3), "en")], at("feed"))
    second = run()
    assert second == {"batches": 1, "read": 3, "papers": 2, "chunks": 3, "rejected": 0}
    want += by_hand(2, words(30, 7), 1, "de", 20, 5) + by_hand(6, words(3), 1, "en", 20, 5)
    assert chunks_of(spark, at("out")) == sorted(want)
    now = files(tmp_path / "out")
    assert {k: v for k, v in now.items() if k in before} == before, "what an earlier run wrote stays untouched"
    papers = {(r.doc_id, r.batch): (r.n_words, r.n_chunks) for r in spark.read.parquet(f"{at('out')}/papers").collect()}
    assert papers == {(1, 0): (50, 3), (2, 0): (20, 1), (3, 0): (0, 0), (4, 0): (0, 0), (5, 0): (21, 2), (2, 1): (30, 2), (6, 1): (3, 1)}


def test_a_batch_that_is_run_again_gives_the_same_rows(spark, at, tmp_path):
    run = lambda: ingest_chunks(spark, at("feed"), at("out"), at("mark"), target=20, overlap=5)
    add(spark, [(1, words(50), "en"), (2, words(9), "fr")], at("feed"))
    run()
    add(spark, [(3, words(44), "en"), (1, words(50), "en")], at("feed"))
    run()
    want = chunks_of(spark, at("out"))
    for name in ("1", ".1.crc"):
        os.remove(tmp_path / "mark" / "commits" / name)  # as if the job had died before the batch was marked as done
    again = run()
    assert again["batches"] == 1 and again["papers"] == 1 and chunks_of(spark, at("out")) == want


def test_several_batches(spark, at):
    for i in range(3):
        add(spark, [(i, words(5, i), "en")], at("feed"))
    got = ingest_chunks(spark, at("feed"), at("out"), at("mark"), files_per_batch=1)
    assert got["batches"] == 3 and got["papers"] == 3 and sorted(r[3] for r in chunks_of(spark, at("out"))) == [0, 1, 2]


def test_empty_feed(spark, at):
    add(spark, [], at("feed"))
    got = ingest_chunks(spark, at("feed"), at("out"), at("mark"))
    assert got["papers"] == 0 and got["chunks"] == 0


@pytest.mark.parametrize("target,overlap", [(20, 5), (7, 0), (5, 9), (1, 0)])
def test_number_of_windows(spark, target, overlap):
    rows = spark.range(60).select("id", windows_of(F.col("id"), target, overlap).alias("n")).collect()
    if overlap < target:
        assert all(r.n == len(by_hand(0, words(r.id), 0, "", target, overlap)) for r in rows)
    assert rows[0].n == 0 and rows[1].n == 1


def test_command_line(spark, at, tmp_path):
    add(spark, [(1, words(50), "en")], at("feed"))
    config = tmp_path / "config.json"
    config.write_text(json.dumps({"documents": at("nowhere"), "out": at("out"), "checkpoint": at("mark"), "target": 20, "overlap": 5}))
    done = subprocess.run([sys.executable, f"{ROOT}/jobs/ingest_chunks.py", str(config), "--documents", at("feed")], capture_output=True, text=True, cwd=tmp_path, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "took 1 rows in 1 batches; wrote 1 papers, 3 chunks, 0 rejected rows" in done.stderr
    assert len(chunks_of(spark, at("out"))) == 3


def report(spark, out):
    hits = sorted((r.system, r.q_id, r.doc_id, r.score, r["rank"], r.gold) for r in spark.read.parquet(f"{out}/hits").collect())
    questions = sorted(map(str, spark.read.parquet(f"{out}/questions").collect()))
    return hits, questions, sorted(map(str, spark.read.parquet(f"{out}/summary").collect()))


def test_retrieval_report_by_hand_and_again(spark, at):
    passage = "gradient clipping keeps the training stable"
    docs = [(1, f"We note that {passage} in practice", "en"), (2, "stable training", "fr"), (3, "nothing here", "en"), (4, None, None), (5, "", "en"), (6, f"{passage}", None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(at("docs"))
    spark.createDataFrame([(7, passage), (8, "unseen words alone"), (9, None)], "item_id long, text string").write.parquet(at("asked"))
    first = retrieval_report(spark, at("docs"), at("asked"), at("out"), k=2, pool=3)
    hits, questions, summary = report(spark, at("out"))
    assert first["documents"] == 6 and first["questions"] == 3 and first["scored"] == 3
    best = {"bm25": [6, 1], "fused": [1, 6], "overlap": [1, 6]}  # the shorter text first; equal scores by doc_id
    assert {(s, d, r, g) for s, q, d, _, r, g in hits if q == 7} == {(s, d, r, True) for s, x in best.items() for r, d in enumerate(x, 1)}
    figures = {(r.system, r.q_id): (r.n_gold, r.first_rank, r.hit_1, r.ndcg_5) for r in spark.read.parquet(f"{at('out')}/questions").collect()}
    assert figures == {(s, 7): (2, 1, 1, 1.0) for s in ("bm25", "overlap", "fused")}
    langs = {(r.system, r.lang): r.cases for r in spark.read.parquet(f"{at('out')}/summary").collect()}
    assert langs == {(s, x): 1 for s in ("bm25", "overlap", "fused") for x in ("en", "und", "all")}
    assert retrieval_report(spark, at("docs"), at("asked"), at("out"), k=2, pool=3) == first and report(spark, at("out")) == (hits, questions, summary)


def test_retrieval_report_over_empty_tables(spark, at):
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(at("docs"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(at("asked"))
    assert retrieval_report(spark, at("docs"), at("asked"), at("out")) == {"documents": 0, "questions": 0, "hits": 0, "scored": 0, "summary": 0}
