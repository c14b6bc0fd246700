"""Full and multi-hop retrieval against a plain loop over chunks, with all channels, clashing ids, ties and nulls."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from skarn.functions import text as T
from skarn.operators import evidence as E
from skarn.operators import retrieval as R

SCHEMA = "doc_id int, source string, ord int, page int, text string, label string, caption string, section string, chunk_type string, is_figure boolean, is_table boolean"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
RESULT = ["result", "observation", "evaluation", "discussion", "scaling"]
CAPTION = ["comparison", "scaling", "degrade", "performance", "score", "versus", "vs"]
COMPARES = ["outperform", "crossover", "tradeoff", "trade-off", "threshold", "input context", "context length", "scaling", "better", "degrade", "versus", "vs"]
WORDS = "encoder decoder attention accuracy dropout training latency baseline gradient corpus tokens layers".split()


def made(seed, n=40):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        figure = rng.random() < 0.3
        table = figure and rng.random() < 0.4
        text = " ".join(rng.choice(WORDS) for _ in range(rng.randrange(3, 12))) + rng.choice(["", " see Figure 3", " in Table 2", " Fig. 5"])
        label = rng.choice(["Figure 3", "Table 2", "figure  5", "", None]) if figure else ""
        rows.append((i * 7 % 101, rng.choice("ab"), i, rng.randrange(1, 5), text, label, rng.choice(["score comparison", "a map", "", None]) if figure else "", rng.choice(["Results", "Method", "Evaluation", "", None]), rng.choice(["result", "method", "body", "experiment"]), figure, table))
    return rows


def units(pages=4):
    return [(1000 + i, s, 500 + i, p, f"{WORDS[p]} page of {s}", f"Page {p}", "", "Full-page visual", "page_visual", True, False) for i, (s, p) in enumerate((s, p) for s in "ab" for p in range(1, pages + 1))]


ASKED = {
    1: "What accuracy has the encoder?",
    2: "Compare the scaling of dropout in Figure 3 versus Table 2",
    3: "Which plot shows latency on page 2?",
    4: "What result does the method report for attention in the limitation section",
    5: "how accurate is the baseline score table",
    6: "the of",
}


def loop(rows, page_rows, question, signals, bm25, limit, dense, images, pages, image_floor, page_floor, first=None):
    """One question, as the composition is specified: channels, fusion, priors, reranking, slots, pins."""
    if not signals["tokens"]:
        return []
    low, info = question.lower(), {r[0]: dict(zip(COLUMNS, r)) for r in [*rows, *page_rows]}
    norm = lambda s: re.sub(r"\s+", " ", (s or "").lower().strip())
    order = sorted(rows, key=lambda r: ({"table": not r[10], "figure": not r[9]}.get(first, False), r[2]))
    lexical = []
    for r in order:
        c, s = info[r[0]], bm25.get(r[0], 0.0)
        if s > 0 or c["is_figure"] and (signals["visual"] or c["is_table"] and signals["tabular"]):
            lexical.append((max(s, 0.08 if c["is_table"] and signals["tabular"] else 0.05 if c["is_figure"] else 0.0), s > 0, r[0]))
    lexical.sort(key=lambda x: -x[0])
    lex, overlaps = [d for *_, d in lexical], {d for _, o, d in lexical if o}
    bridged = {ref for d in lex[:5] + dense[:5] if not info[d]["is_figure"] for ref in signals["refs_of"][d]}
    comparative, modal = signals["comparative"], []
    for r in order:
        c = info[r[0]]
        label, caption, section = norm(c["label"]), f"{c['caption'] or ''} {c['label'] or ''}".lower(), (c["section"] or "").lower()
        score = 0.0
        if label and label in bridged:
            score += 3.0
        elif c["is_table"] and signals["tabular"]:
            score += 2.5
        elif c["is_figure"] and comparative and any(w in caption for w in [*CAPTION, "benchmark"]):
            score += 3.0
        elif c["is_figure"] and signals["visual"]:
            score += 2.0
        elif c["is_table"] and ("table" in low or "result" in signals["hints"]):
            score += 2.0
        if comparative and (c["chunk_type"] in ("result", "experiment") or any(w in section for w in RESULT)):
            score += 2.5
        score += 1.0 * (str(c["page"]) in signals["pages"]) + 0.8 * (c["chunk_type"] in signals["hints"] or any(h in section for h in signals["hints"]))
        if score > 0:
            modal.append((-round(score, 6), len(modal), r[0]))
    image = [d for d, s in images if s >= image_floor]
    page = [d for d, s in pages if s >= page_floor]
    rrf = {}
    for channel in (lex, dense, [d for *_, d in sorted(modal)], image, page):
        for rank, d in enumerate(channel, 1):
            rrf[d] = rrf.get(d, 0.0) + 1 / (60 + rank)
    top = sorted(rrf, key=lambda d: (-round(rrf[d], 12), d))[: max(limit * 6, 25)]
    near = {(info[d]["source"], info[d]["page"]) for d in lex[:5] + dense[:5]}
    scored = []
    asked = set(re.findall(r"\w+", low))
    for d in top:
        c, label = info[d], norm(info[d]["label"])
        is_bridged = bool(label) and label in bridged
        boost = 0.0
        if d in image and (d in overlaps or is_bridged or label and label in signals["refs"]):
            boost += min(0.12, 0.12 / math.sqrt(image.index(d) + 1))
        if d in page and (c["source"], c["page"]) in near:
            boost += min(0.10, 0.10 / math.sqrt(page.index(d) + 1))
        text = f"{c['text'] or ''} {c['section'] or ''}".lower()
        words = set(re.findall(r"\w+", text))
        if is_bridged:
            boost += 0.35
        elif "table" in low and c["is_table"] or ("figure" in low or "plot" in low) and c["is_figure"]:
            boost += 0.2
        if any(w in low for w in COMPARES):
            boost += 0.25 * (c["chunk_type"] in ("result", "experiment") or any(w in text for w in RESULT))
            boost += 0.25 * (c["is_figure"] and any(w in f"{c['caption'] or ''} {c['label'] or ''}".lower() for w in CAPTION))
        scored.append((-round(min(1.0, 0.5 * len(asked & words) / max(len(asked | words), 1) + 0.3 * round(rrf[d], 6) + boost), 4), d))
    best = [d for _, d in sorted(scored, key=lambda x: x[0])][:limit]
    for channel in (image, page):
        found = next((d for d in top if d in channel), None)
        if found is not None and found not in best:
            best = best[: limit - 1] + [found]
    pins, seen = [], set()
    for r in order:
        label = norm(r[5])
        if r[9] and label in signals["refs"] and label not in seen:
            pins.append(r[0])
            seen.add(label)
    return pins + [d for d in best if d not in pins][: max(limit - len(pins), 0)]


def facts(spark, rows, asked):
    """What tested text functions read from the questions and chunks."""
    q = spark.createDataFrame(list(asked.items()), "q_id int, text string")
    read = q.select("q_id", T.tokenize("text").alias("tokens"), T.visual_intent("text").alias("visual"), T.tabular_intent("text").alias("tabular"), T.section_hints("text").alias("hints"), T.page_hints("text").alias("pages"), F.lower("text").rlike(T.COMPARATIVE).alias("comparative"), T.figure_refs("text").alias("refs"))
    signals = {r.q_id: r.asDict() for r in read.collect()}
    chunks = spark.createDataFrame(rows, SCHEMA)
    refs = {r.doc_id: r.refs for r in chunks.select("doc_id", T.figure_refs("text").alias("refs")).collect()}
    bm25 = {}
    for r in R.bm25(chunks, q).collect():
        bm25.setdefault(r.q_id, {})[r.doc_id] = r.score
    for s in signals.values():
        s["refs_of"] = refs
    return chunks, q, signals, bm25


@pytest.mark.parametrize("seed", [1, 2])
def test_all_channels_equal_the_loop(spark, seed):
    rng = random.Random(seed)
    rows, page_rows = made(seed), units()
    chunks, q, signals, bm25 = facts(spark, rows, ASKED)
    some = lambda pool, n: rng.sample(pool, n)
    dense = {i: some([r[0] for r in rows], 9) for i in ASKED}
    images = {i: [(d, round(1 - k / 9, 3)) for k, d in enumerate(some([r[0] for r in rows if r[9]], 6))] for i in ASKED}
    pages = {i: [(d, round(0.5 - k / 10, 3)) for k, d in enumerate(some([r[0] for r in page_rows], 6))] for i in ASKED}
    ranked = lambda found: [(i, d, s, k) for i, x in found.items() for k, (d, s) in enumerate(x, 1)]
    kind = "q_id int, doc_id int, score double, rank int"
    got = E.retrieve(
        chunks, q, 4,
        spark.createDataFrame([(i, d, k) for i, x in dense.items() for k, d in enumerate(x, 1)], "q_id int, doc_id int, rank int"),
        spark.createDataFrame(ranked(images), kind), spark.createDataFrame(ranked(pages), kind), spark.createDataFrame(page_rows, SCHEMA), image_floor=0.4, page_floor=0.12,
    ).collect()
    for i, text in ASKED.items():
        want = loop(rows, page_rows, text, signals[i], bm25.get(i, {}), 4, dense[i], images[i], pages[i], 0.4, 0.12)
        assert [r.doc_id for r in sorted(got, key=lambda r: r.place) if r.q_id == i] == want, text


def test_words_alone_and_limits_of_their_own(spark):
    rows = made(5)
    chunks, q, signals, bm25 = facts(spark, rows, ASKED)
    limits, firsts = {i: i % 3 + 2 for i in ASKED}, {i: [None, "table", "figure"][i % 3] for i in ASKED}
    asked = q.join(spark.createDataFrame([(i, limits[i], firsts[i]) for i in ASKED], "q_id int, most int, first string"), "q_id")
    got = E.retrieve(chunks, asked).collect()
    for i, text in ASKED.items():
        want = loop(rows, [], text, signals[i], bm25.get(i, {}), limits[i], [], [], [], 0, 0, firsts[i])
        assert [r.doc_id for r in sorted(got, key=lambda r: r.place) if r.q_id == i] == want, text


def test_papers_with_clashing_chunk_ids_stay_apart(spark):
    """Two papers name their chunks alike; both chunks are ranked, and a repeated chunk of one paper once."""
    rows = [("p1", "chunk_001", 0, "encoder accuracy of one"), ("p2", "chunk_001", 1, "encoder accuracy of two"), ("p2", "chunk_001", 2, "encoder accuracy again"), ("p2", None, 3, "encoder unnamed"), (None, "chunk_001", 4, "encoder astray")]
    table = spark.createDataFrame([(*r, 1, "", "", "", "body", False, False) for r in rows], "source_paper_id string, chunk_id string, ord int, text string, page int, label string, caption string, section string, chunk_type string, is_figure boolean, is_table boolean")
    chunks = E.by_identity(table, "given")
    got = E.retrieve(chunks, spark.createDataFrame([(1, "encoder accuracy")], "q_id int, text string"), 9).collect()
    keys = sorted((r.doc_id.source, r.doc_id.kind, r.doc_id.id[:9]) for r in got)
    assert [k[:2] for k in keys] == [("given", "chunk_id"), ("p1", "chunk_id"), ("p2", "chunk_id"), ("p2", "content_sha256")]
    dense = chunks.filter("doc_id.source = 'p2' AND doc_id.kind = 'chunk_id'").select(F.lit(1).alias("q_id"), "doc_id", F.lit(1).alias("rank"))
    first = sorted(E.retrieve(chunks, spark.createDataFrame([(1, "encoder accuracy")], "q_id int, text string"), 9, dense).collect(), key=lambda r: r.place)[0]
    assert first.doc_id.source == "p2"


def test_multi_hop_equals_the_loop(spark):
    rows = made(8)
    parts = {1: [("SQ1", "define dropout", None), ("SQ2", "latency of the baseline table", "table"), ("SQ3", "unseen words only here", None)], 2: [("SQ1", "encoder accuracy", "figure")], 3: [("SQ1", "training gradient", None), ("SQ2", "attention layers", "figure")]}
    whole = {1: "Compare dropout and latency", 2: "encoder accuracy", 3: "what is attention"}
    level = {1: "L4", 2: "L3", 3: "L1"}
    limit, want, asked = 6, [], {}
    plans = {}
    for q, sub in parts.items():
        direct = len(sub) <= 1 or level[q] in ("L1", "L2")
        plans[q] = [("SQ1", whole[q], None, limit, True)] if direct else [(n, t, m, max(2, limit // len(sub) + 1), False) for n, t, m in sub]
        for k, (_, t, *_) in enumerate(plans[q]):
            asked[q * 10 + k] = t
    chunks, _, signals, bm25 = facts(spark, rows, asked)
    tokens = lambda texts: {r.t for r in spark.createDataFrame([(x,) for x in texts], "x string").select(F.explode(T.tokenize("x")).alias("t")).collect()}
    text_of = {r[0]: r[4] for r in rows}
    for q, plan in plans.items():
        out, seen = [], set()
        for k, (sq, text, modality, most, direct) in enumerate(plan):
            found = loop(rows, [], text, signals[q * 10 + k], bm25.get(q * 10 + k, {}), most, [], [], [], 0, 0, modality)
            mine, theirs = set(signals[q * 10 + k]["tokens"]), tokens([text_of[d] for d in found]) if found else set()
            if not found or not direct and len(mine) >= 3 and len(mine & theirs) / len(mine) < 0.1:
                continue
            role = "primary_evidence" if direct else {"SQ1": "method_definition", "SQ2": "ablation_support"}.get(sq, "final_result")
            out += [(q, d, sq, role) for d in found if not (d in seen or seen.add(d))]
        want += [(*x, i) for i, x in enumerate(out[:limit], 1)]
    got = E.multi_hop(chunks, spark.createDataFrame([(q, *x) for q, s in parts.items() for x in s], "q_id int, sq string, text string, modality string"), limit, spark.createDataFrame([(q, whole[q], level[q]) for q in whole], "q_id int, text string, level string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
