"""Training-data operators against brute force, on hard small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skarn.llm import best_fit, exact_dedup, language_mixture, license_rules, line_quality, lsa_knn, secret_ledger, signature_join, simple8b, token_files, trie_bpe, word_ids

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())


def library(path):
    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


def split_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# 1: token files


def test_simple8b_round_trips():
    rng = np.random.default_rng(1)
    for i in range(200):
        runs = [rng.integers(0, 1 << int(rng.integers(1, 64)), rng.integers(0, 90), dtype=np.uint64) for _ in range(rng.integers(1, 9))]
        if i % 4 == 0:
            runs[0][: len(runs[0]) // 2] = 2**64 - 1
        packed = simple8b.pack_all(np.concatenate(runs), np.array([len(r) for r in runs]))
        assert all((simple8b.unpack(p) == r).all() for p, r in zip(packed, runs))
        flat, sizes = simple8b.unpack_all(packed)
        assert (flat == np.concatenate(runs)).all() and sizes.tolist() == [len(r) for r in runs]
    assert len(simple8b.pack(np.zeros(600, np.uint64))) == simple8b.HEAD_SIZE + 80
    with pytest.raises(ValueError):
        simple8b.unpack(simple8b.pack(np.arange(9))[:-1])


def test_word_ids_are_the_librarys():
    tok, coder = library(WORD), word_ids.ChunkEncoder(WORD, budget=2000)  # the table starts anew again and again
    texts = ["", "Hello, WORLD! it's", "a<|endoftext|>b <|startoftext|>", "ÉÀß naïve—x\x1cy\x85z\xa0w", "日本 é ﬁ Σς", "x" * 300, " \t\n", "don't 's 't 12.5%"]
    for _ in range(3):
        got = coder.encode([t.encode() for t in texts])
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files(spark, docs, rows, empty, tmp_path):
    path = f"file://{tmp_path}/tokens"
    token_files.write_token_files(docs, path, WORD, end_id=2, parts=3)
    got = [tuple(r) for r in token_files.read_token_files(spark, path, with_ids=True).orderBy("start").collect()]
    tok, start, want = library(WORD), 0, []
    for r in sorted(rows, key=lambda r: r[0]):
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids + [2]
        want.append((r[0], start, len(ids), crc(ids), ids))
        start += len(ids)
    assert got == want
    token_files.write_token_files(empty, f"{path}-empty", WORD)
    assert token_files.read_token_files(spark, f"{path}-empty").count() == 0


# 2: exact dedup


def dedup_want(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append((-len(r[1] or ""), r[0]))
    return sorted((r[0], min(g)[1], len(g), r[0] == min(g)[1]) for r in rows for g in [groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")]])


@pytest.mark.parametrize("bits", [16, 26])  # a full bitmap changes no result
def test_exact_dedup(docs, rows, empty, bits):
    got = exact_dedup.exact_dedup(docs, bitmap_bits=bits).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == dedup_want(rows)
    assert exact_dedup.exact_dedup(empty, bitmap_bits=bits).count() == 0


# 3: licences


def test_licenses(docs, rows, empty):
    got = {r.doc_id: r for r in license_rules.recognise_licenses(docs.drop("count", "key")).collect()}
    found = {i: r.licenses for i, r in got.items() if r.licenses}
    assert found == {14: "MIT", 15: "Apache-2.0"} and got[15].n_license_sentences == 3 and got[0].license_ids == ""
    assert license_rules.recognise_licenses(empty).count() == 0


def test_license_rules_are_ordered(spark):
    s = {i: k for k, i in license_rules.SENTENCES.items()}
    bsd = [s[i] for i in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")]
    texts = [". ".join(bsd), ". ".join(reversed(bsd)), f"{bsd[0]}. other words. {bsd[1]}. {bsd[2]}. {bsd[3]}", "All rights reserved. Released under the MIT License"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert [r.licenses for r in license_rules.recognise_licenses(df).orderBy("doc_id").collect()] == ["BSD-3-Clause", "", "", "LicenseRef-Reserved,MIT"]


def test_every_licence_name_under_every_verb(spark):
    names = {"CC BY 4.0": "CC-BY-4.0", "CC BY-SA 4.0": "CC-BY-SA-4.0", "CC BY-NC 4.0": "CC-BY-NC-4.0", "CC BY-NC-SA 4.0": "CC-BY-NC-SA-4.0", "CC BY-ND 4.0": "CC-BY-ND-4.0"}
    verbs = ("released", "available", "distributed", "published", "provided", "licensed")
    cases = [(f"This work is {v} under {the}{n}.", i) for v in verbs for the in ("", "the terms of ") for n, i in names.items()]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id int, text string")
    assert [r.licenses for r in license_rules.recognise_licenses(df).orderBy("doc_id").collect()] == [i for _, i in cases]


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE FOR ANY CLAIM."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
ENDORSE = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
BSD_AS_IS = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER BE LIABLE."""
GNU = """{} is free software{} you can redistribute it and/or modify
it under the terms of the GNU {} as published by
the Free Software Foundation{} {}.
"""
LATER = "either version {} of the License, or\n(at your option) any later version"
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
CC = "This work is licensed under a Creative Commons {} 4.0 International License. To view a copy, visit"


def test_real_licence_texts(spark):
    general = {"": "General Public License", "L": "Lesser General Public License", "A": "Affero General Public License"}
    gnu = lambda who, k, n, part=":", later=True: GNU.format(who, part, general[k], ";" if part == ";" else ",", (LATER if later else "version {}").format(n))
    cases = [
        ("The software is provided as is without warranty of any kind, express or implied.", "", "0:mit-as-is"), (MIT, "MIT"), ("".join(f" * {x}\n" for x in MIT.split("\n")), "MIT"), (MIT.replace("\n", " "), "MIT"),
        (APACHE, "Apache-2.0"), (APACHE.replace("\n", "\r\n# "), "Apache-2.0"), ("This project is licensed under the MIT License.", "MIT"), ("Released under the MIT License.", "MIT"),
        (gnu("This program", "", 3), "GPL-3.0-or-later"), (gnu("This program", "", 2, ";"), "GPL-2.0-or-later"), (gnu("Some Tool", "", 3), "GPL-3.0-or-later"), (gnu("This program", "", 3, later=False), "GPL-3.0-only"),
        (gnu("This program", "", 2, ";", later=False), "GPL-2.0-only"), (gnu("This library", "L", 3), "LGPL-3.0-or-later"), (gnu("This library", "L", "2.1", ";"), "LGPL-2.1-or-later"), (gnu("This library", "L", 3, later=False), "LGPL-3.0-only"),
        (gnu("This program", "A", 3), "AGPL-3.0-or-later"), (gnu("This program", "A", 3, later=False), "AGPL-3.0-only"), ("This file is licensed under the\nGNU General Public License v3.0", "GPL-3.0-only"),
        (BSD + BSD_AS_IS, "BSD-2-Clause"), (BSD + ENDORSE + BSD_AS_IS, "BSD-3-Clause"), (BSD.replace("1.", "Other words.\n1.") + BSD_AS_IS, ""), ("Released under the BSD 3-Clause License", "BSD-3-Clause"), (MPL, "MPL-2.0"),
        ("Copyright (c) 2020 A. Person. All rights reserved.\n\n" + BSD + BSD_AS_IS, "LicenseRef-Reserved,BSD-2-Clause"), (CC.format("Attribution"), "CC-BY-4.0"), (CC.format("Attribution-ShareAlike"), "CC-BY-SA-4.0"),
        (CC.format("Attribution-NonCommercial"), "CC-BY-NC-4.0"), (CC.format("Attribution-NonCommercial-ShareAlike"), "CC-BY-NC-SA-4.0"), (CC.format("Attribution-NoDerivatives"), "CC-BY-ND-4.0"), ("\n" * 20_000 + MIT + "\nmore" * 20_000, "MIT"),
        ("This software is free of bugs. It is licensed under a licence.", ""), ("Title\n\n  \nBy A. Person.\nReleased under the MIT License.\nMore", "MIT", "4:mit-name"),
    ]
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "doc_id int, text string")
    got = license_rules.recognise_licenses(df).orderBy("doc_id").collect()
    assert [r.licenses for r in got] == [c[1] for c in cases]
    assert all(r.license_ids == c[2] for r, c in zip(got, cases) if len(c) > 2)
    assert {name for name, _ in license_rules.RULES + license_rules.MORE_RULES} - {"LGPL-2.1-only"} <= {x for r in got for x in r.licenses.split(",")}


def test_licenses_equal_sql_on_the_given_tables(spark):
    from skarn.llm import entry, sql

    c = duckdb.connect()
    c.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.1/documents.parquet'")
    got = entry.QUERIES["op3_license_rules"](spark, "/root/testdata/sf0.1").collect()
    assert sorted(tuple(r) for r in got) == sorted(c.sql(sql.LICENSES).fetchall())


# 4: secrets

PATTERNS = [
    ("assign", re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 1, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
]


def secret_want(text):
    spans = sorted((m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(PATTERNS) for m in p.finditer(text or "") if len(m[g]) >= n)
    return ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in spans)


def test_secrets_and_ledger(spark, docs, rows, empty, tmp_path):
    path = f"file://{tmp_path}/ledger"
    assert secret_ledger.scan_secrets(empty, path).count() == 0
    for _ in range(2):  # the second run scans nothing new
        got = secret_ledger.secret_columns(secret_ledger.scan_secrets(docs, path)).collect()
        assert sorted((r.doc_id, r.spans) for r in got) == sorted((r[0], secret_want(r[1])) for r in rows)
        assert all(r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest() for r in got)
        assert secret_ledger.read_ledger(spark, path).count() == len({r[1] or "" for r in rows})
    secret_ledger.scan_secrets(docs, path, version="other").count()
    assert secret_ledger.read_ledger(spark, path).count() == 2 * len({r[1] or "" for r in rows})


def test_secret_edges_and_redaction(spark):
    texts = ["é password=abcdefgh token: abcdefghi", "secret=token: abcdefghijk", "PassWord : 'x'", "ſecret=abcdefgh1", "0" * 31 + "g" + "a" * 33, "AKIA" + "B" * 11, "api_key=0123456789abcdef0123456789abcdef!", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("spans", secret_ledger.secret_spans(F.col("text")))
    got = df.select("doc_id", secret_ledger.spans_text(F.col("spans")).alias("s"), secret_ledger.redacted(F.col("text"), F.col("spans")).alias("t")).orderBy("doc_id").collect()
    assert [r.s for r in got] == [secret_want(t) for t in texts]
    assert got[0].t == "é [secret] [secret]" and got[6].t == "[secret]!" and got[8].t is None


# 5: quality rules


def line_want(rows, share=0, whole=True):
    plain = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x.lower()).strip(" ")
    host = lambda r: r[3] or ""
    texts, held = defaultdict(set), defaultdict(set)
    for r in rows:
        t = r[1] or ""
        unit = (r[0], t) if whole else t
        texts[host(r)].add(unit)
        for x in t.split("\n"):
            if split_words(x):
                held[host(r), plain(x)].add(unit)
    out = []
    for r in rows:
        t, w = r[1] or "", split_words(r[1])
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        times = Counter(windows)
        repeated = len({i + k for i, x in enumerate(windows) if times[x] > 1 for k in range(5)})
        lines = [x for x in t.split("\n") if split_words(x)]
        removed = sum(len(split_words(x)) for x in lines if len(held[host(r), plain(x)]) > 20 and len(held[host(r), plain(x)]) > share * len(texts[host(r)]))
        failed = len(w) < 10 or 100 * repeated > 20 * len(w)
        rest = len(w) - removed
        kept = not failed and not (removed and (rest < 10 or rest < 0.3 * len(w)))
        out.append((r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeated, failed, kept, removed))
    return sorted(out)


def test_line_quality(docs, rows, empty):
    for share, whole in ((0, True), (0.1, False)):
        got = line_quality.line_quality(docs, share=share, whole_documents=whole).collect()
        assert sorted(tuple(r) for r in got) == line_want(rows, share, whole)
    assert line_quality.line_quality(empty).count() == 0


def test_line_limit_does_not_grow_with_the_host(spark):
    body = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    common, copied = "a line that many pages of the host hold", "copied page " + body("c", 20)
    texts = [f"{common}\n" * 3 + body(i, 5) for i in range(25)] + [copied] * 21 + [body(i, 30) for i in range(25, 400)]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(50 + i % 2, texts[50 + i % 2], "s") for i in range(60)]  # repeated rows are no documents
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string")
    got = {r.doc_id: r for r in line_quality.line_quality(docs).collect()}
    assert [i for i in range(400) if got[i].n_removed_words] == list(range(46))  # 25 texts of 401 are below a tenth of the host
    assert all(not got[i].kept for i in range(25, 46)) and got[50].kept
    assert sum(r.n_removed_words for r in line_quality.line_quality(docs, share=0.1, whole_documents=False).collect()) == 0


def test_line_quality_equals_sql(spark):
    from skarn.llm import entry, sql

    c = duckdb.connect()
    c.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.1/documents.parquet'")
    got = entry.QUERIES["op5_line_quality"](spark, "/root/testdata/sf0.1")
    want = c.sql(sql.LINES).fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert any(r[-1] for r in want)


# 6: quality classifier


def test_quality_on_held_out_rows(spark, sf):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = lsa_knn.quality(d, lab).join(lab, "doc_id").filter("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95 and got.score.between(0, 1).all()
    bad, good = got[got.quality == 0].score, got[got.quality == 1].score
    assert np.mean([b < g for b in bad for g in good]) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.itertuples())


def test_quality_ignores_everything_but_text(spark, docs, empty):
    lab = spark.createDataFrame([(i, i % 2 if i != 5 else None) for i in range(3, 40)], "doc_id long, quality int")
    one = {r.doc_id: r.score for r in lsa_knn.quality(docs, lab).collect()}
    two = {r.doc_id: r.score for r in lsa_knn.quality(docs.withColumns({"lang": F.lit("zz"), "source": F.lit("q")}), lab).collect()}
    assert one == two and one[0] == one[1] == one[2]
    assert lsa_knn.quality(empty, lab).count() == 0
    assert {r.score for r in lsa_knn.quality(docs, lab.limit(0)).collect()} == {0.5}


def test_votes_are_exact_neighbours():
    texts = [f"alpha beta {w} gamma".encode() for w in ("one", "two", "three", "four!!", "FIVE", "$$$")]
    m = lsa_knn.LatentVoters(texts, [1, 1, 1, 0, 0, 0], neighbours=3)
    bags = lsa_knn.Bags()
    near = lsa_knn._projected(lsa_knn._rows(bags, texts[:1], m.idf), m.axes)
    sims = (near @ m.vectors.T)[0]
    top = np.argsort(-sims, kind="stable")[:3]
    power = np.exp(lsa_knn.SHARPNESS * (sims[top] - sims.max()))
    assert m.score(texts[:1], bags, 0.5)[0] == pytest.approx(((power * m.labels[top]).sum() / power.sum()) ** lsa_knn.EXPONENT, abs=1e-5)


# 7: language


def test_languages_on_held_out_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_mixture.languages(d).join(d.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()


def test_language_edges(spark, empty):
    texts = {"en": "the house and the garden with a tree", "fr": "la maison et le jardin avec un arbre"}
    rows = [(i, texts["en" if i % 2 else "fr"] + f" {i}", "en" if i % 2 else "fr") for i in range(60)] + [(100, None, "en"), (101, "12 !", "fr"), (102, texts["en"] + " " + texts["fr"], None), (103, "Δ", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_mixture.languages(d).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "fr") for i in range(60))
    assert got[100].lang_pred == got[101].lang_pred == "und" and got[103].lang_pred in ("en", "fr")
    assert set(got[102].lang_mix) == {"en", "fr"}
    assert language_mixture.languages(empty).count() == 0
    assert {r.lang_pred for r in language_mixture.languages(d.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# 8: BPE


def test_bpe_is_the_librarys(docs, rows, empty):
    tok = library(BYTE)
    got = {r.doc_id: r for r in trie_bpe.bpe_round_trip(docs, BYTE, with_ids=True).collect()}
    for i, text, *_ in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].decoded == tok.decode(ids, skip_special_tokens=False)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert trie_bpe.bpe_round_trip(empty, BYTE).count() == 0


def test_bpe_words():
    tok, coder = library(BYTE), trie_bpe.TrieBpe(BYTE)
    rng = np.random.default_rng(3)
    letters = list("aabbeeeethingnor  '.,0123456789\n\tÉü日😀\x85")
    for _ in range(1500):
        s = "".join(rng.choice(letters, rng.integers(0, 25)))
        assert np.frombuffer(coder.encode([s])[0], "<u4").tolist() == tok.encode(s, add_special_tokens=False).ids, s
    bad = np.array([tok.token_to_id("Ã"), tok.token_to_id("Ġ")], "<u4").tobytes()
    assert coder.decode(bad) == tok.decode(np.frombuffer(bad, "<u4").tolist(), skip_special_tokens=False)


# 9: n-gram join


def sets_of(text, k=4):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in split_words(text)]
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def groups_want(rows, k=4, need=85):
    sets = [(r[0], sets_of(r[1], k)) for r in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= need * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return sorted((i, len(s), find(i)) for i, s in sets)


def near_rows(n=60, seed=2):
    """Chains and clusters of texts that differ by a few words, around the limit, and many that share one passage."""
    rng = np.random.default_rng(seed)
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for c in range(6):
        words = [f"c{c}w{i}" for i in range(int(rng.integers(3, 90)))]
        for _ in range(n // 6):
            words = list(words)
            for _ in range(int(rng.integers(0, 3))):
                words[int(rng.integers(0, len(words)))] = f"r{rng.integers(0, 10**9)}"
            rows.append((len(rows), " ".join(words if rng.random() < 0.7 else words + passage)))
    return rows + [(len(rows) + i, " ".join(passage + [f"u{i}"] * (i % 4))) for i in range(12)]


@pytest.mark.parametrize("k,need", [(4, 85), (5, 80)])
def test_linked_groups(spark, docs, rows, empty, k, need):
    got = signature_join.linked_groups(docs, k, need).collect()
    assert sorted(tuple(r) for r in got) == groups_want(rows, k, need)
    more = near_rows()
    got = signature_join.linked_groups(spark.createDataFrame(more, "doc_id long, text string").repartition(4), k, need).collect()
    assert sorted(tuple(r) for r in got) == groups_want(more, k, need)


def test_linked_groups_of_an_empty_table(empty):
    assert signature_join.linked_groups(empty).count() == 0


def test_tree_traversal_loses_no_pair():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 120, dtype=np.uint64)
    members, sets = [], {}
    for key in range(40):
        s = np.unique(np.concatenate([base[: rng.integers(60, 120)], rng.integers(0, 2**63, rng.integers(0, 25), dtype=np.uint64)]))
        sets[key] = set(s.tolist())
        sig = signature_join.signature(s)
        members.append((key, key, len(s), int.from_bytes(sig, "little"), 8 * len(sig)))
    top = signature_join.tree(members)
    found = set(signature_join.traverse(top, top, False))
    want = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert want <= found and len(found) < 40 * 39 / 2
    left, right = signature_join.tree(members[:20]), signature_join.tree(members[20:])
    assert {p for p in want if p[0] < 20 <= p[1]} <= set(signature_join.traverse(left, right, False))


def test_cells_cover_a_hot_group(spark):
    rows = spark.createDataFrame([(1, k, 50, k) for k in range(30)], "lead long, key long, n int, comp long")
    sig = signature_join.signature(np.arange(50, dtype=np.uint64) * np.uint64(7919))
    sigs = spark.createDataFrame([(k, bytearray(sig)) for k in range(30)], "key long, sig binary")
    got = {(r.a, r.b) for r in signature_join.tree_pairs(rows, sigs, False, cell=7).collect()}
    assert got == {(a, b) for a in range(30) for b in range(a + 1, 30)}


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (200, 201)]
    got = {r.key: r.comp for r in signature_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90, 200: 200, 201: 200}


# 10: packing


def test_packing(docs, rows, empty):
    got = [tuple(r) for r in best_fit.best_fit_packing(docs, WORD).collect()]
    tok, want = library(WORD), []
    for r in rows:
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids + [0]
        want += [(r[0], k, a, len(ids[a : a + 2048]), crc(ids[a : a + 2048])) for k, a in enumerate(range(0, len(ids), 2048))]
    assert sorted(g[:5] for g in got) == sorted(want)
    bins = defaultdict(list)
    for g in got:
        bins[g[5]].append((g[6], g[3]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= 1.1 * -(-sum(g[3] for g in got) // 2048) + 1
    assert best_fit.best_fit_packing(empty, WORD).count() == 0


def test_open_bins_are_bounded():
    rng = np.random.default_rng(6)
    bins, used, opened = best_fit.OpenBins(100, 5), Counter(), Counter()
    for n in rng.integers(1, 101, 3000).tolist():
        number, offset = bins.place(n)
        assert offset == used[number]
        used[number] += n
        opened[number] += 1
        assert used[number] <= 100 and bins.open <= 5 and bins.open == sum(map(len, bins.bins))
        assert bins.bits == sum(1 << f for f, b in enumerate(bins.bins) if b)
