"""The corpus operators on edge cases, and against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagegrain.llm import bagminhash, bayes, cascade, entropy, feistel, grams, languages, licences, mixing, near, order, paragraphs, winnowing
from pagegrain.llm.common import table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, raw bigint, n_words string, kept int, size int, node int, w string"
ITEMS = "item_id bigint, text string"


def _rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    body = " ".join(word() for _ in range(120))
    long = " ".join(word() for _ in range(30_000))
    rows = [(1, body), (2, body), (2, body), (3, body.replace(body.split()[60], "changed", 1)), (4, None), (5, ""), (6, " \n\t "), (None, "null id words"), (None, None), (7, long), (8, "one"), (9, "a b c d"), (10, "." * 500), (11, "x" * 3000), (12, long[:2000] + " " + body + " " + word())]
    return [(i, t, "en" if i != 4 else None, None if i in (5, 7) else f"s{(i or 0) % 3}", len(t or ""), 1, "x", 2, 3, 4, "w") for i, t in rows]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 0, 1), (8, 0, None), (None, 1, 1), (9, None, 0)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    text = _rows()[0][1].split()
    return spark.createDataFrame([(1, " ".join(text[10:40])), (2, " ".join(text[50:55])), (3, None), (4, ""), (1, " ".join(text[10:40])), (None, "x"), (5, "zzz")], ITEMS)


OPS = {
    1: lambda s, d, lab, it: bayes.classified(s, d, lab, F.col("source"), F.concat_ws("/", "source", "lang")),
    2: lambda s, d, lab, it: bagminhash.near_classes(s, d),
    5: lambda s, d, lab, it: languages.identified(s, d, languages.learned(s, d)),
    7: lambda s, d, lab, it: cascade.cascade(d, cascade.ordered(d), cascade.BASE),
    8: lambda s, d, lab, it: mixing.taken(s, d),
    9: lambda s, d, lab, it: entropy.scored(s, d, lab.where("quality = 1")),
    10: lambda s, d, lab, it: winnowing.contamination(s, d, it),
}


@pytest.mark.parametrize("n", sorted(OPS))
def test_one_row_a_row(spark, edge, empty, labels, items, n):
    assert OPS[n](spark, edge, labels, items).count() == edge.count()
    assert OPS[n](spark, empty, labels, items).count() == 0
    assert OPS[n](spark, edge, labels.limit(0), items.limit(0)).count() == edge.count()


@pytest.mark.parametrize("run", [paragraphs.repeats, order.sequences, licences.scanned])
def test_free_row_counts(spark, edge, empty, run):
    run(spark, edge).collect()
    assert run(spark, empty).count() == 0


def test_filters_keep_columns(spark, edge, empty, items):
    for stage in (lambda d: cascade.filtered(d), lambda d: bagminhash.deduplicated(spark, d), lambda d: winnowing.decontaminated(spark, d, items), lambda d: mixing.mixed(spark, d)):
        assert stage(edge).columns == edge.columns
        assert stage(empty).count() == 0
    left = [r.doc_id for r in bagminhash.deduplicated(spark, edge).collect()]
    assert left.count(1) == 1 and 2 not in left and 3 not in left and left.count(None) == 2


def test_near_classes_of_copies(spark, edge):
    got = {r.doc_id: r.class_id for r in bagminhash.near_classes(spark, edge).collect() if r.doc_id is not None}
    assert got[1] == got[2] == got[3] == 1 and all(got[i] == i for i in (4, 5, 6, 7, 8, 9))


def _folded(text):
    return [w for w in re.split(r"[ \t\n\x0b\x0c\r]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]


def test_near_classes_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    bags = {r.doc_id: Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := _folded(r.text)) else Counter() for r in docs.collect()}
    parent = {i: i for i in bags}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(bags)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = bags[a], bags[b]
            both, common = sum(x.values()) + sum(y.values()), sum((x & y).values())
            if common and common >= 0.8 * (both - common):
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    assert {r.doc_id: r.class_id for r in bagminhash.near_classes(spark, docs).collect()} == {i: find(i) for i in ids}


def test_bag_minhash_is_unbiased():
    rng = np.random.default_rng(1)
    g = rng.integers(1, 2**62, 60).astype(np.uint64)
    x, y = rng.integers(1, 9, 60), rng.integers(1, 9, 60)
    y[:10] = 0
    on = y > 0
    sig = grams.bag_minhash(np.repeat([0, 1], [60, on.sum()]), np.concatenate((g, g[on])), np.concatenate((x, y[on])), 2, 4000)
    want = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 0.03 and np.isfinite(sig).all()


def test_words_and_shingles_of_blocks(monkeypatch):
    texts = pa.array(["A b  c\td\ne f", None, "", "x" * 50 + " y", "é ü\n"])
    want = grams.words(texts)
    monkeypatch.setattr(grams, "BLOCK", 7)
    got = grams.words(texts)
    assert all((a == b).all() for a, b in zip(want, got, strict=True)) and got.count.tolist() == [6, 0, 0, 2, 2]


def test_components_and_blocks(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.comp for r in near.components(spark, chain).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    rng = random.Random(5)
    core = list(range(100))
    sets = {i: sorted({*rng.sample(core, 88 if i % 2 else 97), *(1000 * i + k for k in range(1 + i % 6))}) for i in range(1, 41)}
    frame = spark.createDataFrame(list(sets.items()), "node bigint, items array<bigint>")
    keys = spark.createDataFrame([(5, i) for i in sets], "key bigint, node bigint")
    comp = {r.node: r.comp for r in near.classes(spark, keys, lambda n: frame.join(n, "node"), 0.8).collect()}
    for a in sets:
        for b in sets:
            x, y = set(sets[a]), set(sets[b])
            if a != b and len(x & y) >= 0.8 * len(x | y):
                assert comp[a] == comp[b]


def test_feistel_is_a_permutation(spark):
    for n in (1, 2, 3, 10, 101, 4096, 5000):
        got = [r[0] for r in spark.range(n).select(F.expr(feistel.permuted("id", f"{n}L", "99L"))).collect()]
        assert sorted(got) == list(range(n))


def test_winnowing_against_brute_force(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(12)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 80)))) for i in range(40)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 5)))) for i in range(20)]
    items += [(100 + i, " ".join(docs[i][1].split()[3 : 3 + rng.randint(5, 30)])) for i in range(20)]
    got = {r.doc_id: r for r in winnowing.contamination(spark, spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, ITEMS)).collect()}
    for i, text in docs:
        w, hit, ids = text.split(), set(), set()
        for k, item in items:
            v = item.split()
            n = min(13, len(v))
            spans = {tuple(v[a : a + n]) for a in range(len(v) - n + 1)} if v else set()
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in spans:
                    hit |= set(range(a, a + n))
                    ids.add(str(k))
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items) == (len(w), len(hit), len(ids))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def test_rules_give_one_verdict_in_any_order(spark):
    docs = table(spark, SF, "documents")
    one = cascade.cascade(docs, cascade.RULES).select("__pg_row.doc_id", "kept")
    two = cascade.cascade(docs, cascade.RULES[::-1], cascade.BASE).select("__pg_row.doc_id", "kept")
    assert one.exceptAll(two).count() == 0
    assert cascade.filtered(docs).count() == one.where("kept").count()


def test_mix_meets_targets(spark):
    docs = table(spark, SF, "documents")
    rows = mixing.taken(spark, docs).collect()
    assert sum(r.taken for r in rows) == pytest.approx(1.5 * sum(r["size"] for r in rows), rel=0.02)
    assert all(r.taken <= 2 * r["size"] for r in rows)
    assert sorted(rows) == sorted(mixing.taken(spark, docs.repartition(7)).collect())
    counts = {i: 0 for i in (r.doc_id for r in rows)}
    for r in mixing.mixed(spark, docs).collect():
        counts[r.doc_id] += len(_folded(r.text))
    assert counts == {r.doc_id: r.taken for r in rows}


def test_sequences_round_trip(spark, tmp_path):
    docs = table(spark, SF, "documents")
    out = order.sequences(spark, docs, shard_slots=50)
    rows = out.collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    again = order.sequences(spark, docs.repartition(5), shard_slots=50).collect()
    assert {(r.slot, bytes(r.tokens)) for r in rows} == {(r.slot, bytes(r.tokens)) for r in again}
    enc, last = order.encoding(vocabulary := open(order.TOKENIZER, "rb").read()), order.end_of(vocabulary)
    texts = {r.doc_id: r.text for r in docs.collect()}
    whole = Counter()
    for r in rows:
        for k, (doc, at) in enumerate(zip(r.doc_ids, r.starts, strict=True)):
            end = r.starts[k + 1] if k + 1 < len(r.starts) else r.n_tokens
            whole[doc] += end - at
            part = np.frombuffer(r.tokens, "<u2")[at:end].tolist()
            assert enc.decode([t for t in part if t != last]) in texts[doc] or "�" in enc.decode([t for t in part if t != last])
    assert whole == {i: len(enc.encode_ordinary(t)) + 1 for i, t in texts.items() if t}
    order.write_shards(out, str(tmp_path / "shards"))
    for r in rows[:20]:
        (file,) = (tmp_path / "shards" / f"shard={r.shard}").glob("part-*")
        with file.open("rb") as f:
            assert order.read_record(f, r.slot, shard_slots=50).tobytes() == bytes(r.tokens)


def test_repeated_passages_are_found(spark):
    docs = table(spark, SF, "documents")
    seen = {}
    for r in docs.collect():
        w = _folded(r.text)
        for k in range(len(w) - 49):
            seen.setdefault(tuple(w[k : k + 50]), set()).add(r.doc_id)
    want = set().union(*(v for v in seen.values() if len(v) > 1))
    got = {r.doc_id for r in paragraphs.repeats(spark, docs).collect()}
    assert want <= got and len(got) < docs.count() / 2


def test_repeated_passages_are_found_whole(spark):
    rng = random.Random(4)
    some = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, want = [], set()
    for k, n in enumerate((50, 57, 60, 69, 80, 120)):
        shared = some(n)
        for j in (0, 1):
            head = some(40 + 3 * j)
            rows.append((2 * k + j, " ".join(head + shared + some(60))))
            want.add((2 * k + j, len(head), n, 2, j == 1))
    a, b, c = some(30), some(60), some(30)
    rows += [(20, " ".join(some(9) + a + b + c + some(9))), (21, " ".join(a + b + c)), (22, " ".join(some(5) + b))]
    # 24 words more at each end of what all three hold belong to runs of the two.
    want |= {(20, 9, 30 + 24, 2, False), (20, 39, 60, 3, False), (20, 75, 24 + 30, 2, False), (21, 0, 54, 2, True), (21, 30, 60, 3, True), (21, 66, 54, 2, True), (22, 5, 60, 3, True)}
    got = paragraphs.repeats(spark, spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    lines = {(20, 0, 138), (21, 0, 120), (22, 0, 65)} | {(i, 0, len(t.split())) for i, t in rows}
    assert {(r.doc_id, r.first_word, r.n_words, r.n_class, r.removed) for r in got if (r.doc_id, r.first_word, r.n_words) not in lines} == want


def test_languages_are_found_out(spark):
    docs = table(spark, SF, "documents")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = languages.op5_languages(spark, SF).collect()
    test = [r for r in got if r.held_out]
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == lang[r.doc_id] for r in test) >= 0.95 * len(test)


def test_classifier_and_scores_separate(spark):
    labels = {r.doc_id: r for r in table(spark, SF, "labels").collect()}
    got = {r.doc_id: r for r in bayes.op1_bayes(spark, SF).collect()}
    right = [(got[i].p_quality >= 0.5) == (r.quality == 1) for i, r in labels.items()]
    assert sum(right) >= 0.9 * len(right)
    diff = {r.doc_id: r.ce_diff for r in entropy.op9_entropy(spark, SF).collect()}
    mean = lambda q: np.mean([diff[i] for i, r in labels.items() if r.quality == q])
    assert mean(1) < mean(0)


def test_scores_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    words = {r.doc_id: _folded(r.text) for r in docs.collect()}
    good = [i for i in words if i % 3 == 0]
    models = []
    for ids in (good, words):
        one = Counter(w for i in ids for w in words[i])
        models.append((one, Counter(p for i in ids for p in zip(words[i], words[i][1:], strict=False)), sum(one.values())))
    types = len(models[1][0])
    got = entropy.scored(spark, docs, docs.where("doc_id % 3 = 0"), chunk=100_000, bucket=70_000).collect()
    assert sorted(r.doc_id for r in got) == sorted(words)
    for r in got:
        w, mean = words[r.doc_id], []
        for (one, two, total), own in zip(models, (r.doc_id % 3 == 0, True), strict=True):
            loss = 0.0
            for k, x in enumerate(w):
                p = (one[x] - own + 0.5) / (total - 1 + 0.5 * types)
                before = one[w[k - 1]] - own if k else 0
                loss -= np.log2(0.6 * (two[w[k - 1], x] - own) / before + 0.4 * p if before > 0 else p)
            mean.append(loss / len(w))
        assert (r.n_tokens, r.ce_target, r.ce_background) == (len(w), pytest.approx(mean[0]), pytest.approx(mean[1]))


def test_licence_rules(spark):
    text = "Intro. Released under the MIT License.\nYou may not use this file except in compliance with the License. Licensed under CC BY-NC 4.0."
    got = [(r.licence, r.kind, r.n_sentences, r.first_sentence) for r in licences.scanned(spark, spark.createDataFrame([(1, text), (2, None), (3, "none")], "doc_id bigint, text string")).collect()]
    assert sorted(got) == [("CC-BY-NC-4.0", "reference", 3, 3), ("MIT", "reference", 3, 1)]


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
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT"""
APACHE = """/*
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version."""


def test_wrapped_licences(spark):
    texts = [MIT, APACHE, BSD, GPL, APACHE.replace("\n * ", " "), "It isn't licensed under the MIT\nLicense.", "Licensed under the MIT. License"]
    got = [(r.doc_id, r.licence, r.kind, r.n_sentences, r.first_sentence) for r in licences.scanned(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()]
    assert sorted(got) == [(0, "MIT", "text", 3, 1), (1, "Apache-2.0", "notice", 3, 1), (2, "BSD-2-Clause", "text", 3, 1), (3, "GPL-3.0-or-later", "notice", 1, 1), (4, "Apache-2.0", "notice", 3, 1)]


ENDORSE = """
3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software without
   specific prior written permission."""


def _licences(spark, texts):
    return sorted((r.doc_id, r.licence, r.kind, r.first_sentence) for r in licences.scanned(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect())


def test_longer_licences_come_first(spark):
    texts = [BSD + ENDORSE, BSD + ENDORSE + "\n" + BSD, BSD + "\n" + BSD + ENDORSE]
    assert _licences(spark, texts) == [(0, "BSD-3-Clause", "text", 1), (1, "BSD-2-Clause", "text", 5), (1, "BSD-3-Clause", "text", 1), (2, "BSD-2-Clause", "text", 1), (2, "BSD-3-Clause", "text", 4)]


def test_licence_families(spark):
    later = "This {} is free software; you can redistribute it and/or modify it\nunder the terms of the GNU {} Public License as published by the Free Software Foundation; either\nversion {} of the License, or (at your option) any later version."
    texts = {
        "// SPDX-License-Identifier: MIT\nint x;": ("MIT", "reference"),
        "# SPDX-License-Identifier: LGPL-2.1-or-later": ("LGPL-2.1-or-later", "reference"),
        later.format("library", "Lesser General", "2.1"): ("LGPL-2.1-or-later", "notice"),
        later.format("program", "General", "2"): ("GPL-2.0-or-later", "notice"),
        later.format("program", "Affero General", "3"): ("AGPL-3.0-or-later", "notice"),
        "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.": ("MPL-2.0", "notice"),
        "This project is licensed under the terms of the BSD 3-Clause License.": ("BSD-3-Clause", "reference"),
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": ("CC-BY-SA-4.0", "reference"),
        "Licensed under CC BY-NC-ND 3.0": ("CC-BY-NC-ND-3.0", "reference"),
        "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any\nmeans.": ("Unlicense", "text"),
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.": ("0BSD", "text"),
        "GNU GENERAL PUBLIC LICENSE\n  Version 2, June 1991\n\n Copyright (C) 1989 Free Software Foundation, Inc.\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.": ("GPL-2.0", "text"),
    }
    assert [x[1:3] for x in _licences(spark, list(texts))] == list(texts.values())


def test_licences_against_sql(spark):
    """Each known sentence and reference on a line, in the order of the catalogue and in another."""
    from pagegrain.llm import catalogue

    lines = [*catalogue.SENTENCES, *(f"licensed under the {n}" for n in catalogue.NAMES), *(f"spdx license identifier {x}" for x in catalogue.SPDX_IDS)]
    again = lines[:]
    random.Random(7).shuffle(again)
    rules = ["\n".join(next(s for s, i in catalogue.SENTENCES.items() if i == x) for x in ids) for _, kind, ids in catalogue.RULES if kind != "reference"]
    texts = [*lines, *rules, "\n".join(lines), "\n".join(again), "\n".join(rules), "\n".join(reversed(rules)), None, ""]
    docs = pa.table({"doc_id": list(range(len(texts))), "text": texts})
    import duckdb

    con = duckdb.connect()
    con.register("documents", docs)
    want = sorted(con.execute(f"select doc_id, licence, kind, n_sentences, first_sentence from ({licences.ORACLE})").fetchall())
    got = licences.scanned(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    assert sorted(map(tuple, got.select("doc_id", "licence", "kind", "n_sentences", "first_sentence").collect())) == want
    assert {licence for _, licence, *_ in want} == {licence for licence, _, _ in catalogue.RULES}


def test_pipeline_runs(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "mix_sources", "token_output"]
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.slot for r in got) == list(range(len(got))) and got


def _water_filled(sizes, weights, share=1.5, most=2):
    """Targets by the contract's words, one source after the other."""
    target, free = {}, set(sizes)
    while True:
        goal = share * sum(sizes.values()) - sum(target.values())
        now = {s: goal * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if now[s] > most * sizes[s]}
        if not over:
            return target | now
        target |= {s: most * sizes[s] for s in over}
        free -= over
        if not free:
            return target


def test_mix_targets_against_water_filling(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(0, 3000)), rng.choice(["b", "a", "c", "d", "é", None])) for i in range(300)]
    rows += [(1000 + i, "x y " * 40, "tiny") for i in range(3)] + [(None, "same words here", "hot")] * 2500
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    sizes, by_doc = Counter(), {}
    for i, text, source in rows:
        sizes[source] += len(text.split())
        by_doc[i] = source
    order_ = sorted(sizes, key=lambda s: (s is None, s))
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order_)}
    want, got = _water_filled(dict(sizes), weights), mixing.taken(spark, docs, shard_slots=16).collect()
    assert len(got) == len(rows)
    took = Counter()
    for r in got:
        source = by_doc[r.doc_id]
        assert r.target == pytest.approx(want[source]) and r.source_size == sizes[source] and r.taken <= 2 * r["size"]
        took[source] += r.taken
    assert all(took[s] == pytest.approx(want[s], rel=0.02, abs=200) for s in sizes)


def test_shards_draw_counts_and_hold_blocks(spark):
    docs = table(spark, SF, "documents")
    p = mixing.plan(spark, docs)
    quota = {r.sk: r.quota for r in p.sources.collect()}
    counts = mixing.shard_counts(spark, p, shard_slots=64).collect()
    by_shard, by_source = Counter(), Counter()
    for r in counts:
        by_shard[r.shard] += r.n
        by_source[r.sk] += r.n
    full = p.slots // 64
    assert by_source == {k: v for k, v in quota.items() if v} and all(by_shard[i] == 64 for i in range(full)) and by_shard[full] == p.slots % 64
    # Counts vary like multinomial ones: their variance is near n p (1 - p), not 0.
    big = max(quota, key=quota.get)
    share, seen = quota[big] / p.slots, [r.n for r in counts if r.sk == big and r.shard < full]
    assert 0.3 < np.var(seen) / (64 * share * (1 - share)) < 2.5
    laid = mixing.slots(spark, p, shard_slots=64).collect()
    assert sorted(r.slot for r in laid) == list(range(p.slots)) and all(r.slot // 64 == r.shard for r in laid)
    assert Counter((r.shard, r.sk) for r in laid) == {(r.shard, r.sk): r.n for r in counts}
    assert max(Counter((r.sk, r.block) for r in laid).values()) <= 2
    rows = mixing.mix(spark, docs, shard_slots=64)
    whole = mixing.blocks(rows).collect()
    assert sorted(r.slot for r in whole) == list(range(p.slots))
    assert sum(len(_folded(r.text)) == mixing.BLOCK_WORDS for r in whole) > 0.9 * len(whole)


def test_rules_are_ordered_by_rejection_per_cost(spark):
    rules = (cascade.Rule("dear", ("slow",), ""), cascade.Rule("some", ("quick",), ""), cascade.Rule("more", ("quick", "slow"), ""), cascade.Rule("none", ("free",), ""))
    # rows by verdict of each rule: `more` rejects most, but needs the costly feature; what `some` leaves, `dear` hardly rejects.
    seen = {(False, True, True, False): 40, (False, False, True, False): 30, (True, True, False, False): 20, (True, False, False, False): 1, (False, False, False, False): 9}
    assert [r.name for r in cascade.arranged(rules, seen, {"slow": 64.0, "quick": 1.0, "free": 0.5})] == ["some", "more", "dear", "none"]
    assert [r.name for r in cascade.arranged(rules, {}, {"slow": 64.0, "quick": 1.0, "free": 0.5})][:2] == ["none", "some"]
    docs = table(spark, SF, "documents")
    assert cascade.ordered(docs.limit(0)) == list(cascade.RULES)
    found = cascade.ordered(docs)
    assert sorted(r.name for r in found) == sorted(r.name for r in cascade.RULES)
    sample = spark.createDataFrame([(r.text,) for r in docs.collect()], "__pg_text string").coalesce(1)
    cost = cascade.costs(sample, ("n_symbols", "n_repeat_words"))
    assert cost["n_repeat_words"] > 2 * cost["n_symbols"]


def test_sequences_of_equal_rows_and_wide_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(order, "COPIES", 10)
    rows = [(1, "again and again")] * 35 + [(2, "once")] + [(None, "no id")] * 12
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = order.sequences(spark, docs, length=8).collect()
    enc = order.encoding(vocabulary := open(order.TOKENIZER, "rb").read())
    assert sorted(r.slot for r in got) == list(range(len(got)))
    assert sum(r.n_tokens for r in got) == sum(len(enc.encode_ordinary(t)) + 1 for _, t in rows)
    assert {r.slot: bytes(r.tokens) for r in got} == {r.slot: bytes(r.tokens) for r in order.sequences(spark, docs.repartition(2), length=8).collect()}
    wide = tmp_path / "wide.tiktoken"
    wide.write_bytes(vocabulary + b"\n" + __import__("base64").b64encode(b"qqqzzzqqq") + b" 70000\n")
    assert order.end_of(wide.read_bytes()) == 70001
    (one,) = order.sequences(spark, docs.where("doc_id = 2"), tokenizer=str(wide), length=8).collect()
    ids = np.frombuffer(one.tokens, "<u4")
    assert len(ids) == 8 and ids[one.n_tokens - 1] == 70001 and one.offset == 0


def test_slots_against_a_plain_feistel(spark):
    """The permutation of permuted(), stepped in Python over the hashes that Spark gives."""
    n, key = 1000, 7
    a = int(np.ceil(np.sqrt(n)))
    b = -(-n // a)
    hashes = {(x, k): h for x, k, h in spark.range(max(a, b)).crossJoin(spark.range(feistel.ROUNDS).selectExpr("cast(id as int) k")).selectExpr("id", "k", f"xxhash64(id, {key}L, k)").collect()}

    def once(x):
        left, right = x // b, x % b
        for k in range(feistel.ROUNDS):
            if k % 2 == 0:
                left = (left + hashes[right, k] % a) % a
            else:
                right = (right + hashes[left, k] % b) % b
        return left * b + right

    want = []
    for x in range(n):
        y = once(x)
        while y >= n:
            y = once(y)
        want.append(y)
    assert [r[0] for r in spark.range(n).orderBy("id").select(F.expr(feistel.permuted("id", f"{n}L", f"{key}L"))).collect()] == want


def test_null_items_hit_and_texts_of_blanks_stay(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "x")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in winnowing.contamination(spark, docs, spark.createDataFrame([(None, "b c"), (None, None)], ITEMS)).collect()}
    assert (got[1].n_hit, got[1].n_items, got[1].contaminated) == (2, 0, True) and got[2].n_hit == 0
    assert got[1].items_sha256 == hashlib.sha256(b"").hexdigest()
    blank = spark.createDataFrame([(1, "\n"), (1, "\n"), (1, " "), (1, " "), (2, "a"), (2, "a")], "doc_id bigint, text string")
    assert bagminhash.deduplicated(spark, blank).count() == 5


def test_heads_without_label_are_left_out(spark):
    good, bad = "fine words of a good text " * 5, "### $$$ *** junk %%% " * 5
    docs = spark.createDataFrame([(i, (good if i % 2 else bad) + str(i), "h", "p") for i in range(80)] + [(500 + i, good, "h", "p") for i in range(5)] * 4, "doc_id bigint, text string, host string, path string")
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(80)] + [(500, None, 1)], "doc_id bigint, quality int, toxic int")
    with_ = bayes.fitted(spark, docs, labels)
    without = bayes.fitted(spark, docs, labels.where("doc_id < 500"))
    assert np.allclose(with_[0], without[0])
    got = {r.doc_id: r for r in bayes.classified(spark, docs, labels, F.col("host"), F.col("path")).collect()}
    assert got[1].p_quality > 0.5 > got[2].p_quality


def test_site_posteriors_against_plain_python(spark):
    docs = table(spark, SF, "documents")
    labels = table(spark, SF, "labels")
    host, path = F.col("source"), F.concat_ws("/", "source", "lang")
    model = bayes.fitted(spark, docs, labels)
    rows = docs.select("doc_id", "text", host.alias("h"), path.alias("p")).collect()
    doc, feature, style = bayes._features(pa.array([r.text or "" for r in rows]))
    got = {r.doc_id: r for r in bayes.classified(spark, docs, labels, host, path).collect()}
    for w, head in zip(model, bayes.HEADS, strict=True):
        z = np.bincount(doc, w[feature], minlength=len(rows))[: len(rows)] + style @ w[bayes.DIMS : -1] + w[-1]
        p = 1 / (1 + np.exp(-z))
        hosts, paths = {}, {}
        for r, x in zip(rows, p, strict=True):
            hosts.setdefault(r.h, []).append(x)
            paths.setdefault((r.h, r.p), []).append(x)

        def weight(groups):
            n, s = sum(map(len, groups)), sum(map(sum, groups))
            mean = min(max(s / n, 1e-4), 1 - 1e-4)
            between = max(sum(sum(g) ** 2 / len(g) for g in groups) / n - mean**2, 1e-9)
            return mean, min(max(mean * (1 - mean) / between - 1, 1.0), 1e4)

        prior, hw = weight(list(hosts.values()))
        _, pw = weight(list(paths.values()))
        odds = lambda x: np.log(x / (1 - x))
        for r, x, own in zip(rows, z, p, strict=True):
            h, g = hosts[r.h], paths[r.h, r.p]
            up = (sum(h) - own + hw * prior) / (len(h) - 1 + hw)
            site = (sum(g) - own + pw * up) / (len(g) - 1 + pw)
            assert got[r.doc_id][f"p_{head}"] == pytest.approx(1 / (1 + np.exp(-(x + odds(site) - odds(prior)))), abs=1e-6)


def test_removed_tells_texts_of_one_id_apart(spark):
    rng = random.Random(8)
    shared = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    docs = spark.createDataFrame([(None, shared + " tail one"), (None, shared + " tail two")], "doc_id bigint, text string")
    got = paragraphs.repeats(spark, docs).collect()
    by_class = {}
    for r in got:
        by_class.setdefault(r.class_id, []).append(r.removed)
    assert by_class and all(sorted(v) == [False, True] for v in by_class.values())


def test_rules_keep_their_order_from_run_to_run(spark, edge):
    docs = table(spark, SF, "documents")
    first = cascade.sampled(docs, 50).collect()
    assert 25 < len(first) < 100 and sorted(first) == sorted(cascade.sampled(docs, 50).collect()) and cascade.sampled(docs, 10**6).count() > 150
    assert cascade.sampled(edge, 5).count() <= 5  # a frame without files gives its first rows
    orders = {tuple(r.name for r in cascade.ordered(docs)) for _ in range(5)}
    assert len(orders) == 1
    assert orders == {tuple(r.name for r in cascade.ordered(docs.select("text", "doc_id")))}


def test_long_runs_of_white_space_are_encoded_alike(spark):
    enc = order.encoding(open(order.TOKENIZER, "rb").read())
    rng = random.Random(4)
    bits = [" ", "  ", "\n", "\t", "\u3000", "\xa0", "\x1c", "a", "bc", "9", "é", "'s", "!", " \n", "."]
    for _ in range(500):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))
        assert order.ids_of(enc, text, 2).tolist() == enc.encode_ordinary(text) == order.ids_of(enc, text, 3).tolist()
    rows = [(1, " " * 1_500_000 + "x"), (2, "\n" * 1_500_000), (3, "a" + "\t " * 800_000 + "b c")]
    got = order.sequences(spark, spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    ids = {i: [] for i, _ in rows}
    for r in sorted(got, key=lambda r: r.slot):
        tokens = np.frombuffer(bytes(r.tokens), np.uint16)
        for doc, a, b in zip(r.doc_ids, r.starts, [*r.starts[1:], r.n_tokens], strict=True):
            ids[doc].append(tokens[a:b])
    end = order.end_of(open(order.TOKENIZER, "rb").read())
    # Slots are permuted, so a document's sequences are compared as multisets of tokens.
    for i, text in rows:
        assert Counter(np.concatenate(ids[i]).tolist()) == Counter([*order.ids_of(enc, text).tolist(), end])


def test_rows_that_differ_in_what_is_null_are_told_apart(spark):
    rows = [(1, "w " * 200, "s", "x", None, [1, None], {"a": 1}), (1, "w " * 200, "s", None, "x", [None, 1], {"a": 1}), (1, "w " * 200, "s", None, "x", [1, None], {"a": 1}), (1, "w " * 200, "s", None, "x", [1, None], {"a": 2})]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, a string, b string, c array<int>, d map<string, int>")
    got = mixing.mixed(spark, docs).select("a", "b", "c", "d").collect()
    assert {(r.a, r.b, tuple(r.c), tuple(r.d.items())) for r in got} == {(r[3], r[4], tuple(r[5]), tuple(r[6].items())) for r in rows}
