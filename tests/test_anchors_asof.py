"""Anchored containment and as-of joins against plain loops."""

import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from pagegrain.operators import containment
from pagegrain.operators.asof import asof


def _texts():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 3)))
    rows = [(i, rng.choice(["", " "]).join([word(), " "]) + " ".join(word() for _ in range(rng.randint(0, 40))) + rng.choice(["", "\n x", "😀"])) for i in range(80)]
    return [*rows, (5, rows[5][1]), (100, None), (101, ""), (None, "ab ab ab ab ab"), (102, "the the the the")]


def _sentences(texts):
    rng = random.Random(9)
    rows = []
    for i in range(120):
        text = rng.choice(texts)[1] or "none at all here"
        a = rng.randrange(len(text) + 1)
        rows.append((i, text[a : a + rng.choice([1, 2, 3, 5, 9, 20, 40])]))
    return [*rows, (3, rows[3][1]), (200, None), (201, ""), (202, "not in any of the texts"), (None, "ab ab"), (203, " "), (204, "the the the"), (205, "  "), (206, "😀")]


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_contained_like_a_plain_loop(spark, monkeypatch, few):
    monkeypatch.setattr(containment, "FEW", few)
    texts = _texts()
    sentences = _sentences(texts)
    got = containment.contained(spark, spark.createDataFrame(sentences, "sentence_key bigint, sentence string"), spark.createDataFrame(texts, "text_key bigint, text string"))
    want = Counter((s, t) for s, x in sentences if x for t, y in texts if y and x in y)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()


def test_contained_of_nothing(spark):
    none = spark.createDataFrame([], "sentence_key bigint, sentence string")
    texts = spark.createDataFrame(_texts(), "text_key bigint, text string")
    assert containment.contained(spark, none, texts).count() == 0
    some = spark.createDataFrame([(1, "a b c d e")], none.schema)
    assert containment.contained(spark, some, texts.limit(0)).count() == 0


def _plain(left, right, forward, wrap):
    out = []
    for i, k, t in left:
        own = [r for r in right if k is not None and r[0] == k and r[1] is not None]
        near = [r for r in own if t is not None and (r[1] >= t if forward else r[1] <= t)]
        pick = (min if forward else max)(near or (own if wrap else []), key=lambda r: (r[1], r[2]), default=None)
        out.append((i, k, t, pick and pick[2]))
    return Counter(out)


@pytest.mark.parametrize("rows", [500_000, 7])
@pytest.mark.parametrize("forward, wrap", [(False, False), (True, False), (True, True), (False, True)])
def test_asof_like_a_plain_loop(spark, rows, forward, wrap):
    rng = random.Random(2)
    key = lambda: rng.choice([0, 0, 0, 1, 2, None])  # noqa: E731  one key holds half of all rows
    time = lambda: rng.choice([None, *range(60)])
    left = [(i, key(), time()) for i in range(150)] + [(7, 0, 3)] * 4
    right = [(key(), time(), i) for i in range(60)] + [(5, 1, 99)]
    one = spark.createDataFrame(left, "id bigint, k bigint, at bigint").repartition(3)
    two = spark.createDataFrame(right, "k bigint, at bigint, v bigint").repartition(3)
    got = asof(spark, one, two, "k", "at", forward, wrap, rows)
    assert Counter((r.id, r.k, r["at"], r.found and r.found.v) for r in got.collect()) == _plain(left, right, forward, wrap)
    if rows < 100:
        assert asof(spark, one, two.limit(0), "k", "at", forward, wrap, rows).where("found is null").count() == len(left)
        assert asof(spark, one.limit(0), two, "k", "at", forward, wrap, rows).count() == 0


def test_contained_deals_out_no_candidates(spark, monkeypatch):
    monkeypatch.setattr(containment, "FEW", 20)  # in turns
    texts = _texts()
    sentences = _sentences(texts)
    got = containment.contained(spark, spark.createDataFrame(sentences, "sentence_key bigint, sentence string"), spark.createDataFrame(texts, "text_key bigint, text string"))
    assert Counter(tuple(r) for r in got.collect()) == Counter((s, t) for s, x in sentences if x for t, y in texts if y and x in y)
    assert "hashpartitioning" not in got._jdf.queryExecution().toString()


def test_sentences_of_few_words_share_no_anchor(spark, monkeypatch):
    """Else each is held against all texts that have one common word: work as the square of the input."""
    seen, write = [], containment.written
    monkeypatch.setattr(containment, "written", lambda *a: seen.append(write(*a)) or seen[-1])
    sentences = [(i, x) for i, x in enumerate([x for k in range(40) for x in (f"word alph{k:02}", f"one the alph{k:02}", f"one of the alph{k:02}")])]
    texts = [(i, "word one the of the word " * 3 + f"alph{i:02}. " + " ".join(x for _, x in sentences if x.endswith(f"{i:02}"))) for i in range(40)]
    got = containment.contained(spark, spark.createDataFrame(sentences, "sentence_key bigint, sentence string"), spark.createDataFrame(texts, "text_key bigint, text string"))
    assert Counter(tuple(r) for r in got.collect()) == Counter((s, t) for s, x in sentences for t, y in texts if x in y)
    assert sum(t.select("h").distinct().count() for t in seen if "h" in t.columns) == len(sentences)


@pytest.mark.parametrize("block", [1, 5, 1 << 15])
def test_windows_of_texts_at_all_places(monkeypatch, block):
    monkeypatch.setattr(containment, "BLOCK", block)
    texts = ["left out", "a", "", "éü😀 the end of it, and more of it than a block holds", "ab" * 40, "a"]
    batch = pa.RecordBatch.from_pydict({"text": texts}).slice(1)
    widths = list(containment.WIDTHS)
    (out,) = containment._found(widths, SimpleNamespace(value=np.full(1024, 255, np.uint8)), ["text"])(iter([batch]))
    for text, hs in zip(texts[1:], out.column("hs").to_pylist(), strict=True):
        raw = np.frombuffer(text.encode(), np.uint8)
        want = {int(h) for w in widths for i in range(len(raw) - w + 1) for h in containment._hashed(raw[i : i + w], [w])[w].view(np.int64)}
        assert len(hs) == len(want) and set(hs) == want
