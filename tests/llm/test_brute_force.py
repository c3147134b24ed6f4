"""The language mixtures, the classifier's fit and the paragraph classes against plain Python."""

import math
import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from pagegrain.llm import bayes, entropy, languages, paragraphs
from pagegrain.llm.common import table

SF = "/root/testdata/sf0.001"


def _plain_em(words, allowed, k, rounds):
    """Shares of the languages in allowed after so many rounds, and the log likelihood (of each word against its best)."""
    share = [1 / len(allowed) if j in allowed else 0.0 for j in range(k)]
    for _ in range(rounds):
        new = [0.0] * k
        for w in words:
            joint = [(math.exp(max(x - max(w), -60)) + 1e-300) * s for x, s in zip(w, share, strict=True)]
            new = [a + b / sum(joint) for a, b in zip(new, joint, strict=True)]
        share = [x / len(words) for x in new]
    like = sum(math.log(sum((math.exp(max(x - max(w), -60)) + 1e-300) * s for x, s in zip(w, share, strict=True))) for w in words)
    return share, like


def _plain_mixture(words, k):
    full, _ = _plain_em(words, range(k), k, languages.ROUNDS)
    single = [sum(w[j] - max(w) for w in words) for j in range(k)]
    best = max(range(k), key=lambda j: (single[j], -j))
    share, score = [float(j == best) for j in range(k)], single[best]
    order = sorted(range(k), key=lambda j: (-full[j], j))
    for s in range(2, k + 1):
        new, like = _plain_em(words, order[:s], k, languages.ROUNDS)
        if like - score <= languages.PENALTY * 0.5 * math.log(max(len(words), 2)):
            break
        share, score = new, like
    return share


def test_mixtures_against_a_plain_em():
    rng = np.random.default_rng(3)
    k, mixed = 4, 0
    table = np.log(rng.dirichlet(np.full(languages.BUCKETS, 0.3), k).T + 1e-9).astype(np.float32)
    own = [np.argsort(-table[:, j])[:400] for j in range(k)]  # buckets that tell of a language
    bucket, doc, begins = [], [], []
    for d, langs in enumerate([(0,), (1, 2), (3,), (0, 1, 2, 3), (2,), (0, 3), (1,), ()] * 3):
        for _ in range(int(rng.integers(3, 40)) if langs else 0):
            begins.append(len(bucket))
            j = langs[int(rng.integers(len(langs)))]
            n = int(rng.integers(1, 6))
            bucket += rng.choice(own[j], n).tolist()
            doc += [d] * n
    got = languages.mixtures(table, np.array(bucket), np.array(doc), np.array(begins), 24)
    for d in range(24):
        words = [[float(np.sum(table[bucket[a:b], j], dtype=np.float64)) for j in range(k)] for a, b in zip(begins, [*begins[1:], len(bucket)], strict=True) if doc[a] == d]
        if not words:
            assert not got[d].any()
            continue
        want = _plain_mixture(words, k)
        mixed += sum(x > 0 for x in want) > 1
        assert got[d] == pytest.approx(want, abs=1e-3)
    assert mixed >= 6


def test_letter_windows_by_plain_python():
    texts = ["  abc é x1y  ", "", " zz   ", "日本 ok "]
    bucket, doc, begins, n = languages._tokens(pa.array([f" {t.lower()}   " for t in texts]))
    want = []
    data = "".join(f" {t.lower()}   " for t in texts).encode()
    letter = [c >= 128 or 97 <= c <= 122 for c in data]
    starts = np.cumsum([0, *[len(f" {t.lower()}   ".encode()) for t in texts]])
    folded = [c if ok else 32 for c, ok in zip(data, letter, strict=True)]
    for i in range(1, len(data) - 2):
        if letter[i]:
            key = folded[i - 1] << 24 | folded[i] << 16 | folded[i + 1] << 8 | folded[i + 2]
            want.append(((key * 2654435761 % (1 << 32)) >> 16, int(np.searchsorted(starts, i, "right")) - 1, i))
    assert n == 4 and bucket.tolist() == [w[0] for w in want] and doc.tolist() == [w[1] for w in want]
    assert begins.tolist() == [k for k, w in enumerate(want) if not k or want[k - 1][2] != w[2] - 1]


def test_fit_against_a_dense_one(monkeypatch):
    monkeypatch.setattr(bayes, "DIMS", 30)
    monkeypatch.setattr(bayes, "EPOCHS", 40)
    rng = np.random.default_rng(5)
    n, dims, style = 120, 30, rng.normal(size=(120, bayes.STYLE))
    y = (rng.random(n) < 0.4).astype(float)
    x = (rng.random((n, dims)) < np.where(np.arange(dims) % 5 == 0, 0.15 + 0.6 * y[:, None], 0.3)).astype(float)
    doc, feature = np.nonzero(x)
    got = bayes._fit(doc, feature, style, y)
    telling = []
    for j in range(dims):
        g = 0.0
        for has in (0, 1):
            for label in (0, 1):
                seen, expected = ((x[:, j] == has) & (y == label)).sum(), (x[:, j] == has).sum() * (y == label).sum() / n
                g += 2 * seen * math.log(seen / expected) if seen else 0
        telling.append(x[:, j].sum() >= bayes.MIN_DOCS and g >= bayes.G2)
    assert 0 < sum(telling) < dims
    whole = np.hstack([x * np.array(telling), style, np.ones((n, 1))])
    w = np.zeros(dims + bayes.STYLE + 1)
    p = (y.sum() + 0.5) / (n + 1)
    w[-1] = math.log(p / (1 - p))
    total = np.full(len(w), 1e-10)
    for _ in range(40):
        grad = whole.T @ (1 / (1 + np.exp(-whole @ w)) - y) / n + bayes.RIDGE * np.append(w[:-1], 0)
        total += grad**2
        w -= bayes.RATE * grad / np.sqrt(total)
    assert got == pytest.approx(w, abs=1e-8)
    one = bayes._fit(doc, feature, style, np.ones(n))
    assert not one[:-1].any() and one[-1] == pytest.approx(math.log((n + 0.5) / 0.5))


def _shingles(line):
    w = line.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_paragraph_classes_against_all_pairs(spark):
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**6)}"
    lines = {}
    for d in range(60):
        base = [word() for _ in range(rng.randint(40, 160))]
        for copy in range(rng.choice([1, 2, 2, 3, 6])):
            mine = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5]) if copy else 0):
                mine[rng.randrange(len(mine))] = word()  # a changed word breaks five shingles
            lines[1000 * d + copy] = " ".join(mine)
    first = {i: (0, len(t.split())) for i, t in lines.items()}
    got = paragraphs.repeats(spark, spark.createDataFrame(list(lines.items()), "doc_id bigint, text string")).collect()
    sets = {i: _shingles(t) for i, t in lines.items()}
    near = [(a, b) for a, b in combinations(lines, 2) if a // 1000 == b // 1000 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    up = {i: i for i in lines}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in near:
        up[root(a)] = root(b)
    want = {}
    for i in lines:
        want.setdefault(root(i), set()).add(i)
    want = {frozenset(c) for c in want.values() if len(c) > 1}
    classes = {}
    for r in got:
        if (r.first_word, r.n_words) == first[r.doc_id]:
            classes.setdefault(r.class_id, []).append(r)
    found = {frozenset(r.doc_id for r in c) for c in classes.values()}
    together = sum(any({a, b} <= c for c in found) for a, b in near)
    assert len(near) > 60 and together >= 0.99 * len(near)
    for c in found - want:  # whole lines that are equal are spans as well
        assert len({lines[i] for i in c}) == 1
    for c in classes.values():  # the first one stays
        assert [r.doc_id for r in c if not r.removed] == [min(r.doc_id for r in c)] and all(r.n_class == len(c) for r in c)


@pytest.mark.parametrize("fan", [2, 5])
def test_counts_that_meet_in_levels_are_the_same(spark, monkeypatch, fan):
    docs, good = table(spark, SF, "documents"), table(spark, SF, "labels").where("quality = 1").select("doc_id")
    want = sorted(map(tuple, entropy.scored(spark, docs, good).collect()))
    monkeypatch.setattr(entropy, "FAN", fan)  # some 25 buckets and as many chunks: three levels and more, and two
    got = sorted(map(tuple, entropy.scored(spark, docs.repartition(5), good, chunk=10_000, bucket=10_000).collect()))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert np.array([r[2:] for r in got], float) == pytest.approx(np.array([r[2:] for r in want], float), abs=1e-9, nan_ok=True)
