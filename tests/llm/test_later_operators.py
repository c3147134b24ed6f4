"""Sharding, resampling and the prefix trie against plain Python, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from pagegrain.llm import resampling, sharding, trie
from pagegrain.llm.common import placed, written

DOCS = "doc_id bigint, text string, shard string, slot int, rank string, raw int, size int"


def _texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefGHé9") for _ in range(rng.randint(1, 7)))
    rows = [(i, " ".join(word() for _ in range(rng.choice([3, 19, 20, 21, 60])))) for i in range(300)]
    rows += [(None, None), (None, "no id here"), (1000, None), (1001, ""), (1002, " \n.,"), (1003, "w" * 500 + " " + "x" * 70 + " a b c"), (1004, "é" * 40 + "-ünd 7"), (1005, " ".join(word() for _ in range(30_000)))]
    rows += [(7, rows[7][1])] * 5 + [(8, "another text of one id " * 10)]
    return [(i, t, "s", 1, "r", 2, 3) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_texts(), DOCS).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_places_split_a_hot_key(spark):
    rows = written(spark, spark.range(0, 3000).selectExpr("if(id % 3 = 0, null, if(id % 3 = 1, 5, id div 100)) k", "3000 - id v"), "hot")
    out = placed(spark, rows, ["k"], ["v"], "place", task_rows=100)
    by = defaultdict(list)
    for r in out.collect():
        by[r.k].append((r.v, r.place))
    assert sum(map(len, by.values())) == 3000
    for found in by.values():
        assert [p for _, p in sorted(found)] == list(range(len(found)))


def test_shards_by_plain_python(spark, docs, none):
    shards = [sharding.Shard("a", "x", 0, 3.0), sharding.Shard("a", "y'", 1, 1.0), sharding.Shard("b", "x", 2, 0.5), sharding.Shard("b", "x", 3, 0.0), sharding.Shard("b", "x", 4, 2.5)]

    def fall(key: str) -> int:
        at, left = "", [s for s in shards if s.weight > 0]
        for depth in range(3):
            names = {f"{at}{s[depth]}/" if depth < 2 else f"{at}s{s.shard}" for s in left}
            own = lambda n: [s for s in left if (f"{at}{s[depth]}/" if depth < 2 else f"{at}s{s.shard}") == n]  # noqa: B023, E731
            draw = lambda n: -math.log((int(hashlib.md5(f"7:{n}:{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / sum(s.weight for s in own(n))
            best = min(names, key=draw)
            left, at = own(best), best
        return left[0].shard

    out = sharding.sharded(spark, docs, shards)
    rows = out.collect()
    assert out.columns == [*docs.columns, "__pg_shard", "__pg_slot"] and len(rows) == docs.count()
    assert all(r["__pg_shard"] == fall("" if r.doc_id is None else str(r.doc_id)) for r in rows)
    for s in {r["__pg_shard"] for r in rows}:
        assert sorted(r["__pg_slot"] for r in rows if r["__pg_shard"] == s) == list(range(sum(r["__pg_shard"] == s for r in rows)))
    assert sharding.sharded(spark, none, shards).count() == 0
    assert {r["__pg_shard"] for r in sharding.sharded(spark, docs, []).collect()} == {None}


def test_movement_is_confined(spark):
    ids = spark.range(60_000).selectExpr("id doc_id", "'xx' text")
    eight = sharding.tree()
    moved = sharding.movement(ids, eight, sharding.grown(eight)).collect()
    assert {r.to_shard for r in moved} == {8} and {r.from_shard for r in moved} == set(range(8))
    assert abs(sum(r.n_rows for r in moved) - 60_000 / 9) < 400 and all(r.n_bytes == 2 * r.n_rows for r in moved)
    # Shard 0 weighs more: rows enter region r0, and inside it rack k0 and shard 0, none goes the other way.
    heavier = [s._replace(weight=3.0) if s.shard == 0 else s for s in eight]
    moved = sharding.movement(ids, eight, heavier).collect()
    assert {r.to_shard for r in moved} <= {0, 1, 2, 3}
    assert all(r.from_shard >= 4 or r.to_shard in (0, 1) and r.from_shard in (2, 3) or (r.from_shard, r.to_shard) == (1, 0) for r in moved)
    counts = {r[0]: r[1] for r in ids.select(sharding.drawn("cast(doc_id as string)", heavier).alias("s")).groupBy("s").count().collect()}
    assert all(abs(counts[s.shard] - 6000 * s.weight) < 400 for s in heavier)


def test_shard_files_in_order_of_slot(spark, docs, tmp_path):
    sharding.write_shards(spark, docs.select("doc_id", "text", "raw"), sharding.tree(), str(tmp_path / "out"), task_rows=40)
    seen = 0
    for shard in range(8):
        rows = []
        for part in sorted((tmp_path / "out" / f"shard={shard}").glob("*.parquet")):
            rows += [r.slot for r in spark.read.parquet(str(part)).collect()]
        assert rows == list(range(len(rows)))
        seen += len(rows)
    assert seen == docs.count()


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _grams(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w, [*w, *(" ".join(p) for p in zip(w, w[1:], strict=False))]


def _resampled(rows, target, percent=25, least=20):
    hashed = lambda g: [zlib.crc32(x.encode()) % 10000 for x in g]
    s, t = Counter(b for _, x in rows for b in hashed(_grams(x)[1])), Counter(b for x in target for b in hashed(_grams(x)[1]))
    a, b = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[i] + 1) * (a + 10000) / ((s[i] + 1) * (b + 10000)))) for i in range(10000)]
    out = []
    for doc, text in rows:
        w, g = _grams(text)
        weight = sum(gain[x] for x in hashed(g)) // len(g) if g else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append((doc, len(w), len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    draw = len(able) * percent // 100
    return Counter((*r, None) for r in out if r[1] < least) + Counter((*r, i + 1 if i < draw else None) for i, r in enumerate(able))


def test_resampling_by_plain_python(spark, docs, none):
    items = [_texts()[3][1], "abc def abc", None, "", "GH " * 50]
    target = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], "item_id bigint, text string, n int")
    for percent in (25, 100, 0):
        got = resampling.ranked(spark, docs, target, percent).collect()
        assert Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in got) == _resampled([r[:2] for r in _texts()], items, percent)
    assert resampling.ranked(spark, none, target).count() == 0
    assert resampling.ranked(spark, docs, target.limit(0)).count() == docs.count()
    kept = resampling.drawn(spark, docs, target)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_features_do_not_hang_on_blocks(monkeypatch):
    import pyarrow as pa

    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcé") for _ in range(rng.choice([1, 3, 60, 90]))) for _ in range(rng.randint(0, 40))) for _ in range(40)] + ["ab", "cd", None, "é"]
    want = Counter((i, zlib.crc32(x.encode())) for i, t in enumerate(texts) for x in _grams(t)[1])
    for block in (1 << 20, 64, 7):
        monkeypatch.setattr(resampling.grams, "BLOCK", block)
        got = Counter()
        for doc, word, owner, pair in resampling.features(pa.array(texts)):
            got.update(zip(doc.tolist(), word.tolist(), strict=True))
            got.update(zip(owner.tolist(), pair.tolist(), strict=True))
        assert got == want


def test_many_copies_are_numbered_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(resampling, "COPIES", 50)
    rows = [(1, "word " * 30)] * 700 + [(i, f"other text {i} " * 20) for i in range(2, 60)]
    got = resampling.ranked(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([("word word",)], "text string")).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(rows) * 25 // 100 + 1)) and len(got) == len(rows)


TURNS = "conv_id bigint, turn bigint, role string, text string, place string, depth int, bytes int"


def _conversations():
    rng = random.Random(11)
    rows = []
    for c in range(0, 90):
        if c in (20, 55):
            continue  # absent bases
        same = rng.random() < 0.4
        for i in range(rng.randint(1, 12)):
            rows.append((c, i if rng.random() < 0.95 else None, rng.choice(["user", "assistant", None]) if not same else "user", f"t{i}" if same else rng.choice(["é", "yes", None, "", "no " * i])))
    rows += [(None, 1, "user", "no conversation"), (3, 0, "user", "again"), (3, 0, "user", "again")]
    rows += [(200, i, "user", f"long {i}") for i in range(300)] + [(205, i, "user", f"long {i}") for i in range(280)]
    return rows


def _rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    turns = {c: [(r, t) for _, _, r, _, t in sorted(x)] for c, x in own.items()}
    out = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = tuple(turns.get(c - c % 5, [])[:h] + mine[h:])
    return out


def _trie(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = defaultdict(list)
    for n in members:
        if n:
            kids[n[:-1]].append(n)
    out, sums = set(), {}
    for n in sorted(members, key=len, reverse=True):
        leaves = 1 if n not in kids else sum(sums[k][0] for k in kids[n])
        saved = (len(members[n]) - 1) * (len(n[-1][1].encode()) if n else 0) + sum(sums[k][1] for k in kids.get(n, []))
        sums[n] = leaves, saved
        ends = ",".join(str(c) for c in sorted(members[n]) if len(convs[c]) == len(n))
        out.add((min(members[n]), len(n), min(members[n[:-1]]) if n else None, len(members[n]), len(kids.get(n, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("stretch", [4096, 7])
def test_trie_by_plain_python(spark, monkeypatch, stretch):
    monkeypatch.setattr(trie, "STRETCH", stretch)
    monkeypatch.setattr(trie, "IDS", 65_536 if stretch > 7 else 3)
    rows = [(*r, "x", 1, 2) for r in _conversations()]
    turns, convs = trie.rebuilt(spark, trie.turns_of(spark, spark.createDataFrame(rows, TURNS).repartition(4)))
    found = trie.nodes(spark, turns, convs)
    got = [tuple(r) for r in found.collect()]
    want = _trie(_rebuilt(rows))
    assert {r[:8] for r in got} == want and len(got) == len(want)
    # Positions are a preorder: gapless, parents first, subtrees nested.
    assert sorted(r[8] for r in got) == list(range(len(got)))
    at = {r[8]: r for r in got}
    stack = []
    for i in range(len(got)):
        while stack and at[stack[-1]][9] < i:
            stack.pop()
        assert len(stack) == at[i][1] and (not stack or at[stack[-1]][9] >= at[i][9])
        stack.append(i)


def test_trie_of_little(spark):
    none = spark.createDataFrame([], TURNS)
    turns, convs = trie.rebuilt(spark, trie.turns_of(spark, none))
    assert trie.nodes(spark, turns, convs).count() == 0
    # 4 has h = 3 turns to take from the absent 0 and none of its own after them.
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in range(1, 5)}
    c = next(c for c in h if h[c] > 0)
    turns, convs = trie.rebuilt(spark, trie.turns_of(spark, spark.createDataFrame([(c, 0, None, None, "", 0, 0)], TURNS)))
    rows = [tuple(r) for r in trie.nodes(spark, turns, convs).collect()]
    assert rows == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest(), 0, 0)]


def test_linearised_holds_each_turn_once(spark):
    rows = [(c, i, "user", f"{t}") for c, ts in {10: "abc", 15: "abd", 20: "abc", 25: "x"}.items() for i, t in enumerate(ts)]
    turns = trie.turns_of(spark, spark.createDataFrame([(*r, "", 0, 0) for r in rows], TURNS))
    found = trie.nodes(spark, turns, turns.select("conv_id").distinct())
    out = trie.linearised(found, turns).orderBy("position").collect()
    texts = {hashlib.sha256(x.encode()).hexdigest(): x for x in "abcdx"}
    assert sorted(texts[r.digest] for r in out) == list("abcdx") and [r.depth for r in out if texts[r.digest] in "ab"] == [1, 2]
    assert found.where("depth = 0").first().end_position == 5
