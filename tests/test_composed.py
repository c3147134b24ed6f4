"""Column widths, code fidelity, links between documents and the refresh stream against plain Python."""

import datetime
import random

import pytest

from pagegrain.operators import fidelity, linking, widths
from pagegrain.sources.store import CacheStore
from pagegrain.streaming import aging, refresh


def _plain_widths(nat, width):
    room, total = width - (3 * len(nat) + 1), sum(nat)
    if not (total > room and room > 4 * len(nat)):
        return nat, nat
    out, free = {}, dict(enumerate(nat))
    while True:  # who is at the least width leaves, the others share anew
        left, of = room - 4 * len(out), sum(free.values())
        small = [i for i, n in free.items() if n * left < 4 * of]
        if not small:
            break
        i = min(small, key=lambda i: (nat[i], i))
        out[i] = 4
        del free[i]
    low = {i: n * left // of for i, n in free.items()}
    spare = room - sum(out.values()) - sum(low.values())
    for i in sorted(free, key=lambda i: (-(free[i] * left % of), i))[:spare]:
        low[i] += 1
    return [max(4, n * room // total) for n in nat], [(out | low)[i] for i in range(len(nat))]


def test_widths_like_a_plain_loop(spark):
    rng = random.Random(6)
    tables = [[rng.choice([0, 1, 2, 3, 5, 8, 13, 40, 200]) for _ in range(rng.randint(1, 9))] for _ in range(150)]
    rows = [(k, 0, i, n) for k, t in enumerate(tables) for i, n in enumerate(t)]
    got = {}
    for r in widths.shared(spark.createDataFrame(rows, "page_id int, tbl int, col int, nat int"), 60).collect():
        got.setdefault(r.page_id, {})[r.col] = (r.shrunk, r.width)
    tight = 0
    for k, t in enumerate(tables):
        shrunk, wide = _plain_widths(t, 60)
        assert [got[k][i][0] for i in range(len(t))] == shrunk and [got[k][i][1] for i in range(len(t))] == wide, t
        if wide != t:
            tight += 1
            assert sum(wide) == 60 - (3 * len(t) + 1) and min(wide) >= 4
    assert tight > 20


def test_natural_widths_of_uneven_rows(spark):
    rows = [(1, 0, 0, ["a", "bb"]), (1, 0, 1, ["cccc"]), (1, 0, 2, ["", "", "é😀"])]
    got = widths.natural(spark.createDataFrame(rows, "page_id int, tbl int, row int, cells array<string>"))
    assert sorted((r.col, r.nat) for r in got.collect()) == [(0, 4), (1, 2), (2, 2)]


@pytest.mark.parametrize("code, rows, want", [
    ("a\n\tb\n", [("a", False), ("    b", False)], (True, "bytes", None)),
    ("abcdef", [("abc", False), ("def", True)], (True, "bytes", None)),
    ("abcdef", [("abc", True), ("def", True)], (True, "bytes", None)),
    ("a  \nb", [("a", False), ("b ", False)], (True, "spaces", None)),
    ("a\nb", [("a", False), ("c", False)], (False, "line", 2)),
    ("a\nb", [("a", False)], (False, "count", None)),
    ("a", [("a", False), ("b", False)], (False, "count", None)),
    ("a", [("a", False), ("", False)], (True, "bytes", None)),
    ("a\nb", [], (False, "count", None)),
    ("", [], (True, "bytes", None)),
    (None, [], (True, "bytes", None)),
    (None, [("x", False)], (False, "line", 1)),
    ("a\n\n\nb", [("a", False), (None, False), ("", None), ("b", False)], (True, "bytes", None)),
])
def test_fidelity(spark, code, rows, want):
    sources = spark.createDataFrame([(1, "go", code)], "k int, lang string, code string")
    shown = spark.createDataFrame([(1, i, t, s) for i, (t, s) in enumerate(rows)], "k int, pos int, text string, soft boolean")
    got = fidelity.compared(sources, shown, ["k"]).collect()
    assert [(r.same, r.how, r.line) for r in got] == [want]


def _follow(moves, at):
    seen = {at}
    while at in moves:
        at = moves[at]
        if at in seen:
            return None
        seen.add(at)
    return at


def test_moves_are_followed_to_their_end(spark):
    rng = random.Random(1)
    moves = {(d, "s"): (d + 1, "s") for d in range(70)}  # one long way
    moves |= {(200, "a"): (201, "a"), (201, "a"): (202, "a"), (202, "a"): (200, "a"), (203, "a"): (201, "a"), (210, "x"): (210, "y")}
    moves |= {(300 + i, "r"): (300 + rng.randrange(40), "r") for i in range(30)}
    rows = [(*a, *b) for a, b in moves.items()] + [(210, "x", 210, "z"), (400, "m", 400, "m"), (None, "x", 1, "s"), (5, None, 1, "s")]
    got = {(r.doc, r.slug): (r.to_doc, r.to_slug) for r in linking.settled(spark, spark.createDataFrame(rows, "doc int, slug string, to_doc int, to_slug string")).collect()}
    own = {k: v for k, v in moves.items() if k != v}
    assert got == {k: _follow(own, k) or (None, None) for k in own}


def test_links(spark):
    sections = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, "")], "doc int, slug string")
    moves = spark.createDataFrame([(1, "old", 2, "b"), (1, "lost", 9, "q"), (1, "loop", 1, "pool"), (1, "pool", 1, "loop")], "doc int, slug string, to_doc int, to_slug string")
    rows = [(7, 0, 1, "a"), (7, 1, 1, "old"), (7, 2, 1, "lost"), (7, 3, 1, "loop"), (7, 4, 2, ""), (7, 5, 2, None), (7, 6, 8, ""), (7, 7, None, "a"), (7, 8, 1, "none")]
    got = linking.linked(spark, spark.createDataFrame(rows, "doc int, ord int, to_doc int, to_slug string"), sections, moves).orderBy("ord").collect()
    assert [(r.to_doc, r.to_slug, r.state) for r in got] == [
        (1, "a", "section"), (2, "b", "moved"), (1, "lost", "dangling"), (1, "loop", "dangling"), (2, "", "document"), (2, None, "document"), (8, "", "dangling"), (None, "a", "dangling"), (1, "none", "dangling")]


def test_refresh_stream_and_a_batch_that_comes_again(spark, tmp_path):
    schema = "url string, content string, saved timestamp"
    day = lambda d: datetime.datetime(2024, 1, d)
    store = CacheStore(spark, str(tmp_path / "cache"))
    store.put(spark.createDataFrame([(f"http://a/{i}", f"old {i}", day(1)) for i in range(6)], schema))
    batches = [[("http://a/0", "old 0", day(2)), ("http://a/1", "new 1", day(2)), ("http://new/", "x", day(2)), (None, "y", day(2))], [("http://a/1", "new 1", day(3)), ("http://a/0", "new 0", day(3)), ("http://a/2", "between", day(3)), ("http://a/2", "old 2", day(4))]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = refresh.refresh_stream(stream, store, out, str(tmp_path / "checkpoint"))
    query.processAllAvailable()
    query.stop()
    want = {(0, "http://a/0", False), (0, "http://a/1", True), (0, "http://new/", False), (1, "http://a/1", False), (1, "http://a/0", True), (1, "http://a/2", False)}
    assert {(r.batch, r.url, r.newer) for r in refresh.told(spark, out).collect()} == want
    held = sorted(tuple(r) for r in store.rows().select("url", "content", "saved").collect())
    refresh.refreshed_batch(store, spark.createDataFrame(batches[1], schema), 1, out)
    assert {(r.batch, r.url, r.newer) for r in refresh.told(spark, out).collect()} == want
    assert sorted(tuple(r) for r in store.rows().select("url", "content", "saved").collect()) == held


def test_clicks_on_a_stream_and_late_ones(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rng = random.Random(4)
    schema = "session bigint, seq bigint, at timestamp, line int, col int"
    rows, t = [], 0
    for i in range(200):
        t += rng.choice([100, 200, 449, 450, 400, 300])
        rows.append((i // 100, i, start + datetime.timedelta(milliseconds=t), rng.choice([1, 1, 1, 1, 2]), rng.choice([5, 5, 5, 6, 7])))
    late = (0, 999, start + datetime.timedelta(seconds=1), 1, 5)
    for part in (rows[:120], rows[120:], [(9, 0, start + datetime.timedelta(hours=2), 1, 1)], [late], [(9, 1, start + datetime.timedelta(hours=4), 1, 1)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = aging.folded_stream(source, aging.CLICKS, 600, "1 minute").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).where("session < 9").collect()))
    want = sorted(map(tuple, aging.folded(spark.createDataFrame(rows, schema), aging.CLICKS, 600).collect()))
    assert got == want and max(r[2] for r in want) > 2
