"""Folds whose state ages: a stream gives the rows of the table, over restarts, and forgets."""

import datetime
import random

import pytest

from pagegrain.streaming import aging

START = datetime.datetime(2024, 1, 1)
IDLE = 3600


def _events(n=60):
    rng = random.Random(3)
    rows = []
    for s in range(4):
        t = 0
        for i in range(n):
            t += rng.choice([20, 60, 300, 300, 5000])  # now and then a session falls silent for more than IDLE
            rows.append((s, i, START + datetime.timedelta(seconds=t), rng.choice(["push", "push", "back", "forward", "replace"]), f"/{s}/{i}"))
    return sorted(rows, key=lambda r: r[2])


SCHEMA = "session bigint, seq bigint, at timestamp, kind string, url string"


def _run(spark, folder, checkpoint, name, fold, schema):
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(folder)
    query = aging.folded_stream(source, fold, IDLE).writeStream.format("parquet").option("path", name).option("checkpointLocation", checkpoint).outputMode("append").start()
    query.processAllAvailable()
    query.stop()


def test_replay_over_a_restart_equals_the_table(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    rows = _events()
    parts = [rows[i::1][k * 40 : (k + 1) * 40] for i in (0,) for k in range(6)]
    for k, part in enumerate(parts[:3]):
        random.Random(k).shuffle(part)  # in a batch, rows come in any order
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    _run(spark, folder, checkpoint, out, aging.REPLAY, SCHEMA)
    first = spark.read.parquet(out).count()
    for part in parts[3:]:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    late = [(9, 0, START + datetime.timedelta(days=30), "push", "/end")]  # moves the watermark on
    spark.createDataFrame(late, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    _run(spark, folder, checkpoint, out, aging.REPLAY, SCHEMA)
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    want = sorted(map(tuple, aging.folded(spark.createDataFrame(rows, SCHEMA), aging.REPLAY, IDLE).collect()))
    assert 0 < first < len(want) and got == want
    assert any(r[3] == 0 and r[1] > 5 for r in want)  # a silent session began anew
    # All but the last event's key are forgotten.
    for state in ("held", "waiting"):
        left = spark.read.format("statestore").option("stateVarName", state).load(checkpoint).select("key.session").distinct().collect()
        assert {r[0] for r in left} <= {9}


def test_checks_like_a_plain_fold(spark):
    hour = 3600
    seen = [  # seconds, running, what a request would bring: asked, newer, announced, just updated
        (0, "v1.0.0", "v1.1.0", (True, True, True, False)),
        (hour, "v1.0.0", "v1.2.0", (False, True, False, False)),
        (13 * hour, "v1.0.0", None, (True, True, False, False)),
        (13 * hour + 600, "v1.0.0", "v1.2.0", (False, True, False, False)),
        (14 * hour + 1, "v1.0.0", "v1.2.0", (True, True, True, False)),
        (15 * hour, "v1.2.0", "v1.2.0", (False, False, False, True)),
        (16 * hour, "v1.2.0", "v1.2.0", (False, False, False, False)),
        (40 * hour, "v1.2.0-rc1", "v1.2.0", (True, True, False, True)),
    ]
    rows = [(1, i, START + datetime.timedelta(seconds=t), c, f) for i, (t, c, f, _) in enumerate(seen)]
    out = aging.folded(spark.createDataFrame(rows, "session bigint, seq bigint, at timestamp, current string, found string"), aging.CHECKS, 90 * 24 * hour).orderBy("seq").collect()
    assert [(r.asked, r.newer, r.announce, r.just_updated) for r in out] == [x[3] for x in seen]


@pytest.mark.parametrize("tag, want", [("v1.2.3", (1, 2, 3, True)), ("1.2", (1, 2, 0, True)), ("v1.2.3-rc1", (1, 2, 3, False)), ("v1", None), ("", None), (None, None), ("v1.x.0", None)])
def test_versions(tag, want):
    assert aging.version_of(tag) == want
