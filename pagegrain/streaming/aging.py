"""Keyed state that ages: events of a key folded in order as their watermark passes, and forgotten when the key falls silent.

One processor serves every fold. Rows wait in map state until the watermark has passed them, so they are folded in the order of their
numbers however they arrive; a value state holds the fold; event-time timers wake both. The same fold over a table is
`folded`, whose rows a stream gives whatever its batches are.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from ..operators.folds import ordered_fold
from ..operators.sessions import step as navigate
from ..session import ship

#: Seconds that an answer about releases holds, and that a failed request is waited after.
CHECK_EVERY, RETRY_AFTER = 12 * 3600, 3600
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Fold(NamedTuple):
    """fresh() is an empty state (of JSON values); step(state, row) gives the next one and the row's output; row has the columns of `reads`."""

    fresh: Callable[[], Any]
    step: Callable[[Any, dict], tuple[Any, dict]]
    reads: tuple[str, ...]
    gives: str  # DDL of a row's output


def _replayed(state: list, r: dict) -> tuple[list, dict]:
    state = list(navigate(*state, r["kind"], r["url"]))
    return state, {"here": state[1], "n_back": len(state[0]), "n_forward": len(state[2])}


#: Back and forward stacks of a session's events (kind, url).
REPLAY = Fold(lambda: [[], None, []], _replayed, ("kind", "url"), "here string, n_back int, n_forward int")


def version_of(tag: str | None) -> tuple[int, int, int, bool] | None:
    """(major, minor, patch, whether a release proper) of a tag such as v1.2.3-rc1; None for others."""
    body, _, pre = (tag or "").strip().removeprefix("v").partition("-")
    parts = body.split("+")[0].split(".")
    if not 2 <= len(parts) <= 3 or not all(p.isdecimal() for p in parts):
        return None
    return (*(int(p) for p in [*parts, "0"][:3]), not pre)


def _checked(s: dict, r: dict) -> tuple[dict, dict]:
    """One look for a newer release: current is the version that runs, found what a request would bring (null: it fails)."""
    at, current = r["at_s"], r["current"]
    waits = s["latest"] is not None and (s["checked"] is not None and at - s["checked"] < CHECK_EVERY or s["failed"] is not None and at - s["failed"] < RETRY_AFTER)
    if not waits:
        s = {**s, "failed": at} if r["found"] is None else {**s, "latest": r["found"], "checked": at, "failed": None}
    failed = not waits and r["found"] is None
    a, b = version_of(s["latest"]), version_of(current)
    newer = bool(a and b and a[3] and (a[:3] > b[:3] or a[:3] == b[:3] and not b[3]))
    announce = newer and not failed and s["told"] != s["latest"]
    just = not failed and s["seen"] is not None and s["seen"] != current and a is not None and b is not None and a[:3] == b[:3]
    s = s if failed else {**s, "seen": current, "told": s["latest"] if announce else s["told"]}
    return s, {"asked": not waits, "newer": newer, "announce": announce, "just_updated": just}


#: Looks for a newer release (at, current, found): whether a request is made, and what is told, each version once.
CHECKS = Fold(lambda: {"latest": None, "checked": None, "failed": None, "told": None, "seen": None}, _checked, ("current", "found"), "asked boolean, newer boolean, announce boolean, just_updated boolean")


#: Milliseconds and columns that two clicks of one run are apart at most.
CLICK_MS, CLICK_COLUMNS = 450, 1


def _clicked(s: list, r: dict) -> tuple[list, dict]:
    line, col, at, clicks = s
    near = at is not None and r["at_ms"] - at < CLICK_MS and r["line"] == line and abs(r["col"] - col) <= CLICK_COLUMNS
    clicks = clicks + 1 if near else 1
    return [r["line"], r["col"], r["at_ms"], clicks], {"clicks": clicks}


#: Clicks of a session (line, col): how many in a row, on one line and near the last one.
CLICKS = Fold(lambda: [None, None, None, 0], _clicked, ("line", "col"), "clicks int")


def _advance(fold: Fold, held: dict | None, row: dict, idle_ms: int) -> tuple[dict, dict] | None:
    """The state after a row, and its output; None for a row that a later one of its key has overtaken. A key that was silent for
    longer than idle_ms begins anew."""
    if held is not None and row["at_ms"] - held["at_ms"] > idle_ms:
        held = None
    if held is not None and row["seq"] <= held["seq"]:
        return None
    state, out = fold.step(fold.fresh() if held is None else held["state"], {**row, "at_s": row["at_ms"] // 1000})
    return {"state": state, "seq": row["seq"], "at_ms": row["at_ms"]}, out


def _schema(fold: Fold) -> str:
    return f"session bigint, seq bigint, {fold.gives}"


def _rows(events: DataFrame, fold: Fold) -> DataFrame:
    return events.select("session", "seq", "at", F.expr("unix_millis(at)").alias("at_ms"), *fold.reads)


def folded(events: DataFrame, fold: Fold, idle_seconds: int) -> DataFrame:
    """(session, seq, ...) after each event of a table events (session, seq, at, and what the fold reads), in order of seq."""

    def step(held: list, r: dict) -> list[dict]:
        found = _advance(fold, held[0], r, idle_seconds * 1000)
        if found is None:
            return []
        held[0] = found[0]
        return [{"session": r["session"], "seq": r["seq"], **found[1]}]

    return ordered_fold(_rows(events, fold).drop("at"), "session", "seq", lambda: [None], step, StructType.fromDDL(_schema(fold)))


class _Aging(StatefulProcessor):
    """Keeps (seq: row) of rows that the watermark hasn't passed, and the fold's state until the key is silent for idle_ms."""

    def __init__(self, fold: Fold, idle_ms: int) -> None:
        self.fold, self.idle_ms, self.columns = fold, idle_ms, [f.name for f in StructType.fromDDL(_schema(fold)).fields]

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "seq bigint", "row string")
        self.held = handle.getValueState("held", "state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for r in frame[["seq", "at_ms", *self.fold.reads]].astype(object).where(frame.notna(), None).to_dict("records"):
                r = {**r, "seq": int(r["seq"]), "at_ms": int(r["at_ms"])}
                self.waiting.updateValue((r["seq"],), (json.dumps(r),))
                self.handle.registerTimer(r["at_ms"])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = json.loads(self.held.get()[0]) if self.held.exists() else None
        due = sorted((r for r in (json.loads(v[0]) for _, v in self.waiting.iterator()) if r["at_ms"] <= now), key=lambda r: r["seq"])
        out = []
        for r in due:
            self.waiting.removeKey((r["seq"],))
            found = _advance(self.fold, held, r, self.idle_ms)
            if found is not None:
                held = found[0]
                out.append({"session": key[0], "seq": r["seq"], **found[1]})
        if held is not None and held["at_ms"] + self.idle_ms < now:
            self.held.clear()
        elif due:
            self.held.update((json.dumps(held),))
            self.handle.registerTimer(held["at_ms"] + self.idle_ms + 1)
        return iter((pd.DataFrame(out, columns=self.columns),)) if out else iter(())

    def close(self) -> None:
        pass


def keeps_state(spark: SparkSession) -> None:
    """The state store that such streams need, for streams that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def folded_stream(events: DataFrame, fold: Fold, idle_seconds: int, late: str = "10 minutes") -> DataFrame:
    """folded() of a stream: rows come out as the watermark, `late` behind the latest event, passes them; events behind it are dropped. Between
    batches a key holds its fold and the rows of its last `late`, and after idle_seconds of silence nothing."""
    spark = events.sparkSession
    ship(spark)
    keeps_state(spark)
    rows = _rows(events, fold).withWatermark("at", late)
    return rows.groupBy("session").transformWithStateInPandas(statefulProcessor=_Aging(fold, idle_seconds * 1000), outputStructType=_schema(fold), outputMode="append", timeMode="eventTime")
