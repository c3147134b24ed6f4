"""The session replay as a stream: the same fold, its stacks kept as keyed state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..operators.sessions import step
from ..session import ship


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    back, here, forward, last = json.loads(state.get[0]) if state.exists else ([], None, [], -1)
    rows = pd.concat(list(frames)).sort_values("seq")
    out = []
    for r in rows.itertuples(index=False):
        if r.seq <= last:  # overtaken: a later event has been applied already
            continue
        back, here, forward = step(back, here, forward, r.kind, r.url)
        last = int(r.seq)
        out.append((key[0], last, here, len(back), len(forward)))
    state.update((json.dumps([back, here, forward, last]),))
    yield pd.DataFrame(out, columns=["session", "seq", "here", "n_back", "n_forward"])


def replay_stream(events: DataFrame) -> DataFrame:
    """replay() of a stream of events (session, seq, kind, url); events that come after a later one of their
    session are dropped."""
    ship(events.sparkSession)
    return events.groupBy("session").applyInPandasWithState(_fold, "session bigint, seq bigint, here string, n_back int, n_forward int", "held string", "append", "NoTimeout")
