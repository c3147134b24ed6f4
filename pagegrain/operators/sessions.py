"""Browsing sessions replayed: back and forward stacks folded over a session's events in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .folds import ordered_fold

STACK = 200


def step(back: list[str], here: str | None, forward: list[str], kind: str, url: str) -> tuple[list[str], str | None, list[str]]:
    """One event. push clears forward; back and forward move a page between the stacks; replace leaves both;
    a failed load changes nothing. A stack keeps its last STACK pages."""
    if kind == "push":
        return ([*back, here] if here is not None else back)[-STACK:], url, []
    if kind == "back" and back:
        return back[:-1], back[-1], [*forward, here][-STACK:]
    if kind == "forward" and forward:
        return [*back, here][-STACK:], forward[-1], forward[:-1]
    if kind == "replace":
        return back, url, forward
    return back, here, forward


def _advance(stacks: list, r: dict) -> list[dict]:
    stacks[:] = step(*stacks, r["kind"], r["url"])
    back, here, forward = stacks
    return [{"session": r["session"], "seq": r["seq"], "here": here, "n_back": len(back), "n_forward": len(forward)}]


def replay(events: DataFrame) -> DataFrame:
    """(session, seq, here, n_back, n_forward) after each event of events (session, seq, kind, url)."""
    out = StructType.fromDDL("session bigint, seq bigint, here string, n_back int, n_forward int")
    return ordered_fold(events.select("session", "seq", "kind", "url"), "session", "seq", lambda: [[], None, []], _advance, out)


def q_nav_session_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"click": "push", "view": "push", "signup": "replace", "error": "fail", "purchase": "back"}
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("event_type")], F.lit("fail"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return replay(events.select(F.col("user_id").cast("long").alias("session"), F.col("event_id").alias("seq"), kind.alias("kind"), F.concat(F.lit("/"), F.col("event_type"), F.lit("/"), F.col("event_id").cast("string")).alias("url")))
