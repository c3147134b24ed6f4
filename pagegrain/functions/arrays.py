"""Columns over arrays inside a row: a value worked out once, and folds that give out elements as they go."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), value worked out once."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def folded(items: Column, zero: dict[str, Column], step: Callable[[Column, Column], tuple[dict[str, Column], Column]], kind: str, end: Callable[[Column], Column]) -> Column:
    """end(state) after a fold of items, an array: state has the fields of zero and `out`, an array of type kind. step(state, item) gives the next
    fields and what out gains. Spark copies a fold's state at each step, so the fold goes by parts, about as many as a part has items: n items
    cost n * sqrt(n) copies of what they give out, not n * n."""
    empty = F.array().cast(kind)

    def inner(s: Column, x: Column) -> Column:
        fields, more = step(s, x)
        return F.struct(*[v.alias(k) for k, v in fields.items()], F.concat(s["out"], more).alias("out"))

    def outer(s: Column, part: Column) -> Column:
        done = lambda e: F.struct(*[e[k].alias(k) for k in zero], F.concat(s["out"], e["out"]).alias("out"))
        return F.aggregate(part, F.struct(*[s[k].alias(k) for k in zero], empty.alias("out")), inner, done)

    def parts(a: Column) -> Column:
        n = F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(a))).cast("int"))
        first = F.when(F.size(a) > 0, F.sequence(F.lit(1), F.size(a), n)).otherwise(F.array().cast("array<int>"))
        return F.transform(first, lambda i: F.slice(a, i, n))

    return F.aggregate(let(items, parts), F.struct(*[v.alias(k) for k, v in zero.items()], empty.alias("out")), outer, end)
