"""Ordered folds: a keyed state carried over rows in order.

Rows are dealt out by key and sorted within their partitions, then streamed through in Arrow batches. What is in
memory is one batch and the state of one key, however many rows a key holds: no group is ever gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import pieces, ship


def ordered_fold(rows: DataFrame, key: str, order: str, start: Callable[[], object], step: Callable[[object, dict], list[dict]], out) -> DataFrame:
    """What step(state, row) returns for each row, in order of `order` within each key; start() makes a key's
    state, which step changes in place. Rows without a key form one group. out: a StructType."""
    ship(rows.sparkSession)
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, at, begun = None, None, False
        for batch in pieces(batches, 1000):
            found = []
            for r in batch.to_pylist():
                if not begun or r[key] != at:
                    state, at, begun = start(), r[key], True
                found.extend(step(state, r))
            if found:
                yield pa.RecordBatch.from_pylist(found, schema=schema)

    return rows.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, out)
