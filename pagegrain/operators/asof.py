"""As-of joins of two tables: each row takes the last row of the other side at or before it, or the first at or after it.

Both sides are laid into one order, by key and time, and cut into ranges of about equal size, so that a key of any number of rows is split. Inside a
range a running last value finds the match; what a range ends with is carried into the next ones of the same key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import written

#: Rows of a range, and ranges that smaller ones may make at most: Spark sends the driver a sample of rows for each.
RANGE_ROWS, SMALL_RANGES = 500_000, 200


def asof(spark: SparkSession, left: DataFrame, right: DataFrame, key: str, at: str, forward: bool = False, wrap: bool = False, range_rows: int = RANGE_ROWS) -> DataFrame:
    """left's columns and `found`, a struct of right's, of the last row of right with the same key and an `at` at or before left's own (forward: of the first one at
    or after it); null if there is none, unless wrap is set: then the key's last row of right (forward: its first).

    Null keys match nothing, and null times only by wrapping. Of right's rows of one key and time the one whose columns are greatest is taken (forward:
    least). left keeps all its rows, repeated ones too; an empty side is no error.
    """
    there = right.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    value = F.struct(*[there[c] for c in there.columns])
    # Forward, the order of all is turned round; a match at the same time comes before the row that takes it.
    one = left.select(F.col(key).alias("k"), F.col(at).alias("t"), F.lit(1).alias("side"), F.struct(*[left[c] for c in left.columns]).alias("row"), F.lit(None).cast(there.select(value.alias("v")).schema["v"].dataType).alias("v"))
    two = there.select(F.col(key).alias("k"), F.col(at).alias("t"), F.lit(0).alias("side"), F.lit(None).cast(one.schema["row"].dataType).alias("row"), value.alias("v"))
    both = written(spark, one.unionByName(two).withColumn("tie", F.monotonically_increasing_id()), "sides")
    turn = (lambda c: F.desc_nulls_last(c)) if forward else (lambda c: F.asc_nulls_first(c))
    order = [F.asc("k"), turn("t"), F.asc("side"), turn("v"), F.asc("tie")]
    rows = both.count()
    n = int(min(10_000, rows // range_rows + 1, max(SMALL_RANGES, rows // RANGE_ROWS + 1)))
    cut = both.repartitionByRange(n, *order).sortWithinPartitions(*order)
    cut = written(spark, cut.withColumn("id", F.monotonically_increasing_id()), "ranges").withColumn("part", F.shiftright("id", 33))
    inside = Window.partitionBy("part", "k").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = cut.withColumn("own", F.last("v", ignorenulls=True).over(inside))
    # The last match of each key and range; keys within one range need none of it.
    ends = cut.where("side = 0 and k is not null").groupBy("k", "part").agg(F.max_by("v", "id").alias("v"))
    spans = cut.where("k is not null").select("k", "part").distinct()
    ahead = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.join(ends, ["k", "part"], "left").withColumn("before", F.last("v", ignorenulls=True).over(ahead)).where("before is not null").select("k", "part", "before")
    # A range begins inside one key at most: as many rows as ranges.
    out = own.where("side = 1").join(F.broadcast(carried), ["k", "part"], "left").withColumn("found", F.when(F.col("t").isNotNull(), F.coalesce("own", "before")))
    if wrap:
        edge = there.groupBy(F.col(key).alias("k")).agg((F.min_by if forward else F.max_by)(value, F.struct(F.col(at), value)).alias("edge"))
        out = out.join(edge.hint("merge"), "k", "left").withColumn("found", F.coalesce("found", "edge"))
    return out.select("row.*", "found")
