"""Widths of table columns: natural ones where they fit, else the room shared out in proportion with a least width."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The least width of a column, and what borders and padding take: so much a column, and once.
LEAST, A_COLUMN, ONCE = 4, 3, 1


def natural(cells: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, tbl, col, nat) of a table's rows (key, tbl, row, cells) as `markdown.tables` gives them: each column's longest cell."""
    each = cells.select(key, "tbl", F.posexplode("cells").alias("col", "cell"))
    return each.groupBy(key, "tbl", "col").agg(F.max(F.char_length("cell")).alias("nat"))


def shared(nat: DataFrame, width: int, key: str = "page_id") -> DataFrame:
    """(key, tbl, col, nat, shrunk, width) of natural(). Where a table fits into `width`, or has no more room than LEAST a column, columns are as wide as they are.

    shrunk: each column's share of the room by its natural width, rounded down, LEAST at the least; such widths may exceed the room. width: those whose
    share is below LEAST get LEAST and leave, the others share what is left, again and again; rounded down, what then is left goes to the largest
    fractions, the first column on ties, so that widths add up to the room.

    In order of natural width the columns at LEAST come first, so the rounds are one pass: the k narrowest leave if the next one's share of what they
    leave is still too small.
    """
    table = Window.partitionBy(key, "tbl")
    rows = nat.withColumn("cols", F.count("*").over(table)).withColumn("total", F.sum("nat").over(table))
    rows = rows.withColumn("room", F.lit(width) - (A_COLUMN * F.col("cols") + ONCE)).withColumn("tight", (F.col("total") > F.col("room")) & (F.col("room") > LEAST * F.col("cols")))
    rows = rows.withColumn("shrunk", F.when(F.col("tight"), F.greatest(F.lit(LEAST), F.expr("nat * room div nullif(total, 0)"))).otherwise(F.col("nat")))
    # Of each column: the room and the total once all narrower ones have left at LEAST.
    narrower = table.orderBy("nat", "col").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("gone", F.count("*").over(narrower)).withColumn("left_room", F.col("room") - LEAST * F.col("gone")).withColumn("left_total", F.col("total") - F.coalesce(F.sum("nat").over(narrower), F.lit(0)))
    rows = rows.withColumn("stays", F.col("nat") * F.col("left_room") >= LEAST * F.col("left_total"))
    upto = table.orderBy("nat", "col").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("stays", F.bool_or("stays").over(upto))
    first = F.min_by(F.struct("left_room", "left_total"), F.when(F.col("stays"), F.struct("nat", "col"))).over(table)
    rows = rows.withColumn("share", first).withColumn("floor", F.when(F.col("stays"), F.expr("nat * share.left_room div nullif(share.left_total, 0)")).otherwise(F.lit(LEAST)))
    rows = rows.withColumn("rest", F.when(F.col("stays"), F.expr("nat * share.left_room % nullif(share.left_total, 0)")).otherwise(F.lit(-1)))
    spare = F.col("room") - F.sum("floor").over(table)
    rows = rows.withColumn("spare", spare).withColumn("place", F.row_number().over(table.orderBy(F.desc("rest"), "col")))
    wide = F.when(F.col("tight"), F.col("floor") + (F.col("place") <= F.col("spare")).cast("int")).otherwise(F.col("nat"))
    return rows.select(key, "tbl", "col", "nat", F.col("shrunk").cast("long").alias("shrunk"), wide.cast("long").alias("width"))
