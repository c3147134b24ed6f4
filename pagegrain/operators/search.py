"""Searching and looking up: places of a query, links near a screen, samples, hits for an address bar."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrays import folded


def _folded(text: Column, query: Column) -> tuple[Column, Column]:
    """Text and query to compare: as they are where the query has a capital, else both in small letters."""
    exact = query.rlike(r"\p{Lu}")
    return F.when(exact, text).otherwise(F.lower(text)), F.when(exact, query).otherwise(F.lower(query))


def matches(lines: DataFrame, query: Column, key: str = "doc_id", line: str = "line", text: str = "text") -> DataFrame:
    """(key, line, start, stop): places of query, in code points, from left to right without overlap, in lines (key, line,
    text). A query of any length goes one way. Where small letters change a text's length (a dotted capital
    I), places count in the folded text. An empty query, and null texts, match nothing.

    Only lines that hold the query are cut up; what lies between its places gives their starts."""
    whole, needle = _folded(F.col(text), query)
    found = lines.select(key, line, whole.alias("t"), needle.alias("q")).where("q <> '' and contains(t, q)")
    # Cut by the query as it is: marks of regular expressions in it are quoted.
    cut = F.expr("split(t, concat('\\\\Q', replace(q, '\\\\E', '\\\\E\\\\\\\\E\\\\Q'), '\\\\E'), -1)")
    # The pieces' lengths add up inside the row.
    n = F.length("q")
    sizes = F.transform(cut, lambda x: F.length(x))
    step = lambda s, size: ({"at": s["at"] + size + n}, F.array(s["at"] + size))
    starts = folded(F.slice(sizes, F.lit(1), F.size(sizes) - 1), {"at": F.lit(0)}, step, "array<int>", lambda s: s["out"])
    rows = found.select(key, line, n.alias("n"), F.explode_outer(starts).alias("start")).where("start is not null")
    return rows.select(key, line, F.col("start").cast("long").alias("start"), (F.col("start") + F.col("n")).cast("long").alias("stop"))


def nearest_links(lines: DataFrame, screens: DataFrame, key: str) -> DataFrame:
    """(key, next, prev) of screens (key, top): the first line with a link at or after the top, and the last before it,
    of lines (key, line, link), going round at the ends; null where there is no link."""
    links = lines.where("link").select(key, "line")
    both = screens.join(links, key, "left").groupBy(key).agg(
        F.min(F.when(F.col("line") >= F.col("top"), F.col("line"))).alias("after"), F.max(F.when(F.col("line") < F.col("top"), F.col("line"))).alias("before"),
        F.min("line").alias("first"), F.max("line").alias("last"),
    )
    return both.select(key, F.coalesce("after", "first").alias("next"), F.coalesce("before", "last").alias("prev"))


def feed(releases: DataFrame, sections: DataFrame) -> DataFrame:
    """(version, released, heading) of releases (version, released) that have a section (heading) named v and the version;
    a release without a date is of the epoch."""
    named = releases.withColumn("version", F.concat(F.lit("v"), "version"))
    return named.join(sections, F.col("version") == F.col("heading")).select("version", F.coalesce("released", F.lit("1970-01-01 00:00:00").cast("timestamp")).alias("released"), "heading")


def sample_for(names: DataFrame, official: DataFrame, own: DataFrame, generic) -> DataFrame:
    """(name, sample, kind) of names (name, aliases): the official sample (name, sample) of the first alias that has one,
    else one's own by the name in small letters, else the generic one."""
    each = names.select("name", F.posexplode("aliases").alias("ord", "alias")).join(official.withColumnRenamed("name", "alias"), "alias")
    best = each.groupBy("name").agg(F.min_by("sample", "ord").alias("of_alias"))
    mine = own.select(F.lower("name").alias("own_name"), F.col("sample").alias("of_name"))
    found = names.select("name").distinct().join(best, "name", "left").join(mine, F.lower("name") == F.col("own_name"), "left")
    kind = F.when(F.col("of_alias").isNotNull(), "official").when(F.col("of_name").isNotNull(), "own").otherwise("generic")
    return found.select("name", F.coalesce("of_alias", "of_name", F.lit(generic)).alias("sample"), kind.alias("kind"))


def address_bar(spark: SparkSession, commands: Sequence[str], hits: DataFrame, query: str, best: int = 8, most: int = 10) -> DataFrame:
    """(ord, label): commands that hold the query, in their order, then the best of hits (label, tie, score), `most` in
    all. The best hits are taken first, so that only they are numbered."""
    fixed = [(0, i, c) for i, c in enumerate(commands) if query.lower() in c.lower()]
    top = hits.orderBy(F.desc("score"), "tie").limit(best)
    ranked = top.select(F.lit(1).alias("o"), F.row_number().over(Window.orderBy(F.desc("score"), "tie")).cast("int").alias("k"), "label")
    both = spark.createDataFrame(fixed, "o int, k int, label string").unionAll(ranked)
    return both.withColumn("ord", F.row_number().over(Window.orderBy("o", "k")).cast("long") - 1).where(F.col("ord") < most).select("ord", "label")


def same_members(one: DataFrame, two: DataFrame) -> DataFrame:
    """(same): whether two frames hold the same rows, however often: neither has one that the other lacks. Rows of both are counted
    together, so that neither side is ever gathered."""
    names = [f"c{i}" for i in range(len(one.columns))]
    side = lambda rows, first: rows.toDF(*names).withColumns({"first": F.lit(first), "second": F.lit(not first)})
    rows = side(one, True).unionAll(side(two, False)).groupBy(*names).agg(F.bool_or("first").alias("first"), F.bool_or("second").alias("second"))
    return rows.agg((F.count_if(~(F.col("first") & F.col("second"))) == 0).alias("same"))
