"""Whether code comes out as it went in: displayed rows rejoined to lines, held line by line against the source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: what a tab is shown as.
TAB = "    "


def rejoined(shown: DataFrame, key: list[str]) -> DataFrame:
    """(key, line, text) of displayed rows (key, pos, text, soft): a row marked soft goes on where the one before it ends; a first row begins a line even so.
    Rows of a line are joined in order; a key's rows meet in one group, as a block of code does on a screen."""
    order = Window.partitionBy(*key).orderBy("pos")
    numbered = shown.withColumn("line", F.sum(F.when(F.coalesce("soft", F.lit(False)), 0).otherwise(1)).over(order))
    numbered = numbered.withColumn("line", F.greatest(F.col("line"), F.lit(1)) - 1)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x.text)
    return numbered.groupBy(*key, "line").agg(F.array_join(parts, "").alias("text"))


def _lines(code: Column) -> Column:
    """A source's lines as they are shown: tabs as TAB, empty lines at the end left out."""
    return F.split(F.regexp_replace(F.replace(code, F.lit("\t"), F.lit(TAB)), r"\n+\z", ""), "\n")


def compared(sources: DataFrame, shown: DataFrame, key: list[str]) -> DataFrame:
    """(key, lang, same, how, line) of sources (key, lang, code) and displayed rows (key, pos, text, soft): how is `bytes` (equal), `spaces` (equal but for
    white space at line ends), `line` (line, from 1, is the first that differs) or `count` (one has lines that the other lacks). Null code has one empty line; a key
    without displayed rows shows nothing; displayed rows without a source have no row."""
    want = sources.select(*key, "lang", F.posexplode(_lines(F.coalesce("code", F.lit("")))).alias("line", "want"))
    got = rejoined(shown, key)
    # Empty lines at the end of what is shown count for nothing either.
    last = got.where("text <> ''").groupBy(*key).agg(F.max("line").alias("last"))
    got = got.join(last, key).where("line <= last").select(*key, F.col("line").cast("int").alias("line"), F.col("text").alias("got"))
    both = want.join(got, [*key, "line"], "full")
    bare = lambda c: F.regexp_replace(c, r"\s+\z", "")
    odd = F.coalesce(F.col("want"), F.lit("")) != F.coalesce(F.col("got"), F.lit(""))
    missing = F.col("want").isNull() | F.col("got").isNull()
    # A source without text is one empty line, which needs no row to show it.
    missing &= ~((F.col("line") == 0) & F.coalesce(F.col("want") == "", F.lit(False)))
    found = both.groupBy(*key).agg(
        F.bool_or(F.col("want").isNotNull()).alias("known"), F.max("lang").alias("lang"), F.count_if(odd | missing).alias("odd"), F.count_if(missing).alias("missing"),
        F.min(F.when(~missing & (bare(F.col("want")) != bare(F.col("got"))), F.col("line") + 1)).alias("first"),
    ).where("known")
    how = F.when(F.col("first").isNotNull(), "line").when(F.col("missing") > 0, "count").when(F.col("odd") > 0, "spaces").otherwise("bytes")
    return found.select(*key, "lang", how.isin("bytes", "spaces").alias("same"), how.alias("how"), F.when(F.col("first").isNotNull(), F.col("first")).alias("line"))


def by_language(results: DataFrame) -> DataFrame:
    """(lang, n, same, exact) of compared(): sources, and the shares that come out the same and byte by byte."""
    share = lambda c: F.round(F.avg(c.cast("int")), 3)
    return results.groupBy("lang").agg(F.count("*").alias("n"), share(F.col("same")).alias("same"), share(F.col("how") == "bytes").alias("exact"))
