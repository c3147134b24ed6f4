"""Links between documents: a registry of sections, links resolved against it, moved sections followed to where they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import written

#: Rounds of following at most: each doubles the steps taken, so ways of 2 ** ROUNDS moves are followed to their end.
ROUNDS = 40


def settled(spark: SparkSession, moves: DataFrame) -> DataFrame:
    """(doc, slug, to_doc, to_slug) of moves of that form, each followed until it leads to what hasn't moved: ways are joined with themselves, so
    that a way of n moves takes log2(n) rounds. What goes round in a circle leads nowhere: null. Of several moves of a section the least counts;
    a section that moves onto itself hasn't moved.

    The places that open ways stand at become fewer from round to round, until they map onto themselves: then all of them are in circles."""
    two = F.struct("to_doc", "to_slug")
    ways = moves.where("doc is not null and slug is not null and to_doc is not null and to_slug is not null and not (doc = to_doc and slug = to_slug)")
    ways = written(spark, ways.groupBy("doc", "slug").agg(F.min(two).alias("t")).select("doc", "slug", "t.to_doc", "t.to_slug"), "ways")
    places = None
    for _ in range(ROUNDS):
        on = ways.select(F.col("doc").alias("to_doc"), F.col("slug").alias("to_slug"), F.col("to_doc").alias("then_doc"), F.col("to_slug").alias("then_slug"))
        step = ways.join(on, ["to_doc", "to_slug"], "left").withColumn("moved", F.col("then_doc").isNotNull())
        step = written(spark, step.select("doc", "slug", F.coalesce("then_doc", "to_doc").alias("to_doc"), F.coalesce("then_slug", "to_slug").alias("to_slug"), F.when(F.col("moved"), F.struct("to_doc", "to_slug")).alias("place")), "ways")
        before, places = places, step.where("place is not null").select("place").distinct().count()
        ways = step.drop("place")
        if places in (0, before):
            break
    # What still leads to a section that moves is in a circle, or leads into one.
    still = ways.select(F.col("doc").alias("to_doc"), F.col("slug").alias("to_slug"), F.lit(True).alias("still"))
    ends = ways.join(still, ["to_doc", "to_slug"], "left")
    end = lambda c: F.when(F.col("still").isNull(), F.col(c)).alias(c)
    return ends.select("doc", "slug", end("to_doc"), end("to_slug"))


def linked(spark: SparkSession, links: DataFrame, sections: DataFrame, moves: DataFrame) -> DataFrame:
    """(doc, ord, to_doc, to_slug, state) of links (doc, ord, to_doc, to_slug): `section` (the section is there), `moved` (it is where its moves lead, and to_doc
    and to_slug say where), `document` (without a section: the document is there) or `dangling`. sections (doc, slug) may repeat; one join each with the registry,
    the settled moves and, for links to whole documents, the documents."""
    there = sections.select(F.col("doc").alias("d"), F.col("slug").alias("s")).distinct()
    docs = sections.select(F.col("doc").alias("d")).distinct().withColumn("known", F.lit(True))
    moved = settled(spark, moves).select(F.col("doc").alias("m_doc"), F.col("slug").alias("m_slug"), F.col("to_doc").alias("n_doc"), F.col("to_slug").alias("n_slug"), F.lit(True).alias("has"))
    rows = links.join(moved, (links["to_doc"] == F.col("m_doc")) & (links["to_slug"] == F.col("m_slug")), "left")
    rows = rows.select(links["doc"], links["ord"], links["to_doc"].alias("a_doc"), links["to_slug"].alias("a_slug"), F.when(F.col("has"), F.col("n_doc")).otherwise(links["to_doc"]).alias("to_doc"), F.when(F.col("has"), F.col("n_slug")).otherwise(links["to_slug"]).alias("to_slug"), F.coalesce("has", F.lit(False)).alias("has"))
    rows = rows.join(there, (F.col("to_doc") == F.col("d")) & (F.col("to_slug") == F.col("s")), "left").withColumn("hit", F.col("d").isNotNull()).drop("d", "s")
    rows = rows.join(docs, F.col("to_doc") == F.col("d"), "left")
    whole = F.col("a_slug").isNull() | (F.col("a_slug") == "")
    state = F.when(whole & F.col("known"), "document").when(F.col("hit") & F.col("has"), "moved").when(F.col("hit"), "section").otherwise("dangling")
    kept = lambda moved, own: F.when(F.col("state") == "dangling", F.col(own)).otherwise(F.col(moved))
    return rows.withColumn("state", state).select("doc", "ord", kept("to_doc", "a_doc").alias("to_doc"), kept("to_slug", "a_slug").alias("to_slug"), "state")
