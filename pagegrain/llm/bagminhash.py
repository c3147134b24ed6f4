"""Operator 2, MinHash near-dedup: BagMinHash signatures, banding, multiset verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import grams
from .common import BLANKS, release, small_batches, table, written
from .near import classes

SHINGLE, THRESHOLD = 5, 0.8
#: Slots, bands and rows: a pair at the threshold shares a band with a chance of 1 - 3e-6.
SLOTS, BANDS, ROWS = 96, 24, 4


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        w = grams.words(batch.column("text"))
        node = np.zeros(n, np.uint64)
        which, h = grams.run_hash(w.doc, w.hash, 0xE7037ED1A0B428DB)
        node[which] = h
        group, g = grams.shingles(w.doc, w.hash, SHINGLE)
        sig = grams.bag_minhash(*grams.counted(group, g), n, SLOTS)
        full = w.count > 0
        keys = grams.bands(sig, BANDS, ROWS)
        owner = np.repeat(np.arange(n), np.where(full, BANDS, 0))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("raw"), pa.array(node.view(np.int64), mask=~full), grams.lists(owner, keys[full].reshape(-1), n)],
            names=["doc_id", "raw", "node", "keys"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        w = grams.words(batch.column("text"))
        group, g = grams.occurrences(*grams.shingles(w.doc, w.hash, SHINGLE))
        yield pa.RecordBatch.from_arrays([batch.column("node"), grams.lists(group, g, batch.num_rows)], names=["node", "items"])


def near_classes(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, raw, class_id, n_class, stays): one row a row of docs (doc_id, text); raw is
    xxhash64(text), stays marks the row of its class that a filter keeps.

    Two texts are near when the multisets of their runs of five words (A-Z folded, white space ignored)
    have a weighted Jaccard of 0.8 or more; classes are components of that relation, class_id the least
    doc_id of the class, n_class its rows. A text of one to four words is one shingle. Null or a text
    without words is near nothing: it is a class of its own, with its own doc_id. Repeated rows are copies of
    each other. Other columns are ignored; an empty table gives no rows.
    """
    base = docs.select("doc_id", "text", F.xxhash64("text").alias("raw"))
    with small_batches(spark):
        signed = written(spark, base.mapInArrow(_signed, "doc_id bigint, raw bigint, node bigint, keys array<bigint>"), "signed")
    owner = signed.where("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "raw")).alias("o"))

    def fetch(nodes: DataFrame) -> DataFrame:
        wanted = owner.join(nodes, "node").selectExpr("node", "o.doc_id as own", "o.raw as own_raw")
        texts = base.join(wanted, F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("raw") == F.col("own_raw"))).select("node", "text")
        with small_batches(spark):
            sets = written(spark, texts.mapInArrow(_sets, "node bigint, items array<bigint>"), "texts")
        return sets.dropDuplicates(["node"])

    comps = classes(spark, signed.select("node", F.explode("keys").alias("key")), fetch, THRESHOLD)
    release(spark)
    grouped = signed.select("doc_id", "raw", "node").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    first = F.min(F.struct("doc_id", "raw")).alias("first")
    ids = written(spark, grouped.where("comp is not null").groupBy("comp").agg(first, F.count("*").alias("n_class")), "ids")
    return grouped.join(ids, "comp", "left").selectExpr(
        "doc_id", "raw", "if(first is null, doc_id, first.doc_id) class_id", "coalesce(n_class, 1L) n_class",
        "first is null or (doc_id <=> first.doc_id and raw = first.raw) stays",
    )


def deduplicated(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all its columns: of each class the row with the least (doc_id,
    xxhash64 of the text), of repeated such rows one. Texts without words all stay."""
    found = near_classes(spark, docs)
    keep = written(spark, found.where("stays").groupBy("doc_id", "raw").agg(F.count("*").alias("n")), "keep")
    own, raw = "__pg_own_id", "__pg_own_raw"
    keyed = docs.withColumn(raw, F.xxhash64("text"))

    def of(rows: DataFrame, how: str) -> DataFrame:
        other = rows.selectExpr(f"doc_id {own}", "raw __pg_raw")
        return keyed.join(other, F.col("doc_id").eqNullSafe(F.col(own)) & (F.col(raw) == F.col("__pg_raw")), how)

    again = keep.where("n > 1")
    kept = of(keep, "left_semi")
    if again.isEmpty():
        return kept.drop(raw)
    some = F.trim(F.coalesce("text", F.lit("")), F.lit(BLANKS)) != ""
    once = of(again, "left_semi").where(some).dropDuplicates(["doc_id", raw])
    wordless = of(again, "left_semi").where(~some)
    return of(keep.where("n = 1"), "left_semi").unionByName(once).unionByName(wordless).drop(raw)


def op2_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class: doc_id, class_id (the least doc_id of its near-duplicates), n_class."""
    return near_classes(spark, table(spark, sf_dir, "documents")).drop("raw", "stays")
