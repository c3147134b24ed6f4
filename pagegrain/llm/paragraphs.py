"""Operator 3, substring dedup: paragraph MinHash banding.

Units are of two kinds. A paragraph is a line of 25 words or more; its MinHash bands are tuned so that a
pair at Jaccard 0.8 meets with a chance of 99.9 %, colliding paragraphs are joined and verified
exactly, and classes are components. A passage pasted inside a paragraph makes no similar paragraph, so
min-hashed runs of 25 words are picked so that any shared span of 50 words picks a shared run, and
around each shared run all runs of 25 words are compared whole, so that the span is found from end to end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import grams
from .common import discard, release, small_batches, table, written
from .near import classes

THRESHOLD, SHINGLE, MIN_WORDS, SPAN = 0.8, 5, 25, 50
BANDS, ROWS = grams.tuned(THRESHOLD, 0.999, 36)


def _paragraphs(w: grams.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of paragraphs: the words they hold (as a mask), of each such word its paragraph, and where each begins."""
    if not len(w.doc):
        return np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.concatenate(([True], (w.doc[1:] != w.doc[:-1]) | (w.line[1:] != w.line[:-1])))
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(w.doc)))
    long = sizes >= MIN_WORDS
    return np.repeat(long, sizes), np.repeat(np.arange(long.sum()), sizes[long]), starts[long]


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        w = grams.words(batch.column("text"))
        place = grams.places(w.doc)
        mask, par, starts = _paragraphs(w)
        n = len(starts)
        _, node = grams.run_hash(par, w.hash[mask], 0x8EBC6AF09C88C6E3)
        group, g = grams.shingles(par, w.hash[mask], SHINGLE)
        keys = grams.bands(grams.minhash(group, g, n, BANDS * ROWS), BANDS, ROWS) if n else np.zeros((0, BANDS), np.uint64)
        first, run = grams.windows(w.doc, w.hash, MIN_WORDS, SPAN - MIN_WORDS + 1)
        at = np.concatenate((starts, first))
        size = np.concatenate((np.bincount(par, minlength=n), np.full(len(first), MIN_WORDS)))
        owner = pa.array(w.doc[at] if len(at) else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(owner), batch.column("raw").take(owner), pa.array(place[at].astype(np.int64) if len(at) else np.zeros(0, np.int64)), pa.array(size.astype(np.int64)),
                pa.array(np.concatenate((node, run)).view(np.int64)), grams.lists(np.repeat(np.arange(n), BANDS), keys.reshape(-1), len(at)),
            ],
            names=["doc_id", "raw", "first_word", "n_words", "node", "keys"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        w = grams.words(batch.column("text"))
        mask, par, starts = _paragraphs(w)
        _, node = grams.run_hash(par, w.hash[mask], 0x8EBC6AF09C88C6E3)
        group, g, _ = grams.counted(*grams.shingles(par, w.hash[mask], SHINGLE))
        yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), grams.lists(group, g, len(starts))], names=["node", "items"])


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All runs of MIN_WORDS words that begin less than a reach from one of a text's places. A shared span of
    SPAN words and more has a picked run less than a reach from each of its runs."""
    reach = SPAN - MIN_WORDS + 1
    for batch in batches:
        w = grams.words(batch.column("text"))
        places = batch.column("places")
        owner = np.repeat(np.arange(batch.num_rows), np.diff(places.offsets.to_numpy()))
        first = places.flatten().to_numpy()
        there = first + MIN_WORDS <= w.count[owner]  # but for two texts of one 64-bit key always so
        owner, first = owner[there], first[there]
        starts = np.cumsum(w.count) - w.count
        edge = np.zeros(len(w.doc) + 1, np.int64)
        np.add.at(edge, starts[owner] + np.maximum(first - reach + 1, 0), 1)
        np.add.at(edge, starts[owner] + np.minimum(first + reach, w.count[owner] - MIN_WORDS + 1), -1)
        at = np.flatnonzero(np.cumsum(edge) > 0)
        doc = w.doc[at]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c).take(pa.array(doc)) for c in ("row", "doc_id", "own")), pa.array((at - starts[doc]).astype(np.int64)), pa.array(grams.runs(w.hash, MIN_WORDS)[at].view(np.int64))],
            names=["row", "doc_id", "own", "first_word", "node"],
        )


PLACE = "row bigint, doc_id bigint, own bigint, first_word bigint, node bigint"
HELD = "row bigint, doc_id bigint, first_word bigint, n_class bigint, lead boolean, here bigint, before bigint"
SPANS = "doc_id bigint, first_word bigint, n_words bigint, class_id bigint, n_class bigint, removed boolean"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _held(rows: pa.Table) -> pa.Table:
    """Of the places of runs: those whose run two documents hold, with the run's places: how many, whether it is the
    first one by (doc_id, first_word, own), null ids first, and sums of hashes of them and of the places one word before them."""
    rows = rows.combine_chunks()
    node, own, at = (rows.column(c).to_numpy() for c in ("node", "own", "first_word"))
    null = rows.column("doc_id").is_null().to_numpy()
    doc = rows.column("doc_id").fill_null(0).to_numpy()
    order = np.lexsort((own, at, doc, ~null, node))
    node, own, at = node[order], own[order].view(np.uint64), at[order].astype(np.uint64)
    starts = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
    sizes = np.diff(np.append(starts, len(node)))
    several = np.maximum.reduceat(own, starts) != np.minimum.reduceat(own, starts)
    sums = [np.add.reduceat(grams.mix(own + x * np.uint64(0x9E3779B97F4A7C15)), starts).view(np.int64) for x in (at, at - np.uint64(1))]
    kept = np.repeat(several, sizes)
    spread = lambda x: np.repeat(x[several], sizes[several])
    mine = rows.take(pa.array(order[kept]))
    return pa.Table.from_arrays([*(mine.column(c) for c in ("row", "doc_id", "first_word")), pa.array(spread(sizes)), pa.array((own == np.repeat(own[starts], sizes))[kept] & (at == np.repeat(at[starts], sizes))[kept]), *(pa.array(spread(x)) for x in sums)], names=_names(HELD))


def _joined(rows: pa.Table) -> pa.Table:
    """Runs of a row that follow each other word by word, at the same places, as one span. Its class is named by the
    hash of the places of its first run: each set of places is one class, so no run need carry its words' hash as well."""
    rows = rows.sort_by([("row", "ascending"), ("first_word", "ascending")])
    row, at, n, here, before = (rows.column(c).to_numpy() for c in ("row", "first_word", "n_class", "here", "before"))
    same = (row[1:] == row[:-1]) & (at[1:] == at[:-1] + 1) & (n[1:] == n[:-1]) & (before[1:] == here[:-1])
    starts = np.flatnonzero(np.concatenate(([True], ~same)))
    size = np.diff(np.append(starts, len(row))) + MIN_WORDS - 1
    first = rows.column("lead").to_numpy()
    out = rows.take(pa.array(starts))
    return pa.Table.from_arrays([out.column("doc_id"), out.column("first_word"), pa.array(size.astype(np.int64)), out.column("here"), out.column("n_class"), pa.array(~first[starts])], names=_names(SPANS))


def _spans(spark: SparkSession, base: DataFrame, runs: DataFrame) -> DataFrame:
    """The shared spans around runs (own, first_word, node), from end to end: a class is a longest
    span that the same places hold, MIN_WORDS long at least. Where more or other places hold the next
    run, the next class begins, so spans of two classes may overlap."""
    # A table of its own: the join below then reads two exchanges, of which Spark splits a hot run's.
    twice = written(spark, runs.groupBy("node").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).where("lo < hi").select("node"), "shared")
    release(spark)
    found = runs.join(twice.hint("merge"), "node", "left_semi").groupBy("own").agg(F.collect_set("first_word").alias("places"))
    found = written(spark, found, "places")
    release(spark)
    discard(spark, twice)
    # Groups for Python, of some hundred thousand rows: a place brings 2 * reach - 1 runs at most.
    groups = (found.agg(F.sum(F.size("places"))).first()[0] or 0) // 20_000 + 1
    near = base.withColumn("own", F.xxhash64("doc_id", "raw")).join(found.hint("merge"), "own")
    near = written(spark, near.select(F.monotonically_increasing_id().alias("row"), "doc_id", "own", "places", "text"), "near")
    release(spark)
    with small_batches(spark):
        held = near.mapInArrow(_around, PLACE).groupBy(F.expr(f"pmod(node, {groups})")).applyInArrow(_held, HELD)
        held = written(spark, held, "held")
        release(spark)
        discard(spark, found, near)
        out = written(spark, held.groupBy(F.expr(f"pmod(xxhash64(row), {groups})")).applyInArrow(_joined, SPANS), "spans")
    release(spark)
    discard(spark, held)
    return out


def repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, first_word, n_words, class_id, n_class, removed): one row for each unit of docs (doc_id, text)
    that some other document repeats: the words first_word and up of its text, its class and the class's
    units, and whether a filter drops it: all but the first one, by (doc_id, first_word), go.

    Paragraphs are near at a Jaccard of 0.8 of their sets of five-word runs (A-Z folded); passages are
    equal word by word and go as far as they are. Rows of one doc_id and text are one document. Null, empty and short texts have no units; a
    unit that only its own document repeats is left out; an empty table gives no rows. Where different texts of one
    doc_id hold a class at the same place, the hash of doc_id and text says which is first. Other columns are ignored.
    class_id is an opaque name: of paragraphs a hash of words, of passages a hash of the places that hold them.
    """
    base = docs.select("doc_id", "text", F.xxhash64("text").alias("raw"))
    with small_batches(spark):
        units = base.mapInArrow(_units, "doc_id bigint, raw bigint, first_word bigint, n_words bigint, node bigint, keys array<bigint>")
        units = written(spark, units, "units")
    units = units.withColumn("own", F.xxhash64("doc_id", "raw"))
    # Spans come first: the tables of the paragraphs' classes stay.
    spans = _spans(spark, base, units.where("size(keys) = 0").select("own", "first_word", "node"))
    lines = units.where("size(keys) > 0")
    owner = lines.groupBy("node").agg(F.min(F.struct("doc_id", "raw")).alias("o"))

    def fetch(nodes: DataFrame) -> DataFrame:
        wanted = written(spark, owner.join(nodes, "node").selectExpr("o.doc_id own", "o.raw own_raw").distinct(), "wanted")
        texts = base.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("raw") == F.col("own_raw")), "left_semi").select("text")
        with small_batches(spark):
            sets = written(spark, texts.mapInArrow(_sets, "node bigint, items array<bigint>"), "sets")
        return sets.join(nodes, "node", "left_semi").dropDuplicates(["node"])

    comps = classes(spark, lines.select("node", F.explode("keys").alias("key")), fetch, THRESHOLD)
    release(spark)
    # Most units come once: only those of repeated nodes, or of nodes with a partner, go on.
    units = units.where("size(keys) > 0").drop("keys", "raw")
    twice = units.groupBy("node").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).where("lo < hi").select("node", F.col("node").alias("comp"))
    twice = written(spark, comps.unionByName(twice.join(comps.select("node").hint("merge"), "node", "left_anti")), "twice")
    release(spark)
    joined = written(spark, units.join(twice.hint("merge"), "node").drop("node").withColumnRenamed("comp", "class_id"), "repeated")
    release(spark)
    sizes = joined.groupBy("class_id").agg(F.min("own").alias("lo"), F.max("own").alias("hi"), F.count("*").alias("n_class"), F.min(F.struct("doc_id", "first_word", "own")).alias("head"))
    heads = written(spark, sizes.where("lo < hi").drop("lo", "hi"), "heads")
    out = joined.join(heads.hint("merge"), "class_id")
    return out.selectExpr("doc_id", "first_word", "n_words", "class_id", "n_class", "not (doc_id <=> head.doc_id and first_word = head.first_word and own = head.own) removed").unionByName(spans)


def op3_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All repeated paragraphs and passages of documents."""
    return repeats(spark, table(spark, sf_dir, "documents"))


ORACLE = None
