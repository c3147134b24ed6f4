"""Sentences in texts, by anchors: each sentence is looked for at one window of its bytes only, of a few the one that the fewest texts have.

A sentence that stands in a text shares with it every window of its UTF-8 bytes. A window is as wide as the widest of WIDTHS that the sentence has room
for, so that it holds two thirds of a short sentence at least. Texts are counted by the windows of sentences that they have, each sentence's rarest is its anchor,
and texts that have the anchor are held against the sentence itself, in the task that reads them. Texts are hashed a batch at a time, at all places,
and held against a Bloom filter of the windows; what passes it is few, and joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import pieces, ship
from ..sources.tables import written

#: Bytes of a window, and windows of a sentence that are counted, from its first to its last.
WIDTHS, WINDOWS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32), 3
#: Anchors that are broadcast to the texts at most, with their sentences (some 370 bytes each); up to ROUNDS times as many are one turn after another, each
#: over the texts, written once with their hashes; beyond, both sides are shuffled by anchor.
FEW, ROUNDS = 250_000, 8
#: Bytes of texts that are hashed at a time, and rows.
BLOCK, ROWS = 1 << 15, 2000
#: Bits a hash of a filter at least, and a hash's bits.
BITS, PROBES = 16, 3


def _mixed(n: int) -> np.ndarray:
    """n fixed 64-bit values without order (splitmix64)."""
    z = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


_BYTES = _mixed(256)
_ODD = _mixed(256 + 64)[256:] | np.uint64(1)


def _hashed(data: np.ndarray, widths: list[int]) -> dict[int, np.ndarray]:
    """By width the hashes of all windows of bytes, along the last axis: two narrower windows' hashes together, which overlap where the width is no power of two."""
    found = {1: _BYTES[data]}
    for w in WIDTHS[1:]:
        k = 1 << (w - 1).bit_length() - 1  # the widest power of two below
        if w in widths or w == 2 * k < max(widths):
            found[w] = found[k][..., : k - w] * _ODD[w] + found[k][..., w - k :]
    return {w: found[w] for w in widths}


def _places(h: np.ndarray, probe: int, size: int) -> np.ndarray:
    """Bits of hashes in a filter of `size` bytes, a power of two."""
    return (h * _ODD[40 + probe] >> np.uint64(62 - size.bit_length())).view(np.int64)


def _passing(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Indexes of the hashes that a filter lets through: all it was made of, and few others."""
    at = None
    for probe in range(PROBES):
        p = _places(h if at is None else h[at], probe, bits.size)
        ok = np.flatnonzero((bits[p >> 3] >> (p & 7).astype(np.uint8) & np.uint8(1)).view(bool))
        at = ok if at is None else at[ok]
    return at


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a column of strings without nulls."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return offsets, np.frombuffer(column.buffers()[2] or b"", np.uint8)


def _lists(rows: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """Values by row, in order of rows, as a list for each of n rows."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32()), pa.array(values.view(np.int64)))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds a sentence's width and the hashes of its WINDOWS windows."""
    for batch in pieces(batches, ROWS):
        offsets, data = _bytes(batch.column("sentence"))
        size = np.diff(offsets)
        width = np.array(WIDTHS)[np.searchsorted(WIDTHS, size, "right") - 1]
        out = np.zeros((len(size), WINDOWS), np.uint64)
        for w in np.unique(width).tolist():
            mine = np.flatnonzero(width == w)
            first = offsets[mine, None] + (size[mine, None] - w) * np.arange(WINDOWS) // (WINDOWS - 1)
            out[mine] = _hashed(data[first[..., None] + np.arange(w)], [w])[w][..., 0]
        hashes = _lists(np.repeat(np.arange(len(size)), WINDOWS), out.ravel(), len(size))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(width, pa.int32()), hashes], [*batch.schema.names, "width", "hs"])


def _found(widths: list[int], bits: Broadcast, keep: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Gives the columns `keep` of texts, and the distinct hashes of their windows that pass a filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, ROWS):
            offsets, data = _bytes(batch.column("text"))
            rows, values = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for start in range(int(offsets[0]), int(offsets[-1]), BLOCK):
                for w, h in _hashed(data[start : min(start + BLOCK + max(widths) - 1, int(offsets[-1]))], widths).items():
                    h = h[:BLOCK]
                    at = _passing(h, bits.value)
                    row = np.searchsorted(offsets, at + start, "right") - 1
                    own = at + start + w <= offsets[row + 1]  # not into the next text
                    rows.append(row[own])
                    values.append(h[at[own]])
            row, h = np.concatenate(rows), np.concatenate(values)
            order = np.lexsort((h, row))
            row, h = row[order], h[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), _lists(row[new], h[new], len(batch))], [*keep, "hs"])

    return run


def _filter(spark: SparkSession, hashes: DataFrame, count: int) -> Broadcast:
    """A Bloom filter of so many hashes (h), made in the tasks: the driver gets its words, 4 to 8 bytes a hash."""
    size = 1 << max(10, (count * BITS // 8 - 1).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
            p = np.concatenate([_places(h, probe, size) for probe in range(PROBES)])
            yield pa.RecordBatch.from_arrays([pa.array(p >> 6), pa.array((np.uint64(1) << (p & 63).astype(np.uint64)).view(np.int64))], ["at", "word"])

    words = hashes.mapInArrow(run, "at bigint, word bigint").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    bits = np.zeros(size // 8, "<i8")
    bits[words.column("at").to_numpy()] = words.column("word").to_numpy()
    return spark.sparkContext.broadcast(bits.view(np.uint8))


def _texts_with(texts: DataFrame, widths: list[int], bits: Broadcast, keep: list[str]) -> DataFrame:
    """The columns `keep` of texts, and hs, the distinct hashes that pass the filter, of texts that have some."""
    out = T.StructType([*(texts.schema[c] for c in keep), T.StructField("hs", T.ArrayType(T.LongType()))])
    return texts.mapInArrow(_found(widths, bits, keep), out).where("size(hs) > 0")


def _anchored(spark: SparkSession, each: DataFrame, texts: DataFrame, widths: list[int], count: int) -> DataFrame:
    """(h, sentence_key, sentence, m) of sentences each (id, sentence_key, sentence, m, width, hs): the window that the fewest texts have. Sentences with a
    window that no text has are left out. Windows meet their counts by hash; sentences by id."""
    own = each.select("id", F.explode(F.array_distinct("hs")).alias("h"))
    counts = _texts_with(texts, widths, _filter(spark, own.select("h"), count * WINDOWS), []).select(F.explode("hs").alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    least = own.join(counts, "h", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "h")).alias("least")).where("least.df > 0")
    return each.join(least, "id").select("least.h", "sentence_key", "sentence", "m")


def _held(spark: SparkSession, texts: DataFrame, widths: list[int], anchors: DataFrame) -> DataFrame:
    """(sentence_key, text_key) of anchors (h, sentence_key, sentence, m; a written table) that a row of texts holds, m times each. What is broadcast meets
    the texts where they are read. Shuffled windows carry a text's key and hash only, and the texts meet their candidates."""
    count, pairs = anchors.count(), None
    bits = _filter(spark, anchors.select("h"), count)
    rounds = -(-count // FEW) if FEW else ROUNDS + 1
    if rounds <= ROUNDS:
        whole = _texts_with(texts, widths, bits, ["text_key", "text"])
        if rounds > 1:
            whole = written(spark, whole, "texts")
        for i in range(max(rounds, 1)):
            mine = anchors if rounds <= 1 else anchors.where(F.pmod(F.xxhash64("sentence"), F.lit(rounds)) == i)
            found = whole.select("text_key", "text", F.explode("hs").alias("h")).join(F.broadcast(mine), "h").where(F.contains("text", F.col("sentence")))
            found = found.select("sentence_key", "text_key", "m")
            if rounds > 1:  # so that one turn's anchors are held at a time
                found = written(spark, found, "found")
            pairs = found if pairs is None else pairs.unionByName(found)
    else:
        rows = texts.select("text_key", "text", F.xxhash64("text").alias("raw"))
        hashed = _texts_with(rows, widths, bits, ["text_key", "raw"]).select("text_key", "raw", F.explode("hs").alias("h"))
        found = hashed.join(anchors.hint("merge"), "h").select(F.col("text_key").alias("own_key"), F.col("raw").alias("own_raw"), "sentence_key", "sentence", "m").distinct()
        same = rows["text_key"].eqNullSafe(F.col("own_key")) & (rows["raw"] == F.col("own_raw"))
        pairs = rows.join(found, same).where(F.contains("text", F.col("sentence"))).select("sentence_key", "text_key", "m")
    return pairs.select("sentence_key", "text_key", F.explode(F.array_repeat(F.lit(0), F.col("m").cast("int"))).alias("i")).drop("i")


def contained(spark: SparkSession, sentences: DataFrame, texts: DataFrame) -> DataFrame:
    """(sentence_key, text_key) of each sentence (sentence_key, sentence) and each text (text_key, text) that holds it, letter by letter. Null and empty sentences
    are in no text; repeated rows give a pair each; a sentence that is in every text gives as many rows as there are texts.
    """
    ship(spark)
    texts = texts.where("text <> ''").select("text_key", "text")
    each = sentences.where("sentence <> ''").groupBy("sentence_key", "sentence").agg(F.count("*").alias("m")).withColumn("id", F.monotonically_increasing_id())
    out = T.StructType([*each.schema.fields, T.StructField("width", T.IntegerType()), T.StructField("hs", T.ArrayType(T.LongType()))])
    each = written(spark, each.mapInArrow(_windows, out), "sentences")
    sizes = {r[0]: r[1] for r in each.groupBy("width").count().collect()}  # as many as WIDTHS at most
    if not sizes:
        return sentences.select("sentence_key").limit(0).join(texts.select("text_key").limit(0), F.lit(False))
    widths = sorted(sizes)
    anchors = written(spark, _anchored(spark, each, texts, widths, sum(sizes.values())), "anchors")
    return _held(spark, texts, widths, anchors)
