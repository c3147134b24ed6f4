"""Operator 5, language ID: a document as a mixture of languages, by expectation-maximisation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import grams
from .common import small_batches, table, written

BUCKETS, SMOOTHING, ROUNDS = 1 << 16, 0.5, 12
#: What one more language must gain in log likelihood, in units of log(words) / 2.
PENALTY = 4.0
LETTER = (np.arange(256) >= 128) | np.isin(np.arange(256), np.arange(97, 123))
_CLASS = np.where(LETTER, np.arange(256), 32).astype(np.uint32)


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Of every letter byte: the bucket of the four-byte window around it, its document; where words
    begin among them; and the documents. Texts come lower-cased and padded with blanks."""
    data, at = grams.buffers(column)
    if len(data) < 4:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), len(at) - 1
    c = _CLASS[data]
    key = (c[:-3] << np.uint32(24)) | (c[1:-2] << np.uint32(16)) | (c[2:-1] << np.uint32(8)) | c[3:]
    letter = LETTER[data[1:-2]]
    where = np.flatnonzero(letter)
    bucket = ((key[where] * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)
    begins = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1] + 1)) if len(where) else np.zeros(0, bool))
    doc = np.searchsorted(at, where + 1, "right") - 1
    return bucket, doc, begins, len(at) - 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, np.ndarray] = {}
    for batch in batches:
        bucket, doc, _, n = _tokens(batch.column("text"))
        langs = batch.column("lang").to_pylist()
        names = sorted(set(langs))
        code = np.array([names.index(x) for x in langs]) if n else np.zeros(0, int)
        counts = np.bincount(code[doc] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS) if len(bucket) else []
        for name, row in zip(names, counts, strict=False):
            found[name] = found.get(name, 0) + row
    for name, row in found.items():
        at = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(row[at].astype(np.int64))], names=["lang", "bucket", "n"])


def _sum(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, starts, axis=0)


def _em(like: np.ndarray, share: np.ndarray, owner: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each document after ROUNDS of EM from `share`, and its log likelihood. like: of
    each word, exp(log likelihood - the word's best)."""
    for _ in range(ROUNDS):
        joint = like * share[owner]
        share = _sum(joint / joint.sum(axis=1, keepdims=True), starts) / sizes[:, None]
    return share, _sum(np.log((like * share[owner]).sum(axis=1)), starts)


def mixtures(like_of: np.ndarray, bucket: np.ndarray, doc: np.ndarray, begins: np.ndarray, n: int) -> np.ndarray:
    """Proportions (n documents x languages), zero outside the chosen set of languages; a document
    without words has none. The set grows along the order of the full mixture's proportions as long as
    another language gains more log likelihood than the penalty."""
    out = np.zeros((n, like_of.shape[1]))
    if not len(bucket):
        return out
    words = _sum(like_of[bucket], begins)
    owner_doc = doc[begins]
    live, starts = np.unique(owner_doc, return_index=True)
    sizes = np.diff(np.append(starts, len(owner_doc)))
    owner = np.repeat(np.arange(len(live)), sizes)
    best = words.max(axis=1)
    like = np.exp(np.maximum(words - best[:, None], -60.0)).astype(np.float64)
    k = like.shape[1]
    full, _ = _em(like, np.full((len(live), k), 1.0 / k), owner, starts, sizes)
    single = _sum(words - best[:, None], starts)
    chosen = single.argmax(axis=1)
    share = np.zeros((len(live), k))
    share[np.arange(len(live)), chosen] = 1.0
    score = single.max(axis=1)
    order = np.argsort(-full, axis=1, kind="stable")
    open_ = np.arange(len(live))
    for s in range(2, k + 1):
        pick = np.isin(owner, open_)
        sub, sub_sizes = like[pick], sizes[open_]
        sub_owner, sub_starts = np.repeat(np.arange(len(open_)), sub_sizes), np.concatenate(([0], np.cumsum(sub_sizes)[:-1]))
        allowed = np.zeros((len(open_), k))
        np.put_along_axis(allowed, order[open_][:, :s], 1.0 / s, axis=1)
        new, ll = _em(sub + 1e-300, allowed, sub_owner, sub_starts, sub_sizes)
        better = ll - score[open_] > PENALTY * 0.5 * np.log(np.maximum(sub_sizes, 2))
        share[open_[better]], score[open_[better]] = new[better], ll[better]
        open_ = open_[better]
        if not len(open_):
            break
    out[live] = share
    return out


def _predictor(model):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table_ = model.value
        for batch in batches:
            bucket, doc, begins, n = _tokens(batch.column("text"))
            lang, score = np.full(n, "und", object), np.zeros(n)
            if len(names) and n:
                share = mixtures(table_, bucket, doc, begins, n)
                has = batch.column("has_letter").to_numpy(zero_copy_only=False).astype(bool) & (share.sum(axis=1) > 0)
                lang[has] = np.array(names, object)[share.argmax(axis=1)][has]
                score[has] = np.clip(share.max(axis=1)[has], 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return predict


def _padded(text: Column) -> Column:
    return F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit("   "))


def learned(spark: SparkSession, rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log likelihoods: buckets x languages) from all rows (text, lang) with a lang. The
    model's size is languages x BUCKETS whatever the input's size."""
    train = rows.where("lang is not null").select(_padded(F.col("text")).alias("text"), "lang")
    with small_batches(spark):
        counts = written(spark, train.mapInArrow(_count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "ngrams")
    got = counts.toPandas()
    names = sorted(got["lang"].unique())
    table_ = np.full((BUCKETS, len(names)), SMOOTHING, np.float64)
    for i, name in enumerate(names):
        of = got[got["lang"] == name]
        table_[of["bucket"].to_numpy(), i] += of["n"].to_numpy()
    return names, np.log(table_ / table_.sum(axis=0)).astype(np.float32)


def identified(spark: SparkSession, docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of docs (doc_id, text): the largest language of its
    mixture and its proportion. `und` and 0 where the text is null or has no letter, or nothing was learned.
    Ties go to the language that sorts first."""
    held = spark.sparkContext.broadcast(model)
    rows = docs.select("doc_id", _padded(F.col("text")).alias("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has_letter"))
    with small_batches(spark):
        return written(spark, rows.mapInArrow(_predictor(held), "doc_id bigint, lang_pred string, score double"), "languages")


def op5_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score; learned from the rows that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = learned(spark, docs.where(~F.coalesce(held, F.lit(False))))
    return identified(spark, docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


ORACLE = None
