"""Operator 1, quality classifier: hierarchical empirical Bayes over host and path.

A logistic classifier, fitted on a bounded sample of labelled documents, gives each document's own
evidence. Grouped sums of that evidence over all documents give every host and path its posterior,
shrunk towards its parent (path to host, host to all) by an empirical-Bayes weight. A document's
score is its own log odds moved by the log odds of its path against all, itself left out of both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import grams
from .common import small_batches, table, written

#: Labelled rows at most that the classifier is fitted on; those of the least hash of doc_id.
FIT_ROWS = 12_000
DIMS, EPOCHS, RATE, RIDGE = 1 << 18, 150, 0.3, 1e-5
MIN_DOCS, G2 = 4, 15.0
STYLE = 5
HEADS = ("quality", "toxic")
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>!@=+_~^", np.uint8))
_UPPER, _LOWER, _DIGIT = (np.isin(np.arange(256), np.arange(a, b)) for a, b in ((65, 91), (97, 123), (48, 58)))


def _features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hashed word) pairs, each once, and STYLE numbers a document."""
    w = grams.words(column, grams.NOT_ALNUM)
    n = len(w.count)
    doc, feature, _ = grams.counted(w.doc, (w.hash >> np.uint64(20)) % np.uint64(DIMS))
    data, at = grams.buffers(column)
    size = np.maximum(np.diff(at), 1)

    def share(kind: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(kind[data])))
        return (sums[at[1:]] - sums[at[:-1]]) / size

    distinct = np.bincount(doc, minlength=n) / np.maximum(w.count, 1)
    style = np.stack([np.log1p(w.count) / 8, share(_SYMBOL) * 5, share(_UPPER) / (share(_UPPER) + share(_LOWER) + 1e-9), share(_DIGIT) * 10, distinct], axis=1)
    return doc, feature.astype(np.int64), style


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, feature, style = _features(batch.column("text"))
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [batch.column("quality"), batch.column("toxic"), grams.lists(doc, feature, n), pa.ListArray.from_arrays(pa.array(np.arange(0, STYLE * n + 1, STYLE), pa.int32()), pa.array(style.reshape(-1)))],
            names=["quality", "toxic", "words", "style"],
        )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _telling(doc: np.ndarray, feature: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Words (a mask over DIMS) whose presence and the label go together by more than chance: a likelihood
    ratio of G2 at least, in MIN_DOCS documents at least. Others would only be learned by heart."""
    n, pos = len(y), y.sum()
    both, of = np.bincount(feature, y[doc], minlength=DIMS), np.bincount(feature, minlength=DIMS)
    g = np.zeros(DIMS)
    for seen, expected in ((both, of * pos / n), (of - both, of * (n - pos) / n), (pos - both, (n - of) * pos / n), (n - of - pos + both, (n - of) * (n - pos) / n)):
        g += 2 * np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12)), 0)
    return (of >= MIN_DOCS) & (g >= G2)


def _fit(doc: np.ndarray, feature: np.ndarray, style: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (DIMS words, STYLE numbers, constant) of a ridge-penalised logistic model of the telling words,
    by AdaGrad over all rows. One class only: the constant alone, at its smoothed odds."""
    weights, n = np.zeros(DIMS + STYLE + 1), len(y)
    p = (y.sum() + 0.5) / (n + 1.0)
    weights[-1] = np.log(p / (1 - p))
    if n == 0 or y.min() == y.max():
        return weights
    on = _telling(doc, feature, y)[feature]
    doc, feature = doc[on], feature[on]
    total = np.full(len(weights), 1e-10)
    for _ in range(EPOCHS):
        score = np.bincount(doc, weights[feature], minlength=n) + style @ weights[DIMS:-1] + weights[-1]
        error = (_sigmoid(score) - y) / n
        grad = np.concatenate((np.bincount(feature, error[doc], minlength=DIMS), error @ style, [error.sum()])) + RIDGE * np.concatenate((weights[:-1], [0.0]))
        total += grad * grad
        weights -= RATE * grad / np.sqrt(total)
    return weights


def _scorer(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = model.value
        for batch in batches:
            doc, feature, style = _features(batch.column("text"))
            n = batch.num_rows
            out = [np.bincount(doc, w[feature], minlength=n)[:n] + style @ w[DIMS:-1] + w[-1] for w in heads]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), batch.column("path"), *map(pa.array, out)], names=["doc_id", "host", "path", *HEADS])

    return score


def fitted(spark: SparkSession, docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> list[np.ndarray]:
    """One weight vector a head, from at most fit_rows labelled documents; a head that is null for one leaves it
    out. Of several texts of one doc_id the one of the least hash counts, so that no more rows come to the driver."""
    some = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    some = written(spark, some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows), "labelled")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("quality").alias("quality"), F.first("toxic").alias("toxic"))
    rows = rows.selectExpr("cast(coalesce(quality, -1) as int) quality", "cast(coalesce(toxic, -1) as int) toxic", "text")
    with small_batches(spark):
        got = rows.mapInArrow(_featured, "quality int, toxic int, words array<bigint>, style array<double>").toArrow()
    if not got.num_rows:
        return [_fit(np.zeros(0, int), np.zeros(0, int), np.zeros((0, STYLE)), np.zeros(0)) for _ in HEADS]
    words = got.column("words").combine_chunks()
    words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    doc = np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy()))
    feature = words.flatten().to_numpy()
    style = np.array(got.column("style").combine_chunks().flatten()).reshape(-1, STYLE)
    heads = []
    for h in HEADS:
        y = got.column(h).to_numpy()
        labelled = y >= 0
        number = np.cumsum(labelled) - 1
        on = labelled[doc]
        heads.append(_fit(number[doc[on]], feature[on], style[labelled], (y[labelled] > 0).astype(float)))
    return heads


def _weight(n: float, s: float, squares: float, k: int) -> tuple[float, float]:
    """(mean, weight) of a level's groups by the method of moments: mean (1 - mean) / variance between the
    groups - 1, held to 1..10,000, so that groups that differ little, or hold few documents, take their
    parent's value. n rows, s their sum, squares: the sum of s^2 / n over k groups."""
    if not n:
        return 0.5, 1.0
    mean = min(max(s / n, 1e-4), 1 - 1e-4)
    between = max(squares / n - mean * mean, 1e-9)
    return mean, min(max(mean * (1 - mean) / between - 1, 1.0), 1e4) if k > 1 else 1e4


def _moments(df: DataFrame, n: str) -> dict[str, tuple[float, float]]:
    """_weight() of each head over df (n, a sum a head)."""
    row = df.agg(F.sum(n).alias("n"), F.count("*").alias("k"), *[F.sum(h).alias(h) for h in HEADS], *[F.sum(F.col(h) * F.col(h) / F.col(n)).alias(f"{h}_squares") for h in HEADS]).first()
    return {h: _weight(row["n"], row[h], row[f"{h}_squares"], row["k"]) for h in HEADS}


def _log_odds(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(p / (1 - p))


def classified(spark: SparkSession, docs: DataFrame, labels: DataFrame, host: Column, path: Column, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, p_quality, p_toxic, keep) of every row of docs (doc_id, text and what host and path read).

    host and path may be null: a group like any other. Null and empty texts are scored by their style alone. Without
    labels every score is 0.5. keep: quality at 0.5 or more and toxic below it. Repeated rows are
    scored each; a doc_id labelled twice takes the larger label.
    """
    model = spark.sparkContext.broadcast(fitted(spark, docs, labels, fit_rows))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), host.cast("string").alias("host"), path.cast("string").alias("path"))
    with small_batches(spark):
        scored = written(spark, rows.mapInArrow(_scorer(model), "doc_id bigint, host string, path string, quality double, toxic double"), "scored")
    own = {h: 1 / (1 + F.exp(-F.col(h))) for h in HEADS}
    groups = written(spark, scored.select("host", "path", *[c.alias(h) for h, c in own.items()]).groupBy("host", "path").agg(F.count("*").alias("n"), *[F.sum(h).alias(h) for h in HEADS]), "groups")
    hosts = groups.groupBy("host").agg(F.sum("n").alias("n"), *[F.sum(h).alias(h) for h in HEADS])
    host_level, path_level = _moments(hosts, "n"), _moments(groups, "n")
    above = hosts.select(F.col("host").alias("of_host"), F.col("n").alias("host_n"), *[F.col(h).alias(f"host_{h}") for h in HEADS])
    site = groups.select(F.col("host").alias("h"), F.col("path").alias("p"), "n", *[F.col(h).alias(f"path_{h}") for h in HEADS]).join(above, F.col("h").eqNullSafe(F.col("of_host"))).drop("of_host")
    site = written(spark, site, "sites")
    out = scored.join(site, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")))
    probability = []
    for h in HEADS:
        (prior, host_weight), (_, path_weight) = host_level[h], path_level[h]
        # A document is no evidence on itself: its site's posterior is that of the site's other documents.
        host = (F.col(f"host_{h}") - own[h] + host_weight * prior) / (F.col("host_n") - 1 + host_weight)
        path = (F.col(f"path_{h}") - own[h] + path_weight * host) / (F.col("n") - 1 + path_weight)
        probability.append((1 / (1 + F.exp(-(F.col(h) + _log_odds(path) - _log_odds(F.lit(prior)))))).alias(f"p_{h}"))
    return out.select("doc_id", *probability).withColumn("keep", F.expr("p_quality >= 0.5 and p_toxic < 0.5"))


def op1_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality: the source is its host, the source's language its path."""
    docs = table(spark, sf_dir, "documents")
    return classified(spark, docs, table(spark, sf_dir, "labels"), F.col("source"), F.concat_ws("/", "source", "lang"))


ORACLE = None
