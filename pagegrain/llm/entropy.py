"""Operator 9, LM scoring: cross-entropy difference of a target and a background model.

Both are interpolated word bigram models over the corpus's own vocabulary, counted over every word of
every document: the background over all, the target over those labelled as good. A token's loss leaves
out its own count, so that a document isn't scored by itself. Words and pairs are counted exactly, as
64-bit hashes, in tables that grow with the corpus: documents are dealt to chunks of bounded size, each
chunk counts its own, buckets of the key range add the chunks' counts up, and each chunk gets the
corpus's counts of its own words and pairs back, in the order in which it gave them. Many chunks and buckets
meet in levels: groups of chunks merge their counts of a range before they cut it into finer ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import grams
from .common import discard, release, small_batches, table, written

PAIR_SHARE, SMOOTHING = 0.6, 0.5
#: Bytes of text in a chunk, and for each bucket of keys; a text that a chunk begins with may be longer.
CHUNK, BUCKET = 8 << 20, 16 << 20
#: Ranges of keys into which a chunk's counts are cut, and chunks whose counts are merged, at a time: with more buckets than that, counts go to
#: them in levels, so that rows grow with the input times the levels, not with its square.
FAN = 512


def _keys(w: grams.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word its key (even), the key of its pair with the word before (odd), and whether it has one."""
    one = np.uint64(1)
    word, pair, has = w.hash & ~one, np.ones(len(w.hash), np.uint64), np.zeros(len(w.hash), bool)
    if len(word) > 1:
        pair[1:] = grams.mix(w.hash[:-1] * np.uint64(0xD6E8FEB86659FD93) + w.hash[1:]) | one
        has[1:] = w.doc[1:] == w.doc[:-1]
    return word, pair, has


class _Counted(NamedTuple):
    doc: np.ndarray  # of each word: its row
    target: np.ndarray
    has: np.ndarray
    key: np.ndarray  # distinct keys of words and pairs in order
    counts: tuple[np.ndarray, np.ndarray]  # of each key: the target's and all occurrences
    word: np.ndarray  # of each word: the place of its key
    pair: np.ndarray  # of each word with has: the place of its pair's key
    words: np.ndarray  # of each row: its words


def _counted(texts: pa.ChunkedArray, target: pa.ChunkedArray) -> _Counted:
    w = grams.words(texts)
    word, pair, has = _keys(w)
    on = target.to_numpy(zero_copy_only=False).astype(bool)[w.doc] if len(w.doc) else has
    key, place, total = np.unique(np.concatenate((word, pair[has])), return_inverse=True, return_counts=True)
    good = np.bincount(place[np.concatenate((on, on[has]))], minlength=len(key))
    return _Counted(w.doc, on, has, key, (good, total), place[: len(word)], place[len(word) :], w.count)


def _packed(x: np.ndarray) -> bytes:
    """Numbers as planes of bytes, the lowest first, without the planes that are all zero: what compresses well."""
    planes = np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8).T
    return planes[: max(1, (int(x.max()).bit_length() + 7) // 8)].tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.zeros((n, 8), np.uint8)
    planes[:, : len(data) // n] = np.frombuffer(data, np.uint8).reshape(-1, n).T
    return planes.view("<u8").reshape(-1)


def _dealer(size: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done, rows = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = done + np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
            chunk = (part << 32) + np.concatenate(([done], ends[:-1])) // size
            at = rows + np.arange(batch.num_rows)
            done, rows = int(ends[-1]), rows + batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chunk), pa.array(at)], names=[*batch.schema.names, "chunk", "at"])

    return deal


REQUEST = "chunk bigint, at bigint, bucket bigint, n bigint, keys binary, target binary, background binary"


def _counter(buckets: int):
    #: Where each bucket's keys begin.
    begins = np.array([(b << 64) // buckets for b in range(buckets)], np.uint64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each bucket of each run of a chunk's rows, named by the run's first row; a chunk that two
        tasks read has more runs than one."""

        def rows(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            run = pa.Table.from_batches(held)
            c = _counted(run.column("text"), run.column("target"))
            cuts = np.append(np.searchsorted(c.key, begins), len(c.key))
            for b in np.flatnonzero(cuts[1:] > cuts[:-1]):
                part = slice(cuts[b], cuts[b + 1])
                row = [run.column("chunk")[0].as_py(), run.column("at")[0].as_py(), int(b), int(cuts[b + 1] - cuts[b]), _packed(np.diff(c.key[part], prepend=np.uint64(0))), _packed(c.counts[0][part]), _packed(c.counts[1][part])]
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["chunk", "at", "bucket", "n", "keys", "target", "background"])

        last, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            chunk, at = (batch.column(c).to_numpy() for c in ("chunk", "at"))
            new = np.concatenate(([(chunk[0], at[0] - 1) != last], (chunk[1:] != chunk[:-1]) | (at[1:] != at[:-1] + 1)))
            edges = sorted({0, *np.flatnonzero(new).tolist(), batch.num_rows})
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if new[lo] and held:
                    yield from rows(held)
                    held = []
                held.append(batch.slice(lo, hi - lo))
            last = (chunk[-1], at[-1])
        if held:
            yield from rows(held)

    return count


ANSWER = "chunk bigint, at bigint, bucket bigint, n bigint, target binary, background binary, types bigint, target_tokens bigint, tokens bigint"


def _add_up(requests: pa.Table) -> pa.Table:
    """The corpus's counts of each request's keys, in its order; the first row also holds the bucket's distinct
    words and their occurrences."""
    sizes = requests.column("n").to_numpy()
    of = lambda name: [_unpacked(x.as_py(), n) for x, n in zip(requests.column(name), sizes, strict=True)]
    key, place = np.unique(np.concatenate([np.cumsum(x, dtype=np.uint64) for x in of("keys")]), return_inverse=True)
    totals = [np.bincount(place, np.concatenate(of(name)), minlength=len(key)).astype(np.int64) for name in ("target", "background")]
    ends = np.cumsum(sizes)[:-1]
    out = [[_packed(x) for x in np.split(t[place], ends)] for t in totals]
    word = key % np.uint64(2) == 0
    first = np.zeros((3, len(sizes)), np.int64)
    first[:, 0] = word.sum(), totals[0][word].sum(), totals[1][word].sum()
    return pa.Table.from_arrays([*(requests.column(c) for c in ("chunk", "at", "bucket", "n")), *(pa.array(x, pa.binary()) for x in out), *(pa.array(x) for x in first)], names=[x.split()[0] for x in ANSWER.split(", ")])


def _keys_of(requests: pa.Table) -> list[np.ndarray]:
    return [np.cumsum(_unpacked(x.as_py(), n), dtype=np.uint64) for x, n in zip(requests.column("keys"), requests.column("n").to_numpy(), strict=True)]


def _merger(finer: int, groups: int):
    #: Where each finer range's keys begin.
    begins = np.array([(b << 64) // finer for b in range(finer)], np.uint64)

    def merge(requests: pa.Table) -> pa.Table:
        """The counts of one range by one group of chunks, as requests of one chunk for finer ranges."""
        sizes = requests.column("n").to_numpy()
        key, place = np.unique(np.concatenate(_keys_of(requests)), return_inverse=True)
        totals = [np.bincount(place, np.concatenate([_unpacked(x.as_py(), n) for x, n in zip(requests.column(c), sizes, strict=True)]), minlength=len(key)).astype(np.int64) for c in ("target", "background")]
        chunk = requests.column("bucket")[0].as_py() * groups + requests.column("grp")[0].as_py()
        cuts = np.append(np.searchsorted(key, begins), len(key))
        rows = [(chunk, 0, int(b), int(cuts[b + 1] - cuts[b]), _packed(np.diff(key[cuts[b] : cuts[b + 1]], prepend=np.uint64(0))), *(_packed(t[cuts[b] : cuts[b + 1]]) for t in totals)) for b in np.flatnonzero(cuts[1:] > cuts[:-1])]
        kinds = [pa.int64()] * 4 + [pa.binary()] * 3
        return pa.Table.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in REQUEST.split(", ")])

    return merge


def _spread(requests: pa.Table, answers: pa.Table) -> pa.Table:
    """The corpus's counts of each of a group's requests, from those of the keys that the group has merged."""
    answers = answers.sort_by("bucket")
    keys = _keys_of(requests)
    merged = np.unique(np.concatenate(keys))
    out = []
    for c in ("target", "background"):
        total = np.concatenate([_unpacked(x.as_py(), n) for x, n in zip(answers.column(c), answers.column("n").to_numpy(), strict=True)])
        if len(total) != len(merged):
            raise ValueError(f"{len(total)} counts for {len(merged)} words and pairs")
        out.append(pa.array([_packed(total[np.searchsorted(merged, k)]) for k in keys], pa.binary()))
    return pa.Table.from_arrays([*(requests.column(c) for c in ("chunk", "at", "bucket", "n")), *out], names=["chunk", "at", "bucket", "n", "target", "background"])


def _answered(spark: SparkSession, requests: DataFrame, ranges: int, buckets: int, chunks: int) -> tuple[DataFrame, tuple[int, ...]]:
    """(answers, (distinct words, the target's words, all words)) to requests whose keys are cut into `ranges`, about `chunks` of them each."""
    if ranges >= buckets:
        answers = written(spark, requests.groupBy("bucket").applyInArrow(_add_up, ANSWER), "counts")
        release(spark)
        sums = tuple(x or 0 for x in answers.agg(F.sum("types"), F.sum("target_tokens"), F.sum("tokens")).first())
        return answers.drop("types", "target_tokens", "tokens"), sums
    groups = chunks // FAN + 1
    finer = ranges * min(FAN, -(-buckets // ranges))
    rows = written(spark, requests.withColumn("grp", F.expr(f"pmod(xxhash64(chunk), {groups})")), "requests")
    release(spark)
    merged = rows.groupBy("bucket", "grp").applyInArrow(_merger(finer, groups), REQUEST)
    answers, sums = _answered(spark, merged, finer, buckets, groups)
    answers = answers.withColumn("up", F.expr(f"chunk div {groups}")).withColumn("grp", F.expr(f"chunk % {groups}"))
    out = rows.groupBy("bucket", "grp").cogroup(answers.groupBy("up", "grp")).applyInArrow(_spread, "chunk bigint, at bigint, bucket bigint, n bigint, target binary, background binary")
    out = written(spark, out, "spread")
    release(spark)
    discard(spark, rows, answers)
    return out, sums


def _loss(words: np.ndarray, pairs: np.ndarray, before: np.ndarray, has: np.ndarray, own: np.ndarray, tokens: int, types: int) -> np.ndarray:
    """-log2 of each word's probability under one model, its own occurrence (`own`: 1 or 0) left out, by
    the counts of each word, of its pair and of the word before."""
    total = max(tokens - 1.0, 1.0)
    p = (np.maximum(words - own, 0) + SMOOTHING) / (total + SMOOTHING * types)
    history = np.maximum(before - own, 0)
    seen = has & (history > 0)
    ratio = np.maximum(pairs - own, 0) / np.maximum(history, 1)
    return -np.log2(np.where(seen, PAIR_SHARE * ratio + (1 - PAIR_SHARE) * p, p))


def _scorer(tokens: tuple[int, int], types: int):
    def score(rows: pa.Table, answers: pa.Table) -> pa.Table:
        rows, answers = rows.sort_by("at"), answers.sort_by([("at", "ascending"), ("bucket", "ascending")])
        at, run, sizes = rows.column("at").to_numpy(), answers.column("at").to_numpy(), answers.column("n").to_numpy()
        starts = np.unique(run)  # a run without words has no answer: it goes with the run before
        edges = np.unique(np.concatenate(([0], np.searchsorted(at, starts), [len(at)])))
        out = []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            part = rows.slice(lo, hi - lo)
            c = _counted(part.column("text"), part.column("target"))
            mine = np.flatnonzero(run == at[lo])
            mean = []
            for k, (name, own) in enumerate((("target", c.target.astype(np.int64)), ("background", 1))):
                parts = [_unpacked(answers.column(name)[int(i)].as_py(), sizes[i]) for i in mine]
                total = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
                if len(total) != len(c.key):
                    raise ValueError(f"{len(total)} counts for {len(c.key)} words and pairs")
                words, pairs = total[c.word], np.zeros(len(c.word), np.int64)
                pairs[c.has] = total[c.pair]
                loss = _loss(words, pairs, np.concatenate((words[:1], words[:-1])), c.has, own, tokens[k], types)
                mean.append(pa.array(np.bincount(c.doc, loss, minlength=hi - lo)[: hi - lo] / np.maximum(c.words, 1), mask=c.words == 0))
            out.append(pa.Table.from_arrays([part.column("doc_id"), pa.array(c.words.astype(np.int64)), *mean], names=["doc_id", "n_tokens", "ce_target", "ce_background"]))
        return pa.concat_tables(out)

    return score


def scored(spark: SparkSession, docs: DataFrame, good: DataFrame, chunk: int = CHUNK, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, n_tokens, ce_target, ce_background, ce_diff) of every row of docs (doc_id, text): mean loss in bits a
    word, A-Z folded, under the models of the documents in good (doc_id) and of all; ce_diff is their
    difference, lower the more like the target. Texts without words have null scores; repeated rows count and
    are scored each; without good documents the target model is uniform; an empty table gives no rows.
    Two rows of one text and doc_id get one score each, the same; other columns are ignored.
    """
    ids = good.where("doc_id is not null").selectExpr("doc_id good_id").distinct()
    flagged = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(ids.hint("merge"), F.col("doc_id") == F.col("good_id"), "left").select("doc_id", "text", F.col("good_id").isNotNull().alias("target"))
    with small_batches(spark):
        dealt = written(spark, flagged.mapInArrow(_dealer(chunk), "doc_id bigint, text string, target boolean, chunk bigint, at bigint"), "dealt")
        release(spark)
        size = dealt.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = size // bucket + 1
        requests = dealt.mapInArrow(_counter(min(buckets, FAN)), REQUEST)
        answers, (types, *tokens) = _answered(spark, requests, min(buckets, FAN), buckets, size // chunk + 1)
        scores = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_scorer(tuple(tokens), types), "doc_id bigint, n_tokens bigint, ce_target double, ce_background double")
        out = written(spark, scores, "scores")
        release(spark)
    return out.withColumn("ce_diff", F.expr("ce_target - ce_background"))


def op9_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against the documents labelled as of good quality and not toxic."""
    labels = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    return scored(spark, table(spark, sf_dir, "documents"), labels.select("doc_id"))


ORACLE = None
