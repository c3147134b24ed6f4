"""Operator 12, target-distribution importance resampling over hashed word n-grams.

Features are runs of one and two words, hashed into BUCKETS buckets. One pass counts the buckets of the documents and of the
target; each bucket's gain is the log ratio of its smoothed shares. A second pass scores a document from the array of gains. Scores
are integers, so that a histogram of them is exact and small: its counts summed from the top give each score the rank where it begins,
and the score at which the draw ends. Rows of surviving scores alone are numbered, by doc_id within their score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import grams
from .common import release, small_batches, table, written
from .sharding import CRC_TABLE, crc_sql

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
#: Words of more bytes take zlib's own loop; copies of a row that one task makes.
LONG, COPIES = 48, 4096


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


CRC, FULL = _crc_table(), 0xFFFFFFFF


def _fed(state: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC states after each word of data: its `size` bytes from `start`. Words of most bytes come first, so that a step is a slice."""
    order = np.argsort(-size, kind="stable")
    out, at, left = state[order], start[order], size[order]
    long = int(np.searchsorted(-left, -LONG, "left"))
    for i in range(long):
        out[i] = zlib.crc32(data[at[i] : at[i] + left[i]].tobytes(), int(out[i]) ^ FULL) ^ FULL
    ends = long + np.searchsorted(-left[long:], -np.arange(int(left[long]) if long < len(left) else 0), "left")
    for j, n in enumerate(ends):  # the words with more than j bytes
        out[long:n] = CRC[(out[long:n] ^ data[at[long:n] + j]) & 255] ^ (out[long:n] >> 8)
    back = np.empty_like(out)
    back[order] = out
    return back


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of a column of texts, in blocks that end between words: each word's text and CRC-32, and each pair's: of a word and the one after it
    in the text, joined by one space. Words are runs of digits, letters and anything beyond ASCII, A-Z folded."""
    data, at = grams.buffers(column)
    lo, n, last_doc, last_state = 0, len(data), -1, 0
    while lo < n:
        hi = min(n, lo + grams.BLOCK)
        if hi < n:
            back = np.flatnonzero(grams.NOT_ALNUM[data[lo:hi]])
            if len(back):
                hi = lo + int(back[-1]) + 1
            else:  # one word longer than a block
                while hi < n and not grams.NOT_ALNUM[data[hi]]:
                    hi += 1
        b = grams.FOLD[data[lo:hi]]
        gap, edge = grams.NOT_ALNUM[b], np.zeros(len(b) + 1, bool)
        edge[0] = edge[-1] = True
        edge[at[(at >= lo) & (at < hi)] - lo] = True
        start = np.flatnonzero(~gap & (edge[:-1] | np.concatenate(([True], gap[:-1]))))
        size = np.flatnonzero(~gap & (edge[1:] | np.concatenate((gap[1:], [True])))) + 1 - start
        lo, doc = hi, np.searchsorted(at, start + lo, "right") - 1
        if not len(doc):
            continue
        state = _fed(np.full(len(doc), FULL, np.uint32), b, start, size)
        spaced = CRC[(state ^ np.uint32(32)) & 255] ^ (state >> 8)
        has = np.concatenate(([last_doc], doc[:-1])) == doc
        pair = _fed(np.concatenate(([np.uint32(last_state)], spaced[:-1]))[has], b, start[has], size[has])
        yield doc, ~state, doc[has], ~pair
        last_doc, last_state = doc[-1], spaced[-1]


def _counter(buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's counts: a row a bucket that has any."""
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, word, _, pair in features(batch.column("text")):
                n += np.bincount(np.concatenate((word, pair)) % buckets, minlength=buckets)
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(n[there])], names=["bucket", "n"])

    return count


def _weigher(gains):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = gains.value
        for batch in batches:
            n_words, n, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for doc, word, owner, pair in features(batch.column("text")):
                n_words += np.bincount(doc, minlength=batch.num_rows)
                both = np.concatenate((doc, owner))
                n += np.bincount(both, minlength=batch.num_rows)
                total += np.bincount(both, gain[np.concatenate((word, pair)) % len(gain)], batch.num_rows).astype(np.int64)
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("raw"), pa.array(n_words), pa.array(n), pa.array(weight)], names=["doc_id", "raw", "n_words", "n_features", "weight"])

    return weigh


def gains(spark: SparkSession, docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket; one job over all texts (text) of docs and of target, which sends up a row a bucket."""
    with small_batches(spark):
        counted = [x.select("text").mapInArrow(_counter(buckets), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")) for x in (docs, target)]
        both = counted[0].select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(counted[1].select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
        both = both.unionByName(spark.range(buckets).selectExpr("id bucket", "0L s", "0L t")).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
        whole = Window.partitionBy()  # over `buckets` rows
        every = both.select("bucket", "s", "t", F.sum("s").over(whole).alias("a"), F.sum("t").over(whole).alias("b"))
        rows = every.selectExpr("bucket", f"floor(1000D * ln((t + 1D) * (a + {buckets}D) / ((s + 1D) * (b + {buckets}D)))) gain").collect()
    out = np.zeros(buckets, np.int64)
    out[[r.bucket for r in rows]] = [r.gain for r in rows]
    return out


def scored(spark: SparkSession, docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, raw, n_words, n_features, weight, score) of every row of docs, written; raw is the text's hash."""
    gain = spark.sparkContext.broadcast(gains(spark, docs, target, buckets))
    with small_batches(spark):
        schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, raw bigint, n_words bigint, n_features bigint, weight bigint"
        weights = docs.select("doc_id", F.xxhash64("text").alias("raw"), "text").mapInArrow(_weigher(gain), schema)
        h = f"cast(conv(substr(sha2(concat('{seed}:', coalesce(cast(doc_id as string), '')), 256), 1, 8), 16, 10) as double)"
        return written(spark, weights.withColumn("score", F.expr(f"weight + floor(-1000D * ln(-ln(({h} + 0.5D) / 4294967296D)))")), "scored")


def ranked(spark: SparkSession, docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """A row for each row of docs (doc_id, text), drawn by likeness to target (text): doc_id, raw, n_words, n_features, weight, score, rank:
    1, 2, 3 ... for the drawn ones, highest score first, ties by doc_id, null first, then by raw; null for the others.

    Of the rows with at least least_words words, percent in a hundred are drawn, rounded down. A null or empty text has no features and
    weight 0; a null id is an empty one to the hash; repeated rows tie and are drawn one by one; without target texts all weights come from
    the documents alone; an empty table gives no rows. Other columns are ignored.
    """
    rows = scored(spark, docs, target, buckets, seed)
    able = rows.where(f"n_words >= {least_words}")
    # Scores are whole numbers of some 100,000 values at most at any size: 1,000 times logarithms of counts and of a 32-bit draw.
    counts = able.groupBy("score").agg(F.count("*").alias("n"))
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    histogram = written(spark, counts.select("score", "n", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("above")), "histogram")
    draw = (histogram.agg(F.sum("n")).first()[0] or 0) * percent // 100
    surviving = histogram.where(f"above < {draw}")
    cutoff = surviving.agg(F.min("score")).first()[0]
    if cutoff is None:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    # Repeated rows are one row with a count until they are numbered, so that no number of copies meets in a task.
    same = able.where(f"score >= {cutoff}").groupBy("score", "doc_id", "raw", "n_words", "n_features", "weight").agg(F.count("*").alias("m"))
    ahead = Window.partitionBy("score").orderBy("doc_id", "raw").rowsBetween(Window.unboundedPreceding, -1)
    placed = same.withColumn("ahead", F.coalesce(F.sum("m").over(ahead), F.lit(0))).join(F.broadcast(surviving.select("score", "above")), "score")
    placed = written(spark, placed, "survivors")
    release(spark)
    parts = placed.select("*", F.explode(F.expr(f"sequence(0L, (m - 1) div {COPIES})")).alias("part"))
    if (placed.agg(F.max("m")).first()[0] or 0) > COPIES:
        parts = parts.repartition("score", "doc_id", "raw", "part")
    each = parts.select("*", F.explode(F.expr(f"sequence(part * {COPIES}, least(m, (part + 1) * {COPIES}) - 1)")).alias("copy")).withColumn("rank", F.expr("above + ahead + copy + 1"))
    drawn = each.select(*rows.columns, F.expr(f"if(rank <= {draw}, rank, null)").alias("rank"))
    return drawn.unionByName(rows.where(f"n_words < {least_words} or score < {cutoff}").withColumn("rank", F.lit(None).cast("long")))


def drawn(spark: SparkSession, docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of docs that are drawn, with all their columns. Rows of one id and text stay together: all go with the first of them."""
    took = ranked(spark, docs, target, percent, least_words).where("rank is not null").selectExpr("doc_id __pg_d", "raw __pg_r").distinct()
    keyed = docs.withColumn("__pg_raw", F.xxhash64("text"))
    return keyed.join(took.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__pg_d")) & (F.col("__pg_raw") == F.col("__pg_r")), "left_semi").drop("__pg_raw")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, drawn towards the benchmark's texts."""
    out = ranked(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_FEATURES = "unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f"
ORACLE = f"""
with k as (select {CRC_TABLE} as crc_table),
d as (select row_number() over () as rid, doc_id, {_WORDS} as w from documents),
x as (select rid, {_FEATURES} from d),
y as (select {_FEATURES} from (select {_WORDS} as w from benchmark)),
c as (select f, {crc_sql("f")} % 10000 as bucket from (select f from x union select f from y), k),
xs as (select rid, bucket from x join c using (f)),
s as (select bucket, count(*) as n from xs group by bucket),
t as (select bucket, count(*) as n from y join c using (f) group by bucket),
z as (select r.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * ((select count(*) from x) + 10000)::double / ((coalesce(s.n, 0) + 1)::double * ((select count(*) from y) + 10000)::double)))::bigint as gain
  from range(10000) r(bucket) left join s on s.bucket = r.bucket left join t on t.bucket = r.bucket),
m as (select rid, count(*) as n_features, floor(sum(gain)::double / count(*))::bigint as weight from xs join z using (bucket) group by rid),
e as (select d.rid, doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || coalesce(doc_id::varchar, ''))[:8])::bigint + 0.5::double) / 4294967296::double)))::bigint as score from d left join m using (rid)),
o as (select rid, row_number() over (order by score desc, doc_id nulls first) as rank from e where n_words >= 20)
select doc_id, n_features, weight, score, case when rank <= (25 * (select count(*) from o)) // 100 then rank end as rank from e left join o using (rid)
"""
