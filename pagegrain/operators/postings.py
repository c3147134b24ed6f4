"""Search over a postings table that is written once and read by bucket.

An index is two tables. `postings` has a row for each distinct word of an entry's body or title (word, entry, n, first, opens, field), in
folders by the word's hash, sorted. `words` has a row for each word and each end of it (its letters from the k-th on), in folders by that
end's first letters: a term, which may stand anywhere inside words, begins some end of each word that holds it. A query looks its terms'
words up in one folder a term, reads the folders of those words, and nothing else; texts are read for the hits' snippets alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import own_path, removed

BUCKETS, END_BUCKETS = 64, 64
#: Rows that a task writes; entries of the rarest term that are broadcast to the others at most; words of a term that are.
TASK_ROWS, FEW_ENTRIES, FEW_WORDS = 500_000, 500_000, 200_000
#: What a query scores, and the length of a snippet.
IN_TITLE, MOST_TIMES, OPENING, BEST, SNIPPET = 8, 12, 2, 24, 220
TERM = r"[\p{L}\p{N}]+"


class Index(NamedTuple):
    """Where an index lies, and the type of its entries' keys."""

    path: str
    kind: str = "bigint"

    def postings(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"word string, entry {self.kind}, field string, n bigint, first bigint, opens boolean, bucket int").parquet(f"{self.path}/postings")

    def words(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("end string, word string, df bigint, n bigint, times bigint, bucket int").parquet(f"{self.path}/words")


def tokens(text: Column) -> Column:
    """Words of a text, small letters: runs of letters and numbers."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def terms_of(query: str) -> list[str]:
    """Distinct words of a query, those of one character left out, in order."""
    import regex

    return list(dict.fromkeys(t for t in regex.findall(TERM, query.lower()) if len(t) > 1))


def _bucket(word: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(n)).cast("int")


def _end_bucket(end: Column) -> Column:
    """Of an end, by its first two letters; ends of one letter are found by no term and aren't kept."""
    return _bucket(F.left(end, F.lit(2)), END_BUCKETS)


def _stored(spark: SparkSession, df: DataFrame, path: str, *order: str, **made: Column) -> None:
    """df in folders by bucket, sorted; a bucket with a word of many entries is written by several tasks. df is worked out once, and sorted within its
    own tasks already: rows of one word side by side take less room in what is shuffled. made: columns that are worked out of others (and of `at`, which goes) when
    the rows lie in their places."""
    (df if made else df.sortWithinPartitions("bucket", *order)).write.option("compression", "zstd").parquet(f"{path}-raw")
    raw = spark.read.parquet(f"{path}-raw")
    cut = raw.repartitionByRange(int(min(100_000, raw.count() // TASK_ROWS + 1)), "bucket", *[made.get(c, F.col(c)) for c in order])
    cut = cut.withColumns(made).drop("at").sortWithinPartitions("bucket", *order)
    cut.write.partitionBy("bucket").option("compression", "zstd").parquet(path)
    removed(spark, f"{path}-raw")


def build(spark: SparkSession, entries: DataFrame, key: str, body: str, title: str, path: str | None = None) -> Index:
    """The index of entries, a row each. Null bodies and titles have no words; keys tell entries apart, and rows of one key count as one
    entry, which has the words of both. An empty table gives an empty index."""
    index = Index(path or own_path(spark, "postings"), entries.schema[key].dataType.simpleString())
    # Texts are dealt out by key, so that words meet within a task: a text is far smaller than its postings.
    field = lambda c, name: F.struct(F.lit(name).alias("field"), F.lower(F.col(c)).alias("t"))
    each = entries.select(F.col(key).alias("entry"), body, title).repartition("entry").select("entry", F.explode(F.array(field(body, "body"), field(title, "title"))).alias("f"))
    each = each.select("entry", "f.field", "f.t", F.posexplode(F.regexp_extract_all("f.t", F.lit(TERM), F.lit(0))).alias("first", "word"))
    each = each.withColumn("opens", (F.col("first") == 0) & F.col("t").startswith(F.col("word")))
    found = each.groupBy("word", "entry", "field").agg(F.count("*").alias("n"), F.min("first").cast("long").alias("first"), F.bool_or("opens").alias("opens"))
    _stored(spark, found.withColumn("bucket", _bucket(F.col("word"), BUCKETS)), f"{index.path}/postings", "word", "entry", "field")
    spread = index.postings(spark).groupBy("word").agg(F.count("*").alias("df"), F.sum("n").alias("n"))
    # A word's ends differ in length, so that each is there once; until they lie in their places they are numbers.
    ends = spread.where("char_length(word) > 1").select("*", F.explode(F.sequence(F.lit(1), F.char_length("word") - 1)).alias("at"))
    end = F.substr(F.col("word"), F.col("at"))
    _stored(spark, ends.withColumn("bucket", _end_bucket(end)), f"{index.path}/words", "end", "word", end=end, times=F.lit(1).cast("long"))
    return index


def words_of(spark: SparkSession, index: Index, terms: Sequence[str]) -> DataFrame:
    """(term, word, df, times, opens_word) of terms of two letters and more: words that hold the term, how often without overlap, and whether
    they begin with it. One folder a term is read, and in it the rows from the term on."""
    found = None
    for t in terms:
        bucket = int(spark.range(1).select(_end_bucket(F.lit(t))).first()[0])
        rows = index.words(spark).where((F.col("bucket") == bucket) & (F.col("end") >= t) & F.col("end").startswith(t))
        times = (F.char_length("word") - F.char_length(F.replace("word", F.lit(t), F.lit("")))) / F.char_length(F.lit(t))
        rows = rows.groupBy("word").agg(F.min("df").alias("df")).select(F.lit(t).alias("term"), "word", "df", times.cast("long").alias("times"), F.startswith("word", F.lit(t)).alias("opens_word"))
        found = rows if found is None else found.unionByName(rows)
    return found


def matched(spark: SparkSession, index: Index, terms: Sequence[str]) -> DataFrame:
    """(entry, term, n, opens, in_title) of all entries that hold a term in body or title. Only the folders of the terms' words are read, and entries
    that lack the rarest term go before the others meet."""
    words = words_of(spark, index, terms)
    folders = {r.term: (sorted(r.buckets), r.n, r.df) for r in words.groupBy("term").agg(F.collect_set(_bucket(F.col("word"), BUCKETS)).alias("buckets"), F.count("*").alias("n"), F.sum("df").alias("df")).collect()}
    if len(folders) < len(terms):  # some term stands nowhere
        return index.postings(spark).limit(0).select("entry", F.lit("").alias("term"), "n", "opens", F.lit(False).alias("in_title"))
    out, rare = None, None
    for t in sorted(terms, key=lambda t: (folders[t][2], t)):
        buckets, n, df = folders[t]
        mine = words.where(F.col("term") == t).drop("df")
        rows = index.postings(spark).where(F.col("bucket").isin(buckets)).join(F.broadcast(mine) if n <= FEW_WORDS else mine.hint("merge"), "word")
        if rare is not None:
            rows = rows.join(rare, "entry", "left_semi")
        of_body = F.col("field") == "body"
        rows = rows.groupBy("entry", "term").agg(
            F.coalesce(F.sum(F.when(of_body, F.col("n") * F.col("times"))), F.lit(0)).alias("n"), F.bool_or(of_body & F.col("opens") & F.col("opens_word")).alias("opens"), F.bool_or(~of_body).alias("in_title"))
        if rare is None:
            rare = F.broadcast(rows.select("entry")) if df <= FEW_ENTRIES else rows.select("entry").hint("merge")
        out = rows if out is None else out.unionByName(rows)
    return out


def search(spark: SparkSession, index: Index, query: str, scope: DataFrame | None = None, best: int = BEST) -> DataFrame:
    """(entry, score) of the best entries that hold every word of query, in body or title: for each word IN_TITLE if the title has it, the times that the
    body has it, MOST_TIMES at most, and OPENING if the body begins with it. Ties go to the smaller key. scope (entry): only those. A query
    without words finds nothing."""
    terms = terms_of(query)
    if not terms:
        return index.postings(spark).limit(0).select("entry", F.lit(0).cast("long").alias("score"))
    rows = matched(spark, index, terms)
    if scope is not None:
        rows = rows.join(scope.select("entry").distinct(), "entry", "left_semi")
    score = F.least("n", F.lit(MOST_TIMES)) + F.when(F.col("opens"), OPENING).otherwise(0) + F.when(F.col("in_title"), IN_TITLE).otherwise(0)
    every = rows.groupBy("entry").agg(F.sum(score).alias("score"), F.count("*").alias("k")).where(F.col("k") == len(terms))
    return every.select("entry", F.col("score").cast("long").alias("score")).orderBy(F.desc("score"), "entry").limit(best)


def snippet(text: Column, term: str) -> Column:
    """SNIPPET characters of text around the first place of term, a third of them before it, trimmed, with dots where it is cut."""
    at = F.locate(term, F.lower(text)) - 1
    start = F.when(at < 0, 0).otherwise(F.greatest(F.lit(0), at - SNIPPET // 3))
    cut = F.concat(F.substring(text, start + 1, F.lit(SNIPPET)), F.when((at >= 0) & (start + SNIPPET < F.char_length(text)), "…").otherwise(""))
    trimmed = F.regexp_replace(cut, r"\A\s+|\s+\z", "")
    return F.when(start > 0, F.concat(F.lit("…"), trimmed)).otherwise(trimmed)


def hits(spark: SparkSession, index: Index, entries: DataFrame, key: str, body: str, title: str, query: str, best: int = BEST) -> DataFrame:
    """(key, title, score, snippet) of search(), in order of score, then title. The few hits are broadcast to the entries."""
    terms = terms_of(query)
    found = search(spark, index, query, best=best)
    rows = entries.join(F.broadcast(found), F.col(key) == F.col("entry"))
    return rows.select(key, F.col(title).alias("title"), "score", snippet(F.col(body), terms[0] if terms else "").alias("snippet")).orderBy(F.desc("score"), "title", key)
