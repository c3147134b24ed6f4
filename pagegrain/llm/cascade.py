"""Operator 7, quality rules: a short-circuit cascade ordered by rejection per cost. Native."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, table, word_array, word_count

SYMBOLS = "#*$%&|<>"
#: Rows at most of the sample on which cost and selectivity are estimated, bytes of each, and files that are read for it: what
#: a task and the driver hold of it is bounded at every input size. The verdict doesn't depend on it.
SAMPLE_ROWS, SAMPLE_BYTES, SAMPLE_FILES = 200, 1 << 16, 4
#: Nanoseconds that a feature takes of a text of __pg_c characters and __pg_n words, in SQL: measured once over 1,500 documents on one core, so
#: that the order of the rules hangs on the sample and not on what else the machine does.
COST = {
    "n_words": "50D * __pg_c", "word_chars": "60D * __pg_c", "n_symbols": "60D * __pg_c", "n_capitals": "60D * __pg_c", "n_small": "60D * __pg_c", "n_lines": "8D * __pg_c", "n_dup_lines": "10D * __pg_c",
    "n_repeat_words": "400D * __pg_n + 75D * __pg_n * log2(__pg_n + 2D)",
}


class Rule(NamedTuple):
    name: str
    needs: tuple[str, ...]  # features that `rejects` reads
    rejects: str  # SQL


RULES = (
    Rule("few_words", ("n_words",), "n_words < 50"),
    Rule("word_length", ("n_words", "word_chars"), "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    Rule("symbols", ("n_words", "n_symbols"), "10 * n_symbols > n_words"),
    Rule("capitals", ("n_capitals", "n_small"), "n_capitals > n_small"),
    Rule("dup_lines", ("n_lines", "n_dup_lines"), "n_dup_lines >= 3 and 10 * n_dup_lines > 3 * n_lines"),
    Rule("repeat_words", ("n_words", "n_repeat_words"), "100 * n_repeat_words > 50 * n_words"),
)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _without(text: Column, chars: str) -> Column:
    return F.char_length(F.translate(text, chars, "")).cast("long")


def _with_feature(df: DataFrame, name: str, alive: Column | None) -> DataFrame:
    """df with feature `name` of column __pg_text; null where the row isn't alive."""
    if name in df.columns:
        return df
    text = F.col("__pg_text")
    of = (lambda x: x) if alive is None else (lambda x: F.when(alive, x))
    if name == "n_words":
        return df.withColumn(name, of(word_count(text)))
    if name == "word_chars":
        return df.withColumn(name, of(_without(text, BLANKS)))
    if name in ("n_symbols", "n_capitals", "n_small"):
        chars = {"n_symbols": SYMBOLS, "n_capitals": _UPPER, "n_small": _LOWER}[name]
        return df.withColumn(name, of(F.char_length(text).cast("long") - _without(text, chars)))
    if name in ("n_lines", "n_dup_lines"):
        if "__pg_lines" not in df.columns:
            lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(BLANKS)) != "")
            df = df.withColumn("__pg_lines", of(lines))
        n = F.size("__pg_lines").cast("long")
        return df.withColumn(name, of(n if name == "n_lines" else n - F.size(F.array_distinct("__pg_lines"))))
    if name == "n_repeat_words":
        return _with_repeats(df, of)
    raise KeyError(name)


def _with_repeats(df: DataFrame, of) -> DataFrame:
    """Words in three-word windows that come twice or more. Windows are compared as 64-bit hashes, in
    order of hash: equal neighbours are repeats, so a text of n words costs n log n."""
    df = df.withColumn("__pg_w", of(word_array(F.col("__pg_text"))))
    df = df.withColumn(
        "__pg_h", F.expr("if(size(__pg_w) < 4, null, transform(sequence(0, size(__pg_w) - 3), i -> xxhash64(__pg_w[i], __pg_w[i + 1], __pg_w[i + 2])))")
    ).drop("__pg_w")
    df = df.withColumn("__pg_s", F.sort_array("__pg_h"))
    df = df.withColumn("__pg_d", F.expr("array_distinct(filter(__pg_s, (x, i) -> x = get(__pg_s, i + 1)))")).drop("__pg_s")
    few = "filter(sequence(0, size(__pg_h) - 1), i -> array_contains(__pg_d, __pg_h[i]))"
    by_hash = "sort_array(transform(__pg_h, (x, i) -> named_struct('x', x, 'i', i)))"
    many = f"transform(array({by_hash}), z -> transform(filter(z, (e, k) -> e.x = get(z, k - 1).x or e.x = get(z, k + 1).x), e -> e.i))[0]"
    df = df.withColumn("__pg_p", F.expr(f"case when coalesce(size(__pg_d), 0) <= 0 then array() when size(__pg_d) <= 48 then {few} else {many} end")).drop("__pg_h", "__pg_d")
    covered = F.expr("cast(size(array_distinct(flatten(transform(__pg_p, i -> array(i, i + 1, i + 2))))) as bigint)")
    return df.withColumn("n_repeat_words", of(covered)).drop("__pg_p")


def arranged(rules: Sequence[Rule], seen: dict[tuple[bool, ...], int], cost: dict[str, float]) -> list[Rule]:
    """The rules by rejection per cost, each against the rows that the ones before it leave: seen has how many
    rows get which verdicts (True: rejected), in the order of rules. A feature that is there already costs
    nothing. Rules that reject none of what is left come last, cheapest first; ties keep the given order."""
    left, there, out = dict(seen), set(), []
    while len(out) < len(rules):
        best, key = None, None
        for i, rule in enumerate(rules):
            if rule in out:
                continue
            hits = sum(n for verdicts, n in left.items() if verdicts[i])
            price = sum(cost[f] for f in rule.needs if f not in there) + 1e-9
            mine = (-hits / price, price if not hits else 0.0, i)
            if key is None or mine < key:
                best, key = i, mine
        out.append(rules[best])
        there |= set(rules[best].needs)
        left = {v: n for v, n in left.items() if not v[best]}
    return out


def sampled(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About `rows` texts (__pg_text) of SAMPLE_BYTES at most: of a table's files SAMPLE_FILES, by the hash of their names, and of those the rows whose
    place's hash is in one of as many classes as leave so many, so that the same table gives the same sample, without a shuffle. Of a frame that isn't a plain
    table, its first rows."""
    text = F.coalesce(docs["text"], F.lit("")).alias("__pg_text")
    files = sorted({f.rpartition("/")[2] for f in docs.inputFiles()}, key=lambda f: hashlib.md5(f.encode()).digest())[:SAMPLE_FILES]
    try:
        own = docs.where(F.col("_metadata.file_name").isin(files))  # Spark skips the other files
        picked = F.pmod(F.xxhash64("_metadata.file_name", "_metadata.row_index"), F.lit(max(1, own.count() // rows))) == 0
        found = own.where(picked).select(text)
    except AnalysisException:
        found = docs.select(text).limit(rows)
    return found.where(F.octet_length("__pg_text") <= SAMPLE_BYTES)


def _measured(sample: DataFrame) -> DataFrame:
    return sample.withColumn("__pg_c", F.char_length("__pg_text")).withColumn("__pg_n", word_count(F.col("__pg_text")))


def _prices(features: Sequence[str]) -> dict[str, Column]:
    return {f: F.expr(COST[f]) for f in features}


def costs(sample: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """The cost of each feature over a sample (__pg_text), in nanoseconds."""
    return _measured(sample).agg(*[F.sum(c).alias(f) for f, c in _prices(features).items()]).first().asDict()


def ordered(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules, most rejection per cost first: what each rejects, and what its features cost, on sampled(docs). One job, whose rows are a few
    verdicts; the same rows in the same files give the same order. An empty sample keeps the given order."""
    features = list(dict.fromkeys(f for rule in rules for f in rule.needs))
    df = _measured(sampled(docs, sample_rows))
    for f in features:
        df = _with_feature(df, f, None)
    verdicts = [F.coalesce(F.expr(rule.rejects), F.lit(False)).alias(f"r{i}") for i, rule in enumerate(rules)]
    sums = [F.sum(c).alias(f) for f, c in _prices(features).items()]
    names = [f"r{i}" for i in range(len(rules))]
    got = df.select(*verdicts, "__pg_c", "__pg_n").groupBy(*names).agg(F.count("*").alias("n"), *sums).collect()
    if not got:
        return list(rules)
    return arranged(rules, {tuple(r[n] for n in names): r["n"] for r in got}, {f: sum(r[f] for r in got) for f in features})


def cascade(docs: DataFrame, order: Sequence[Rule], always: Sequence[str] = ()) -> DataFrame:
    """docs' own columns under struct __pg_row, the features of `always` for every row, and `kept`.

    A rule's features are worked out only for rows that no earlier rule rejected. The verdict is the
    same in any order. A null text counts as empty.
    """
    df = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__pg_row"), F.coalesce(docs["text"], F.lit("")).alias("__pg_text"))
    for f in always:
        df = _with_feature(df, f, None)
    df = df.withColumn("kept", F.lit(True))
    for rule in order:
        for f in rule.needs:
            df = _with_feature(df, f, F.col("kept"))
        df = df.withColumn("kept", F.col("kept") & ~F.coalesce(F.expr(rule.rejects), F.lit(False)))
    # Not deterministic to the optimizer: a filter on `kept` isn't pushed into the projections above.
    return df.select("__pg_row", *always, (F.col("kept") & (F.spark_partition_id() >= 0)).alias("kept"))


def filtered(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows that no rule rejects, with all columns of docs. Nulls and empty texts go (too few
    words); repeated rows share their verdict; an empty table stays empty."""
    return cascade(docs, ordered(docs, rules)).where("kept").select("__pg_row.*")


def op7_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, the base counts, base_failed and kept."""
    docs = table(spark, sf_dir, "documents")
    out = cascade(docs.select("doc_id", "text"), ordered(docs), BASE)
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words").alias("base_failed")
    return out.select("__pg_row.doc_id", *BASE, failed, "kept")


ORACLE = r"""
with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
l as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
w as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as i from d),
t as (select doc_id, i, word, lead(word) over p as w2, lead(word, 2) over p as w3 from w window p as (partition by doc_id order by i)),
c as (select doc_id, i, count(*) over (partition by doc_id, word, w2, w3) as n from t where w3 is not null),
r as (select doc_id, count(distinct i + o) as n_repeat_words from c, (values (0), (1), (2)) as v(o) where n >= 2 group by doc_id),
f as (select d.doc_id, len(words)::bigint as n_words,
  length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
  (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::bigint as n_capitals,
  (length(text) - length(regexp_replace(text, '[a-z]', '', 'g')))::bigint as n_small,
  len(lines)::bigint as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
  coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from d join l using (doc_id) left join r using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
  not (n_words < 50 or word_chars < 2 * n_words or word_chars > 15 * n_words or 10 * n_symbols > n_words
    or n_capitals > n_small or (n_dup_lines >= 3 and 10 * n_dup_lines > 3 * n_lines) or 100 * n_repeat_words > 50 * n_words) as kept
from f
"""
