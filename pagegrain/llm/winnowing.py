"""Operator 10, benchmark decontamination: winnowed fingerprints, joined and extended. Native."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

WINDOW, GRAM = 13, 8
#: Bits of a fingerprint for its place: texts of up to 2^28 words. The rest, 36, only select candidates.
PLACE = 28
#: Fingerprints that one broadcast may hold: 16 bytes each. More go through a shuffled join.
BROADCAST_FINGERPRINTS = 1_000_000
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str) -> str:
    """SQL: words of a text, A-Z folded. Words are runs of digits, letters and anything beyond ASCII."""
    folded = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"filter(split({folded}, r'{GAP}'), w -> w <> '')"


def _prints(df: DataFrame, spans: list[int]) -> DataFrame:
    """df (w array<string>, ...) with `prints`, an array of (n, f) for each span: winnowed fingerprints, the least
    k-gram hash of every window of span - k + 1 k-grams, k = min(span, GRAM). Any shared run of `span` words picks
    a shared k-gram. A fingerprint is one long: the upper bits of the hash, and the k-gram's place in the
    lower PLACE bits, so that the least one carries its place. Texts of fewer than `span` words have none."""
    df = df.withColumn("__h", F.expr("transform(w, x -> xxhash64(x))"))
    names = []
    for k in sorted({min(n, GRAM) for n in spans}):
        gram = "xxhash64(" + ", ".join(f"__h[i + {j}]" for j in range(k)) + ")" if k > 1 else "__h[i]"
        df = df.withColumn(f"__g{k}", F.expr(f"if(size(w) < {k}, null, transform(sequence(0, size(w) - {k}), i -> (({gram}) & {-(1 << PLACE)}L) | i))"))
    for n in spans:
        k, v = min(n, GRAM), n - min(n, GRAM) + 1
        least = f"array_distinct(transform(sequence(1, size(__g{k}) - {v - 1}), i -> array_min(slice(__g{k}, i, {v}))))" if v > 1 else f"__g{k}"
        names.append(f"__f{n}")
        df = df.withColumn(names[-1], F.expr(f"if(size(w) < {n}, array(), transform({least}, f -> named_struct('n', {n}, 'f', f)))"))
    grams = [c for c in df.columns if c.startswith("__g")]
    return df.withColumn("prints", F.concat(*names) if names else F.expr("cast(array() as array<struct<n: int, f: bigint>>)")).drop("__h", *grams, *names)


def hits(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Of docs (doc_id, raw, w): counts (doc_id, raw, n_words), a row a row, and hits (doc_id, raw, first, words,
    item_ids): every place that equals a window of items (item_id, w), with the items that have that window,
    null ids left out. Repeated rows of docs count once in hits.

    Items are in groups of equal window length (`window`, or the whole item if it has fewer words). One pass over
    docs hashes each word once and winnows its k-grams for each of those lengths; a row's fingerprints, tagged with
    their length, and a mark that carries its number of words, are exploded together and meet the items'
    fingerprints. A hit is extended to all windows around it, and these are compared word by word with the
    items' windows. explode_outer, as plain explode makes the optimizer push a filter on the array into the
    projections that build it, where lambdas would work out whole arrays anew for each element.
    """
    spans = [r[0] for r in items.where("size(w) > 0").select(F.expr(f"least(size(w), {window})").alias("n")).distinct().orderBy("n").collect()]
    items = items.where("size(w) > 0").withColumn("n", F.expr(f"least(size(w), {window})"))
    gram = items.select("item_id", "n", F.explode_outer(F.expr("transform(sequence(1, size(w) - n + 1), i -> array_join(slice(w, i, n), ' '))")).alias("gram"))
    windows = written(spark, gram.groupBy("n", "gram").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids")), "windows")
    prints = _prints(items.select("w", "n"), spans).select(F.col("n").alias("own"), F.explode_outer("prints").alias("p")).where("p.n = own")
    prints = written(spark, prints.selectExpr("own p_n", f"shiftright(p.f, {PLACE}) p_hash").distinct(), "prints")
    mark = F.array(F.struct(F.lit(0).alias("n"), F.size("w").cast("long").alias("f")))
    each = _prints(docs, spans).select("doc_id", "raw", "w", F.explode_outer(F.concat(mark, "prints")).alias("p"))
    each = each.selectExpr("doc_id", "raw", "w", "p.n n", "p.f f", f"if(p.n = 0, xxhash64(doc_id, raw), shiftright(p.f, {PLACE})) hash")
    pos, k = f"cast(f & {(1 << PLACE) - 1}L as int)", f"least(n, {GRAM})"
    lo = f"greatest(0, {pos} - (n - {k}))"
    context = [F.expr(f"if(n = 0, f, cast({lo} as bigint))").alias("lo"), F.expr(f"if(n = 0, null, slice(w, {lo} + 1, {pos} + n - {lo}))").alias("c")]
    small = prints.count() <= BROADCAST_FINGERPRINTS
    if small:  # what is carried through the join is the text's words; beyond the bound, only the words around a print
        each = each.join(F.broadcast(prints), F.expr("n = p_n and hash = p_hash"), "left").where("n = 0 or p_n is not null").select("doc_id", "raw", "n", *context)
    else:
        each = each.select("doc_id", "raw", "n", "hash", *context).join(prints.hint("merge"), F.expr("n = p_n and hash = p_hash"), "left").where("n = 0 or p_n is not null").drop("hash", "p_n", "p_hash")
    each = written(spark, each, "scanned")
    counts = each.where("n = 0").selectExpr("doc_id", "raw", "lo n_words")
    near = each.where("n > 0").select("doc_id", "raw", "n", F.explode_outer(F.expr(
        "if(size(c) < n, array(), transform(sequence(0, size(c) - n), o -> named_struct('first', lo + o, 'gram', array_join(slice(c, o + 1, n), ' '))))")).alias("x"))
    near = near.selectExpr("doc_id", "raw", "n", "cast(x.first as int) first", "x.gram gram").where("gram is not null").distinct()
    return counts, near.join(windows, ["n", "gram"]).selectExpr("doc_id", "raw", "first", "n words", "item_ids")


def contamination(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row for each row of docs (doc_id, text), against items (item_id, text): doc_id, raw
    (xxhash64 of the text), n_words, n_hit, n_items, items_sha256, contaminated.

    A null text has no words; an item without words has no window; equal items with different ids all
    count, repeated item rows once; an item of a null id makes hits but isn't counted or listed. Documents of one
    doc_id and different texts are told apart by raw; other columns are ignored. Empty tables give no rows, or no hits.
    """
    words = docs.select("doc_id", F.xxhash64("text").alias("raw"), F.expr(_words("text")).alias("w"))
    items = written(spark, items.select("item_id", F.expr(_words("text")).alias("w")), "items")
    counts, found = hits(spark, words, items, window)
    found = written(spark, found, "hits")
    row = ["doc_id", "raw"]
    earlier = Window.partitionBy(*row).orderBy("first", "words").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max(F.expr("first + words")).over(earlier), F.lit(0))
    places = found.select(*row, "first", "words").withColumn("seen", seen)
    covered = places.groupBy(*row).agg(F.sum(F.expr("greatest(0, first + words - greatest(first, seen))")).alias("n_hit"))
    # Neighbouring windows mostly have the same items: sets are told apart first, then their members.
    which = found.select(*row, "item_ids").distinct().select(*row, F.explode_outer("item_ids").alias("item")).distinct().groupBy(*row)
    which = which.agg(F.count("item").alias("n_items"), F.array_join(F.sort_array(F.collect_list(F.col("item").cast("string"))), ",").alias("ids"))
    got = covered.join(which, (covered["doc_id"].eqNullSafe(which["doc_id"])) & covered["raw"].eqNullSafe(which["raw"]))
    got = written(spark, got.select(covered["doc_id"].alias("d"), covered["raw"].alias("r"), "n_hit", "n_items", "ids"), "covered")
    out = counts.join(got, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("raw").eqNullSafe(F.col("r")), "left")
    return out.selectExpr(
        "doc_id", "raw", "n_words", "coalesce(n_hit, 0L) n_hit", "coalesce(n_items, 0L) n_items",
        "sha2(coalesce(ids, ''), 256) items_sha256", "coalesce(n_hit, 0L) > 0 and 20 * coalesce(n_hit, 0L) >= n_words contaminated",
    )


def decontaminated(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns."""
    bad = written(spark, contamination(spark, docs, items, window).where("contaminated").selectExpr("doc_id __pg_d", "raw __pg_r").distinct(), "bad")
    keyed = docs.withColumn("__pg_raw", F.xxhash64("text"))
    return keyed.join(bad, F.col("doc_id").eqNullSafe(F.col("__pg_d")) & (F.col("__pg_raw") == F.col("__pg_r")), "left_anti").drop("__pg_raw")


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's overlap with the benchmark."""
    return contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("raw")


ORACLE = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select distinct item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
s as (select item_id, w, least(len(w), 13) as n from b where len(w) > 0),
bw as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as gram from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) as i from s)),
lens as (select distinct n from bw),
dw as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as gram from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, lens where len(w) >= n)),
m as (select distinct doc_id, i, dw.n, item_id from dw join bw on dw.gram = bw.gram and dw.n = bw.n),
h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from m) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct doc_id, item_id::varchar as item from m where item_id is not null) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, (coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w)) as contaminated
from d left join h using (doc_id) left join t using (doc_id)
"""
