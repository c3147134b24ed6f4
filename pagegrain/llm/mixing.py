"""Operator 8, mixing sources to target weights: fixed-length blocks dealt to shard slots. Native.

Each source is one stream of words, its documents in a fixed pseudorandom order, cut into blocks of
`block_words`. The mix has N slots in shards of `shard_slots`. First each shard draws how many of its
slots each source gets: multinomial counts, given that a source's counts over all shards add up to its
quota (a keyed permutation of N tickets, quota of them a source's, deals each shard its tickets).
Independent draws would miss the targets by chance and break the limit of twice a document. The counts
alone then lay the mix out: in a shard, a keyed permutation spreads the sources over the slots; a source's
j-th slot, shard by shard, holds block perm(j mod blocks) of its stream, by another permutation each
epoch. The slots are a table, (shard, slot, sk, block), to which blocks are joined by (source, index).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import running, table, word_count, written
from .feistel import permuted

BLOCK_WORDS, SHARD_SLOTS, SHARE, MOST = 128, 4096, 1.5, 2
WEIGHTS = (5, 2, 1)
KEY = 20240607
ROWS_A_BUCKET = 20_000
#: Rows of a broadcast table at most: (range, source) rows of some 60 bytes. More are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Shards whose counts are added up together, and copies of a row that one task makes.
GROUP, COPIES = 1024, 1024


class Plan(NamedTuple):
    sources: DataFrame  # sk, source, source_size, target, blocks, quota, before (quotas of the sources ahead)
    placed: DataFrame  # k1, k2, sk, doc_id, size, m, off: distinct rows with words, their copies, their first word's place
    empty: DataFrame  # sk, doc_id, m: rows without words
    slots: int
    most_copies: int
    few_sources: bool


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with sk (a source's key without nulls), size, and k1, k2: 128 bits that tell rows apart."""
    source = F.col("source").cast("string")
    # The hash skips nulls: each column's mark says where they are. Nested values are told apart by their whole text.
    nested = lambda kind: any(x in kind for x in ("<", "variant"))
    told = [F.to_json(F.struct(docs[f"`{c}`"].alias("x")), {"ignoreNullFields": "false"}) if nested(kind) else docs[f"`{c}`"] for c, kind in docs.dtypes]
    told = [F.concat(*[F.when(docs[f"`{c}`"].isNull(), "0").otherwise("1") for c in docs.columns]), *told]
    return docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__pg_row"), F.col("doc_id").alias("__pg_id"), source.alias("__pg_source"),
        F.when(source.isNull(), "-").otherwise(F.concat(F.lit("+"), source)).alias("sk"), F.xxhash64(*told).alias("k1"), F.xxhash64(F.lit(17), *told).alias("k2"), F.xxhash64("doc_id", "text").alias("raw"), word_count(F.col("text")).alias("size"),
    )


def _targets(spark: SparkSession, by_source: DataFrame, block_words: int) -> DataFrame:
    """by_source (sk, source, source_size) with target, blocks and quota (draws). Weights go by rank; as long as
    some target is above its limit, those are held there and the rest is shared by weight among the others."""
    order = [F.col("source").isNull().cast("int"), F.col("source"), F.col("sk")]
    ranked = running(spark, by_source, order).drop("before")
    ranked = written(spark, ranked.withColumn("w", F.expr(f"element_at(array({', '.join(f'{w}.0D' for w in WEIGHTS)}), cast(rank % {len(WEIGHTS)} as int) + 1)")).withColumn("cap", F.expr(f"{float(MOST)}D * source_size")), "weights")
    goal = SHARE * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        full, free = ranked.agg(F.sum(F.expr(f"if(cap <= {level!r}D * w, cap, 0D)")), F.sum(F.expr(f"if(cap <= {level!r}D * w, 0D, w)"))).first()
        if not free or (now := (goal - full) / free) <= level:
            break
        level = now
    target = ranked.withColumn("target", F.expr(f"least(cap, {level!r}D * w)"))
    target = target.withColumn("blocks", F.expr(f"cast(ceil(source_size / {block_words}) as bigint)"))
    return target.withColumn("quota", F.expr(f"if(source_size = 0, 0L, least({MOST} * blocks, cast(round(target * blocks / source_size) as bigint)))"))


def plan(spark: SparkSession, docs: DataFrame, block_words: int = BLOCK_WORDS) -> Plan:
    """Sizes, targets and places. Equal rows are one row with a count from here on, so that no number of copies
    meets in a task; rows are placed in order of bucket, then id and key, and only a bucket's rows meet."""
    rows = written(spark, _keyed(docs).groupBy("k1", "k2", "sk", "__pg_source", "__pg_id", "raw", "size").agg(F.count("*").alias("m")), "sized")
    n = max(512, rows.count() // ROWS_A_BUCKET)
    rows = rows.withColumn("bucket", F.expr(f"pmod(xxhash64(raw, 17), {n})"))
    sums = written(spark, rows.groupBy("sk", "bucket").agg(F.first("__pg_source").alias("source"), F.sum(F.expr("size * m")).alias("s")), "sums")
    by_source = sums.groupBy("sk").agg(F.first("source").alias("source"), F.sum("s").alias("source_size"))
    targets = _targets(spark, by_source, block_words).select("sk", "source", "source_size", "target", "blocks", "quota")
    sources = written(spark, running(spark, targets, [F.col("sk")], "quota").drop("rank"), "sources")
    before = Window.partitionBy("sk").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("sk", "bucket", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("at"))
    own = Window.partitionBy("sk", "bucket").orderBy("__pg_id", "raw", "k1", "k2").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.where("size > 0").withColumn("inside", F.coalesce(F.sum(F.expr("size * m")).over(own), F.lit(0)))
    placed = inside.join(starts, ["sk", "bucket"]).select("k1", "k2", "sk", F.col("__pg_id").alias("doc_id"), "size", "m", (F.col("at") + F.col("inside")).alias("off"))
    slots, few = sources.agg(F.sum("quota"), F.count("*") <= BROADCAST_ROWS).first()
    most = rows.agg(F.max("m")).first()[0] or 0
    return Plan(sources, written(spark, placed, "placed"), rows.where("size = 0").select("sk", F.col("__pg_id").alias("doc_id"), "m"), slots or 0, most, few)


def _small(rows: DataFrame, p: Plan) -> DataFrame:
    """rows, one or two a source and 65,537 more at most, for a broadcast where they are few, else for a merge join."""
    return F.broadcast(rows) if p.few_sources else rows.hint("merge")


def shard_counts(spark: SparkSession, p: Plan, shard_slots: int = SHARD_SLOTS, key: int = KEY) -> DataFrame:
    """(shard, sk, n): how many slots of a shard each source gets, 0 left out. A shard's slots draw tickets without
    replacement; a ticket is of the source in whose range of quota tickets it lies. A source's counts add up to
    its quota, a shard's to its slots."""
    slots, shards = p.slots, -(-p.slots // shard_slots)
    each = spark.range(0, shards, 1, int(min(20_000, slots // 65_536 + 1))).withColumnRenamed("id", "shard")
    each = each.select("shard", F.explode_outer(F.expr(f"sequence(shard * {shard_slots}, least({slots}L, (shard + 1) * {shard_slots}) - 1)")).alias("slot"))
    width = max(1, slots // 65_536)  # tickets a range: a range holds one source, or a few small ones
    each = each.select("shard", F.expr(permuted("slot", f"{slots}L", f"{key}L")).alias("ticket")).withColumn("range", F.expr(f"ticket div {width}"))
    ranges = p.sources.where("quota > 0").select("sk", F.col("before").alias("lo"), F.expr("before + quota").alias("hi"), F.explode(F.expr(f"sequence(before div {width}, (before + quota - 1) div {width})")).alias("range"))
    held = each.join(_small(ranges, p), "range").where("lo <= ticket and ticket < hi")
    return written(spark, held.groupBy("shard", "sk").agg(F.count("*").alias("n")), "counts")


def slots(spark: SparkSession, p: Plan, shard_slots: int = SHARD_SLOTS, key: int = KEY) -> DataFrame:
    """(shard, slot, sk, block), written: every slot of the mix once, laid out from the shards' counts."""
    counts = shard_counts(spark, p, shard_slots, key)
    group = counts.withColumn("g", F.expr(f"shard div {GROUP}"))
    ahead = Window.partitionBy("sk").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    groups = group.groupBy("sk", "g").agg(F.sum("n").alias("of")).select("sk", "g", F.coalesce(F.sum("of").over(ahead), F.lit(0)).alias("of"))
    inside = Window.partitionBy("sk", "g").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    drawn = group.withColumn("first", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(groups, ["sk", "g"])
    drawn = drawn.join(_small(p.sources.select("sk", "blocks"), p), "sk").select("shard", "sk", "n", "blocks", (F.col("first") + F.col("of")).alias("first"))
    # A stated number of tasks: adaptive execution would put these few rows, which become many, into one.
    drawn = drawn.repartition(int(min(20_000, p.slots // 32_768 + 1)), "shard")
    rank = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("sk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = drawn.withColumn("rank", rank).select("*", F.explode_outer(F.expr("sequence(0L, n - 1)")).alias("k"))
    slot = permuted("rank + k", f"least({shard_slots}L, {p.slots}L - shard * {shard_slots})", f"xxhash64(shard, {key}L)")
    block = permuted("(first + k) % blocks", "blocks", f"xxhash64(sk, (first + k) div blocks, {key}L)")
    return written(spark, each.select("shard", F.expr(f"shard * {shard_slots} + {slot}").alias("slot"), "sk", F.expr(block).alias("block")), "slots")


def _copies(rows: DataFrame, p: Plan, m: str = "m") -> DataFrame:
    """A row for each of m copies, numbered `copy`; many copies of a row are dealt to tasks in parts of COPIES."""
    parts = rows.select("*", F.explode(F.expr(f"sequence(0L, ({m} - 1) div {COPIES})")).alias("__part"))
    if p.most_copies > COPIES:
        parts = parts.repartition("k1", "k2", "__part") if "k1" in rows.columns else parts.repartition("doc_id", "__part")
    return parts.select("*", F.explode(F.expr(f"sequence(__part * {COPIES}, least({m}, (__part + 1) * {COPIES}) - 1)")).alias("copy")).drop("__part")


def taken(spark: SparkSession, docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """A row for each row of docs (doc_id, source, text): doc_id, size, source_size, target, taken: the words that
    the slots of the mix take of it.

    Sources in order of code point, null last, weigh 5, 2, 1, repeating, and share 1.5 times all words;
    a target stops at twice its source and the excess goes to the others by weight. Every row is a document
    of its own, repeated ones too; null or wordless texts have size 0 and are never taken. No words give
    targets of 0; an empty table gives no rows. Other columns are ignored, whatever their names.
    """
    p = plan(spark, docs.select("doc_id", "source", "text"), block_words)
    b = block_words
    uses = slots(spark, p, shard_slots).groupBy("sk", "block").agg(F.count("*").alias("uses"))
    rows = _copies(p.placed, p).selectExpr("doc_id", "sk", "size", "off + copy * size as off")
    pieces = rows.select("sk", "off", "size", F.explode_outer(F.expr(f"sequence(off div {b}, (off + size - 1) div {b})")).alias("block"))
    pieces = pieces.selectExpr("sk", "off", "block", f"least(off + size, (block + 1) * {b}) - greatest(off, block * {b}) words")
    got = pieces.join(uses.hint("merge"), ["sk", "block"]).groupBy("sk", "off").agg(F.sum(F.expr("words * uses")).alias("taken"))
    out = rows.join(got.hint("merge"), ["sk", "off"], "left").select("doc_id", "sk", "size", F.coalesce("taken", F.lit(0)).alias("taken"))
    none = _copies(p.empty, p).selectExpr("doc_id", "sk", "0L size", "0L taken")
    return out.unionByName(none).join(_small(p.sources.select("sk", "source_size", "target"), p), "sk").select("doc_id", "size", "source_size", "target", "taken")


def mix(spark: SparkSession, docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix itself: for each slot a row for each document that its block holds words of, in order of `at`.

    Columns: __pg_shard, __pg_slot, __pg_block, __pg_at (of the row's first word in the block) and those of docs,
    `text` being that stretch of the text, white space kept; n_chars, where there is one, counts it. Equal rows are
    copies, each with its own place. No words, or an empty table, give no rows.
    """
    p = plan(spark, docs, block_words)
    every = slots(spark, p, shard_slots)
    split = r"split({}, r'(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])')"
    words = split.format(r"regexp_replace(row.text, r'^[\x20\x09-\x0D]+', '')")
    # The rows of docs, equal ones once, merged before the shuffle; the same exchange serves the join.
    rows = _keyed(docs).where("size > 0").groupBy("k1", "k2").agg(F.first("__pg_row").alias("row"))
    flat = [F.col(f"row.`{c}`").alias(f"__pg_{i}") for i, c in enumerate(docs.columns) if c != "text"]
    b, names = block_words, [f"__pg_{i}" for i, c in enumerate(docs.columns) if c != "text"]
    # One list of words a document, sliced once a block.
    placed = rows.join(p.placed.hint("merge"), ["k1", "k2"]).select("k1", "k2", "sk", "size", "m", "off", F.expr(words).alias("words"), *flat)
    placed = _copies(placed, p).withColumn("off", F.expr("off + copy * size"))
    each = placed.select("sk", *names, F.explode_outer(F.expr(
        f"transform(sequence(off div {b}, (off + size - 1) div {b}), k -> named_struct('block', k, 'at', greatest(0L, off - k * {b}), 'text', "
        f"array_join(slice(words, cast(greatest(0L, k * {b} - off) + 1 as int), cast(least(size, (k + 1) * {b} - off) - greatest(0L, k * {b} - off) as int)), '')))"
    )).alias("p"))
    out = each.select("sk", "p.block", "p.at", "p.text", *names).join(every.hint("merge"), ["sk", "block"])

    def column(i: int, c: str) -> Column:
        return F.col("text") if c == "text" else F.char_length("text").cast(docs.schema[c].dataType) if c == "n_chars" else F.col(f"__pg_{i}")

    return out.select(F.col("shard").alias("__pg_shard"), F.col("slot").alias("__pg_slot"), F.col("block").alias("__pg_block"), F.col("at").alias("__pg_at"), *[column(i, c).alias(c) for i, c in enumerate(docs.columns)])


def mixed(spark: SparkSession, docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """mix() in the columns of docs alone, for what orders its rows itself."""
    return mix(spark, docs, block_words, shard_slots).select(*[F.col(f"`{c}`") for c in docs.columns])


def blocks(rows: DataFrame) -> DataFrame:
    """(shard, slot, source, doc_ids, text) of mix()'s rows: a slot's pieces joined into its block, a row a slot."""
    piece = F.array_sort(F.collect_list(F.struct(F.col("__pg_at").alias("at"), "doc_id", "text")))
    whole = rows.groupBy("__pg_shard", "__pg_slot").agg(F.first("source").alias("source"), piece.alias("p"))
    text = F.array_join(F.transform("p", lambda x: F.regexp_replace(x["text"], r"[\x20\x09-\x0D]*$", "")), "\n")
    return whole.select(F.col("__pg_shard").alias("shard"), F.col("__pg_slot").alias("slot"), "source", F.transform("p", lambda x: x.doc_id).alias("doc_ids"), text.alias("text"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's share of the mix."""
    return taken(spark, table(spark, sf_dir, "documents"))


ORACLE = None
