"""Operator 13, conversation prefix trie: preorder intervals.

A node is a distinct sequence of first turns, named by its depth and an exclusive-or of hashes of (place, turn), so that every row
of a conversation gets its node's name from a prefix sum that splits anywhere. Distinct nodes are ranked lexicographically, a node
before what stands under it: the key is the names of the turnings on a node's way (the first nodes under a fork), then its depth, so
that a long unshared tail costs one name. A rank is a preorder position; a node's subtree is the positions from its own to `end`,
the last one of the leaves that its conversations lead to. Leaves and saved tokens of a subtree are differences of prefix sums over
the positions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import placed, release, running, small_batches, table, written
from .sharding import CRC_TABLE, crc_sql

#: Rows of a conversation that are summed up in one group, ids in one list, and conversations that share first turns in `rebuilt`.
STRETCH, IDS, FAMILY = 4096, 65_536, 5
KEY = ["depth", "k1", "k2"]


def turns_of(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """(conv_id, place, role, digest, bytes) of rows (conv_id, turn, role, text), written: place counts a conversation's turns from 0 by turn,
    null first, then role, then the text's SHA-256. Null roles and texts are empty; rows without conv_id are of no conversation."""
    text = F.coalesce("text", F.lit(""))
    slim = rows.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.sha2(text, 256).alias("digest"), F.octet_length(text).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("at"))
    out = placed(spark, written(spark, slim, "turns"), ["conv_id"], ["turn", "role", "digest", "at"], "place")
    return written(spark, out.select("conv_id", "place", "role", "digest", "bytes"), "placed")


def rebuilt(spark: SparkSession, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """turns_of() with shared openings: conversation c takes the first h turns of c - c % FAMILY, then its own after its first h, h being crc32(c) % 9.
    Beside them, all conversations (conv_id), those left without turns too. At most 8 turns of a conversation go to FAMILY others."""
    convs = written(spark, turns.groupBy("conv_id").agg(F.count("*").alias("n")), "convs")
    h = F.crc32(F.encode(F.col("conv_id").cast("string"), "utf-8")) % 9
    heads = convs.select(F.col("conv_id").alias("c"), h.alias("h"), F.expr(f"conv_id - conv_id % {FAMILY}").alias("base"))
    firsts = turns.where("place < 8").withColumnRenamed("conv_id", "base")
    head = firsts.join(heads.hint("merge"), "base").where("place < h").select(F.col("c").alias("conv_id"), "place", "role", "digest", "bytes")
    base = convs.selectExpr("conv_id base", "n")
    shift = written(spark, heads.join(base.hint("merge"), "base", "left").selectExpr("c conv_id", "h", "least(h, coalesce(n, 0L)) - h shift"), "shift")
    own = turns.join(shift.hint("merge"), "conv_id").where("place >= h").selectExpr("conv_id", "place + shift place", "role", "digest", "bytes")
    return head.unionByName(own), convs.select("conv_id")


def _prefixes(spark: SparkSession, turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, j1, j2, bytes), written: the node after each turn, its parent's name and the last text's bytes; depth 0 too."""
    each = turns.selectExpr("conv_id", "place + 1 depth", "xxhash64(place, role, digest) t1", "xxhash64(17, place, role, digest) t2", "bytes")
    each = written(spark, each.withColumn("stretch", F.expr(f"depth div {STRETCH}")), "steps")
    sums = each.groupBy("conv_id", "stretch").agg(F.expr("bit_xor(t1)").alias("s1"), F.expr("bit_xor(t2)").alias("s2"))
    ahead = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select("conv_id", "stretch", F.expr("bit_xor(s1)").over(ahead).alias("c1"), F.expr("bit_xor(s2)").over(ahead).alias("c2"))
    upto = Window.partitionBy("conv_id", "stretch").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = each.select("*", F.expr("bit_xor(t1)").over(upto).alias("p1"), F.expr("bit_xor(t2)").over(upto).alias("p2"))
    both = inside.join(carry, ["conv_id", "stretch"]).selectExpr("conv_id", "depth", "p1 ^ coalesce(c1, 0L) k1", "p2 ^ coalesce(c2, 0L) k2", "t1", "t2", "bytes")
    both = both.selectExpr("conv_id", "depth", "k1", "k2", "k1 ^ t1 j1", "k2 ^ t2 j2", "bytes")
    return written(spark, both.unionByName(convs.selectExpr("conv_id", "0L depth", "0L k1", "0L k2", "cast(null as bigint) j1", "cast(null as bigint) j2", "0L bytes")), "prefixes")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of node and part: the SHA-256 of a node's lists, comma-joined, one list in memory at a time."""
    node, running_hash, out = None, None, []
    for batch in batches:
        for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids")), strict=True):
            if key != node:
                if running_hash:
                    out.append((*node, running_hash.hexdigest()))
                node, running_hash = key, hashlib.sha256()
            else:
                running_hash.update(b",")
            running_hash.update(ids.encode())
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=[*KEY, "ends"])
            out = []
    if running_hash:
        out.append((*node, running_hash.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=[*KEY, "ends"])


def _ends(spark: SparkSession, prefixes: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends): of nodes where conversations end, the hash of their ids in order."""
    last = prefixes.groupBy("conv_id").agg(F.max(F.struct(*KEY)).alias("e")).selectExpr("conv_id", "e.*")
    part = F.expr(f"floor(conv_id / {IDS})")
    lists = last.groupBy(*KEY, part.alias("part")).agg(F.expr("array_join(transform(sort_array(collect_list(conv_id)), x -> cast(x as string)), ',')").alias("ids"))
    with small_batches(spark, 64):
        rows = lists.repartition("depth", "k1", "k2").sortWithinPartitions(*KEY, "part")
        return written(spark, rows.mapInArrow(_digests, "depth bigint, k1 bigint, k2 bigint, ends string"), "ends")


def nodes(spark: SparkSession, turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The trie's nodes: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and
    position and end_position, the first and last preorder position of its subtree.

    turns (conv_id, place, role, digest, bytes) may hold conversations of any length, convs those without turns as well. Equal conversations
    are members of the same nodes. No conversations give no rows, turnless ones the root alone.
    """
    rows = _prefixes(spark, turns, convs)
    own = rows.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("j1").alias("j1"), F.min("j2").alias("j2"), F.min("bytes").alias("bytes"))
    own = written(spark, own, "nodes")
    children = own.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("j1").alias("k1"), F.col("j2").alias("k2")).agg(F.count("*").alias("n_children"))
    own = written(spark, own.join(children.hint("merge"), KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "counted")
    above = own.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("j1"), F.col("k2").alias("j2"), F.col("conv_id").alias("parent_conv_id"), (F.col("n_children") > 1).alias("turning"))
    full = own.where("depth > 0").join(above.hint("merge"), ["depth", "j1", "j2"]).select(*own.columns, "parent_conv_id", "turning")
    root = own.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")).withColumn("turning", F.lit(False))
    full = written(spark, full.unionByName(root), "linked")
    release(spark)

    # The way of each conversation that names a node: the turnings on it.
    first = full.select("conv_id").distinct()
    ways = rows.select("conv_id", *KEY).join(full.where("turning").select(*KEY).hint("merge"), KEY).join(first.hint("merge"), "conv_id", "left_semi")
    ways = written(spark, ways.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*KEY))).alias("way")), "ways")
    path = F.expr("array_join(transform(filter(way, x -> x.depth <= depth), x -> concat(lpad(hex(x.k1), 16, '0'), lpad(hex(x.k2), 16, '0'))), '')")
    full = full.join(ways.hint("merge"), "conv_id", "left").withColumn("path", F.coalesce(path, F.lit(""))).drop("way", "turning", "j1", "j2")
    full = written(spark, full.withColumn("leaf", F.expr("if(n_children = 0, 1L, 0L)")).withColumn("saved", F.expr("(n_convs - 1) * bytes")), "paths")
    ranked = running(spark, full, [F.col("path"), F.col("depth")], ["leaf", "saved"], 50_000)
    ranked = written(spark, ranked.drop("path").withColumnsRenamed({"rank": "position", "before_leaf": "leaves_before", "before_saved": "saved_before"}), "ranked")
    release(spark)

    # Of each leaf the conversation that names it leads to all nodes above; the last leaf under a node ends its subtree.
    leaves = ranked.where("leaf = 1").selectExpr("conv_id", "position", "leaves_before + leaf upto_leaves", "saved_before + saved upto_saved")
    lead = rows.select("conv_id", *KEY).join(leaves.hint("merge"), "conv_id").groupBy(*KEY).agg(F.max(F.struct("position", "upto_leaves", "upto_saved")).alias("last"))
    out = ranked.join(lead.hint("merge"), KEY).join(_ends(spark, rows).hint("merge"), KEY, "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("last.upto_leaves") - F.col("leaves_before")).alias("n_leaves"), (F.col("last.upto_saved") - F.col("saved_before")).alias("saved_tokens"),
        F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"), "position", F.col("last.position").alias("end_position"),
    )


def linearised(found: DataFrame, turns: DataFrame) -> DataFrame:
    """Each distinct turn once, in preorder positions, with what a trainer needs to mask attention to ancestors: position, end_position, depth
    and the columns of turns (conv_id, place, ...) of the node's own turn. turns are those that the nodes were made of."""
    on = (found["conv_id"] == turns["conv_id"]) & (found["depth"] == turns["place"] + 1)
    return found.join(turns.hint("merge"), on).select("position", "end_position", "depth", *[turns[c] for c in turns.columns])


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt with shared openings."""
    turns, convs = rebuilt(spark, turns_of(spark, table(spark, sf_dir, "conversations")))
    return nodes(spark, turns, convs).drop("position", "end_position")


ORACLE = f"""
with k as (select {CRC_TABLE} as crc_table),
t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), sha256(coalesce(text, ''))) - 1 as place, coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null),
c as (select conv_id, n, conv_id - conv_id % 5 as base, {crc_sql("conv_id::varchar")} % 9 as h from (select conv_id, count(*) as n from t group by conv_id), k),
r as (select c.conv_id, place, role, text from c join t on t.conv_id = c.base and place < h
  union all select c.conv_id, place - c.h + least(c.h, coalesce(b.n, 0)), role, text from c join t on t.conv_id = c.conv_id and place >= c.h left join c b on b.conv_id = c.base),
p as (select conv_id, 0 as depth, '' as name, 0 as bytes from c
  union all select conv_id, place + 1, sha256(string_agg(role || chr(0) || sha256(text), chr(1)) over (partition by conv_id order by place)), octet_length(encode(text)) from r),
g as (select p.*, lag(name) over (partition by conv_id order by depth) as parent, lead(name) over (partition by conv_id order by depth) is null as ends from p),
n as (select depth, name, any_value(parent) as parent, min(conv_id) as conv_id, count(*) as n_convs, any_value(bytes) as bytes, string_agg(conv_id::varchar, ',' order by conv_id) filter (ends) as ids from g group by depth, name),
m as (select n.*, (select count(*) from n x where x.parent = n.name and x.depth = n.depth + 1) as n_children from n),
u as (select distinct a.depth, a.name, b.depth as d, b.name as under from g a join g b on b.conv_id = a.conv_id and b.depth >= a.depth),
s as (select u.depth, u.name, count(*) filter (m.n_children = 0) as n_leaves, sum((m.n_convs - 1) * m.bytes)::bigint as saved_tokens from u join m on m.depth = u.d and m.name = u.under group by u.depth, u.name)
select m.conv_id, m.depth::bigint as depth, x.conv_id as parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, sha256(coalesce(m.ids, '')) as ends_sha256
from m join s using (depth, name) left join m x on x.depth = m.depth - 1 and x.name = m.parent
"""
