"""From band keys to classes: candidate pairs, exact verification, connected components.

Nodes are 64-bit fingerprints of distinct texts, so exact copies are one node before anything else
happens and a group of copies of any size costs one row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, written

#: Buckets up to this size are held against each other pair by pair; larger ones block by block.
SMALL, BLOCK = 16, 256


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of edges (a, b): comp is the least node of its connected component.

    Large-star and small-star steps in turn (Kiveris et al., 2014), each round a written table; ends
    when a round changes nothing. Nulls and loops are dropped; no edges give no rows.
    """
    e = edges.where("a <> b").selectExpr("greatest(a, b) u", "least(a, b) v").distinct()
    e = written(spark, e, "edges")
    print_of = lambda x: x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = print_of(e)
    while seen[0]:
        both = e.unionByName(e.selectExpr("v u", "u v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) m")
        large = both.where("v > u").join(least, "u").selectExpr("v u", "m v").distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").where("v <> m").selectExpr("v u", "m v").unionByName(root.selectExpr("u", "m v")).distinct()
        e = written(spark, small, "edges")
        now = print_of(e)
        if now == seen:
            break
        seen = now
    return e.selectExpr("u node", "v comp").unionByName(e.selectExpr("v node", "v comp").distinct())


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets (node, items array<bigint>, all different) have a Jaccard
    of threshold at least. A pair of which one set is missing is dropped."""
    one = sets.selectExpr("node a", "items x")
    two = sets.selectExpr("node b", "items y")
    near = pairs.join(one, "a").join(two, "b").where(f"least(size(x), size(y)) >= {threshold} * greatest(size(x), size(y))")
    common = near.selectExpr("a", "b", "size(x) + size(y) both", "size(array_intersect(x, y)) c")
    return common.where(f"c >= {threshold} * (both - c)").select("a", "b")


def _forest(near: np.ndarray) -> np.ndarray:
    """Edges (i, j) of a spanning forest of a symmetric boolean matrix: one less than its nodes at most."""
    edges, seen = [], np.zeros(len(near), bool)
    for root in range(len(near)):
        todo = [] if seen[root] else [root]
        seen[root] = True
        while todo:
            i = todo.pop()
            new = np.flatnonzero(near[i] & ~seen)
            seen[new] = True
            edges.extend((i, j) for j in new)
            todo.extend(new)
    return np.array(edges, np.int64).reshape(-1, 2)


def _overlaps(owner: np.ndarray, items: np.ndarray, n: int) -> np.ndarray:
    """Common items of each pair of n sets, exactly: products of incidence matrices, some columns at a time."""
    _, code, seen = np.unique(items, return_inverse=True, return_counts=True)
    shared = seen[code] > 1
    column = np.cumsum(seen > 1) - 1
    owner, code = owner[shared], column[code[shared]]
    out, width = np.zeros((n, n), np.float32), 4096
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        a, b = np.searchsorted(code, (lo, lo + width))
        m = np.zeros((n, width), np.float32)
        m[owner[a:b], code[a:b] - lo] = 1
        out += m @ m.T
    return out


def _blocks(threshold: float):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (key, lo, hi); each such run is two blocks of a bucket, or one with itself."""

        def edges(rows: pa.Table) -> pa.RecordBatch:
            node, comp, mine = (rows.column(c).to_numpy() for c in ("node", "comp", "mine"))
            items = rows.column("items").combine_chunks()
            sizes = np.diff(items.offsets.to_numpy())
            common = _overlaps(np.repeat(np.arange(len(node)), sizes), items.flatten().to_numpy(), len(node))
            both = sizes[:, None] + sizes[None, :]
            near = (common >= threshold * (both - common)) & (comp[:, None] != comp[None, :])
            if rows.column("lo")[0] != rows.column("hi")[0]:
                near &= mine[:, None] != mine[None, :]
            found = _forest(near)
            x, y = node[found[:, 0]], node[found[:, 1]]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            group = list(zip(*(batch.column(c).to_pylist() for c in ("key", "lo", "hi")), strict=True))
            start = 0
            for i in range(len(group)):
                if group[i] != last:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    if held:
                        yield edges(pa.Table.from_batches(held))
                    held, start, last = [], i, group[i]
            held.append(batch.slice(start))
        if held:
            yield edges(pa.Table.from_batches(held))

    return link


def classes(spark: SparkSession, keys: DataFrame, fetch: Callable[[DataFrame], DataFrame], threshold: float) -> DataFrame:
    """(node, comp) of all nodes that have a partner: components of the verified pairs that share a key.

    keys: (key, node) rows, repeats allowed. fetch: from (node) to (node, items), the sets to verify.
    First every node of a bucket is held against the bucket's least node, which is linear in the
    bucket. Pairs that those links already connect need no look. In the buckets that still span two or
    more components, every pair across components is verified too, so no link between different texts
    is lost to the choice of the first node: up to SMALL nodes as rows of pairs, beyond that by pairs of
    blocks of about BLOCK nodes, each a task of bounded size that multiplies incidence matrices and
    gives back no more links than it has nodes.
    """
    keys = written(spark, keys.groupBy("key", "node").agg(F.lit(1).alias("one")).drop("one"), "keys")
    bucket = keys.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1")
    members = written(spark, keys.join(bucket.hint("merge"), "key").select("key", "node", "least", "n"), "members")
    star = written(spark, members.where("node <> least").selectExpr("least a", "node b").distinct(), "star")
    sets = written(spark, fetch(star.selectExpr("a node").unionByName(star.selectExpr("b node")).distinct()), "sets")
    links = written(spark, verified(star, sets, threshold), "links")
    comps = components(spark, links)
    open_ = members.where("n > 2").join(comps.hint("merge"), "node", "left").selectExpr("key", "n", "node", "coalesce(comp, node) comp")
    open_ = written(spark, open_, "labelled")
    split = open_.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    open_ = written(spark, open_.join(split.hint("merge"), "key", "left_semi"), "open")
    small, large = open_.where(f"n <= {SMALL}"), open_.where(f"n > {SMALL}")
    across = small.selectExpr("key", "node a", "comp ca").join(small.selectExpr("key", "node b", "comp cb").hint("merge"), "key").where("ca < cb")
    across = across.selectExpr("least(a, b) a", "greatest(a, b) b").distinct().join(star, ["a", "b"], "left_anti")
    more = verified(across, sets, threshold)
    dealt = large.withColumn("k", F.expr(f"cast(ceil(n / {BLOCK}) as int)")).withColumn("mine", F.expr("cast(pmod(xxhash64(node, key), k) as int)"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, k - 1)"))).selectExpr("key", "node", "comp", "mine", "least(mine, other) lo", "greatest(mine, other) hi")
    dealt = dealt.join(sets.hint("merge"), "node").select("key", "lo", "hi", "mine", "node", "comp", "items").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    with small_batches(spark):
        more = written(spark, more.unionByName(dealt.mapInArrow(_blocks(threshold), "a bigint, b bigint")).distinct(), "links")
    if more.isEmpty():
        return comps
    return components(spark, links.unionByName(more))
