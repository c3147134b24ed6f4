"""Operator 11, sharding: a hierarchical weighted hash tree.

Regions hold racks, racks hold shards. A key descends: at each level every child draws -ln(u) / weight, u a hash
of key and child, and the least draw is entered; a node weighs what its shards weigh together. A node's draw hangs on
its own weight alone, so a new weight moves rows only into or out of the nodes above it: no row moves between two
subtrees whose weights stay. A shard that is added by `grown` opens a region of its own, so all old weights stay and
it takes rows only into itself.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import placed, table, written

SEED = 7
#: Region, rack and shard counts of the tree that the query uses.
SHAPE = (2, 2, 2)


class Shard(NamedTuple):
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def tree(regions: int = SHAPE[0], racks: int = SHAPE[1], shards: int = SHAPE[2]) -> list[Shard]:
    """A tree of equal weights; shards are numbered from 0."""
    return [Shard(f"r{r}", f"k{k}", (r * racks + k) * shards + s) for r in range(regions) for k in range(racks) for s in range(shards)]


def grown(shards: Sequence[Shard], weight: float = 1.0) -> list[Shard]:
    """shards and one more, with the next number, in a rack and region of its own."""
    number = max((s.shard for s in shards), default=-1) + 1
    return [*shards, Shard(f"+{number}", "k0", number, weight)]


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _literal(shards: Sequence[Shard]) -> str:
    """The tree as a SQL literal: arrays of (n, w, c); a node's name holds those above it, so that equal names draw apart.
    Shards without weight, and nodes without shards, are left out."""
    there = [s for s in shards if s.weight and s.weight > 0]

    def node(name: str, of: list[Shard], content: str) -> str:
        return f"named_struct('n', {_quoted(name)}, 'w', {float(sum(s.weight for s in of))!r}D, 'c', {content})"

    def level(prefix: str, of: list[Shard], depth: int) -> str:
        if depth == 2:
            return f"array({', '.join(node(f'{prefix}s{s.shard}', [s], str(s.shard)) for s in of)})"
        names = dict.fromkeys(s[depth] for s in of)
        groups = [(f"{prefix}{n}/", [s for s in of if s[depth] == n]) for n in names]
        return f"array({', '.join(node(n, g, level(n, g, depth + 1)) for n, g in groups)})"

    return level("", there, 0) if there else ""


def drawn(key: str, shards: Sequence[Shard], seed: int = SEED) -> Column:
    """The shard (int) that a key (SQL of a string) falls to: three weighted draws. Ties go to the node first by name; a null key
    is an empty one; a tree without weight gives null."""
    found = _literal(shards)
    if not found:
        return F.lit(None).cast("int")
    uniform = f"(cast(conv(substr(md5(concat('{seed}:', x.n, ':', coalesce({key}, ''))), 1, 13), 16, 10) as double) + 0.5D) / 4503599627370496D"
    for _ in range(3):
        found = f"array_min(transform({found}, x -> named_struct('d', -ln({uniform}) / x.w, 'n', x.n, 'c', x.c))).c"
    return F.expr(f"cast({found} as int)")


def sharded(spark: SparkSession, docs: DataFrame, shards: Sequence[Shard], order: Sequence[str] = (), seed: int = SEED) -> DataFrame:
    """docs with __pg_shard and __pg_slot: the shard that doc_id falls to, and the row's place in it, from 0 without gaps, by doc_id,
    then the columns of `order`, then the place in which the table gives equal rows. Null ids are one key and come first; repeated rows have
    a slot each; a hot id is split over tasks; an empty table gives no rows. Other columns go along, whatever their names."""
    keyed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__pg_row"), drawn("cast(doc_id as string)", shards, seed).alias("__pg_shard"), F.col("doc_id").alias("__pg_id"), *[F.col(f"`{c}`").alias(f"__pg_o{i}") for i, c in enumerate(order)], F.monotonically_increasing_id().alias("__pg_at"))
    keyed = written(spark, keyed, "keyed")
    out = placed(spark, keyed, ["__pg_shard"], ["__pg_id", *[f"__pg_o{i}" for i in range(len(order))], "__pg_at"], "__pg_slot")
    return out.select("__pg_row.*", "__pg_shard", "__pg_slot")


def movement(docs: DataFrame, before: Sequence[Shard], after: Sequence[Shard], seed: int = SEED) -> DataFrame:
    """(from_shard, to_shard, n_rows, n_bytes) of docs (doc_id, text) whose shard differs between two trees."""
    both = docs.select(drawn("cast(doc_id as string)", before, seed).alias("from_shard"), drawn("cast(doc_id as string)", after, seed).alias("to_shard"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"))
    return both.where("not (from_shard <=> to_shard)").groupBy("from_shard", "to_shard").agg(F.count("*").alias("n_rows"), F.sum("n").cast("long").alias("n_bytes"))


def write_shards(spark: SparkSession, docs: DataFrame, shards: Sequence[Shard], path: str, task_rows: int = 50_000) -> None:
    """docs as Parquet in path/shard=S, rows in order of their slot within and across a folder's files by name. A shard is written by as many tasks
    as its rows need; the job's commit is atomic and a lost task is written anew."""
    rows = written(spark, sharded(spark, docs, shards), "slots")
    cut = rows.repartitionByRange(int(min(10_000, rows.count() // task_rows + 1)), "__pg_shard", "__pg_slot").sortWithinPartitions("__pg_shard", "__pg_slot")
    cut.withColumnRenamed("__pg_slot", "slot").withColumnRenamed("__pg_shard", "shard").write.partitionBy("shard").parquet(path)


def op11_hashtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot, and its shard if there were one more. Law: `key`. A null text has no bytes."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"))
    out = sharded(spark, docs.withColumn("grown_shard", drawn("cast(doc_id as string)", grown(tree()))), tree(), ["size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("__pg_shard").alias("shard"), F.col("__pg_slot").alias("slot"), "grown_shard")


#: CRC-32 in SQL: the table of its 256 remainders, and the fold of a list of byte values.
CRC_TABLE = "(select list(v order by i) from (select i, list_reduce(list_prepend(i::bigint, range(8)::bigint[]), lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as v from range(256) r(i)))"


def crc_sql(text: str) -> str:
    """DuckDB SQL: unsigned CRC-32 of a text's UTF-8 bytes, with CRC_TABLE as column crc_table."""
    return f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::bigint)), lambda a, b: xor(a >> 8, crc_table[(xor(a, b) & 255) + 1])), 4294967295)"


ORACLE = f"""
with k as (select {CRC_TABLE} as crc_table),
d as (select row_number() over () as rid, doc_id, octet_length(encode(coalesce(text, '')))::bigint + 1 as size, {crc_sql("coalesce(text, '')")} as text_crc32 from documents, k),
n(node, parent, weight) as (values ('r0/', '', 4), ('r1/', '', 4), ('r0/k0/', 'r0/', 2), ('r0/k1/', 'r0/', 2), ('r1/k0/', 'r1/', 2), ('r1/k1/', 'r1/', 2), ('+8/', '+', 1),
  ('r0/k0/s0', 'r0/k0/', 1), ('r0/k0/s1', 'r0/k0/', 1), ('r0/k1/s2', 'r0/k1/', 1), ('r0/k1/s3', 'r0/k1/', 1), ('r1/k0/s4', 'r1/k0/', 1), ('r1/k0/s5', 'r1/k0/', 1), ('r1/k1/s6', 'r1/k1/', 1), ('r1/k1/s7', 'r1/k1/', 1)),
w as (select rid, parent, node, -ln((('0x' || md5('{SEED}:' || node || ':' || coalesce(doc_id::varchar, ''))[:13])::bigint + 0.5) / 4503599627370496) / weight as draw from d, n),
b as (select rid, parent, arg_min(node, draw) as node, min(draw) as draw from w group by rid, parent),
s as (select d.*, right(c.node, 1)::int as shard, case when x.draw < a.draw then 8 else right(c.node, 1)::int end as grown_shard
  from d join b a on a.rid = d.rid and a.parent = '' join b r on r.rid = d.rid and r.parent = a.node join b c on c.rid = d.rid and c.parent = r.node join b x on x.rid = d.rid and x.parent = '+')
select doc_id, size, text_crc32, 'key' as law, shard, row_number() over (partition by shard order by doc_id nulls first, size, text_crc32) - 1 as slot, grown_shard from s
"""
