"""Operator 4, token-ID output: packed sequences in training order, in shards of fixed stride.

Documents are dealt to buckets by hash, ordered in each, tokenised and packed end to end into sequences
of `length` tokens. A sequence's number is its bucket's first number plus its place there; a keyed
Feistel permutation of all numbers, with cycle-walking, gives its slot. Shard s holds the slots
s * shard_slots and up, in order, so that a trainer reads files from start to end and resumes at
byte (slot mod shard_slots) * stride.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, running, small_batches, table, written
from .feistel import permuted

LENGTH, SHARD_SLOTS, KEY = 1024, 8192, 7
ROWS_A_BUCKET = 2_000
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that goes with that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Equal rows (doc_id, text) beyond this many are dealt to buckets one by one; bytes of text a task reads, about.
COPIES, TASK_BYTES = 1000, 64 << 20
#: Tasks that write the sequences at most.
MOST_TASKS = 20_000
#: A run of white space of this many characters goes to the encoder by itself: the pattern's own search through it would overflow.
LONG_RUN = 4096
#: The characters that the pattern's \\s stands for.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_encodings: dict[bytes, object] = {}


def encoding(vocabulary: bytes):
    """The tokenizer of a .tiktoken file's bytes; built once a process."""
    import tiktoken

    if vocabulary not in _encodings:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, vocabulary.splitlines()))}
        _encodings[vocabulary] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[vocabulary]


def ids_of(enc, text: str, long_run: int = LONG_RUN) -> np.ndarray:
    """A text's ids. It is cut around long runs of white space, where the pattern cuts anyway: one match takes such a run up to its last
    character, which goes to what follows, or to the text's end."""
    parts, done = [], 0
    for run in re.finditer(rf"[{SPACES}]{{{long_run},}}", text):
        stop = run.end() if run.end() == len(text) else run.end() - 1
        parts.append(enc.encode_to_numpy(text[done : run.start()], disallowed_special=()))
        parts.append(np.array(enc._encode_single_piece(text[run.start() : stop]), np.uint32))
        done = stop
    parts.append(enc.encode_to_numpy(text[done:], disallowed_special=()))
    return np.concatenate(parts) if len(parts) > 1 else parts[0]


def end_of(vocabulary: bytes) -> int:
    """The end of a document: the least id above all of the vocabulary's. Ids need two bytes, or four where this one is
    over 65,535."""
    return max(int(line.split()[1]) for line in filter(bytes.strip, vocabulary.splitlines())) + 1


def id_type(end: int) -> type:
    return np.uint16 if end < 1 << 16 else np.uint32


def _packer(vocabulary, length: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of bucket; a bucket's last sequence may be short, and is filled with the end's id."""
        enc, end = encoding(vocabulary.value), end_of(vocabulary.value)
        kind = id_type(end)
        bucket, number, room = None, 0, length
        tokens: list[np.ndarray] = []
        ids: list[int | None] = []
        starts: list[int] = []
        out: list[tuple] = []

        def close() -> None:
            nonlocal number, room
            body = np.concatenate(tokens)
            full = np.full(length, end, kind)
            full[: len(body)] = body
            out.append((bucket, number, len(body), ids.copy(), starts.copy(), full.tobytes()))
            number, room = number + 1, length
            tokens.clear(), ids.clear(), starts.clear()

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for b, doc, text in zip(batch.column("bucket").to_pylist(), batch.column("doc_id").to_pylist(), texts, strict=True):
                if b != bucket:
                    if tokens:
                        close()
                    bucket, number = b, 0
                t = np.append(ids_of(enc, text).astype(kind), kind(end))
                at = 0
                while at < len(t):
                    part = t[at : at + room]
                    ids.append(doc)
                    starts.append(length - room)
                    tokens.append(part)
                    at += len(part)
                    room -= len(part)
                    if not room:
                        close()
            if len(out) > 2000:
                yield _rows(out)
                out.clear()
        if tokens:
            close()
        yield _rows(out)

    return pack


_SCHEMA = pa.schema([("bucket", pa.int64()), ("number", pa.int64()), ("n_tokens", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("tokens", pa.binary())])
_DDL = "bucket bigint, number bigint, n_tokens int, doc_ids array<bigint>, starts array<int>, tokens binary"


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_SCHEMA)], schema=_SCHEMA)


def sequences(spark: SparkSession, docs: DataFrame, tokenizer: str = TOKENIZER, length: int = LENGTH, shard_slots: int = SHARD_SLOTS, key: int = KEY) -> DataFrame:
    """The sequences of docs (doc_id, text) in training order: slot (0 and up, without gaps), shard,
    offset (of its first byte in the shard's file), n_tokens, doc_ids and starts (whose tokens it
    holds, from where), tokens (length ids, little-endian, of id_type(end_of(vocabulary)), filled up with the end's id).

    Every text's tokens are followed by the end's id. Null and empty texts give nothing; repeated rows are kept, also
    when a third of all rows are equal; a null doc_id stays null; ties can't be told apart, so their order is
    one. Other columns are ignored. The order depends on docs, length and key only, not on their
    partitions. An empty table gives no rows.
    """
    with open(tokenizer, "rb") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())
    base = docs.where("text <> ''").select("doc_id", "text", F.xxhash64("doc_id", "text").alias("raw"))
    rows, size, hot = base.groupBy("raw").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).agg(F.sum("n"), F.sum("size"), F.max("n")).first()
    n = max(16, (rows or 0) // ROWS_A_BUCKET)
    dealt = base.withColumn("copy", F.lit(0).cast("long"))
    if hot and hot > COPIES:
        dealt = _dealt_copies(spark, base)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (size or 0) // TASK_BYTES)
    dealt = dealt.withColumn("bucket", F.expr(f"pmod(if(copy = 0, raw, xxhash64(raw, copy)), {n})"))
    dealt = dealt.repartition(min(tasks, n), "bucket").sortWithinPartitions("bucket", "doc_id", "raw")
    with small_batches(spark):
        packed = written(spark, dealt.select("bucket", "doc_id", "text").mapInArrow(_packer(vocabulary, length), _DDL), "packed")
    release(spark)
    per = written(spark, packed.groupBy("bucket").agg(F.count("*").alias("n")), "buckets")
    starts = running(spark, per, [F.col("bucket")], "n").select("bucket", F.col("before").alias("base"))
    total = per.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // shard_slots))
    width = np.dtype(id_type(end_of(vocabulary.value))).itemsize
    out = packed.join(starts, "bucket").withColumn("slot", F.expr(permuted("base + number", f"{total}L", f"{key}L"))).withColumn("shard", F.expr(f"slot div {shard_slots}"))
    out = out.select("slot", "shard", F.expr(f"(slot % {shard_slots}) * {stride(length, width)}").alias("offset"), "n_tokens", "doc_ids", "starts", "tokens")
    tasks = min(shards, MOST_TASKS)  # neighbouring shards share a task where there are more
    return out.repartitionById(tasks, F.expr(f"cast(shard * {tasks} div {shards} as int)")).sortWithinPartitions("slot")


def _dealt_copies(spark: SparkSession, base: DataFrame) -> DataFrame:
    """base with `copy`, 0 but for rows of which there are more than COPIES: those are made anew from one of them,
    numbered, in tasks of COPIES. Equal rows are merged before the shuffle, so none gathers them."""
    many = written(spark, base.groupBy("doc_id", "raw").agg(F.count("*").alias("m")).where(f"m > {COPIES}"), "many")
    same = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("raw") == F.col("own_raw"))
    keys = F.broadcast(many.selectExpr("doc_id own_id", "raw own_raw", "m")) if many.count() <= 500_000 else many.selectExpr("doc_id own_id", "raw own_raw", "m").hint("merge")
    rest = base.join(keys, same, "left_anti").withColumn("copy", F.lit(0).cast("long"))
    one = base.join(keys, same).groupBy("doc_id", "raw", "m").agg(F.min("text").alias("text"))
    parts = one.select("*", F.explode(F.expr(f"sequence(0L, (m - 1) div {COPIES})")).alias("part")).repartition("raw", "part")
    copies = parts.select("doc_id", "text", "raw", F.explode(F.expr(f"sequence(part * {COPIES}, least(m, (part + 1) * {COPIES}) - 1)")).alias("copy"))
    return rest.unionByName(copies)


def stride(length: int, width: int = 2) -> int:
    """Bytes of a record in a shard file: the ids, of `width` bytes, and one line feed."""
    return width * length + 1


def write_shards(ordered: DataFrame, path: str) -> None:
    """Shard files path/shard=S/part-*, one each: records of fixed stride in order of slot. Spark's text
    writer puts a record's bytes down as they are, then its line feed; the job's commit is atomic and a
    lost task is written anew."""
    rows = ordered.sortWithinPartitions("shard", "slot")  # the order that a partitioned write asks for, and ours in it
    rows.select("shard", F.col("tokens").cast("string").alias("value")).write.partitionBy("shard").option("lineSep", "\n").text(path)


def read_record(shard_file, slot: int, length: int = LENGTH, shard_slots: int = SHARD_SLOTS, width: int = 2) -> np.ndarray:
    """The ids of a slot from its open shard file, by one seek."""
    shard_file.seek((slot % shard_slots) * stride(length, width))
    return np.frombuffer(shard_file.read(width * length), f"<u{width}")


def op4_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as sequences in training order."""
    return sequences(spark, table(spark, sf_dir, "documents"))


ORACLE = None
