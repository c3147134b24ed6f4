"""The training-corpus pipeline: quality rules, near-dedup, decontamination, mixing, token output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagegrain.llm import bagminhash, cascade, mixing, order, winnowing
from pagegrain.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that some rule rejects go."""
    return cascade.filtered(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return bagminhash.deduplicated(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by a benchmark item go."""
    return winnowing.decontaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each stretch of a document in each slot."""
    return mixing.mixed(spark, docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token sequences in training order."""
    return order.sequences(spark, docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mix_sources", mix_sources),
    ("token_output", token_output),
]

#: Near-dedup signatures, the pseudorandom mix and tokenisation have no SQL form; tests hold their classes, targets,
#: shard counts, permutation and token counts against plain Python instead, and rules and overlaps against SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all stages, each one's rows written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
