"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bagminhash, bayes, cascade, entropy, languages, licences, mixing, order, paragraphs, resampling, sharding, trie, winnowing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bayes": bayes.op1_bayes,
    "op2_bagminhash": bagminhash.op2_bagminhash,
    "op3_paragraphs": paragraphs.op3_paragraphs,
    "op4_order": order.op4_order,
    "op5_languages": languages.op5_languages,
    "op6_licences": licences.op6_licences,
    "op7_cascade": cascade.op7_cascade,
    "op8_mixing": mixing.op8_mixing,
    "op9_entropy": entropy.op9_entropy,
    "op10_winnowing": winnowing.op10_winnowing,
    "op11_hashtree": sharding.op11_hashtree,
    "op12_resampling": resampling.op12_resampling,
    "op13_trie": trie.op13_trie,
}

ORACLES: dict[str, str] = {"op6_licences": licences.ORACLE, "op7_cascade": cascade.ORACLE, "op10_winnowing": winnowing.ORACLE, "op11_hashtree": sharding.ORACLE, "op12_resampling": resampling.ORACLE, "op13_trie": trie.ORACLE}
