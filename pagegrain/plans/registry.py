"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code, text
from ..operators import extraction, fallback, markdown, memory, sessions
from . import composed, derived, indexed, lookups
from .relational import RELATIONAL
from .reports import REPORTS

Query = Callable[[SparkSession, str], DataFrame]


def _relational(tables: tuple[str, ...], text: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if not tables:
            return spark.sql(text.replace("{{", "{").replace("}}", "}"))
        return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})

    return run


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def q_doc_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown, each further line under a heading of its own."""
    docs = _documents(spark, sf_dir).select("doc_id", F.regexp_replace("text", "\n", "\n## The `next` part\n").alias("markdown"))
    return markdown.sections(docs, "doc_id")


def q_guess_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets (numbered below 0) and all documents."""
    snippets = spark.createDataFrame([(-1 - i, c) for i, c in enumerate(code.SAMPLES)], "sample bigint, code string")
    both = snippets.unionAll(_documents(spark, sf_dir).select("doc_id", "text"))
    return both.select("sample", code.guessed_language(F.col("code")).alias("lang"))


def q_resolve_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses without their scheme, as typed."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", text.resolved_input(F.regexp_replace("url", "^https?://", "")).alias("r")).select("page_id", "r.target", "r.is_search")


_DOC_SECTIONS = r"""select doc_id, ord::int as ord, 'the-next-part' as slug, 'The next part' as heading, regexp_replace(regexp_replace(line, '^\s+', ''), '\s+$', '') as body
from (select doc_id, unnest(l[2:]) as line, generate_subscripts(l[2:], 1) as ord from (select doc_id, string_split(text, chr(10)) as l from documents))"""
_SNIPPETS = ", ".join("({}, '{}')".format(-1 - i, c.replace("'", "'" * 2)) for i, c in enumerate(code.SAMPLES))

QUERIES: dict[str, Query] = {name: _relational(tables, text) for name, (tables, text, _) in (RELATIONAL | REPORTS).items()}
QUERIES |= {
    "extract_markdown": extraction.q_extract_markdown, "page_metrics": extraction.q_page_metrics,
    "page_blocks": extraction.q_page_blocks, "layout_lines": extraction.q_layout_lines, "page_headings": extraction.q_headings, "resolved_links": extraction.q_resolved_links,
    "nav_session_replay": sessions.q_nav_session_replay, "recent_pages": memory.q_recent_pages, "page_hints": fallback.q_page_hints, "link_spans": extraction.q_link_spans,
    "page_introductions": lambda spark, sf_dir: markdown.introductions(extraction.q_extract_markdown(spark, sf_dir)),
    "doc_sections": q_doc_sections, "guess_language": q_guess_language, "resolve_input": q_resolve_input,
}
ORACLES: dict[str, str] = {name: duck for name, (_, _, duck) in (RELATIONAL | REPORTS).items()}
ORACLES |= {
    "doc_sections": _DOC_SECTIONS,
    "guess_language": code.duckdb_guess(f"select sample, code from (values {_SNIPPETS}) as t(sample, code) union all select doc_id, text from documents"),
    "resolve_input": "select page_id, 'https://' || regexp_replace(url, '^https?://', '') as target, false as is_search from pages",
}
QUERIES |= derived.QUERIES | indexed.QUERIES | composed.QUERIES | lookups.QUERIES  # what reads the tables takes the place of what read literals
ORACLES |= derived.ORACLES | indexed.ORACLES | composed.ORACLES | lookups.ORACLES
FLAGSHIP = extraction.q_page_metrics
