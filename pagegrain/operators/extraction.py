"""Pages to extracted documents, their blocks, and quality metrics. Pages are parsed once, in one pass."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.html import extract
from ..session import pieces, ship
from . import markdown

_DDL = "page_id bigint, url string, title string, root_kind string, is_shell boolean, markdown string, words int, blocks array<struct<kind: string, text: string>>"
_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("title", pa.string()), ("root_kind", pa.string()), ("is_shell", pa.bool_()), ("markdown", pa.string()), ("words", pa.int32()), ("blocks", pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())])))])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        rows = [{"page_id": r["page_id"], "url": r["url"]} | extract(r["html"], r["url"]) for r in batch.to_pylist()]
        yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, root_kind, is_shell, markdown, words, blocks) of pages (page_id, url, html)."""
    ship(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInArrow(_extracted, _DDL)


def _with_source(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        for found in _extracted([batch]):
            yield pa.RecordBatch.from_arrays([*found.columns, batch.column("html")], schema=_SCHEMA.append(pa.field("html", pa.string())))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def page_text(html: Column) -> Column:
    """A page's text by patterns alone, furniture included: what extraction is measured against."""
    for pattern in (r"(?is)<(script|style|noscript|svg|template)[^>]*>.*?</\1>", r"(?s)<!--.*?-->", r"(?s)<[^>]+>"):
        html = F.regexp_replace(html, pattern, " ")
    for name, by in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        html = F.replace(html, F.lit(name), F.lit(by))
    return F.trim(F.regexp_replace(html, r"\s+", " "))


def sampled_sentences(text: Column, most: int = 40, least: int = 50) -> Column:
    """Up to `most` sentences of `least` characters and more, at even distances."""
    long = F.filter(F.split(text, r"[.!?]\s+"), lambda x: F.length(x) >= least)
    return F.transform(F.array(long), lambda s: F.when(F.size(s) <= most, s).otherwise(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get(s, F.floor(i * F.size(s) / most).cast("int")))))[0]


def metrics(pages: DataFrame) -> DataFrame:
    """A row for each row of pages (page_id, url, html), in one pass over them: page_id, url, title, root_kind, orig_words and md_words
    (distinct words of the page and of its Markdown), word_recall, word_precision, sentence_recall (of sampled sentences of
    the page, those whose first 60 characters the Markdown holds; null without sentences), md_vs_orig_ratio (of all
    words), leaks and leak_total (page furniture's words), and counts of the Markdown's structure."""
    ship(pages.sparkSession)
    both = pages.select("page_id", "url", "html").mapInArrow(_with_source, _DDL + ", html string")
    both = both.withColumn("source", page_text(F.coalesce("html", F.lit("")))).drop("html", "blocks")
    both = both.withColumn("all_orig", _words(F.col("source"))).withColumn("all_md", _words(F.col("markdown")))
    both = both.withColumn("orig", F.array_distinct("all_orig")).withColumn("md", F.array_distinct("all_md")).withColumn("common", F.size(F.array_intersect("orig", "md")))
    flat = F.lower(F.regexp_replace("markdown", r"\s+", " "))
    probes = F.transform(sampled_sentences(F.col("source")), lambda x: F.left(F.lower(F.regexp_replace(x, r"\s+", " ")), F.lit(60)))
    both = both.withColumn("probes", probes).withColumn("flat", flat).withColumn("leaks", markdown.leaks(F.col("markdown")))
    part = lambda a, b: F.round(a / F.greatest(b, F.lit(1)), 3)
    held = F.size(F.filter("probes", lambda p: (F.length(p) >= 30) & F.contains(F.col("flat"), p)))
    total = F.aggregate(F.map_values("leaks"), F.lit(0), lambda s, x: s + x)
    return both.select(
        "page_id", "url", "title", "root_kind", F.size("orig").alias("orig_words"), F.size("md").alias("md_words"),
        part(F.col("common"), F.size("orig")).alias("word_recall"), part(F.col("common"), F.size("md")).alias("word_precision"),
        F.when(F.size("probes") > 0, F.round(held / F.size("probes"), 3)).alias("sentence_recall"), part(F.size("all_md"), F.size("all_orig")).alias("md_vs_orig_ratio"),
        "leaks", total.alias("leak_total"), *markdown.structure(F.col("markdown")),
    )


#: What extraction takes out of every page, in its order: names and patterns.
RULES = (("comments", r"(?s)<!--.*?-->"), ("scripts", r"(?is)<(script|style)[^>]*>.*?</(script|style)>"), ("nav", r"(?is)<nav[^>]*>.*?</nav>"), ("footer", r"(?is)<footer[^>]*>.*?</footer>"))


def rule_words(pages: DataFrame) -> DataFrame:
    """(page_id, rule, words): how many words of pages (page_id, html) each rule takes that no earlier one took."""
    count = lambda c: F.size(F.filter(F.split(F.regexp_replace(c, r"(?s)<[^>]+>", " "), r"\s+"), lambda w: w != ""))
    left, names = pages.select("page_id", F.col("html").alias("h0")), []
    for i, (name, pattern) in enumerate(RULES):
        left = left.withColumn(f"h{i + 1}", F.regexp_replace(f"h{i}", pattern, " "))
        names.append(F.struct(F.lit(name).alias("rule"), (F.col(f"n{i}") - F.col(f"n{i + 1}")).alias("words")))
    for i in range(len(RULES) + 1):
        left = left.withColumn(f"n{i}", count(f"h{i}"))
    return left.select("page_id", F.explode(F.array(*names)).alias("r")).select("page_id", "r.rule", "r.words")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of pages; where its files make fewer tasks than there are cores, its rows are dealt out anew, as a page costs far more to extract than to move."""
    pages, cores = spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.sparkContext.defaultParallelism
    return pages.repartition(cores) if pages.rdd.getNumPartitions() < cores else pages


def q_extract_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(_pages(spark, sf_dir)).drop("blocks")


def q_page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(_pages(spark, sf_dir)).select("page_id", F.posexplode("blocks").alias("ord", "b")).select("page_id", "ord", "b.kind", "b.text")


def q_page_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(_pages(spark, sf_dir))


_LINES = "page_id bigint, line int, kind string, soft boolean, text string"


def laid_out(pages: DataFrame, width: int = 80) -> DataFrame:
    """(page_id, line, kind, soft, text): extracted pages as lines of a width."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..functions.layout import lines

        schema = pa.schema([("page_id", pa.int64()), ("line", pa.int32()), ("kind", pa.string()), ("soft", pa.bool_()), ("text", pa.string())])
        for batch in pieces(batches):
            rows = []
            for r in batch.to_pylist():
                found = [(b["kind"], b["text"]) for b in extract(r["html"], r["url"])["blocks"]]
                rows.extend({"page_id": r["page_id"], "line": i, "kind": k, "soft": s, "text": t} for i, (k, s, t) in enumerate(lines(found, width)))
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return pages.select("page_id", "url", "html").mapInArrow(run, _LINES)


def link_spans(pages: DataFrame, width: int = 80) -> DataFrame:
    """(page_id, line, start, stop, link, target): where the links of laid-out pages stand, in cells."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..functions.layout import spans

        names = ("line", "start", "stop", "link", "target")
        schema = pa.schema([("page_id", pa.int64()), *((n, pa.int32()) for n in names[:4]), ("target", pa.string())])
        for batch in pieces(batches):
            rows = [{"page_id": r["page_id"]} | dict(zip(names, x, strict=True)) for r in batch.to_pylist() for x in spans([(b["kind"], b["text"]) for b in extract(r["html"], r["url"])["blocks"]], width)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id bigint, line int, start int, stop int, link int, target string")


def code_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, ord, lang, guessed, code): code blocks; where no language is declared, one that is sure is guessed."""
    from ..functions.code import guessed_language

    found = extracted(pages).select("page_id", F.posexplode("blocks").alias("ord", "b")).where("b.kind = 'code'")
    shape = r"(?s)\A`{3,}([^\n]*)\n(.*)\n`{3,}\z"
    found = found.select("page_id", "ord", F.regexp_extract("b.text", shape, 1).alias("said"), F.regexp_extract("b.text", shape, 2).alias("code"))
    guess = F.when(F.col("said") == "", guessed_language(F.col("code"))).otherwise("")
    return found.select("page_id", "ord", F.coalesce(F.nullif("said", F.lit("")), guess).alias("lang"), (guess != "").alias("guessed"), "code")


def highlighted(blocks: DataFrame) -> DataFrame:
    """blocks (page_id, ord, lang, code) with tokens, an array of (kind, text) that joins to the code: each distinct
    code of a language is read once, then joined back by its digest."""
    ship(blocks.sparkSession)

    def run(code: pd.Series) -> pd.Series:
        from ..functions.tokens import tokens

        return pd.Series([[{"kind": k, "text": t} for k, t in tokens(c)] if c is not None else None for c in code], dtype=object)

    keyed = blocks.withColumn("__k", F.sha2(F.concat_ws("\0", F.coalesce("lang", F.lit("")), "code"), 256))
    once = keyed.groupBy("__k").agg(F.any_value("code").alias("__c")).select("__k", F.pandas_udf(run, "array<struct<kind: string, text: string>>")("__c").alias("tokens"))
    return keyed.join(once, "__k").drop("__k")


def resolved(links: DataFrame) -> DataFrame:
    """links (url, href, ...) with target and followed; each distinct pair is resolved once a batch."""
    ship(links.sparkSession)

    def run(url: pd.Series, href: pd.Series) -> pd.DataFrame:
        from ..functions.links import resolve

        seen = {p: resolve(*p) for p in set(zip(url, href, strict=True))}
        return pd.DataFrame([seen[p] for p in zip(url, href, strict=True)], columns=["target", "followed"])

    return links.withColumn("r", F.pandas_udf(run, "target string, followed boolean")("url", "href")).select(*links.columns, "r.target", "r.followed")


def q_layout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return laid_out(_pages(spark, sf_dir))


def q_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = q_page_blocks(spark, sf_dir).where("kind = 'heading'")
    return found.select("page_id", "ord", F.expr("cast(length(regexp_extract(text, '^(#+)', 1)) as int)").alias("level"), F.expr("regexp_replace(text, '^#+ ', '')").alias("text"))


#: An anchor's address: any order of attributes, in double, single or no quotes, in any case.
ANCHOR = r"""(?i)<a\s(?:[^>"']|"[^"]*"|'[^']*')*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


#: What holds no anchors: comments, and elements whose content is text. An unclosed one goes on to the end.
NO_MARKUP = r"(?is)<!--.*?(?:-->|\z)|<(script|style|xmp|iframe|noembed|noframes|title|textarea)\b.*?(?:</\1\s*>|\z)"
#: Entities with names that occur in addresses.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}


def unescaped(text: Column) -> Column:
    """Numbered entities and ENTITIES as characters; others, and numbers that are no characters, stay. One pass: what comes out of an entity isn't read again."""
    number = r"\A(?:[xX]([0-9a-fA-F]{1,6})|([0-9]{1,7}));?"

    def part(x: Column, i: Column) -> Column:
        code = F.coalesce(F.conv(F.nullif(F.regexp_extract(x, number, 1), F.lit("")), 16, 10), F.nullif(F.regexp_extract(x, number, 2), F.lit(""))).cast("bigint")
        fits = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        made = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(i == 0, named(x)).when(fits, F.concat(made, named(F.regexp_replace(x, number, "")))).otherwise(F.concat(F.lit("&#"), named(x)))

    def named(x: Column) -> Column:
        for k, v in ENTITIES.items():
            x = F.replace(x, F.lit(k), F.lit(v))
        return x

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(F.split(text, "&#"), part), "")).otherwise(text)


def anchors(pages: DataFrame) -> DataFrame:
    """(page_id, url, ord, href) of the anchors of pages (page_id, url, html) that have an address, in order: entities read, none out of comments, scripts
    and other elements of text alone."""
    html = F.regexp_replace("html", NO_MARKUP, "")
    rows = pages.select("page_id", "url", html.alias("html"))
    got = [F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(i)) for i in (1, 2, 3)]
    href = F.transform(F.arrays_zip(*[g.alias(f"g{i}") for i, g in enumerate(got)]), lambda x: unescaped(F.concat(x.g0, x.g1, x.g2)))
    return rows.select("page_id", "url", F.posexplode(href).alias("ord", "href"))


def link_kind(href: Column) -> Column:
    """What a link is: an anchor, a file, a page of the web, or unsupported."""
    web = F.lower(href).rlike("^https?://") | href.startswith("/")
    return F.when(href == "", "unsupported").when(href.startswith("#"), "anchor").when(F.lower(href).startswith("file:"), "file").when(web, "web").when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), "unsupported").otherwise("web")


def destinations(links: DataFrame) -> DataFrame:
    """(page_id, href, link_id, n) of links (page_id, ord, href): a page's distinct destinations, numbered from 1 by their first place."""
    found = links.groupBy("page_id", "href").agg(F.min("ord").alias("first"), F.count("*").alias("n"))
    number = F.row_number().over(Window.partitionBy("page_id").orderBy("first", "href"))
    return found.select("page_id", "href", number.alias("link_id"), "n")


def q_resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(anchors(_pages(spark, sf_dir)))


def q_link_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, their navigation and article tags taken off: the generated links all stand in navigation, which extraction drops."""
    return link_spans(_pages(spark, sf_dir).withColumn("html", F.regexp_replace("html", "</?(nav|article)>", "")))
