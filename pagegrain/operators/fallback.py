"""Pages that scripts draw, replaced by another version of themselves where one says more: left joins on address."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.shell import NOTICE, read
from ..session import pieces, ship

_OUT = "page_id bigint, url string, title string, markdown string, body_words int, is_shell boolean, hints array<string>, text_url string, amp_url string"


def read_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, markdown, body_words, is_shell, hints, text_url, amp_url) of pages (page_id, url, html)."""
    ship(pages.sparkSession)
    schema = to_arrow_schema(StructType.fromDDL(_OUT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.RecordBatch.from_pylist([{"page_id": r["page_id"], "url": r["url"]} | read(r["html"], r["url"]) for r in batch.to_pylist()], schema=schema)

    return pages.select("page_id", "url", "html").mapInArrow(run, _OUT)


def with_fallbacks(pages: DataFrame, versions: DataFrame, rendered: DataFrame) -> DataFrame:
    """(page_id, url, title, markdown, body_words, is_shell, version) of pages. versions and rendered (page_id, url,
    html) hold other versions by their own address, and drawn pages by the page's; one row an address (of several,
    the least page_id). A drawn page takes its text version, then its AMP version, where that has more words, until
    one isn't drawn by scripts; then its rendered form where that has more words than the page without notice.
    Only pages that need one are joined; keys without a partner are spread, so they make no hot one."""
    base = read_pages(pages)

    def other(frame: DataFrame, name: str) -> DataFrame:
        one = read_pages(frame.where("url is not null")).groupBy("url").agg(F.min_by(F.struct("markdown", "body_words", "is_shell"), "page_id").alias(name))
        return one.withColumnRenamed("url", f"__{name}_key")

    spread = F.concat(F.lit("\0"), F.col("page_id").cast("string"))
    wanted = lambda c: F.coalesce(F.when(F.col("is_shell") & F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col("url") if c != "url" else F.lit(None)), F.col(c)), spread)
    joined = base
    for name, column, frame in (("text", "text_url", versions), ("amp", "amp_url", versions), ("drawn", "url", rendered)):
        side = other(frame, name)
        joined = joined.join(side, wanted(column) == F.col(f"__{name}_key"), "left").drop(f"__{name}_key")
    notice = len(NOTICE.split())
    now = joined.select("page_id", "url", "title", F.struct("markdown", "body_words", "is_shell", F.lit("page").alias("version")).alias("now"), "text", "amp", "drawn")
    for name, less in (("text", 0), ("amp", 0), ("drawn", notice)):
        better = F.col("now.is_shell") & F.col(name).isNotNull() & (F.col(f"{name}.body_words") > F.col("now.body_words") - less)
        took = F.struct(F.col(f"{name}.markdown").alias("markdown"), F.col(f"{name}.body_words").alias("body_words"), F.col(f"{name}.is_shell").alias("is_shell"), F.lit(name).alias("version"))
        now = now.withColumn("now", F.when(better, took).otherwise(F.col("now")))
    return now.select("page_id", "url", "title", "now.*")


def cacheable(read: DataFrame) -> DataFrame:
    """Pages to keep: those of the web that aren't bare shells."""
    return read.where("url rlike '^https?://' and not is_shell")


def q_page_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("markdown")
