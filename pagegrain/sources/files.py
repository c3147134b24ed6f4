"""Files as tables: pages, histories, bookmarks, caches, benchmark logs, sitemaps, request lines, settings.

Readers are Spark's own, so they take any path Spark can read; only what a format needs beyond them is here.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

MAX_BYTES = 8_000_000
VISIT = "url string, title string, at timestamp"


def local_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, size): files as they are, what is over MAX_BYTES cut off."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.expr(f"substring(content, 1, {MAX_BYTES})").alias("content"), F.col("length").alias("size"))


def history(spark: SparkSession, path: str) -> DataFrame:
    """(url, title, at, pos) of JSON lines; broken lines and those without an address are skipped. pos: order in
    the files, by file name and place within it."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__f"), F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row")).alias("__i"))
    rows = lines.select(F.from_json("value", VISIT).alias("v"), "__f", "__i").where("v.url <> ''")
    return rows.select("v.url", "v.title", "v.at", F.struct("__f", "__i").alias("pos"))


def bookmarks(spark: SparkSession, path: str) -> DataFrame:
    """(url, title, at, pos) of one JSON array, or of a folder that sinks.write_bookmarks wrote; a file that can't be
    parsed has none."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.from_json("value", "array<struct<url: string, title: string, at: timestamp>>")).alias("pos", "b")).where("b.url <> ''").select("b.url", "b.title", "b.at", "pos")


def cache_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, changed) of a cache's files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("changed"))


def benchmark_log(spark: SparkSession, path: str) -> DataFrame:
    """benchmark_lines() of a log's files."""
    return benchmark_lines(spark.read.text(path))


def benchmark_lines(lines: DataFrame) -> DataFrame:
    """(name, ns, bytes, allocs) of the result lines among lines (value); remarks and other lines are skipped."""
    shape = r"^(Benchmark\S+?)-\d+\s+\d+\s+([\d.]+) ns/op(?:\s+([\d.]+) B/op)?(?:\s+(\d+) allocs/op)?"
    got = lambda i, kind: F.expr(f"try_cast(nullif(regexp_extract(value, '{shape.replace(chr(92), chr(92) * 2)}', {i}), '') as {kind})")
    return lines.where(~F.col("value").startswith("#") & F.col("value").rlike(shape)).select(F.regexp_extract("value", shape, 1).alias("name"), got(2, "double").alias("ns"), got(3, "double").alias("bytes"), got(4, "bigint").alias("allocs"))


def table_file(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """A corpus of addresses (comma) or an inventory (tab): columns by schema, broken rows skipped."""
    return spark.read.schema(schema).option("sep", sep).option("mode", "DROPMALFORMED").csv(path)


def sitemap(spark: SparkSession, path: str) -> DataFrame:
    """sitemap_pages() of a site map's files."""
    return sitemap_pages(spark.read.text(path, wholetext=True))


def sitemap_pages(whole: DataFrame) -> DataFrame:
    """(url): the pages of site maps (value), distinct; entries that are themselves .xml or .txt go."""
    return whole.select(F.explode(F.regexp_extract_all("value", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))).alias("url")).where(~F.col("url").rlike(r"\.(xml|txt)$")).distinct()


def requests(lines: DataFrame, order: str = "seq", session: str = "session") -> DataFrame:
    """(session, seq, id, method, params, bad) of request lines (session, seq, value), up to the second of two
    lines in a row that aren't requests."""
    from pyspark.sql import Window

    w = Window.partitionBy(session).orderBy(order)
    body = F.from_json("value", "id string, method string, params string")
    rows = lines.where("trim(value) <> ''").withColumn("__bad", F.try_parse_json("value").isNull())
    rows = rows.withColumn("__twice", (F.col("__bad") & F.lag("__bad", 1, False).over(w)).cast("int"))
    rows = rows.withColumn("__over", F.sum("__twice").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__twice")).where("__over = 0")
    return rows.select(session, order, body.alias("r"), F.col("__bad").alias("bad")).select(session, order, "r.id", "r.method", "r.params", "bad")


def release_info(texts: DataFrame, column: str = "value") -> DataFrame:
    """(tag, body, prerelease, assets) of a release endpoint's JSON; broken text gives nulls."""
    shape = "tag_name string, body string, prerelease boolean, assets array<struct<name: string, browser_download_url: string, size: bigint>>"
    return texts.select(F.from_json(column, shape).alias("r")).select(F.col("r.tag_name").alias("tag"), "r.body", "r.prerelease", "r.assets")


def settings(spark: SparkSession, text: str | None, defaults: dict[str, object]) -> DataFrame:
    """(name, value): a settings file (TOML text) over defaults, values as JSON. A broken file, an unknown name or a
    value of another type leaves the default."""
    import json
    import tomllib

    try:
        found = tomllib.loads(text or "")
    except tomllib.TOMLDecodeError:
        found = {}
    rows = [(k, json.dumps(found[k] if k in found and type(found[k]) is type(v) else v)) for k, v in sorted(defaults.items())]
    return spark.createDataFrame(rows, "name string, value string")


def decode(raw: bytes | None, declared: str | None = None) -> str | None:
    """Bytes as text: by the byte order mark, what the header declares, or a meta element in the first KB; where
    nothing is declared, as UTF-8 if valid (but for a character cut at the end), else as windows-1252."""
    import re

    if raw is None:
        return None
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if raw.startswith(mark):
            return raw.decode(name, "replace")
    head = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", declared or "", re.I)
    meta = re.search(rb"<meta[^>]+charset\s*=\s*[\"']?([\w.:-]+)", raw[:1024], re.I)
    name = head[1] if head else meta[1].decode("ascii", "replace") if meta else None
    if name is not None:
        try:
            # pages that declare Latin-1 or ASCII mean windows-1252
            return raw.decode("cp1252" if name.lower() in ("iso-8859-1", "latin1", "us-ascii", "windows-1252") else name, "replace")
        except (LookupError, UnicodeError):  # an unknown name, or a codec that isn't one of texts
            pass
    for cut in range(min(4, len(raw) + 1)):
        try:
            return raw[: len(raw) - cut].decode("utf-8") + "�" * bool(cut)
        except UnicodeDecodeError:
            continue
    return raw.decode("cp1252", "replace")


def decoded(frame: DataFrame, content: str = "content", declared: str | None = None) -> DataFrame:
    """frame with html, the content column as text."""
    ship(frame.sparkSession)

    def run(raw: pd.Series, said: pd.Series) -> pd.Series:
        return pd.Series([decode(bytes(r) if r is not None else None, s) for r, s in zip(raw, said, strict=True)], dtype=object)

    return frame.withColumn("html", F.pandas_udf(run, "string")(F.col(content), F.col(declared) if declared else F.lit(None).cast("string")))
