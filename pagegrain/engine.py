"""The tool surface: one method a tool, each from tables to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .operators import extraction, fallback, sessions
from .sources import sinks

_MD_LINK = r"(?<!!)\[([^\]]*)\]\(([^)\s]*)\)"


class Engine:
    """Reading tools over pages (page_id, url, html); state tools over visits and bookmarks (url, title, at, pos),
    where pos is the order in which they were written."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def read(self, pages: DataFrame, strip_links: bool = False) -> DataFrame:
        """(page_id, url, title, bytes, markdown)."""
        body = F.col("markdown")
        body = F.regexp_replace(body, r"!?\[([^\]]*)\]\([^)]*\)", "$1") if strip_links else body
        return fallback.read_pages(pages).select("page_id", "url", "title", F.octet_length(body).alias("bytes"), body.alias("markdown"))

    def render(self, pages: DataFrame, width: int = 80) -> DataFrame:
        """(page_id, lines, headings, text): a page laid out; its lines are its own, so a page is one row."""
        rows = extraction.laid_out(pages, max(20, min(width, 400))).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("line", "kind", "soft", "text"))).alias("r"))
        heads = F.size(F.filter("r", lambda x: (x.kind == "heading") & ~x.soft))
        return rows.select("page_id", F.size("r").alias("lines"), heads.alias("headings"), F.array_join(F.transform("r", lambda x: x["text"]), "\n").alias("text"))

    def links(self, pages: DataFrame) -> DataFrame:
        """(page_id, ord, text, href, kind): a page's distinct destinations in reading order."""
        found = fallback.read_pages(pages)
        pairs = F.arrays_zip(F.regexp_extract_all("markdown", F.lit(_MD_LINK), F.lit(1)).alias("text"), F.regexp_extract_all("markdown", F.lit(_MD_LINK), F.lit(2)).alias("href"))
        rows = found.select("page_id", F.posexplode(pairs).alias("ord", "l")).groupBy("page_id", "l.href").agg(F.min("ord").alias("first"), F.min_by("l.text", "ord").alias("text"))
        kind = F.when(F.col("href") == "", "unsupported").when(F.col("href").startswith("#"), "anchor").when(F.col("href").startswith("file:"), "file").when(F.col("href").rlike(r"^(?!https?://)[a-zA-Z][a-zA-Z0-9+.-]*:"), "unsupported").otherwise("web")
        return rows.select("page_id", F.row_number().over(Window.partitionBy("page_id").orderBy("first")).alias("ord"), "text", "href", kind.alias("kind"))

    def resolve_input(self, typed: DataFrame, column: str = "input", engine: str = "duckduckgo") -> DataFrame:
        """typed with target, is_search and template."""
        r = T.resolved_input(F.col(column), engine)
        return typed.withColumn("__r", r).select(*typed.columns, F.col("__r.target").alias("target"), F.col("__r.is_search").alias("is_search"), F.lit(T.ENGINES.get(engine, engine if "%s" in engine else T.ENGINES["duckduckgo"])).alias("template"))

    def history(self, visits: DataFrame, limit: int = 50, words: str = "") -> DataFrame:
        """(url, title, at): of the newest `limit` addresses, each with its latest visit, those that hold `words` in
        address or title. The limit comes first."""
        latest = Window.partitionBy("url").orderBy(F.desc("pos"))
        newest = visits.withColumn("__r", F.row_number().over(latest)).where("__r = 1").orderBy(F.desc("pos")).limit(limit if limit > 0 else 50)
        q = F.lit(words.strip().lower())
        return newest.where(F.contains(F.lower("url"), q) | F.contains(F.lower(F.coalesce("title", F.lit(""))), q)).select("url", "title", "at")

    def bookmarks(self, marks: DataFrame) -> DataFrame:
        return marks.orderBy(F.desc("pos")).select("url", "title", "at")

    def bookmark_toggle(self, marks: DataFrame, url: str, title: str, at) -> DataFrame:
        """marks without url where it was there, else with it as the last."""
        one = self.spark.range(1).select(F.lit(url).alias("url"), F.lit(title).alias("title"), F.lit(at).cast("timestamp").alias("at"))
        last = marks.agg(F.max("pos").alias("__last"), F.coalesce(F.max((F.col("url") == url).cast("int")), F.lit(0)).alias("__has"))
        new = one.join(F.broadcast(last)).where("__has = 0").select("url", "title", "at", (F.coalesce("__last", F.lit(-1)) + 1).alias("pos"))
        return marks.where(F.col("url") != url).select("url", "title", "at", "pos").unionByName(new)

    def delete(self, rows: DataFrame, url: str) -> DataFrame:
        """History or bookmarks without an address."""
        return rows.where(~F.col("url").eqNullSafe(url))

    def clear(self, rows: DataFrame) -> DataFrame:
        return rows.limit(0)

    def cache_stats(self, cache: DataFrame) -> DataFrame:
        return cache.agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("size"))

    def cache_put(self, cache: DataFrame, pages: DataFrame, at) -> DataFrame:
        """cache with what read_pages gives for pages: those of the web that aren't bare shells."""
        new = fallback.cacheable(fallback.read_pages(pages)).select("url", F.col("markdown").alias("content"), F.lit(at).cast("timestamp").alias("saved"))
        return sinks.upserted(cache, new)

    def navigate(self, events: DataFrame) -> DataFrame:
        """Sessions after each of their events."""
        return sessions.replay(events)

    def config_set(self, config: DataFrame, changes: dict[str, object]) -> DataFrame:
        """config (name, value as JSON) with changes; an unknown name or a value of another type is an error."""
        import json

        held = {r.name: json.loads(r.value) for r in config.collect()}  # a settings table: some dozen rows
        for name, value in changes.items():
            if name not in held:
                raise ValueError(f"unknown setting: {name}")
            if type(value) is not type(held[name]):
                raise ValueError(f"{name}: expected {type(held[name]).__name__}")
        return self.spark.createDataFrame([(k, json.dumps(changes.get(k, v))) for k, v in sorted(held.items())], "name string, value string")
