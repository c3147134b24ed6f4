"""Recently used pages under a budget of entries and of bytes, and what a refresh or a release has to tell."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .folds import ordered_fold

PAGES, BYTES = 24, 24 << 20


class _Recent:
    def __init__(self) -> None:
        self.sizes: OrderedDict[str, int] = OrderedDict()
        self.total = 0


def recent_pages(accesses: DataFrame, pages: int = PAGES, room: int = BYTES) -> DataFrame:
    """(session, seq, hit, n_kept, kept_bytes, evicted) after each of accesses (session, seq, url, size). A hit
    makes a page the latest and keeps its size; a miss stores it, evicting the least recently used ones while a
    budget is exceeded. An empty or oversized page, or one not from the web, isn't stored."""
    out = StructType.fromDDL("session bigint, seq bigint, hit boolean, n_kept int, kept_bytes bigint, evicted array<string>")

    def step(m: _Recent, r: dict) -> list[dict]:
        url, size, gone = r["url"] or "", r["size"] or 0, []
        hit = url in m.sizes
        if hit:
            m.sizes.move_to_end(url)
        elif url.startswith(("http://", "https://")) and 0 < size <= room:
            m.sizes[url] = size
            m.total += size
            while len(m.sizes) > pages or m.total > room:
                old, n = m.sizes.popitem(last=False)
                m.total -= n
                gone.append(old)
        return [{"session": r["session"], "seq": r["seq"], "hit": hit, "n_kept": len(m.sizes), "kept_bytes": m.total, "evicted": gone}]

    return ordered_fold(accesses.select("session", "seq", "url", F.col("size").cast("long").alias("size")), "session", "seq", _Recent, step, out)


def refreshed(cached: DataFrame, fetched: DataFrame, now, fresh_seconds: int = 120, keep_days: int = 30, key: Sequence[str] = ("url",)) -> DataFrame:
    """(url, serve, newer): for each cached (url, content, saved), whether it is served (fresh, stale or expired),
    and whether what was fetched since (url, content) differs; not fetched: not newer. key: the columns by which both
    meet. A cached row gives one row, whatever its key was fetched: newer if any of it differs."""
    digest = lambda c: F.sha2(F.coalesce(c, F.lit("")), 256)
    age = F.unix_timestamp(F.lit(now)) - F.unix_timestamp("saved")
    serve = F.when(age < fresh_seconds, "fresh").when(age < keep_days * 86400, "stale").otherwise("expired")
    old = cached.select(*dict.fromkeys([*key, "url"]), serve.alias("serve"), digest(F.col("content")).alias("__old"))
    new = fetched.groupBy(*key).agg(F.min(digest(F.col("content"))).alias("__least"), F.max(digest(F.col("content"))).alias("__most"))
    differs = (F.col("__old") != F.col("__least")) | (F.col("__old") != F.col("__most"))
    return old.join(new, [*key], "left").select("url", "serve", F.coalesce(differs, F.lit(False)).alias("newer"))


def announcements(checks: DataFrame) -> DataFrame:
    """(session, seq, version) of checks (session, seq, version): each version once a session, when first seen."""
    w = Window.partitionBy("session", "version").orderBy("seq")
    return checks.where("version is not null").withColumn("__n", F.row_number().over(w)).where("__n = 1").select("session", "seq", "version")


def q_recent_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    url = F.concat(F.lit("https://"), F.col("event_type"), F.lit(".example/"), (F.col("event_id") % 7).cast("string"))
    return recent_pages(events.select(F.col("user_id").cast("long").alias("session"), F.col("event_id").alias("seq"), url.alias("url"), (F.length("event_type") * 100).alias("size")), pages=8, room=4000)
