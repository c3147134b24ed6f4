"""Tables to files: histories, bookmarks, caches, replies, results, search entries.

Computed frames are written beside the old ones, as Spark's committers do; a caller swaps paths. Nothing that is
read is overwritten in the same job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def append_history(visits: DataFrame, path: str) -> None:
    """(url, title, at) as further JSON lines."""
    visits.where("url <> ''").select("url", "title", "at").write.mode("append").json(path)


def rewrite_history(visits: DataFrame, path: str) -> None:
    """(url, title, at) as the whole history: written beside the old one, which then goes, so that visits may be computed from it."""
    spark = visits.sparkSession
    beside = f"{path}.new"
    visits.where("url <> ''").select("url", "title", "at").write.mode("overwrite").json(beside)
    new, old = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (beside, path))
    fs = new.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise OSError(f"{beside} can't take the place of {path}")


def write_bookmarks(marks: DataFrame, path: str) -> None:
    """(url, title, at, pos) as one JSON array in order of pos: bookmarks are what a person keeps, some thousand
    rows. A person's list is one value of one row, aggregated by Spark; no rows give an empty array."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("pos", "url", "title", "at"))), lambda r: F.struct(r.url.alias("url"), r.title.alias("title"), r["at"].alias("at")))
    marks.where("url <> ''").agg(F.to_json(rows).alias("value")).write.mode("overwrite").text(path)


def cache_key(url, version: str = "1"):
    return F.substring(F.sha2(F.concat(F.lit(version + "|"), url), 256), 1, 32)


def upserted(cache: DataFrame, pages: DataFrame, key: str = "url") -> DataFrame:
    """cache (url, content, saved) with pages' rows in place of its own: the latest a key, a new one on ties. Another key than
    the url is a further column of both, and of the result."""
    cols = list(dict.fromkeys([key, "url", "content", "saved"]))
    both = cache.select(*cols, F.lit(0).alias("__new")).unionByName(pages.select(*cols, F.lit(1).alias("__new")))
    latest = Window.partitionBy(key).orderBy(F.desc_nulls_last("saved"), F.desc("__new"), F.desc_nulls_last("content"))
    return both.where(F.col(key).isNotNull()).withColumn("__r", F.row_number().over(latest)).where("__r = 1").select(*cols)


def deleted(rows: DataFrame, urls: DataFrame, key: str = "url") -> DataFrame:
    return rows.join(urls.select(key).distinct(), key, "left_anti")


def pruned(cache: DataFrame, now, days: int = 30) -> DataFrame:
    return cache.where(F.col("saved") > F.lit(now) - F.expr(f"interval {int(days)} days"))


def replies(results: DataFrame, modern: bool = True, keep: str = "id") -> DataFrame:
    """(keep, reply) of (id, result, error): one JSON message a row. A legacy reply carries its result as text."""
    good = F.struct(F.lit("2.0").alias("jsonrpc"), "id", (F.struct(F.array(F.struct(F.lit("text").alias("type"), F.col("result").alias("text"))).alias("content"), F.lit(False).alias("isError")) if modern else F.col("result")).alias("result"))
    bad = F.struct(F.lit("2.0").alias("jsonrpc"), "id", F.struct(F.lit(-32000).alias("code"), F.col("error").alias("message")).alias("error"))
    return results.select(keep, F.when(F.col("error").isNull(), F.to_json(good)).otherwise(F.to_json(bad)).alias("reply"))


#: Error codes of the protocol, by what went wrong.
CODES = {"parse": -32700, "request": -32600, "method": -32601, "params": -32602, "internal": -32603}


def envelopes(results: DataFrame, server: str, version: str, modern: bool = True, keep: str = "id") -> DataFrame:
    """(keep, reply) of (id, result, problem, message): one JSON message a row. result is an object's JSON without its braces (null: an empty object), problem a name in
    CODES (null: none; any other is an internal one). A modern reply says that its result is complete, and of whom it comes. What has no id is a
    notification and has no row."""
    code = F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])
    head = F.concat(F.lit('{"jsonrpc":"2.0",'), F.regexp_replace(F.to_json(F.struct("id")), r"\A\{|\}\z", ""), F.lit(","))
    body = F.coalesce("result", F.lit(""))
    who = F.to_json(F.struct(F.struct(F.lit(server).alias("name"), F.lit(version).alias("version")).alias("server")))
    more = F.concat(F.when(body == "", "").otherwise(","), F.lit('"resultType":"complete","_meta":'), who) if modern else F.lit("")
    good = F.concat(F.lit('"result":{'), body, more, F.lit("}}"))
    error = F.to_json(F.struct(F.coalesce(F.try_element_at(code, F.col("problem")), F.lit(CODES["internal"])).alias("code"), F.coalesce("message", F.lit("")).alias("message")))
    bad = F.concat(F.lit('"error":'), error, F.lit("}"))
    return results.where("id is not null").select(keep, F.concat(head, F.when(F.col("problem").isNull(), good).otherwise(bad)).alias("reply"))


def write_report(report: DataFrame, path: str) -> None:
    """A report as JSON, and as CSV with nested columns as text and texts cut to 200 characters."""
    report.write.mode("overwrite").json(f"{path}/json")
    flat = [F.to_json(c).alias(c) if kind.startswith(("array", "map", "struct")) else F.left(c, F.lit(200)).alias(c) if kind == "string" else F.col(c) for c, kind in report.dtypes]
    report.select(*flat).write.mode("overwrite").option("header", "true").csv(f"{path}/csv")


def _escaped(text):
    """Text in XML."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def feed_items(releases: DataFrame, title: str, base: str, keep: str | None = None) -> DataFrame:
    """(version, item[, keep]) of releases (version, released, plain): a feed's item as XML. A release without a date is of the epoch."""
    date = F.date_format(F.coalesce(F.col("released").cast("timestamp"), F.timestamp_seconds(F.lit(0))), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    link = _escaped(F.concat(F.lit(f"{base}/v"), "version", F.lit("/")))
    item = tag("item", F.concat(tag("title", _escaped(F.concat(F.lit(f"{title} "), "version"))), tag("link", link), tag("pubDate", date), tag("description", _escaped(F.coalesce("plain", F.lit(""))))))
    return releases.select("version", item.alias("item"), *([keep] if keep else []))


def write_feed(items: DataFrame, path: str, title: str) -> None:
    """feed_items() (version, item, ord) as one RSS file: releases are what people write, some thousand rows, in one task, in order of ord."""
    spark = items.sparkSession
    edge = spark.createDataFrame([(0, 0, f'<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>{title}</title>'), (2, 0, "</channel></rss>")], "part int, ord bigint, item string")
    rows = edge.unionByName(items.select(F.lit(1).alias("part"), F.col("ord").cast("long").alias("ord"), "item"))
    rows.coalesce(1).sortWithinPartitions("part", "ord").select("item").write.mode("overwrite").text(path)


def text_map(entries: DataFrame, base: str) -> DataFrame:
    """(doc, text) of entries (doc, label, blurb, ord, section, title, summary): a document's part of the map that a language model reads first, a line a
    section in order of ord, the index section left out; without a summary the document's blurb."""
    line = F.concat(F.lit("- ["), "title", F.lit(f"]({base}/"), "doc", F.lit("/"), "section", F.lit("/): "), F.coalesce(F.nullif("summary", F.lit("")), "blurb"))
    rows = entries.where("section <> 'index'").select("doc", "label", "blurb", F.struct("ord", line.alias("line")).alias("l"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x.line), "\n")
    whole = rows.groupBy("doc").agg(F.min("label").alias("label"), F.min("blurb").alias("blurb"), lines.alias("lines"))
    return whole.select("doc", F.concat(F.lit("## "), "label", F.lit("\n\n"), "blurb", F.lit("\n\n"), "lines").alias("text"))


def write_search_entries(sections: DataFrame, path: str, key: str = "page_id") -> None:
    """Sections (key, ord, slug, heading, body) as search entries, a JSON object a line."""
    sections.select(F.concat(F.col(key).cast("string"), F.lit("#"), "slug").alias("href"), F.col("heading").alias("title"), F.lower("body").alias("body")).write.mode("overwrite").json(path)
