"""Stale while revalidate, as a stream: pages fetched anew are held against the cache store, told as newer where their content differs, and stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import CacheStore


def _done(spark: SparkSession, path: str) -> bool:
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def refreshed_batch(store: CacheStore, fetched: DataFrame, batch: int, out: str) -> None:
    """One batch of fetched (url, content, saved): out/batch=N gets (url, newer), newer where the store holds another content (an address that it doesn't hold is no
    newer one); then the store takes the pages. A batch that comes again finds its rows written and changes nothing: they tell what it found the first time, and storing
    the same pages twice is storing them once."""
    spark = store.spark
    folder = f"{out}/batch={batch}"
    latest = fetched.where("url is not null").groupBy("url").agg(F.max_by(F.struct("content", "saved"), F.struct("saved", "content")).alias("p")).select("url", "p.content", "p.saved")
    if not _done(spark, folder):
        digest = lambda c: F.sha2(F.coalesce(c, F.lit("")), 256)
        held = store.get(latest.select("url")).select("url", digest(F.col("content")).alias("held"))
        told = latest.select("url", digest(F.col("content")).alias("now")).join(held, "url", "left")
        told.select("url", F.coalesce(F.col("held") != F.col("now"), F.lit(False)).alias("newer")).write.mode("overwrite").parquet(folder)
    store.put(latest)


def refresh_stream(fetched: DataFrame, store: CacheStore, out: str, checkpoint: str) -> StreamingQuery:
    """A running query over a stream fetched (url, content, saved); see refreshed_batch."""
    return fetched.writeStream.foreachBatch(lambda rows, n: refreshed_batch(store, rows, n, out)).option("checkpointLocation", checkpoint).start()


def told(spark: SparkSession, out: str) -> DataFrame:
    """(url, newer, batch) of all batches."""
    return spark.read.schema("url string, newer boolean, batch bigint").parquet(out)
