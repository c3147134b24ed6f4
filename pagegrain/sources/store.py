"""The page cache as a table in folders by the first digits of its keys: a lookup reads the folders of its keys, a change rewrites those it touches.

An entry is (key, url, header, saved, content, size). The key is a hash of version and address; the header, checked on reading, holds both, so
that an entry of another version, or of an address with the same key, is no hit. Rows are staged before a folder is replaced: what is read is
never what is being overwritten, and a job that fails leaves the old folders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .sinks import cache_key
from .tables import own_path, removed

#: The version of the stored form, days that an entry lives, seconds between two prunings.
VERSION, DAYS, PRUNE_EVERY = "2", 30, 3600
MARK = "page-cache"
SCHEMA = "key string, url string, header string, saved timestamp, content string, size bigint, prefix string"
#: Bytes that a task writes; addresses of a lookup that are broadcast.
TASK_BYTES, FEW = 128 << 20, 100_000


class CacheStore:
    def __init__(self, spark: SparkSession, path: str, version: str = VERSION, digits: int = 2) -> None:
        """digits of the key that name a folder: 16 ** digits folders at most."""
        self.spark, self.path, self.version, self.digits = spark, path, version, digits

    def rows(self) -> DataFrame:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def _keyed(self, rows: DataFrame) -> DataFrame:
        key = cache_key(F.col("url"), self.version)
        return rows.where("url is not null").withColumn("key", key).withColumn("prefix", F.left("key", F.lit(self.digits)))

    def _folders(self, rows: DataFrame) -> list[str]:
        """The folders that rows fall into: 16 ** digits names at most."""
        return sorted(r[0] for r in rows.select("prefix").distinct().collect())

    def _valid(self) -> Column:
        part = F.split("header", " ", 4)
        ok = (F.size(part) == 4) & (F.get(part, F.lit(0)) == MARK) & (F.get(part, F.lit(1)) == self.version) & (F.get(part, F.lit(3)) == F.col("url"))
        return ok & F.get(part, F.lit(2)).rlike("^-?[0-9]+$")

    def get(self, urls: DataFrame) -> DataFrame:
        """(url, content, saved) of those of urls (url) that have a valid entry. Addresses are looked up once each; null finds nothing."""
        wanted = self._keyed(urls.select("url").distinct())
        folders = self._folders(wanted)
        few = wanted.count() <= FEW
        keys = wanted.select("prefix", "key", F.col("url").alias("asked"))
        found = self.rows().where(F.col("prefix").isin(folders)).join(F.broadcast(keys) if few else keys.hint("merge"), ["prefix", "key"])
        return found.where(self._valid() & (F.col("url") == F.col("asked"))).select("url", "content", "saved")

    def put(self, pages: DataFrame) -> list[str]:
        """Stores pages (url, content, saved) in place of older entries of their addresses; of rows of one address the latest, and of those the one
        with the greater content. Returns the folders that were rewritten."""
        header = F.concat_ws(" ", F.lit(MARK), F.lit(self.version), F.unix_timestamp("saved").cast("string"), "url")
        new = self._keyed(pages.select("url", "saved", F.coalesce("content", F.lit("")).alias("content"))).withColumn("header", header).withColumn("size", F.octet_length("content").cast("long") + F.octet_length("header") + 1)
        folders = self._folders(new)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        old = self.rows().where(F.col("prefix").isin(folders)).select(*names, F.lit(0).alias("new"))
        latest = Window.partitionBy("prefix", "key").orderBy(F.desc("new"), F.desc_nulls_last("saved"), F.desc("content"))
        both = old.unionByName(new.select(*names, F.lit(1).alias("new"))).withColumn("r", F.row_number().over(latest)).where("r = 1")
        self._replace(both.select(*names), folders)
        return folders

    def delete(self, urls: DataFrame) -> list[str]:
        """Removes the entries of urls (url); returns the folders that were rewritten."""
        gone = self._keyed(urls.select("url").distinct())
        folders = self._folders(gone)
        self._replace(self.rows().where(F.col("prefix").isin(folders)).join(gone.select("prefix", "key"), ["prefix", "key"], "left_anti"), folders)
        return folders

    def prune(self, now, days: int = DAYS) -> list[str]:
        """Removes entries older than days; only folders that have such are rewritten."""
        old = F.col("saved") < F.lit(now).cast("timestamp") - F.expr(f"interval {int(days)} days")
        folders = self._folders(self.rows().where(old))
        self._replace(self.rows().where(F.col("prefix").isin(folders) & ~F.coalesce(old, F.lit(False))), folders)
        return folders

    def maybe_prune(self, now, days: int = DAYS) -> bool:
        """prune(), unless the last one is less than PRUNE_EVERY seconds before now."""
        marks = f"{self.path}.pruned"
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(marks)
        at = self.spark.range(1).select(F.lit(now).cast("timestamp").alias("at"))
        if folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            last = self.spark.read.schema("at timestamp").parquet(marks)
            if at.crossJoin(last.agg(F.max("at").alias("last"))).where(f"at < last + interval {PRUNE_EVERY} seconds").count():
                return False
        self.prune(now, days)
        at.write.mode("append").parquet(marks)
        return True

    def clear(self) -> None:
        removed(self.spark, self.path)
        removed(self.spark, f"{self.path}.pruned")

    def stats(self) -> DataFrame:
        """(entries, size, oldest): one row; contents aren't read."""
        return self.rows().agg(F.count("*").alias("entries"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.min("saved").alias("oldest"))

    def _replace(self, rows: DataFrame, folders: list[str]) -> None:
        """rows, staged first, in place of what the folders hold; a folder that gets none goes."""
        if not folders:
            return
        stage = own_path(self.spark, "staged")
        rows.write.option("compression", "zstd").parquet(stage)
        staged = self.spark.read.schema(SCHEMA).parquet(stage)
        size, left = staged.agg(F.coalesce(F.sum("size"), F.lit(0)), F.collect_set("prefix")).first()
        cut = staged.repartitionByRange(int(max(1, size // TASK_BYTES + 1)), "prefix", "key").sortWithinPartitions("prefix", "key")
        cut.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("prefix").parquet(self.path)
        for name in set(folders) - set(left):
            removed(self.spark, f"{self.path}/prefix={name}")
        removed(self.spark, stage)
