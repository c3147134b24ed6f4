"""What the operators share: tables, the shared folder, written cut points, session settings."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship

#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
WORD_GAP = r"[\x20\x09-\x0D]+"

_own_folder: list[str] = []


#: Rows of a table at most that is dealt out anew where it has fewer files than there are cores.
SMALL_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. A small one in few files would keep most cores idle, so its rows are dealt out; a large one is read as it lies."""
    found, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return found.repartition(cores) if len(found.inputFiles()) < cores and found.count() <= SMALL_ROWS else found


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a
    temporary folder of our own, and only under a local master."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="pagegrain-"))
    return _own_folder[0]


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back: lineage ends here, and a lost executor costs
    only its running tasks."""
    path = f"{shared_dir(spark)}/pagegrain/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def running(spark: SparkSession, rows: DataFrame, order: list[Column], value: str | list[str] | None = None, task_rows: int = 200_000) -> DataFrame:
    """rows (a written table) with `rank`, their place from 0 by `order`, and `before`, the sum of `value` over the
    rows ahead (of several values: before_<name> each). Ranges of rows are sorted in a task each; only a row a range meets in one."""
    sums = {f"before_{v}": v for v in value} if isinstance(value, list) else {"before": value}
    size = lambda v: F.col(v) if v else F.lit(0)
    n = int(min(10_000, rows.count() // task_rows + 1))
    if n == 1:
        ahead = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("rank", F.count("*").over(ahead)).withColumns({b: F.coalesce(F.sum(size(v)).over(ahead), F.lit(0)) for b, v in sums.items()})
    cut = rows.repartitionByRange(n, *order)
    cut = written(spark, cut.sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()), "ordered").withColumn("__part", F.shiftright("__id", 33))
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut.groupBy("__part").agg(F.count("*").alias("__n"), *[F.sum(size(v)).alias(f"__{b}") for b, v in sums.items()])
    parts = parts.select("__part", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(c) for c in parts.columns[1:]])
    inside = Window.partitionBy("__part").orderBy("__id").rowsBetween(Window.unboundedPreceding, -1)
    out = cut.withColumns({b: F.coalesce(F.sum(size(v)).over(inside), F.lit(0)) for b, v in sums.items()}).join(F.broadcast(parts), "__part")  # 10,000 rows at most
    out = out.withColumn("rank", F.col("__n") + F.col("__id").bitwiseAND((1 << 33) - 1)).withColumns({b: F.col(f"__{b}") + F.col(b) for b in sums})
    return out.drop("__id", "__part", *parts.columns[1:])


def placed(spark: SparkSession, rows: DataFrame, by: list[str], order: list[str], name: str, task_rows: int = 50_000) -> DataFrame:
    """rows (a written table) with column `name`: a row's place from 0 among the rows of its `by`, in order of `order`, which
    tells rows apart, nulls first. Ranges of rows are sorted in a task each, so a hot `by` is split; what a range has of the `by`
    that goes on into the next is carried over in a table of a row a range at most."""
    n = int(min(10_000, rows.count() // task_rows + 1))
    cut = rows.repartitionByRange(n, *by, *order).sortWithinPartitions(*by, *order).withColumn("__id", F.monotonically_increasing_id())
    cut = written(spark, cut, "ranges").withColumn("__part", F.shiftright("__id", 33))
    inside = Window.partitionBy("__part", *by).orderBy("__id")
    ahead = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut.groupBy(*by, "__part").agg(F.count("*").alias("__n"))
    carry = parts.select("__part", *by, F.sum("__n").over(ahead).alias("__ahead")).where("__ahead > 0")
    carry = F.broadcast(carry.select(F.col("__part").alias("__p"), *[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], "__ahead"))
    same = F.col("__part") == F.col("__p")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"__by{i}"))
    out = cut.withColumn("__row", F.row_number().over(inside) - 1).join(carry, same, "left")
    return out.select(*rows.columns, (F.col("__row") + F.coalesce("__ahead", F.lit(0))).cast("long").alias(name))


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of finished jobs now rather than at its next
    periodic collection, so that disk holds one copy of a table in flight, not two."""
    for _ in range(2):  # Python's references to the JVM go first
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


@contextlib.contextmanager
def settings(spark: SparkSession, **conf: str):
    """Session settings held for the jobs inside, then put back."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_batches(spark: SparkSession, rows: int = 1000):
    """For jobs that call Python: this package is there, and Arrow batches have a bounded number of
    rows, so that very long texts fit in a worker."""
    ship(spark)
    return settings(spark, **{"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)})


def word_array(text: Column) -> Column:
    """Words of a text: maximal runs without BLANKS. Null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def word_count(text: Column) -> Column:
    """size(word_array(text)) without keeping the words."""
    kept = F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(kept == "", 0).otherwise(F.size(F.split(kept, WORD_GAP))).cast("long")
