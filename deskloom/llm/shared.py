"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A word: a run of characters other than space, \t, \n, \v, \f and \r.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset in a local session (tests) one of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='deskloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as a table in the shared folder and read again.

    Later steps then start from files that outlive a lost executor, and know the
    table's size.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_kept: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """What an operator keeps in a Python worker from task to task. What others kept there goes, and its memory back to the system."""
    if _kept.keys() - {owner}:
        for other in _kept.keys() - {owner}:
            _kept.pop(other).clear()
        gc.collect()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)
    return _kept.setdefault(owner, {})


def small_batches(spark: SparkSession, most: int = 1000) -> None:
    """Rows go to Python in batches of so many at most from now on, as long texts add up in executors and workers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= most:
        spark.conf.set(name, str(most))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_count(text: Column) -> Column:
    """Words of a text as long; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*cols: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the values and the seed alone, so reruns agree."""
    h = F.xxhash64(F.lit(seed), *cols)
    return (F.shiftrightunsigned(h, 11).cast("double") + F.lit(0.5)) * F.lit(2.0**-53)


def numbered(df: DataFrame, *order: Column, name: str) -> DataFrame:
    """df with its rows numbered from 0 in an order: ranges are sorted and numbered each, and only their sizes meet."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    parts = stored(parts, "ranges")
    sizes = parts.groupBy("__part").agg(F.min("__at").alias("__low"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("__before", before).drop("__n")
    return parts.join(F.broadcast(sizes), "__part").withColumn(name, F.col("__before") + F.col("__at") - F.col("__low")).drop("__part", "__at", "__low", "__before")


#: Groups that are broadcast at most, and rows that a group of a join by shuffle has at least before it may be broadcast.
MOST_GROUPS, LARGE = 100_000, 10_000


def with_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """rows with the columns of groups, which has one row for each key, null too, and the key's number of rows.

    Groups of more than LARGE rows and of more than a share of 1 / MOST_GROUPS of all
    rows, so MOST_GROUPS of them at most, are broadcast; the rest, whose groups are
    small, meet by a shuffle. No task gets a large group whole.
    """
    most = max(LARGE, (groups.agg(F.sum(size)).first()[0] or 0) // MOST_GROUPS)
    groups = groups.withColumnRenamed(key, "__key").withColumn("__met", F.lit(True))
    same = F.col(key).eqNullSafe(F.col("__key"))
    marked = rows.join(F.broadcast(groups.where(F.col(size) > most)), same, "left")
    large = marked.where(F.col("__met")).drop("__key", "__met")
    rest = marked.where(F.col("__met").isNull()).select(*rows.columns)
    small = rest.join(groups.where(F.col(size) <= most), same).drop("__key", "__met")
    return large.unionByName(small)
