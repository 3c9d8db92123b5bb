"""Tables that are written to the folder that driver and executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; where that is unset, in a folder of this machine if the session is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        base = f"file://{tempfile.mkdtemp(prefix='deskloom-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written and read again, so that what follows starts from files that outlive a lost executor."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered_by(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with name: its rows' places from 0 by order; ranges are sorted and numbered each, and only their sizes meet."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    parts = stored(parts, "ranges")
    sizes = parts.groupBy("__part").agg(F.min("__at").alias("__low"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("__before", before).drop("__n")
    return parts.join(F.broadcast(sizes), "__part").withColumn(name, F.col("__before") + F.col("__at") - F.col("__low")).drop("__part", "__at", "__low", "__before")
