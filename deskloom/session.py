"""A Spark session with the settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC, since naive timestamps mean UTC here; AQE joins small partitions and splits skewed ones.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """The session; settings that are given win. The number of shuffle partitions is left to the cluster's own setting."""
    builder = SparkSession.builder.appName("deskloom").config(map=SETTINGS | settings)
    return (builder.master(master) if master else builder).getOrCreate()


def small_batches(spark: SparkSession, most: int = 500) -> None:
    """Rows go to Python in batches of so many at most from now on, as long texts add up in workers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= most:
        spark.conf.set(name, str(most))
