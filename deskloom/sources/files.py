"""File sources: JSON arrays, JSON lines, rotated logs, markdown with front matter, JDBC tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A trace line. Summaries are kept as JSON text, since each stage has its own.
TRACE = "timestamp string, email_id long, stage string, input_summary string, output_summary string, duration_ms double"


def json_array(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Files that hold one JSON array each; a file is read by one task."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines; malformed ones are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def rotated_log(spark: SparkSession, folder: str, name: str, email_id: int | None = None, schema: str = TRACE) -> DataFrame:
    """name.3, name.2, name.1 and name, with generation: the oldest has the largest number, the current one 0. Sort by it, falling, for the order of writing.

    Each is a file, or a folder of files as Spark writes them; other names in the folder aren't read.
    """
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(f"{folder}/{name}{{,.[0-9],.[0-9][0-9],.[0-9][0-9][0-9]}}")
    number = F.regexp_extract(F.col("_metadata.file_path"), rf".*/{re.escape(name)}(?:\.(\d+))?(?:/[^/]*)?$", 1)
    rows = rows.withColumn("generation", F.coalesce(number.try_cast("int"), F.lit(0)))
    return rows if email_id is None else rows.where(F.col("email_id") == email_id)


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, tags, body) of markdown files with a front matter between lines of dashes; without one the whole file is body."""
    head = r"(?s)^---\r?\n(.*?)\r?\n---\r?\n?(.*)$"
    rows = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    meta = F.regexp_extract("value", head, 1)
    tags = F.transform(F.split(F.regexp_extract(meta, r"(?m)^tags:\s*\[?([^\]\n]*)\]?\s*$", 1), ","), lambda t: F.trim(F.regexp_replace(t, r"[\"']", "")))
    return rows.select(
        "path",
        F.nullif(F.trim(F.regexp_replace(F.regexp_extract(meta, r"(?m)^title:\s*(.*)$", 1), r"^[\"']|[\"']$", "")), F.lit("")).alias("title"),
        F.filter(tags, lambda t: t != "").alias("tags"),
        F.when(F.col("value").rlike(head), F.regexp_extract("value", head, 2)).otherwise(F.col("value")).alias("body"),
    )


def jdbc_table(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A table of a database, read in parts by ranges of a numeric key."""
    bounds = {"partitionColumn": key, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}
    return spark.read.format("jdbc").options(url=url, dbtable=name, **bounds, **options).load()


def child_events(exports: DataFrame) -> DataFrame:
    """(ticket_id, event_id, body, public, created_at): the comments among the child events of exported ticket events."""
    rows = exports.select("ticket_id", "created_at", F.explode("child_events").alias("e"))
    return rows.where("e.event_type = 'Comment'").select("ticket_id", F.col("e.id").alias("event_id"), "e.body", "e.public", "created_at")


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that a run which was broken off still has to do: done has those that succeeded, errors aren't among them."""
    return rows.join(done.where("error IS NULL").select(key), key, "left_anti")
