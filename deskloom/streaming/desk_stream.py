"""The ingest side as Structured Streaming: volumes, tickets with state, idempotent sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues


def audit_stream(spark: SparkSession, folder: str, schema, files: int = 1000) -> DataFrame:
    """The audit log as it grows, from parquet files that are added to a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def daily_volumes(events: DataFrame, at: str = "ts", late: str = "1 day") -> DataFrame:
    """(day, event_type, n), each day once it is over by more than late."""
    rows = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return rows.groupBy(F.window(at, "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")


def once(events: DataFrame, key: str, at: str = "ts", late: str = "1 day") -> DataFrame:
    """events without repeats of a key within late."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark([key])


#: A ticket's state goes when the watermark is so far past its latest comment.
FORGET_MS = 90 * 24 * 3600 * 1000
#: State by key needs this store; a session that has another one is given it for the streams that it starts from then on.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Tickets(StatefulProcessor):
    """State: a map of the comments seen, each kept on its own, and of a known ticket when it is to be forgotten."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "comment_id long", "status string")
        self.known = handle.getValueState("known", "forget long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        fresh, last = {}, 0
        for part in rows:
            last = max(last, int(part["created_at"].max().timestamp() * 1000))
            for r in part.itertuples():
                if r.comment_id not in fresh and not self.seen.containsKey((r.comment_id,)):
                    fresh[r.comment_id] = r
                    self.seen.updateValue((r.comment_id,), (r.status,))
        known, forget = self.known.get()[0] if self.known.exists() else None, last + FORGET_MS
        if known is None or forget > known:
            if known is not None:
                self.handle.deleteTimer(known)
            self.handle.registerTimer(forget)
            self.known.update((forget,))
        if fresh:
            asked = any(r.public and r.author_id == r.requester_id for r in fresh.values())
            closed = fresh[max(fresh)].status == "closed"
            action = "classify" if known is None else "append" if not asked else "surface" if closed else "reprocess"
            yield pd.DataFrame({"ticket_id": [int(key[0])], "new_comments": [len(fresh)], "last_comment_id": [int(max(fresh))], "action": [action]})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        self.known.clear()
        return iter(())

    def close(self) -> None:
        pass


def ticket_actions(comments: DataFrame, late: str = "1 day") -> DataFrame:
    """(ticket_id, new_comments, last_comment_id, action) for each ticket that a micro-batch brings something new for.

    comments: ticket_id, comment_id, author_id, requester_id, public, status, created_at;
    whole threads may come again, as a comment counts once. A new ticket is classified.
    A requester's new public comment has it processed again, or only shown if the
    ticket is closed, which its latest new comment says; others are appended. A
    requester that is null never asks. Comments that are later than late behind the
    watermark are left out; a ticket whose latest comment is FORGET_MS behind it is
    forgotten.
    """
    comments.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = comments.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", late)
    return rows.groupBy("ticket_id").transformWithStateInPandas(Tickets(), "ticket_id long, new_comments long, last_comment_id long, action string", "append", "EventTime")


def by_batch(target: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch to a folder of its own, so a batch that comes twice replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return write


def split_by_batch(good: str, bad: str, schema: str, text: str = "value") -> Callable[[DataFrame, int], None]:
    """A sink for JSON texts: typed rows to one target, dead letters to another, both by batch as by_batch has them.

    A batch that breaks off between the two is written again whole.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for rows, target in zip(well_formed(batch, schema, text), (good, bad)):
                by_batch(target)(rows, number)
        finally:
            batch.unpersist()

    return write


def idempotent(key: str, target: str) -> Callable[[DataFrame, int], None]:
    """A sink that appends rows whose key the target doesn't have yet, so that a batch which comes twice counts once."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key])
        try:
            new = new.join(spark.read.parquet(target).select(key), key, "left_anti")
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        new.select(*batch.columns).write.mode("append").parquet(target)

    return write


def well_formed(rows: DataFrame, schema: str, text: str = "value") -> tuple[DataFrame, DataFrame]:
    """JSON texts as typed rows, and those that aren't as dead letters: one bad record doesn't stop the rest."""
    parsed = rows.withColumn("__r", F.from_json(text, f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("__r").isNull() | F.col("__r._corrupt").isNotNull()
    return parsed.where(~bad).select("__r.*").drop("_corrupt"), parsed.where(bad).select(text)


def run_once(frame: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Everything that is there into a sink for batches, then stop."""
    query = frame.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
    return query
