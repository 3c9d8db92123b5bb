"""Queries of sources, sinks, streams and table functions. Files are written to the shared folder first, from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from deskloom.functions.chunks import chunked
from deskloom.plans.registry import Registry
from deskloom.sources import files
from deskloom.sources.export import TicketExport
from deskloom.sources.matrix import Matrix
from deskloom.sources.tables import table
from deskloom.stores import scratch
from deskloom.streaming import desk_stream as st

R = Registry()


@R.add("s1_scan", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def scan(spark, d):
    rows = table(spark, d, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.count("*").alias("n"))


@R.add("s5_json_lines", "SELECT event_id, event_type FROM events WHERE event_id % 3 = 0")
def json_lines(spark, d):
    path = scratch(spark, "lines")
    rows = table(spark, d, "events").select("event_id", F.to_json(F.struct("event_id", "event_type")).alias("good"))
    rows.select(F.when(F.col("event_id") % 3 == 0, F.col("good")).otherwise(F.lit('{"event_id": oops')).alias("value")).write.text(path)
    return files.json_lines(spark, path, "event_id long, event_type string")


@R.add("s4_json_array", "SELECT n_nationkey, n_name FROM nation")
def json_array(spark, d):
    path = scratch(spark, "array")
    one = table(spark, d, "nation").agg(F.to_json(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))).alias("value"))
    one.write.text(path)
    return files.json_array(spark, path, "n_nationkey int, n_name string")


@R.add("s6_rotated_log", "SELECT event_id % 3 AS generation, count(*) AS n FROM events WHERE user_id = 7 GROUP BY 1")
def rotated(spark, d):
    folder = scratch(spark, "trace")
    for i in range(3):
        rows = table(spark, d, "events").where(F.col("event_id") % 3 == i)
        lines = rows.select(F.to_json(F.struct(F.col("user_id").alias("email_id"), F.col("event_type").alias("stage"))).alias("value"))
        lines.write.text(f"{folder}/trace.jsonl.{i}" if i else f"{folder}/trace.jsonl")
    rows = files.rotated_log(spark, folder, "trace.jsonl", email_id=7)
    return rows.groupBy(F.col("generation").cast("long").alias("generation")).agg(F.count("*").alias("n"))


@R.add("s9_child_events", "SELECT o_orderkey AS ticket_id, l_linenumber AS event_id, l_returnflag AS body FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linestatus = 'F'")
def child_events(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.collect_list(
            F.struct(F.col("l_linenumber").alias("id"), F.when(F.col("l_linestatus") == "F", "Comment").otherwise("Change").alias("event_type"), F.col("l_returnflag").alias("body"), F.lit(True).alias("public"))
        ).alias("child_events")
    )
    exports = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("ticket_id"), "child_events", F.col("o_orderdate").alias("created_at"))
    return files.child_events(exports).select("ticket_id", "event_id", "body")


def _export(spark, d, ends: bool) -> str:
    """A folder with an export of the events: 500 to a page, whose cursors are opaque; without the last page's end if it broke off."""
    path, at = scratch(spark, "export"), F.floor(F.col("event_id") / 500).cast("long")
    record = F.struct(F.col("event_id").alias("id"), F.when(F.col("event_id") % 11 == 0, "deleted").otherwise("open").alias("status"), F.col("event_type").alias("subject"), F.col("user_id").alias("requester_id"))
    user = F.struct(F.col("user_id").alias("id"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("name"))
    pages = table(spark, d, "events").groupBy(at.alias("page")).agg(F.collect_list(record).alias("records"), F.collect_set(user).alias("users"))
    last = pages.agg(F.max("page").alias("last"))
    cursor = lambda n: F.when(n == 0, "first").otherwise(F.concat(F.lit("c"), n.cast("string")))
    ended = F.col("page") == F.col("last")
    body = F.to_json(F.struct("records", "users", F.when(~ended, cursor(F.col("page") + 1)).alias("after_cursor"), (ended & F.lit(ends)).alias("end_of_stream")))
    pages.crossJoin(F.broadcast(last)).select(body.alias("value"), cursor(F.col("page")).alias("cursor")).write.partitionBy("cursor").text(path)
    spark.dataSource.register(TicketExport)
    return path


EXPORTED = "SELECT event_id AS id, event_type AS subject, user_id AS requester_id, 'user ' || user_id AS requester_name, {complete} AS complete FROM events WHERE event_id % 11 <> 0"


@R.add("s8_s10_export", EXPORTED.format(complete="true"))
def exported(spark, d):
    rows = spark.read.format("ticket_export").option("path", _export(spark, d, True)).option("start", "first").load()
    return rows.select("id", "subject", "requester_id", "requester_name", "complete")


@R.add("s13_truncated_export", EXPORTED.format(complete="event_id // 500 < (SELECT max(event_id) // 500 FROM events)"))
def truncated(spark, d):
    rows = spark.read.format("ticket_export").option("path", _export(spark, d, False)).option("start", "first").load()
    return rows.select("id", "subject", "requester_id", "requester_name", "complete")


@R.add("s10_users_once", "SELECT DISTINCT user_id FROM events")
def users_once(spark, d):
    return table(spark, d, "events").dropDuplicates(["user_id"]).select("user_id")


@R.add(
    "s12_vectors",
    """WITH e AS (SELECT vec_id % 7 AS k, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS row FROM embeddings WHERE embedding IS NOT NULL)
    SELECT row, list_transform(embedding, lambda x: x * CAST(k AS FLOAT) + CAST(0 AS FLOAT)) AS vector, CASE WHEN k = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS length FROM e""",
)
def vectors(spark, d):
    """The matrix as it was written, and the lengths of its rows as they are read scaled; every seventh row has zeros."""
    spark.dataSource.register(Matrix)
    path, by = scratch(spark, "matrix"), (F.col("vec_id") % 7).cast("float")
    rows = table(spark, d, "embeddings").where("embedding IS NOT NULL").repartitionByRange(4, "vec_id").sortWithinPartitions("vec_id")
    rows.select(F.transform("embedding", lambda x: x * by + F.lit(0).cast("float")).alias("vector")).write.format("npy_matrix").mode("append").option("rows", 100).save(path)
    read = lambda scaled: spark.read.format("npy_matrix").option("rows", 64).option("scaled", scaled).load(path)
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return read("false").join(read("true").select("row", F.round(length, 4).alias("length")), "row")


@R.add("w1_w7_append", "SELECT action, count(*) AS n FROM (SELECT event_type AS action FROM events UNION ALL SELECT 'extra' FROM nation) GROUP BY 1")
def append(spark, d):
    path = scratch(spark, "audit")
    table(spark, d, "events").select(F.col("event_type").alias("action")).write.mode("append").parquet(path)
    table(spark, d, "nation").select(F.lit("extra").alias("action")).write.mode("append").parquet(path)
    return spark.read.parquet(path).groupBy("action").agg(F.count("*").alias("n"))


@R.add("w10_pending", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0")
def pending(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    done = docs.where("doc_id % 3 = 0").withColumn("error", F.when(F.col("doc_id") % 2 == 0, "failed"))
    return files.pending(docs, done, "doc_id")


@R.add("c32_chunks")
def chunks(spark, d):
    spaced, heading = F.replace("text", F.lit("\n"), F.lit("\n\n")), lambda mark, name: F.concat(F.lit(f"\n{mark} "), name, F.lit("\n"))
    body = F.concat(spaced, heading("##", F.col("source")), F.col("text"), heading("###", F.col("lang")), F.lit("#tag\n#### note\n"), spaced, heading("##", F.lit("Contact")), F.lit("Write to us."))
    return chunked(table(spark, d, "documents").select("doc_id", F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), body.alias("body")))


def _events_folder(spark, d) -> tuple[str, object]:
    rows = table(spark, d, "events")
    path = scratch(spark, "events")
    rows.repartition(4, "event_id").write.parquet(path)
    return path, rows.schema


@R.add(
    "stream_daily_volumes",
    "WITH c AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT * FROM c WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)",
)
def stream_daily(spark, d):
    path, schema = _events_folder(spark, d)
    target = scratch(spark, "volumes")
    st.run_once(st.daily_volumes(st.audit_stream(spark, path, schema)), scratch(spark, "check"), st.by_batch(target))
    return spark.read.parquet(target).select(F.col("day").cast("timestamp_ntz").alias("day"), "event_type", "n")


@R.add("stream_once", "SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def stream_once(spark, d):
    path, schema = _events_folder(spark, d)
    rows = st.audit_stream(spark, path, schema, files=2)
    target = scratch(spark, "once")
    st.run_once(st.once(rows.withColumn("key", F.col("event_id")), "key"), scratch(spark, "check"), sink=st.idempotent("event_id", target))
    st.run_once(st.once(rows.withColumn("key", F.col("event_id")), "key"), scratch(spark, "check"), sink=st.idempotent("event_id", target))
    return spark.read.parquet(target).agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


@R.add("stream_dead_letters", "SELECT 'good' AS kind, count(*) FILTER (event_id % 4 <> 0) AS n FROM events UNION ALL SELECT 'bad', count(*) FILTER (event_id % 4 = 0) FROM events")
def dead_letters(spark, d):
    path, good, bad = (scratch(spark, x) for x in ("lines", "good", "dead"))
    rows = table(spark, d, "events").select(F.when(F.col("event_id") % 4 != 0, F.to_json(F.struct("event_id", "event_type"))).otherwise(F.lit("{oops")).alias("value"))
    rows.repartition(4).write.text(path)
    lines = spark.readStream.option("maxFilesPerTrigger", 1).text(path)
    st.run_once(lines, scratch(spark, "check"), st.split_by_batch(good, bad, "event_id long, event_type string"))
    count = lambda target, kind: spark.read.parquet(target).agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return count(good, "good").unionByName(count(bad, "bad"))


#: Turns of a conversation that have come by each poll but the last, which has all.
POLLS = (2, 4)
_TURNS = f"""
WITH c AS (SELECT conv_id, turn, role, CASE WHEN turn < {POLLS[0]} THEN 0 WHEN turn < {POLLS[1]} THEN 1 ELSE 2 END AS poll FROM conversations),
p AS (SELECT conv_id, poll, count(*) AS n, max(turn) AS last, bool_or(role = 'user') AS asked, poll = min(poll) OVER (PARTITION BY conv_id) AS first FROM c GROUP BY conv_id, poll)
SELECT conv_id AS ticket_id, n AS new_comments, last AS last_comment_id, CASE WHEN first THEN 'classify' WHEN NOT asked THEN 'append' WHEN conv_id % 5 = 0 THEN 'surface' ELSE 'reprocess' END AS action FROM p"""


@R.add("stream_ticket_actions", _TURNS)
def ticket_actions(spark, d):
    folder, check, target = (scratch(spark, x) for x in ("polls", "check", "actions"))
    status = F.when(F.col("conv_id") % 5 == 0, "closed").when(F.col("conv_id") % 5 == 1, "solved").otherwise("open")
    rows = table(spark, d, "conversations").select(
        F.col("conv_id").alias("ticket_id"), F.col("turn").alias("comment_id"), F.when(F.col("role") == "user", F.col("conv_id")).otherwise(-1).alias("author_id"), F.col("conv_id").alias("requester_id"), (F.col("role") != "system").alias("public"), status.alias("status"), F.timestamp_seconds(F.col("turn") * 60 + 1_750_000_000).alias("created_at")
    )
    for upto in (*POLLS, None):
        # each poll brings whole threads, and a query that starts again where the last one stopped
        (rows if upto is None else rows.where(F.col("comment_id") < upto)).write.mode("append").parquet(folder)
        st.run_once(st.ticket_actions(st.audit_stream(spark, folder, rows.schema)), check, st.by_batch(target))
    return spark.read.parquet(target).drop("batch")


@R.add("s7_markdown", "SELECT item_id, 'Item ' || item_id AS title, ['a', 'b'] AS tags, md5(text) AS body FROM benchmark")
def markdown(spark, d):
    path = scratch(spark, "markdown")
    text = F.concat(F.lit("---\ntitle: Item "), F.col("item_id").cast("string"), F.lit("\ntags: [a, \"b\"]\n---\n"), F.col("text"))
    rows = table(spark, d, "benchmark").select(text.alias("value"), F.col("item_id").alias("part"))
    # one file for each item, without a line end of its own
    rows.write.partitionBy("part").option("lineSep", "\x00").text(path)
    found = files.markdown(spark, f"{path}/*")
    item = F.regexp_extract("path", r"part=(\d+)", 1).cast("long")
    return found.select(item.alias("item_id"), "title", "tags", F.md5(F.regexp_replace("body", "\x00$", "")).alias("body"))
