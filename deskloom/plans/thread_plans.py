"""Queries of threads, runs and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from deskloom.operators import threads as th
from deskloom.plans.registry import Registry
from deskloom.sources.tables import table, views_sql

R = Registry()
M, T, D = views_sql("messages"), views_sql("tickets"), views_sql("policies")

BUDGET = 1600


@R.add(
    "n3_n4_transcripts",
    rf"""{M}, v AS (SELECT email_id, turn, role, CASE WHEN role = 'user' THEN 'Requester: ' ELSE 'Support: ' END || regexp_replace(body, '^\s+|\s+$', '', 'g') AS block, regexp_replace(body, '^\s+|\s+$', '', 'g') AS b
        FROM messages WHERE public AND regexp_replace(body, '^\s+|\s+$', '', 'g') <> ''),
    w AS (SELECT *, row_number() OVER o AS place, sum(length(block) + 2) OVER (o ROWS UNBOUNDED PRECEDING) AS used FROM v WINDOW o AS (PARTITION BY email_id ORDER BY turn DESC, block DESC)),
    g AS (SELECT email_id, count(*) AS visible, count(*) FILTER (used <= {BUDGET} OR place = 1) AS included,
        string_agg(substr(block, 1, {BUDGET}), chr(10) || chr(10) ORDER BY place DESC) FILTER (used <= {BUDGET} OR place = 1) AS t, arg_min(b, place) FILTER (role = 'user') AS latest_request FROM w GROUP BY email_id)
    SELECT email_id, CASE WHEN visible > included THEN '[… ' || (visible - included) || ' earlier message(s) omitted …]' || chr(10) || chr(10) ELSE '' END || t AS text, included, visible - included AS omitted, coalesce(latest_request, '') AS latest_request FROM g""",
)
def transcripts(spark, d):
    return th.transcripts(table(spark, d, "messages"), BUDGET)


@R.add("n2_first_inquiry", f"{M} SELECT email_id, min(turn) AS turn, arg_min(body, turn) AS body FROM messages WHERE public AND author_id = email_id GROUP BY email_id")
def first_inquiry(spark, d):
    rows = table(spark, d, "messages")
    return th.first_inquiry(rows, rows.select("email_id", F.col("email_id").alias("requester_id")).distinct())


@R.add("n14_first_exchange", f"{M} SELECT email_id, arg_min(body, turn) FILTER (role = 'user') AS question, arg_min(body, turn) FILTER (role = 'assistant') AS answer FROM messages WHERE public GROUP BY email_id")
def first_exchange(spark, d):
    return th.first_exchange(table(spark, d, "messages"))


@R.add("n5_latest_result", "SELECT DISTINCT ON (user_id) user_id, event_id, event_type, ts FROM events ORDER BY user_id, ts DESC, event_id DESC")
def latest_result(spark, d):
    return th.latest(table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", "ts", "event_id")


@R.add("n11_high_water", "SELECT user_id, max(event_id) AS last_id FROM events GROUP BY user_id")
def high_water(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max("event_id").alias("last_id"))


@R.add(
    "n13_runs",
    """WITH c AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM c)
    SELECT event_id, user_id, event_type, count(*) OVER (PARTITION BY user_id, run) AS run_length FROM r""",
)
def runs(spark, d):
    return th.runs(table(spark, d, "events").select("event_id", "user_id", "event_type"), "user_id", "event_id", "event_type")


@R.add(
    "n7_spaced_sample",
    f"""{D}, n AS (SELECT category, id, row_number() OVER (PARTITION BY category ORDER BY id) - 1 AS pos, count(*) OVER (PARTITION BY category) AS size FROM policies)
    SELECT category, id FROM n WHERE size <= 7 OR pos IN (SELECT CAST(floor(i * size / 7) AS BIGINT) FROM range(7) r(i))""",
)
def spaced(spark, d):
    return th.spaced_sample(table(spark, d, "policies").select("category", "id"), "category", "id", 7)


@R.add(
    "n9_quota",
    f"""{D}, n AS (SELECT category, visibility, id, row_number() OVER (PARTITION BY category, visibility ORDER BY (length(content) BETWEEN 200 AND 3000) DESC, id) AS place FROM policies) SELECT * FROM n WHERE place <= 3""",
)
def quota(spark, d):
    rows = table(spark, d, "policies")
    return th.quota(rows, ["category", "visibility"], F.length("content").between(200, 3000), "id", 3).select("category", "visibility", "id", "place")


@R.add("n10_deal", "SELECT p_partkey, CAST((row_number() OVER (ORDER BY p_partkey) - 1) % 6 AS BIGINT) AS batch FROM part")
def deal(spark, d):
    return th.deal(table(spark, d, "part").select("p_partkey"), "p_partkey", 6)


@R.add(
    "n8_assign_once",
    f"""{T}, a AS (SELECT id FROM tickets WHERE lane = 'faq' ORDER BY id LIMIT 30), b AS (SELECT id FROM tickets WHERE status = 'approved' AND id NOT IN (SELECT id FROM a) ORDER BY id LIMIT 30),
    c AS (SELECT id FROM tickets WHERE id NOT IN (SELECT id FROM a) AND id NOT IN (SELECT id FROM b) ORDER BY id LIMIT 30)
    SELECT id, 'auto' AS category FROM a UNION ALL SELECT id, 'approved' FROM b UNION ALL SELECT id, 'rest' FROM c""",
)
def assign_once(spark, d):
    rules = [("auto", F.col("lane") == "faq", 30), ("approved", F.col("status") == "approved", 30), ("rest", F.lit(True), 30)]
    return th.assign_once(table(spark, d, "tickets"), rules, "id")


@R.add(
    "j2_threads",
    f"""{views_sql("messages", "tickets")} SELECT t.id, coalesce(list({{'turn': m.turn, 'role': m.role, 'body': m.body}} ORDER BY m.turn) FILTER (m.email_id IS NOT NULL), []) AS thread FROM tickets t LEFT JOIN messages m ON m.email_id = t.id WHERE t.id < 200 GROUP BY t.id""",
)
def threads(spark, d):
    emails = table(spark, d, "tickets").where("id < 200").select(F.col("id").alias("email_id"))
    return th.with_results(emails, table(spark, d, "messages")).select(F.col("email_id").alias("id"), "thread")


@R.add(
    "u5_dealt_pairs",
    """WITH k AS (SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, count(*) AS frequency FROM documents GROUP BY text),
    s AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, count(*) OVER () AS total FROM k WHERE frequency < 2),
    q AS (SELECT *, greatest(1, CAST(round_even((500 - (SELECT count(*) FROM k WHERE frequency >= 2))::DOUBLE * n / total, 0) AS BIGINT)) AS share FROM s),
    g AS (SELECT doc_id, source, frequency FROM q WHERE i % greatest(1, n // share) = 0 AND i < greatest(1, n // share) * share),
    b AS (SELECT doc_id, source, frequency, row_number() OVER (ORDER BY frequency DESC, doc_id) - 1 AS place FROM k WHERE frequency >= 2
        UNION ALL SELECT doc_id, source, frequency, (SELECT count(*) FROM k WHERE frequency >= 2) + row_number() OVER (ORDER BY source, doc_id) - 1 FROM g)
    SELECT doc_id, source, frequency, place % (((SELECT count(*) FROM b) + 39) // 40) AS batch FROM b""",
)
def dealt_pairs(spark, d):
    return th.dealt_pairs(table(spark, d, "documents"), F.col("text"), "source", "doc_id", least=2, most=500, size=40)
