"""Queries of the ticket queue and its logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from deskloom.operators import queue as q
from deskloom.plans.registry import Registry
from deskloom.sources.tables import table, views_sql

R = Registry()
T = views_sql("tickets")
A = views_sql("audit_log")

RANGE = {"after": "1996-03-01", "before": "1999-09-30"}
IN_RANGE = "received_at >= TIMESTAMP '1996-03-01' AND received_at < TIMESTAMP '1999-10-01'"


@R.add("f1_t1_queue_page", f"{T} SELECT id, sender, subject, received_at FROM tickets WHERE lane = 'faq' AND owner_id IS NULL AND ticket_status IN ('solved', 'closed') AND {IN_RANGE} ORDER BY received_at DESC, id DESC LIMIT 50 OFFSET 5")
def queue_page(spark, d):
    rows = table(spark, d, "tickets").where(q.all_of(q.queue_conditions(lane="faq", owner="unassigned", ticket_status="solved", **RANGE)))
    return q.page(rows, 50, 5).select("id", "sender", "subject", "received_at")


@R.add("a2_queue_total", f"{T} SELECT count(*) AS n FROM tickets WHERE lane = 'faq' AND owner_id IS NULL AND ticket_status IN ('solved', 'closed') AND {IN_RANGE}")
def queue_total(spark, d):
    rows = table(spark, d, "tickets").where(q.all_of(q.queue_conditions(lane="faq", owner="unassigned", ticket_status="solved", **RANGE)))
    return rows.agg(F.count("*").alias("n"))


@R.add("f3_bare_end_date", f"{T} SELECT id, received_at FROM tickets WHERE received_at >= TIMESTAMP '1997-05-05 12:00:00' AND received_at < TIMESTAMP '1997-06-07'")
def bare_end_date(spark, d):
    return table(spark, d, "tickets").where(q.in_range("received_at", "1997-05-05T12:00:00Z", "1997-06-06")).select("id", "received_at")


@R.add("f4_search", f"{T} SELECT id, subject FROM tickets WHERE subject ILIKE '%urgent%1_7%' OR sender ILIKE '%urgent%1_7%' OR CAST(ticket_id AS VARCHAR) ILIKE '%urgent%1_7%'")
def search(spark, d):
    return table(spark, d, "tickets").where(q.matches("#urgent%1_7", "subject", "sender", "ticket_id")).select("id", "subject")


@R.add(
    "a3_facets",
    f"""{T} SELECT 'ticket_status' AS facet, CASE WHEN ticket_status IN ('solved', 'closed') THEN 'solved' ELSE ticket_status END AS value, count(*) AS n
    FROM tickets WHERE lane = 'human_review' AND source = 'BUILDING' AND ticket_status <> '' GROUP BY 2
    UNION ALL SELECT 'source', source, count(*) FROM tickets WHERE lane = 'human_review' GROUP BY 2
    UNION ALL SELECT DISTINCT 'sources', source, 0 FROM tickets""",
)
def facets(spark, d):
    return q.facets(table(spark, d, "tickets"), q.queue_conditions(lane="human_review"), "BUILDING")


@R.add("a1_by_status", f"{T} SELECT status, count(*) AS n FROM tickets GROUP BY status")
def by_status(spark, d):
    return q.count_by(table(spark, d, "tickets"), "status")


@R.add("a4_by_owner", f"{T} SELECT owner_id, count(*) AS n FROM tickets WHERE owner_id IS NOT NULL GROUP BY owner_id")
def by_owner(spark, d):
    return q.count_by(table(spark, d, "tickets"), "owner_id", nulls=False)


@R.add("f7_open_drafts", f"{T} SELECT id, ticket_status FROM tickets WHERE status = 'DRAFT_GENERATED' AND (ticket_status IS NULL OR ticket_status NOT IN ('solved', 'closed'))")
def open_drafts(spark, d):
    return q.open_drafts(table(spark, d, "tickets")).select("id", "ticket_status")


@R.add("s2_by_key", f"{T} SELECT id, sender FROM tickets WHERE id = 77 AND sender IS NOT NULL")
def by_key(spark, d):
    rows = table(spark, d, "tickets")
    return q.by_key(rows, "id", "77").unionByName(q.by_key(rows, "id", "x77")).select("id", "sender")


@R.add("s3_by_keys", f"{T} SELECT id, status FROM tickets WHERE id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def by_keys(spark, d):
    keys = table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("id"))
    return q.by_keys(table(spark, d, "tickets"), keys, "id").select("id", "status")


@R.add("f14_exclude_processed", f"{T} SELECT id FROM tickets WHERE id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def exclude_processed(spark, d):
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return q.not_in(table(spark, d, "tickets"), done, "id").select("id")


@R.add("f14_cut_by_date", f"{T} SELECT received_at >= TIMESTAMP '1998-01-01' AS is_new, count(*) AS n FROM tickets GROUP BY 1")
def cut_by_date(spark, d):
    return q.count_by(q.cut_by_date(table(spark, d, "tickets"), "received_at", "1998-01-01"), "is_new")


@R.add("f16_allowed_states", f"{T} SELECT id, ticket_status FROM tickets WHERE ticket_status IN ('open', 'pending')")
def allowed_states(spark, d):
    known = ("new", "open", "pending", "hold", "solved", "closed")
    return q.allowed_states(table(spark, d, "tickets"), " Open, pending,open", known).select("id", "ticket_status")


@R.add("f10_audit", f"{A} SELECT id, ts FROM audit_log WHERE email_id = 7 AND action = 'click' AND actor = 'system'")
def audit(spark, d):
    return q.audit_rows(table(spark, d, "audit_log"), "7", "click", "system").select("id", "ts")


@R.add("f11_audit_search", f"{A} SELECT id FROM audit_log WHERE contains(lower(action || ' ' || actor || ' ' || CAST(email_id AS VARCHAR)), 'system 1')")
def audit_search(spark, d):
    return q.audit_search(table(spark, d, "audit_log"), "System 1").select("id")


@R.add("t2_recent_audit", f"{A} SELECT id, action, ts FROM audit_log ORDER BY ts DESC, id DESC LIMIT 20")
def recent_audit(spark, d):
    return q.recent(table(spark, d, "audit_log"), 20, F.desc("ts"), F.desc("id")).select("id", "action", "ts")


@R.add("a5_reassigned_from", f"{A} SELECT coalesce(CAST(TRY_CAST(json_extract_string(metadata, '$.k') AS BIGINT) AS VARCHAR), 'unassigned') AS owner, count(*) AS n FROM audit_log GROUP BY 1")
def reassigned_from(spark, d):
    return q.reassigned_from(table(spark, d, "audit_log"))


@R.add("f12_json_path", f"{A} SELECT id, json_extract_string(metadata, '$.k') AS k FROM audit_log WHERE TRY_CAST(json_extract_string(metadata, '$.k') AS INTEGER) > 90")
def json_path(spark, d):
    return table(spark, d, "audit_log").withColumn("k", F.get_json_object("metadata", "$.k")).where("try_cast(k AS INT) > 90").select("id", "k")


@R.add("j11_roster_counts", f"{views_sql('owners', 'tickets')} SELECT o.id, o.name, count(t.id) AS n FROM owners o LEFT JOIN tickets t ON t.owner_id = o.id GROUP BY o.id, o.name")
def roster_counts(spark, d):
    counts = q.count_by(table(spark, d, "tickets"), "owner_id", nulls=False).withColumnRenamed("owner_id", "id")
    return q.roster_counts(table(spark, d, "owners").select("id", "name"), counts, "id")


@R.add("f15_forced_flag", f"{T} SELECT id, CASE WHEN owner_id IS NULL THEN NULL ELSE list_contains([id % 3 + 1, id % 4 + 1], owner_id) END AS forced_applied, 'https://desk.example/tickets/' || ticket_id AS link FROM tickets")
def forced_flag(spark, d):
    ids = F.array(F.col("id") % 3 + 1, F.col("id") % 4 + 1)
    rows = table(spark, d, "tickets").select("id", F.when(F.col("owner_id").isNotNull(), F.array_contains(ids, F.col("owner_id").cast("bigint"))).alias("forced_applied"), F.concat(F.lit("https://desk.example/tickets/"), F.col("ticket_id").cast("string")).alias("link"))
    return rows


@R.add("f20_already_posted", f"{A} SELECT id FROM audit_log WHERE action || ':' || id NOT IN (SELECT action || ':' || id FROM audit_log WHERE value > 50)")
def already_posted(spark, d):
    rows = table(spark, d, "audit_log").withColumn("key", F.concat_ws(":", "action", F.col("id").cast("string")))
    return q.not_in(rows, rows.where("value > 50"), "key").select("id")
