"""Domain views over the driver's tables. Each is one SELECT that Spark and DuckDB both run; {name} is a base table or another view."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from deskloom.functions.vocabulary import INTENT_NAMES

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_INTENT = "CASE {x} " + " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(INTENT_NAMES)) + " END"

VIEWS = {
    "tickets": f"""
        SELECT o_orderkey AS id, c_name AS sender, concat(o_orderpriority, ' case ', CAST(o_orderkey AS STRING)) AS subject, o_orderdate AS received_at,
            CASE o_orderkey % 5 WHEN 0 THEN 'approved' WHEN 1 THEN 'rerouted' WHEN 2 THEN 'SENT' ELSE 'DRAFT_GENERATED' END AS status,
            CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN '' WHEN o_orderstatus = 'O' THEN 'open' WHEN o_orderstatus = 'P' THEN 'pending'
                WHEN o_orderkey % 2 = 0 THEN 'solved' ELSE 'closed' END AS ticket_status,
            CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey * 10 END AS ticket_id, c_mktsegment AS source,
            CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey % 5 + 1 END AS owner_id,
            CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE CAST(o_orderkey % 101 AS DOUBLE) / CAST(100 AS DOUBLE) END AS confidence,
            CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 89 AS DOUBLE) / CAST(100 AS DOUBLE) END AS calibrated,
            CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(80 + o_orderkey % 21 AS DOUBLE) / CAST(100 AS DOUBLE) END AS answer_confidence,
            CASE WHEN o_orderkey % 101 >= 65 THEN 'faq' ELSE 'human_review' END AS lane,
            {_INTENT.format(x="o_orderkey % 14")} AS intent,
            CASE WHEN o_orderkey % 6 = 0 THEN 1 + o_orderkey % 3 ELSE 0 END AS n_placeholders, o_orderkey % 10 = 3 AS has_notes,
            CASE WHEN o_orderkey % 8 = 0 THEN 0 ELSE o_orderkey % 4 + 1 END AS n_citations
        FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey""",
    "audit_log": """
        SELECT event_id AS id, user_id AS email_id, ts, event_type AS action, props AS metadata,
            CASE WHEN event_id % 3 = 0 THEN 'system' ELSE concat('chair', CAST(event_id % 4 AS STRING)) END AS actor,
            CASE WHEN event_id % 2 = 0 THEN 'near_miss' ELSE 'edited' END AS kind, value
        FROM {events}""",
    "messages": """
        SELECT conv_id AS email_id, turn, role <> 'system' AS public, CASE WHEN role = 'user' THEN conv_id ELSE -1 END AS author_id, role, text AS body
        FROM {conversations}""",
    "policies": f"""
        SELECT doc_id AS id, concat('policy_', CAST(doc_id AS STRING)) AS policy_key, concat(source, ' — ', substr(text, 1, 40)) AS title, text AS content, source AS category,
            {_INTENT.format(x="doc_id % 14")} AS intent_a, {_INTENT.format(x="(doc_id * 5) % 14")} AS intent_b,
            CASE WHEN doc_id % 5 = 0 THEN 'internal' ELSE 'public' END AS visibility, CASE WHEN doc_id % 7 = 0 THEN 'inactive' ELSE 'active' END AS status,
            CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 3 = 0 THEN concat('policy_', CAST(doc_id - doc_id % 9 AS STRING)) END AS root_key,
            CASE WHEN doc_id % 13 = 0 THEN concat('policy_', CAST(doc_id + 1 AS STRING)) END AS superseded_by
        FROM {{documents}}""",
    "owners": """
        SELECT n_nationkey + 1 AS id, n_name AS name, n_nationkey % 14 AS area_a, (n_nationkey * 3 + 1) % 14 AS area_b, n_nationkey % 6 = 5 AS fallback, n_nationkey % 4 <> 3 AS active
        FROM {nation}""",
    "judged": """
        SELECT doc_id, quality AS truth, toxic AS other, CAST((doc_id * 37) % 1001 AS DOUBLE) / CAST(1000 AS DOUBLE) AS p,
            CASE WHEN (doc_id * 7) % 10 < 7 THEN quality ELSE 1 - quality END AS predicted
        FROM {labels}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a view, by its name."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    used = {x: table(spark, sf_dir, x) for x in set(re.findall(r"\{(\w+)\}", VIEWS[name]))}
    return spark.sql(VIEWS[name], **used)


def views_sql(*names: str) -> str:
    """WITH and the views, for an SQL text over the base tables."""
    return "WITH " + ", ".join(f"{n} AS ({re.sub(r'\{(\w+)\}', r'\1', VIEWS[n])})" for n in names)
