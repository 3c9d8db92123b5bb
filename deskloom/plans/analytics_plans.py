"""Queries of dashboards and metrics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from deskloom.functions import text as tx
from deskloom.functions.vocabulary import INTENT_NAMES
from deskloom.operators import analytics as an
from deskloom.operators import evaluation as ev
from deskloom.operators import queue as q
from deskloom.plans.registry import Registry
from deskloom.sources.tables import table, views_sql

R = Registry()
T, A, J, D = views_sql("tickets"), views_sql("audit_log"), views_sql("judged"), views_sql("policies")


@R.add(
    "a6_summary",
    f"""{T} SELECT count(*) AS total, count(*) FILTER (lane = 'faq') AS faq, count(*) FILTER (lane = 'human_review') AS human_review, count(*) FILTER (status = 'approved') AS approved,
    count(*) FILTER (status NOT IN ('approved', 'rerouted')) AS pending, coalesce(round(avg(confidence), 4), 0.0) AS avg_confidence, coalesce(round(avg(confidence) FILTER (lane = 'faq'), 4), 0.0) AS avg_faq_confidence FROM tickets""",
)
def summary(spark, d):
    return an.summary(table(spark, d, "tickets"))


@R.add(
    "a7_confidence_bands",
    f"""{T}, b AS (SELECT CASE WHEN confidence < 0.5 THEN 0 WHEN confidence < 0.6 THEN 1 WHEN confidence < 0.7 THEN 2 WHEN confidence < 0.8 THEN 3 WHEN confidence < 0.9 THEN 4 ELSE 5 END AS band FROM tickets WHERE confidence IS NOT NULL),
    dim AS (SELECT * FROM (VALUES (0, '<0.5'), (1, '0.5-0.6'), (2, '0.6-0.7'), (3, '0.7-0.8'), (4, '0.8-0.9'), (5, '0.9-1.0')) v(band, label))
    SELECT dim.band, label, count(b.band) AS n FROM dim LEFT JOIN b ON b.band = dim.band GROUP BY dim.band, label""",
)
def bands(spark, d):
    return an.confidence_bands(table(spark, d, "tickets"))


@R.add("a8_intents", f"{T} SELECT intent, count(*) AS n FROM tickets WHERE intent <> '' GROUP BY intent")
def intents(spark, d):
    return an.intent_distribution(table(spark, d, "tickets"))


@R.add(
    "a9_daily_volume",
    f"""{T} SELECT c.day, count(t.id) AS n FROM (SELECT CAST(unnest(range(TIMESTAMP '2001-07-28', TIMESTAMP '2001-08-04', INTERVAL 1 DAY)) AS DATE) AS day) c
    LEFT JOIN tickets t ON CAST(t.received_at AS DATE) = c.day GROUP BY c.day""",
)
def daily(spark, d):
    return an.daily_volume(table(spark, d, "tickets"), dt.date(2001, 8, 3))


@R.add(
    "a10_win_rates",
    f"""{T}, r AS (SELECT intent, CASE WHEN lane = 'faq' THEN 'auto_reply' ELSE 'human_review' END AS arm, count(*) FILTER (status = 'approved') AS wins, count(*) FILTER (status IN ('approved', 'rerouted')) AS trials FROM tickets GROUP BY 1, 2)
    SELECT *, CASE WHEN trials > 0 THEN round(wins / trials, 6) ELSE 0.5 END AS rate FROM r""",
)
def win_rates(spark, d):
    return an.win_rates(table(spark, d, "tickets"))


@R.add(
    "j3_n1_flagged",
    f"""{views_sql("audit_log", "tickets")}, f AS (SELECT email_id, max(ts) AS flagged_at, arg_min(metadata, (ts, id)) FILTER (kind = 'near_miss') AS near_miss, arg_min(metadata, (ts, id)) FILTER (kind = 'edited') AS edited FROM audit_log GROUP BY email_id)
    SELECT f.*, t.subject FROM f LEFT JOIN tickets t ON t.id = f.email_id""",
)
def flagged(spark, d):
    return an.flagged(table(spark, d, "audit_log"), table(spark, d, "tickets"))


@R.add(
    "a19_drift",
    """WITH x AS (SELECT CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS INTEGER) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    y AS (SELECT days, CASE WHEN days < 1 THEN 0 WHEN days < 7 THEN 1 WHEN days < 30 THEN 2 WHEN days < 365 THEN 3 ELSE 4 END AS bucket FROM x),
    z AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY days) - 1 AS i, count(*) OVER (PARTITION BY bucket) AS n FROM y)
    SELECT bucket, any_value(n) AS n, min(days) AS least, min(days) FILTER (i = n // 2) AS upper_median, max(days) AS most FROM z GROUP BY bucket""",
)
def drift(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return an.drift(rows.select(F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate")).alias("days")))


@R.add(
    "a20_year_profile",
    f"""{T}, y AS (SELECT intent, CAST(year(received_at) AS INTEGER) AS year, count(*) AS c FROM tickets GROUP BY 1, 2), s AS (SELECT *, c / sum(c) OVER (PARTITION BY intent) AS share FROM y)
    SELECT intent, count(*) FILTER (share >= 0.05) AS years, round(max(share), 2) AS max_share, count(*) FILTER (share >= 0.05) >= 3 AS persistent FROM s GROUP BY intent""",
)
def year_profile(spark, d):
    return an.year_profile(table(spark, d, "tickets").withColumn("year", F.year("received_at")), "intent")


@R.add(
    "a22_contract_report",
    f"""WITH d AS (SELECT doc_id % 10 = 3 AS has_notes, len(regexp_extract_all(text, '(?i)\\bth\\w+ th\\w+')) AS leaks, len(regexp_extract_all(text, '\\. [A-Z]')) AS holes FROM documents)
    SELECT count(*) AS drafts, round(100 * round(count(*) FILTER (leaks > 0) / count(*), 6), 1) AS pct_leaks, round(100 * round(count(*) FILTER (holes > 0) / count(*), 6), 1) AS pct_placeholders,
    CAST(sum(holes) AS BIGINT) AS placeholders, count(*) FILTER (has_notes AND holes = 0) AS unpaired_notes FROM d""",
)
def contract_report(spark, d):
    found = lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(0))
    rows = table(spark, d, "documents").select((F.col("doc_id") % 10 == 3).alias("has_notes"), found(r"(?i)\bth\w+ th\w+").alias("leaks"), found(r"\. [A-Z]").alias("placeholders"))
    return an.contract_report(rows)


@R.add(
    "a24_sweep_classes",
    f"""{T} SELECT CASE WHEN ticket_status IN ('solved', 'closed') THEN 'skipped_closed' WHEN n_placeholders > 0 THEN 'skipped_edited' WHEN id % 4 = 1 THEN 'redrafted' ELSE 'unaffected' END AS class, count(*) AS n FROM tickets WHERE status = 'DRAFT_GENERATED' GROUP BY 1""",
)
def sweep(spark, d):
    rows = table(spark, d, "tickets").where("status = 'DRAFT_GENERATED'")
    kind = F.when(F.col("ticket_status").isin("solved", "closed"), "skipped_closed").when(F.col("n_placeholders") > 0, "skipped_edited").when(F.col("id") % 4 == 1, "redrafted").otherwise("unaffected")
    return q.count_by(rows.withColumn("class", kind), "class")


@R.add(
    "a25_c29_template_groups",
    r"""WITH k AS (SELECT doc_id, text, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}', '<email>', 'g'), 'https?://\S+', '<url>', 'g'),
    '(?m)^(?:dear|hi|hello)\b[^\n,]*,', '<greeting>', 'g'), '\d+', '<n>', 'g'), '\s+', ' ', 'g')) AS template FROM documents)
    SELECT md5(template) AS template, count(*) AS n, arg_min(doc_id, doc_id) AS first FROM k GROUP BY k.template""",
)
def templates(spark, d):
    groups = an.template_groups(table(spark, d, "documents"), tx.template_key(F.col("text")), "doc_id", "doc_id")
    return groups.withColumn("template", F.md5("template"))


@R.add(
    "a27_label_index",
    f"""{D}, p AS (SELECT DISTINCT label, id FROM (SELECT unnest([intent_a, intent_b]) AS label, id FROM policies)),
    v AS (SELECT unnest([{", ".join(f"'{x}'" for x in INTENT_NAMES)}, 'unused']) AS label)
    SELECT v.label, coalesce(list(p.id ORDER BY p.id) FILTER (p.id IS NOT NULL), []) AS keys FROM v LEFT JOIN p ON p.label = v.label GROUP BY v.label""",
)
def label_index(spark, d):
    rows = table(spark, d, "policies").withColumn("labels", F.array("intent_a", "intent_b"))
    vocabulary = spark.createDataFrame([(x,) for x in (*INTENT_NAMES, "unused")], "label string")
    return an.label_index(rows, "labels", "id", vocabulary)


@R.add("a28_group_report", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS keys, min(user_id) AS first, max(user_id) AS last FROM events GROUP BY event_type")
def group_report(spark, d):
    return an.group_report(table(spark, d, "events"), "event_type", "user_id")


@R.add("a11_brier", f"{J} SELECT round(avg((p - truth) ** 2), 6) AS brier FROM judged")
def brier(spark, d):
    return ev.brier(table(spark, d, "judged"))


BIN = "CASE " + " ".join(f"WHEN p <= {e} THEN {i}" for i, e in enumerate(ev.EDGES)) + " END"


@R.add("a12_ece", f"{J}, b AS (SELECT {BIN} AS bin, count(*) AS n, avg(p) AS conf, avg(truth) AS acc FROM judged GROUP BY 1) SELECT round(sum(n * abs(acc - conf)) / sum(n), 6) AS ece FROM b")
def ece(spark, d):
    return ev.calibration_error(table(spark, d, "judged"))


@R.add(
    "a13_reliability",
    f"{J}, b AS (SELECT {BIN} AS bin, count(*) AS n, round(avg(p), 4) AS mean_conf, round(avg(truth), 4) AS acc FROM judged GROUP BY 1) SELECT *, round(acc - mean_conf, 4) AS gap FROM b",
)
def reliability(spark, d):
    return ev.reliability(table(spark, d, "judged"))


@R.add(
    "a14_class_report",
    f"""{T}, r AS (SELECT intent AS truth, CASE WHEN id % 3 = 0 THEN 'cms_support' ELSE intent END AS predicted FROM tickets),
    l AS (SELECT truth AS label FROM r UNION SELECT predicted FROM r),
    c AS (SELECT label, (SELECT count(*) FROM r WHERE truth = label AND predicted = label) AS hit, (SELECT count(*) FROM r WHERE truth = label) AS support, (SELECT count(*) FROM r WHERE predicted = label) AS said FROM l)
    SELECT label, CASE WHEN said > 0 THEN round(hit / said, 6) ELSE 0 END AS precision, CASE WHEN support > 0 THEN round(hit / support, 6) ELSE 0 END AS recall,
    CASE WHEN said + support > 0 THEN round(2 * hit / (said + support), 6) ELSE 0 END AS f1, support FROM c""",
)
def class_report(spark, d):
    rows = table(spark, d, "tickets").select(F.col("intent").alias("truth"), F.when(F.col("id") % 3 == 0, "cms_support").otherwise(F.col("intent")).alias("predicted"))
    return ev.class_report(rows)


@R.add("a14_confusion", f"{J} SELECT truth, predicted, count(*) AS n FROM judged GROUP BY ALL")
def confusion(spark, d):
    return ev.confusion(table(spark, d, "judged"))


@R.add(
    "a14_accuracy",
    f"""{J}, m AS (SELECT v AS label, count(*) FILTER (truth = v AND predicted = v) AS hit, count(*) FILTER (truth = v) AS support, count(*) FILTER (predicted = v) AS said FROM judged, (VALUES (0), (1)) x(v) GROUP BY v)
    SELECT (SELECT round(avg(CASE WHEN truth = predicted THEN 1.0 ELSE 0.0 END), 6) FROM judged) AS accuracy, (SELECT round(avg(round(2 * hit / (said + support), 6)), 6) FROM m) AS macro_f1""",
)
def accuracy(spark, d):
    return ev.accuracy(table(spark, d, "judged"))


@R.add("a15_lane_breakdown", f"{T} SELECT lane, count(*) AS total, count(*) FILTER (status = 'approved') AS hits, round(count(*) FILTER (status = 'approved') / count(*), 2) AS rate FROM tickets GROUP BY lane")
def lanes(spark, d):
    return ev.group_rates(table(spark, d, "tickets"), "lane", F.col("status") == "approved")


@R.add("a16_coverage", f"{D} SELECT category, count(*) AS total, count(*) FILTER (status = 'active') AS hits, round(count(*) FILTER (status = 'active') / count(*), 2) AS rate FROM policies GROUP BY category")
def coverage(spark, d):
    return ev.group_rates(table(spark, d, "policies"), "category", F.col("status") == "active")


@R.add("a17_top_confusions", f"{T} SELECT intent, ticket_status, count(*) AS n FROM tickets WHERE ticket_status IS NOT NULL GROUP BY ALL ORDER BY n DESC, intent, ticket_status LIMIT 10")
def top_confusions(spark, d):
    return ev.most_common(table(spark, d, "tickets").where("ticket_status IS NOT NULL"), 10, "intent", "ticket_status")


@R.add("a18_a23_means", "SELECT event_type, round(avg(value), 2) AS mean, round(avg(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)), 2) AS mean_k FROM events GROUP BY event_type")
def means(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("double")
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 2).alias("mean"), F.round(F.avg(k), 2).alias("mean_k"))


@R.add(
    "n15_blinded_blocks",
    """WITH x AS (SELECT user_id, event_type FROM events GROUP BY ALL), w AS (SELECT user_id FROM x GROUP BY user_id HAVING count(*) = 5),
    n AS (SELECT user_id, CAST((row_number() OVER (ORDER BY user_id) - 1) // 10 AS BIGINT) AS batch FROM w)
    SELECT x.user_id, x.event_type, batch, chr(CAST(65 + (rank() OVER (PARTITION BY x.user_id ORDER BY x.event_type) - 1 + x.user_id % 5) % 5 AS INTEGER)) AS letter FROM x JOIN n USING (user_id)""",
)
def blinded(spark, d):
    return ev.complete_blocks(table(spark, d, "events").select("user_id", "event_type").distinct(), "user_id", "event_type", 5, 10)
