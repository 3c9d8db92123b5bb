"""Queries of text functions, classification and routing."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from deskloom.functions import routing as ro
from deskloom.functions import text as tx
from deskloom.functions.markup import sanitised as sanitised_html
from deskloom.functions.vocabulary import INTENT_NAMES, KEYWORDS, RANKING_STOP_WORDS
from deskloom.plans.registry import Registry
from deskloom.session import small_batches
from deskloom.sources.tables import table, views_sql

R = Registry()
T, O, D, A = views_sql("tickets"), views_sql("owners"), views_sql("policies"), views_sql("audit_log")
STOP = ", ".join(f"'{w}'" for w in RANKING_STOP_WORDS)


@R.add("c1_tokens", f"SELECT item_id, array_to_string(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '' AND x NOT IN ({STOP})), ' ') AS tokens FROM benchmark")
def tokens(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(tx.ranking_tokens(F.col("text")), " ").alias("tokens"))


@R.add("c2_leaf_title", f"{D} SELECT id, CASE WHEN contains(title, ' — ') THEN substr(title, instr(title, ' — ') + 3) ELSE title END AS leaf FROM policies")
def leaf(spark, d):
    return table(spark, d, "policies").select("id", tx.leaf_title(F.col("title")).alias("leaf"))


def _texts(spark, d):
    """Letters made of the tables' values, so that every cue turns up: a subject and a body."""
    cues = [c for name in INTENT_NAMES for c in KEYWORDS[name]]
    cue = lambda n: F.element_at(F.array(*(F.lit(c) for c in cues)), (F.pmod(F.col("o_orderkey") * n, F.lit(len(cues))) + 1).cast("int"))
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderkey") % 4 == 0, "Question").otherwise(F.concat(F.lit("About the "), F.upper(cue(7)))).alias("subject"),
        F.when(F.col("o_orderkey") % 9 == 0, "Hello").otherwise(F.concat(F.lit("Dear chairs, "), cue(7), F.lit(" and "), cue(11), F.lit(", see paper 1234."))).alias("body"),
    )


_CUES = ", ".join(f"'{c}'" for name in INTENT_NAMES for c in KEYWORDS[name])
_N = sum(len(KEYWORDS[name]) for name in INTENT_NAMES)
_RULES = ", ".join(f"({i}, '{name}', '{c}')" for i, name in enumerate(INTENT_NAMES) for c in KEYWORDS[name])
TEXTS = f"""texts AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'Question' ELSE 'About the ' || upper([{_CUES}][o_orderkey * 7 % {_N} + 1]) END AS subject,
    CASE WHEN o_orderkey % 9 = 0 THEN 'Hello' ELSE 'Dear chairs, ' || [{_CUES}][o_orderkey * 7 % {_N} + 1] || ' and ' || [{_CUES}][o_orderkey * 11 % {_N} + 1] || ', see paper 1234.' END AS body FROM orders)"""


@R.add(
    "c3_classified",
    f"""WITH {TEXTS}, rules AS (SELECT * FROM (VALUES {_RULES}) v(place, intent, cue)),
    h AS (SELECT id, place, intent, sum(CASE WHEN contains(lower(subject), cue) AND contains(lower(body), cue) THEN 1.5 WHEN contains(lower(subject), cue) OR contains(lower(body), cue) THEN 1.0 ELSE 0.0 END) AS s FROM texts, rules GROUP BY ALL),
    r AS (SELECT id, intent, least(CAST(s AS DOUBLE) / 5, CAST(0.95 AS DOUBLE)) AS conf, row_number() OVER (PARTITION BY id ORDER BY s DESC, place) AS n FROM h WHERE s > 0),
    g AS (SELECT id, max(intent) FILTER (n = 1) AS intent, max(conf) FILTER (n = 1) AS c1, max(conf) FILTER (n = 2) AS c2, list(intent ORDER BY n) FILTER (n IN (2, 3)) AS secondary FROM r GROUP BY id)
    SELECT t.id, coalesce(intent, 'cms_support') AS intent, CASE WHEN intent IS NULL THEN 0.3 ELSE round(greatest(c1 - CASE WHEN coalesce(c1 - c2 <= CAST(0.1 AS DOUBLE), false) THEN CAST(0.15 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END, 0), 4) END AS confidence, coalesce(secondary, []) AS secondary FROM texts t LEFT JOIN g USING (id)""",
)
def classified(spark, d):
    return ro.classified(_texts(spark, d)).select("id", "intent", "confidence", "secondary")


@R.add(
    "r20_calibration_pairs",
    f"""WITH {TEXTS}, rules AS (SELECT * FROM (VALUES {_RULES}) v(place, intent, cue)),
    h AS (SELECT id, place, intent, sum(CASE WHEN contains(lower(subject), cue) AND contains(lower(body), cue) THEN 1.5 WHEN contains(lower(subject), cue) OR contains(lower(body), cue) THEN 1.0 ELSE 0.0 END) AS s FROM texts, rules GROUP BY ALL),
    r AS (SELECT id, intent FROM h WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, place) = 1)
    SELECT coalesce(intent, 'cms_support') = [{", ".join(f"'{x}'" for x in INTENT_NAMES)}][id % 14 + 1] AS correct, count(*) AS n FROM texts LEFT JOIN r USING (id) GROUP BY 1""",
)
def pairs(spark, d):
    gold = F.element_at(F.array(*(F.lit(x) for x in INTENT_NAMES)), (F.col("id") % 14 + 1).cast("int"))
    return ro.classified(_texts(spark, d)).groupBy((F.col("intent") == gold).alias("correct")).agg(F.count("*").alias("n"))


@R.add(
    "c4_c5_lanes",
    f"""{T}, c AS (SELECT *, coalesce(calibrated, confidence) AS used FROM tickets),
    w AS (SELECT *, CASE WHEN n_placeholders > 0 THEN 'draft has ' || n_placeholders || ' chair placeholder(s)' WHEN has_notes THEN 'draft has notes for the chair' WHEN n_citations = 0 THEN 'draft cites no policy (ungrounded)'
        WHEN used < 0.65 THEN 'intent confidence ' || format('{{:.2f}}', used) || ' < 0.65' WHEN answer_confidence IS NULL THEN 'drafter provided no answer confidence'
        WHEN answer_confidence < 0.85 THEN 'answer confidence ' || format('{{:.2f}}', answer_confidence) || ' < 0.85' END AS why FROM c)
    SELECT id, CASE WHEN why IS NULL THEN 'faq' ELSE 'human_review' END AS lane, coalesce(why, 'complete grounded draft') AS reason FROM w""",
)
def lanes(spark, d):
    lane, why = ro.lane_reason(F.col("n_placeholders"), F.col("has_notes"), F.col("n_citations"), ro.used_confidence(F.col("calibrated"), F.col("confidence")), F.col("answer_confidence"))
    return table(spark, d, "tickets").select("id", lane.alias("lane"), why.alias("reason"))


@R.add("c6_floored_lane", f"{T} SELECT id, CASE WHEN n_placeholders > 0 OR has_notes OR answer_confidence IS NULL OR n_citations = 0 THEN 'human_review' ELSE lane END AS lane FROM tickets")
def floored(spark, d):
    lane = ro.floored_lane(F.col("lane"), F.col("n_placeholders"), F.col("has_notes"), F.col("n_citations"), F.col("answer_confidence"))
    return table(spark, d, "tickets").select("id", lane.alias("lane"))


@R.add("c7_bandit_lane", f"{T} SELECT id, CASE WHEN confidence < 0.4 OR confidence < 0.65 THEN 'human_review' WHEN n_citations >= n_placeholders THEN 'faq' ELSE 'human_review' END AS lane FROM tickets")
def bandit(spark, d):
    return table(spark, d, "tickets").select("id", ro.bandit_lane(F.col("confidence"), F.col("n_citations"), F.col("n_placeholders")).alias("lane"))


@R.add("c8_near_miss", f"{T} SELECT id FROM tickets WHERE coalesce(calibrated, confidence) >= CAST(0.65 AS DOUBLE) - CAST(0.15 AS DOUBLE) AND coalesce(calibrated, confidence) < 0.65")
def near(spark, d):
    return table(spark, d, "tickets").where(ro.near_miss(ro.used_confidence(F.col("calibrated"), F.col("confidence")))).select("id")


@R.add(
    "j4_owner",
    f"""{views_sql("owners", "tickets")}, names AS (SELECT [{", ".join(f"'{x}'" for x in INTENT_NAMES)}] AS n), a AS (SELECT id, unnest(CASE WHEN fallback THEN CAST([] AS VARCHAR[]) ELSE [n[area_a + 1], n[area_b + 1]] END) AS intent FROM owners, names WHERE active AND area_a < 9),
    m AS (SELECT intent, min(id) AS owner FROM a GROUP BY intent), f AS (SELECT min(id) AS owner FROM owners WHERE active AND fallback)
    SELECT t.id, coalesce(m.owner, (SELECT owner FROM f)) AS owner FROM tickets t LEFT JOIN m USING (intent)""",
)
def owner(spark, d):
    name = lambda c: F.element_at(F.array(*(F.lit(x) for x in INTENT_NAMES)), F.col(c) + 1)
    areas = F.when(F.col("fallback"), F.array().cast("array<string>")).otherwise(F.array(name("area_a"), name("area_b")))
    roster = table(spark, d, "owners").where("area_a < 9 OR fallback").select("id", "active", areas.alias("areas"))
    return ro.owner_of(table(spark, d, "tickets").select(F.col("id").alias("ticket"), "intent"), roster).select(F.col("ticket").alias("id"), "owner")


@R.add(
    "c21_send_decision",
    f"""{T} SELECT id, CASE WHEN id % 19 = 0 THEN 'no text' WHEN n_placeholders > 0 THEN 'placeholders' WHEN lower(status) = 'approved' THEN 'approved' WHEN lane = 'faq' AND id % 5 = 3 THEN 'leaks'
    WHEN lane = 'faq' AND lower(status) = 'draft_generated' THEN 'auto' ELSE 'needs approval' END AS decision FROM tickets""",
)
def send(spark, d):
    i = F.col("id")
    decision = ro.send_decision(F.when(i % 19 != 0, F.lit("x")), F.col("n_placeholders"), F.col("status"), F.col("lane"), (i % 5 == 3).cast("int"), auto=True)
    return table(spark, d, "tickets").select("id", decision.alias("decision"))


@R.add(
    "c15_c19_reply_parts",
    r"""WITH x AS (SELECT doc_id, 'Reply:' || chr(10) || '[CHAIR: ' || source || ' ] ' || text || ' (see policy_' || doc_id || ', int_a-b) we will  check policy_7 , and policy_7 cannot confirm. [Sender name]' AS t FROM documents)
    SELECT doc_id, list_transform(regexp_extract_all(t, '\[CHAIR:\s*([^\]]*)\]', 1), lambda h: trim(h)) AS placeholders,
    list_sort(list_distinct(regexp_extract_all(t, 'policy_\d+|int_[a-z0-9-]+'))) AS citations, len(regexp_extract_all(t, '(?i)\bwe\s+(?:will|''ll)\s+(?:look\s+into|check|verify|confirm|investigate|follow\s+up)')) + len(regexp_extract_all(t, '(?i)\b(?:cannot|can''?t|unable\s+to)\s+(?:confirm|verify|determine)\b')) AS n_leaks FROM x""",
)
def reply_parts(spark, d):
    t = F.concat(F.lit("Reply:\n[CHAIR: "), F.col("source"), F.lit(" ] "), F.col("text"), F.lit(" (see policy_"), F.col("doc_id").cast("string"), F.lit(", int_a-b) we will  check policy_7 , and policy_7 cannot confirm. [Sender name]"))
    return table(spark, d, "documents").select("doc_id", tx.placeholders(t).alias("placeholders"), F.array_sort(tx.citations(t)).alias("citations"), F.size(tx.leaks(t)).cast("long").alias("n_leaks"))


@R.add(
    "c17_sanitised",
    r"""WITH x AS (SELECT doc_id, 'Draft reply:' || chr(10) || 'Dear ' || source || ' , thanks (see policy_' || doc_id || ', int_a-b)  for  it . policy_7 [sender_name]' AS t FROM documents)
    SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?i)^\s*(?:draft\s+reply|reply|draft)\s*:\s*\n+', ''),
    '\s*\((?:see\s+)?(?:policy_\d+|int_[a-z0-9-]+)(?:\s*,\s*(?:policy_\d+|int_[a-z0-9-]+))*\)|\b(?:policy_\d+|int_[a-z0-9-]+)\b', '', 'g'), '(?i)\[\s*sender[\s_]?name\s*\]', 'The Chairs', 'g'), '[ \t]+([.,;:!?])', '\1', 'g'), '[ \t]{2,}', ' ', 'g'), '^\s+|\s+$', '', 'g') AS reply FROM x""",
)
def sanitised(spark, d):
    t = F.concat(F.lit("Draft reply:\nDear "), F.col("source"), F.lit(" , thanks (see policy_"), F.col("doc_id").cast("string"), F.lit(", int_a-b)  for  it . policy_7 [sender_name]"))
    return table(spark, d, "documents").select("doc_id", tx.sanitised(t, "The Chairs").alias("reply"))


@R.add(
    "c18_sections",
    r"""SELECT item_id, text AS reply, ['policy_' || item_id] AS citations, CASE WHEN item_id % 3 = 0 THEN NULL ELSE 'check ' || item_id END AS notes, CASE WHEN item_id % 4 = 0 THEN NULL WHEN item_id % 4 = 1 THEN 1.0 ELSE 0.5 END AS confidence FROM benchmark""",
)
def sections(spark, d):
    i = F.col("item_id")
    conf = F.when(i % 4 == 0, "").when(i % 4 == 1, "=== Confidence ===\n3.5").otherwise("===CONFIDENCE===  about 0.5")
    t = F.concat(F.lit("=== REPLY ===\n"), F.trim("text"), F.lit("\n=== CITATIONS ===\npolicy_"), i.cast("string"), F.lit("\n=== NOTES FOR CHAIR ===\n"), F.when(i % 3 == 0, "None.").otherwise(F.concat(F.lit("check "), i.cast("string"))), F.lit("\n"), conf)
    return table(spark, d, "benchmark").withColumn("s", tx.sections(t)).select("item_id", "s.reply", "s.citations", "s.notes", "s.confidence")


@R.add(
    "c13_people",
    """SELECT c_custkey, [{'name': c_name, 'email': CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE 'a@b.c' END, 'affiliation': CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment || '|x' ELSE c_mktsegment END}] AS people FROM customer""",
)
def people(spark, d):
    i = F.col("c_custkey")
    line = F.concat(F.col("c_name"), F.lit(" | "), F.when(i % 2 == 0, "none").otherwise("a@b.c"), F.lit("|"), F.col("c_mktsegment"), F.when(i % 3 == 0, "|x").otherwise(""), F.lit("\nNONE| |none\n"))
    return table(spark, d, "customer").select("c_custkey", tx.people(line).alias("people"))


@R.add("c14_method", f"{T} SELECT id, CASE WHEN n_placeholders > 0 THEN 'llm' WHEN has_notes THEN 'regex' ELSE 'none' END AS method FROM tickets")
def method(spark, d):
    return table(spark, d, "tickets").select("id", F.when(F.col("n_placeholders") > 0, "llm").when(F.col("has_notes"), "regex").otherwise("none").alias("method"))


@R.add("c20_labelled_lines", "SELECT item_id, CASE WHEN item_id % 5 = 0 THEN NULL ELSE [regexp_replace(text, '\\s+', ' ', 'g')] END AS queries FROM benchmark")
def labelled_lines(spark, d):
    body = F.trim(F.regexp_replace("text", r"\s+", " "))
    t = F.concat(F.when(F.col("item_id") % 5 == 0, F.lit("Q: ")).otherwise(F.lit("query:  ")), body, F.lit("\nQUERY: none\nINTENT: x"))
    t = F.when(F.col("item_id") % 5 == 0, F.lit("INTENT: x")).otherwise(t)
    out = table(spark, d, "benchmark").select("item_id", F.regexp_replace("text", r"\s+", " ").alias("p"), tx.labelled_lines(t, "QUERY").alias("q"))
    return out.select("item_id", F.when(F.col("q").isNotNull(), F.array("p")).alias("queries"))


@R.add(
    "c28_scrubbed",
    r"""SELECT doc_id, left(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email]', 'g'), 'https?://\S+', '[url]', 'g'), '\d{4,}', '[num]', 'g'), '\s+', ' ', 'g')), 300) AS text FROM documents""",
)
def scrubbed(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.scrubbed(F.col("text")).alias("text"))


@R.add("c27_without_tail", "SELECT doc_id, md5(CASE WHEN instr(text, chr(10)) > 0 THEN left(text, instr(text, chr(10)) - 1) ELSE text END) AS head FROM documents")
def without_tail(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(tx.without_tail(F.col("text"), ("\n", "\nFrom: "))).alias("head"))


@R.add(
    "c26_clean_body",
    r"""SELECT item_id, left(regexp_replace(regexp_replace(regexp_replace('Hi' || chr(10) || text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g'), 2000) AS body FROM benchmark""",
)
def clean_body(spark, d):
    t = F.concat(F.lit("> quoted\nHi\n"), F.col("text"), F.lit("\nFrom: somebody\nmore"))
    return table(spark, d, "benchmark").select("item_id", tx.clean_body(t).alias("body"))


@R.add(
    "c25_stripped_html",
    r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(?:script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS preview FROM pages""",
)
def stripped(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(tx.stripped_html(F.col("html"))).alias("preview"))


@R.add(
    "c25_paragraphs",
    "SELECT item_id, '<p>' || replace(replace(replace(replace(replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') || '</p><p><br>&quot;a&quot; &lt; b<br>it&#x27;s</p>' AS html FROM benchmark",
)
def paragraphs(spark, d):
    t = F.concat(F.lit("\n"), F.trim(F.regexp_replace("text", r"\s+", " ")), F.lit("\n\n\n\"a\" < b\nit's\n"))
    return table(spark, d, "benchmark").select("item_id", tx.paragraphs(t).alias("html"))


@R.add("c25_sanitised")
def sanitised(spark, d):
    return table(spark, d, "pages").select("page_id", sanitised_html("html").alias("html"))


@R.add(
    "c22_fingerprint",
    f"""{D} SELECT id, sha1('[["' || policy_key || '", ["' || least(intent_a, intent_b) || '", "' || greatest(intent_a, intent_b) || '"]]]') AS fingerprint FROM policies""",
)
def fingerprint(spark, d):
    chunk = F.array(F.struct(F.col("policy_key").alias("id"), F.array("intent_b", "intent_a").alias("intents")))
    return table(spark, d, "policies").select("id", tx.fingerprint(chunk).alias("fingerprint"))


@R.add("c23_c24_times", "SELECT event_id, epoch_us(ts - INTERVAL 2 HOUR) AS at_us, strftime(ts - INTERVAL 12 HOUR, '%Y-%m-%d %H:%M') || ' AoE' AS aoe FROM events")
def times(spark, d):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+02:00"))
    return table(spark, d, "events").select("event_id", F.unix_micros(tx.moment(text)).alias("at_us"), tx.last_place_on_earth(F.col("ts")).alias("aoe"))


@R.add("c30_cycle", "SELECT o_orderkey, CASE year(o_orderdate) WHEN 1996 THEN 'c96' WHEN 1998 THEN 'c98' ELSE 'other' END AS cycle FROM orders")
def cycles(spark, d):
    return table(spark, d, "orders").select("o_orderkey", tx.cycle(F.year("o_orderdate"), {1996: "c96", 1998: "c98"}).alias("cycle"))


@R.add("c31_query_text", "SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN source || ' ' || lang ELSE trim(source || ' ' || left(text, 600)) END) AS query FROM documents")
def query_text(spark, d):
    distilled = F.when(F.col("doc_id") % 3 == 0, F.array("source", "lang")).when(F.col("doc_id") % 3 == 1, F.array().cast("array<string>"))
    return table(spark, d, "documents").select("doc_id", F.md5(tx.query_text(distilled, F.col("source"), F.col("text"))).alias("query"))


@R.add("c33_json_slice", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, ['k'] AS spoken FROM events")
def json_slice(spark, d):
    t = F.concat(F.lit("Sure! ```json\n"), F.col("props"), F.lit("\n``` done"))
    return table(spark, d, "events").select("event_id", F.try_variant_get(tx.json_slice(t), "$.k", "int").alias("k"), tx.spoken(F.array(F.lit("k"), F.lit("not there")), F.col("props")).alias("spoken"))


@R.add(
    "c34_model_record",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'q' || event_id WHEN 1 THEN '' WHEN 2 THEN '' END AS what_was_asked, CASE event_id % 5 WHEN 0 THEN ['one'] WHEN 1 THEN ['x', 'y'] WHEN 2 THEN CAST([] AS VARCHAR[]) END AS steps_taken,
    CASE WHEN event_id % 5 < 3 THEN '' END AS resolution, CASE WHEN event_id % 5 = 0 THEN ['p1'] END AS policy_or_reference_used, CASE event_id % 5 WHEN 0 THEN 'escalated' WHEN 1 THEN 'no_clear_resolution' WHEN 2 THEN 'no_clear_resolution' END AS outcome_type FROM events""",
)
def model_record(spark, d):
    i = F.col("event_id")
    full = F.concat(F.lit('{"what_was_asked": " q'), i.cast("string"), F.lit(' ", "steps_taken": "one", "resolution": 5, "policy_or_reference_used": ["N/A", " p1 ", ""], "outcome_type": " Escalated "}'))
    said = F.when(i % 5 == 0, full).when(i % 5 == 1, F.lit('{"steps_taken": [" x ", "", 7, "y"], "policy_or_reference_used": "none", "outcome_type": "bogus"}'))
    said = said.when(i % 5 == 2, F.lit("{}")).when(i % 5 == 3, F.lit("no record")).otherwise(F.lit("[1]"))
    return table(spark, d, "events").select("event_id", tx.model_record(F.try_parse_json(said)).alias("r")).select("event_id", "r.*")


@R.add(
    "c39_c40_labels",
    f"""{T} SELECT id, CASE WHEN id % 3 = 0 THEN 'cms_support' ELSE intent END AS label, id % 3 = 0 OR intent = 'cms_support' AS is_fallback, CASE WHEN intent IN ('paper_bidding', 'cms_support') THEN [intent] ELSE CAST([] AS VARCHAR[]) END AS known FROM tickets""",
)
def labels(spark, d):
    said = F.when(F.col("id") % 3 == 0, "no such label").when(F.col("id") % 3 == 1, F.upper("intent")).otherwise(F.col("intent"))
    rows = table(spark, d, "tickets").select("id", tx.constrained(said, INTENT_NAMES, "cms_support").alias("x"), tx.known_labels(F.array("intent", F.lit("bogus"), "intent"), ("paper_bidding", "cms_support")).alias("known"))
    return rows.select("id", "x.label", "x.is_fallback", "known")


@R.add("c36_display", f"{T} SELECT id, upper(left(intent, 1)) || replace(substr(intent, 2), '_', ' ') AS label, 'C' AS initials, CASE WHEN date_diff('day', received_at, TIMESTAMP '2001-08-02') >= 1 THEN 'd' END AS unit FROM tickets")
def display(spark, d):
    rows = table(spark, d, "tickets")
    age = tx.age_label(F.col("received_at"), dt.datetime(2001, 8, 2))
    return rows.select("id", tx.display_label(F.col("intent")).alias("label"), tx.initials(F.col("sender")).alias("initials"), F.regexp_extract(age, r"^\d+([mhd]) ago$", 1).alias("unit"))


@R.add("c37_template_draft", f"{D} SELECT id, md5('Thank you.' || chr(10) || chr(10) || concat_ws(chr(10) || chr(10), title, content) || chr(10) || chr(10) || 'Kind regards') AS draft FROM policies")
def template_draft(spark, d):
    """The draft that assembles a policy's two parts."""
    return table(spark, d, "policies").select("id", F.md5(F.concat_ws("\n\n", F.lit("Thank you."), "title", "content", F.lit("Kind regards"))).alias("draft"))


@R.add("c41_c42_c38_history", f"{T} SELECT id, CASE WHEN status = 'SENT' THEN CAST([] AS VARCHAR[]) ELSE [lane] END AS history, CASE WHEN owner_id IS NULL THEN NULL ELSE owner_id = 3 END AS by_requester, CASE lane WHEN 'faq' THEN 'DRAFT_GENERATED' ELSE 'DRAFT_FAILED' END AS lifecycle FROM tickets")
def history(spark, d):
    empty = F.array().cast("array<string>")
    life = F.create_map(F.lit("faq"), F.lit("DRAFT_GENERATED"), F.lit("human_review"), F.lit("DRAFT_FAILED"))
    return table(spark, d, "tickets").select(
        "id",
        F.when(F.col("status") != "SENT", F.array_append(empty, F.col("lane"))).otherwise(empty).alias("history"),
        F.when(F.col("owner_id").isNotNull(), F.col("owner_id").eqNullSafe(F.lit(3))).alias("by_requester"),
        F.try_element_at(life, "lane").alias("lifecycle"),
    )


@R.add("c9_edit_ratio")
def edit_ratio(spark, d):
    b = table(spark, d, "benchmark")
    return b.select("item_id", F.round(tx.edit_ratio(F.col("text"), F.concat(F.col("text"), F.lit(" and more"))), 6).alias("ratio"))


@R.add("c10_similarity")
def similarity(spark, d):
    b = table(spark, d, "benchmark")
    pairs = b.select("item_id", "text").join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other")), "item_id")
    return pairs.select("item_id", F.round(tx.similarity(F.col("text"), F.col("other")), 6).alias("similarity"))


# a mark after each run of digits stands for the look-ahead, which DuckDB's patterns lack
_CUED = r"(?:paper|submission)s?(?:\s*(?:id|no\.?|number))?((?:\s*[A-Za-z][A-Za-z.\-]{0,11})?)\s*[#:\-]?\s*([0-9]{4,5})\x01"


def _numbers_sql(text: str) -> str:
    marked = f"regexp_replace({text}, '([0-9]+)', '\\1' || chr(1), 'g')"
    hits = f"regexp_extract_all({marked}, '(?i)(?:^|[^A-Za-z0-9\\x01])({_CUED})', 1)"
    dated = f"(regexp_extract(h, '(?i){_CUED}', 1) <> '' AND regexp_matches(h, '[^0-9]20(2[0-9]|3[0-5])\\x01$'))"
    fine = f"list_filter({hits}, lambda h: NOT regexp_matches(h, '(?i)(?:AAAI|IAAI|EAAI)[-\\s]*[0-9]+\\x01$') AND NOT {dated})"
    return f"list_transform({fine}, lambda h: regexp_extract(h, '([0-9]+)\\x01$', 1)) || regexp_extract_all({marked}, '(?:^|[^\\w/\\x01])#([0-9]{{4,5}})\\x01', 1)"


@R.add(
    "c11_c12_identifiers",
    f"""WITH {TEXTS}, l AS (SELECT id, subject, body || ' openreview.net/forum?id=Ab3xY9kLm2 #' || CAST(id % 90000 + 10000 AS VARCHAR) AS body FROM texts),
    n AS (SELECT id, {_numbers_sql('subject')} || {_numbers_sql('body')} AS numbers, regexp_extract_all(body, '(?i:openreview\\.net/(?:forum|pdf)\\?id=)([A-Za-z0-9]{{10}})(?:$|[^A-Za-z0-9])', 1) AS forums FROM l)
    SELECT id, list_filter(numbers, lambda x, i: list_position(numbers, x) = i) AS numbers, list_filter(forums, lambda x, i: list_position(forums, x) = i) AS forums FROM n""",
)
def identifiers(spark, d):
    rows = _texts(spark, d)
    link = F.concat(F.col("body"), F.lit(" openreview.net/forum?id=Ab3xY9kLm2 #"), (F.col("id") % 90000 + 10000).cast("string"))
    return rows.select("id", tx.submission_numbers(F.col("subject"), link).alias("numbers"), tx.forum_ids(link).alias("forums"))


@R.add("c35_word_diff")
def word_diff(spark, d):
    small_batches(spark)
    b = table(spark, d, "documents")
    return b.select("doc_id", tx.word_diff(F.col("text"), F.regexp_replace("text", r"\bthe\b", "a")).alias("diff"))
