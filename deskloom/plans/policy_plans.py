"""Queries of the policy corpus, its changes, and mining filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from deskloom.operators import mining as mi
from deskloom.operators import policies as po
from deskloom.operators import threads as th
from deskloom.plans.registry import Registry
from deskloom.sources.tables import table, views_sql

R = Registry()
D, A, M, O = views_sql("policies"), views_sql("audit_log"), views_sql("messages"), views_sql("owners")
ROOT = "coalesce(nullif(root_key, ''), policy_key)"


@R.add("f5_browse", f"{D} SELECT id, title FROM policies WHERE visibility = 'public' AND status = 'active' AND (title ILIKE '%the%' OR content ILIKE '%the%')")
def browse(spark, d):
    return po.browse(table(spark, d, "policies"), "public", "active", "the").select("id", "title")


@R.add("f6_active_corpus", f"{D} SELECT id FROM policies WHERE status = 'active' AND visibility IN ('public')")
def active(spark, d):
    return po.active_corpus(table(spark, d, "policies")).select("id")


@R.add("f8_live_tips", f"{D} SELECT policy_key FROM policies WHERE status = 'active' AND superseded_by IS NULL")
def tips(spark, d):
    return po.live_tips(table(spark, d, "policies")).select("policy_key")


@R.add("f9_lineage_root", f"{D} SELECT {ROOT} AS root, count(*) AS n FROM policies GROUP BY 1")
def roots(spark, d):
    return table(spark, d, "policies").groupBy(po.root_of().alias("root")).agg(F.count("*").alias("n"))


@R.add(
    "j13_without_lineages",
    f"""{D}, r AS (SELECT *, {ROOT} AS root FROM policies), x AS (SELECT root FROM r WHERE id % 10 = 6), k AS (SELECT * FROM r WHERE status = 'active' AND root NOT IN (SELECT root FROM x))
    SELECT policy_key, false AS forced FROM k UNION ALL SELECT policy_key, true FROM r WHERE id % 35 = 0 AND root NOT IN (SELECT root FROM x) AND policy_key NOT IN (SELECT policy_key FROM k)""",
)
def lineages(spark, d):
    rows = table(spark, d, "policies")
    return po.without_lineages(rows.where("status = 'active'"), rows.where("id % 10 = 6"), rows.where("id % 35 = 0")).select("policy_key", "forced")


@R.add(
    "f21_would_empty",
    f"""{D}, r AS (SELECT id, policy_key, {ROOT} AS root FROM policies), x AS (SELECT DISTINCT root FROM r WHERE id % 3 = 0), c AS (SELECT id % 50 AS cid, root FROM r WHERE id % 4 = 0)
    SELECT cid AS id, bool_and(root IN (SELECT root FROM x)) AS would_empty FROM c GROUP BY cid""",
)
def would_empty(spark, d):
    rows = table(spark, d, "policies")
    return po.would_empty(rows.where("id % 4 = 0").select((F.col("id") % 50).alias("id"), "policy_key"), rows, rows.where("id % 3 = 0"))


@R.add(
    "w3_upsert",
    f"""{D}, a AS (SELECT policy_key, title, category, visibility, status FROM policies WHERE id % 2 = 0), b AS (SELECT policy_key, CASE WHEN id % 3 = 0 THEN NULL ELSE 'new ' || id END AS title, category FROM policies WHERE id % 5 < 2)
    SELECT coalesce(a.policy_key, b.policy_key) AS policy_key, coalesce(b.title, a.title) AS title, coalesce(b.category, a.category) AS category, CASE WHEN a.policy_key IS NULL THEN 'public' ELSE a.visibility END AS visibility, CASE WHEN a.policy_key IS NULL THEN 'active' ELSE a.status END AS status
    FROM a FULL JOIN b ON a.policy_key = b.policy_key""",
)
def upsert(spark, d):
    rows = table(spark, d, "policies")
    old = rows.where("id % 2 = 0").select("policy_key", "title", "category", "visibility", "status")
    new = rows.where("id % 5 < 2").select("policy_key", F.when(F.col("id") % 3 != 0, F.concat(F.lit("new "), F.col("id").cast("string"))).alias("title"), "category")
    return po.upserted(old, new, "policy_key", ["title", "category"], {"visibility": F.lit("public"), "status": F.lit("active")})


@R.add("w2_insert_once", "SELECT event_id, user_id FROM events WHERE event_id % 5 = 0 AND event_id % 3 <> 0")
def insert_once(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id")
    return po.inserted_once(rows.where("event_id % 3 = 0"), rows.where("event_id % 5 = 0"), "event_id")


@R.add("w4_patch", f"{views_sql('tickets')} SELECT id, 'approved' AS status, lane FROM tickets")
def patch(spark, d):
    rows = table(spark, d, "tickets").select("id", "status", "lane")
    return po.patched(rows, {"status": F.lit("approved"), "lane": F.lit("faq"), "bogus": F.lit(1)}, ("status", "owner_id"))


@R.add("w5_first_claims", f"{A} SELECT id, email_id, row_number() OVER (PARTITION BY email_id ORDER BY ts, id) = 1 AS won FROM audit_log WHERE action = 'click'")
def claims(spark, d):
    rows = table(spark, d, "audit_log").where("action = 'click'").withColumn("claimer", F.col("id"))
    return po.first_claims(rows, "email_id").select("id", "email_id", "won")


@R.add(
    "w8_governance",
    """WITH RECURSIVE e AS (SELECT 'policy_' || user_id AS root_key, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
    s AS (SELECT DISTINCT root_key, CAST(0 AS BIGINT) AS i, 1 AS tip, 1 AS most, true AS live, [0] AS back FROM e
        UNION ALL SELECT s.root_key, e.i, CASE WHEN event_type = 'click' THEN most + 1 WHEN event_type = 'view' AND back[-1] > 0 THEN back[-1] ELSE tip END, CASE WHEN event_type = 'click' THEN most + 1 ELSE most END,
        CASE WHEN event_type = 'click' THEN true WHEN event_type = 'view' AND back[-1] > 0 THEN true WHEN event_type = 'purchase' THEN false WHEN event_type = 'signup' THEN true ELSE live END,
        CASE WHEN event_type = 'click' THEN list_append(back, tip) WHEN event_type = 'view' AND back[-1] > 0 THEN back[:-2] ELSE back END FROM s JOIN e ON e.root_key = s.root_key AND e.i = s.i + 1),
    f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY root_key ORDER BY i DESC) = 1)
    SELECT CASE WHEN v = 1 THEN root_key ELSE root_key || '__v' || v END AS policy_key, CASE WHEN v = tip AND live THEN 'active' ELSE 'inactive' END AS status, CAST(v AS INTEGER) AS version FROM (SELECT *, unnest(range(1, most + 1)) AS v FROM f)""",
)
def governance(spark, d):
    kinds = F.create_map(*(F.lit(x) for kv in (("click", "edit"), ("view", "revert"), ("purchase", "delete"), ("signup", "reactivate")) for x in kv))
    rows = table(spark, d, "events")
    return po.after_governance(rows.select(F.concat(F.lit("policy_"), F.col("user_id").cast("string")).alias("root_key"), F.col("event_id").alias("seq"), F.coalesce(F.try_element_at(kinds, "event_type"), F.lit("note")).alias("action")))


@R.add(
    "w9_slugs",
    r"""WITH b AS (SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(lower(p_type || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'policy') AS base FROM part),
    n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS i FROM b) SELECT p_partkey, CASE WHEN i = 1 THEN base ELSE base || '-' || i END AS slug FROM n""",
)
def slug(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_type", "p_brand").alias("title"))
    return po.slugs(rows, "title", "p_partkey").select("p_partkey", "slug")


@R.add(
    "j10_pruned_conflicts",
    f"""{D}, t AS (SELECT policy_key FROM policies WHERE status = 'active' AND superseded_by IS NULL), r AS (SELECT id, unnest(['policy_' || (id + 3), 'policy_' || (id + 1), 'policy_' || (id * 2)]) AS policy_key, unnest([1, 2, 3]) AS pos FROM policies)
    SELECT r.id, coalesce(list(t.policy_key ORDER BY pos) FILTER (t.policy_key IS NOT NULL), []) AS kept, CASE WHEN count(t.policy_key) = 0 THEN 'No conflicts.' ELSE count(t.policy_key) || ' conflict(s).' END AS summary FROM r LEFT JOIN t USING (policy_key) GROUP BY r.id""",
)
def conflicts(spark, d):
    rows = table(spark, d, "policies")
    key = lambda x: F.concat(F.lit("policy_"), x.cast("string"))
    i = F.col("id")
    return po.pruned_conflicts(rows.select("id", F.array(key(i + 3), key(i + 1), key(i * 2)).alias("keys")), po.live_tips(rows))


@R.add("w14_review_state", f"{A} SELECT email_id, arg_max(action, (ts, id)) AS state, count(*) AS changes FROM audit_log GROUP BY email_id")
def review(spark, d):
    return po.review_state(table(spark, d, "audit_log"), "email_id")


@R.add(
    "w11_backfill",
    """WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END AS a, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END AS b FROM orders)
    SELECT o_orderkey, b AS a FROM x WHERE b IS NOT NULL AND a IS DISTINCT FROM b""",
)
def backfill(spark, d):
    i, at = F.col("o_orderkey"), F.col("o_orderdate")
    rows = table(spark, d, "orders").select("o_orderkey", F.when(i % 5 != 0, at).alias("a"), F.when(i % 7 != 0, F.when(i % 3 == 0, at + F.expr("INTERVAL 1 DAY")).otherwise(at)).alias("b"))
    return po.backfilled(rows, "a", "b").select("o_orderkey", "a")


@R.add("w6_unlock", "SELECT count(*) AS n FROM events WHERE event_type = 'click'")
def unlock(spark, d):
    rows = table(spark, d, "events").withColumn("busy", F.col("event_type") == "click")
    return rows.where("busy").agg(F.count("*").alias("n"))


@R.add(
    "f17_noise",
    """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN source = 'src3' THEN 'api' WHEN length(trim(text)) < 40 THEN 'short' WHEN regexp_matches(text, '(?i)rights reserved|licensed') THEN 'notice' WHEN regexp_matches(text, '(?i)^\\s*in\\b') AND length(text) < 200 THEN 'forward' END AS reason FROM documents) GROUP BY reason""",
)
def noise(spark, d):
    reason = mi.noise_reason(F.when(F.col("source") == "src3", "api").otherwise("web"), F.col("text"), r"(?i)rights reserved|licensed", r"(?i)^\s*in\b")
    return table(spark, d, "documents").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@R.add("f18_without_tags", f"{D} SELECT id FROM policies WHERE NOT list_has_any([intent_a, intent_b], ['cms_support', 'paper_bidding'])")
def without_tags(spark, d):
    return mi.without_tags(table(spark, d, "policies").withColumn("tags", F.array("intent_a", "intent_b")), "tags", ("cms_support", "paper_bidding")).select("id")


@R.add(
    "f19_pure_merges",
    f"""{M}, x AS (SELECT email_id, turn, nullif(regexp_extract(body, '(?i)^(\\w*t\\w*)', 1), '') AS target FROM messages WHERE role = 'assistant') SELECT email_id, arg_min(target, turn) AS target FROM x GROUP BY email_id HAVING bool_and(target IS NOT NULL)""",
)
def merges(spark, d):
    return mi.pure_merges(table(spark, d, "messages"), r"(?i)^(\w*t\w*)")


@R.add(
    "u4_overlap",
    """WITH w AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM benchmark) SELECT a.item_id AS a, b.item_id AS b, CAST(len(list_intersect(a.w, b.w)) AS INTEGER) AS shared FROM w a JOIN w b ON b.item_id = a.item_id + 1""",
)
def overlap(spark, d):
    b = table(spark, d, "benchmark")
    pairs = b.select(F.col("item_id").alias("a"), F.col("text").alias("x")).join(b.select(F.col("item_id").alias("b"), (F.col("item_id") - 1).alias("a"), F.col("text").alias("y")), "a")
    return pairs.select("a", "b", mi.overlap(F.col("x"), F.col("y")).alias("shared"))


@R.add(
    "j12_tag_union",
    f"{D} SELECT p.id, list_sort(list_distinct([p.intent_a, p.intent_b] || coalesce(CASE WHEN l.doc_id IS NOT NULL THEN ['quality_' || l.quality] END, []))) AS tags FROM policies p LEFT JOIN labels l ON l.doc_id = p.id",
)
def tag_union(spark, d):
    rows = table(spark, d, "policies").select("id", F.array("intent_a", "intent_b").alias("tags"))
    more = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.array(F.concat(F.lit("quality_"), F.col("quality").cast("string"))).alias("more"))
    return rows.join(more, "id", "left").select("id", F.array_sort(F.array_union("tags", F.coalesce("more", F.array().cast("array<string>")))).alias("tags"))


@R.add("j6_labelled_sample", f"{D} SELECT p.id, l.quality FROM policies p JOIN labels l ON l.doc_id = p.id WHERE p.status = 'active' AND l.toxic = 0")
def labelled(spark, d):
    rows = table(spark, d, "policies").where("status = 'active'").select("id")
    return rows.join(table(spark, d, "labels").where("toxic = 0").withColumnRenamed("doc_id", "id"), "id").select("id", "quality")


@R.add("j7_unmatched", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unmatched(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@R.add("u2_new_ids", f"{M} SELECT email_id, list(turn ORDER BY turn) AS new FROM messages WHERE turn % 3 <> 0 GROUP BY email_id")
def new_ids(spark, d):
    rows = table(spark, d, "messages").groupBy("email_id").agg(F.array_sort(F.collect_list("turn")).alias("all"), F.collect_list(F.when(F.col("turn") % 3 == 0, F.col("turn"))).alias("known"))
    return rows.select("email_id", F.array_except("all", "known").alias("new")).where(F.size("new") > 0)


@R.add(
    "j5_side_loaded_users",
    "SELECT event_id, coalesce(c_name, 'unknown') AS name FROM events LEFT JOIN customer ON user_id = c_custkey AND c_acctbal > 0",
)
def users(spark, d):
    known = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"), "c_name")
    return table(spark, d, "events").join(known, "user_id", "left").select("event_id", F.coalesce("c_name", F.lit("unknown")).alias("name"))


@R.add("f13_internal_notes", f"{M} SELECT email_id, turn FROM messages WHERE NOT public AND author_id = -1 AND turn BETWEEN 0 AND 2")
def internal_notes(spark, d):
    return th.notes_of(table(spark, d, "messages"), [-1], 0, 2).select("email_id", "turn")


@R.add("j9_source_ticket", f"{views_sql('audit_log', 'tickets')} SELECT a.id, t.ticket_id FROM audit_log a LEFT JOIN tickets t ON t.id = a.email_id WHERE a.kind = 'edited'")
def source_ticket(spark, d):
    log = table(spark, d, "audit_log").where("kind = 'edited'").select("id", "email_id")
    return log.join(table(spark, d, "tickets").select(F.col("id").alias("email_id"), "ticket_id"), "email_id", "left").select("id", "ticket_id")


@R.add("t5_t6_governance_page", f"{A} SELECT id, action, ts FROM audit_log WHERE actor <> 'system' ORDER BY id DESC LIMIT 25 OFFSET 50")
def governance_page(spark, d):
    return table(spark, d, "audit_log").where("actor <> 'system'").orderBy(F.desc("id")).offset(50).limit(25).select("id", "action", "ts")


@R.add("n12_people_once", "SELECT c_custkey, [{'name': c_name, 'email': 'a@b.c'}, {'name': c_mktsegment, 'email': NULL}] AS people FROM customer")
def people_once(spark, d):
    person = lambda n, e: F.struct(n.alias("name"), e.alias("email"))
    name, none = F.col("c_name"), F.lit(None).cast("string")
    people = F.array(person(name, F.lit("a@b.c")), person(F.upper(name), F.lit("A@b.C")), person(F.col("c_mktsegment"), none), person(F.lower("c_mktsegment"), none))
    return table(spark, d, "customer").select("c_custkey", th.people_once(people).alias("people"))


@R.add("w13_learned")
def learned(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("title"), F.col("text").alias("content"))
    old = b.where("id % 2 = 0").withColumn("seen_count", F.lit(1).cast("long"))
    new = b.select((F.col("id") + 1000).alias("id"), "title", F.concat("content", F.lit(" please")).alias("content"), (F.col("id") % 3 > 0).alias("edited"), F.lit(True).alias("had_placeholder"))
    return po.learned(old, new)
