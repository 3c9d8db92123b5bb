"""Cases worked out by hand."""

from __future__ import annotations

import datetime as dt
import difflib
import http.server
import json
import math
import random
import re
import threading
import urllib.error

import numpy as np
import pytest
from pyspark.sql import functions as F

from deskloom.functions import chunks, routing, text
from deskloom.operators import analytics, evaluation, mining, policies, queue, retrieval, threads
from deskloom.sources import export, files
from deskloom.streaming import desk_stream


def ranks(spark, *lists):
    return [spark.createDataFrame([(1, d, i + 1) for i, d in enumerate(ids)], "query_id long, doc_id string, rank int") for ids in lists]


def test_fusion_of_two_rankings(spark):
    got = [(r.doc_id, r.score) for r in retrieval.fuse(ranks(spark, "ABC", "ABD"), 10).orderBy("rank").collect()]
    assert got == [("A", round(2 / 61, 9)), ("B", round(2 / 62, 9)), ("C", round(1 / 63, 9)), ("D", round(1 / 63, 9))]


def test_fusion_of_one_document_each(spark):
    got = {r.doc_id: r.score for r in retrieval.fuse(ranks(spark, "B", "A"), 10).collect()}
    assert got == {"A": round(1 / 61, 9), "B": round(1 / 61, 9)}


def test_ranking_metrics(spark):
    ranked = spark.createDataFrame([(q, d, d) for q in (1, 2, 3, 4) for d in (1, 2, 3)], "query_id long, doc_id long, rank int")
    gold = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 9)], "query_id long, doc_id long")
    items = spark.range(1, 5).withColumnRenamed("id", "query_id")
    r = evaluation.ranking_metrics(ranked, gold, items).first()
    assert (r.recall_1, r.recall_3, r.ndcg_1) == (0.25, 0.75, 0.25)
    assert r.ndcg_3 == pytest.approx((1 + 1 / math.log2(3) + 0.5) / 4, abs=1e-6)
    none = evaluation.ranking_metrics(ranked, gold, items.where("query_id > 9")).first()
    assert none.hit_1 == none.mrr == none.ndcg_5 == 0.0


def test_bm25_without_a_match_gives_the_first_documents(spark):
    docs = spark.createDataFrame([(3, "apple pie"), (1, "pear tart"), (2, "the plum")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "the quince")], "query_id long, text string")
    assert [(r.doc_id, r.score) for r in retrieval.bm25(asked, docs, 2).orderBy("rank").collect()] == [(1, 0.0), (2, 0.0)]


def test_dense_leaves_out_the_query_itself(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8])], "doc_id long, vector array<double>")
    q = v.where("doc_id = 1").withColumnRenamed("doc_id", "query_id")
    assert [r.doc_id for r in retrieval.dense(q, v, 5).orderBy("rank").collect()] == [3, 2]


def test_brier_and_reliability(spark):
    rows = spark.createDataFrame([(0.15, 1), (0.15, 1), (0.85, 0), (0.85, 0)], "p double, truth int")
    assert evaluation.brier(spark.createDataFrame([(1.0, 1), (0.0, 0)], "p double, truth int")).first().brier == 0
    assert {r.bin: r.acc for r in evaluation.reliability(rows).collect()} == {1: 1.0, 8: 0.0}
    assert evaluation.brier(rows.limit(0)).first().brier == 0.0
    out = spark.createDataFrame([(1.5, 1), (0.5, 1)], "p double, truth int")
    assert evaluation.calibration_error(out).first().ece == 0.25


def test_bands(spark):
    rows = spark.createDataFrame([(0.30,)] * 3 + [(0.95,)] * 22 + [(None,)], "confidence double")
    assert [r.n for r in analytics.confidence_bands(rows).orderBy("band").collect()] == [3, 0, 0, 0, 0, 22]


def test_summary_counts_sent_as_pending(spark):
    rows = spark.createDataFrame([("faq", "SENT", 0.7)] * 5 + [("faq", "approved", 1.0)] * 20, "lane string, status string, confidence double")
    r = analytics.summary(rows).first()
    assert (r.pending, r.approved, r.avg_faq_confidence) == (5, 20, 0.94)
    assert analytics.summary(rows, pending_is_open=True).first().pending == 0


def test_facets_ignore_their_own_dimension(spark):
    rows = [("z", s, "x") for s in ("new", "new", "new", "open", "open", "closed")] + [("toy", None, "x")] * 22
    df = spark.createDataFrame(rows, "source string, ticket_status string, lane string")
    got = {(r.facet, r.value): r.n for r in queue.facets(df, queue.queue_conditions(lane="x"), "z").collect()}
    assert got == {("ticket_status", "new"): 3, ("ticket_status", "open"): 2, ("ticket_status", "solved"): 1, ("source", "z"): 6, ("source", "toy"): 22, ("sources", "z"): 0, ("sources", "toy"): 0}


def test_bare_end_date_takes_the_whole_day(spark):
    rows = spark.createDataFrame([(dt.datetime(2026, 1, 20, 23, 50),), (dt.datetime(2026, 1, 21),)], "received_at timestamp_ntz")
    assert rows.where(queue.in_range("received_at", "2026-01-20", "2026-01-20")).count() == 1
    with pytest.raises(ValueError):
        queue.in_range("received_at", "2026-01-21", "2026-01-20")
    with pytest.raises(ValueError):
        queue.parse_bound("soon")


def test_search_wildcards_and_hash(spark):
    rows = spark.createDataFrame([("a1b", 12), ("ab", None)], "subject string, ticket_id long")
    assert rows.where(queue.matches("#a_b", "subject", "ticket_id")).count() == 1
    assert rows.where(queue.matches("#", "subject")).count() == 2
    assert queue.matches("", "subject") is None


@pytest.mark.parametrize(
    ("placeholders", "notes", "citations", "confidence", "answer", "lane", "why"),
    [
        (0, False, 1, 0.9, 0.95, "faq", "complete grounded draft"),
        (2, False, 1, 0.9, 0.95, "human_review", "draft has 2 chair placeholder(s)"),
        (0, True, 1, 0.9, 0.95, "human_review", "draft has notes for the chair"),
        (0, False, 0, 0.9, 0.95, "human_review", "draft cites no policy (ungrounded)"),
        (0, False, 1, 0.4, 0.95, "human_review", "intent confidence 0.40 < 0.65"),
        (0, False, 1, 0.9, None, "human_review", "drafter provided no answer confidence"),
        (0, False, 1, 0.9, 0.5, "human_review", "answer confidence 0.50 < 0.85"),
    ],
)
def test_lane(spark, placeholders, notes, citations, confidence, answer, lane, why):
    row = spark.createDataFrame([(placeholders, notes, citations, confidence, answer)], "p int, n boolean, c int, k double, a double")
    got, reason = routing.lane_reason(F.col("p"), F.col("n"), F.col("c"), F.col("k"), F.col("a"))
    assert row.select(got, reason).first()[:] == (lane, why)


def test_near_miss(spark):
    rows = spark.createDataFrame([(0.6, None), (0.85, None), (0.3, None), (0.95, 0.6)], "raw double, cal double")
    assert [r[0] for r in rows.select(routing.near_miss(routing.used_confidence(F.col("cal"), F.col("raw")))).collect()] == [True, False, False, True]


def test_transcript_budget(spark):
    rows = spark.createDataFrame([(1, i, True, "user", "x" * 100) for i in range(3)], "email_id long, turn long, public boolean, role string, body string")
    r = threads.transcripts(rows, 130).first()
    assert (r.included, r.omitted) == (1, 2) and r.text.startswith("[… 2 earlier message(s) omitted …]\n\nRequester: xxx")
    cut = threads.transcripts(rows, 20).first()
    assert cut.included == 1 and cut.text.endswith("Requester: " + "x" * 9)


def test_first_inquiry_with_an_unknown_requester(spark):
    rows = spark.createDataFrame([(1, 0, True, None, "a"), (1, 1, True, 5, "b")], "email_id long, turn long, public boolean, author_id long, body string")
    who = spark.createDataFrame([(1, None)], "email_id long, requester_id long")
    assert threads.first_inquiry(rows, who).first().body == "a"
    assert threads.first_inquiry(rows, who, null_matches=False).count() == 0


def test_runs(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(["a", "a", None, None, None, "b"])], "k long, o long, v string")
    assert [r.run_length for r in threads.runs(rows, "k", "o", "v").orderBy("o").collect()] == [2, 2, 3, 3, 3, 1]


@pytest.mark.parametrize(("size", "n"), [(1, 3), (3, 3), (4, 3), (10, 3), (10, 7), (100, 7), (23, 22)])
def test_spaced_sample(spark, size, n):
    rows = spark.range(size).withColumn("s", F.lit(1))
    want = [int(i * size / n) for i in range(n)] if size > n else list(range(size))
    assert [r.id for r in threads.spaced_sample(rows, "s", "id", n).orderBy("id").collect()] == want


def test_open_drafts_keep_null_states(spark):
    rows = spark.createDataFrame([("DRAFT_GENERATED", None), ("DRAFT_GENERATED", "solved"), ("SENT", None)], "status string, ticket_status string")
    assert queue.open_drafts(rows).count() == 1


def test_reassigned_null_missing_and_text_are_one_bucket(spark):
    rows = spark.createDataFrame([('{"k": 3}',), ('{"k": null}',), ("{}",), ('{"k": "unassigned"}',), (None,)], "metadata string")
    assert {r.owner: r.n for r in queue.reassigned_from(rows).collect()} == {"3": 1, "unassigned": 4}


def test_flags_keep_the_oldest_payload(spark):
    log = spark.createDataFrame([(1, 9, 1, "near_miss", "old"), (2, 9, 2, "near_miss", "new")], "id long, email_id long, ts long, kind string, metadata string")
    tickets = spark.createDataFrame([(9, "s")], "id long, subject string")
    assert analytics.flagged(log, tickets).first()[:] == (9, 2, "old", None, "s")
    assert analytics.flagged(log, tickets, newest=True).first().near_miss == "new"


def test_insert_once_refuses_a_batch_that_repeats_a_key(spark):
    stored = spark.createDataFrame([(1,)], "k long")
    assert sorted(str(r.k) for r in policies.inserted_once(stored, spark.createDataFrame([(1,), (2,), (None,), (None,)], "k long"), "k").collect()) == ["2", "None", "None"]
    assert policies.inserted_once(stored, spark.createDataFrame([(2,), (2,)], "k long"), "k").count() == 0


def test_governance(spark):
    events = spark.createDataFrame([("p", i, a) for i, a in enumerate(["edit", "edit", "revert", "delete", "reactivate", "edit"])], "root_key string, seq long, action string")
    assert {r.policy_key: r.status for r in policies.after_governance(events).collect()} == {"p": "inactive", "p__v2": "inactive", "p__v3": "inactive", "p__v4": "active"}


def test_exclusion_beats_force(spark):
    rows = spark.createDataFrame([("a", None), ("b", "a"), ("c", "")], "policy_key string, root_key string")
    got = policies.without_lineages(rows, rows.where("policy_key = 'a'"), rows.where("policy_key = 'b'")).collect()
    assert [(r.policy_key, r.forced) for r in got] == [("c", False)]


def test_submission_numbers(spark):
    rows = [
        ("Paper 12345", "see #54321 and submission ID: 1234"),
        ("AAAI 2026", "paper due 2026 but Submission 2026 counts"),
        (None, "paper AAAI-2027 and a/#1234, papers no. 777777"),
        ("#1234", "#1234 paper 1234"),
    ]
    df = spark.createDataFrame(rows, "s string, b string")
    got = [r[0] for r in df.select(text.submission_numbers("s", "b")).collect()]
    assert got == [["12345", "1234", "54321"], ["2026"], [], ["1234"]]


def numbers_by_hand(*texts):
    """Submission numbers by Python's patterns, hit by hit."""
    cued = re.compile(r"(?<![A-Za-z0-9])(?:paper|submission)s?(?:\s*(?:id|no\.?|number))?(?P<word>(?:\s*[A-Za-z][A-Za-z.\-]{0,11})?)\s*[#:\-]?\s*(?P<n>\d{4,5})(?!\d)", re.I)
    hashed = re.compile(r"(?<![\w/])#(?P<n>\d{4,5})(?!\d)")
    out = []
    for t in texts:
        for pattern in (cued, hashed):
            for m in pattern.finditer(t or ""):
                year = pattern is cued and m["word"].strip() and len(m["n"]) == 4 and 2020 <= int(m["n"]) <= 2035
                if not year and not re.search(r"(?:AAAI|IAAI|EAAI)[-\s]*$", t[: m.start("n")], re.I):
                    out.append(m["n"])
    return list(dict.fromkeys(out))


def test_submission_numbers_of_any_text(spark):
    r = random.Random(6)
    parts = ["paper", "Papers", "SUBMISSION", "id", "no.", "number", " ", "  ", "\n", "\u00a0", "\x1c", "#", ":", "-", "/", "1234", "12345", "2026", "123456", "AAAI", "eaai-", "due", "é", "_", "x.y", "ſubmiſſion", "\u0661\u0662\u0663\u0664"]
    rows = [tuple("".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(2)) for _ in range(3000)]
    rows += [(None, None), ("", None), ("paper 1234 " * 5000, "#12345 " * 5000)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, s string, b string")
    got = {x.i: x.n for x in df.select("i", text.submission_numbers("s", "b").alias("n")).collect()}
    assert got == {i: numbers_by_hand(*x) for i, x in enumerate(rows)}


def test_forum_ids_keep_their_case(spark):
    t = "openreview.net/forum?id=Ab3xY9kLm2 OpenReview.net/PDF?id=ab3xy9klm2 openreview.net/group?id=Ab3xY9kLm2 openreview.net/forum?id=Ab3xY9kLm2xx"
    assert spark.createDataFrame([(t,)], "t string").select(text.forum_ids(F.col("t"))).first()[0] == ["Ab3xY9kLm2", "ab3xy9klm2"]


def test_sections(spark):
    rows = spark.createDataFrame([("=== REPLY ===\nHi\n=== CITATIONS ===\npolicy_1, policy_1\n=== NOTES FOR CHAIR ===\nnone\n=== CONFIDENCE === 1.7",), ("just policy_3",)], "t string")
    got = [r.s.asDict() for r in rows.select(text.sections(F.col("t")).alias("s")).collect()]
    assert got[0] == {"reply": "Hi", "citations": ["policy_1"], "notes": None, "confidence": 1.0}
    assert got[1] == {"reply": "just policy_3", "citations": ["policy_3"], "notes": None, "confidence": None}


def test_matching_blocks_are_those_of_the_standard_library():
    r = random.Random(7)
    for n in range(400):
        letters = "ab" if n % 3 == 0 else "abcdefgh " if n % 3 == 1 else [f"w{i}" for i in range(60)]
        a, b = ([r.choice(letters) for _ in range(r.choice([0, 1, 5, 40, 199, 200, 260]))] for _ in range(2))
        if n % 2:
            b = [x for x in a if r.random() < 0.9] + b[:5]
        assert text.matching_ratio(a, b) == difflib.SequenceMatcher(None, a, b).ratio()
        assert text.alike("".join(a), "".join(b), 0.82) == (difflib.SequenceMatcher(None, "".join(a), "".join(b)).ratio() >= 0.82)


def test_similarity(spark):
    rows = spark.createDataFrame([("Abc", "aBd"), (None, ""), ("x", None)], "a string, b string")
    assert [r[0] for r in rows.select(text.similarity("a", "b")).collect()] == [pytest.approx(2 / 3), 1.0, 0.0]


def test_edit_ratio_and_diff(spark):
    rows = spark.createDataFrame([("a b c", "a c d"), (None, "")], "a string, b string")
    assert [r[0] for r in rows.select(text.edit_ratio("a", "b")).collect()] == [pytest.approx(1 / 3), 0.0]
    assert json.loads(rows.select(text.word_diff("a", "b")).first()[0]) == [["equal", "a"], ["removed", "b"], ["equal", "c"], ["added", "d"]]


def test_chunks():
    assert chunks.pack("w " * 220) == ["w " * 220]
    long = "\n\n".join(["w " * 99 + "w"] * 3)
    assert [len(c.split()) for c in chunks.pack(long)] == [100, 100, 100]
    assert list(chunks.sections("T", "too short\n## A\ntext")) == [("T — A", "text")]


def test_noise_reason(spark):
    rows = spark.createDataFrame([("api", "x" * 50), ("web", "short"), ("web", "Automatic reply: " + "x" * 40), ("web", "x" * 50)], "c string, t string")
    assert [r[0] for r in rows.select(mining.noise_reason(F.col("c"), F.col("t"))).collect()] == ["api", "short", "notice", None]


def test_isotonic_with_one_class(spark):
    rows = spark.createDataFrame([(0.2, 1), (0.9, 1)], "p double, truth int")
    assert {r.calibrated for r in mining.isotonic(rows).collect()} == {1.0}


def test_platt_is_the_penalised_logistic_curve(spark):
    rows = [(round(0.05 * i, 2), int(i % 3 == 0 or i > 12)) for i in range(20)] + [(None, 1)]
    got = {r.p: r.calibrated for r in mining.platt(spark.createDataFrame(rows, "p double, truth int")).collect()}
    x, y = np.array([p for p, _ in rows[:-1]]), np.array([t for _, t in rows[:-1]])
    a = b = 0.0
    for _ in range(200):  # Newton's method on the loss plus half the squared slope
        q = 1 / (1 + np.exp(-(a * x + b)))
        w = q * (1 - q)
        step = np.linalg.solve([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum()]], [((q - y) * x).sum() + a, (q - y).sum()])
        a, b = a - step[0], b - step[1]
    assert got[None] is None
    assert all(abs(got[p] - 1 / (1 + math.exp(-(a * p + b)))) < 1e-4 for p in x)
    assert {r.calibrated for r in mining.platt(spark.createDataFrame([(0.2, 0), (0.9, 0)], "p double, truth int")).collect()} == {0.0}
    assert mining.platt(spark.createDataFrame([], "p double, truth int")).collect() == []


def test_silhouette_chooses_the_true_number(spark):
    rows = [(10 * a + i, [10.0 * (a == 0) + 0.01 * i, 10.0 * (a == 1), 10.0 * (a == 2) - 0.01 * i]) for a in range(3) for i in range(6)]
    got, found = mining.kmeans_by_silhouette(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), (2, 3, 5))
    assert max(found, key=found.get) == 3
    assert len({(r.vec_id // 10, r.cluster) for r in got.collect()}) == 3


@pytest.mark.parametrize("ranges", [2, 7])
def test_numbered_by_ranges(spark, ranges):
    values = [5, None, 3, 3, 3, 9, 1, None, 7, 3]
    rows = threads.numbered(spark.createDataFrame([(v,) for v in values], "k long"), "k", "at", ranges).collect()
    assert [r.k for r in sorted(rows, key=lambda r: r.at)] == [None, None, 1, 3, 3, 3, 3, 5, 7, 9]
    assert sorted(r.at for r in rows) == list(range(10))
    assert threads.numbered(spark.createDataFrame([], "k long"), "k", "at").collect() == []


def test_model_record(spark):
    said = ['{"steps_taken": [[1], null, "a"], "resolution": " done\\n", "policy_or_reference_used": ["None"], "outcome_type": null}', '"text"', None]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string").select("i", text.model_record(F.try_parse_json("s")).alias("r"))
    got = {r.i: r.r for r in rows.collect()}
    assert got[0].asDict() == {"what_was_asked": "", "steps_taken": ["a"], "resolution": "done", "policy_or_reference_used": None, "outcome_type": "no_clear_resolution"}
    assert got[1] is None and got[2] is None


def test_word_cosine_sees_every_document(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["alpha beta", "alpha", None, "beta gamma delta", ""])], "doc_id long, text string")
    asked = spark.createDataFrame([(38, "Alpha alpha beta")], "query_id long, text string")
    got = [(r.doc_id, r.score, r.rank) for r in retrieval.word_cosine(asked, docs, 5).orderBy("rank").collect()]
    assert got == [(0, 1.0, 1), (1, round(1 / math.sqrt(2), 6), 2), (3, round(1 / math.sqrt(6), 6), 3)]


def write_pages(folder, pages):
    for i, p in enumerate(pages):
        (folder / f"{i}.json").write_text(json.dumps(p))


def test_export_batch_and_stream(spark, tmp_path):
    record = lambda i, s="open": {"id": i, "status": s, "subject": f"s{i}", "requester_id": i % 2, "updated_at": "t"}
    pages = [{"records": [record(1), record(2, "deleted")], "users": [{"id": 1, "name": "one"}]}, {"records": [record(3)], "users": [], "end_of_stream": True}]
    write_pages(tmp_path, pages)
    spark.dataSource.register(export.TicketExport)
    batch = spark.read.format("ticket_export").option("path", str(tmp_path)).option("parts", 2).load()
    assert sorted((r.id, r.requester_name, r.complete) for r in batch.collect()) == [(1, "one", True), (3, None, True)]
    stream = spark.readStream.format("ticket_export").option("path", str(tmp_path)).load()
    query = stream.writeStream.format("memory").queryName("exported").option("checkpointLocation", str(tmp_path / "check")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.id for r in spark.table("exported").collect()) == [1, 3]


def test_truncated_export_shows(spark, tmp_path):
    write_pages(tmp_path, [{"records": [{"id": 1}], "users": []}])
    spark.dataSource.register(export.TicketExport)
    assert [r.complete for r in spark.read.format("ticket_export").option("path", str(tmp_path)).load().collect()] == [False]


def test_markdown(spark, tmp_path):
    (tmp_path / "a.md").write_text('---\ntitle: "Late work"\ntags: [a, "b"]\n---\nBody\ntext')
    (tmp_path / "b.md").write_text("No front matter")
    got = {r.path[-4:]: (r.title, r.tags, r.body) for r in files.markdown(spark, str(tmp_path)).collect()}
    assert got == {"a.md": ("Late work", ["a", "b"], "Body\ntext"), "b.md": (None, [], "No front matter")}


def test_ticket_actions(spark, tmp_path):
    schema = "ticket_id long, comment_id long, author_id long, requester_id long, public boolean, status string"
    batches = [[(1, 1, 7, 7, True, "open"), (2, 5, 8, 8, True, "open")], [(1, 1, 7, 7, True, "open"), (1, 2, 7, 7, True, "open"), (2, 6, 8, 8, True, "closed")], [(1, 3, 9, 7, True, "open")]]
    source = tmp_path / "in"
    got = []

    def sink(batch, _):
        got.append(sorted((r.ticket_id, r.new_comments, r.action) for r in batch.collect()))

    for rows in batches:
        spark.createDataFrame(rows, schema).withColumn("created_at", F.lit("2026-01-01 10:00:00").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(f"{schema}, created_at timestamp").parquet(str(source))
        desk_stream.run_once(desk_stream.ticket_actions(stream), str(tmp_path / "check"), sink=sink)
    seen = [x for x in got if x]
    assert seen == [[(1, 1, "classify"), (2, 1, "classify")], [(1, 1, "reprocess"), (2, 1, "surface")], [(1, 1, "append")]]


def test_learned_suggestions(spark):
    old = spark.createDataFrame([(1, "Late work", "Hand in by Friday noon", 1), (2, "Fees", "Fees are due in May", 4)], "id long, title string, content string, seen_count long")
    new = [(11, "Late work", "Hand in by Friday noon!", True, True), (12, "late WORK", "hand in by friday noon", True, True), (13, "Visa", "Letters take a week", True, True), (14, "Fees", "Fees are due in May", False, True), (15, "Fees", "Fees are due in May", True, False)]
    df = spark.createDataFrame(new, "id long, title string, content string, edited boolean, had_placeholder boolean")
    assert {r.id: r.seen_count for r in policies.learned(old, df).collect()} == {1: 3, 2: 4, 13: 1}


def test_learned_with_many_suggestions(spark):
    old = spark.range(1500).selectExpr("id", "concat('t', id) AS title", "sha2(cast(id AS string), 256) AS content", "1L AS seen_count")
    new = old.where("id IN (3, 1400)").selectExpr("id + 5000 AS id", "title", "concat(content, ' !') AS content", "true AS edited", "true AS had_placeholder")
    got = {r.id: r.seen_count for r in policies.learned(old, new.unionByName(new)).collect()}
    assert len(got) == 1500 and got[3] == got[1400] == 3 and sum(got.values()) == 1504


def test_export_follows_named_cursors(spark, tmp_path):
    (tmp_path / "first.json").write_text(json.dumps({"records": [{"id": 1}], "after_cursor": "x=="}))
    (tmp_path / "x==.json").write_text(json.dumps({"records": [{"id": 2}], "after_cursor": "y", "end_of_stream": True}))
    spark.dataSource.register(export.TicketExport)
    read = lambda: spark.readStream.format("ticket_export").option("path", str(tmp_path)).option("start", "first").load()
    batch = spark.read.format("ticket_export").option("path", str(tmp_path)).option("start", "first").load()
    assert sorted((r.id, r.complete) for r in batch.collect()) == [(1, True), (2, True)]
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def catch_up():
        query = read().writeStream.format("parquet").option("path", out).option("checkpointLocation", check).start()
        query.processAllAvailable()
        query.stop()
        return sorted(r.id for r in spark.read.parquet(out).collect())

    assert catch_up() == [1, 2]
    (tmp_path / "y.json").write_text(json.dumps({"records": [{"id": 3}], "end_of_stream": True}))
    assert catch_up() == [1, 2, 3]


@pytest.mark.parametrize("codes, ok", [([429, 503, 200], True), ([404], False), ([500, 500, 500], False)])
def test_fetch_tries_again(codes, ok):
    asked = []

    class Server(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            code = codes[len(asked)]
            asked.append(self.path)
            self.send_response(code)
            self.end_headers()
            if code == 200:
                self.wfile.write(b'{"records": []}')

        def log_message(self, *args):
            pass

    with http.server.HTTPServer(("127.0.0.1", 0), Server) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        url = f"http://127.0.0.1:{server.server_port}/?cursor=0"
        if ok:
            assert export.fetch(url, 3, 0.01) == {"records": []}
        else:
            with pytest.raises(urllib.error.HTTPError):
                export.fetch(url, 3, 0.01)
        server.shutdown()
    assert len(asked) == len(codes)


def test_passages_in_texts(spark):
    texts = ["alpha beta gamma delta epsilon zeta", "xalpha beta gamma delta epsilonx tail", "beta gamma", " lead in  two spaces here", "", None, "a b c d", "one beta gamma delta two"]
    asked = ["alpha beta gamma delta epsilon", "pha beta gamma delta eps", "beta gamma", "", None, " lead in  two spaces", "lead in two spaces here", "b c d", "eta gamma del"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("passage", F.lit("clash"))
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, passage string").withColumn("text", F.lit("clash"))
    got = sorted((r.query_id, r.doc_id) for r in retrieval.containing(docs, queries).collect())
    assert got == [(q, d) for q, p in enumerate(asked) for d, t in enumerate(texts) if p is not None and t is not None and p in t]
    assert retrieval.containing(docs.limit(0), queries).count() == retrieval.containing(docs, queries.limit(0)).count() == 0


def test_tfidf_terms_meet_their_documents_once(spark):


    data = [(1, "x", "a b b"), (1, "y", "a c"), (2, "x", "b c d"), (3, "y", "d e"), (4, None, "b e")]
    docs = spark.createDataFrame(data, "doc long, c string, text string")
    found = mining.tfidf_terms(docs, "c", "doc", F.split("text", " "), n=9, least_df=1, most_share=1.0)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
    df = {t: sum(t in text.split() for _, _, text in data) for t in "abcde"}
    weight = {(d, c, t): text.split().count(t) * (math.log(6 / (1 + df[t])) + 1) for d, c, text in data for t in set(text.split())}
    norm = {d: math.sqrt(sum(w * w for (e, _, _), w in weight.items() if e == d)) for d, _, _ in data}
    want = {}
    for (d, c, t), w in weight.items():
        if c:
            want[c, t] = want.get((c, t), 0) + w / norm[d] / 2
    assert {(r.c, r.term): r.weight for r in found.collect()} == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}


def test_word_diffs_take_small_arrow_batches(spark, small):
    from pyspark.util import PythonEvalType

    from deskloom.plans.catalog import CORE

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        CORE.queries["c35_word_diff"](spark, small)
        assert int(spark.conf.get(name)) <= 500
    finally:
        spark.conf.set(name, before)
    assert text.word_diff.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF


def test_trials_add_discounts_in_the_order_of_the_table(spark, tmp_path):
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    from deskloom.plans.catalog import CORE

    # one sum of all eight lies just below the middle of two roundings, the sum of two files' sums on it
    cents = [3, 3, 6, 5, 0, 2, 0, 2]
    (tmp_path / "lineitem.parquet").mkdir()
    for i in (0, 1):
        rows = {"l_suppkey": pa.array([1] * 4, "int64"), "l_linenumber": pa.array([1] * 4, "int32"), "l_discount": [c / 100 for c in cents[4 * i : 4 * i + 4]]}
        pq.write_table(pa.table(rows), tmp_path / "lineitem.parquet" / f"part-{i}.parquet")
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(CORE.oracle["r12_chosen_trials"]).fetchall()
    assert want == [(1, 1, 0.0262, 8)]
    assert [tuple(r) for r in CORE.queries["r12_chosen_trials"](spark, str(tmp_path)).collect()] == want


def test_trials_are_rounded_as_by_sql(spark, tmp_path):
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    from deskloom.plans.catalog import CORE

    # scaled by 10,000 some lie below the middle of two roundings and some on it, whatever their shortest decimals say
    means = [0.00145, 0.00465, 0.0018499999999999999, 0.0033499999999999997, 0.02625, 0.026249999999999996, 0.05, -0.00145, 0.49999999999999994e-4, 1e15 / 3]
    rows = {"l_suppkey": pa.array(range(len(means)), "int64"), "l_linenumber": pa.array([1] * len(means), "int32"), "l_discount": means}
    pq.write_table(pa.table(rows), tmp_path / "lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    want = sorted(con.execute(CORE.oracle["r12_chosen_trials"]).fetchall())
    assert sorted(tuple(r) for r in CORE.queries["r12_chosen_trials"](spark, str(tmp_path)).collect()) == want


@pytest.mark.parametrize("most", [0, 100])
def test_rounded_means_do_not_hang_on_partitions(spark, most):
    from decimal import ROUND_HALF_UP, Decimal

    rng = random.Random(3)
    groups = {(k or None, j): [rng.choice([None, *(c / 100 for c in range(-3, 11))]) for _ in range(8 * (1 + k % 4))] for k in range(12) for j in (1, 2)}
    groups |= {(20, 1): [None, None], (20, 2): [float("nan"), 1.0], (20, 3): [1e300, 1e300, -1e300], (20, 4): [-0.00005]}
    data = [(*g, i, x) for g, values in groups.items() for i, x in enumerate(values)]

    def mean(values):
        known, total = [x for x in values if x is not None], 0.0
        for x in known:
            total += x
        value = total / len(known) if known else None
        return value if value is None or math.isnan(value) else float(Decimal(repr(value)).quantize(Decimal("0.0001"), ROUND_HALF_UP)) if abs(value) < 1e9 else value

    want = {g: (repr(mean(values)), len(values)) for g, values in groups.items()}
    rng.shuffle(data)
    for parts in (1, 7):
        rows = spark.createDataFrame(data, "k long, j int, at long, x double").repartition(parts)
        found = mining.rounded_means(rows, ["k", "j"], "x", ["at"], 4, "mean", "n", most)
        assert {(r.k, r.j): (repr(r["mean"]), r.n) for r in found.collect()} == want
