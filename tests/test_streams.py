"""Tickets with state by key, and dead letters, over several batches, restarts and repeats."""

from __future__ import annotations

from pyspark.sql import functions as F

from deskloom.streaming import desk_stream as st

SCHEMA = "ticket_id long, comment_id long, author_id long, requester_id long, public boolean, status string"


def polled(spark, folder, polls):
    """The actions of each poll, every one by a query that starts again."""
    out = []

    def sink(batch, _):
        out.append(sorted((r.ticket_id, r.new_comments, r.last_comment_id, r.action) for r in batch.collect()))

    for day, rows in polls:
        table = spark.createDataFrame(rows, SCHEMA).withColumn("created_at", F.lit(f"{day} 10:00:00").cast("timestamp"))
        table.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(table.schema).parquet(f"{folder}/in")
        st.run_once(st.ticket_actions(stream), f"{folder}/check", sink)
    return [x for x in out if x]


def test_follow_ups(spark, tmp_path):
    first = [(1, 1, 7, 7, True, "open"), (2, 1, 8, None, True, "open"), (3, 1, 9, 9, False, "open"), (3, 1, 9, 9, False, "open")]
    second = first + [(1, 2, 7, 7, True, "solved"), (2, 2, 8, None, True, "open"), (3, 2, 9, 9, False, "open"), (3, 3, 5, 9, True, "open")]
    third = second + [(1, 4, 7, 7, True, "closed"), (1, 3, 7, 7, True, "open"), (4, 9, 1, 1, True, "closed")]
    got = polled(spark, tmp_path, [("2026-01-01", first), ("2026-01-01", second), ("2026-01-02", second), ("2026-01-02", third)])
    assert got[0] == [(1, 1, 1, "classify"), (2, 1, 1, "classify"), (3, 1, 1, "classify")]
    assert got[1] == [(1, 1, 2, "reprocess"), (2, 1, 2, "append"), (3, 2, 3, "append")]
    assert got[2] == [(1, 2, 4, "surface"), (4, 1, 9, "classify")]
    assert len(got) == 3


def test_tickets_are_forgotten_long_after_their_last_comment(spark, tmp_path):
    one, other = [(1, 1, 7, 7, True, "open")], [(2, 1, 7, 7, True, "open")]
    got = polled(spark, tmp_path, [("2026-01-01", one), ("2026-02-01", [(1, 2, 7, 7, True, "open")]), ("2026-04-15", other), ("2026-04-15", [(1, 3, 7, 7, True, "open")]), ("2026-12-01", [(2, 2, 7, 7, True, "open")]), ("2026-12-01", [(1, 4, 7, 7, True, "open")])])
    assert [x[0][3] for x in got] == ["classify", "reprocess", "classify", "reprocess", "reprocess", "classify"]


def test_dead_letters_of_batches_that_come_twice(spark, tmp_path):
    lines, good, bad = (str(tmp_path / x) for x in ("lines", "good", "bad"))
    for i, texts in enumerate([['{"a": 1}', "{oops", ""], ['{"a": 2}', '{"a": "x"}', "[]"], ['{"a": 3}', "null"]]):
        spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1).write.mode("append").text(lines)
        sink = st.split_by_batch(good, bad, "a long")
        for check in ("check", f"again{i}"):  # a stream that goes on, and one that reads all from the start
            st.run_once(spark.readStream.option("maxFilesPerTrigger", 1).text(lines), str(tmp_path / check), sink)
    assert sorted(r.a for r in spark.read.parquet(good).collect()) == [1, 2, 3]
    assert sorted(r.value for r in spark.read.parquet(bad).collect()) == sorted(["{oops", "", '{"a": "x"}', "[]", "null"])
