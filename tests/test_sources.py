"""Matrices, limits of exports, and rotated logs as files."""

from __future__ import annotations

import json

import numpy as np
import pytest

from deskloom.operators import threads
from deskloom.sources import export, files, matrix


def read(spark, path, **options):
    spark.dataSource.register(matrix.Matrix)
    return spark.read.format("npy_matrix").options(**options).load(str(path))


@pytest.mark.parametrize("kind", [np.float32, np.float64, np.int16])
def test_matrix_is_read_in_ranges(spark, tmp_path, kind):
    x = (np.random.default_rng(3).normal(size=(103, 5)) * 9).astype(kind)
    x[[0, 50]] = 0
    np.save(tmp_path / "x.npy", x)
    rows = read(spark, tmp_path / "x.npy", rows=20, scaled="false")
    assert rows.rdd.getNumPartitions() == 6
    got = {r.row: r.vector for r in rows.collect()}
    assert sorted(got) == list(range(103)) and all(np.allclose(got[i], x[i]) for i in got)
    scaled = np.array([r.vector for r in read(spark, tmp_path / "x.npy", rows=50).orderBy("row").collect()])
    assert np.allclose(np.linalg.norm(scaled, axis=1), [0.0 if i in (0, 50) else 1.0 for i in range(103)], atol=1e-6)


def test_folders_empty_matrices_and_others(spark, tmp_path):
    for name, x in (("a", np.ones((3, 2))), ("b", np.zeros((0, 2))), ("c", np.full((2, 2), 3.0))):
        np.save(tmp_path / f"{name}.npy", x)
    got = sorted((r.row, r.vector) for r in read(spark, tmp_path, scaled="false").collect())
    assert got == [(0, [1, 1]), (1, [1, 1]), (2, [1, 1]), (3, [3, 3]), (4, [3, 3])]
    for i, bad in enumerate((np.asfortranarray(np.ones((4, 3))), np.ones(4))):
        np.save(tmp_path / f"bad{i}.npy", bad)
        with pytest.raises(Exception, match="not a matrix"):
            read(spark, tmp_path / f"bad{i}.npy").collect()


def test_written_matrix_comes_back_in_order(spark, tmp_path):
    rows = [(i, [float(i), float(i * i), -1.0]) for i in range(57)]
    table = spark.createDataFrame(rows, "id long, vector array<double>").repartitionByRange(3, "id").sortWithinPartitions("id")
    spark.dataSource.register(matrix.Matrix)
    table.select("vector").write.format("npy_matrix").mode("append").option("rows", 10).save(str(tmp_path / "m"))
    (tmp_path / "m" / "part-000000-left-behind.npy").write_bytes(b"of a task that failed")
    assert [(r.row, r.vector) for r in read(spark, tmp_path / "m", rows=4, scaled="false").orderBy("row").collect()] == rows


def pages(folder, n, ends=True):
    for i in range(n):
        (folder / f"{i}.json").write_text(json.dumps({"records": [{"id": i}], "users": [], "end_of_stream": ends and i == n - 1}))


@pytest.mark.parametrize("parts", [1, 2])
def test_exports_have_no_limit_of_their_own_and_show_one_that_is_set(spark, tmp_path, parts):
    pages(tmp_path, 1100)
    spark.dataSource.register(export.TicketExport)
    ask = lambda **o: {r.id: r.complete for r in spark.read.format("ticket_export").options(path=str(tmp_path), parts=parts, **o).load().collect()}
    assert ask() == {i: True for i in range(1100)}
    assert ask(pages=3) == {0: True, 1: True, 2: False}
    assert ask(pages=2, start=1098) == {1098: True, 1099: True}


def test_a_stream_goes_on_beyond_the_pages_of_a_batch(spark, tmp_path):
    pages(tmp_path, 7)
    spark.dataSource.register(export.TicketExport)
    out = str(tmp_path / "out")
    stream = spark.readStream.format("ticket_export").options(path=str(tmp_path), pages=2).load()
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(7))


def test_rotated_files(spark, tmp_path):
    line = lambda i, stage: json.dumps({"email_id": i, "stage": stage})
    for name, lines in (("trace.jsonl", [line(1, "new"), "{broken"]), ("trace.jsonl.1", [line(1, "old"), line(2, "x")]), ("trace.jsonl.12", [line(1, "oldest")]), ("trace.jsonl.bak", [line(1, "no")]), ("other.jsonl", [line(1, "no")])):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    got = [(r.generation, r.stage) for r in files.rotated_log(spark, str(tmp_path), "trace.jsonl", email_id=1).collect()]
    assert sorted(got, reverse=True) == [(12, "oldest"), (1, "old"), (0, "new")]


def test_dealt_pairs(spark):
    rows = [(1, "a", "x"), (2, "a", "y"), (3, "b", "z"), (4, None, "x"), (5, "b", "p"), (6, "b", "q"), (7, "b", "r"), (8, None, "s")]
    table = spark.createDataFrame(rows, "id long, month string, text string")
    from pyspark.sql import functions as F

    got = sorted(map(tuple, threads.dealt_pairs(table, F.col("text"), "month", "id", least=2, most=4, size=2).collect()))
    # a template (ids 1 and 4), and of three shares that its budget of 3 leaves: b has 4 singles of 6, the others one each
    assert [(r[0], r[2]) for r in got] == [(1, 2), (2, 1), (3, 1), (6, 1), (8, 1)]
    assert sorted(r[3] for r in got) == [0, 0, 1, 1, 2]
    assert threads.dealt_pairs(table.limit(0), F.col("text"), "month", "id", 2, 4, 2).count() == 0
