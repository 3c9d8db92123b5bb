"""Ranked lexical search, vector codes and exact duplicates against brute-force versions."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from deskloom.llm import codes, exact_dedup, lexical, queries
from deskloom.sources.tables import BASE

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_vector_codes", "op13_exact_dedup"])
def test_query_gives_duckdbs_rows(spark, small, name):
    con = duckdb.connect()
    for table in BASE:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    want = con.sql(queries.ORACLE[name])
    got = queries.QUERIES[name](spark, small).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


# ranked lexical search


def own_terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def own_ranking(items, docs, k):
    found = [(d, Counter(own_terms(t)), len(own_terms(t))) for d, t in docs if own_terms(t)]
    n_docs, total, df = len(found), sum(n for _, _, n in found), Counter(t for _, c, _ in found for t in c)
    asked = defaultdict(Counter)
    for item, text in items:
        if item is not None:
            asked[item].update(own_terms(text))
    out = []
    for item, times in asked.items():
        rows = []
        for d, c, n in found:
            m = 100 - 75 + 75 * n * n_docs // total
            score = sum(x * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, x in times.items() if t in c)
            if score > 0 and d is not None:
                rows.append((-score, d))
        out += [(item, i + 1, d, -s) for i, (s, d) in enumerate(sorted(rows)[:k])]
    return sorted(out)


ITEMS = [(1, "Red apple, RED apple"), (2, None), (3, "..."), (4, "straße 42 naïve É"), (None, "red"), (5, "nowhere"), (4, "red"), (6, "x" * 5000)]
DOCS = [(i, f"red apple number {i % 7}") for i in range(40)] + [(50, None), (51, ""), (52, "STRASSE straße 42"), (None, "red red red"), (53, "é É naïve 42"), (53, "é É naïve 42"), (54, "word " * 30_000 + "red"), (55, "x" * 5000), (56, "!! ??")]


@pytest.mark.parametrize("block", [lexical.BLOCK, 3])
def test_ranking_is_that_of_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(lexical, "MATCHES", 7)
    items = spark.createDataFrame([(i, t, 0.5) for i, t in ITEMS], "item_id long, text string, score double")
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in DOCS], "doc_id long, text string, n int, terms string").repartition(3)
    got = lexical.lexical_search(items, docs, k=4, block=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == own_ranking(ITEMS, DOCS, 4)


def test_ranking_of_empty_tables_and_of_text_ids(spark):
    docs = spark.createDataFrame([("b", "red"), ("a", "red"), ("c", "blue green")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "red blue")], "item_id string, text string")
    assert [tuple(r)[:3] for r in lexical.lexical_search(items, docs).orderBy("rank").collect()] == [(x[0], x[1], x[2]) for x in own_ranking([("q", "red blue")], [("b", "red"), ("a", "red"), ("c", "blue green")], 10)]
    assert lexical.lexical_search(items.limit(0), docs).count() == 0
    assert lexical.lexical_search(items, docs.limit(0)).count() == 0


@given(st.lists(st.tuples(st.integers(0, 70_000), st.integers(0, 3_000_000), st.integers(0, 10**15)), max_size=60))
@settings(max_examples=60, deadline=None)
def test_sorted_sums(rows):
    item, doc, impact = (np.array([r[i] for r in rows], np.int64) for i in range(3))
    want = Counter()
    for i, d, x in rows:
        want[i, d] += x
    assert list(zip(*(x.tolist() for x in lexical.summed(item, doc, impact)))) == [(*k, want[k]) for k in sorted(want)]


@given(st.binary(max_size=60), st.text(max_size=40))
@settings(max_examples=100, deadline=None)
def test_terms_follow_the_pattern(_, text):
    assert [t.decode() for t in lexical.terms(text.encode())] == own_terms(text)


# vector codes


def own_codes(rows, parts=16, entries=64, rounds=2):
    """rows: (vec_id, whole vector)."""
    width = len(rows[0][1]) // parts
    book = [[list(v[p * width : p * width + width]) for _, v in sorted(rows)[:entries]] for p in range(parts)]

    def best(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book[p]))

    def assign():
        return [[best(p, v[p * width : p * width + width]) for p in range(parts)] for _, v in rows]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(book[p])):
                own = [v[p * width : p * width + width] for (_, v), a in zip(rows, found) if a[p][1] == e]
                if own:
                    book[p][e] = [sum(x) // len(own) for x in zip(*own)]
    sha = hashlib.sha256(",".join(str(x) for part in book for e in part for x in e).encode()).hexdigest()
    return {i: ("".join(f"{e:02x}" for _, e in a), sum(d for d, _ in a)) for (i, _), a in zip(rows, assign())}, sha


@pytest.mark.parametrize("scale", [1.0, 1e-3, 1e9, 1e30])
def test_codes_are_those_of_brute_force(spark, scale):
    rng = np.random.default_rng(5)
    data = [(i, [float(x) for x in (rng.integers(-3, 4, 32) * scale)], [1, 2, None][i % 3]) for i in range(150)]
    bad = [(900, None, 1), (901, [float("nan")] * 32, 1), (902, [None] + [1.0] * 31, 2), (903, [float("inf")] * 32, None)]
    rows = spark.createDataFrame([(*r, "x") for r in data + bad], "vec_id long, embedding array<double>, label int, code string").repartition(3)
    got = {r["vec_id"]: r for r in codes.vector_codes(rows).collect()}
    whole = [(i, [max(-(2**63), min(2**63 - 1, math.floor(256 * x))) for x in v]) for i, v, _ in data]
    want, sha = own_codes(whole)
    assert got.keys() == want.keys() and {r["codebooks_sha256"] for r in got.values()} == {sha}
    sums = defaultdict(int)
    for i, _, label in data:
        sums[label] += want[i][1]
    fits = lambda x: x if x < 2**63 else None
    for i, _, label in data:
        assert (got[i]["code"], got[i]["error"]) == (want[i][0], fits(want[i][1]))
        if scale <= 1:
            assert got[i]["label_error"] == sums[label]


def test_codes_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label string"
    assert codes.vector_codes(spark.createDataFrame([], schema)).count() == 0
    assert codes.vector_codes(spark.createDataFrame([(1, None, "a")], schema)).count() == 0
    empty = codes.vector_codes(spark.createDataFrame([(1, [], "a"), (1, [], None)], schema)).collect()
    assert [(r["code"], r["error"], r["label_error"]) for r in empty] == [("00" * 16, 0, 0)] * 2
    ragged = codes.vector_codes(spark.createDataFrame([(1, [1.0] * 20, "a"), (None, [1.0], None), (1, [1.0] * 20, "a"), (2, [], "b")], schema)).collect()
    assert len(ragged) == 4 and all(r["error"] == 0 and len(r["code"]) == 32 for r in ragged)


def test_annulus_leaves_entries_out_but_never_the_nearest():
    rng = np.random.default_rng(1)
    for kind in (np.int64, object):
        x = (rng.normal(size=(400, 4)) * 40).astype(np.int64).astype(kind)
        e = (rng.normal(size=(64, 4)) * 40).astype(np.int64).astype(kind)
        e[7] = e[3]
        code, d, computed = codes.nearest(x, e)
        every = ((x[:, None] - e[None]) ** 2).sum(axis=2)
        assert d.tolist() == every.min(axis=1).tolist() and code.tolist() == [row.index(min(row)) for row in every.tolist()]
        assert computed < 400 * 64


# exact duplicates


def own_groups(rows):
    groups = defaultdict(list)
    for i, (doc, text) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc is None, doc or 0, i))
    out = []
    for bare, own in groups.items():
        first = min(own)
        out += [(rows[o[3]][0], rows[first[3]][0], len(own), o == first, hashlib.sha256(bare.encode()).hexdigest()) for o in own]
    return sorted(out, key=repr)


COPIES = [(1, "a b"), (2, "ab "), (3, "a\tb\n"), (4, None), (5, ""), (6, " \x0b\x0c\r"), (7, "a b"), (8, "😀 b"), (9, "😀b"), (10, "x" * 100_000), (None, "x" * 100_000), (None, None), (11, "ab"), (11, "ab"), (12, "AB"), (13, "alone")]


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


@pytest.mark.parametrize("most", [exact_dedup.SLICE, 2])
def test_groups_are_those_of_brute_force(spark, most):
    rows = COPIES + [(100 + i, f"text {i}") for i in range(1500)] + [(5000 + i, f"copy {i % 3}") for i in range(400)]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, h string, row int").repartition(5)
    got = rows_of(exact_dedup.exact_dedup(docs, most=most))
    want = own_groups(rows)
    # of rows that repeat doc_id and text one stays, whichever it is
    assert got == want


def test_large_groups_meet_by_broadcast(spark, monkeypatch):
    from deskloom.llm import shared

    monkeypatch.setattr(shared, "LARGE", 50)
    rows = [(i, "hot" if i % 3 else f"pair {i // 6}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(exact_dedup.exact_dedup(docs)) == own_groups(rows)


def test_no_copy_is_missed_by_the_filter_and_few_others_shuffle(spark):
    from pyspark.sql import functions as F

    docs = spark.range(30_000).select(F.xxhash64(F.when(F.col("id") < 1000, F.col("id") % 400).otherwise(F.col("id"))).alias("h"), "id").repartition(6)
    segments = 30_000 // exact_dedup.VALUES
    rows = exact_dedup.possibly_repeated(docs, exact_dedup.repeated_filter(docs, segments), segments)
    assert rows.where("id < 1000 AND NOT __maybe").count() == 0
    assert rows.where("id >= 1000 AND __maybe").count() < 1000


def test_no_copies_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert rows_of(exact_dedup.exact_dedup(docs)) == own_groups([(1, "a"), (2, "b")])
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0
