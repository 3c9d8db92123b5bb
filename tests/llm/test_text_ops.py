"""Operators on texts against brute-force versions, with odd rows of every kind."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from deskloom.llm import bloom, bpe, components, language, mixing, ngram_join, quality
from deskloom.llm import shingles as ngrams
from deskloom.llm.queries import ORACLE, QUERIES, VOCABULARY
from deskloom.llm.shared import documents, numbered

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ODD = [
    (1, None, "en", "a", None),
    (2, "", "en", "a", 0),
    (3, " \t\n ", None, None, 4),
    (4, "The quick brown fox. " * 30, "en", "a", 1),
    (4, "The quick brown fox. " * 30, "en", "a", 1),
    (5, LONG, "en", "b", 1),
    (6, LONG + " end", "en", None, 1),
    (None, "no id at all here", "en", "b", 1),
    (7, "éÉ ß\u00a0x\x1cy 日本 🙂 <|endoftext|>", "fr", "é", 1),
    (8, "one two", "en", "b", 1),
    (9, "ONE  two", "de", "b", 1),
    (10, "one two three", "de", "𐍈", 1),
    (11, "12345 !!! 67", "de", "\uffff", 1),
    (12, "½ ² ①", "de", "a", 1),
]


def odd(spark, rows=ODD):
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    """With columns named as those that operators make."""
    extra = "n_words keys cls component_id ids decoded score lang_pred bits_per_byte size taken copies rank bin edge canonical __hit kept value"
    return df.withColumns({c: F.lit("mine") for c in extra.split()})


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, n):
    w = WORD.findall(low(text))
    return frozenset(zip(*(w[i:] for i in range(n)))) if len(w) >= n else frozenset([tuple(w)] if w else [])


def classes(rows, n, num, den):
    sets = {i: shingles(t, n) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(list)
    for i in sorted(sets):
        seen = Counter(j for g in sets[i] for j in by[g])
        for j, k in seen.items():
            if den * k >= num * (len(sets[i]) + len(sets[j]) - k):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for g in sets[i]:
            by[g].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80), (2, 50)])
def test_ngram_join(spark, small, n, num):
    docs = documents(spark, small)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(clashing(docs), n, num, 100).collect()}
    assert got == classes([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], n, num, 100)


def family(size):
    """A base, and copies with more and more of it changed."""
    base = [f"x{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, size):
        words = list(base)
        for j in range(i % 9):
            words[(i * 13 + j * 29) % 120] = f"new{i}_{j}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("paired", [32, 1])
def test_ngram_join_of_a_large_group(spark, monkeypatch, paired):
    monkeypatch.setattr(ngram_join, "PAIRED", paired)
    monkeypatch.setattr(ngram_join, "BLOCK", 2000)
    rows = family(90)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()}
    assert got == classes(rows, 3, 90, 100)


@pytest.mark.parametrize("chunk", [1 << 19, 64, 1000])
def test_ngram_sets(monkeypatch, chunk):
    monkeypatch.setattr(ngrams, "CHUNK", chunk)
    monkeypatch.setattr(ngrams._Powers, "up", np.ones(1, np.uint64))
    r = random.Random(1)
    words = ["a", "A", "bb", "é", "É", "x y", "日本", "q" * 40, "-", " ", "\n", "\t \r", "\x0b"]
    texts = [None if r.random() < 0.05 else "".join(r.choice(words) + r.choice(["", " ", "  ", "\n"]) for _ in range(r.randint(0, 14))) for _ in range(1500)]
    texts += ["w" * 3000 + " b c d " + "z" * 100, "b c d " * 50, ("w" * 50 + " ") * 300, "w" * 2000]
    for n in (1, 3, 5):
        seen, back = {}, {}
        for text, got in zip(texts[3:], ngrams.ngram_sets(pa.array(texts).slice(3), n), strict=True):
            want, key = shingles(text, n), got.tobytes()
            assert len(got) == len(want) and seen.setdefault(key, want) == want and back.setdefault(want, key) == key


def test_ngram_join_of_templated_documents(spark, monkeypatch):
    """Many short documents with one template: no block holds more than CLASSES of them on a side."""
    monkeypatch.setattr(ngram_join, "CLASSES", 150)
    monkeypatch.setattr(ngram_join, "PAIRED", 20)
    rows = [(i, f"dear customer {i // 2} your parcel number has now arrived safely here {'today' if i % 2 else 'again'} and we thank you for all your patience") for i in range(800)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()}
    assert got == classes(rows, 3, 90, 100)


def test_ngram_join_of_odd_rows(spark):
    rows = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(odd(spark), 3, 90, 100).collect()]
    assert len(rows) == len(ODD)
    got = {i: c for i, _, c in rows}
    assert (got[1], got[2], got[3]) == (1, 2, 3)
    assert got[8] == got[9] == 8 and got[10] == 10 and got[5] == got[6] == 5
    assert ngram_join.ngram_components(odd(spark, [])).count() == 0


def test_without_copies_keeps_one_of_each(spark):
    got = sorted(r.doc_id or -1 for r in ngram_join.without_copies(clashing(odd(spark))).collect())
    assert got == [-1, 1, 2, 3, 4, 5, 7, 8, 10, 11, 12]


def test_components(spark):
    links = [(5, 4), (4, 3), (9, 8), (3, 1), (8, 7), (2, 2), (None, 3), (6, 5)] + [(i, i + 1) for i in range(100, 160)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 7, 8: 7, 9: 7} | {i: 100 for i in range(100, 161)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bloom_loses_nothing(spark):
    values = spark.range(0, 3000, 3).withColumnRenamed("id", "v")
    hit = {r.v: r["__hit"] for r in bloom.marked(spark.range(3000).withColumnRenamed("id", "v"), "v", values).collect()}
    assert all(hit[v] for v in range(0, 3000, 3)) and sum(hit.values()) < 1300


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_bpe_round_trip(spark, small):
    t = Tokenizer.from_file(VOCABULARY)
    rows = ODD + [(20, "a" * 5000 + " " * 3000 + "ab" * 900, None, None, 1), (21, "\0<|endoftext|>\0 <|endoftext|><|endoftext|>", None, None, 1)]
    texts = {r[0]: r[1] for r in rows} | {10_000 + r.doc_id: r.text for r in documents(spark, small).collect()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in bpe.bpe_digests(clashing(df), VOCABULARY).collect():
        ids = t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()))
        assert r.decoded_sha256 == sha(t.decode(ids, skip_special_tokens=False).encode())
    assert bpe.bpe_digests(df.limit(0), VOCABULARY).count() == 0
    broken = spark.createDataFrame([([447],), (None,), ([],)], "ids array<int>")
    assert [r.decoded for r in bpe.bpe_decode(broken, VOCABULARY).collect()] == [t.decode([447]), "", ""]


def measures(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    covered = {p for places in windows.values() if len(places) > 1 for i in places for p in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark, small):
    extra = [(30, "a b c d e f g h " * 3 + "z", None, None, 1), (31, "x\ny\nx\n\n\nx\r\n| # %", None, None, 1), (32, "q " * 8 + "r " * 9, None, None, 1)]
    rows = [(r[0], r[1]) for r in ODD + extra] + [(10_000 + r.doc_id, r.text) for r in documents(spark, small).collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality_rules(clashing(df)).collect()), key=str)
    want = []
    for i, t in rows:
        m = measures(t)
        want.append((i, *m, m[0] < 20 or 100 * m[4] > 30 * m[0]))
    assert got == sorted(want, key=str)
    assert quality.quality_rules(df.limit(0)).count() == 0


def test_quality_stage_keeps_columns(spark, small):
    docs = clashing(documents(spark, small))
    kept = quality.passing(docs)
    assert kept.columns == docs.columns
    assert kept.count() == quality.quality_rules(docs).where("kept").count()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_duckdb(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    rel = con.sql(ORACLE[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)


def test_language_model_has_exact_code_lengths(spark, small):
    docs = documents(spark, small).where(~language.held_out()).limit(60)
    model = language.train(docs).prepared()
    after = defaultdict(Counter)
    for r in docs.select("text", "lang").collect():
        raw = b"\n" * language.ORDER + r.text.encode()
        for i in range(language.ORDER, len(raw)):
            for k in range(language.ORDER + 1):
                after[r.lang, raw[i - k : i]][raw[i]] += 1

    def bits(text, lang):
        raw, out = b"\n" * language.ORDER + text, 0.0
        for i in range(language.ORDER, len(raw)):
            for k in range(language.ORDER, -1, -1):
                seen = after.get((lang, raw[i - k : i]))
                if seen:
                    total = sum(seen.values()) + len(seen)
                    if raw[i] in seen:
                        out -= math.log2(seen[raw[i]] / total)
                        break
                    out -= math.log2(len(seen) / total)
            else:
                out += 8
        return out

    texts = [r.text.encode()[:1500] for r in documents(spark, small).where(language.held_out()).limit(8).collect()] + ["日本語 x".encode(), b"\n\n", b"", b"the"]
    for text, got in zip(texts, model.code_lengths(texts)):
        assert got == pytest.approx([bits(text, x) for x in model.languages], rel=1e-4, abs=1e-3)


def test_long_texts_are_scored_in_pieces(spark, small, monkeypatch):
    model = language.train(documents(spark, small).limit(60)).prepared()
    text = b"the cat and the dog " * 200
    whole = model.code_lengths([text, b"x", text])
    monkeypatch.setattr(language, "CHUNK", 777)
    assert model.code_lengths([text, b"x", text]) == pytest.approx(whole, rel=1e-5)


def test_language_predictions(spark, small):
    docs = documents(spark, small)
    rows = language.predict_languages(clashing(docs.drop("score"))).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(spark):
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict_languages(odd(spark)).collect()}
    assert got[1] == got[2] == got[3] == got[11] == got[12] == ("und", 0.0)
    assert got[4][0] in ("en", "de", "fr")
    assert language.predict_languages(odd(spark, [])).count() == 0
    unlabelled = odd(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.predict_languages(unlabelled).collect()} == {"und"}
    docs = clashing(odd(spark))
    kept = language.in_a_language(docs, language.train(docs))
    assert kept.columns == docs.columns and {(r.score, r.lang_pred) for r in kept.collect()} == {("mine", "mine")}


def many_languages():
    """70 languages, each with a script of its own; the last ones are the rarest."""
    words = lambda i, j: " ".join(chr(0x4E00 + 100 * i + (7 * j + k * k) % 90) * 3 for k in range(12))
    return [(1000 * i + j, words(i, j), f"l{i:02}", "s", None) for i in range(70) for j in range(6 if i < 64 else 5)]


@pytest.mark.parametrize("most", [1 << 23, 20_000])
def test_every_language_is_learned(spark, monkeypatch, most):
    monkeypatch.setattr(language, "MOST_COSTS", most)
    docs = odd(spark, many_languages())
    model = language.train(docs)
    assert model.languages == [f"l{i:02}" for i in range(70)] and (len(model.groups) > 1) == (most == 20_000)
    rows = docs.collect()
    got = {r.doc_id: r for r in language.identify_language(docs.unionByName(odd(spark, [(-1, "...", None, "s", None)])), model).collect()}
    assert len(got) == len(rows) + 1 and got[-1].lang_pred == "und" and got[-1].score == 0
    assert all(got[r.doc_id].lang_pred == r.lang for r in rows)
    for r in rows[::50]:
        raw = r.text.encode()
        bits = model.code_lengths([raw])[0]
        assert got[r.doc_id].bits_per_byte == pytest.approx(min(bits) / len(raw)) and got[r.doc_id].score == pytest.approx(1 / sum(2 ** (min(bits) - x) for x in bits))
    assert language.in_a_language(docs, model).count() == len(rows)


def targets(sizes, weights=(5, 2, 1), most=3):
    """By taking out sources over their cap until none is left."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        out |= {s: float(most * sizes[s]) for s in over}
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


@pytest.mark.parametrize("weights", [(5, 2, 1), (1,), (1, 100)])
def test_mixing(spark, small, weights):
    docs = documents(spark, small).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "src0").when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise(F.col("source")))
    texts = {r.doc_id: (r.source, len(WORD.findall(r.text or ""))) for r in docs.collect()}
    sizes = Counter()
    for s, n in texts.values():
        sizes[s] += n
    want = targets(sizes, weights)
    rows = mixing.mix_sources(clashing(docs.drop("size", "taken", "copies", "rank", "bin", "edge")), weights).collect()
    assert len(rows) == len(texts)
    taken = Counter()
    for r in rows:
        assert (r.source, r.size) == texts[r.doc_id] and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.05 * t, 0.5 * max(n for x, n in texts.values() if x == s))
    again = {(r.doc_id, r.copies) for r in mixing.mix_sources(docs.repartition(3), weights).collect()}
    assert again == {(r.doc_id, r.copies) for r in rows}


def test_mixing_of_odd_rows(spark):
    rows = mixing.mix_sources(odd(spark)).collect()
    assert len(rows) == len(ODD) and {r.size for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert mixing.mix_sources(odd(spark, [])).count() == 0
    assert mixing.mix_sources(odd(spark, ODD[:3])).agg(F.sum("taken")).first()[0] == 0
    docs = clashing(odd(spark))
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r.copies for r in rows)


def words_taken(spark, sizes, weights):
    rows = [(1000 * i + j, "w " * n, s) for i, s in enumerate(sorted(sizes)) for j, n in enumerate(sizes[s])]
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"))
    return {r.source: (r.taken, round(r.target)) for r in out.collect()}


def test_mixing_takes_documents_longer_than_what_is_lacking(spark):
    assert words_taken(spark, {"a": [100], "b": [100]}, (5, 2)) == {"a": (100, 143), "b": (100, 57)}
    assert words_taken(spark, {"a": [1000] * 10, "b": [1000] * 2}, (9, 111)) == {"a": (6000, 6000), "b": (6000, 6000)}
    assert words_taken(spark, {"a": [1000] * 10, "b": [1000] * 10}, (9, 191)) == {"a": (1000, 900), "b": (19000, 19100)}
    # a dominating document is taken where that is nearer, and leaves the place to the others where it isn't
    assert words_taken(spark, {"a": [950] + [1] * 50, "b": [1000]}, (9, 11)) == {"a": (950, 900), "b": (1000, 1100)}
    assert words_taken(spark, {"a": [20000] + [200] * 100, "b": [1600] * 25}, (4, 46)) == {"a": (6400, 6400), "b": (73600, 73600)}


def level(sizes, lack):
    """The scale at which min(1, scale * size) documents of each size have as many words as are lacking, by halving."""
    low, high = 0.0, 2 / min(s for s in sizes if s)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (low, mid) if sum(min(1, mid * s) * s for s in sizes) > lack else (mid, high)
    return low


def test_mixing_takes_by_pareto_rank(spark):
    """The rest of a source is a prefix of the ranks that odds over inclusion odds give, of large documents and then of small ones."""
    r = random.Random(3)
    sizes = [r.choice([5, 20, 60, 150, 400, 900]) for _ in range(400)]
    docs = spark.createDataFrame([(i, "w " * n, "a" if i % 2 else "b") for i, n in enumerate(sizes)], "doc_id long, text string, source string")
    rows = mixing.mix_sources(docs, (3, 7)).collect()
    for source in ("a", "b"):
        own = [x for x in rows if x.source == source]
        whole = int(own[0].target // own[0].source_size)
        lack = own[0].target - whole * own[0].source_size
        scale = level([x.size for x in own], lack)
        hashes = {x.doc_id: x.h for x in docs.select("doc_id", F.xxhash64(F.lit(17), "doc_id", "text").alias("h")).collect()}
        for x in own:
            u, p = ((hashes[x.doc_id] % (1 << 64) >> 11) + 0.5) * 2.0**-53, scale * x.size
            assert x.rank == (0 if p >= 1 else pytest.approx(0.5 + math.log2((u / (1 - u)) / (p / (1 - p))) / 256, rel=1e-9))
        large = [x for x in own if lack < 64 * x.size <= 64 * lack]
        small = [x for x in own if 64 * x.size <= lack]
        want = [sum(min(1, scale * x.size) * x.size for x in some) for some in (large, small)]
        left = lack
        goal, taken = min(sum(x.size for x in large), max(lack * want[0] / sum(want), lack - sum(x.size for x in small))), set()
        for some in (large, small):
            upto = 0
            for x in sorted(some, key=lambda x: x.rank):
                if upto + x.size / 2 > goal:
                    break
                upto += x.size
                taken.add(x.doc_id)
            goal = left = left - upto
        assert {x.doc_id for x in own if x.copies > whole} == taken and abs(left) <= max(x.size for x in small) / 2


def test_pareto_inclusion_follows_size(spark):
    """Documents three times as long are taken three times as often."""
    docs = spark.createDataFrame([(i, "w " * (30 if i % 2 else 10), "a" if i < 4000 else "b") for i in range(6000)], "doc_id long, text string, source string")
    rows = mixing.mix_sources(docs, (1, 4)).where("source = 'a'").groupBy("size").agg(F.avg("copies").alias("share"), F.first("target").alias("target")).collect()
    for x in rows:
        assert x.share == pytest.approx(x.size * x.target / (2000 * (30**2 + 10**2)), abs=0.03)


def test_realised_inclusion_is_that_of_the_design(spark):
    """Over 200 sources with the same sizes, one document of each so long that it is certain."""
    sizes = [800] + [40] * 40 + [10] * 160
    # sources weigh 5, 2, 1 in turn; those that weigh 1 lack 3/8 of their words
    rows = [(1000 * s + i, "w " * n, f"{s:04d}") for s in range(600) for i, n in enumerate(sizes)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(8)).where("CAST(source AS INT) % 3 = 2")
    got = {r["size"]: r for r in got.groupBy("size").agg(F.avg("copies").alias("share"), F.avg("target").alias("target")).collect()}
    lack = got[10]["target"]
    scale = level(sizes, lack)
    assert lack == pytest.approx(sum(sizes) * 3 / 8) and scale * 800 > 1
    assert got[800]["share"] == 1
    # a source ends within half a small document of its target, which one with so few words shows
    assert got[40]["share"] == pytest.approx(scale * 40, rel=0.1)
    assert got[10]["share"] == pytest.approx(scale * 10, rel=0.1)


def test_ranks_of_small_probabilities_do_not_crowd(spark):
    rows = spark.range(20_000).select(F.lit(10).cast("long").alias("size"), F.xxhash64("id").alias("hash"), F.lit(1e6).alias("lack"), F.lit(1e-10).alias("scale"))
    bins = mixing._ranked(rows).groupBy(F.floor(F.col("rank") * 4096.0**2)).count()
    assert bins.agg(F.max("count")).first()[0] < 20


def test_numbered(spark):
    rows = [(i * 37 % 1000, str(i)) for i in range(1000)] + [(None, "n")]
    got = numbered(spark.createDataFrame(rows, "k long, v string").repartition(7), F.col("k").asc_nulls_last(), name="at").collect()
    assert [r.k for r in sorted(got, key=lambda r: r["at"])] == [*range(1000), None] and sorted(r["at"] for r in got) == list(range(1001))


def test_pareto_ranks_follow_inclusion(spark):
    """Units with larger inclusion odds are taken more often: the mean rank falls with them."""
    from deskloom.llm.shared import uniform

    rows = spark.range(20_000).withColumn("p", F.when(F.col("id") % 2 == 0, 0.8).otherwise(0.2)).withColumn("u", uniform(F.col("id"), seed=3))
    ranked = rows.withColumn("q", mixing.pareto_odds(F.col("u"), F.col("p"))).orderBy("q").limit(10_000)
    share = ranked.agg(F.avg((F.col("p") == 0.8).cast("double"))).first()[0]
    assert 0.78 < share < 0.82
