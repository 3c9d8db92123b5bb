"""Operators on conversations, pages and vectors, and the pipeline."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import math
import operator
import random
import re
import sys

import numpy as np
import pytest
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from deskloom.llm import chat, html_text, language, mixing, topk, url_filter, warc
from deskloom.llm.quality import quality_rules
from deskloom.llm.queries import QUERIES, VOCABULARY
from deskloom.llm.shared import documents

CALLS = "conv_id long, call_id string, after_id string, turn long, name string, arguments string"
RESULTS = "conv_id long, call_id string, turn long, content string"
TOOLS = {"add": {"a": ("number", True), "b": ("integer", True), "note": ("string", False)}, "ping": {}}


def linked(spark, calls, results):
    out = chat.link_tool_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), TOOLS)
    return {(r.conv_id, r.call_id): r for r in out.collect()}


def test_tool_calls(spark):
    calls = [
        (1, "a", None, 1, "add", '{"b": 2, "a": 1.5}'),
        (1, "b", "a", 3, "add", '{"a": "x", "b": 2}'),
        (1, "c", "b", 5, "ping", "{}"),
        (1, "c", None, 9, "ping", '{"again": 1}'),
        (1, "d", "e", 6, "add", '{"a": 1}'),
        (1, "e", "d", 7, "nope", "{}"),
        (1, "f", "zz", 8, "ping", "[1]"),
        (2, "a", None, 9, "add", "not json"),
        (2, "b", None, 1, "add", '{"a": 1, "b": 2, "z": 0, "note": null}'),
        (None, "a", None, 1, "ping", "{}"),
    ]
    results = [(1, "a", 2, "3.5"), (1, "c", 4, "late?"), (1, "x", 4, "lost"), (2, "b", 2, None), (1, "a", 4, "second"), (None, "q", 1, "z")]
    got = linked(spark, calls, results)
    assert [got[1, x].level for x in "abcdef"] == [0, 1, 2, None, None, 0]
    assert [got[1, x].status for x in "abcdefx"] == ["linked", "pending", "early", "cycle", "cycle", "pending", "orphan"]
    assert [got[1, x].error for x in "abcdef"] == [None, "a is not number", None, "b is missing", "unknown tool", "not an object"]
    assert got[2, "a"].error == "not an object" and got[2, "b"].error == "unknown z" and got[2, "b"].result_turn == 2
    assert got[1, "a"].json == '{"arguments":{"a":1.5,"b":2},"id":"a","name":"add","result":"3.5"}'
    assert got[None, "a"].status == "pending" and got[None, "q"].status == "orphan" and len(got) == 11
    assert json.loads(got[2, "a"].json)["arguments"] == {"text": "not json"}
    assert linked(spark, [], []) == {}


def test_names_of_parameters_and_numbers_out_of_range(spark):
    tools = {"t": {"a.b": ("integer", True), "c[0]": ("string", False), "it's": ("boolean", False)}}
    given = ['{"a.b": 1, "c[0]": "x", "it\'s": true}', '{"a": {"b": 1}}', '{"a.b": 1, "c[0]": 2}', '{"a.b": 1e400}', '{"a.b": 1, "c[0]": "Infinity 1e400"}', '{"a.b": 1, "c[0]": "-Infinity"}', '{"a.b": -1E+999, "c[0]": "\\"Infinity\\""}', "1e308", None, '{"a.b": 1' + "0" * 400 + "}", '{"a.b": 2, "c[0]": "' + "x" * 100_000 + '"}']
    calls = spark.createDataFrame([(1, str(i), None, i, "t", g) for i, g in enumerate(given)], CALLS).withColumn("error", F.lit("clash"))
    got = {int(r.call_id): r for r in chat.link_tool_calls(calls, spark.createDataFrame([], RESULTS), tools).collect()}
    assert [got[i].error for i in range(len(given))] == [None, "a.b is missing", "c[0] is not string", "not an object", None, None, "not an object", "not an object", "not an object", "not an object", None]
    for i, g in enumerate(given):
        arguments = json.loads(got[i].json)["arguments"]
        assert arguments == ({"text": g} if i in (3, 6, 8, 9) else json.loads(g)), i
    with pytest.raises(ValueError):
        chat._path("a'b\"c")


def test_tool_calls_whose_ids_hold_colons(spark):
    calls = spark.createDataFrame([("a:b", "c", "b:c", 1, "add", '{"a": 1, "b": 2.0}'), ("a", "b:c", None, 2, "add", None)], CALLS.replace("conv_id long", "conv_id string"))
    results = spark.createDataFrame([("a", "b:c", 3, "mine")], RESULTS.replace("conv_id long", "conv_id string"))
    got = {(r.conv_id, r.call_id): r for r in chat.link_tool_calls(calls, results, TOOLS).collect()}
    assert (got["a:b", "c"].status, got["a:b", "c"].level, got["a:b", "c"].error) == ("pending", 0, None)
    assert (got["a", "b:c"].status, got["a", "b:c"].result_turn, got["a", "b:c"].error) == ("linked", 3, "not an object")


def test_levels_of_a_long_chain(spark):
    calls = [(1, str(i), str(i - 1) if i else None, i, "ping", "{}") for i in range(70)]
    assert [r.level for (_, i), r in sorted(linked(spark, calls, []).items(), key=lambda x: int(x[0][1]))] == list(range(70))


def best(rows, div, k=5):
    fine = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in fine:
        if q % div == 0:
            ranked = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in fine if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("block", [4000, 60])
def test_topk(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 1) * math.exp(r.gauss(0, 1)) for _ in range(6)] if i % 41 else [0.0] * 6) for i in range(400)]
    rows += [(i, rows[7][1]) for i in range(400, 420)] + [(500, None), (501, [None] + [1.0] * 5), (550, [math.nan] * 6), (600, [math.inf] + [0.0] * 5), (None, [1.0] * 6)]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    vectors = topk.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("norm", F.lit("mine")).withColumn("bucket", F.lit(1)))
    assert sorted(tuple(x) for x in topk.norm_topk(vectors, vectors.where("vec_id % 50 = 0")).collect()) == best(rows, 50)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_topk_of_few(spark, n):
    rows = [(i * 50, [float(i), 1.0]) for i in range(n)]
    vectors = topk.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert sorted(tuple(x) for x in topk.norm_topk(vectors, vectors).collect()) == best(rows, 50)


def test_topk_of_large_and_ragged_vectors(spark):
    """Products beyond 64 bits are held there, and shorter vectors filled up with zeros."""
    r = random.Random(8)
    rows = [(i, [r.choice([-1, 1]) * 10.0 ** r.uniform(-3, 20) for _ in range(r.randint(0, 5))]) for i in range(120)]
    rows += [(200, [1e308, -1e308]), (201, [1e18, -1e17]), (202, [1.0, 1.0]), (250, []), (251, [1e-3])]
    whole = {i: [int(256 * x) if abs(256 * x) >= 2**53 else math.floor(256 * x) for x in v] for i, v in rows if i != 200}
    whole[200] = [int(sys.float_info.max), -int(sys.float_info.max)]
    want = []
    for i, v in whole.items():
        if i % 50 == 0:
            scores = [(max(-(2**63), min(2**63 - 1, sum(map(operator.mul, v, w)))), j) for j, w in whole.items() if j != i]
            want += [(i, n, j, s) for n, (s, j) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:5], 1)]
    vectors = topk.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted(tuple(x) for x in topk.norm_topk(vectors, vectors.where("vec_id % 50 = 0")).collect()) == sorted(want)


def test_partial_products_keep_what_reaches_the_bound():
    """On unit vectors in 64 coordinates, most pairs are out after three quarters of the products."""
    r = np.random.default_rng(3)
    c = r.normal(size=(3000, 64))
    c = np.floor(256 * c / np.sqrt((c**2).sum(axis=1))[:, None])
    q = c[:40]
    scores = q @ c.T
    bounds = np.sort(scores, axis=1)[:, -6]
    i, j, products = topk._survivors(q, c, bounds)
    assert (products == scores[i, j]).all()
    assert set(zip(*np.nonzero(scores >= bounds[:, None]))) <= set(zip(i, j))
    assert len(i) < 0.15 * scores.size


def test_topk_query(spark, small):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    assert sorted(tuple(x) for x in QUERIES["op7_norm_topk"](spark, small).select("query_id", "rank", "vec_id", "score").collect()) == best(rows, 50)


def test_pruning_keeps_what_reaches_the_bound():
    r = np.random.default_rng(1)
    c = r.integers(-300, 300, (500, 5))
    c = c[np.argsort(-np.sqrt((c**2).sum(1)), kind="stable")]
    length = np.sqrt((c.astype(float) ** 2).sum(1))
    for q in r.integers(-300, 300, (40, 5)):
        scores = c @ q
        for bound in (float(np.sort(scores)[-5]), float(np.sort(scores)[-60]), 1e9, -5.0):
            assert set(np.flatnonzero(scores >= bound)) <= set(topk._pruned(q, c / length[:, None], length, bound))


def test_urls(spark):
    rows = {
        "https://A.Example.NET/en/x?q#f": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "http://example.net/EN/": ("example.net", "/EN/", "net/", "block"),
        "http://example.net": ("example.net", "", None, "allow"),
        "http://notexample.com/de/": ("notexample.com", "/de/", None, "allow"),
        "http://x.example.com/de/1": ("x.example.com", "/de/1", "example.com/de/", "block"),
        "http://a.org/fr/?x://y": ("a.org", "/fr/", "org/fr/", "allow"),
        "no url": ("", "", None, "allow"),
        "http://spam.com/a/?utm_x=1&b=2#t": ("spam.com", "/a/", None, "block"),
        "HTTPS://www.spam.com:443/a?b=2": ("www.spam.com:443", "/a", None, "block"),
        "://?": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string").withColumn("canonical", F.lit("mine"))
    listed = spark.createDataFrame([("spam.com/a?b=2",), (None,), ("other.com/x",)], "canonical string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, listed).collect()}
    assert got == dict(enumerate(rows.values()))
    assert url_filter.filter_urls(pages, listed.limit(0)).where("listed").count() == 0
    assert url_filter.filter_urls(pages.limit(0), listed).count() == 0


PAGES = "page_id long, url string, html string"


def histories(spark, rows):
    df = spark.createDataFrame(rows, PAGES).repartition(3).withColumn("digest", F.lit("mine"))
    out = sorted(warc.archive_pages(df).collect(), key=lambda r: (r.range, r.position))
    keys = [(r.urlkey, r.captured, r.page_id) for r in out]
    assert keys == sorted(keys)
    return sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out)


def test_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS", 20)
    monkeypatch.setattr(warc, "RANGE", 50)
    r = random.Random(2)
    payloads = ["", None, "a\r\n\r\nWARC/1.1\r\n", "é \n\n\r\n\r\n", "x\0y", "same", "long " * 20_000]
    rows = [(i, r.choice(["http://a.b/c", "https://www.X.org/é?q#f", None, "no url", "http://h/ x\r\ny"]), r.choice([*payloads, str(r.random())])) for i in r.sample(range(900), 200)]
    rows += [(7_000, "u", "dup"), (7_000, "u", "dup"), (None, "u", "x"), (-5, "http://z/", "same"), (7_000, "v", "same")]
    bodies = [(i, (h or "").encode()) for i, _, h in rows if i is not None]
    first = {}
    for i, b in bodies:
        first[b] = min(i, first.get(b, i))
    want = sorted((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first[b] == i else "revisit", None if first[b] == i else first[b]) for i, b in bodies)
    assert histories(spark, rows) == want
    assert histories(spark, []) == []


def test_archives_end_by_bytes(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "BYTES", 30_000)
    rows = [(i, f"http://h/{i}", "x" * (20_000 if i % 5 == 0 else 100)) for i in range(60)]
    warc.write_archives(spark.createDataFrame(rows, PAGES).coalesce(1), str(tmp_path / "w"), 1 << 30)
    sizes = [len(gzip.decompress(f.read_bytes())) for f in (tmp_path / "w").rglob("*.gz")]
    assert len(sizes) > 5 and max(sizes) < 30_000 + 21_000
    index = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert sorted(r.page_id for r in index) == list(range(60))
    assert len({r.archive for r in index}) == len(sizes)


def test_loser_tree():
    r = random.Random(1)
    for k in (0, 1, 2, 3, 7, 8):
        runs = [sorted((r.randint(0, 20), i) for _ in range(r.choice([0, 1, 15]))) for i in range(k)]
        got = list(warc.LoserTree([iter([((x,), y) for x, y in run]) for run in runs]))
        assert [x[0][0] for x in got] == sorted(x for run in runs for x, _ in run)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><ul><li>one<li>two<ul><li>x<li>y</ul></ul><!-- c -->
<p>Hello <b>bold<br>line<p>Second   para &amp; more<div hidden>no</div><span style="display: none">no</span>
<table><tr><th>Name<th>Qty<tr><td>Apple<td>10<tr><td colspan=2>wide</table><ol start=3><li>a<p>b</p></li><li>c</ol><pre>  x
   y</pre>tail<dl><dt>T<dd>D</dl><p style="visibility:hidden">h<i style="visibility:visible">seen</i></p>"""
TEXT = """- one
- two

  - x
  - y

Hello bold
line

Second para & more

Name   Qty
Apple  10
wide

3. a

   b
4. c

  x
   y

tail

T
  D

seen"""


def test_html(spark):
    rows = [(1, PAGE), (2, None), (3, ""), (4, "<div>" * 3000 + "x" + "<table><tr><td>" * 2000 + "y"), (5, "plain"), (6, "<p>" + "w " * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit("mine"))
    got = {r.page_id: r.text for r in html_text.extract_text(df).collect()}
    assert re.sub(r" +\n", "\n", got[1]) == TEXT
    assert got[2] == got[3] == "" and got[4].split() == ["x", "y"] and got[5] == "plain" and len(got[6].split()) == 50_000
    assert html_text.extract_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("depth", [100, 160, 3000, 20_000])
@pytest.mark.parametrize("tag", ["font", "div", "section"])
def test_html_at_any_depth(depth, tag):
    inside = '<script>var a</script><style>b{}</style><template>t</template><div style="display:none">no</div>seen<ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c<td>d</table>'
    assert html_text.visible_text(f"<{tag}>" * depth + inside) == "seen\n\n- one\n- two\n\na  b\nc  d"
    # an end tag closes its own element, and not the hidden one around it
    assert html_text.visible_text("<i>" * depth + f"<div hidden><{tag}>no</{tag}>no</div>seen") == "seen"


def test_html_of_nested_containers():
    for a, b in (("<ul><li>", "</li></ul>"), ("<blockquote>", "</blockquote>"), ("<table><tr><td>", "</td></tr></table>"), ("<details open>", "</details>")):
        assert html_text.visible_text("<script>no</script>" + a * 2000 + "x" + b * 2000 + "y").split()[-2:] == ["x", "y"]


def test_html_leaves_no_markup(spark, small):
    rows = spark.read.parquet(f"{small}/pages.parquet").collect()
    for r in rows:
        text = html_text.visible_text(r.html)
        assert "track(" not in text and "</" not in text and "&amp;" not in text
        body = re.sub(r"(?s)<head>.*?</head>", "", r.html)
        assert len(text.split()) >= 0.95 * len(re.sub(r"<[^>]*>", " ", body).split())


def text_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_pipeline(spark, small):
    docs = documents(spark, small)
    rows = corpus_pipeline.run(spark, small).collect()
    kept = quality_rules(docs).where("kept").select("doc_id")
    one = docs.join(kept, "doc_id", "left_semi")
    two = language.in_a_language(one, language.train(one.where(~language.held_out())))
    assert two.count() >= 0.97 * one.count()
    # one of each group of near copies, by comparing all pairs
    texts = {r.doc_id: r for r in two.collect()}
    sets = {d: text_shingles(r.text) for d, r in texts.items()}
    group = {d: d for d in texts}
    for x in sorted(sets):
        for y in sorted(sets):
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]) and group[x] != group[y]:
                low, high = sorted((group[x], group[y]))
                group = {d: low if g == high else g for d, g in group.items()}
    kept = {d for d, g in group.items() if d == g or not sets[d]}
    three = two.where(F.col("doc_id").isin(*kept))
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(three).collect()}
    encode = tokenizers.Tokenizer.from_file(VOCABULARY)
    encode.no_truncation()
    encode.no_padding()
    want = []
    for d in kept:
        ids = encode.encode(texts[d].text, add_special_tokens=False).ids
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        want += [(d, len(ids), digest, hashlib.sha256(encode.decode(ids, skip_special_tokens=False).encode()).hexdigest())] * copies[d]
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == sorted(want)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "language ID", "near duplicates", "mix", "encode"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns
    assert set(rows[0].asDict()) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} and VOCABULARY.endswith("byte_bpe_50k.json")
