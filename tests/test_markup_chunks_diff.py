"""The sanitiser, the heading tree and word diffs: independent versions, broken input, long texts."""

from __future__ import annotations

import json
import re
import time
import tracemalloc
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from deskloom.functions import chunks, markup, text


class Seen(HTMLParser):
    """What a reader of HTML that knows nothing of the sanitiser finds."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags, self.said, self.others = [], "", []

    def handle_starttag(self, tag, attrs):
        self.tags.append((tag, attrs))

    def handle_data(self, data):
        self.said += data

    def handle_comment(self, data):
        self.others.append(data)

    handle_decl = unknown_decl = handle_pi = handle_comment


LISTED = {"a": {"href", "title", "target", "rel"}, "img": {"src", "alt", "title", "width", "height"}, "td": {"colspan", "rowspan"}, "th": {"colspan", "rowspan"}}


def harmless(html: str) -> Seen:
    seen = Seen()
    seen.feed(html)
    seen.close()
    assert not seen.others
    for tag, attrs in seen.tags:
        assert tag in "p br div span a ul ol li b strong i em u s blockquote pre code h1 h2 h3 h4 h5 h6 hr table thead tbody tfoot tr td th img".split()
        for name, value in attrs:
            assert name in LISTED.get(tag, ()), (tag, name)
            bare = re.sub(r"[\x00-\x20\x7f-\xa0`\s�]", "", value or "").lower()
            if name in ("href", "src"):
                scheme = re.match(r"[a-z][a-z0-9+.-]*(?=:)", bare)
                assert not scheme or scheme[0] in ("http", "https", "mailto", "tel", "cid") or tag == "img" and name == "src" and re.match(r"data:image/(png|jpe?g|gif|webp);base64,", bare)
    return seen


@pytest.mark.parametrize(
    "given_, want",
    [
        ("a < b & c &amp; d &nbsp;\"e\"", 'a &lt; b &amp; c &amp; d \xa0"e"'),
        ("<p onclick=x style='a'>hi<p>there", "<p>hi</p><p>there</p>"),
        ("<script>alert(1)</script>x<STYLE a='b'>p{}</style >y", "xy"),
        ("x<script>alert('<b>')", "xalert('&lt;b&gt;')"),
        ("<!-- a --><!DOCTYPE html><?php 1 ?><![CDATA[ z ]]>b<!-- open", "b"),
        ('<a href="javascript:x()" title=t>k</a>', '<a title="t">k</a>'),
        ('<a href="&#106;ava&#10;script&colon;x()">k</a>', "<a>k</a>"),
        ('<a href=" JaVa\tScRiPt:x">k</a><a href=/p?a:b&amp;c>m</a><a href="MAILTO:a@b">n</a>', '<a>k</a><a href="/p?a:b&amp;c">m</a><a href="MAILTO:a@b">n</a>'),
        ('<img src="data:image/png;base64,AA" alt="x"><img src="data:image/svg+xml;base64,AA"><a href="data:image/png;base64,AA">l</a>', '<img src="data:image/png;base64,AA" alt="x"><img><a>l</a>'),
        ('<img src="da&#9;ta:text/html,x"/>', "<img>"),
        ('<a href="http://a" href="javascript:1" target=_blank>k', '<a href="http://a" target="_blank">k</a>'),
        ("<iframe src=x><form><input>in</form></iframe></b></p>", "in"),
        ("<b><i>x</b>y</i>", "<b><i>x</i></b>y"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", "<ul><li>a</li><li>b<ul><li>c</li></ul></li></ul>"),
        ("<table><tr><td colspan=2 onload=1>a<td>b<tr><th>c</table>", '<table><tr><td colspan="2">a</td><td>b</td></tr><tr><th>c</th></tr></table>'),
        ("tail <b and <i more", "tail &lt;b and &lt;i more"),
        ("1 <2 <- </ x><>", "1 &lt;2 &lt;- &lt;&gt;"),
        ('<a title="a\'b&quot;c<d>">k</a>', '<a title="a&#x27;b&quot;c&lt;d&gt;">k</a>'),
        (None, None),
        ("", None),
    ],
)
def test_what_is_left(given_, want):
    assert markup.clean(given_) == want
    if want:
        harmless(want)


PIECES = st.lists(
    st.one_of(
        st.sampled_from("<a <b> </b> <p> </p> <li> <td> <table> <script> </script> <style> <img <svg> <!-- --> <!x <? /> > = \" ' & &lt; &#60; &colon; href= src= onerror= javascript: data:image/png;base64, &#106; \x01 http: x".split(" ") + [" ", "\n"]),
        st.text(max_size=4),
    ),
    max_size=30,
).map("".join)


@given(PIECES)
@settings(max_examples=400, deadline=None)
def test_nothing_unlisted_survives_and_a_second_pass_changes_nothing(raw):
    once = markup.clean(raw)
    if once:
        harmless(once)
        assert markup.clean(once) == once


def test_all_pages_are_harmless(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    rows = pages.select("html", markup.sanitised("html").alias("safe")).collect()
    assert len(rows) == pages.count()
    for r in rows:
        words = harmless(r["safe"]).said.split()
        assert words and "<script" not in r["safe"].lower()
    nulls = spark.createDataFrame([(None,), ("",)], "html string").select(markup.sanitised("html").alias("safe")).collect()
    assert [r["safe"] for r in nulls] == [None, None]


@pytest.mark.parametrize("piece", ["<a ", "<a b=\"", "<!--", "<script>", "<", "</", "<b>", "</b>", "&", "<a href=x", "<li>", "<table><tr><td>", "<p x=' "])
def test_a_megabyte_of_broken_markup_takes_seconds(piece):
    began = time.time()
    markup.clean(piece * (1_000_000 // len(piece)))
    assert time.time() - began < 8


# paragraphs


def test_paragraphs(spark):
    given_ = ["a\nb\n\nc", "  \"q\" & 'r' <s>\n\n\nt\n", "", None, " \n "]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(given_)], "i int, t string").select("i", text.paragraphs(F.col("t")).alias("h")).orderBy("i").collect()
    assert [r["h"] for r in rows] == ["<p>a<br>b</p><p>c</p>", "<p>&quot;q&quot; &amp; &#x27;r&#x27; &lt;s&gt;</p><p><br>t</p>", "<p></p>", "<p></p>", "<p></p>"]


# the heading tree


def own_chunks(title, body):
    """By cutting with patterns, from the whole to its parts."""

    def cut(part, mark):
        at = [m.start() for m in re.finditer(rf"(?m)^{mark} ", part)]
        return (part[: at[0]], [part[a:b] for a, b in zip(at, [*at[1:], len(part)])]) if at else (part, None)

    def named(block):
        first, _, rest = block.partition("\n")
        return first.lstrip("# ").strip(), rest

    out = []
    head, blocks = cut(body, "##")
    if len(head.split()) >= 25:
        out.append((f"{title} — Overview", head.strip()))
    for block in blocks or []:
        name, rest = named(block)
        intro, subs = cut(rest, "###")
        if subs is None:
            out.append((f"{title} — {name}", rest.strip()))
            continue
        if len(intro.split()) >= 25:
            out.append((f"{title} — {name} (intro)", intro.strip()))
        out += [(f"{title} — {name} — {n}", r.strip()) for n, r in map(named, subs)]
    rows = []
    for name, whole in out:
        if not whole:
            continue
        parts = [whole]
        if len(whole.split()) > 220:
            parts = []
            for p in (q.strip() for q in re.split(r"\n\s*\n", whole)):
                if p and parts and sum(len(x.split()) for x in parts[-1]) + len(p.split()) <= 170:
                    parts[-1].append(p)
                elif p:
                    parts.append([p])
            parts = ["\n\n".join(p) for p in parts]
        rows += [(name if len(parts) == 1 else f"{name} (part {i}/{len(parts)})", p) for i, p in enumerate(parts, 1)]
    return [(i, n, p, len(p.split())) for i, (n, p) in enumerate(rows)]


BODY = "# Title\nshort\n### early\nstays text\n## A\nthree words here\n### B\n#tag\n#### deep\ntext\n### \n\n## Empty\n## C\n" + "w " * 30 + "\n### D\n" + "\n\n".join("v " * 90 for _ in range(5))


def test_chunks_of_a_tree():
    found = [(n, len(t.split())) for n, t in chunks.sections("T", BODY)]
    assert found == [("T — A — B", 4), ("T — C (intro)", 30), ("T — C — D", 450)]
    assert own_chunks("T", BODY)[-1][1] == "T — C — D (part 5/5)"


def test_chunks_of_all_documents_and_of_odd_bodies(spark, small):
    from deskloom.plans.catalog import CORE

    odd = [(1, "T", BODY), (2, None, None), (3, "T", ""), (4, "T", "word " * 300), (5, "T", "## only"), (6, "T", "### a\n## b\n### c\nx")]
    table = spark.createDataFrame(odd, "doc_id long, title string, body string")
    got = sorted(tuple(r) for r in chunks.chunked(table).collect())
    assert got == [(d, *row) for d, t, b in odd for row in own_chunks(t or "", b or "")]
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    want = []
    for d, r in docs.items():
        spaced = r["text"].replace("\n", "\n\n")
        body = f"{spaced}\n## {r['source']}\n{r['text']}\n### {r['lang']}\n#tag\n#### note\n{spaced}\n## Contact\nWrite to us."
        want += [(d, *row) for row in own_chunks(f"Document {d}", body)]
    assert sorted(tuple(r) for r in CORE.queries["c32_chunks"](spark, small).collect()) == sorted(want)


# word diffs


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


@given(st.lists(st.sampled_from("abcd"), max_size=40), st.lists(st.sampled_from("abcde"), max_size=40))
@settings(max_examples=300, deadline=None)
def test_shared_words_are_a_longest_common_subsequence(a, b):
    found = text.shared_words(a, b)
    assert len(found) == longest(a, b)
    assert all(a[i] == b[j] for i, j in found)
    assert all(x < z and y < w for (x, y), (z, w) in zip(found, found[1:]))


def test_diff_gives_both_texts_back(spark):
    pairs = [("a b c", "a c d"), ("", "x y"), (None, None), ("one  two\nthree", "one four three five"), ("same", "same")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", text.word_diff("a", "b").alias("d")).collect()
    assert json.loads(rows[0]["d"]) == [["equal", "a"], ["removed", "b"], ["equal", "c"], ["added", "d"]]
    for r in rows:
        parts = json.loads(r["d"])
        assert " ".join(w for k, w in parts if k != "added").split() == (r["a"] or "").split()
        assert " ".join(w for k, w in parts if k != "removed").split() == (r["b"] or "").split()


def test_two_long_texts_take_little_memory():
    a, b = [f"w{i * 7919 % 5000}" for i in range(20_000)], [f"w{i * 104729 % 5000}" for i in range(20_000)]
    tracemalloc.start()
    began = time.time()
    assert text.shared_words(a, b)
    assert tracemalloc.get_traced_memory()[1] < 100_000_000 and time.time() - began < 60
    tracemalloc.stop()
