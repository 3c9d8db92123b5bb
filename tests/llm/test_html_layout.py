"""Pages made together with the text that they must give, broken markup, and its cost."""

from __future__ import annotations

import random
import time

import pytest

from deskloom.llm.html_text import tokens, visible_text

WORDS = "alpha beta gamma delta 漢字 é x1 naïve & <b".split(" ")


def said(rng):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 4)))


def written(text):
    return text.replace("&", "&amp;").replace("<", "&lt;")


def columns(text):
    return sum(2 if c in "漢字" else 1 for c in text)


def together(blocks):
    """Blocks (lines, blank lines around) one below the other."""
    out, due = [], 0
    for lines, blank in blocks:
        if lines:
            out += [""] * max(due, blank) * bool(out) + lines
            due = blank
    return out


def marked(mark, lines):
    return [(mark if not i else " " * len(mark)) + x if x else x for i, x in enumerate(lines)]


def made(rng, depth):
    """(html, block) of one random block."""
    kind = rng.choice(["p", "div", "h2", "pre", "table"] + (["ul", "ol", "blockquote"] * 2 if depth else []))
    if kind in ("p", "div", "h2"):
        text = said(rng)
        return f"<{kind} class=a>{written(text)}" + (f"</{kind}>" if kind != "p" or rng.random() < 0.5 else ""), ([text], int(kind != "div"))
    if kind == "pre":
        lines = [said(rng), "  two   spaces", said(rng)]
        return f"<pre>{written(chr(10).join(lines))}</pre>", (lines, 1)
    if kind == "table":
        cells = [[said(rng) for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 3))]
        wide = [max(columns(r[i]) for r in cells if len(r) > i) for i in range(max(map(len, cells)))]
        lines = ["  ".join(c + " " * (w - columns(c)) for c, w in zip(r, wide)).rstrip() for r in cells]
        return "<table>" + "".join("<tr>" + "".join(f"<td>{written(c)}" for c in r) for r in cells) + "</table>", (lines, 1)
    parts, lines, number = [], [], rng.choice([1, 1, -3, 12])
    if kind == "blockquote":
        inner = [made(rng, depth - 1) for _ in range(rng.randint(1, 3))]
        return f"<blockquote>{''.join(h for h, _ in inner)}</blockquote>", (marked("  ", together(b for _, b in inner)), 1)
    for i in range(rng.randint(1, 3)):
        first, inner = said(rng), [made(rng, depth - 1) for _ in range(rng.randint(0, 2))]
        parts.append(f"<li>{written(first)}{''.join(h for h, _ in inner)}" + ("</li>" if inner else ""))
        lines += marked(f"{number + i}. " if kind == "ol" else "- ", together([([first], 0), *(b for _, b in inner)]))
    start = f" start={number}" if kind == "ol" and number != 1 else ""
    return f"<{kind}{start}>{''.join(parts)}</{kind}>", (lines, 1)


@pytest.mark.parametrize("seed", range(10))
def test_pages_made_with_their_text(seed):
    rng = random.Random(seed)
    for _ in range(50):
        blocks = [made(rng, 3) for _ in range(rng.randint(1, 5))]
        page = "<html><head><title>no</title><style>no</style></head><body><!-- no --><script>no</script>" + "<span hidden>no</span>".join(h for h, _ in blocks)
        assert visible_text(page) == "\n".join(x.rstrip() for x in together(b for _, b in blocks)), page


@pytest.mark.parametrize(
    "page, text",
    [
        ('<ol start="²"><li>a</ol>', "1. a"),
        ('<table><tr><td colspan="³">a<td>b</table>', "a  b"),
        ("<![foo[ x ]]>b<![CDATA[ y ]]>c", "bc"),
        ("a<!-->b<!--->c<!-- d --!> e -->f<!-- g", "abcf"),
        ("a </>b</ x>c<?php d ?>e < f <3", "a bce < f <3"),
        ("a<b title='x>y' hidden>no</b>c<i hidden", "ac"),
        ("<textarea>a &amp; <b></textarea>c<xmp>&amp;</xmp>", "a & <b>c&amp;"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
        ("<table><tr><td>漢字<td>b<tr><td>abcd<td>c</table>", "漢字  b\nabcd  c"),
        ("<table><tr><td colspan=1000>a<tr><td>b<td>c</table>", "a\nb  c"),
        ("<pre><ul><li>a  b</ul></pre>", "- a  b"),
        ('<ol start="-3" reversed><li>a<li>b<li value=7>c<li>d</ol>', "-3. a\n-4. b\n7. c\n6. d"),
        ("<ol reversed><li>a<li>b</ol>", "2. a\n1. b"),
        ('<p style="display:none;display:block">a<p style="--display:none">b<p style="display:none !important;display:block">c', "a\n\nb"),
        ('<div style="visibility:hidden">a<b style="visibility:visible">b</b><i style="visibility:inherit">c</i></div>', "b"),
        ("<ul><li><li>a<li><ul><li>b</ul></ul>", "- a\n- - b"),
        ("<b class=x class=y hidden>no</b>yes", "yes"),
        (None, ""),
        ("", ""),
    ],
)
def test_odd_markup(page, text):
    assert visible_text(page) == text


def test_the_first_of_equal_attributes_counts():
    assert list(tokens("<a b=1 B=2 c>")) == [("start", "a", {"b": "1", "c": ""})]


@pytest.mark.parametrize("piece", ["<a ", "<a b=\"", "<!--", "<!x", "</", "<ul><li>", "<ul><li>a", "<blockquote>b ", "<table><tr><td>", "<td colspan=1000 rowspan=9>x", "<script>", "&", "<p>", "<div style='display:"])
def test_a_megabyte_of_it_takes_seconds(piece):
    began = time.time()
    visible_text(piece * (1_000_000 // len(piece)))
    assert time.time() - began < 8
