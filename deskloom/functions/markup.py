"""HTML of messages made safe to show: only listed tags, attributes and protocols are left.

One pass over the text, whatever it holds: each character is looked at a bounded number of times.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The tags that stay, their attributes, protocols of links, and images that may be given as data.
TAGS = frozenset("p br div span a ul ol li b strong i em u s blockquote pre code h1 h2 h3 h4 h5 h6 hr table thead tbody tfoot tr td th img".split())
ATTRIBUTES = {"a": {"href", "title", "target", "rel"}, "img": {"src", "alt", "title", "width", "height"}, "td": {"colspan", "rowspan"}, "th": {"colspan", "rowspan"}}
PROTOCOLS = frozenset("http https mailto tel cid".split())
RASTER = re.compile(r"data:image/(png|jpe?g|gif|webp);base64,", re.I)

VOID = frozenset(("br", "hr", "img"))
#: Tags that end an open paragraph, and for tags that end one of their kind: which open elements they end.
BLOCKS = frozenset("p div ul ol blockquote pre h1 h2 h3 h4 h5 h6 hr table".split())
CELLS, ROWS = frozenset(("td", "th", "p")), frozenset(("td", "th", "tr", "p"))
ENDS = {"li": frozenset(("li", "p")), "td": CELLS, "th": CELLS, "tr": ROWS} | {t: ROWS | {"thead", "tbody", "tfoot"} for t in ("thead", "tbody", "tfoot")}

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_GAP = re.compile(r"[\s/]*")
_KEY = re.compile(r"[^\s/>][^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_SCHEME = re.compile(r"([a-z][a-z0-9+.\-]*):")
#: What browsers leave out or pass over before and within a protocol.
_IGNORED = re.compile(r"[\x00-\x20\x7f-\xa0`\s�]+")


def safe_link(tag: str, name: str, value: str) -> bool:
    """Whether a link's value, entities resolved, has a listed protocol or none; data only for raster images."""
    bare = _IGNORED.sub("", value).lower()
    if bare.startswith("data:"):
        return tag == "img" and name == "src" and bool(RASTER.match(value.strip()))
    found = _SCHEME.match(bare)
    return not found or found[1] in PROTOCOLS


def tag_at(text: str, at: int) -> tuple[str, list[tuple[str, str]], int] | None:
    """(name, attributes, end) of the tag whose name begins at at; None if the text ends within it."""
    name = _NAME.match(text, at)
    at, found = name.end(), []
    while True:
        at = _GAP.match(text, at).end()
        if at == len(text):
            return None
        if text[at] == ">":
            return name[0].lower(), found, at + 1
        key = _KEY.match(text, at)
        at, value = key.end(), ""
        if equals := _EQUALS.match(text, at):
            at = equals.end()
            if text[at : at + 1] in ("'", '"'):
                end = text.find(text[at], at + 1)
                if end < 0:
                    return None
                value, at = text[at + 1 : end], end + 1
            else:
                bare = _BARE.match(text, at)
                value, at = bare[0], bare.end()
        found.append((key[0].lower(), html.unescape(value)))


def _written(tag: str, attributes: list[tuple[str, str]]) -> str:
    seen, out = set(), [tag]
    for name, value in attributes:
        if name not in seen and name in ATTRIBUTES.get(tag, ()):
            seen.add(name)
            if safe_link(tag, name, value):
                out.append(f'{name}="{html.escape(value)}"')
    return f"<{' '.join(out)}>"


def clean(text: str | None) -> str | None:
    """HTML with listed tags, attributes and protocols only; None for none.

    Scripts and styles go with their contents, other tags alone, and so do comments and
    declarations. Text is escaped. What is open at the end is closed, and an end tag
    without a start goes. A tag in which the text ends counts as text, as does what
    follows a script or style that isn't closed.
    """
    if not text:
        return None
    out, opened, count, at = [], [], Counter(), 0

    def say(part: str) -> None:
        out.append(html.escape(html.unescape(part), quote=False))

    def close(tag: str) -> None:
        while True:
            last = opened.pop()
            count[last] -= 1
            out.append(f"</{last}>")
            if last == tag:
                return

    while at < len(text):
        start = text.find("<", at)
        if start < 0:
            say(text[at:])
            break
        say(text[at:start])
        after = text[start + 1 : start + 2]
        if after.isascii() and after.isalpha():
            found = tag_at(text, start + 1)
            if not found:
                say(text[start:])
                break
            tag, attributes, at = found
            if tag in ("script", "style"):
                end = re.compile(rf"</{tag}[\s/]*>", re.I).search(text, at)
                if not end:
                    say(text[at:])
                    break
                at = end.end()
            elif tag in TAGS:
                while opened and (tag in BLOCKS and opened[-1] == "p" or opened[-1] in ENDS.get(tag, ())):
                    close(opened[-1])
                out.append(_written(tag, attributes))
                if tag not in VOID:
                    opened.append(tag)
                    count[tag] += 1
        elif after == "/" and text[start + 2 : start + 3].isascii() and text[start + 2 : start + 3].isalpha():
            found = tag_at(text, start + 2)
            if not found:
                say(text[start:])
                break
            tag, _, at = found
            if count[tag]:
                close(tag)
        elif text.startswith("<!--", start):
            end = text.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(text)
        elif after in ("!", "?", "/"):
            end = text.find(">", start + 2)
            at = end + 1 if end >= 0 else len(text)
        else:
            out.append("&lt;")
            at = start + 1
    out += [f"</{t}>" for t in reversed(opened)]
    return "".join(out)


@F.pandas_udf(T.StringType())
def sanitised(texts: pd.Series) -> pd.Series:
    """HTML made safe to show, as clean gives it; null and empty texts give null."""
    return texts.map(clean, na_action="ignore")
