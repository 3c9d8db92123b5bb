"""Markdown bodies in chunks, as a table function: packing is greedy, and so goes paragraph by paragraph."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a chunk that stays whole and of a part, the least words of an intro, and the dash between titles.
MOST, TARGET, INTRO, DASH = 220, 170, 25, " — "
#: Headings that part a body; deeper ones, the title and tags are text.
SECTION, SUBSECTION = "## ", "### "


def sections(title: str, body: str) -> Iterator[tuple[str, str]]:
    """(title, text) of each section and subsection, under the titles that it lies in; intros only of INTRO words or more.

    A subsection's heading before the first section is text.
    """
    names, lines, split = [title], [], False

    def text() -> str:
        return "\n".join(lines).strip()

    def ended() -> Iterator[tuple[str, str]]:
        if len(names) == 1:
            if len(text().split()) >= INTRO:
                yield f"{title}{DASH}Overview", text()
        elif len(names) == 3 or not split:
            if text():
                yield DASH.join(names), text()
        elif len(text().split()) >= INTRO:
            yield f"{DASH.join(names)} (intro)", text()

    for line in body.split("\n"):
        depth = 2 if line.startswith(SECTION) else 3 if line.startswith(SUBSECTION) and len(names) > 1 else 0
        if not depth:
            lines.append(line)
            continue
        split = depth == 3
        yield from ended()
        names, lines = [*names[: depth - 1], line.lstrip("# ").strip()], []
        split = False
    yield from ended()


def pack(text: str, most: int = MOST, target: int = TARGET) -> list[str]:
    """Paragraphs packed up to target words; a text of most words at most stays whole."""
    if len(text.split()) <= most:
        return [text]
    out, held, words = [], [], 0
    for part in (p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()):
        n = len(part.split())
        if words and words + n > target:
            out.append("\n\n".join(held))
            held, words = [], 0
        held.append(part)
        words += n
    return [*out, "\n\n".join(held)] if held else out


@F.udtf(returnType="place int, title string, chunk string, words int")
class Chunks:
    def eval(self, title: str, body: str):
        place = 0
        for name, text in sections(title or "", body or ""):
            parts = pack(text)
            for i, chunk in enumerate(parts, 1):
                yield place, f"{name} (part {i}/{len(parts)})" if len(parts) > 1 else name, chunk, len(chunk.split())
                place += 1


def chunked(docs: DataFrame, key: str = "doc_id", title: str = "title", body: str = "body") -> DataFrame:
    """(key, place, title, chunk, words) for every chunk of every document: whole sections, or their parts where they are long."""
    spark = docs.sparkSession
    spark.udtf.register("deskloom_chunks", Chunks)
    return spark.sql(f"SELECT d.`{key}` AS `{key}`, c.* FROM {{docs}} d, LATERAL deskloom_chunks(d.`{title}`, d.`{body}`) c", docs=docs)
