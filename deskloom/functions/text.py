"""Text functions, as Column to Column."""

from __future__ import annotations

import datetime as dt
import json
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskloom.functions.vocabulary import NO_REFERENCE, OUTCOMES, RANKING_STOP_WORDS

#: Language for the desk's staff that a reply must not hold.
LEAKS = (
    r"(?i)(?:do(?:es)?\s+not|doesn'?t|don'?t)\s+(?:specify|state|address|cover|mention)|not\s+specified",
    r"(?i)\bwe\s+(?:will|'ll)\s+(?:look\s+into|check|verify|confirm|investigate|follow\s+up)",
    r"(?i)\b(?:cannot|can'?t|unable\s+to)\s+(?:confirm|verify|determine)\b",
    r"(?i)\bpolicy\s+(?:context|information|text)\b",
)
#: Patterns of placeholders, policy keys, links and addresses.
PLACEHOLDER = r"\[CHAIR:\s*([^\]]*)\]"
POLICY_KEY = r"policy_\d+|int_[a-z0-9-]+"
FORUM_ID = r"(?i:openreview\.net/(?:forum|pdf)\?id=)([A-Za-z0-9]{10})(?![A-Za-z0-9])"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
LINK = r"https?://\S+"
#: Lines that begin a quoted tail.
TAILS = ("-----Original Message-----", "________________________________", "\nFrom: ", "\nSent from my ")


def ranking_tokens(text: Column) -> Column:
    """Lower-cased words at white space, punctuation kept, without the stop words of rankings."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+")
    return F.filter(words, lambda x: (x != "") & ~x.isin(*RANKING_STOP_WORDS))


def leaf_title(title: Column) -> Column:
    """What follows the first dash between sections; the whole title without one."""
    return F.regexp_replace(title, r"^(?s:.*?) — ", "")


def placeholders(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PLACEHOLDER), F.lit(1)), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))


def leaks(text: Column) -> Column:
    """All leaks, pattern by pattern."""
    return F.flatten(F.array(*(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(0)) for p in LEAKS)))


def citations(text: Column) -> Column:
    """Policy keys, each once, as they come."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(POLICY_KEY), F.lit(0)))


def forum_ids(text: Column) -> Column:
    """Forum ids of ten characters, each once; longer ones aren't cut."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(FORUM_ID), F.lit(1)))


def sanitised(reply: Column, sender: str) -> Column:
    """A reply without scaffold headers and policy keys, its sender's name filled in, its spacing tidied."""
    out = F.regexp_replace(reply, r"(?i)^\s*(?:draft\s+reply|reply|draft)\s*:\s*\n+", "")
    out = F.regexp_replace(out, rf"\s*\((?:see\s+)?(?:{POLICY_KEY})(?:\s*,\s*(?:{POLICY_KEY}))*\)|\b(?:{POLICY_KEY})\b", "")
    out = F.regexp_replace(out, r"(?i)\[\s*sender[\s_]?name\s*\]", sender.replace("\\", "\\\\").replace("$", "\\$"))
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]+([.,;:!?])", "$1"), r"[ \t]{2,}", " ")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def rating(text: Column) -> Column:
    """The first number of a text within 0 to 1, or null."""
    number = F.regexp_extract(text, r"[-+]?\d*\.?\d+", 0).try_cast("double")
    return F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))


def sections(text: Column) -> Column:
    """Reply, citations, notes and confidence of a structured answer; unstructured text is all reply."""
    head = lambda name: rf"===\s*{name}\s*==="
    whole = rf"(?is){head('REPLY')}\s*(.*?)\s*{head('CITATIONS')}\s*(.*?)\s*{head(r'NOTES\s+FOR\s+CHAIR')}\s*(.*?)(?:\s*{head('CONFIDENCE')}\s*(.*))?\z"
    part = lambda i: F.regexp_extract(text, whole, i)
    notes = F.regexp_replace(part(3), r"^\s+|\s+$", "")
    return F.when(
        text.rlike(whole),
        F.struct(
            part(1).alias("reply"),
            citations(part(2)).alias("citations"),
            F.when(~F.lower(notes).isin("", "none", "n/a", "none."), notes).alias("notes"),
            rating(part(4)).alias("confidence"),
        ),
    ).otherwise(F.struct(text.alias("reply"), citations(text).alias("citations"), F.lit(None).cast("string").alias("notes"), F.lit(None).cast("double").alias("confidence")))


def people(lines: Column) -> Column:
    """Name, email and affiliation from lines of name|email|affiliation; NONE and blanks are null, surplus parts belong to the last, empty lines go."""

    def one(line: Column) -> Column:
        parts = F.split(line, r"\|", 3)
        field = lambda i: F.trim(F.get(parts, F.lit(i)))
        clean = lambda x: F.when(~F.upper(x).isin("", "NONE"), x)
        return F.struct(clean(field(0)).alias("name"), clean(field(1)).alias("email"), clean(field(2)).alias("affiliation"))

    return F.filter(F.transform(F.split(lines, "\n"), one), lambda p: p["name"].isNotNull() | p["email"].isNotNull() | p["affiliation"].isNotNull())


def labelled_lines(text: Column, label: str) -> Column:
    """The values of all lines label: value, without NONE and blanks; null if there is no such line."""
    values = F.transform(F.regexp_extract_all(text, F.lit(rf"(?im)^[ \t]*{label}:[ \t]*(.*)$"), F.lit(1)), lambda x: F.trim(x))
    return F.when(F.size(values) > 0, F.filter(values, lambda x: ~F.upper(x).isin("", "NONE")))


def scrubbed(text: Column) -> Column:
    """E-mail addresses, links and long numbers as tokens, white space squeezed, 300 characters at most."""
    out = F.regexp_replace(F.regexp_replace(text, EMAIL, "[email]"), LINK, "[url]")
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(out, r"\d{4,}", "[num]"), r"\s+", " ")), 1, 300)


def template_key(text: Column) -> Column:
    """A text with what differs between letters of one template as tokens."""
    out = F.regexp_replace(F.regexp_replace(F.lower(text), r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}", "<email>"), LINK, "<url>")
    out = F.regexp_replace(F.regexp_replace(out, r"(?m)^(?:dear|hi|hello)\b[^\n,]*,", "<greeting>"), r"\d+", "<n>")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def without_tail(text: Column, tails: tuple[str, ...] = TAILS) -> Column:
    """The text before the first of the markers of a quoted tail."""
    at = F.least(*(F.when(F.locate(t, text) > 0, F.locate(t, text)) for t in tails), F.length(text) + 1)
    return F.substring(text, F.lit(1), at - 1)


def clean_body(text: Column, most: int = 2000) -> Column:
    """Without quoted tail and quoted lines, blank runs squeezed, cut to most characters."""
    lines = F.filter(F.split(without_tail(text), "\n"), lambda x: ~x.startswith(">"))
    squeezed = F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.substring(F.regexp_replace(squeezed, r"^\s+|\s+$", ""), 1, most)


def paragraphs(text: Column) -> Column:
    """Plain text as HTML: two line ends part paragraphs, single ones are breaks, special characters and quotes are escaped; one empty paragraph for no text."""
    safe = F.coalesce(text, F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        safe = F.replace(safe, F.lit(char), F.lit(entity))
    parts = F.split(F.regexp_replace(safe, r"(?U)^\s+|\s+$", ""), "\n\n")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.lit("<p>"), F.replace(p, F.lit("\n"), F.lit("<br>")), F.lit("</p>"))), "")


def stripped_html(html: Column) -> Column:
    """A preview of HTML: no scripts, styles and tags, white space squeezed."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(?:script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"(?s)<[^>]*>", " "), r"\s+", " "))


def fingerprint(chunks: Column) -> Column:
    """SHA-1 of the canonical JSON of sorted (id, sorted intents); order doesn't matter."""
    rows = F.array_sort(F.transform(chunks, lambda c: F.struct(c["id"].alias("id"), F.array_sort(c["intents"]).alias("intents"))))
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    text = F.transform(rows, lambda r: F.concat(F.lit("["), quoted(r["id"]), F.lit(", ["), F.array_join(F.transform(r["intents"], quoted), ", "), F.lit("]]")))
    return F.sha1(F.concat(F.lit("["), F.array_join(text, ", "), F.lit("]")))


def moment(text: Column) -> Column:
    """ISO time to a UTC timestamp: naive times are UTC, bad ones null."""
    return F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), text))


def last_place_on_earth(at: Column) -> Column:
    """The time at UTC-12, to the minute."""
    return F.concat(F.date_format(at - F.expr("INTERVAL 12 HOURS"), "yyyy-MM-dd HH:mm"), F.lit(" AoE"))


def cycle(year: Column, cycles: dict[int, str]) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in cycles.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, year.cast("int")), F.lit("other"))


def query_text(distilled: Column, subject: Column, body: Column) -> Column:
    """The first that there is: distilled lines joined, else subject and the body's first 600 characters."""
    return F.coalesce(F.when(F.size(distilled) > 0, F.array_join(distilled, " ")), F.trim(F.concat_ws(" ", subject, F.substring(body, 1, 600))))


def json_slice(text: Column) -> Column:
    """The JSON between the first { and the last }, as a variant; null if it isn't JSON."""
    return F.try_parse_json(F.regexp_extract(text, r"(?s)\{.*\}", 0))


def model_record(record: Column) -> Column:
    """The five fields of a mined thread, from a variant that holds an object; null if it doesn't.

    Texts are trimmed and anything else counts as empty. Lists may be given as one
    text and keep their texts that aren't empty; references without any are null. An
    outcome that isn't of the vocabulary is its last one.
    """
    part = lambda name: F.try_variant_get(record, f"$.{name}", "variant")
    is_text = lambda v: F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))
    said = lambda v: F.when(is_text(v), F.regexp_replace(F.try_variant_get(v, "$", "string"), r"(?U)^\s+|\s+$", "")).otherwise(F.lit(""))
    none = F.array().cast("array<string>")

    def texts(name: str) -> Column:
        v = part(name)
        several = F.transform(F.try_variant_get(v, "$", "array<variant>"), said)
        return F.filter(F.coalesce(F.when(is_text(v), F.array(said(v))).otherwise(several), none), lambda t: t != "")

    used = F.filter(texts("policy_or_reference_used"), lambda t: ~F.lower(t).isin(*NO_REFERENCE))
    outcome = F.lower(said(part("outcome_type")))
    fields = F.struct(
        said(part("what_was_asked")).alias("what_was_asked"),
        texts("steps_taken").alias("steps_taken"),
        said(part("resolution")).alias("resolution"),
        F.when(F.size(used) > 0, used).alias("policy_or_reference_used"),
        F.when(outcome.isin(*OUTCOMES), outcome).otherwise(F.lit(OUTCOMES[-1])).alias("outcome_type"),
    )
    return F.when(F.schema_of_variant(record).startswith("OBJECT"), fields)


def spoken(snippets: Column, source: Column) -> Column:
    """Those snippets that the source holds."""
    return F.filter(snippets, lambda s: source.contains(s))


def constrained(label: Column, vocabulary: tuple[str, ...], fallback: str) -> Column:
    """A label of the vocabulary, whatever its case, else the fallback; and whether it is the fallback."""
    lower = F.create_map(*(F.lit(x) for v in vocabulary for x in (v.lower(), v)))
    found = F.when(label.isin(*vocabulary), label).otherwise(F.try_element_at(lower, F.lower(F.trim(label))))
    return F.struct(F.coalesce(found, F.lit(fallback)).alias("label"), (F.coalesce(found, F.lit(fallback)) == fallback).alias("is_fallback"))


def known_labels(labels: Column, vocabulary: tuple[str, ...]) -> Column:
    return F.array_distinct(F.filter(labels, lambda x: x.isin(*vocabulary)))


def display_label(name: Column) -> Column:
    """snake_case as a label: only the first letter is a capital."""
    spaced = F.replace(name, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, F.lit(2), F.length(spaced)))


def initials(name: Column) -> Column:
    """The first letters of the first and last word."""
    words = F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != "")
    first = lambda w: F.upper(F.substring(w, 1, 1))
    return F.when(F.size(words) == 0, "").when(F.size(words) == 1, first(F.get(words, F.lit(0)))).otherwise(F.concat(first(F.get(words, F.lit(0))), first(F.element_at(words, -1))))


def age_label(at: Column, now: dt.datetime) -> Column:
    minutes = F.floor((F.unix_timestamp(F.lit(now)) - F.unix_timestamp(at.cast("timestamp"))) / 60)
    return F.when(minutes < 1, "just now").when(minutes < 60, F.format_string("%dm ago", minutes)).when(minutes < 1440, F.format_string("%dh ago", F.floor(minutes / 60))).otherwise(F.format_string("%dd ago", F.floor(minutes / 1440)))


#: Sequences from which on frequent elements begin no block, and the share that makes them so.
LONG, FREQUENT = 200, 100


def matching(a: Sequence, b: Sequence) -> int:
    """How many elements two sequences share in matching blocks: the longest block, the first in a and then in b, and so on left and right of it.

    In a b of LONG elements or more, those that make up over 1 / FREQUENT of it don't
    begin blocks, and only extend them. Blocks grow for all places of an element in b at once.
    """
    known: dict = {}
    x, y = (np.array([known.setdefault(e, len(known)) for e in side], np.int64) for side in (a, b))
    order = np.argsort(y, kind="stable")
    starts = np.searchsorted(y[order], np.arange(len(known) + 1))
    usual = np.diff(starts) > (len(y) // FREQUENT + 1 if len(y) >= LONG else len(y))
    places = [order[:0] if skip else order[low:high] for skip, low, high in zip(usual, starts, starts[1:])]
    ends = np.zeros(len(y) + 1, np.int64)  # the block that ends before each place of b, in the row at hand
    shared, todo = 0, [(0, len(x), 0, len(y))]
    while todo:
        top, bottom, left, right = todo.pop()
        size, row, column, seen = 0, top, left, order[:0]
        for i in range(top, bottom):
            at = places[x[i]]
            if left or right < len(y):
                at = at[np.searchsorted(at, left) : np.searchsorted(at, right)]
            grown = ends[at] + 1
            ends[seen + 1] = 0
            seen = at
            if len(at):
                ends[at + 1] = grown
                best = int(grown.argmax())
                if grown[best] > size:
                    size = int(grown[best])
                    row, column = i + 1 - size, int(at[best]) + 1 - size
        ends[seen + 1] = 0
        while row > top and column > left and x[row - 1] == y[column - 1]:
            row, column, size = row - 1, column - 1, size + 1
        while row + size < bottom and column + size < right and x[row + size] == y[column + size]:
            size += 1
        if size:
            shared += size
            todo += [p for p in ((top, row, left, column), (row + size, bottom, column + size, right)) if p[0] < p[1] and p[2] < p[3]]
    return shared


def matching_ratio(a: Sequence, b: Sequence) -> float:
    """Twice the elements in matching blocks by all elements; 1 if there are none."""
    return 2.0 * matching(a, b) / (len(a) + len(b)) if len(a) + len(b) else 1.0


def alike(a: str, b: str, least: float) -> bool:
    """Whether matching_ratio is least or more. Lengths, then the characters in any order, rule most pairs out before blocks are sought."""
    total = len(a) + len(b)
    if 2.0 * min(len(a), len(b)) < least * total or 2.0 * (Counter(a) & Counter(b)).total() < least * total:
        return False
    return matching_ratio(a, b) >= least


@F.pandas_udf(T.DoubleType())
def edit_ratio(before: pd.Series, after: pd.Series) -> pd.Series:
    """1 - the similarity of two texts' words by matching blocks; 0 if both are empty. Null counts as empty."""
    return pd.Series([1.0 - matching_ratio((a or "").split(), (b or "").split()) for a, b in zip(before, after)])


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """The similarity of two lower-cased texts' characters by matching blocks. Null counts as empty."""
    return pd.Series([matching_ratio((x or "").lower(), (y or "").lower()) for x, y in zip(a, b)])


def _shared_counts(a: list[str], b: list[str]) -> np.ndarray:
    """How many words a has in common, in order, with each beginning of b: a row of bits for b is moved on word by word of a."""
    places: dict[str, int] = {}
    for j, word in enumerate(b):
        places[word] = places.get(word, 0) | 1 << j
    row = whole = (1 << len(b)) - 1
    for word in a:
        met = row & places.get(word, 0)
        row = (row + met | row - met) & whole
    bits = np.unpackbits(np.frombuffer(row.to_bytes(-(-len(b) // 8), "little"), np.uint8), bitorder="little")[: len(b)]
    return np.r_[0, np.cumsum(bits == 0)]


def shared_words(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence in both, in linear space: a is halved, and b cut where the halves share most."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        low, high, left, right = todo.pop()
        while low < high and left < right and a[low] == b[left]:
            out.append((low, left))
            low, left = low + 1, left + 1
        while low < high and left < right and a[high - 1] == b[right - 1]:
            high, right = high - 1, right - 1
            out.append((high, right))
        if low == high or left == right:
            continue
        if high - low == 1:
            if a[low] in b[left:right]:
                out.append((low, b.index(a[low], left, right)))
            continue
        middle = (low + high) // 2
        ahead, back = _shared_counts(a[low:middle], b[left:right]), _shared_counts(a[middle:high][::-1], b[left:right][::-1])
        cut = left + int((ahead + back[::-1]).argmax())
        todo += [(low, middle, left, cut), (middle, high, cut, right)]
    return sorted(out)


@F.arrow_udf(T.StringType())
def word_diff(before: pa.Array, after: pa.Array) -> pa.Array:
    """A JSON list of [kind, words]: what two texts share, and what was removed and added, by a longest common subsequence of their words. Null counts as empty."""

    def one(a, b):
        a, b = (a or "").split(), (b or "").split()
        out: list[tuple[str, list[str]]] = []
        i = j = 0
        for x, y in [*shared_words(a, b), (len(a), len(b))]:
            for kind, words in (("removed", a[i:x]), ("added", b[j:y]), ("equal", a[x : x + 1])):
                if words and out and out[-1][0] == kind:
                    out[-1][1].extend(words)
                elif words:
                    out.append((kind, words))
            i, j = x + 1, y + 1
        return json.dumps([[kind, " ".join(words)] for kind, words in out], ensure_ascii=False)

    # texts become Python's one pair at a time
    return pa.array((one(a.as_py(), b.as_py()) for a, b in zip(before, after)), pa.string(), size=len(before))


#: White space; a submission's number after its cue, with one word between at most, and after #; a conference before it; years.
SPACE = r"[\s\x1c-\x1f]"
CUED = rf"(?iuU)(?<![A-Za-z0-9])(?:paper|submission)s?(?:{SPACE}*(?:id|no\.?|number))?((?:{SPACE}*[A-Za-z][A-Za-z.\-]{{0,11}})?){SPACE}*[#:\-]?{SPACE}*(\d{{4,5}})(?!\d)"
HASHED = r"(?U)(?<![\p{L}\p{N}_/])#(\d{4,5})(?!\d)"
CONFERENCE = rf"(?iuU)(?:AAAI|IAAI|EAAI)(?:-|{SPACE}){{0,36}}\d{{4,5}}$"
YEARS = r"^20(2\d|3[0-5])$"


def _numbers_in(text: Column) -> Column:
    """A text's submission numbers, cued before hashed. Years after another word and numbers after a conference aren't any."""
    found = [F.regexp_extract_all(text, F.lit(CUED), F.lit(i)) for i in range(3)]
    hits = F.zip_with(F.zip_with(found[0], found[1], lambda hit, word: F.struct(hit.alias("hit"), word.alias("word"))), found[2], lambda h, n: F.struct(h["hit"].alias("hit"), h["word"].alias("word"), n.alias("number")))
    fine = F.filter(hits, lambda h: ~h["hit"].rlike(CONFERENCE) & ~((h["word"] != "") & h["number"].rlike(YEARS)))
    return F.concat(F.transform(fine, lambda h: h["number"]), F.regexp_extract_all(text, F.lit(HASHED), F.lit(1)))


def submission_numbers(subject: Column | str, body: Column | str) -> Column:
    """Submission numbers, each once: subject before body, cued before hashed."""
    return F.array_distinct(F.concat(*(_numbers_in(F.coalesce(t, F.lit(""))) for t in (subject, body))))
