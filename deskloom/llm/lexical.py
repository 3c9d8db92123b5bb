"""Ranked lexical search by sort-based accumulation.

One pass over the texts keeps, of each document, its length and how often it has
each term that some item asks (postings by document, written once). Frequencies of
terms and the corpus' size follow from that table. Then each task takes the
documents of its range, a bounded number of matches at a time: it concatenates
arrays of (item, document, impact) for all matches, sorts the packed pairs of item
and document by radix, and adds up equal neighbours. Each item's best scores stay
in a heap of k, so a task sends k rows an item at most, whatever it has read, and
these meet in two steps.

Items are dealt with in blocks of a bounded number of terms, which are what tasks
are sent; further blocks read the texts again.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deskloom.llm.shared import stored

#: Percentages of a document's length in its norm, and the scales of weights and of saturated frequencies.
SLOPE, WEIGHT, IMPACT = 75, 1000, 1_000_000_000
#: Different terms of all items of a block together, counted once an item, and matches that a task sorts at once.
BLOCK, MATCHES = 500_000, 1 << 21
#: Ranges into which an item's candidates are dealt before its k best of all are taken.
RANGES = 64

#: Letters and digits, A-Z lower-cased and all beyond ASCII as it is, and a space for every other byte of UTF-8.
_BYTES = bytes(ord(c.lower()) if (c := chr(b)).isascii() and c.isalnum() else b if b > 0x7F else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8: maximal runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased."""
    return text.translate(_BYTES).split()


def _texts(column: pa.Array) -> Iterator[bytes]:
    for value in column.cast(pa.binary()):
        yield value.as_py() or b""


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, term, times), terms as UTF-8. Rows of one item_id are one item; those without are left out, as are items without terms."""

    def run(batches):
        for batch in batches:
            ids, names, n = [], [], []
            for item, found in zip(batch.column(0), _texts(batch.column(1))):
                counts = Counter(terms(found))
                ids += [item] * len(counts)
                names += counts.keys()
                n += counts.values()
            yield pa.RecordBatch.from_arrays([pa.array([i.as_py() for i in ids], batch.column(0).type), pa.array(names, pa.binary()), pa.array(n, pa.int64())], names=["item_id", "term", "times"])

    kind = items.schema[key].dataType.simpleString()
    rows = items.where(F.col(key).isNotNull()).select(F.col(key).alias("item_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"item_id {kind}, term binary, times long").groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def postings(docs: DataFrame, asked: dict[bytes, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, terms, tf): of every document that has a term, its number of terms, and the asked ones by number with their frequencies."""
    shared = docs.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        number = shared.value
        for batch in batches:
            rows, n, at, tf, ends = [], [], [], [], [0]
            for i, found in enumerate(map(terms, _texts(batch.column(1)))):
                if found:
                    counts = Counter(found)
                    has = counts.keys() & number.keys()
                    rows.append(i)
                    n.append(len(found))
                    at += [number[t] for t in has]
                    tf += [counts[t] for t in has]
                    ends.append(len(at))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind)) for x, kind in ((at, pa.int32()), (tf, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tf"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, tf array<long>")


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order that sorts whole numbers from 0 on, stably, by digits of 16 bits from the last to the first."""
    order, most = np.arange(len(keys)), int(keys.max(initial=0))
    for shift in range(0, most.bit_length(), 16):
        digit = (keys[order] >> shift & 0xFFFF).astype(np.uint16)
        order = order[np.argsort(digit, kind="stable")]  # numpy sorts 16 bits by radix
    return order


def summed(items: np.ndarray, docs: np.ndarray, impacts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different pairs of item and document, ascending, with their impacts' sums."""
    wide = int(docs.max(initial=0)).bit_length()
    keys = items.astype(np.int64) << wide | docs
    order = radix_order(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[starts] >> wide, keys[starts] & ((1 << wide) - 1), np.add.reduceat(impacts[order], starts) if len(starts) else impacts


def _ranges(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to most at most, or of one row."""
    low, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield low, i
            low, total = i, 0
        total += int(size)
    if low < len(sizes):
        yield low, len(sizes)


class _Later:
    """A value that orders the other way round: the heap's first entry has the lowest score, and of equal ones the largest id."""

    __slots__ = ("value",)

    def __init__(self, value):
        self.value = value

    def __lt__(self, other: _Later) -> bool:
        return other.value < self.value


def _frequencies(n_terms: int):
    """A task's (term, df)."""

    def run(batches):
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(), minlength=n_terms)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(df[some])], names=["term", "df"])

    return run


def _ranked(k: int, shared, n_docs: int, n_terms: int, kind: pa.DataType):
    """A task's k best documents of each item.

    shared: the terms' weights, starts, asking, times: term t is asked by the items
    asking[starts[t]:starts[t + 1]], so many times each.
    """

    def run(batches):
        weights, starts, asking, times, ids = shared.value
        heaps: dict[int, list] = {}
        for batch in batches:
            names, n, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(), batch.column(2)
            ends = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
            at, tf = lists.flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            doc = np.repeat(np.arange(len(n)), np.diff(ends))
            m = 100 - SLOPE + SLOPE * n * n_docs // n_terms
            impact, fan = weights[at] * (IMPACT * tf // (1000 * tf + 8 * m[doc])), starts[at + 1] - starts[at]
            for low, high in _ranges(np.bincount(doc, weights=fan, minlength=len(n)).astype(np.int64), MATCHES):
                some = slice(ends[low], ends[high])
                f = fan[some]
                place = np.arange(f.sum()) - np.repeat(np.cumsum(f) - f - starts[at[some]], f)
                item, where, score = summed(asking[place], np.repeat(doc[some] - low, f), times[place] * np.repeat(impact[some], f))
                cuts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if len(item) else np.empty(0, np.int64)
                for a, b in zip(cuts, np.r_[cuts[1:], len(item)]):
                    heap = heaps.setdefault(int(item[a]), [])
                    least = max(1, heap[0][0] if len(heap) == k else 1, np.partition(score[a:b], -k)[-k] if b - a > k else 1)
                    pick = a + np.flatnonzero(score[a:b] >= least)
                    pick = pick[np.argsort(names[low + where[pick]], kind="stable")]
                    for j in pick[np.argsort(-score[pick], kind="stable")][:k]:
                        entry = (int(score[j]), _Later(names[low + where[j]]))
                        heapq.heappush(heap, entry) if len(heap) < k else heapq.heappushpop(heap, entry)
        rows = [(ids[i], e[1].value, e[0]) for i, heap in heaps.items() for e in heap]
        if rows:
            item, doc, score = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(item, kind), pa.array(np.array(doc)), pa.array(score, pa.int64())], names=["item_id", "doc_id", "score"])

    return run


def _searched(block: DataFrame, docs: DataFrame, k: int, key: str, text: str) -> DataFrame:
    """The ranking of a block's items; its terms are what the driver and the tasks hold."""
    spark, kinds = docs.sparkSession, {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    table = block.toArrow().combine_chunks()
    ids, item = np.unique(table.column("item_id").to_numpy(zero_copy_only=False), return_inverse=True)
    names = table.column("term").to_pylist()
    number = {t: i for i, t in enumerate(sorted(set(names)))}
    at = np.array([number[t] for t in names], np.int64)
    order = np.lexsort((item, at))
    starts = np.searchsorted(at[order], np.arange(len(number) + 1))
    posts = stored(postings(docs, number, key, text), "postings")
    n_docs, n_terms = posts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = posts.select("terms").mapInArrow(_frequencies(len(number)), "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weights = np.zeros(len(number), np.int64)
    for r in df.collect():
        weights[r["term"]] = math.floor(WEIGHT * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
    shared = spark.sparkContext.broadcast((weights, starts, item[order], table.column("times").to_numpy()[order], ids.tolist()))
    schema = f"item_id {block.schema['item_id'].dataType.simpleString()}, doc_id {kinds[key]}, score long"
    return posts.where("doc_id IS NOT NULL").mapInArrow(_ranked(k, shared, n_docs, n_terms, table.schema.field("item_id").type), schema)


def lexical_search(items: DataFrame, docs: DataFrame, k: int = 10, item_key: str = "item_id", key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents of the highest score above 0, ties to the smaller doc_id; all, if fewer.

    Every document counts in the corpus' statistics; those without doc_id aren't
    ranked, and rows that repeat a doc_id are documents each. Rows of one item_id are
    one item, their terms together; items without item_id or without terms have no
    rows, nor do null or empty texts on either side. Of empty tables the result is
    empty. Other columns don't matter, whatever their names. Ids are numbers or strings.

    block: terms of the items that are dealt with at once, each counted once an item; an
    item isn't divided, so the bound is that or the terms of one item.
    """
    asked = stored(item_terms(items, item_key, text), "asked")
    blocks = max(1, -(-asked.count() // block))
    found = None
    for i in range(blocks):
        part = _searched(asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i), docs, k, key, text)
        found = part if found is None else found.unionByName(part)
    best = lambda *by: F.row_number().over(W.partitionBy("item_id", *by).orderBy(F.desc("score"), "doc_id"))
    some = found.withColumn("range", F.pmod(F.xxhash64("doc_id"), F.lit(RANGES))).withColumn("rank", best("range")).where(F.col("rank") <= k)
    return some.withColumn("rank", best()).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOUND = rf"unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"
ORACLE = rf"""
WITH d AS (SELECT doc_id, {_FOUND} FROM documents), n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1), c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {_FOUND} FROM benchmark) GROUP BY ALL),
s AS (
  SELECT item_id, doc_id, CAST(sum(times * CAST(floor({WEIGHT} * ln((2.0::DOUBLE * docs + 2) / (2 * df + 1))) AS BIGINT) * (({IMPACT} * tf) // (1000 * tf + 8 * (100 - {SLOPE} + ({SLOPE} * n * docs) // terms)))) AS BIGINT) AS score
  FROM q JOIN df USING (term) JOIN tf USING (term) JOIN n USING (doc_id), c GROUP BY ALL
)
SELECT * FROM (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0) WHERE rank <= 10
"""
