"""Exact duplicates by two passes over digests, of which only possibly repeated rows shuffle.

The first pass puts every digest's hash into a Bloom filter and notes the cells
that are set a second time; these make a second filter. Tasks send their cells
packed, a few bytes a row, and each group of cells is merged on its own, so no task
holds the filter whole. The second pass asks the second filter, by a broadcast
join: a row that isn't in it is alone with its text and goes straight to the
result; the others are grouped by digest, exactly, so a false positive costs a
shuffled row and nothing else. Where the filter would pass a bound, rows are dealt
with in slices of the hash, each with a filter within the bound.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskloom.llm.shared import stored, with_groups

#: Cells of a segment (64 longs), and the values that share one: 16 cells a value, of which it sets two.
CELLS, VALUES = 4096, 256
#: Segments that are merged at once, and segments of a slice: 134 MB of cells that are broadcast at most.
GROUP, SLICE = 256, 1 << 18
#: Rows whose cells a task packs at once.
PACKED = 1 << 20


def bare(text: Column) -> Column:
    """A text without the characters space, \\t, \\n, \\v, \\f and \\r; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def _segment(h: Column, segments: int) -> Column:
    """A hash's segment: the hash's first 31 bits, scaled, so that slices of segments are ranges of hashes."""
    return F.shiftright(F.shiftrightunsigned(h, 33) * F.lit(segments).cast("long"), 31)


def _places(h: Column) -> tuple[Column, Column]:
    """The two different cells of a hash within its segment."""
    a = h.bitwiseAND(F.lit(CELLS - 1))
    step = F.shiftrightunsigned(h, 12).bitwiseAND(F.lit(0xFFFFF)) % F.lit(CELLS - 1)
    return a.cast("int"), ((a + step + 1) % F.lit(CELLS)).cast("int")


def _packed(batches):
    """(segment, a, b) rows as (group, cells): a cell's place in its group, shifted by one bit that says whether it was set twice here."""

    def send(rows: list[pa.RecordBatch]):
        first = np.concatenate([r.column(0).to_numpy() for r in rows]) * CELLS
        both = np.concatenate([first + np.concatenate([r.column(i).to_numpy() for r in rows]) for i in (1, 2)])
        cells, n = np.unique(both, return_counts=True)
        groups, at = cells // (GROUP * CELLS), (cells % (GROUP * CELLS)).astype(np.uint32) << 1 | (n > 1)
        starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
        parts = [x.astype(np.uint32).tobytes() for x in np.split(at, starts[1:])]
        return pa.RecordBatch.from_arrays([pa.array(groups[starts]), pa.array(parts, pa.binary())], names=["group", "cells"])

    held, n = [], 0
    for batch in batches:
        held, n = [*held, batch], n + batch.num_rows
        if n >= PACKED:
            yield send(held)
            held, n = [], 0
    if n:
        yield send(held)


def _twice(rows: pd.DataFrame) -> pd.DataFrame:
    """A group's cells as (segment, bits): those segments in which a cell was set twice."""
    packed = np.concatenate([np.frombuffer(x, np.uint32) for x in rows["cells"]])
    at = packed >> 1
    cells, n = np.unique(at, return_counts=True)
    again = np.union1d(cells[n > 1], at[packed & 1 == 1])
    bits = np.zeros(GROUP * CELLS, np.uint8)
    bits[again] = 1
    words = np.packbits(bits, bitorder="little").view(np.int64).reshape(GROUP, CELLS // 64)
    some = np.flatnonzero(words.any(axis=1))
    return pd.DataFrame({"segment": rows["group"].iat[0] * GROUP + some, "bits": pd.Series(list(words[some]), dtype=object)})


def repeated_filter(digests: DataFrame, segments: int) -> DataFrame:
    """(segment, bits): the filter of hashes h that may occur twice. Every hash that does is in it."""
    a, b = _places(F.col("h"))
    packed = digests.select(_segment(F.col("h"), segments).alias("segment"), a.alias("a"), b.alias("b")).mapInArrow(_packed, "group long, cells binary")
    return packed.groupBy("group").applyInPandas(_twice, "segment long, bits array<long>")


def possibly_repeated(digests: DataFrame, found: DataFrame, segments: int) -> DataFrame:
    """digests with __maybe: false only for rows whose hash occurs once."""
    held = lambda c: F.getbit(F.get("bits", F.shiftright(c, 6)), c.bitwiseAND(F.lit(63))) == 1
    a, b = _places(F.col("h"))
    rows = digests.withColumn("segment", _segment(F.col("h"), segments)).join(F.broadcast(found), "segment", "left")
    return rows.withColumn("__maybe", F.coalesce(held(a) & held(b), F.lit(False))).drop("segment", "bits")


def _deduped(digests: DataFrame, segments: int) -> DataFrame:
    found = stored(repeated_filter(digests, segments), "repeated")
    rows = possibly_repeated(digests, found, segments)
    alone = rows.where(~F.col("__maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    again = rows.where("__maybe").select("doc_id", "text_sha256", "length", "row")
    first = F.min(F.struct((-F.col("length")).alias("length"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("first")
    groups = stored(again.groupBy("text_sha256").agg(first, F.count("*").alias("group_size")), "groups")
    met = with_groups(again, groups, "text_sha256", "group_size")
    kept = F.col("row") == F.col("first.row")
    return alone.unionByName(met.select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256"))


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = SLICE) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of docs, dropped ones too.

    Texts are equal when their SHA-256 is, without whitespace; null counts as empty,
    and equals texts of whitespace alone. Of equal texts the row with the most code
    points in the original text stays, then that with the smallest doc_id; a null
    doc_id comes last, and of rows that repeat doc_id and text one stays. Other columns
    don't matter, whatever their names. An empty table gives an empty result.

    most: segments of a slice. A corpus whose filter has more is dealt with in slices,
    one after the other, each of which reads its range of the digests alone.
    """
    sha = F.sha2(bare(F.col(text)), 256)
    rows = docs.select(F.col(key).alias("doc_id"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("length"), sha.alias("text_sha256"))
    rows = rows.withColumn("h", F.xxhash64("text_sha256")).withColumn("top", F.shiftrightunsigned("h", 33)).withColumn("row", F.monotonically_increasing_id())
    digests = stored(rows.sortWithinPartitions("top"), "digests")
    segments = max(1, -(-digests.count() // VALUES))
    if segments <= most:
        return _deduped(digests, segments)
    slices = []
    for low in range(0, segments, most):
        ends = [-(-(min(s, segments) << 31) // segments) for s in (low, low + most)]
        slices.append(stored(_deduped(digests.where((F.col("top") >= ends[0]) & (F.col("top") < ends[1])), segments), "slice"))
    return reduce(DataFrame.unionByName, slices)


ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w = 1 AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST)
"""
