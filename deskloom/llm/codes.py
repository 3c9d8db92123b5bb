"""Product quantisation of vectors: codes of 16 parts, by codebooks that rounds of nearest entries refine.

A part's nearest entry is found by annular pruning. The entries of a codebook are
sorted by norm. An entry whose norm differs from the part's by more than the best
distance so far can't be nearer, so a binary search gives the interval of norms
that may, and only that interval, ends included, is evaluated, in whole numbers.

Codebooks are small and go to every task; vectors never shuffle. A task adds up its
parts by entry, so what meets is a row for each task, entry and component.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskloom.llm.shared import stored, with_groups

#: Parts of a vector, entries of a part's codebook, and rounds that refine it.
PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Entries next to a part by norm, on either side, that give the first distance.
NEAR = 2


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each part the place of its nearest entry, ties to the lower, and the squared distance; and how many distances were computed.

    Both are whole numbers, in an int64 array where all sums fit, and otherwise in one of Python's integers.
    """
    order = np.argsort(norms := _norms(entries), kind="stable")
    norms, ranked, own, k = norms[order], entries[order], _norms(parts), len(entries)

    def apart(rows: np.ndarray, places: np.ndarray) -> np.ndarray:
        d = parts[rows] - ranked[places]
        return (d * d).sum(axis=1)

    rows, at = np.arange(len(parts)), np.searchsorted(norms, own)
    first = [apart(rows, np.clip(at + i, 0, k - 1)) for i in range(-NEAR, NEAR)]
    reach = np.sqrt(np.minimum.reduce(first).astype(np.float64))
    slack = 1e-9 * (own + reach) + 1e-6
    low, high = np.searchsorted(norms, own - reach - slack, "left"), np.searchsorted(norms, own + reach + slack, "right")
    counts = high - low
    starts = np.cumsum(counts) - counts
    places = np.arange(counts.sum()) - np.repeat(starts - low, counts)
    found = apart(np.repeat(rows, counts), places) * k + order[places]
    best = np.minimum.reduceat(found, starts) if len(parts) else found
    return (best % k).astype(np.int64), best // k, int(counts.sum()) + 2 * NEAR * len(parts)


def _exact(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as int64, or as Python's integers where a packed distance may pass 62 bits."""
    most = max(float(np.abs(a.astype(np.float64)).max(initial=0)) for a in (x, book))
    kind = np.int64 if 4 * most * most * x.shape[-1] * ENTRIES < 2**62 else object
    return x.astype(kind), book.astype(kind)


def _vectors(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """A batch's vectors as (rows, parts, components)."""
    return batch.column("v").flatten().to_numpy().reshape(batch.num_rows, PARTS, width)


def _sums(book: np.ndarray):
    """Sums of each entry's parts, added up over a task's rows."""

    def run(batches):
        totals, counts = np.zeros(book.shape, object), np.zeros(book.shape[:2], np.int64)
        for batch in batches:
            x, entries = _exact(_vectors(batch, book.shape[2]), book)
            for p in range(PARTS):
                code, _, _ = nearest(x[:, p], entries[p])
                counts[p] += np.bincount(code, minlength=book.shape[1])
                part = np.zeros(book.shape[1:], x.dtype)
                np.add.at(part, code, x[:, p])
                totals[p] += part.astype(object)
        for p, e in zip(*np.nonzero(counts)):
            w = range(book.shape[2])
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([p] * len(w), pa.int32()), "entry": pa.array([e] * len(w), pa.int32()), "place": pa.array(w, pa.int32()), "n": pa.array([counts[p, e]] * len(w), pa.int64()), "total": pa.array([Decimal(int(totals[p, e, i])) for i in w], pa.decimal128(38, 0))}
            )

    return run


def _codes(book: np.ndarray):
    def run(batches):
        for batch in batches:
            x, entries = _exact(_vectors(batch, book.shape[2]), book)
            codes, errors = np.zeros((len(x), PARTS), np.uint8), np.zeros(len(x), x.dtype)
            for p in range(PARTS):
                codes[:, p], d, _ = nearest(x[:, p], entries[p])
                errors += d
            texts = [c.tobytes().hex() for c in codes]
            error = pa.array([int(e) if e < 2**63 else None for e in errors], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(texts, pa.string()), error], names=["vec_id", "label", "code", "error"])

    return run


def whole_rows(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", factor: float = 256.0) -> DataFrame:
    """(vec_id, label, v): floor(factor * x) of each component, as double, those beyond 64 bits as the nearest 64-bit number; rows whose vector is null or holds a null or non-finite component go."""
    x = F.col(vector)
    fine = x.isNotNull() & F.forall(x, lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a.cast("double")) < float("inf")))

    def whole(a: Column) -> Column:
        y = F.lit(factor) * a.cast("double")
        return F.when(F.abs(y) < 2.0**63, F.floor(y)).when(y > 0, F.lit(2**63 - 1)).otherwise(F.lit(-(2**63)))

    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(key).alias("vec_id"), F.col(label).alias("label"), F.transform(x, whole).alias("v"))


def first_book(rows: DataFrame, dims: int) -> np.ndarray:
    """(parts, entries, components): the parts of the first ENTRIES rows by vec_id, a null one last, equal ones by vector."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(ENTRIES).select("v").collect()
    return np.array([[int(x) for x in r["v"]] for r in first], object).reshape(len(first), PARTS, dims // PARTS).transpose(1, 0, 2)


def refined(rows: DataFrame, book: np.ndarray) -> np.ndarray:
    """The book with each entry that some part is nearest to replaced by those parts' mean, rounded down."""
    sums = rows.mapInArrow(_sums(book), "part int, entry int, place int, n long, total decimal(38,0)")
    out = book.copy()
    for r in sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        out[r["part"], r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return out


def vector_codes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for every vector without null or non-finite components.

    Vectors are cut into PARTS equal parts; shorter ones count as filled up with zeros
    to the longest one's components, and all to a multiple of PARTS, so empty vectors
    have code 00... and error 0. With fewer than ENTRIES vectors, codebooks have as many
    entries. A vec_id may be null or repeat: each row has its code. Null labels are one
    label. An error beyond 64 bits is null, as is the sum over a label if that is. Other
    columns don't matter, whatever their names. Without vectors the result is empty.

    The driver holds the codebooks: ENTRIES vectors, whatever the table's size.
    """
    rows = stored(whole_rows(vectors, key, vector, label), "vectors")
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 0
    dims = -(-dims // PARTS) * PARTS
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("v"))))
    book = first_book(rows, dims)
    for _ in range(rounds if book.size else 0):
        book = refined(rows, book)
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    sha = hashlib.sha256(",".join(str(x) for x in book.flat).encode()).hexdigest()
    coded = stored(rows.mapInArrow(_codes(book), f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error long"), "codes")
    groups = coded.groupBy("label").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("__rows"))
    met = with_groups(coded, stored(groups, "labels"), "label", "__rows")
    return met.select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def codes_sql(rounds: int = ROUNDS) -> str:
    """DuckDB SQL of vector_codes over embeddings, for vectors of one length, a multiple of PARTS, and of modest components."""
    steps = [
        "k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT vec_id, label, i AS part, v[i * (len(v) // {PARTS}) + 1 : (i + 1) * (len(v) // {PARTS})] AS x FROM k, range({PARTS}) r(i))",
        f"b0 AS MATERIALIZED (SELECT part, n - 1 AS entry, x FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY vec_id) AS n FROM p) WHERE n <= {ENTRIES})",
    ]
    for r in range(rounds + 1):
        far = "list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, b.x) + list_inner_product(b.x, b.x)"
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, label, part, any_value(p.x) AS x, CAST(min(({far}) * {ENTRIES} + entry) AS BIGINT) AS m FROM p JOIN b{r} b USING (part) GROUP BY vec_id, label, part)")
        if r < rounds:
            steps.append(f"e{r} AS (SELECT part, m % {ENTRIES} AS entry, j, floor(sum(x[j]) / count(*)) AS y FROM a{r}, range(1, 1 + (SELECT max(len(x)) FROM p)) q(j) GROUP BY ALL)")
            steps.append(f"m{r} AS (SELECT part, entry, list(y ORDER BY j) AS x FROM e{r} GROUP BY ALL)")
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN m{r} m ON b.part = m.part AND b.entry = m.entry)")
    steps += [
        f"c AS (SELECT vec_id, label, string_agg(printf('%02x', m % {ENTRIES}), '' ORDER BY part) AS code, CAST(sum(m // {ENTRIES}) AS BIGINT) AS error FROM a{rounds} GROUP BY ALL)",
        f"h AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})",
    ]
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c, h"
