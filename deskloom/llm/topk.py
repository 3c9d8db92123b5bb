"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are grouped by length into buckets. For a query with a known bound b
on its k-th best product, a bucket whose largest length is l needs a cosine of
b / (|q| l) at least, the local threshold. Above 1, the bucket is out (length
pruning). Where it is high, a unit vector p with that cosine to the query lies, in
each of the query's largest coordinates, within a range about the query's own
value. Where it is low, such ranges exclude little; then the products over the
coordinates in which the queries are largest are taken first, and a pair whose
lengths over the other coordinates can't make up what is lacking is out. What is
left is verified by exact integer products.

Bounds come first from the longest vectors, about a block of them, so every query
starts with one; both steps work on blocks of queries against blocks of one bucket.
"""

from __future__ import annotations

import operator
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deskloom.llm.shared import stored

#: Coordinates of a query that are looked at, the local cosine below which partial products prune instead, and the coordinates these take.
FOCUS, COSINE, PART = 6, 0.45, 0.75
#: Lengths are counted to this, so that squares are finite; the ends of 64 bits hold every product beyond.
LONGEST = 1e150
#: Vectors in a block of candidates and in one of queries, and lengths told apart within a factor of 2.
BLOCK, QUERIES, STEPS = 4000, 20_000, 8
#: Rows of a tile within a block.
TILE = 256


def _fits(a: np.ndarray, b: np.ndarray) -> float:
    """No sum of products of a's and b's rows is larger than this."""
    return float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of whole numbers held as doubles: by doubles or 64 bits where these hold every sum exactly, else by integers of any size, and then held within 64 bits."""
    most = _fits(a, b)
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    if most < 2**63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = [[[int(x) for x in row] for row in side] for side in (a, b)]
    out = [[max(-(2**63), min(2**63 - 1, sum(map(operator.mul, x, y)))) for y in whole[1]] for x in whole[0]]
    return np.array(out, np.int64).reshape(len(a), len(b))


def _lengths(v: np.ndarray) -> np.ndarray:
    return np.sqrt((np.clip(v, -LONGEST, LONGEST) ** 2).sum(axis=1))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows of doubles, filled up with zeros to a width."""
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out


def _survivors(q: np.ndarray, c: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of queries and candidates whose product may reach the query's bound, and their exact products.

    The coordinates with most of the queries' squares come first. Over the others a
    product is at most that of the two lengths there.
    """
    head = np.argsort(-(q**2).sum(axis=0), kind="stable")
    head, tail = np.split(head, [int(np.ceil(PART * len(head)))])
    part = q[:, head] @ c[:, head].T
    rest = np.outer(_lengths(q[:, tail]), _lengths(c[:, tail]))
    i, j = np.nonzero(part + rest * (1 + 1e-9) >= bounds[:, None] - 1e-9 * np.abs(bounds[:, None]))
    return i, j, (part[i, j] + np.einsum("ij,ij->i", q[np.ix_(i, tail)], c[np.ix_(j, tail)])).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of a row's k highest scores, ties to the smaller id."""
    return np.lexsort((ids, ~scores))[:k]


def _pruned(q: np.ndarray, unit: np.ndarray, lengths: np.ndarray, bound: float) -> np.ndarray:
    """Places of a block's vectors (by falling length) that may reach the bound."""
    size = float(_lengths(q[None].astype(np.float64))[0])
    if bound <= 0 or not len(lengths):
        return np.arange(len(lengths))
    if size * lengths[0] < bound * (1 - 1e-9):
        return np.empty(0, np.int64)
    # only the first ones are long enough
    upto = int(np.searchsorted(-lengths, -bound * (1 - 1e-9) / size, side="right"))
    local = bound * (1 - 1e-9) / (size * lengths[0])
    if local < COSINE:
        return np.arange(upto)
    direction = q / size
    keep = np.arange(upto)
    slack = np.sqrt(max(0.0, 1 - local * local))
    for c in np.argsort(-np.abs(direction))[:FOCUS]:
        # cos >= local leaves p_c within q_c cos +- sqrt(1 - q_c^2) sin, for every cosine from local to 1
        side = np.sqrt(max(0.0, 1 - direction[c] ** 2)) * slack
        high = 1.0 if direction[c] >= local else direction[c] * local + side
        low = -1.0 if -direction[c] >= local else direction[c] * local - side
        at = unit[keep, c]
        keep = keep[(at <= high + 1e-9) & (at >= low - 1e-9)]
    return keep


def _search(k: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        candidates, queries = block[~block["asks"]], block[block["asks"]]
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(candidates) and len(queries):
            width = int(block["v"].map(len).max())
            c, q = _matrix(candidates["v"], width), _matrix(queries["v"], width)
            length = _lengths(c)
            order = np.argsort(-length, kind="stable")
            c, length, ids = c[order], length[order], candidates["vec_id"].to_numpy()[order]
            unit = c / np.where(length > 0, length, 1)[:, None]
            bounds = queries["bound"].fillna(-np.inf).to_numpy(np.float64)
            for low in range(0, len(q), TILE):
                some, own, least = q[low : low + TILE], queries["vec_id"].to_numpy()[low : low + TILE], bounds[low : low + TILE]
                for i, keep, scores in _verified(some, c, unit, length, least):
                    good = (ids[keep] != own[i]) & (scores >= least[i])
                    keep, scores = keep[good], scores[good]
                    best = _best(scores, ids[keep], k)
                    out["query_id"] += [own[i]] * len(best)
                    out["vec_id"] += ids[keep[best]].tolist()
                    out["score"] += scores[best].tolist()
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def _verified(q: np.ndarray, c: np.ndarray, unit: np.ndarray, length: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each of some queries the places of the candidates that pruning leaves, and their exact products."""
    keeps = [_pruned(x, unit, length, b) for x, b in zip(q, bounds)]
    narrow = np.array([len(keep) <= 0.2 * len(c) for keep in keeps], bool)
    for i in np.flatnonzero(narrow):
        yield i, keeps[i], _exact(q[i : i + 1], c[keeps[i]])[0]
    # what has no bound above 0 yet needs all products
    partial = ~narrow & (bounds > 0) & (_fits(q, c) < 2**53)
    wide = np.flatnonzero(~narrow & ~partial)
    if len(wide):
        for i, scores in zip(wide, _exact(q[wide], c)):
            yield i, np.arange(len(c)), scores
    some = np.flatnonzero(partial)
    if len(some):
        at, places, scores = _survivors(q[some], c, bounds[some])
        ends = np.searchsorted(at, np.arange(len(some) + 1))
        for n, i in enumerate(some):
            yield i, places[ends[n] : ends[n + 1]], scores[ends[n] : ends[n + 1]]


def whole_vectors(vectors: DataFrame, vector: str = "embedding", factor: float = 256.0) -> DataFrame:
    """(vec_id, v, norm): floor(factor * x) of each component x as double, as a whole number held by a double; rows with a null id, vector or component, or one that isn't finite, go.

    A product with the factor that no double holds counts as the largest double.
    """
    x = F.col(vector)
    fine = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a.cast("double")) < float("inf")))
    most = F.lit(sys.float_info.max)

    def floored(a: Column) -> Column:
        y = F.greatest(-most, F.least(most, F.lit(factor) * a.cast("double")))
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)  # beyond, all doubles are whole

    rows = vectors.where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, floored).alias("v"))
    limit = F.lit(LONGEST)
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, a: acc + F.pow(F.least(limit, F.abs(a)), F.lit(2.0)))))


def _met(candidates: DataFrame, queries: DataFrame, key: list[str]):
    """Blocks of candidates and of queries, by key."""
    there = candidates.select(*key, "vec_id", "v", F.lit(None).cast("double").alias("bound"), F.lit(False).alias("asks"))
    return there.unionByName(queries.select(*key, "vec_id", "v", "bound", F.lit(True).alias("asks"))).groupBy(*key)


def norm_topk(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k best candidates by integer inner product, ties to the smaller vec_id.

    vectors and queries: (vec_id, v, norm) as of whole_vectors; of two lengths, the
    shorter vector counts as filled up with zeros. Products beyond 64 bits count as the
    largest, or smallest, number of 64 bits. A query's own id is no candidate for it;
    all candidates where there are fewer than k. Repeated ids are candidates each.
    Empty sides give an empty result.
    """
    bucket = F.when(F.col("norm") > 0, F.floor(F.log2("norm") * STEPS)).otherwise(F.lit(-9999)).cast("int")
    rows = stored(vectors.withColumn("bucket", bucket), "vectors")
    asked = stored(queries.select("vec_id", "v", "norm"), "queries")
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.max("norm").alias("longest"))
    n_queries = asked.count()
    grids = max(1, -(-n_queries // QUERIES))
    asked = asked.withColumn("grid", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(grids)).cast("int"))
    sizes = sizes.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    blocks = rows.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(7)), "blocks").cast("int"))
    schema = "query_id long, vec_id long, score long"

    # the bounds: each query against a block of each bucket until there is about one block of the longest vectors
    above = F.coalesce(F.sum("n").over(W.orderBy(F.desc("bucket")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    longest = sizes.withColumn("above", above).where(F.col("above") < BLOCK).select(F.col("bucket").alias("__top"))
    first = blocks.join(F.broadcast(longest), F.col("bucket") == F.col("__top")).where("block = 0").drop("__top")
    parts = max(1, min(64, -(-n_queries // 500)))
    spread = first.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = asked.withColumn("cell", F.pmod(F.xxhash64("vec_id", F.lit(9)), F.lit(parts)).cast("int")).withColumn("bound", F.lit(None).cast("double"))
    seen = _met(spread, dealt, ["cell"]).applyInPandas(_search(k), schema)
    kth = seen.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("bound")).where(F.col("n") >= k)
    bounded = asked.join(kth.select(F.col("query_id").alias("vec_id"), "bound"), "vec_id", "left")
    bounded = stored(bounded.dropDuplicates(["vec_id"]), "bounds")

    # all blocks; a query goes to those whose longest vector may reach its bound
    cells = sizes.select("bucket", "longest", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    goes = F.col("bound").isNull() | (F.col("bound") <= 0) | (F.col("norm") * F.col("longest") >= F.col("bound") * (1 - 1e-9))
    cells = cells.groupBy("bucket").agg(F.max("longest").alias("longest"), F.max("block").alias("last"))
    sent = bounded.join(F.broadcast(cells), goes).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("last"))))
    there = blocks.withColumn("grid", F.explode(F.sequence(F.lit(0), F.lit(grids - 1))))
    key = ["bucket", "block", "grid"]
    found = _met(there, sent, key).applyInPandas(_search(k), schema)
    # the complement of a score falls as it rises, without an overflow at the end of 64 bits
    top = F.slice(F.array_sort(F.collect_list(F.struct(F.bitwise_not("score").alias("s"), F.col("vec_id").alias("v")))), 1, k)
    ranked = found.groupBy("query_id").agg(top.alias("top")).select("query_id", F.posexplode("top").alias("rank", "x"))
    return ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.v").alias("vec_id"), F.bitwise_not("x.s").alias("score"))
