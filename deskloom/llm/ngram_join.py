"""N-gram Jaccard join by vertical partitioning.

Every distinct n-gram has a place in one global order, that of its 64-bit hash, and
the order is cut into fragments. The steps:

1. Of each set only a prefix of the order is looked at. Two sets that reach the
   threshold share so many n-grams that their prefixes share some, and, as the
   prefixes have some n-grams to spare, each can leave out those that the most
   documents have. Classes that still share n-grams enough are candidates.
2. The candidates' overlaps are counted fragment by fragment, each fragment for
   itself, and the partial counts are summed per pair. The sum is exact.

Documents with equal sets are one class from the start, and only classes are
compared. First each n-gram's members are compared with one of them, its hub; what
that links is one component. Only n-grams whose members are still in several
components are looked at further: those with few members give pairs of different
components, and those with many are gathered and dealt out as pairs of bounded
blocks, each of which is counted in one matrix and returns a forest of its links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deskloom.llm.bloom import marked
from deskloom.llm.components import connected_components
from deskloom.llm.shared import stored, worker_cache
from deskloom.llm.shingles import ngram_sets

#: A prefix has one n-gram to spare for so many in which a set may differ from a partner; as many are left out as the most frequent.
SPARE = 3
#: Fragments in which overlaps are counted.
PARTS = 8
#: An n-gram that more classes share is dealt out in blocks.
PAIRED = 200
#: N-grams that one side of a block pair holds at most, or one set if that is larger, and classes.
BLOCK, CLASSES = 300_000, 1000
#: Times the members of its largest key that a group of such n-grams has at most.
GATHERED = 4
#: Documents up to which a list of their ids is broadcast; beyond, a Bloom filter is, and the ids are joined by shuffle.
LISTED = 100_000
#: Rows that a worker turns into sets at once.
ROWS = 400


def _class(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def prefix_length(size: int, num: int, den: int) -> int:
    """How many of a set's n-grams, first in the order, are looked at.

    A partner shares at least o = num/den of the set's n-grams, rounded up. Without
    the o - 1 last ones, two such sets still share one n-gram; with s more, s + 1.
    """
    least = -(-num * size // den)
    return size - least + 1 + min((size - least) // SPARE, least - 1)


def _least(size: str, num: int, den: int) -> str:
    return f"(({num} * {size} + {den - 1}) div {den})"


def _spare(size: str, num: int, den: int) -> str:
    least = _least(size, num, den)
    return f"least(({size} - {least}) div {SPARE}, {least} - 1)"


def shared_enough(a: str, b: str, num: int, den: int) -> Column:
    """How many of their kept n-grams two sets of sizes a and b share at least if they reach num/den.

    The pair shares at least o n-grams, so of that set whose prefix ends first, all
    but size - o of the prefix are in the other's prefix too. Of these each set
    leaves out as many as it has to spare, the most frequent ones; both leave out
    the same end of one order.
    """
    both = f"(({num} * ({a} + {b}) + {num + den - 1}) div {num + den})"
    spare = [_spare(x, num, den) for x in (a, b)]
    ahead = f"least({spare[0]} - {_least(a, num, den)}, {spare[1]} - {_least(b, num, den)})"
    return F.expr(f"greatest(1, {both} + 1 + {ahead} - greatest({spare[0]}, {spare[1]}))")


def _alike(a: str, b: str, num: int, den: int) -> Column:
    """Whether two sizes alone allow the threshold."""
    return den * F.least(a, b) >= num * F.greatest(a, b)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64)))


def _profiles(n: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("ngrams")  # an encoder's words, say, go
        seen = set()
        for batch in _slices(batches):
            sizes, classes, keys = [], [], []
            for doc, s in zip(batch.column("doc_id"), ngram_sets(batch.column("text"), n), strict=True):
                sizes.append(len(s))
                classes.append(_class(s))
                again = classes[-1] in seen
                keys.append(s[: 0 if again else prefix_length(len(s), num, den)] if len(s) else s)
                if doc.is_valid:
                    seen.add(classes[-1])
            made = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), _lists(keys)]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "n_shingles", "cls", "keys"])

    return run


#: Where the order is cut into fragments.
EDGES = np.array([(i << 64) // PARTS for i in range(1, PARTS)], np.uint64)


def _segments(n: int, parts: int):
    """The sets of classes, as PARTS fragments or, if parts is 1, whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("ngrams")
        for batch in _slices(batches):
            owners, grams = [], []
            for cls, s in zip(batch.column("cls").to_pylist(), ngram_sets(batch.column("text"), n), strict=True):
                if _class(s) == cls:  # else it is another row of the same doc_id
                    owners.append(cls)
                    grams += np.split(s, np.searchsorted(s, EDGES)) if parts > 1 else [s]
            part = np.tile(np.arange(parts, dtype=np.int32), len(owners))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(owners, np.int64), parts)), pa.array(part), _lists(grams)], ["cls", "part", "grams"])

    return run


def _block_links(num: int, den: int):
    """Links of one block pair: each class with the least that it reaches within the pair."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # a class of one block paired with itself comes once
        pdf = pdf.drop_duplicates("cls").sort_values("cls")
        classes, sets = pdf["cls"].to_numpy(), [np.asarray(s, np.int64).view(np.uint64) for s in pdf["grams"]]
        overlap, size = np.zeros((len(classes), len(classes)), np.float32), np.array([len(s) for s in sets])
        cuts = np.array([[0, *np.searchsorted(s, EDGES), len(s)] for s in sets])
        for part in range(PARTS):
            grams = [s[a:b] for s, a, b in zip(sets, cuts[:, part], cuts[:, part + 1])]
            lengths = np.array([len(g) for g in grams])
            if not lengths.sum():
                continue
            _, ids, often = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
            owner = np.repeat(np.arange(len(classes)), lengths)
            shared = often[ids] > 1
            _, ids = np.unique(ids[shared], return_inverse=True)
            owner, order = owner[shared], np.argsort(ids, kind="stable")
            owner, ids = owner[order], ids[order]
            for low in range(0, int(ids[-1]) + 1 if len(ids) else 0, 2048):
                a, b = np.searchsorted(ids, (low, low + 2048))
                x = np.zeros((len(classes), 2048), np.float32)
                x[owner[a:b], ids[a:b] - low] = 1
                overlap += x @ x.T
        label = np.arange(len(classes))
        while True:
            least = label.copy()
            for i in range(len(classes)):
                linked = (num + den) * overlap[i].astype(np.int64) >= num * (size[i] + size)
                linked[i] = True
                least[i] = label[linked].min()
            least = least[least]
            if (least == label).all():
                break
            label = least
        far = label != np.arange(len(classes))
        return pd.DataFrame({"a": classes[far], "b": classes[label[far]]})

    return run


def ngram_profiles(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Each document's doc_id, n_shingles (set size), cls (the hash of its set) and keys (its prefix in the global order, once a task for equal sets)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _profiles(n, num, den), "doc_id long, n_shingles long, cls long, keys array<long>"
    )


def _kept_keys(profiles: DataFrame, num: int, den: int) -> DataFrame:
    """(key, cls, n, weight): each class with those of its keys that others have, without its most frequent ones.

    weight says how much a class has in common with others, the same in all its rows.
    """
    keyed = profiles.select("cls", F.col("n_shingles").alias("n"), F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("cls").alias("low"), F.max("cls").alias("high"), F.count("*").alias("often")).where("low < high")
    shared = stored(shared.select("key", "often"), "shared")
    # the keys that nobody shares, nearly all, don't get past the filter to the second shuffle
    # dealt by class before rows of equal documents go, so that Spark can split a key that many classes have
    rows = marked(keyed, "key", shared).where("__hit").drop("__hit").join(shared, "key").repartition("cls").distinct()
    mine = W.partitionBy("cls")
    rows = rows.withColumn("place", F.row_number().over(mine.orderBy(F.desc("often"), F.desc("key")))).withColumn("weight", F.sum("often").over(mine))
    return stored(rows.where(F.col("place") > F.expr(_spare("n", num, den))).select("key", "cls", "n", "weight"), "members")


class _Sets:
    """The sets of those classes that are compared, cut into fragments."""

    def __init__(self, docs: DataFrame, names: DataFrame, n: int, repeated: bool):
        self.docs, self.names, self.n, self.repeated = docs, names, n, repeated

    def of(self, classes: DataFrame, parts: int = PARTS) -> DataFrame:
        """(cls, part, grams) for classes (cls), from one document of each; parts is PARTS, or 1 for whole sets."""
        first = stored(self.names.join(classes.distinct(), "cls", "left_semi"), "compared")
        docs = self.docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        if first.count() <= LISTED:
            docs = docs.join(F.broadcast(first), "doc_id")
        else:
            docs = marked(docs, "doc_id", first).where("__hit").drop("__hit").join(first, "doc_id")
        sets = docs.select("cls", "text").mapInArrow(_segments(self.n, parts), "cls long, part int, grams array<long>")
        return stored(sets.dropDuplicates(["cls", "part"]) if self.repeated else sets, "sets")


def _verified(pairs: DataFrame, sets: _Sets, num: int, den: int) -> DataFrame:
    """Those of pairs (a, b, n_a, n_b) that reach the threshold: overlaps by fragment, summed."""
    found = sets.of(pairs.select(F.explode(F.array("a", "b")).alias("cls")))
    side = lambda x: found.select(F.col("cls").alias(x), "part", F.col("grams").alias(f"grams_{x}"))
    counted = pairs.withColumn("part", F.explode(F.array(*map(F.lit, range(PARTS))))).join(side("a"), ["a", "part"]).join(side("b"), ["b", "part"])
    both = F.sum(F.size(F.array_intersect("grams_a", "grams_b"))).alias("both")
    counted = counted.groupBy("a", "b").agg(both, F.max(F.col("n_a") + F.col("n_b")).alias("total"))
    return counted.where((num + den) * F.col("both") >= num * F.col("total")).select("a", "b")


def _hub_links(members: DataFrame, sets: _Sets, num: int, den: int) -> DataFrame:
    """Links of each key's members with its hub: the member that has most in common with others."""
    hubs = members.groupBy("key").agg(F.max(F.struct("weight", "cls", "n")).alias("hub"), F.count("*").alias("k")).where("k > 1")
    hubs = hubs.select("key", F.col("hub.cls").alias("a"), F.col("hub.n").alias("n_a"))
    pairs = members.withColumnsRenamed({"cls": "b", "n": "n_b"}).join(hubs, "key").where("a <> b").where(_alike("n_a", "n_b", num, den))
    pairs = pairs.groupBy("a", "b").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"), F.count("*").alias("keys"))
    # a key may have another hub, so pairs count that have some of the keys that they need
    pairs = pairs.where(3 * F.col("keys") >= shared_enough("n_a", "n_b", num, den))
    return stored(_verified(stored(pairs, "pairs"), sets, num, den), "links")


def _open_keys(members: DataFrame, parts: DataFrame) -> DataFrame:
    """(key, cls, n, component, k, keys): the k members of keys that lie in several components; of keys with equal members one, and how many there are."""
    rows = members.join(parts.withColumnsRenamed({"node": "cls"}), "cls", "left").select("key", "cls", "n", F.coalesce("component", "cls").alias("component"))
    same = [F.sum(F.xxhash64("cls", F.lit(i)).cast("decimal(20,0)")).alias(f"h{i}") for i in range(2)]
    keys = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("k"), *same).where("low < high")
    keys = keys.groupBy("k", "h0", "h1").agg(F.min("key").alias("key"), F.count("*").alias("keys"))
    return stored(rows.join(keys.select("key", "k", "keys"), "key"), "open")


def _pair_links(small: DataFrame, sets: _Sets, num: int, den: int) -> DataFrame:
    a = small.select("key", "keys", F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("component").alias("__a"))
    b = small.select("key", F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("component").alias("__b"))
    pairs = a.join(b, "key").where("a < b AND __a <> __b").where(_alike("n_a", "n_b", num, den))
    pairs = pairs.groupBy("a", "b").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"), F.sum("keys").alias("keys"))
    return _verified(stored(pairs.where(F.col("keys") >= shared_enough("n_a", "n_b", num, den)).drop("keys"), "pairs"), sets, num, den)


def _gathered(large: DataFrame) -> DataFrame:
    """(cls, n, key): the members of keys with many members, where keys that share members are one, unless that is far larger than each of them.

    All keys of a group of near copies have much the same members, which are so
    compared once and not once for each key.
    """
    spread = large.withColumn("first", F.min("cls").over(W.partitionBy("key")))
    groups = connected_components(spread.select(F.col("cls").alias("a"), F.col("first").alias("b"))).withColumnsRenamed({"node": "cls", "component": "group"})
    rows = large.join(groups, "cls")
    sizes = rows.groupBy("group").agg(F.countDistinct("cls").alias("all"), F.max("k").alias("most"))
    one = F.col("all") <= GATHERED * F.col("most")
    rows = rows.join(sizes, "group").select("cls", "n", F.when(one, F.col("group")).otherwise(F.col("key")).alias("key"))
    return stored(rows.distinct(), "many")


def _block_pairs(large: DataFrame, sets: _Sets, num: int, den: int) -> DataFrame:
    keys = large.groupBy("key").agg(F.max("n").alias("largest"), F.count("*").alias("k")).where("k > 1")
    blocks = F.greatest(F.ceil(F.col("k") * F.col("largest") / F.lit(BLOCK)), F.ceil(F.col("k") / F.lit(CLASSES))).cast("int")
    rows = large.join(keys, "key").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("cls", "key"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("cls", "key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    found = rows.join(sets.of(large.select("cls"), parts=1), "cls")
    return found.groupBy("key", "p", "q").applyInPandas(_block_links(num, den), "a long, b long")


def class_links(docs: DataFrame, profiles: DataFrame, names: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(a, b): links between classes, of which a forest for each component; what hubs link comes as stars."""
    repeated = bool(profiles.groupBy("doc_id").count().where("count > 1").limit(1).count())
    sets = _Sets(docs, names, n, repeated)
    members = _kept_keys(profiles, num, den)
    parts = connected_components(_hub_links(members, sets, num, den))
    rest = _open_keys(members, parts)
    small, large = rest.where(F.col("k") <= PAIRED), rest.where(F.col("k") > PAIRED)
    links = parts.select(F.col("node").alias("a"), F.col("component").alias("b"))
    links = links.unionByName(_pair_links(small, sets, num, den))
    if large.limit(1).count():
        links = links.unionByName(_block_pairs(_gathered(large), sets, num, den))
    return links


def ngram_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach).

    docs has doc_id and text; other columns are left out. Two documents link when
    den * intersection >= num * union of their sets. Null and empty texts have an
    empty set and link with nothing, not even each other. Repeated rows are
    repeated in the result. A row with a null doc_id can't be named, so it links
    with nothing, and its component is null.
    """
    profiles = stored(ngram_profiles(docs, n, num, den), "profiles")
    filled = profiles.where("n_shingles > 0 AND doc_id IS NOT NULL")
    names = stored(filled.groupBy("cls").agg(F.min("doc_id").alias("doc_id")), "classes")
    parts = stored(connected_components(class_links(docs, filled, names, n, num, den)), "components").withColumnRenamed("node", "cls")
    named = names.join(parts, "cls").select("component", F.col("doc_id").alias("component_id")).groupBy("component").agg(F.min("component_id").alias("component_id"))
    linked = parts.join(named, "component").select("cls", "component_id")
    first = names.join(linked, "cls", "left").select("cls", F.coalesce("component_id", "doc_id").alias("component_id"))
    kept = filled.select("doc_id", "n_shingles", "cls").join(first, "cls").select("doc_id", "n_shingles", "component_id")
    return kept.unionByName(profiles.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def without_copies(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs (doc_id, text, ...) with one document of each component: that with the smallest doc_id.

    Documents with an empty set or a null doc_id stay. Of rows that repeat a doc_id
    and text, one stays.
    """
    comps = stored(ngram_components(docs, n, num, den), "components")
    gone = stored(comps.where("component_id < doc_id").select("doc_id").distinct(), "gone")
    if gone.count() <= LISTED:
        kept = docs.join(F.broadcast(gone), "doc_id", "left_anti")
    else:
        asked = marked(docs, "doc_id", gone)
        kept = asked.where("NOT __hit").unionByName(asked.where("__hit").join(gone, "doc_id", "left_anti")).drop("__hit")
    repeated = comps.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count()
    return kept.dropDuplicates(["doc_id", "text"]) if repeated else kept
