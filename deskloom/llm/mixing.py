"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deskloom.llm.shared import numbered, stored, word_count

#: Intervals of the ranks in which words are summed before one of them is looked into, and how often.
BINS, LEVELS = 4096, 2
#: A document is large if it has more than one part in so many of what its source lacks.
LARGE = 64
#: Inclusion probabilities that aren't 1 lie between this and 1 less it.
LEAST = 1e-12
#: Ranks are the quotients' binary logarithms, scaled from this range (plus and minus) to 0 to 1, so that small probabilities' ranks don't crowd.
POWERS = 128


def source_targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """sources (source, source_size) with each one's target in words.

    The sources, ordered by code point with null last, weigh weights in turn and
    share all words. A target stops at most times its source's size; what is over
    goes to the others by weight, until none is above. Each round is a sum over
    the table of sources.
    """
    rows = numbered(sources, F.col("source").asc_nulls_last(), name="turn")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("turn") % len(weights) + 1).cast("int"))
    rows = stored(rows.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most))), "sources")
    total, level, full = rows.agg(F.sum("source_size")).first()[0] or 0, 0.0, -1
    while True:
        over = F.col("cap") < F.col("weight") * F.lit(level)
        capped, left, count = rows.agg(F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight"))), F.count_if(over)).first()
        if count == full or not left:
            break
        full, level = count, (total - (capped or 0.0)) / left
    target = F.least(F.col("cap"), F.col("weight") * F.lit(level))
    return rows.withColumn("target", target.cast("double")).select("source", "source_size", "target")


def _same(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """a joined with b by source, null being a source like others."""
    b = b.withColumnRenamed("source", "__source")
    return a.join(b, F.col("source").eqNullSafe(F.col("__source")), how).drop("__source")


def pareto_odds(u: Column, inclusion: Column) -> Column:
    """The rank of Pareto order sampling: random odds divided by inclusion odds."""
    return (u / (1 - u)) / (inclusion / (1 - inclusion))


def _ranked(rows: DataFrame) -> DataFrame:
    """rows (size, hash, lack, scale) with inclusion, tier and rank: the Pareto quotient's logarithm, scaled; certain documents have rank 0."""
    certain = F.col("scale") * F.col("size") >= 1
    inclusion = F.least(F.lit(1 - LEAST), F.greatest(F.lit(LEAST), F.col("scale") * F.col("size")))
    u = (F.shiftrightunsigned("hash", 11).cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
    rows = rows.withColumn("rank", F.when(certain, F.lit(0.0)).otherwise(0.5 + F.log2(pareto_odds(u, inclusion)) / (2 * POWERS)))
    over, large = F.col("size") > F.col("lack"), F.col("size") * LARGE > F.col("lack")
    tier = F.when((F.col("size") <= 0) | (F.col("lack") <= 0), F.lit(None)).when(over, "over").when(large, "large").otherwise("small")
    return rows.withColumn("inclusion", F.when(certain, F.lit(1.0)).otherwise(inclusion)).withColumn("tier", tier)


def _levelled(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """plan (source, lack, ...) with scale: inclusion probabilities min(1, scale * size) then add up to lack words.

    sizes: (source, size, n), n documents of a size. Documents whose probability would
    pass 1 are certain, and what that leaves goes to the others, until no more are.
    """
    base = stored(_same(sizes.where("size > 0"), plan.where("lack > 0").select("source", "lack")), "levels")
    rows, full = base.withColumn("scale", F.lit(0.0)), 0
    while True:
        certain = F.col("scale") * F.col("size") >= 1
        words, squares = F.col("size") * F.col("n"), (F.col("size") * F.col("size")).cast("decimal(38,0)") * F.col("n")
        taken, others = F.coalesce(F.sum(F.when(certain, words)), F.lit(0)), F.sum(F.when(~certain, squares)).cast("double")
        # where all are certain the scale stays
        scale = F.when(others > 0, F.greatest(F.lit(0.0), F.max("lack") - taken) / others).otherwise(F.max("scale"))
        scales = stored(rows.groupBy("source").agg(scale.alias("scale")), "scales")
        rows = _same(base, scales)
        count = rows.agg(F.sum(F.when(F.col("scale") * F.col("size") >= 1, F.col("n")))).first()[0] or 0
        if count == full:
            return _same(plan, scales, "left").withColumn("scale", F.coalesce("scale", F.lit(0.0)))
        full = count


def _place() -> Column:
    return F.struct("rank", "hash")


def _cuts(items: DataFrame, goals: DataFrame, name: str) -> DataFrame:
    """(source, name): the last place of those items (source, rank, hash, size) that come first in their source, up to its goal of words.

    Ranks are cut into intervals, whose words are summed, and the one in which the
    goal lies is cut again; what is left of it is gone through row by row. The last
    item is in if that comes closer to the goal.
    """
    goals = goals.where("goal > 0")
    rows, low = _same(items, goals.withColumn("before", F.lit(0).cast("long"))), None
    for level in range(1, LEVELS + 1):
        rows = rows.withColumn("bin", F.floor(F.col("rank") * float(BINS**level)))
        bins = rows.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("goal").alias("goal"), F.first("before").alias("before"))
        upto = F.col("before") + F.sum("words").over(W.partitionBy("source").orderBy("bin"))
        bins = bins.withColumn("upto", upto).where("upto - words <= goal AND goal < upto")
        edges = stored(bins.select("source", F.col("bin").alias("edge"), (F.col("upto") - F.col("words")).alias("start")), "edges")
        low = edges if low is None else low
        rows = _same(rows, edges).where("bin = edge").drop("before", "edge", "bin").withColumnRenamed("start", "before")
    whole = _same(goals.select("source"), low.select("source"), "left_anti").select("source", F.struct(F.lit(2.0).alias("rank"), F.lit(0).cast("long").alias("hash")).alias(name))
    none = F.struct((F.col("edge") / float(BINS**LEVELS)).alias("rank"), F.lit(-(1 << 63)).alias("hash"))
    begun = edges.select("source", none.alias(name))
    within = W.partitionBy("source").orderBy("rank", "hash").rowsBetween(W.unboundedPreceding, -1)
    fits = F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0)) + F.col("size") * F.lit(0.5) <= F.col("goal")
    # after the first that doesn't fit, none is taken
    rows = rows.withColumn("fits", fits).withColumn("fits", F.min("fits").over(within.rowsBetween(W.unboundedPreceding, 0)))
    some = rows.where("fits").select("source", _place().alias(name))
    return whole.unionByName(begun.unionByName(some).groupBy("source").agg(F.max(name).alias(name)))


def _words(sized: DataFrame, plan: DataFrame, tier: str) -> DataFrame:
    """(source, got): the words of a tier up to its cut."""
    rows = _ranked(_same(sized, plan)).where(f"tier = '{tier}'").where(_place() <= F.col(tier))
    return rows.groupBy("source").agg(F.sum("size").alias("got"))


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    """docs with size and hash added: a random number that depends on seed, doc_id and text alone."""
    return docs.withColumns({"size": word_count(F.col("text")), "hash": F.xxhash64(F.lit(seed), "doc_id", "text")})


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3, seed: int = 17) -> DataFrame:
    """One row for each source of docs: its size and target, how many whole copies are certain, and the last places that the rest takes.

    A document is expected to be taken target / source_size times. The whole part
    of that number is certain. What a source then lacks is a sample with a fixed
    size in words: a document's inclusion probability is proportional to its own
    words, up to 1, and the probabilities of all give as many words as are lacking.
    Documents are taken by Pareto rank, certain ones first. Large documents are drawn before
    small ones, which make up for what the large ones leave. Of the documents with
    more words than their source lacks, which come before all others, the first
    is taken that brings the source nearer to what is expected of them.
    """
    sized = stored(_sized(docs.select("doc_id", "source", "text"), seed).select("source", "size", "hash"), "sized")
    sizes = stored(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "sizes")
    plan = source_targets(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0)
    plan = plan.withColumn("whole", whole.cast("int")).withColumn("lack", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    plan = stored(_levelled(sizes, stored(plan, "targets")), "plan")

    rest = _ranked(_same(sized, plan)).where("tier IS NOT NULL")
    tier = lambda t, x: F.coalesce(F.sum(F.when(F.col("tier") == t, x)), F.lit(0)).alias
    expected = (F.col("inclusion") * F.col("size") * 1024).cast("long")
    sums = rest.groupBy("source").agg(*(tier(t, F.col("size"))(t) for t in ("over", "large", "small")), *(tier(t, expected)(f"want_{t}") for t in ("over", "large", "small")))
    sums = stored(_same(sums, plan.select("source", "lack")), "sums")

    # after one document with more words than are lacking, a second comes no nearer
    share = F.greatest(F.col("want_over") / 1024, F.col("lack") - F.col("large") - F.col("small"))
    nearer = _same(rest.where("tier = 'over'").select("source", "rank", "hash", "size"), sums.select("source", share.alias("goal"))).where("size * 0.5D <= goal")
    over = stored(nearer.groupBy("source").agg(F.min(F.struct("rank", "hash", "size")).alias("first")), "over")
    plan = _same(plan, over.select("source", F.struct("first.rank", "first.hash").alias("over")), "left")

    goals = _same(sums.drop("over"), over.select("source", F.col("first.size").alias("got")), "left").withColumn("lack", F.col("lack") - F.coalesce("got", F.lit(0)))
    share = F.least(F.lit(1.0), F.col("want_large") / F.greatest(F.col("want_large") + F.col("want_small"), F.lit(1))) * F.col("lack")
    goals = goals.withColumn("goal", F.least(F.col("large").cast("double"), F.greatest(share, F.col("lack") - F.col("small"))))
    place = ["source", "rank", "hash", "size"]
    cuts = stored(_cuts(rest.where("tier = 'large'").select(*place), goals.select("source", "goal"), "large"), "large")
    plan = stored(_same(plan, cuts, "left"), "plan")
    goals = _same(goals.select("source", "lack"), _words(sized, plan, "large"), "left")
    goals = goals.select("source", (F.col("lack") - F.coalesce("got", F.lit(0))).alias("goal"))
    return stored(_same(plan, _cuts(rest.where("tier = 'small'").select(*place), goals, "small"), "left"), "plan")


def _with_copies(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """sized (source, size, hash, ...) with the columns of plan, rank and copies. The plan has a row for each source, and Spark broadcasts it if its file is small."""
    rows = _ranked(_same(sized, plan))
    extra = F.when(F.col("tier") == "over", _place() == F.col("over")).when(F.col("tier") == "large", _place() <= F.col("large")).when(F.col("tier") == "small", _place() <= F.col("small"))
    return rows.withColumn("copies", F.col("whole").cast("long") + F.coalesce(extra, F.lit(False)).cast("long"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3, seed: int = 17) -> DataFrame:
    """One row for each of docs (doc_id, source, text): doc_id, source, size, source_size, target, rank, copies, taken.

    The mix is that of mix_plan. size counts words (null text: 0), null is a source
    like others, rank is the Pareto rank within the source's tier, taken is copies
    times size. Ranks follow from seed, doc_id and text, so reruns agree, and rows
    that repeat both within a source are taken together. An empty table gives an
    empty result.
    """
    plan = mix_plan(docs, weights, most, seed)
    rows = _with_copies(_sized(docs.select("doc_id", "source", "text"), seed).drop("text"), plan)
    return rows.select("doc_id", "source", "size", "source_size", "target", "rank", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3, seed: int = 17) -> DataFrame:
    """docs with each row as often as the mix takes it, with docs' columns alone. The rows stay where they are: only the plan is sent."""
    plan = mix_plan(docs, weights, most, seed)
    rows = _sized(docs.select(F.struct("*").alias("__row"), "doc_id", "source", "text"), seed).drop("doc_id", "text")
    taken = _with_copies(rows, plan).where("copies > 0").withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return taken.select("__row.*")
