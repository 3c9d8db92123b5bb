"""Metrics of predictions and rankings, each a few aggregates over joined rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deskloom.operators.threads import numbered

#: Upper edges of the ten bins of a probability.
EDGES = tuple(i / 10 for i in range(1, 11))


def brier(rows: DataFrame, p: str = "p", truth: str = "truth") -> DataFrame:
    """One row, brier: the mean squared distance of p from the truth; 0 without rows."""
    return rows.agg(F.coalesce(F.round(F.avg(F.pow(F.col(p) - F.col(truth), 2)), 6), F.lit(0.0)).alias("brier"))


def bin_of(p: Column) -> Column:
    """0 to 9: the first bin is closed on both sides, others are open below; null outside 0 to 1."""
    chain = reduce(lambda c, ie: c.when(p <= ie[1], ie[0]), list(enumerate(EDGES))[1:], F.when(p <= EDGES[0], 0))
    return F.when((p >= 0) & (p <= 1), chain)


def _bins(rows: DataFrame, p: str, truth: str) -> DataFrame:
    return rows.groupBy(bin_of(F.col(p)).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("conf"), F.avg(truth).alias("acc"))


def calibration_error(rows: DataFrame, p: str = "p", truth: str = "truth") -> DataFrame:
    """One row, ece: the bins' distances of accuracy from confidence, weighed by their rows. Values outside 0 to 1 count in the total only."""
    gap = F.when(F.col("bin").isNotNull(), F.col("n") * F.abs(F.col("acc") - F.col("conf"))).otherwise(F.lit(0.0))
    return _bins(rows, p, truth).agg(F.coalesce(F.round(F.sum(gap) / F.sum("n"), 6), F.lit(0.0)).alias("ece"))


def reliability(rows: DataFrame, p: str = "p", truth: str = "truth") -> DataFrame:
    """(bin, n, mean_conf, acc, gap) of the bins that have rows; the gap is that of the rounded values."""
    out = _bins(rows, p, truth).where("bin IS NOT NULL").select("bin", "n", F.round("conf", 4).alias("mean_conf"), F.round("acc", 4).alias("acc"))
    return out.withColumn("gap", F.round(F.col("acc") - F.col("mean_conf"), 4))


def confusion(rows: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    return rows.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_report(rows: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """(label, precision, recall, f1, support) for every label that is true or predicted somewhere; 0 where nothing is to divide by.

    The rows meet once, in the confusion matrix, whose size is the labels squared.
    """
    cells = confusion(rows, truth, predicted)
    sides = F.array(
        F.struct(F.col("truth").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said"), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("said"), F.lit(0).cast("long").alias("hit")),
    )
    sums = cells.select(F.explode(sides).alias("s")).select("s.*").groupBy("label").agg(F.sum("support").alias("support"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    p, r = rate(F.col("hit"), F.col("said")), rate(F.col("hit"), F.col("support"))
    return sums.select("label", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(rate(2 * F.col("hit"), F.col("said") + F.col("support")), 6).alias("f1"), "support")


def accuracy(rows: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """One row: accuracy and macro-F1."""
    cells = confusion(rows, truth, predicted)
    acc = cells.agg(F.round(F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("accuracy"))
    return acc.crossJoin(class_report(rows, truth, predicted).agg(F.round(F.avg("f1"), 6).alias("macro_f1")))


def group_rates(rows: DataFrame, group: str, hit: Column) -> DataFrame:
    """(group, total, hits, rate)."""
    return rows.groupBy(group).agg(F.count("*").alias("total"), F.count_if(hit).alias("hits")).withColumn("rate", F.round(F.col("hits") / F.col("total"), 2))


def most_common(rows: DataFrame, n: int, *key: str) -> DataFrame:
    """The n most frequent keys, of equal ones the smallest."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *key).limit(n)


def ranking_metrics(ranked: DataFrame, gold: DataFrame, queries: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """One row: hit, recall and nDCG at each k, MRR and mean rank of the first hit, over all queries.

    ranked: query_id, doc_id, rank (from 1); gold: query_id, doc_id; queries: query_id.
    Queries without gold count as 0. Misses are 0 in MRR and left out of the mean
    rank. The ideal DCG has min(gold, k) documents; gold is joined to ranks once.
    """
    sizes = gold.groupBy("query_id").agg(F.count("*").alias("golds"))
    return hit_metrics(ranked.join(gold, ["query_id", "doc_id"]), sizes, queries, ks)


def hit_metrics(hits: DataFrame, sizes: DataFrame, queries: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """ranking_metrics where the ranks of hits (query_id, rank) and the number of gold documents (query_id, golds) are known, so gold needn't exist as pairs."""
    ranks = hits.groupBy("query_id").agg(F.array_sort(F.collect_list("rank")).alias("ranks"))
    rows = queries.select("query_id").join(sizes, "query_id", "left").join(ranks, "query_id", "left")
    rows = rows.select("query_id", F.coalesce("golds", F.lit(0)).cast("int").alias("golds"), F.coalesce("ranks", F.array().cast("array<int>")).alias("ranks"))
    gain = lambda ranks: F.aggregate(ranks, F.lit(0.0), lambda acc, r: acc + 1 / F.log2(r + F.lit(1)))
    upto = lambda k: F.filter("ranks", lambda r: r <= k)
    out = []
    for k in ks:
        found = upto(k)
        ideal = gain(F.sequence(F.lit(1), F.least("golds", F.lit(k))))
        per = {"hit": (F.size(found) > 0).cast("double"), "recall": F.size(found) / F.col("golds"), "ndcg": gain(found) / ideal}
        out += [F.coalesce(F.round(F.avg(F.when(F.col("golds") > 0, v).otherwise(0.0)), 6), F.lit(0.0)).alias(f"{name}_{k}") for name, v in per.items()]
    first = F.get("ranks", F.lit(0))
    mrr = F.coalesce(F.round(F.avg(F.coalesce(1 / first, F.lit(0.0))), 6), F.lit(0.0)).alias("mrr")
    return rows.agg(F.count("*").alias("queries"), *out, mrr, F.round(F.avg(first), 6).alias("mean_rank"))


def complete_blocks(rows: DataFrame, key: str, config: str, configs: int, size: int) -> DataFrame:
    """Rows of keys that have all configs, with their batch and blinded letter: letters turn with the key, so a config's letter tells nothing."""
    whole = rows.groupBy(key).agg(F.countDistinct(config).alias("c")).where(F.col("c") == configs).select(key)
    batches = numbered(whole, key, "batch").withColumn("batch", F.floor(F.col("batch") / size).cast("long"))
    place = F.dense_rank().over(W.partitionBy(key).orderBy(config)) - 1
    letter = F.element_at(F.array(*(F.lit(chr(65 + i)) for i in range(configs))), (F.pmod(place + F.pmod(F.col(key), F.lit(configs)), F.lit(configs)) + 1).cast("int"))
    return rows.join(batches, key).withColumn("letter", letter)
