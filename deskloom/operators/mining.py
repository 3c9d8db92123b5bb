"""Mining threads and embeddings: filters, cluster profiles, similarity."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deskloom.stores import stored

#: Terms with their numbers of documents that are broadcast at most; more meet their rows by a shuffle.
MOST_TERMS = 1_000_000

#: Groups whose rows are looked up by a broadcast at most; more meet their rows by a shuffle.
MOST_GROUPS = 100_000

def noise_reason(channel: Column, text: Column, notice: str = r"(?i)automatic (reply|notice)|do not reply", forward: str = r"(?i)^\s*fwd?:") -> Column:
    """Why a row is noise, the first reason that holds, or null."""
    return F.when(channel == "api", "api").when(F.length(F.trim(text)) < 40, "short").when(text.rlike(notice), "notice").when(text.rlike(forward) & (F.length(text) < 200), "forward")


def without_tags(rows: DataFrame, tags: str, excluded: tuple[str, ...]) -> DataFrame:
    return rows.where(~F.coalesce(F.arrays_overlap(tags, F.array(*(F.lit(t) for t in excluded))), F.lit(False)))


def pure_merges(messages: DataFrame, pattern: str) -> DataFrame:
    """(email_id, target) of threads whose every answer says that it was merged elsewhere, with the first target; threads without answers aren't merges."""
    rows = messages.where("role = 'assistant'").withColumn("target", F.nullif(F.regexp_extract("body", pattern, 1), F.lit("")))
    found = rows.groupBy("email_id").agg(F.every(F.col("target").isNotNull()).alias("all"), F.min_by("target", "turn").alias("target"))
    return found.where("all").select("email_id", "target")


def first_fitting(rows: DataFrame, categories: list[tuple[str, Column]]) -> DataFrame:
    chain = reduce(lambda c, nf: c.when(nf[1], nf[0]), categories[1:], F.when(categories[0][1], categories[0][0]))
    return rows.withColumn("category", chain)


def overlap(a: Column, b: Column) -> Column:
    """How many distinct words two texts share."""
    words = lambda t: F.array_distinct(F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != ""))
    return F.size(F.array_intersect(words(a), words(b)))


def tfidf_terms(docs: DataFrame, cluster: str, doc: str, tokens: Column, n: int = 5, least_df: int = 5, most_share: float = 0.5) -> DataFrame:
    """(cluster, term, weight, place): each cluster's n terms of the largest mean weight; smooth idf, rows of length 1, terms in least_df documents or more and most_share of them at most."""
    total = docs.count()
    # rows of a document meet by its text's shuffle; its terms, their weights and its norm need no other
    counts = docs.repartition(doc).select(cluster, doc, F.explode(tokens).alias("term")).groupBy(cluster, doc, "term").agg(F.count("*").alias("tf"))
    df = stored(counts.groupBy("term").agg(F.count("*").alias("df")).where((F.col("df") >= least_df) & (F.col("df") <= most_share * total)), "df")
    known = F.broadcast(df) if df.count() <= MOST_TERMS else df.hint("merge")
    rows = counts.join(known, "term").withColumn("w", F.col("tf") * (F.log((1.0 + total) / (1 + F.col("df"))) + 1))
    rows = rows.withColumn("norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(doc))))
    sizes = docs.groupBy(cluster).agg(F.count("*").alias("size"))
    means = rows.groupBy(cluster, "term").agg(F.sum(F.col("w") / F.col("norm")).alias("s")).join(sizes, cluster)
    means = means.select(cluster, "term", F.round(F.col("s") / F.col("size"), 6).alias("weight"))
    return means.withColumn("place", F.row_number().over(W.partitionBy(cluster).orderBy(F.desc("weight"), "term"))).where(F.col("place") <= n)


def centroids(vectors: DataFrame, group: str = "label", vector: str = "embedding") -> DataFrame:
    """(group, centroid, size): mean vectors, by one aggregate for each coordinate."""
    rows = vectors.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("size"))
    return rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c"), F.max("size").alias("size")).select(group, F.transform("c", lambda x: x["m"]).alias("centroid"), "size")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def close_groups(means: DataFrame, group: str = "label", least: float = 0.85) -> DataFrame:
    """(a, b, similarity) of groups whose centroids are similar; there is one row a group on either side."""
    a, b = means.select(F.col(group).alias("a"), F.col("centroid").alias("x")), means.select(F.col(group).alias("b"), F.col("centroid").alias("y"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(cosine(F.col("x"), F.col("y")), 4).alias("similarity")).where(F.col("similarity") >= least)


def representatives(vectors: DataFrame, means: DataFrame, n: int, key: str = "vec_id", group: str = "label", vector: str = "embedding") -> DataFrame:
    """(group, key, similarity, place): the n vectors closest to each centroid."""
    rows = vectors.join(F.broadcast(means.select(group, "centroid")), group).select(group, key, F.round(cosine(F.col(vector), F.col("centroid")), 5).alias("similarity"))
    return rows.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(F.desc("similarity"), key))).where(F.col("place") <= n)


def coverage(best: DataFrame, least: float = 0.35) -> DataFrame:
    """One row: the mean of the best scores (query_id, score), and the share below least."""
    top = best.groupBy("query_id").agg(F.max("score").alias("s"))
    return top.agg(F.round(F.avg("s"), 4).alias("mean_best"), F.round(F.avg((F.col("s") < least).cast("int")), 4).alias("low_share"))


def renumbered(rows: DataFrame, group: str) -> DataFrame:
    """rows with cluster_no: groups by falling size, of equal ones the smaller first."""
    order = rows.groupBy(group).agg(F.count("*").alias("size")).withColumn("cluster_no", F.row_number().over(W.orderBy(F.desc("size"), group)).cast("long"))
    return rows.join(order.select(group, "cluster_no"), group)


def kmeans(vectors: DataFrame, k: int, seed: int = 42, vector: str = "embedding") -> DataFrame:
    """vectors with cluster."""
    rows = vectors.withColumn("__x", array_to_vector(F.col(vector).cast("array<double>")))
    return KMeans(k=k, seed=seed, featuresCol="__x", predictionCol="cluster").fit(rows).transform(rows).drop("__x")


def trained_labels(vectors: DataFrame, label: str = "label", vector: str = "embedding", c: float = 1.0, top: int = 3) -> DataFrame:
    """vectors with predicted: the top labels of a logistic regression with their probabilities, likeliest first."""
    rows = vectors.withColumn("__x", array_to_vector(F.col(vector).cast("array<double>"))).withColumn("__y", F.col(label).cast("double"))
    model = LogisticRegression(featuresCol="__x", labelCol="__y", regParam=1.0 / (c * max(1, rows.count())), maxIter=50).fit(rows)
    p = F.transform(vector_to_array("probability"), lambda x, i: F.struct((-F.round(x, 6)).alias("m"), i.alias("label")))
    best = F.transform(F.slice(F.array_sort(p), 1, top), lambda x: F.struct(x["label"].alias("label"), (-x["m"]).alias("p")))
    return model.transform(rows).withColumn("predicted", best).drop("__x", "__y", "rawPrediction", "probability", "prediction")


def isotonic(rows: DataFrame, p: str = "p", truth: str = "truth") -> DataFrame:
    """rows with calibrated: monotone in p. One class alone gives its rate."""
    values = rows.agg(F.countDistinct(truth), F.avg(truth)).first()
    if values[0] < 2:
        return rows.withColumn("calibrated", F.lit(float(values[1]) if values[1] is not None else None).cast("double"))
    data = rows.withColumn("__y", F.col(truth).cast("double"))
    return IsotonicRegression(featuresCol=p, labelCol="__y", predictionCol="calibrated").fit(data).transform(data).drop("__y")


def platt(rows: DataFrame, p: str = "p", truth: str = "truth") -> DataFrame:
    """rows with calibrated: a logistic curve of p, its slope under a unit penalty. One class alone gives its rate, a null p null."""
    values = rows.where(F.col(p).isNotNull() & F.col(truth).isNotNull())
    n, kinds, rate = values.agg(F.count("*"), F.countDistinct(truth), F.avg(truth)).first()
    if kinds < 2:
        return rows.withColumn("calibrated", F.lit(float(rate) if n else None).cast("double"))
    data = values.select(F.array(F.col(p).cast("double")).alias("x"), F.col(truth).cast("double").alias("__y")).select(array_to_vector("x").alias("__x"), "__y")
    model = LogisticRegression(featuresCol="__x", labelCol="__y", regParam=1.0 / n, standardization=False, maxIter=1000, tol=1e-9).fit(data)
    slope, shift = float(model.coefficients[0]), float(model.intercept)
    return rows.withColumn("calibrated", 1 / (1 + F.exp(-(F.lit(slope) * F.col(p) + F.lit(shift)))))


def kmeans_by_silhouette(vectors: DataFrame, ks: tuple[int, ...] = (12, 20, 28, 36), seed: int = 42, vector: str = "embedding") -> tuple[DataFrame, dict[int, float]]:
    """kmeans for that k of ks with the best mean silhouette (squared distances), of equal ones the first, and the silhouettes by k. Every vector counts."""
    rows = vectors.withColumn("__x", array_to_vector(F.col(vector).cast("array<double>")))
    judge, found, best = ClusteringEvaluator(featuresCol="__x", predictionCol="cluster"), {}, None
    for k in ks:
        model = KMeans(k=k, seed=seed, featuresCol="__x", predictionCol="cluster").fit(rows)
        found[k] = judge.evaluate(model.transform(rows))
        if best is None or found[k] > found[best[0]]:
            best = k, model
    return best[1].transform(rows).drop("__x"), found


def rounded(value: Column, digits: int) -> Column:
    """value rounded half up after it is scaled, as SQL engines do: round() itself goes by the shortest decimal, and differs near the middle of two roundings."""
    scaled = value * 10.0**digits
    # from there on doubles have no more digits
    return F.when(F.abs(scaled) < 2.0**52, F.round(scaled) / 10.0**digits).otherwise(value)


def rounded_means(rows: DataFrame, keys: list[str], value: str, place: list[str], digits: int, mean: str, size: str, most: int = MOST_GROUPS) -> DataFrame:
    """(keys, mean, size): each group's rows and the rounded mean of its doubles, added in the order of place, whatever the partitions. Any order does where the mean is so far from the middle of two roundings that no order reaches it; the other groups' rows are sorted."""
    scaled = F.abs(mean) * 10.0**digits
    error = 2.0**-51 * (F.col(size) + 2) * F.col("__far") * 10.0**digits  # twice what two orders can differ by
    doubt = F.coalesce((F.abs(scaled % 1 - 0.5) <= error) | (error >= 0.5), F.lit(False))
    means = rows.groupBy(*keys).agg(F.avg(value).alias(mean), F.count("*").alias(size), F.avg(F.abs(value)).alias("__far"))
    means = stored(means.withColumn("__doubt", doubt).drop("__far"), "means")
    open_ = means.where("__doubt").select(*(F.col(k).alias(f"__{k}") for k in keys), size)
    open_ = F.broadcast(open_) if open_.count() <= most else open_.hint("merge")
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    order = W.partitionBy(*keys).orderBy(*place)
    so_far = F.avg(value).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    added = rows.join(open_, same).select(*keys, so_far.alias(mean), size, F.row_number().over(order).alias("__row")).where(F.col("__row") == F.col(size))
    return means.where("NOT __doubt").drop("__doubt").unionByName(added.drop("__row")).withColumn(mean, rounded(F.col(mean), digits))


def chosen_trials(trials: DataFrame, group: str, plateau: float = 0.01) -> DataFrame:
    """Each group's chosen trial (coverage, run_length, size): the best coverage within plateau, then the longest run, then the smallest size."""
    best = F.max("coverage").over(W.partitionBy(group))
    near = trials.withColumn("__best", best).where(F.col("coverage") >= F.col("__best") - plateau).drop("__best")
    return near.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(F.desc("run_length"), "size"))).where("place = 1").drop("place")
