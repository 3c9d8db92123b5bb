"""Dashboards: summary, histograms, volumes, flags and reports, each one aggregate over the queue or its logs."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskloom.functions.vocabulary import BANDS


def share(part: Column, whole: Column, digits: int) -> Column:
    """part / whole, rounded; 0 if there is no whole."""
    return F.when(whole > 0, F.round(part / whole, digits)).otherwise(F.lit(0.0))


def summary(tickets: DataFrame, pending_is_open: bool = False) -> DataFrame:
    """One row: totals by lane and state, and mean confidences.

    pending counts every state but approved and rerouted, sent ones too;
    pending_is_open counts open drafts alone instead.
    """
    pending = F.col("status") == "DRAFT_GENERATED" if pending_is_open else ~F.coalesce(F.col("status").isin("approved", "rerouted"), F.lit(False))
    mean = lambda cond: F.coalesce(F.round(F.avg(F.when(cond, F.col("confidence"))), 4), F.lit(0.0))
    return tickets.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("lane") == "faq").alias("faq"),
        F.count_if(F.col("lane") == "human_review").alias("human_review"),
        F.count_if(F.col("status") == "approved").alias("approved"),
        F.count_if(pending).alias("pending"),
        mean(F.lit(True)).alias("avg_confidence"),
        mean(F.col("lane") == "faq").alias("avg_faq_confidence"),
    )


def band_of(value: Column, bands=BANDS) -> Column:
    """The place of the first band whose bound is above the value; the last band takes the rest, null stays null."""
    chain = reduce(lambda c, ib: c.when(value < ib[1], ib[0]), list(enumerate(b for _, b in bands))[1:-1], F.when(value < bands[0][1], 0))
    return F.when(value.isNotNull(), chain.otherwise(len(bands) - 1))


def confidence_bands(tickets: DataFrame, column: str = "confidence", bands=BANDS) -> DataFrame:
    """(band, label, n) for every band, 0 where none falls into it."""
    counts = tickets.select(band_of(F.col(column), bands).alias("band")).where("band IS NOT NULL").groupBy("band").agg(F.count("*").alias("n"))
    dim = tickets.sparkSession.createDataFrame([(i, label) for i, (label, _) in enumerate(bands)], "band int, label string")
    return dim.join(counts, "band", "left").select("band", "label", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def intent_distribution(tickets: DataFrame) -> DataFrame:
    return tickets.where("intent <> ''").groupBy("intent").agg(F.count("*").alias("n"))


def daily_volume(tickets: DataFrame, as_of: dt.date, days: int = 7) -> DataFrame:
    """(day, n) for the days up to as_of, 0 where nothing came in."""
    first = as_of - dt.timedelta(days=days - 1)
    fits = (F.col("received_at") >= F.lit(dt.datetime.combine(first, dt.time())).cast("timestamp_ntz")) & (
        F.col("received_at") < F.lit(dt.datetime.combine(as_of + dt.timedelta(days=1), dt.time())).cast("timestamp_ntz")
    )
    counts = tickets.where(fits).groupBy(F.to_date("received_at").alias("day")).agg(F.count("*").alias("n"))
    calendar = tickets.sparkSession.range(days).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("day"))
    return calendar.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def win_rates(feedback: DataFrame, untried: float = 0.5) -> DataFrame:
    """(intent, arm, wins, trials, rate): an approved reply is a win and a trial, a rerouted one a trial; other rows count for nothing."""
    won, lost = F.col("status") == "approved", F.col("status") == "rerouted"
    arm = F.when(F.col("lane").isin("faq", "auto_reply"), "auto_reply").otherwise("human_review")
    rates = feedback.groupBy("intent", arm.alias("arm")).agg(F.count_if(won).alias("wins"), F.count_if(won | lost).alias("trials"))
    return rates.withColumn("rate", F.when(F.col("trials") > 0, F.round(F.col("wins") / F.col("trials"), 6)).otherwise(F.lit(untried)))


def flagged(log: DataFrame, tickets: DataFrame, newest: bool = False) -> DataFrame:
    """One row for each flagged e-mail: when it was last flagged, its payloads by kind, and its subject.

    The payload kept is the oldest of its kind, as readers of a newest-first log
    that overwrite get it; newest keeps the newest.
    """
    pick = F.max_by if newest else F.min_by
    payload = lambda kind: pick(F.when(F.col("kind") == kind, F.col("metadata")), F.when(F.col("kind") == kind, F.struct("ts", "id")))
    flags = log.groupBy("email_id").agg(F.max("ts").alias("flagged_at"), payload("near_miss").alias("near_miss"), payload("edited").alias("edited"))
    return flags.join(tickets.select(F.col("id").alias("email_id"), "subject"), "email_id", "left")


def drift(rows: DataFrame, edges: tuple[int, ...] = (1, 7, 30, 365)) -> DataFrame:
    """(bucket, n, least, upper_median, most) of the column days: half-open buckets between the edges; the median is the upper of two."""
    bucket = reduce(lambda c, ie: c.when(F.col("days") < ie[1], ie[0]), list(enumerate(edges))[1:], F.when(F.col("days") < edges[0], 0)).otherwise(len(edges))
    # distinct numbers of days are few: their counts are gathered, not the rows
    counts = rows.where("days IS NOT NULL").groupBy(bucket.alias("bucket"), "days").agg(F.count("*").alias("c"))
    listed = counts.groupBy("bucket").agg(F.sum("c").alias("n"), F.array_sort(F.collect_list(F.struct("days", "c"))).alias("v"))
    upper = F.aggregate(
        "v",
        F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("at")),
        lambda acc, x: F.struct((acc["seen"] + x["c"]).alias("seen"), F.coalesce(acc["at"], F.when(acc["seen"] + x["c"] > F.floor(F.col("n") / 2), x["days"].cast("int"))).alias("at")),
        lambda acc: acc["at"],
    )
    return listed.select("bucket", "n", F.col("v")[0]["days"].cast("int").alias("least"), upper.alias("upper_median"), F.element_at("v", -1)["days"].cast("int").alias("most"))


def year_profile(rows: DataFrame, key: str, least_share: float = 0.05, persistent: int = 3) -> DataFrame:
    """For each key: years that hold least_share of its rows or more, the largest share, and whether those years are persistent or more."""
    years = rows.groupBy(key, "year").agg(F.count("*").alias("c"))
    total = years.groupBy(key).agg(F.sum("c").alias("total"))
    shares = years.join(total, key).withColumn("share", F.col("c") / F.col("total"))
    out = shares.groupBy(key).agg(F.count_if(F.col("share") >= least_share).alias("years"), F.round(F.max("share"), 2).alias("max_share"))
    return out.withColumn("persistent", F.col("years") >= persistent)


def contract_report(drafts: DataFrame) -> DataFrame:
    """One row: shares of drafts (leaks array, placeholders array, has_notes) with leaks and with placeholders, and their numbers."""
    leaks, holes = F.size("leaks") > 0, F.size("placeholders") > 0
    n = F.count("*")
    return drafts.agg(
        n.alias("drafts"),
        F.round(100 * share(F.count_if(leaks), n, 6), 1).alias("pct_leaks"),
        F.round(100 * share(F.count_if(holes), n, 6), 1).alias("pct_placeholders"),
        F.coalesce(F.sum(F.size("placeholders")), F.lit(0)).cast("long").alias("placeholders"),
        F.count_if(F.col("has_notes") & ~holes).alias("unpaired_notes"),
    )


def template_groups(rows: DataFrame, key: Column, order: str, text: str) -> DataFrame:
    """(template, n, first): texts with the same key, and the first of them."""
    return rows.groupBy(key.alias("template")).agg(F.count("*").alias("n"), F.min_by(text, order).alias("first"))


def label_index(rows: DataFrame, labels: str, key: str, vocabulary: DataFrame) -> DataFrame:
    """(label, keys): for every label of the vocabulary the keys that bear it, in order; empty where none does."""
    pairs = rows.select(F.explode(labels).alias("label"), key).distinct().groupBy("label").agg(F.array_sort(F.collect_list(key)).alias("keys"))
    return vocabulary.select("label").join(pairs, "label", "left").select("label", F.coalesce("keys", F.array().cast(pairs.schema["keys"].dataType)).alias("keys"))


def group_report(rows: DataFrame, group: str, key: str) -> DataFrame:
    """For each group: rows, distinct keys, and the least and largest of them."""
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.countDistinct(key).alias("keys"), F.min(key).alias("first"), F.max(key).alias("last"))
