"""Threads: transcripts within a budget, first and latest messages, runs, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deskloom.stores import numbered_by, stored

#: What stands for the messages that were left out.
OMITTED = "[… %s earlier message(s) omitted …]"


def trimmed(text: Column) -> Column:
    """Without white space at both ends; null stays null."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def transcripts(messages: DataFrame, budget: int, order: str = "turn") -> DataFrame:
    """(email_id, text, included, omitted, latest_request) of each thread's public messages with text.

    Newest first, messages are kept while their lengths and a blank line each fit
    the budget. The newest is kept in any case, cut to the budget. A thread's order
    is that of the column order, null last.
    """
    label = F.when(F.col("role") == "user", "Requester").otherwise("Support")
    rows = messages.where("public").withColumn("body", trimmed(F.col("body"))).where("body <> ''")
    rows = rows.select("email_id", "role", "body", F.col(order).alias("o"), F.concat(label, F.lit(": "), F.col("body")).alias("block"))
    newest = W.partitionBy("email_id").orderBy(F.desc_nulls_first("o"), F.desc("block"))
    used = F.sum(F.char_length("block") + 2).over(newest.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("place", F.row_number().over(newest)).withColumn("used", used)
    keeps = (F.col("used") <= budget) | (F.col("place") == 1)
    block = F.struct((-F.col("place")).alias("p"), F.substring("block", 1, budget).alias("block"))
    out = rows.groupBy("email_id").agg(
        F.count("*").alias("visible"),
        F.count_if(keeps).alias("included"),
        F.array_sort(F.collect_list(F.when(keeps, block))).alias("blocks"),
        F.min_by(F.when(F.col("role") == "user", F.col("body")), F.when(F.col("role") == "user", F.col("place"))).alias("latest_request"),
    )
    omitted = F.col("visible") - F.col("included")
    head = F.when(omitted > 0, F.array(F.format_string(OMITTED, omitted.cast("string")))).otherwise(F.array().cast("array<string>"))
    text = F.array_join(F.concat(head, F.transform("blocks", lambda b: b["block"])), "\n\n")
    return out.select("email_id", text.alias("text"), "included", omitted.alias("omitted"), F.coalesce("latest_request", F.lit("")).alias("latest_request"))


def first_inquiry(messages: DataFrame, requesters: DataFrame, null_matches: bool = True) -> DataFrame:
    """(email_id, turn, body): each thread's first public message by its requester (requesters: email_id, requester_id).

    null_matches: an unknown author counts as the unknown requester.
    """
    same = F.col("author_id").eqNullSafe(F.col("requester_id")) if null_matches else F.col("author_id") == F.col("requester_id")
    rows = messages.where("public AND turn IS NOT NULL").join(requesters, "email_id").where(same)
    return rows.groupBy("email_id").agg(F.min(F.struct("turn", "body")).alias("m")).select("email_id", "m.turn", "m.body")


def first_exchange(messages: DataFrame) -> DataFrame:
    """(email_id, question, answer): the first message of the requester, and the first of support."""
    pick = lambda role: F.min_by(F.when(F.col("role") == role, F.col("body")), F.when(F.col("role") == role, F.col("turn")))
    return messages.where("public").groupBy("email_id").agg(pick("user").alias("question"), pick("assistant").alias("answer"))


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Each key's last row in the order of the columns."""
    found = rows.groupBy(key).agg(F.max_by(F.struct("*"), F.struct(*order)).alias("r"))
    return found.select("r.*")


def runs(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """rows with run_length: how many equal values stand together, in each key's order."""
    w = W.partitionBy(key).orderBy(order)
    changed = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(1))
    first = F.when(F.row_number().over(w) == 1, 1).otherwise(changed)
    numbered = rows.withColumn("__run", F.sum(first).over(w))
    return numbered.withColumn("run_length", F.count("*").over(W.partitionBy(key, "__run"))).drop("__run")


def spaced_sample(rows: DataFrame, stratum: str, order: str, n: int) -> DataFrame:
    """n rows of each stratum, evenly spaced in its order: those at int(i * size / n); all rows of small strata."""
    at = F.row_number().over(W.partitionBy(stratum).orderBy(order)) - 1
    rows = rows.withColumn("__at", at).withColumn("__size", F.count("*").over(W.partitionBy(stratum)))
    # at is int(i * size / n) for some i if the next multiple of size / n from it on is below at + 1
    i = F.ceil(F.col("__at") * n / F.col("__size"))
    chosen = (F.col("__size") <= n) | ((i < n) & (F.floor(i * F.col("__size") / n) == F.col("__at")))
    return rows.where(chosen).drop("__at", "__size")


def quota(rows: DataFrame, cell: list[str], preferred: Column, key: str, n: int) -> DataFrame:
    """n rows of each cell, preferred ones first, then by key."""
    place = F.row_number().over(W.partitionBy(*cell).orderBy(preferred.desc(), key))
    return rows.withColumn("place", place).where(F.col("place") <= n)


def numbered(rows: DataFrame, order: str, name: str, ranges: int = 200) -> DataFrame:
    """rows with name: their places from 0 by order (a number, date or timestamp; nulls first), without one task that sees all.

    Cut points part the rows into ranges, each of which numbers its own and starts
    where the earlier ones end; rows of one value of order lie in one range.
    """
    shares = [i / ranges for i in range(1, ranges)]
    cuts = rows.agg(F.percentile_approx(order, shares, 100 * ranges).alias("cuts")).first()["cuts"] or []
    # a null passes no cut, so it lies in the first range
    parts = rows.withColumn("__range", F.size(F.filter(F.array(*(F.lit(c) for c in sorted(set(cuts)))), lambda c: c < F.col(order))) if cuts else F.lit(0))
    sizes = parts.groupBy("__range").agg(F.count("*").alias("__n"))
    starts = sizes.select("__range", F.coalesce(F.sum("__n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    place = F.row_number().over(W.partitionBy("__range").orderBy(order)) - 1 + F.col("__start")
    return parts.join(F.broadcast(starts), "__range").withColumn(name, place.cast("long")).drop("__range", "__start")


def deal(rows: DataFrame, order: str, hands: int) -> DataFrame:
    """rows with batch: dealt out in turn."""
    return numbered(rows, order, "batch").withColumn("batch", F.pmod("batch", F.lit(hands)))


def assign_once(rows: DataFrame, rules: list[tuple[str, Column, int]], key: str) -> DataFrame:
    """(key, category): each rule in turn takes its first rows, by key, of those that no earlier rule took."""
    left, out = rows, None
    for name, fits, n in rules:
        taken = left.where(fits).orderBy(key).limit(n).select(key, F.lit(name).alias("category"))
        left = left.join(taken, key, "left_anti")
        out = taken if out is None else out.unionByName(taken)
    return out


def with_results(emails: DataFrame, messages: DataFrame) -> DataFrame:
    """emails with their messages as an array in order; none where there is none."""
    nested = messages.groupBy("email_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "body"))).alias("thread"))
    return emails.join(nested, "email_id", "left").withColumn("thread", F.coalesce("thread", F.array().cast(nested.schema["thread"].dataType)))


def people_once(people: Column) -> Column:
    """People (name, email, ...), each once by name and email whatever their case, as they come."""
    key = lambda p: F.lower(F.concat_ws("\x00", F.coalesce(p["name"], F.lit("")), F.coalesce(p["email"], F.lit(""))))
    return F.filter(people, lambda p, i: F.array_position(F.transform(people, key), key(p)) == i + 1)


def notes_of(messages: DataFrame, authors: list[int], after, before) -> DataFrame:
    """Messages that are surely internal, by the authors and within the turns: a message whose flag is missing isn't."""
    return messages.where((F.col("public") == F.lit(False)) & F.col("author_id").isin(*authors) & F.col("turn").between(after, before))


def dealt_pairs(rows: DataFrame, same: Column, month: str, key: str, least: int, most: int, size: int) -> DataFrame:
    """(key, month, frequency, batch): templates and single letters, dealt out in turn to batches of size at most.

    Rows that are the same are one, the one with the smallest key, and a template if
    there are least of them. What templates leave of most is shared out to the months by
    their singles, one at least, and each month's share is taken evenly from its singles
    by key. Templates come first, the most frequent ones leading, then singles by month
    and key. key is unique; null months are a month.
    """
    kinds = rows.groupBy(same.alias("__same")).agg(F.min_by(F.struct(key, month), key).alias("__r"), F.count("*").alias("frequency")).select(f"__r.{key}", f"__r.{month}", "frequency")
    kinds = stored(kinds, "kinds")
    templates, singles = kinds.where(F.col("frequency") >= least), kinds.where(F.col("frequency") < least)
    budget, total = most - templates.count(), singles.count()
    placed = numbered_by(singles, "__place", month, key)
    months = placed.groupBy(month).agg(F.min("__place").alias("__first"), F.count("*").alias("__n")).withColumnRenamed(month, "__month")
    share = F.greatest(F.lit(1), F.bround(F.lit(float(budget)) * F.col("__n") / F.lit(max(total, 1)))).cast("long")
    months = months.withColumn("__share", share).withColumn("__step", F.greatest(F.lit(1), F.floor(F.col("__n") / F.col("__share"))))
    at = F.col("__place") - F.col("__first")
    sampled = placed.join(months, F.col(month).eqNullSafe(F.col("__month"))).where((at % F.col("__step") == 0) & (at < F.col("__step") * F.col("__share")))
    both = templates.select(key, month, "frequency", F.lit(0).alias("__bucket")).unionByName(sampled.select(key, month, "frequency", F.lit(1).alias("__bucket")))
    order = F.struct("__bucket", F.when(F.col("__bucket") == 0, -F.col("frequency")).otherwise(0).alias("n"), F.when(F.col("__bucket") == 1, F.col(month)).alias("m"), key)
    pairs = stored(numbered_by(both.withColumn("__order", order), "batch", "__order"), "pairs")
    return pairs.select(key, month, "frequency", F.pmod("batch", F.lit(max(1, -(-pairs.count() // size)))).alias("batch"))
