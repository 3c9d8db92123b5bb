"""The policy corpus: browsing, lineage, upserts and governance, as changes to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deskloom.functions.text import alike


def root_of(root: str = "root_key", key: str = "policy_key") -> Column:
    """A policy's lineage: its root, or itself where that is null or empty."""
    return F.coalesce(F.nullif(F.col(root), F.lit("")), F.col(key))


def browse(policies: DataFrame, visibility: str | None = None, status: str | None = None, term: str | None = None) -> DataFrame:
    rows = policies
    for column, value in (("visibility", visibility), ("status", status)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    return rows.where(F.col("title").ilike(f"%{term}%") | F.col("content").ilike(f"%{term}%")) if term else rows


def active_corpus(policies: DataFrame, visibilities: tuple[str, ...] = ("public",)) -> DataFrame:
    """What is indexed: active policies of the visibilities."""
    return policies.where((F.col("status") == "active") & F.col("visibility").isin(*visibilities))


def live_tips(policies: DataFrame) -> DataFrame:
    return policies.where("status = 'active' AND superseded_by IS NULL")


def without_lineages(policies: DataFrame, excluded: DataFrame, forced: DataFrame | None = None) -> DataFrame:
    """policies whose lineage isn't among the excluded keys' lineages, and the forced ones; exclusion beats force."""
    rows = policies.withColumn("__root", root_of())
    out = rows.join(excluded.select(root_of().alias("__root")).distinct(), "__root", "left_anti").withColumn("forced", F.lit(False))
    if forced is not None:
        more = forced.withColumn("__root", root_of()).join(excluded.select(root_of().alias("__root")).distinct(), "__root", "left_anti")
        out = out.unionByName(more.join(out, "policy_key", "left_anti").select(*rows.columns).withColumn("forced", F.lit(True)))
    return out.drop("__root")


def would_empty(current: DataFrame, policies: DataFrame, excluded: DataFrame) -> DataFrame:
    """(id, would_empty) for current (id, policy_key rows): whether every key's lineage is excluded."""
    roots = policies.select("policy_key", root_of().alias("root"))
    gone = excluded.select(root_of().alias("root")).distinct().withColumn("gone", F.lit(True))
    rows = current.join(roots, "policy_key", "left").withColumn("root", F.coalesce("root", "policy_key")).join(gone, "root", "left")
    return rows.groupBy("id").agg(F.every(F.coalesce("gone", F.lit(False))).alias("would_empty"))


def upserted(policies: DataFrame, changes: DataFrame, key: str, refreshed: list[str], defaults: dict[str, Column]) -> DataFrame:
    """policies after changes: new keys come in with the defaults, known ones take what changes has for the refreshed columns, nulls leave as is."""
    a, b = policies.alias("a"), changes.alias("b")
    rows = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    known, out = F.col(f"a.{key}").isNotNull(), []
    for c in policies.columns:
        if c == key:
            out.append(F.coalesce(f"a.{key}", f"b.{key}").alias(key))
        elif c in refreshed:
            out.append(F.coalesce(f"b.{c}", f"a.{c}").alias(c))
        elif c in defaults:
            out.append(F.when(known, F.col(f"a.{c}")).otherwise(defaults[c]).alias(c))
        else:
            out.append(F.col(f"a.{c}").alias(c))
    return rows.select(*out)


def inserted_once(stored: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """The rows of batch that are new: keys that are stored go, rows without a key stay; a batch that repeats a key is refused as a whole."""
    new = batch.join(stored.select(key), key, "left_anti")
    twice = new.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").agg(F.count("*").alias("__twice"))
    return new.crossJoin(F.broadcast(twice)).where("__twice = 0").drop("__twice")


def patched(rows: DataFrame, changes: dict[str, Column], allowed: tuple[str, ...]) -> DataFrame:
    """rows with those changes whose columns are allowed."""
    return rows.withColumns({k: v for k, v in changes.items() if k in allowed})


def unlocked(rows: DataFrame, flag: str) -> DataFrame:
    return rows.withColumn(flag, F.lit(False))


def first_claims(claims: DataFrame, key: str = "id") -> DataFrame:
    """claims (id, ts, claimer, ...) with won: of all claims on a row, the earliest wins, as a compare-and-set would decide."""
    order = W.partitionBy(key).orderBy("ts", "claimer")
    return claims.withColumn("won", F.row_number().over(order) == 1)


def after_governance(events: DataFrame) -> DataFrame:
    """(policy_key, status, version) after all events (root_key, seq, action): each edit makes the next version and retires the last, a revert goes back one, delete and reactivate turn the tip off and on.

    Events of a lineage fold in order; a lineage's history is short.
    """
    ordered = events.groupBy("root_key").agg(F.array_sort(F.collect_list(F.struct("seq", "action"))).alias("log"))
    start = F.struct(F.lit(1).alias("tip"), F.lit(1).alias("most"), F.lit(True).alias("on"), F.array(F.lit(0)).alias("back"))

    def step(acc, e):
        edit = F.struct((acc["most"] + 1).alias("tip"), (acc["most"] + 1).alias("most"), F.lit(True).alias("on"), F.concat(acc["back"], F.array(acc["tip"])).alias("back"))
        last = F.element_at(acc["back"], -1)
        can = (last > 0) & (e["action"] == "revert")
        undo = F.struct(F.when(can, last).otherwise(acc["tip"]).alias("tip"), acc["most"].alias("most"), (acc["on"] | can).alias("on"), F.when(can, F.slice(acc["back"], 1, F.size(acc["back"]) - 1)).otherwise(acc["back"]).alias("back"))
        turn = F.struct(acc["tip"].alias("tip"), acc["most"].alias("most"), F.when(e["action"] == "delete", F.lit(False)).when(e["action"] == "reactivate", F.lit(True)).otherwise(acc["on"]).alias("on"), acc["back"].alias("back"))
        return F.when(e["action"] == "edit", edit).when(e["action"] == "revert", undo).otherwise(turn)

    state = ordered.select("root_key", F.aggregate("log", start, step).alias("s"))
    rows = state.select("root_key", "s", F.explode(F.sequence(F.lit(1), F.col("s.most"))).alias("version"))
    key = F.when(F.col("version") == 1, F.col("root_key")).otherwise(F.concat("root_key", F.lit("__v"), F.col("version").cast("string")))
    return rows.select(key.alias("policy_key"), F.when((F.col("version") == F.col("s.tip")) & F.col("s.on"), "active").otherwise("inactive").alias("status"), "version")


def slugs(rows: DataFrame, title: str, key: str) -> DataFrame:
    """rows with slug: the title in lower case with dashes; of equal ones, the second and later get -2, -3 and so on, by key."""
    base = F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(F.col(title)), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), F.lit("")), F.lit("policy"))
    place = F.row_number().over(W.partitionBy("__base").orderBy(key))
    return rows.withColumn("__base", base).withColumn("slug", F.when(place == 1, F.col("__base")).otherwise(F.concat("__base", F.lit("-"), place.cast("string")))).drop("__base")


def pruned_conflicts(reports: DataFrame, tips: DataFrame) -> DataFrame:
    """reports (id, keys) with kept: the keys that are live tips, in order, and a summary of their number."""
    rows = reports.select("id", F.posexplode_outer("keys").alias("pos", "policy_key")).join(tips.select("policy_key", F.lit(True).alias("live")), "policy_key", "left")
    kept = F.array_sort(F.collect_list(F.when(F.col("live"), F.struct("pos", "policy_key"))))
    out = rows.groupBy("id").agg(F.transform(kept, lambda x: x["policy_key"]).alias("kept"))
    return out.withColumn("summary", F.when(F.size("kept") == 0, "No conflicts.").otherwise(F.concat(F.size("kept").cast("string"), F.lit(" conflict(s)."))))


def review_state(log: DataFrame, key: str) -> DataFrame:
    """(key, state, changes): the last state of each suggestion, and how many there were."""
    return log.groupBy(key).agg(F.max_by("action", F.struct("ts", "id")).alias("state"), F.count("*").alias("changes"))


def backfilled(rows: DataFrame, target: str, source: str) -> DataFrame:
    """rows where source would change target, with the new value: source is there and differs, null counting as a value."""
    return rows.where(F.col(source).isNotNull() & ~F.col(target).eqNullSafe(F.col(source))).withColumn(target, F.col(source))


def learned(suggestions: DataFrame, candidates: DataFrame, least: float = 0.82) -> DataFrame:
    """suggestions (id, title, content, seen_count) after candidates (id, title, content, edited, had_placeholder).

    Only candidates from edited drafts with a placeholder count. One whose title and
    content are similar enough, by characters, to a suggestion raises the count of the
    first such; any other comes in, seen once, under its own id. Candidates meet the
    suggestions whose length lets them be similar enough, by a join on its logarithm.
    """
    import math
    from collections.abc import Iterator

    import numpy as np
    import pandas as pd

    step = math.log(1.01 * (2 - least) / least)  # lengths further apart than this can't reach least

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [f"{title}\n{content}".lower() for title, content in zip(batch["title"], batch["content"])]
            yield batch.assign(lower=texts, size=[math.floor(math.log(len(t)) / step) for t in texts])

    def similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = [alike(text, other, least) for text, other in zip(batch["lower"], batch["other"])]
            yield batch.loc[np.array(good, bool), ["row", "hit"]]

    fields = "id long, title string, content string, lower string, size long"
    known = suggestions.select("id", "title", "content").mapInPandas(keyed, fields).select(F.col("id").alias("hit"), F.col("lower").alias("other"), "size")
    asked = candidates.where("edited AND had_placeholder").select("id", "title", "content")
    # equal candidates are one row here, so that it has a key
    asked = asked.groupBy("id", "title", "content").agg(F.count("*").alias("times")).withColumn("row", F.xxhash64("id", "title", "content"))
    near = asked.select("id", "title", "content", "row").mapInPandas(keyed, f"{fields.replace('lower', 'row long, lower')}")
    near = near.select("row", "lower", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)).alias("size"))
    hits = near.join(known, "size").select("row", "lower", "hit", "other").mapInPandas(similar, "row long, hit long").groupBy("row").agg(F.min("hit").alias("hit"))
    rows = asked.join(hits, "row", "left").withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    more = rows.where("hit IS NOT NULL").groupBy(F.col("hit").alias("id")).agg(F.count("*").alias("more"))
    raised = suggestions.join(more, "id", "left").select("id", "title", "content", (F.col("seen_count") + F.coalesce("more", F.lit(0))).cast("long").alias("seen_count"))
    return raised.unionByName(rows.where("hit IS NULL").select("id", "title", "content", F.lit(1).cast("long").alias("seen_count")))
