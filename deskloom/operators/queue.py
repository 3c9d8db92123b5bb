"""The ticket queue: filters, pages, facets and counts.

Every filter is a condition or None, for not applied, so a page, its total and
its facets share one list of conditions and Spark pushes them into the scan.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a bucket of ticket states stands for; other states stand for themselves.
BUCKETS = {"solved": ("solved", "closed")}
#: Rows of a page.
LEAST_PAGE, MOST_PAGE = 1, 200


def all_of(conditions: list[Column | None]) -> Column:
    """All conditions that are there."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def in_bucket(column: str, bucket: str | None) -> Column | None:
    return None if bucket is None else F.col(column).isin(*BUCKETS.get(bucket, (bucket,)))


def parse_bound(value: str | None, end: bool = False) -> dt.datetime | None:
    """A bound of a time range in UTC. A bare date means the whole day; naive times are UTC; anything else raises ValueError."""
    if value is None:
        return None
    if len(value) == 10:
        day = dt.datetime.fromisoformat(value)
        return day + dt.timedelta(days=1, microseconds=-1) if end else day
    at = dt.datetime.fromisoformat(value.replace("Z", "+00:00"))
    return at.astimezone(dt.UTC).replace(tzinfo=None) if at.tzinfo else at


def in_range(column: str, after: str | None, before: str | None) -> Column | None:
    """after <= column <= before, either end open; an empty range raises ValueError."""
    low, high = parse_bound(after), parse_bound(before, end=True)
    if low and high and low > high:
        raise ValueError("the range ends before it begins")
    ends = [F.col(column) >= F.lit(low).cast("timestamp_ntz") if low else None, F.col(column) <= F.lit(high).cast("timestamp_ntz") if high else None]
    return all_of(ends) if low or high else None


def matches(term: str | None, *columns: str) -> Column | None:
    """Any of the columns contains the term, whatever its case. One leading # is dropped; % and _ are wildcards; an empty term is off."""
    if not term:
        return None
    pattern = f"%{term.removeprefix('#')}%"
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c).cast("string").ilike(pattern), F.lit(False)) for c in columns])


def owned_by(owner: int | str | None) -> Column | None:
    if owner is None:
        return None
    return F.col("owner_id").isNull() if owner == "unassigned" else F.col("owner_id") == int(owner)


def queue_conditions(lane=None, owner=None, status=None, source=None, ticket_status=None, after=None, before=None, search=None) -> list[Column | None]:
    """The queue's filters, all optional."""
    equal = lambda name, value: None if value is None else F.col(name) == value
    return [
        equal("lane", lane),
        owned_by(owner),
        equal("status", status),
        equal("source", source),
        in_bucket("ticket_status", ticket_status),
        in_range("received_at", after, before),
        matches(search, "subject", "sender", "ticket_id"),
    ]


def page(rows: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """The newest rows first. Spark keeps only limit + offset rows of each partition."""
    if not LEAST_PAGE <= limit <= MOST_PAGE or offset < 0:
        raise ValueError("limit must be 1 to 200, offset at least 0")
    return rows.orderBy(F.desc("received_at"), F.desc("id")).offset(offset).limit(limit)


def facets(rows: DataFrame, conditions: list[Column | None], ticket_source: str) -> DataFrame:
    """(facet, value, n): ticket states of one source, sources under the conditions, and all sources there are.

    conditions must not hold the facets' own dimensions. One pass: each row counts
    for up to three groups, as under grouping sets.
    """
    fits = all_of(conditions)
    state = F.when(F.col("ticket_status").isin(*BUCKETS["solved"]), "solved").otherwise(F.col("ticket_status"))
    groups = F.array(
        F.struct(F.lit("ticket_status").alias("facet"), F.when(fits & (F.col("source") == ticket_source) & (state != ""), state).alias("value"), F.lit(1).alias("one")),
        F.struct(F.lit("source").alias("facet"), F.when(fits, F.col("source")).alias("value"), F.lit(1).alias("one")),
        F.struct(F.lit("sources").alias("facet"), F.col("source").alias("value"), F.lit(0).alias("one")),
    )
    rows = rows.select(F.explode(groups).alias("g")).select("g.*").where("value IS NOT NULL")
    return rows.groupBy("facet", "value").agg(F.sum("one").alias("n"))


def count_by(rows: DataFrame, column: str, nulls: bool = True) -> DataFrame:
    rows = rows if nulls else rows.where(F.col(column).isNotNull())
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def open_drafts(rows: DataFrame) -> DataFrame:
    """Drafts that can still be redone: a null ticket state is open."""
    return rows.where((F.col("status") == "DRAFT_GENERATED") & (F.col("ticket_status").isNull() | ~F.col("ticket_status").isin(*BUCKETS["solved"])))


def by_key(rows: DataFrame, column: str, key: str) -> DataFrame:
    """The row of a key given as text; a key that isn't a number finds nothing."""
    return rows.where(F.col(column) == F.expr(f"try_cast('{key}' AS BIGINT)") if key.lstrip("-").isdigit() else F.lit(False))


def by_keys(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose key is in keys, whatever their state."""
    return rows.join(keys.select(column), column, "left_semi")


def not_in(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose key isn't in keys; rows without a key stay."""
    return rows.join(keys.select(column), column, "left_anti")


def parse_states(text: str | None, known: tuple[str, ...]) -> list[str]:
    """Ticket states from a comma-separated list: trimmed, lower-cased, each once; empty means all, an unknown one raises ValueError."""
    states = list(dict.fromkeys(x for part in (text or "").split(",") if (x := part.strip().lower())))
    if strange := [x for x in states if x not in known]:
        raise ValueError(f"unknown states: {strange}")
    return states


def allowed_states(rows: DataFrame, text: str | None, known: tuple[str, ...]) -> DataFrame:
    """Rows in the listed states; deleted ones never."""
    states = parse_states(text, known)
    kept = rows.where("ticket_status IS DISTINCT FROM 'deleted'")
    return kept.where(F.col("ticket_status").isin(*states)) if states else kept


def audit_rows(log: DataFrame, email_id: str | None = None, action: str | None = None, actor: str | None = None) -> DataFrame:
    """Audit rows under all given filters; an email_id that isn't a number finds nothing."""
    rows = log if email_id is None else by_key(log, "email_id", email_id)
    return rows.where(all_of([None if action is None else F.col("action") == action, None if actor is None else F.col("actor") == actor]))


def audit_search(log: DataFrame, term: str) -> DataFrame:
    """Audit rows whose action, actor and email_id contain the term, whatever its case."""
    return log.where(F.lower(F.concat_ws(" ", "action", "actor", F.col("email_id").cast("string"))).contains(term.lower()))


def recent(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def cut_by_date(rows: DataFrame, column: str, cutoff: str) -> DataFrame:
    """rows with is_new: on or after the cutoff; a null date isn't."""
    return rows.withColumn("is_new", F.coalesce(F.col(column) >= F.lit(parse_bound(cutoff)).cast("timestamp_ntz"), F.lit(False)))


def reassigned_from(log: DataFrame, field: str = "k") -> DataFrame:
    """(owner, n): audit rows by the owner named in their JSON; a missing one, null and text that isn't a number are unassigned."""
    owner = F.expr(f"try_cast(get_json_object(metadata, '$.{field}') AS BIGINT)")
    return log.groupBy(F.coalesce(owner.cast("string"), F.lit("unassigned")).alias("owner")).agg(F.count("*").alias("n"))


def roster_counts(roster: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """roster with n from counts, 0 where there is none."""
    return roster.join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
