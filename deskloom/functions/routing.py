"""Classification and routing rules as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskloom.functions.vocabulary import FALLBACK_INTENT, INTENT_NAMES, KEYWORDS, LANE_FAQ, LANE_HUMAN

THRESHOLD, ANSWER_THRESHOLD, NEAR, FLOOR, EXPLORE = 0.65, 0.85, 0.15, 0.4, 0.15


def keyword_scores(subject: Column, body: Column) -> Column:
    """One struct (score, place, intent) for each intent, of lower-cased fields without nulls: a cue in one field counts 1, in both 1.5."""
    points = lambda acc, cue: acc + F.when(subject.contains(cue), F.when(body.contains(cue), 1.5).otherwise(1.0)).when(body.contains(cue), 1.0).otherwise(0.0)
    out = []
    for place, name in enumerate(INTENT_NAMES):
        # a fold over the cues stays small, where a sum of one term for each cue outgrows what the JVM compiles
        score = F.aggregate(F.array(*(F.lit(cue) for cue in KEYWORDS[name])), F.lit(0.0), points)
        out.append(F.struct((-score).alias("minus"), F.lit(place).alias("place"), F.lit(name).alias("intent")))
    return F.array(*out)


def classified(rows: DataFrame, subject: str = "subject", body: str = "body") -> DataFrame:
    """rows with intent, confidence and secondary (at most two runners-up).

    Confidence is a fifth of the score, 0.95 at most, less 0.15 if the two best are
    nearly tied; without any cue it is 0.3 for the fallback.
    """
    lower = lambda name: F.lower(F.coalesce(name, F.lit("")))
    hits = F.array_sort(F.filter(keyword_scores(F.col("__subject"), F.col("__body")), lambda x: x["minus"] < 0))
    rows = rows.withColumns({"__subject": lower(subject), "__body": lower(body)}).withColumn("__hits", hits).drop("__subject", "__body")
    score = lambda i: -F.get("__hits", F.lit(i))["minus"] / 5
    conf = lambda i: F.when(score(i).isNotNull(), F.least(score(i), F.lit(0.95)))
    tied = F.coalesce(conf(0) - conf(1) <= 0.1, F.lit(False))
    some = F.size("__hits") > 0
    return rows.withColumns(
        {
            "intent": F.when(some, F.get("__hits", F.lit(0))["intent"]).otherwise(F.lit(FALLBACK_INTENT)),
            "confidence": F.when(some, F.round(F.greatest(conf(0) - F.when(tied, 0.15).otherwise(0.0), F.lit(0.0)), 4)).otherwise(F.lit(0.3)),
            "secondary": F.transform(F.slice("__hits", 2, 2), lambda x: x["intent"]),
        }
    ).drop("__hits")


def used_confidence(calibrated: Column, raw: Column) -> Column:
    return F.coalesce(calibrated, raw)


def lane_reason(placeholders: Column, notes: Column, citations: Column, confidence: Column, answer: Column, threshold: float = THRESHOLD, least_answer: float = ANSWER_THRESHOLD) -> tuple[Column, Column]:
    """The lane and why: faq for complete, grounded drafts of enough confidence, else human review for the first reason that holds."""
    two = lambda x: F.format_string("%.2f", x)
    below = lambda what, x, least: F.concat(F.lit(f"{what} "), two(x), F.lit(f" < {least:.2f}"))
    why = (
        F.when(placeholders > 0, F.format_string("draft has %d chair placeholder(s)", placeholders.cast("long")))
        .when(notes, F.lit("draft has notes for the chair"))
        .when(citations == 0, F.lit("draft cites no policy (ungrounded)"))
        .when(confidence < threshold, below("intent confidence", confidence, threshold))
        .when(answer.isNull(), F.lit("drafter provided no answer confidence"))
        .when(answer < least_answer, below("answer confidence", answer, least_answer))
    )
    return F.when(why.isNull(), LANE_FAQ).otherwise(LANE_HUMAN), F.coalesce(why, F.lit("complete grounded draft"))


def floored_lane(lane: Column, placeholders: Column, notes: Column, citations: Column, answer: Column) -> Column:
    """A draft that can't stand alone goes to a person, whatever the router said."""
    return F.when((placeholders > 0) | notes | answer.isNull() | (citations == 0), F.lit(LANE_HUMAN)).otherwise(lane)


def bandit_lane(confidence: Column, auto_rate: Column, human_rate: Column, threshold: float = THRESHOLD, floor: float = FLOOR, draw: Column | None = None) -> Column:
    """The arm with the better rate, auto-reply on ties; a person below the floor or the threshold. draw: a number in 0 to 1, to explore either arm below EXPLORE."""
    best = F.when(auto_rate >= human_rate, LANE_FAQ).otherwise(LANE_HUMAN)
    if draw is not None:
        best = F.when(draw < EXPLORE / 2, LANE_FAQ).when(draw < EXPLORE, LANE_HUMAN).otherwise(best)
    return F.when((confidence < floor) | (confidence < threshold), LANE_HUMAN).otherwise(best)


def near_miss(confidence: Column, threshold: float = THRESHOLD, margin: float = NEAR) -> Column:
    return (confidence >= threshold - margin) & (confidence < threshold)


def send_decision(text: Column, unresolved: Column, status: Column, lane: Column, leaks: Column, auto: bool) -> Column:
    """Whether a draft may go out, and in which mode: the first rule that holds."""
    state = F.lower(F.coalesce(status, F.lit("")))
    rules = F.when(F.coalesce(F.trim(text), F.lit("")) == "", "no text").when(unresolved > 0, "placeholders").when(state == "approved", "approved")
    if auto:
        rules = rules.when((lane == LANE_FAQ) & (leaks > 0), "leaks").when((lane == LANE_FAQ) & (state == "draft_generated"), "auto")
    return rules.otherwise("needs approval")


def owner_of(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """rows (intent) with owner: the smallest active owner whose areas hold the intent, else the smallest without areas.

    owners: id, areas, active. The roster becomes one row for each intent, so the join has one match a row.
    """
    active = owners.where("active")
    by_intent = active.select("id", F.explode("areas").alias("intent")).groupBy("intent").agg(F.min("id").alias("__owner"))
    rest = active.where(F.size("areas") == 0).agg(F.min("id").alias("__rest"))
    return rows.join(by_intent, "intent", "left").crossJoin(F.broadcast(rest)).withColumn("owner", F.coalesce("__owner", "__rest")).drop("__owner", "__rest")
