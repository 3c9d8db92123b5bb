"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskloom.llm.shared import WORD

#: Frequent short words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for on was be with as by this are at from or an he not his "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine "
    "de la le et les en un que qui dans du pour au par sur une pas plus est avec "
    "el y los se las del por con no su para al lo como más"
).split()
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: What separates words.
SPACES = " \t\n\x0b\x0c\r"
#: Words of a window whose repetition counts.
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= numerator / denominator <= high; with a denominator of 0 the ratio is 0."""

    name: str
    numerator: str
    denominator: str | None
    low: float | None = None
    high: float | None = None


#: Lenient on purpose: a rule should hit junk and leave prose of any of the languages alone.
RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 20.0),
    Rule("symbol_ratio", "n_symbols", "n_words", None, 0.5),
    Rule("stop_word_ratio", "n_stop_words", "n_words", 0.01, None),
    Rule("dup_line_ratio", "n_dup_lines", "n_lines", None, 0.6),
)


def _let(value: Column, then) -> Column:
    """then(value), where the value is computed once although then uses it in lambdas."""
    return F.transform(F.array(value), then)[0]


def repeated_words(words: Column) -> Column:
    """Words in windows of WINDOW words that occur twice or more, the first included.

    Windows are compared by 64-bit hashes. Only a text that has a repeated window
    sorts its windows; then the covered words follow from the sorted places.
    """

    def windows(h: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(h) - (WINDOW - 1))
        return F.transform(places, lambda i: F.xxhash64(F.slice(h, i, WINDOW)))

    def covered(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        return _let(
            pairs,
            lambda s: F.aggregate(
                F.sort_array(
                    F.transform(
                        F.filter(s, lambda x, k: (x["g"] == F.get(s, k - 1)["g"]).eqNullSafe(True) | (x["g"] == F.get(s, k + 1)["g"]).eqNullSafe(True)),
                        lambda x: x["i"],
                    )
                ),
                F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
                lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), x - acc["last"])).alias("n")),
                lambda acc: acc["n"],
            ),
        )

    found = _let(
        _let(F.transform(words, lambda x: F.xxhash64(x)), windows),
        lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(F.lit(0).cast("long")),
    )
    return F.when(F.size(words) > WINDOW, found).otherwise(F.lit(0).cast("long"))


def quality_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_stop_words and n_repeat_words (long)."""
    raw = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(raw, "\n"), lambda x: x.rlike(WORD))
    words = F.regexp_extract_all(raw, F.lit(WORD), F.lit(0))
    parts = docs.withColumn("__words", words).withColumn("__lines", lines)
    return parts.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.translate(raw, SPACES, "")).cast("long"),
            "n_symbols": (F.length(raw) - F.length(F.translate(raw, SYMBOLS, ""))).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_stop_words": F.size(F.filter("__words", lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long"),
            "n_repeat_words": repeated_words(F.col("__words")),
        }
    ).drop("__words", "__lines")


def passes(rules: tuple[Rule, ...] = RULES) -> Column:
    """One condition for all rules of the table."""
    out = F.lit(True)
    for r in rules:
        ratio = F.col(r.numerator).cast("double")
        if r.denominator:
            ratio = F.when(F.col(r.denominator) > 0, ratio / F.col(r.denominator)).otherwise(F.lit(0.0))
        if r.low is not None:
            out = out & (ratio >= r.low)
        if r.high is not None:
            out = out & (ratio <= r.high)
    return out


def quality_verdict(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & passes(rules))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the measures, base_failed and kept for every row of docs (doc_id, text).

    base_failed: fewer than 20 words, or more than 30 % of them in repeated
    windows. kept: not base_failed, and within every threshold. A null text counts
    as empty and fails; repeated rows are judged each; other columns are left out.
    """
    return quality_verdict(quality_measures(docs.select("doc_id", "text")), rules).drop("text")


def passing(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that are kept, with all their columns.

    The verdict becomes an element of an array that is exploded: a filter on it
    can't be merged with the measures, which would then be computed for each use.
    """
    row = docs.select(F.struct("*").alias("__row"), F.col("text").alias("__text"))
    judged = quality_verdict(quality_measures(row, "__text"), rules)
    return judged.select("__row", F.explode(F.array("kept")).alias("kept")).where("kept").select("__row.*")


def rules_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same condition as SQL."""
    out = []
    for r in rules:
        ratio = f"(CASE WHEN {r.denominator} > 0 THEN CAST({r.numerator} AS DOUBLE) / {r.denominator} ELSE 0 END)" if r.denominator else r.numerator
        out += [f"{ratio} >= {r.low}"] * (r.low is not None) + [f"{ratio} <= {r.high}"] * (r.high is not None)
    return " AND ".join(out)


def quality_sql() -> str:
    """DuckDB SQL of quality_rules over documents."""
    space, word = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]+"
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines FROM documents),
k AS (SELECT row_number() OVER () AS k, * FROM d),
g AS (SELECT k, unnest(range(1, len(w) - {WINDOW - 2})) AS i, w FROM k WHERE len(w) > {WINDOW}),
h AS (SELECT k, i, count(*) OVER (PARTITION BY k, list_slice(w, i, i + {WINDOW - 1})) AS c FROM g),
r AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(range(i, i + {WINDOW})) AS p FROM h WHERE c > 1) GROUP BY k),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{space}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS BIGINT) AS n_stop_words, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
    FROM k LEFT JOIN r USING (k)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND {rules_sql()} AS kept FROM b"""
