"""Chat formatting: tool calls linked with their results, ordered, validated and written as canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskloom.llm.shared import stored

#: The type of a value in a variant, by the JSON type that a schema names.
TYPES = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",)}

Schema = dict[str, tuple[str, bool]]


def _path(name: str) -> str:
    """A parameter's place in a variant; the name is quoted, as it may hold dots and brackets."""
    quote = next((q for q in "'\"" if q not in name), None)
    if quote is None:
        raise ValueError(f"a parameter's name can't hold both kinds of quotes: {name}")
    return f"$[{quote}{name}{quote}]"


def readable(arguments: Column) -> Column:
    """Arguments as a variant; null if they aren't JSON, or hold a number too large for a double, which JSON couldn't write again."""
    parsed, infinite = F.try_parse_json(arguments), F.lit('"-?Infinity"')
    grown = F.regexp_count(F.to_json(F.struct(parsed.alias("a"))), infinite) > F.regexp_count(arguments, infinite)
    return F.when(~F.coalesce(arguments.rlike(r"[0-9][eE][+]?[0-9]{3}|[0-9]{300}") & grown, F.lit(False)), parsed)


def argument_error(name: Column, arguments: Column, schemas: dict[str, Schema]) -> Column:
    """Why the arguments don't fit the tool's schema, or null: the first of the failed checks, in order.

    schemas: for each tool its parameters, with their JSON type and whether they
    must be there. The order: unknown tool, not an object, then by parameter
    missing or of another type, then unknown parameters. JSON null counts as missing.
    Arguments with a number beyond a double's range aren't an object. A parameter's
    name may hold anything but both kinds of quotes.
    """
    parsed = readable(arguments)
    out = F.lit("unknown tool")
    for tool, schema in schemas.items():
        error = F.when(F.schema_of_variant(parsed).startswith("OBJECT").eqNullSafe(True), F.lit(None).cast("string")).otherwise(F.lit("not an object"))
        known = F.array(*(F.lit(k) for k in schema)) if schema else F.array().cast("array<string>")
        strange = F.array_sort(F.array_except(F.json_object_keys(arguments), known))
        rest = F.when(F.size(strange) > 0, F.concat(F.lit("unknown "), F.get(strange, F.lit(0))))
        for key, (kind, required) in reversed(schema.items()):
            value = F.try_variant_get(parsed, _path(key), "variant")
            absent = value.isNull() | F.is_variant_null(value)
            typed = F.lit(False)
            for t in TYPES[kind]:
                typed = typed | F.schema_of_variant(value).startswith(t)
            if kind == "integer":  # 1.0 is one too
                number = F.try_variant_get(parsed, _path(key), "double")
                typed = typed | (F.schema_of_variant(value).rlike("^(DOUBLE|DECIMAL)") & (number == F.floor(number)))
            rest = F.when(~absent & ~typed, F.lit(f"{key} is not {kind}")).otherwise(rest)
            if required:
                rest = F.when(absent, F.lit(f"{key} is missing")).otherwise(rest)
        out = F.when(name == tool, F.coalesce(error, rest)).otherwise(out)
    return out


def topological_levels(calls: DataFrame) -> DataFrame:
    """(call_id, level) for calls (call_id, after_id): how many calls come before, along after_id.

    Pointers are doubled, so a chain of n calls takes log n joins. An after_id
    without a call is none. A call on a cycle, or behind one, has a null level.
    """
    now = calls.select("call_id", F.col("after_id").alias("up")).where("call_id IS NOT NULL")
    known = now.select(F.col("call_id").alias("up"), F.lit(True).alias("__known"))
    now = now.join(known, "up", "left").select("call_id", F.when(F.col("__known"), F.col("up")).alias("up"))
    now = stored(now.withColumn("level", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long")), "levels")
    total, rounds, open_calls = now.count(), 0, now.where("up IS NOT NULL").count()
    while open_calls and 2**rounds <= total:
        above = now.select(F.col("call_id").alias("up"), F.col("up").alias("__up"), F.col("level").alias("__level"))
        moving = now.where("up IS NOT NULL").join(above, "up").select("call_id", F.col("__up").alias("up"), (F.col("level") + F.col("__level")).alias("level"))
        now = stored(now.where("up IS NULL").unionByName(moving), "levels")
        rounds, open_calls = rounds + 1, now.where("up IS NOT NULL").count()
    return now.select("call_id", F.when(F.col("up").isNull(), F.col("level")).alias("level"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, Schema]) -> DataFrame:
    """One row per distinct call: conv_id, call_id, level, call_turn, result_turn, status, error, json.

    calls: conv_id, call_id, after_id (the call it follows, or null), turn, name,
    arguments (JSON text). results: conv_id, call_id, turn, content. Ids are unique
    within a conversation; of repeated ids the earliest row counts (of equal turns,
    the smallest values). status: linked, pending (no result), early (its result
    comes before it), orphan (a result without a call) or cycle. error is null if the
    arguments fit the schema. json is the canonical text: keys sorted, no spaces,
    ids and arguments as they are, null results left out. Rows with a null conv_id
    or call_id can't be linked: such calls are pending, such results orphans. Sorting
    by conv_id, level, call_turn and call_id orders calls topologically.
    """
    # the conversation's length keeps ids with colons apart
    key_of = lambda call: F.concat(F.length(F.col("conv_id").cast("string")), F.lit(":"), F.col("conv_id").cast("string"), F.lit(":"), F.col(call).cast("string"))
    key = key_of("call_id")
    first = F.min(F.struct("turn", "name", "arguments", "after_id"))
    calls = calls.withColumn("key", key)
    whole = calls.where("key IS NOT NULL").groupBy("key", "conv_id", "call_id").agg(first.alias("c")).select("key", "conv_id", "call_id", "c.*")
    whole = stored(whole.withColumn("arguments", F.col("arguments")), "calls")
    results = results.withColumn("key", key)
    answers = results.where("key IS NOT NULL").groupBy("key", "conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"))
    answers = answers.select("key", F.col("conv_id").alias("__conv"), F.col("call_id").alias("__call"), F.col("r.turn").alias("result_turn"), "r.content")
    levels = topological_levels(whole.select(F.col("key").alias("call_id"), key_of("after_id").alias("after_id"))).withColumnRenamed("call_id", "key")
    loose = calls.where("key IS NULL").select("key", "conv_id", "call_id", "turn", "name", "arguments", F.lit(0).cast("long").alias("level"), F.lit(True).alias("known"))
    known = whole.join(levels, "key").select("key", "conv_id", "call_id", "turn", "name", "arguments", "level", F.lit(True).alias("known")).unionByName(loose)
    rows = known.join(answers.hint("shuffle_hash"), "key", "full_outer")
    lost = results.where("key IS NULL").select("conv_id", "call_id", F.col("turn").alias("result_turn"), "content")
    rows = rows.select(F.coalesce("conv_id", "__conv").alias("conv_id"), F.coalesce("call_id", "__call").alias("call_id"), "turn", "name", "arguments", "level", "known", "result_turn", "content")
    rows = rows.unionByName(lost, allowMissingColumns=True)
    status = (
        F.when(F.col("known").isNull(), "orphan").when(F.col("level").isNull(), "cycle").when(F.col("result_turn").isNull(), "pending").when(F.col("result_turn") < F.col("turn"), "early").otherwise("linked")
    )
    text = F.to_json(
        F.struct(
            F.coalesce(readable(F.col("arguments")), F.to_variant_object(F.struct(F.col("arguments").alias("text")))).alias("arguments"),
            F.col("call_id").alias("id"),
            F.col("name"),
            F.col("content").alias("result"),
        )
    )
    error = F.when(F.col("known"), argument_error(F.col("name"), F.col("arguments"), schemas))
    return rows.select(
        "conv_id", "call_id", "level", F.col("turn").alias("call_turn"), "result_turn", status.alias("status"), error.alias("error"), F.when(F.col("known"), text).alias("json")
    )


#: The schema of the query's one tool.
REPLY = {"reply": {"text": ("string", True), "turn": ("integer", True), "instructions": ("string", False)}}


def conversation_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results in conversations: a user's turn calls the tool reply, and the assistant's next turn answers.

    The id of a call is its turn; a result bears the id of the turn before it. A
    call follows the call that the turn before it answers. A system turn is a call
    with instructions but no text, and so is not valid.
    """
    what = F.when(F.col("role") == "system", F.struct(F.col("text").alias("instructions"), F.col("turn")))
    arguments = F.when(F.col("role") == "system", F.to_json(what)).otherwise(F.to_json(F.struct("text", "turn")))
    calls = conversations.where("role IN ('user', 'system')").select(
        "conv_id", F.col("turn").cast("string").alias("call_id"), (F.col("turn") - 2).cast("string").alias("after_id"), "turn", F.lit("reply").alias("name"), arguments.alias("arguments")
    )
    results = conversations.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).cast("string").alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


ORACLE = """
WITH c AS (SELECT conv_id, turn, role, text,
    CASE WHEN role = 'system' THEN '{"instructions":' || to_json(text) || ',"turn":' || turn || '}' ELSE '{"text":' || to_json(text) || ',"turn":' || turn || '}' END AS arguments
    FROM conversations WHERE role IN ('user', 'system')),
calls AS (SELECT conv_id, turn, arg_min(role, arguments) AS role, min(arguments) AS arguments FROM c GROUP BY conv_id, turn),
results AS (SELECT conv_id, turn - 1 AS id, min(text) AS content FROM conversations WHERE role = 'assistant' GROUP BY conv_id, turn),
chain AS (SELECT conv_id, turn, sum(fresh) OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS run FROM (
    SELECT conv_id, turn, CASE WHEN lag(turn) OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) = turn - 2 THEN 0 ELSE 1 END AS fresh FROM calls)),
levels AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn % 2, run ORDER BY turn) - 1 AS level FROM chain)
SELECT coalesce(k.conv_id, r.conv_id) AS conv_id, CAST(coalesce(k.turn, r.id) AS VARCHAR) AS call_id, CAST(l.level AS BIGINT) AS level, k.turn AS call_turn, r.id + 1 AS result_turn,
    CASE WHEN k.turn IS NULL THEN 'orphan' WHEN r.id IS NULL THEN 'pending' ELSE 'linked' END AS status,
    CASE WHEN k.role = 'system' THEN 'text is missing' END AS error,
    CASE WHEN k.turn IS NOT NULL THEN '{"arguments":' || k.arguments || ',"id":"' || k.turn || '","name":"reply"' || CASE WHEN r.content IS NULL THEN '' ELSE ',"result":' || to_json(r.content) END || '}' END AS json
FROM calls k FULL JOIN results r ON k.conv_id = r.conv_id AND k.turn = r.id LEFT JOIN levels l ON l.conv_id = k.conv_id AND l.turn = k.turn
"""
