"""Chat formatting: link tool calls and results, order them, validate arguments, write canonical JSON.  DataFrame functions only.

Calls and results are hash-joined on conversation and identifier.  Order: by (stage, turn, call_id) every call of a conversation
comes after all that it needs.  A call's stage is the largest number of *forward* needs, ones on a call that is later by (turn,
call_id), along any chain of needs below it; as most needs point back, most stages are 0 without any work, and only calls that stand above a forward
need are visited, in rounds that touch only calls whose stage has just risen.
Arguments are parsed as variants: their schema checks are expressions, and a variant writes its keys in order,
without spaces, so equal arguments have equal JSON.

No conversation is ever gathered in one place; joins have the call's identifier in their keys, so long conversations spread.  The rounds
append to one table that is read once, so the final plan does not depend on their number.

Defined cases: a call without a result: status ``no_result``; a result without a call: ``orphan_result``.  Several calls or
results of one identifier: the smallest by (turn, name, arguments) or (turn, content) stands, ``repeats`` and ``result_repeats`` count
them.  Dependencies on unknown calls or on itself are ignored; calls on or above a cycle have stage -1.  A null turn comes before all
others.  Null or malformed arguments, or unknown tools: not valid, with the reason.  Calls and results whose conversation or identifier is null never
link: each keeps a row of its own.  Extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import dropped, stored

_KINDS = {"string": "STRING", "boolean": "BOOLEAN", "object": "OBJECT<", "array": "ARRAY<", "null": "VOID", "integer": "BIGINT", "number": ""}


def _kind_of(value: Column, kind: str) -> Column:
    found = F.schema_of_variant(value)
    if kind == "number":
        return found.isin("BIGINT", "DOUBLE", "FLOAT") | found.startswith("DECIMAL")
    return found.startswith(_KINDS[kind])


def schema_errors(value: Column, schema: dict, at: str = "$") -> list[Column]:
    """For each demand of a JSON schema (type, required, properties, enum, minimum, maximum, minLength, maxLength,
    additionalProperties) a text if the variant ``value`` breaks it, else null."""
    inside = F.try_variant_get(value, at, "variant")
    breaks = lambda bad, what: F.when(inside.isNotNull() & bad, F.lit(f"{at}: {what}"))
    out = []
    if "type" in schema:
        kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        good = _kind_of(inside, kinds[0])
        for k in kinds[1:]:
            good = good | _kind_of(inside, k)
        out.append(breaks(~good, "is not " + " or ".join(kinds)))
    if "enum" in schema:
        out.append(breaks(~F.to_json(inside).isin([json.dumps(x, separators=(",", ":"), sort_keys=True) for x in schema["enum"]]), "is none of the values"))
    number, text = F.try_variant_get(value, at, "double"), F.when(_kind_of(inside, "string"), F.try_variant_get(value, at, "string"))
    for name, bad in (("minimum", lambda x: number < x), ("maximum", lambda x: number > x), ("minLength", lambda x: F.char_length(text) < x), ("maxLength", lambda x: F.char_length(text) > x)):
        if name in schema:
            out.append(breaks(F.coalesce(bad(F.lit(schema[name])), F.lit(False)), f"breaks {name} {schema[name]}"))
    for name in schema.get("required", []):
        out.append(breaks(F.try_variant_get(value, f"{at}.{name}", "variant").isNull(), f"lacks {name}"))
    if schema.get("additionalProperties") is False:
        more = F.array_except(F.json_object_keys(F.to_json(inside)), F.lit(sorted(schema.get("properties", {}))))
        out.append(breaks(F.coalesce(F.size(more) > 0, F.lit(False)), "has further properties"))
    for name, inner in sorted(schema.get("properties", {}).items()):
        out += schema_errors(value, inner, f"{at}.{name}")
    return out


def argument_errors(name: Column, arguments: Column, schemas: dict[str, dict]) -> Column:
    """All that is wrong with a call's arguments, as an array of texts; ``schemas``: the tools on offer."""
    value = F.try_parse_json(arguments)
    out = F.array(F.lit("unknown tool"))
    for tool, schema in sorted(schemas.items()):
        demands = schema_errors(value, schema)
        out = F.when(name == tool, F.array_compact(F.array(*demands)) if demands else F.array().cast("array<string>")).otherwise(out)
    return F.when(value.isNull(), F.array(F.lit("arguments are no JSON"))).otherwise(out)


#: The stage of calls on or above a cycle while rounds go on: above any other.
_CYCLE = 1 << 62


def stages_of(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """(conv_id, call_id, stage) of the calls whose stage is not 0; ``calls`` (conv_id, call_id, turn) are distinct, ``needs``: conv_id, call_id, needed."""
    key, to = ["conv_id", "call_id"], ["conv_id", "needed"]
    spark = calls.sparkSession
    place = lambda turn, call: F.struct(F.coalesce(turn.cast("long"), F.lit(-(1 << 63))), call)
    mine = calls.select(*key, place(F.col("turn"), F.col("call_id")).alias("at"))
    theirs = mine.toDF(*to, "needed_at")
    edges = needs.where("call_id <> needed").distinct().join(theirs, to).join(mine, key)
    edges = stored(edges.select(*key, "needed", (F.col("needed_at") > F.col("at")).cast("long").alias("forward")), "chat-needs")
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in calls.select(key).schema) + ", stage long"
    frontier = edges.where("forward = 1").groupBy(*key).agg(F.lit(1).cast("long").alias("stage"))
    if frontier.isEmpty():
        dropped(edges)
        return spark.createDataFrame([], shape)
    # a chain without a cycle passes each forward need once
    most = stored(edges.groupBy("conv_id").agg(F.sum("forward").alias("most")).where("most > 0"), "chat-most")
    best = frontier = stored(frontier, "chat-stages")
    while not frontier.isEmpty():
        found = edges.join(frontier.select("conv_id", F.col("call_id").alias("needed"), "stage"), to)
        found = found.groupBy(*key).agg(F.max(F.when(F.col("stage") == _CYCLE, _CYCLE).otherwise(F.col("stage") + F.col("forward"))).alias("new"))
        risen = found.join(best, key, "left").where("stage is null or new > stage").join(most, "conv_id")
        frontier = stored(risen.select(*key, F.when(F.col("new") > F.col("most"), F.lit(_CYCLE)).otherwise(F.col("new")).alias("stage")), "chat-frontier")
        more = stored(best.union(frontier).groupBy(*key).agg(F.max("stage").alias("stage")), "chat-stages")
        dropped(best)
        best = more
    for used in (edges, most):
        dropped(used)
    return best.withColumn("stage", F.when(F.col("stage") == _CYCLE, F.lit(-1).cast("long")).otherwise(F.col("stage")))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """(conv_id, call_id, turn, name, stage, status, valid, errors, repeats, result_repeats, json); calls by (stage, turn, call_id) are in topological order.

    ``calls``: conv_id, call_id, turn, name, arguments (JSON text), needs (array of identifiers); ``results``: conv_id,
    call_id, turn, content.
    """
    key = ["conv_id", "call_id"]
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    one = calls.where(named).groupBy(*key).agg(F.min(F.struct("turn", "name", "arguments")).alias("c"), F.count("*").alias("repeats"))
    answers = results.where(named).groupBy(*key).agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("result_repeats"))
    stages = stages_of(one.select(*key, "c.turn"), calls.where(named).select(*key, F.explode("needs").alias("needed")).where("needed is not null"))
    linked = one.join(answers, key, "full").join(stages, key, "left")
    once, never = F.lit(1).cast("long"), F.lit(None).cast("long")
    lone_calls = calls.where(~named).select(*key, F.struct("turn", "name", "arguments").alias("c"), once.alias("repeats"), F.lit(None).cast(answers.schema["r"].dataType).alias("r"), never.alias("result_repeats"), never.alias("stage"))
    lone_results = results.where(~named).select(*key, F.lit(None).cast(one.schema["c"].dataType).alias("c"), never.alias("repeats"), F.struct("turn", "content").alias("r"), once.alias("result_repeats"), never.alias("stage"))
    both = linked.select(*lone_calls.columns).union(lone_calls).union(lone_results)
    status = F.when(F.col("repeats").isNull(), "orphan_result").when(F.col("r").isNull(), "no_result").otherwise("linked")
    errors = F.when(F.col("repeats").isNull(), F.array().cast("array<string>")).otherwise(argument_errors(F.col("c.name"), F.col("c.arguments"), schemas))
    shown = both.select(
        *key, F.coalesce("c.turn", "r.turn").alias("turn"), F.col("c.name").alias("name"), F.when(F.col("repeats").isNotNull(), F.coalesce("stage", F.lit(0).cast("long"))).alias("stage"),
        status.alias("status"), errors.alias("errors"), F.coalesce("repeats", F.lit(0).cast("long")).alias("repeats"), F.coalesce("result_repeats", F.lit(0).cast("long")).alias("result_repeats"),
        F.try_parse_json("c.arguments").alias("arguments"), F.col("r.content").alias("content"), F.col("r.turn").alias("result_turn"),
    )
    # keys in order, as canonical JSON has them
    shape = F.struct(F.col("arguments"), F.col("call_id").cast("string").alias("call_id"), F.col("content"), F.col("conv_id").cast("string").alias("conv_id"), F.col("name"), F.col("result_turn"), F.col("stage"), F.col("status"), F.col("turn"))
    return shown.select(*key, "turn", "name", "stage", "status", (F.size("errors") == 0).alias("valid"), "errors", "repeats", "result_repeats", F.to_json(shape).alias("json"))
