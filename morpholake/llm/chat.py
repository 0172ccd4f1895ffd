"""Tool calls of conversations: linked to their results, ordered, validated, and written as canonical JSON.

DataFrame functions only. Calls and results are first reduced to one row for each (conversation, id), the earliest turn,
with a count, so the hash join on the id is one to one however often an id is repeated. A call follows the calls named
in its after; its level is one more than the highest among them, found in rounds that grow with the logarithm of the
longest chain: a conversation's links are doubled in length by equi-joins, so where calls follow several others each,
up to the square of its calls in pairs. Sorting by (level, turn, call_id) is a topological order.
Arguments are parsed once into a variant, whose object fields are in order of their names, and so is what is written.

Cases: rows without a conversation or an id cannot be linked and are calls by themselves, with the error "id"; results
without a call are returned too, with the error "orphan"; names in after that are no calls of the conversation are
ignored; calls in or behind a circle have no level, and the error "circle"; arguments that are null or no JSON object
have the error "json"; unknown tools have the error "tool"; a missing or null required field, a field of another type,
and an unknown field give "missing:x", "type:x" and "unknown:x"; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from morpholake.llm.blocks import checkpointed

#: A tool's fields: name to (type, required). Types are those of JSON, with integer besides number.
Schemas = Mapping[str, Mapping[str, tuple[str, bool]]]
_TYPES = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DOUBLE|FLOAT|DECIMAL.*)", "boolean": "BOOLEAN", "array": "ARRAY<.*", "object": "OBJECT<.*"}


def argument_errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Sorted array of what is wrong with a call's arguments; empty if nothing is."""
    parsed = F.try_parse_json(arguments)
    kind = F.schema_of_variant(parsed)
    keys = F.json_object_keys(arguments)
    said = F.when(parsed.isNull() | ~kind.startswith("OBJECT<"), F.array(F.lit("json")))
    for tool, fields in schemas.items():
        checks = []
        for field, (type_, required) in fields.items():
            value = F.try_variant_get(parsed, f"$.{field}", "variant")
            empty = value.isNull() | F.coalesce(F.is_variant_null(value), F.lit(False))
            wrong = ~F.schema_of_variant(value).rlike(f"^{_TYPES[type_]}$")
            checks.append(F.when(empty, F.lit(f"missing:{field}") if required else F.lit(None)).when(wrong, F.lit(f"type:{field}")))
        unknown = F.transform(F.array_except(keys, F.array(*[F.lit(f) for f in fields])), lambda k: F.concat(F.lit("unknown:"), k))
        said = said.when(name == tool, F.array_sort(F.concat(F.array_compact(F.array(*checks)), unknown)))
    return said.otherwise(F.array(F.lit("tool")))


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of every call that is in no circle and behind none; calls: one row for each (conv_id, call_id), with after.

    Links over 1, 2, 4, ... calls are made by joining those of half the length with themselves, until there are none or
    they are longer than any conversation. A level is then put together from the longest down, each link taken where one
    starts at where the call has come to. A level of as many links as the conversation has calls is that of a circle.
    """
    keys = ["conv_id", "call_id"]
    known = calls.select("conv_id", F.col("call_id").alias("needs"))
    edges = checkpointed(calls.select(*keys, F.explode(F.array_distinct("after")).alias("needs")).join(known, ["conv_id", "needs"], "left_semi").select(*keys, "needs"))
    sizes = calls.groupBy("conv_id").agg(F.count("*").alias("n")).join(edges.select("conv_id").distinct(), "conv_id", "left_semi")
    longest = sizes.agg(F.max("n")).first()[0] or 0
    steps = [edges] if longest else []
    while steps and 2 ** len(steps) <= longest:
        on = steps[-1].select("conv_id", F.col("call_id").alias("needs"), F.col("needs").alias("far"))
        twice = checkpointed(steps[-1].join(on, ["conv_id", "needs"]).select(*keys, F.col("far").alias("needs")).distinct())
        if twice.isEmpty():
            break
        steps.append(twice)
    at = calls.select(*keys, F.col("call_id").alias("at"), F.lit(0).alias("level"))
    for k, step in reversed(list(enumerate(steps))):
        on = step.select("conv_id", F.col("call_id").alias("at"), "needs")
        moves = F.max(F.col("needs").isNotNull()).over(Window.partitionBy(*keys))
        met = at.join(on, ["conv_id", "at"], "left").withColumn("moves", moves).where("needs is not null or not moves")
        at = checkpointed(met.select(*keys, F.coalesce("needs", "at").alias("at"), (F.col("level") + F.when(F.col("moves"), 2**k).otherwise(0)).alias("level")).distinct())
    size = calls.groupBy("conv_id").agg(F.count("*").alias("n"))
    return at.select(*keys, "level").distinct().join(size, "conv_id").where("level < n").select(*keys, "level")


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row for each call and each orphaned result.

    calls: conv_id, turn, call_id (string), name, arguments (JSON text), after (array of call ids, may be null).
    results: conv_id, turn, call_id, content. Returned: conv_id, call_id, turn, name, level, n_calls, n_results,
    result_turn, valid, errors (array) and json, the canonical JSON of the call with its result.
    """
    keys = ["conv_id", "call_id"]
    calls = calls.select("conv_id", "turn", F.col("call_id").cast("string"), "name", "arguments", F.col("after").cast("array<string>"))
    results = results.select("conv_id", "turn", F.col("call_id").cast("string"), "content")
    whole = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    one_call = calls.where(whole).groupBy(*keys).agg(F.min(F.struct("turn", "name", "arguments", "after")).alias("call"), F.count("*").alias("n_calls"))
    one_call = checkpointed(one_call.select(*keys, "call.*", "n_calls"))
    one_result = results.where(whole).groupBy(*keys).agg(F.min(F.struct("turn", "content")).alias("result"), F.count("*").alias("n_results"))
    joined = one_call.join(one_result, keys, "full_outer").join(levels(one_call), keys, "left")
    loose = calls.where(~whole).select(*keys, "turn", "name", "arguments", F.lit(1).cast("bigint").alias("n_calls"))
    stray = results.where(~whole).select(*keys, F.struct("turn", "content").alias("result"), F.lit(1).cast("bigint").alias("n_results"))
    every = joined.unionByName(loose, allowMissingColumns=True).unionByName(stray, allowMissingColumns=True)
    is_call = F.col("n_calls").isNotNull()
    more = F.array_compact(F.array(
        F.when(F.col("conv_id").isNull() | F.col("call_id").isNull(), "id"),
        F.when(~is_call, "orphan"),
        F.when(is_call & F.col("conv_id").isNotNull() & F.col("call_id").isNotNull() & F.col("level").isNull(), "circle"),
    ))
    errors = F.concat(more, F.when(is_call, argument_errors(F.col("name"), F.col("arguments"), schemas)).otherwise(F.array().cast("array<string>")))
    parsed = F.try_parse_json("arguments")
    text = F.to_json(F.struct(
        F.coalesce(parsed, F.to_variant_object(F.array("arguments"))).alias("arguments"),
        F.col("call_id"), F.col("level"), F.col("name"), F.col("result.content").alias("result"), F.col("turn"),
    ))
    return every.select(
        *keys, F.coalesce("turn", "result.turn").alias("turn"), "name", "level",
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"),
        F.col("result.turn").alias("result_turn"), (F.size(errors) == 0).alias("valid"), errors.alias("errors"), text.alias("json"),
    )
