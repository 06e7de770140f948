"""Tool-call linking: calls and results are joined by identifier, ordered by their dependencies and written as canonical JSON.

A call depends on the calls named in ``depends_on``; a result on its call. Levels come from joins: runs of calls with one
dependency each are followed by pointer doubling (as many rounds as the logarithm of the longest run), and only calls with
several dependencies take a round for each level among them. No conversation is gathered in one task.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

_HALVES = re.compile("[\ud800-\udfff]")
_TYPES = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}


def fits(value, schema: dict) -> bool:
    """Whether a value fits a schema: type, enum, const, length, range, pattern-free properties, required, items."""
    kind = schema.get("type")
    kinds = kind if isinstance(kind, list) else [kind] if kind else []
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kinds and not any((k == "number" and number) or (k == "integer" and number and (isinstance(value, int) or value.is_integer())) or (k in _TYPES and isinstance(value, _TYPES[k])) for k in kinds):
        return False
    if ("enum" in schema and value not in schema["enum"]) or ("const" in schema and value != schema["const"]):
        return False
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", float("inf")):
        return False
    if number and not schema.get("minimum", -float("inf")) <= value <= schema.get("maximum", float("inf")):
        return False
    if isinstance(value, list):
        return all(fits(x, schema.get("items", {})) for x in value)
    if isinstance(value, dict):
        known = schema.get("properties", {})
        if any(k not in value for k in schema.get("required", [])) or (schema.get("additionalProperties") is False and any(k not in known for k in value)):
            return False
        return all(fits(value[k], s) for k, s in known.items() if k in value)
    return True


def canonical(value) -> str:
    """JSON with sorted keys and no spaces; characters beyond ASCII stay, halves of surrogate pairs become U+FFFD.

    Numbers that JSON doesn't have (not finite) are a ValueError.
    """
    return _HALVES.sub("\ufffd", json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def judged(call_id: str, name: str | None, arguments: str | None, schemas: dict[str, dict]) -> tuple[bool, dict]:
    """Whether the arguments of a call fit, and what is told of it; arguments that are no JSON, are nested too deeply or
    hold numbers that aren't finite stay a string and don't fit."""
    try:
        value = None if arguments is None else json.loads(arguments)
        told = {"id": call_id, "name": name, "arguments": value}
        canonical(told)
        return isinstance(value, dict) and name in schemas and fits(value, schemas[name]), told
    except (ValueError, RecursionError):
        return False, {"id": call_id, "name": name, "arguments": arguments}


def call_levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, depth: 0 for calls that depend on none, else one more than the deepest; null in a cycle and for
    what depends on one. Names of unknown calls count for nothing.
    """
    key = ["conv_id", "call_id"]
    nodes = calls.select(*key)
    edges = calls.select(*key, F.explode("depends_on").alias("on")).distinct()
    edges = common.materialize(edges.join(nodes.withColumnRenamed("call_id", "on"), ["conv_id", "on"], "left_semi"))
    waits = edges.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("on").alias("on"))
    roots = nodes.join(waits, key, "left_anti").withColumn("depth", F.lit(0))
    runs = waits.where("n = 1").select(*key, "on", F.lit(1).alias("steps"))
    singles = runs.select("conv_id", F.col("call_id").alias("on"), F.lit(True).alias("open"))
    runs = common.materialize(runs.join(singles, ["conv_id", "on"], "left").select(*key, "on", "steps", F.coalesce("open", F.lit(False)).alias("open")))
    rounds = runs.count().bit_length() + 1  # a run still open after them leads into a cycle
    while rounds and not runs.where("open").isEmpty():
        ahead = runs.select("conv_id", F.col("call_id").alias("on"), F.col("on").alias("far"), F.col("steps").alias("more"), F.col("open").alias("still"))
        jumped = runs.where("open").join(ahead, ["conv_id", "on"]).select(*key, F.col("far").alias("on"), (F.col("steps") + F.col("more")).alias("steps"), F.col("still").alias("open"))
        before, runs, rounds = runs, common.materialize(runs.where("NOT open").union(jumped)), rounds - 1
        common.discard(before)
    runs = runs.where("NOT open").drop("open")
    done = common.materialize(roots)
    several = edges.join(waits.where("n > 1").select(*key), key, "left_semi")
    if not several.isEmpty():
        via = runs.select("conv_id", F.col("call_id").alias("on"), F.col("on").alias("far"), "steps")
        known = nodes.join(runs, key, "left_anti").select("conv_id", F.col("call_id").alias("on"))  # calls that end a run, and those lost in cycles
        several = common.materialize(several.join(via, ["conv_id", "on"], "left").select(*key, F.coalesce("far", "on").alias("on"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps")).join(known, ["conv_id", "on"], "left_semi"))
        while True:
            left = several.join(done.select(*key), key, "left_anti")
            reach = left.join(done.select("conv_id", F.col("call_id").alias("on"), "depth"), ["conv_id", "on"], "left")
            new = reach.groupBy(*key).agg(F.max(F.col("depth") + F.col("steps")).alias("depth"), F.count_if(F.col("depth").isNull()).alias("open")).where("open = 0").select(*key, "depth")
            new = common.materialize(new)
            if new.isEmpty():
                break
            done = common.materialize(done.union(new))
    ends = done.select("conv_id", F.col("call_id").alias("on"), "depth")
    depths = done.union(runs.join(ends, ["conv_id", "on"]).select(*key, F.col("depth") + F.col("steps")))
    return nodes.join(depths, key, "left")


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """conv_id, call_id, status, level, valid, linked_json for every call and every result without one.

    calls: conv_id, call_id, seq, name, arguments (JSON), depends_on (array of call ids); results: conv_id, call_id, seq,
    content. Of calls (results) that share an identifier the first by seq, then by content, counts. status: linked,
    unanswered (no result), orphan (no call). level orders a conversation: twice the depth of a call, null in a
    cycle and for orphans; its result comes right after it. valid: the arguments are a JSON object that fits the schema
    of the tool; tools without a schema are not valid. Arguments that are no JSON stay a string. Rows without conv_id or
    call_id take no part; a null content is a null result; texts of any length are taken whole; other columns are ignored;
    empty tables give no rows.
    """
    def first(df: DataFrame, by: str) -> DataFrame:
        w = Window.partitionBy("conv_id", "call_id").orderBy("seq", by)
        return df.where("conv_id IS NOT NULL AND call_id IS NOT NULL").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")

    calls = common.materialize(first(calls.select("conv_id", "call_id", "seq", "name", "arguments", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on")), "arguments"))
    results = first(results.select("conv_id", "call_id", F.col("seq"), "content"), "content").withColumn("answered", F.lit(True)).withColumnRenamed("seq", "result_seq")
    levels = call_levels(calls)
    linked = calls.withColumn("called", F.lit(True)).hint("shuffle_hash").join(results.hint("shuffle_hash"), ["conv_id", "call_id"], "full_outer").join(levels, ["conv_id", "call_id"], "left")
    linked = linked.select("conv_id", "call_id", F.when(F.col("called").isNull(), "orphan").when(F.col("answered").isNull(), "unanswered").otherwise("linked").alias("status"), (F.col("depth") * 2).cast("int").alias("level"), "name", "arguments", "content")
    common.by_bytes(calls.sparkSession)
    conv_type = calls.schema["conv_id"].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            valid, out = [], []
            for r in batch.to_pylist():
                fine, item = judged(r["call_id"], r["name"], r["arguments"], schemas) if r["status"] != "orphan" else (False, {"id": r["call_id"]})
                valid.append(fine)
                if r["status"] != "unanswered":
                    item["result"] = r["content"]
                out.append(canonical(item))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(valid, pa.bool_()), pa.array(out, pa.string())], names=["conv_id", "call_id", "status", "level", "valid", "linked_json"])

    return linked.mapInArrow(batches, f"conv_id {conv_type}, call_id string, status string, level int, valid boolean, linked_json string")


def calls_of_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A conversation read as tool use: each user turn calls ``reply``; the assistant's next turn is its result, and the
    call two turns on depends on it. Turns without a conversation or number take no part; of repeated turns each is a call or
    result (``link`` takes the first); a null text is an argument or a result that is null."""
    ident = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    turns = conversations.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    calls = turns.where("role = 'user'").select("conv_id", ident(F.col("turn")).alias("call_id"), F.col("turn").alias("seq"), F.lit("reply").alias("name"), F.to_json(F.struct("text", "turn")).alias("arguments"), F.array(ident(F.col("turn") - 2)).alias("depends_on"))
    results = turns.where("role = 'assistant'").select("conv_id", ident(F.col("turn") - 1).alias("call_id"), F.col("turn").alias("seq"), F.col("text").alias("content"))
    return calls, results


REPLY_SCHEMA = {"reply": {"type": "object", "required": ["text", "turn"], "additionalProperties": False, "properties": {"text": {"type": "string", "minLength": 1, "maxLength": 400}, "turn": {"type": "integer", "minimum": 0}}}}
