"""Chat formatting: tool calls linked to their results.

Messages are rows (conversation, turn, role, text). A text that is a JSON object with
``tool_calls`` makes calls ({id, name, arguments, after}), one with ``tool_call_id`` is a result;
any other text is plain. The first call and result of an identifier are hash-joined by conversation
and identifier; every other call and result keeps a row of its own. A call's ``after`` names the call that must come first;
depths in that forest are found by pointer doubling, so a chain of n calls takes log n joins, and
calls on a cycle are reported. Arguments are validated against the tools' schemas, and everything is
written as canonical JSON: sorted keys, no spaces, whole numbers without a fraction.

Nothing is gathered by conversation: the order within one is given by (turn, n, level, kind, call_id).

Defined cases: a null text is an empty plain message; text that looks like JSON and isn't, or nests too deep
for Spark's reader, is plain; blanks before JSON don't matter; arguments that nest deeper than ``DEPTH`` or
aren't JSON stay a string and are invalid; halves of surrogate pairs are written as escapes;
calls without an id can't be linked; of calls or results with one identifier the first turn counts
and the others are ``duplicate``; rows without a conversation are one conversation of their own; a message with calls, or an empty list of them, has a row ``calls``; arguments that are null are an empty object; a null turn comes
first; no rows give no rows; columns other than the four are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redquill.llm.runtime import cut

PARSED = "tool_calls array<struct<id:string,name:string,arguments:string,after:string>>, tool_call_id string, content string"
TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}
DEPTH = 100  # levels of arrays and objects in arguments
STRINGS = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
HALVES = re.compile("[\ud800-\udfff]")


def depth(text: str) -> int:
    """How deep brackets nest outside of strings."""
    level = most = 0
    for c in re.findall(r"[\[\]{}]", STRINGS.sub("", text)):
        level += 1 if c in "[{" else -1
        most = max(most, level)
    return most


def canonical(value) -> str:
    """JSON with sorted keys and no spaces; 2.0 is written as 2, NaN and infinities as null, half a surrogate pair as its escape."""

    def plain(v):
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        if isinstance(v, list):
            return [plain(x) for x in v]
        if isinstance(v, float):
            return None if v != v or v in (float("inf"), float("-inf")) else int(v) if v.is_integer() and abs(v) < 2**53 else v
        return v

    text = json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return HALVES.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """Where ``value`` breaks a JSON schema of types, enums, bounds, lengths, properties and items."""
    out = []
    if (kind := schema.get("type")) is not None:
        kinds = kind if isinstance(kind, list) else [kind]
        if not any(isinstance(value, TYPES[k]) and not (k in ("integer", "number") and isinstance(value, bool)) or k == "integer" and isinstance(value, float) and value.is_integer() for k in kinds):
            return [f"{at}: not {kind}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [f"{at}: under minimum"] if value < schema.get("minimum", value) else []
        out += [f"{at}: over maximum"] if value > schema.get("maximum", value) else []
    if isinstance(value, str):
        out += [f"{at}: too short"] if len(value) < schema.get("minLength", 0) else []
        out += [f"{at}: too long"] if len(value) > schema.get("maxLength", len(value)) else []
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += violations(x, schema["items"], f"{at}[{i}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, x in value.items():
            if k in known:
                out += violations(x, known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unexpected")
    return out


def depths(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level (0 for a call that waits for none; null on or behind a cycle).

    ``calls`` has one row a (conv_id, call_id) and its ``after``; names of absent calls count as none.
    """
    def with_named(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
        """``left`` with what ``right`` has for the call that column ``name`` names in the same conversation."""
        return left.alias("l").join(right.alias("r"), F.col("l.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col(f"l.{name}") == F.col(f"r.{name}")), "left").select("l.*", *(f"r.{c}" for c in right.columns if c not in ("conv_id", name)))

    known = calls.select("conv_id", F.col("call_id").alias("after"), F.lit(True).alias("there"))
    nodes = with_named(calls.select("conv_id", "call_id", "after"), known, "after")
    nodes = cut(nodes.select("conv_id", "call_id", F.when(F.col("there"), F.col("after")).alias("up"), F.when(F.col("there"), F.lit(1)).otherwise(F.lit(0)).cast("long").alias("level")))
    total = max(1, nodes.count())
    for _ in range(total.bit_length() + 1):
        # Only calls that still point somewhere go on; what they point to may be at its end.
        if nodes.where("up is not null").isEmpty():
            break
        above = nodes.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("level").alias("more"))
        nodes = cut(with_named(nodes, above, "up").select("conv_id", "call_id", F.col("next").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")))
    return nodes.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("level")).alias("level"))


def format_chats(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """conv_id, turn, n (a call's place in its message), level, kind (message, calls, call, result), call_id, result_turn, status, json.

    Status of a message, and of one that makes calls, is ``plain``; of a call ``linked``, ``no_result``, ``unknown_tool``,
    ``invalid`` (its arguments), ``cycle``, ``no_id`` or ``duplicate``; of a result that isn't
    in a call's row ``no_call`` or ``duplicate``.
    """
    rows = messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("p", F.when(F.col("text").rlike(r"^[ \t\r\n]*\{"), F.from_json("text", PARSED, {"mode": "PERMISSIVE"})))
    is_calls, is_result = F.col("p.tool_calls").isNotNull(), F.col("p.tool_calls").isNull() & F.col("p.tool_call_id").isNotNull()
    plain = rows.where(~F.coalesce(is_calls | is_result, F.lit(False))).select("conv_id", "turn", "role", F.col("text").alias("content"))
    calls = rows.where(is_calls).select("conv_id", "turn", F.posexplode("p.tool_calls").alias("n", "c")).select("conv_id", "turn", "n", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.col("c.after").alias("after"))
    results = rows.where(is_result).select("conv_id", "turn", F.col("p.tool_call_id").alias("call_id"), F.col("p.content").alias("content"))

    heads = rows.where(is_calls).select("conv_id", "turn", "role", F.col("p.content").alias("content"))

    same = Window.partitionBy("conv_id", "call_id")
    known = calls.where("call_id is not null").withColumn("nth", F.row_number().over(same.orderBy("turn", "n", "name", "arguments", "after")))
    answers = results.withColumn("nth", F.row_number().over(same.orderBy("turn", "content")))
    first_call = known.where("nth = 1").select("conv_id", "call_id", "turn", "n", "name", "arguments", "after", F.lit(1).alias("copies"))
    first_result = answers.where("nth = 1").select("conv_id", "call_id", F.col("turn").alias("result_turn"), "content")
    first_call = cut(first_call)
    level = depths(first_call)
    linked = first_call.alias("x").hint("shuffle_hash").join(first_result.alias("y"), F.col("x.conv_id").eqNullSafe(F.col("y.conv_id")) & (F.col("x.call_id") == F.col("y.call_id")), "full_outer")
    linked = linked.select(F.coalesce("x.conv_id", "y.conv_id").alias("conv_id"), F.coalesce("x.call_id", "y.call_id").alias("call_id"), "turn", "n", "name", "arguments", "after", "copies", "result_turn", "content")
    linked = linked.alias("k").join(level.alias("v"), (F.col("k.conv_id").eqNullSafe(F.col("v.conv_id"))) & (F.col("k.call_id") == F.col("v.call_id")), "left").select("k.*", "v.level")
    # Later rows with a known identifier, and calls without one.
    later_calls = known.where("nth > 1").drop("nth").unionByName(calls.where("call_id is null"))
    later_results = answers.where("nth > 1")

    turn_type = messages.schema["turn"].dataType
    none = {"n": "int", "call_id": "string", "name": "string", "arguments": "string", "content": "string", "result_turn": turn_type, "level": "long"}

    def part(x: DataFrame, kind: str, *has: str) -> DataFrame:
        return x.select("conv_id", "turn", F.lit(kind).alias("kind"), *(F.col(c) if c in has else F.lit(None).cast(t).alias(c) for c, t in none.items()))

    parts = [
        part(plain.withColumnRenamed("role", "name"), "message", "name", "content"),
        part(heads.withColumnRenamed("role", "name"), "calls", "name", "content"),
        part(linked.where("copies is not null"), "call", *none),
        part(linked.where("copies is null").withColumn("turn", F.col("result_turn")), "result", "call_id", "content", "result_turn"),
        part(later_calls, "later_call", "n", "call_id", "name", "arguments"),
        part(later_results, "later_result", "call_id", "content"),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, states, texts = [], [], []
            for x in b.select(["kind", "call_id", "name", "arguments", "content", "result_turn", "level"]).to_pylist():
                kind = x["kind"]
                if kind in ("message", "calls"):
                    state, value = "plain", {"role": x["name"], "content": x["content"]}
                elif kind in ("result", "later_result"):
                    state, value = "no_call" if kind == "result" else "duplicate", {"tool_call_id": x["call_id"], "content": x["content"]}
                else:
                    arguments, wrong = x["arguments"], []
                    if arguments is None:
                        arguments = {}
                    elif depth(arguments) > DEPTH:
                        wrong = [f"$: deeper than {DEPTH}"]
                    else:
                        try:
                            arguments = json.loads(arguments)
                        except ValueError:
                            wrong = ["$: not JSON"]
                    if not wrong and x["name"] in schemas:
                        wrong = violations(arguments, schemas[x["name"]])
                    state = ("no_id" if x["call_id"] is None else "duplicate") if kind == "later_call" else "cycle" if x["level"] is None else "unknown_tool" if x["name"] not in schemas else "invalid" if wrong else "no_result" if x["result_turn"] is None else "linked"
                    value = {"id": x["call_id"], "name": x["name"], "arguments": arguments} | ({"violations": wrong} if wrong else {}) | ({"result": x["content"]} if x["result_turn"] is not None else {})
                kinds.append(kind.removeprefix("later_"))
                states.append(state)
                texts.append(canonical(value))
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), b.column("n"), b.column("level"), pa.array(kinds, pa.string()), b.column("call_id"), b.column("result_turn"), pa.array(states, pa.string()), pa.array(texts, pa.string())], names=["conv_id", "turn", "n", "level", "kind", "call_id", "result_turn", "status", "json"])

    conv, turn = (messages.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    return every.mapInArrow(write, f"conv_id {conv}, turn {turn}, n int, level long, kind string, call_id string, result_turn {turn}, status string, json string")
