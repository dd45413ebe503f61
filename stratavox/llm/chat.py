"""Operator 8: chat formatting with linked tool calls.

A message's text is plain, or (assistant) a JSON object with "tool_calls", or
(tool) a JSON object with "tool_call_id". Calls and results are joined by their
identifier within the conversation; calls and results are put in topological
order (a result after its call; a call after every result that its arguments
refer to by {"$result": id}); arguments are validated against schemas; every
message becomes canonical JSON: sorted keys, no blanks, unescaped Unicode.

The order is a pair of columns, (order_turn, depth), so nothing needs a whole
conversation in one task: rounds of joins over the tool rows alone raise a
row's order to that of what it depends on, one level per round. Parsing is per
row.

Cases: a null text is the empty content, a null role "unknown"; text that is
not such an object stays plain, also if it is broken JSON; of calls with one
identifier the first by (turn, place) is linked, of results too, and the others
count as duplicates; results without a call and calls without a result are
orphans, and keep their turns, as do calls without an identifier; members of a reference cycle get depth -1 and
the status "cycle"; calls of unknown tools are invalid; repeated messages are
formatted each; parts of a message without conversation or turn are orphans;
other columns are ignored.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from stratavox.llm.common import map_batches, table, written

#: A tool's arguments: name -> (JSON type, required).
Schemas = dict[str, dict[str, tuple[str, bool]]]

DEFAULT_SCHEMAS: Schemas = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "fetch": {"url": ("string", True)},
    "calculate": {"expression": ("string", True)},
}

_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False)


def fits(value: object, kind: str) -> bool:
    if isinstance(value, dict) and set(value) == {"$result"}:
        return True  # its type is known only once the result is
    if isinstance(value, bool) and kind != "boolean":
        return False
    return isinstance(value, _TYPES[kind])


def valid_arguments(name: object, arguments: object, schemas: Schemas) -> bool:
    """Known tool, an object, all required fields, no unknown ones, types as stated."""
    schema = schemas.get(name) if isinstance(name, str) else None
    if schema is None or not isinstance(arguments, dict):
        return False
    return set(arguments) <= set(schema) and all(k in arguments or not need for k, (_, need) in schema.items()) and all(fits(v, schema[k][0]) for k, v in arguments.items())


def references(value: object) -> list[str]:
    """Identifiers of results that a value refers to."""
    if isinstance(value, dict):
        if set(value) == {"$result"}:
            return [str(value["$result"])]
        return [r for v in value.values() for r in references(v)]
    if isinstance(value, list):
        return [r for v in value for r in references(v)]
    return []


def _object(text: str | None) -> dict | None:
    if not text or not text.lstrip().startswith("{"):
        return None
    try:
        found = json.loads(text)
        canonical(found).encode("utf-8")
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def parse_message(role: str | None, text: str | None, schemas: Schemas) -> list[tuple[str, str | None, list[str], bool, str]]:
    """(kind, identifier, references, valid, canonical JSON) of a message and its calls."""
    found, role = _object(text), role if role is not None else "unknown"
    if role == "assistant" and found and isinstance(found.get("tool_calls"), list):
        rows = []
        if found.get("content"):
            rows.append(("message", None, [], True, canonical({"role": role, "content": found["content"]})))
        for c in found["tool_calls"]:
            if not isinstance(c, dict):
                c = {"id": None, "name": None, "arguments": c}
            arguments = c.get("arguments")
            if isinstance(arguments, str):
                arguments = _object(arguments) if _object(arguments) is not None else arguments
            name, i = c.get("name"), c.get("id")
            rows.append(("call", None if i is None else str(i), references(arguments), valid_arguments(name, arguments, schemas), canonical({"role": role, "tool_call": {"id": i, "name": name, "arguments": arguments}})))
        return rows or [("message", None, [], True, canonical({"role": role, "content": ""}))]
    if role == "tool" and found and found.get("tool_call_id") is not None:
        return [("result", str(found["tool_call_id"]), [], True, canonical({"role": role, "tool_call_id": found["tool_call_id"], "content": found.get("content")}))]
    return [("message", None, [], True, canonical({"role": role, "content": text or ""}))]


def _levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, turn, place, order_turn, depth) of tool rows, level by level."""
    key = ["conv_id", "turn", "place"]
    waiting = nodes.select(*key).join(edges.select(*key).distinct(), key, "left_anti")
    known = written(waiting.select(*key, F.col("turn").alias("order_turn"), F.lit(0).alias("depth")), "levels")
    total = known.count()
    need = edges.groupBy(*key).agg(F.count("*").alias("need"))
    while True:
        got = edges.join(known.select(F.col("conv_id"), F.col("turn").alias("on_turn"), F.col("place").alias("on_place"), F.col("order_turn").alias("ot"), F.col("depth").alias("d")), ["conv_id", "on_turn", "on_place"])
        ready = got.groupBy(*key).agg(F.count("*").alias("have"), F.max("ot").alias("ot"), F.max("d").alias("d")).join(need, key).filter("have = need")
        fresh = ready.select(*key, F.greatest("turn", "ot").alias("order_turn"), (F.col("d") + 1).cast("int").alias("depth"))
        known = written(known.join(fresh.select(*key), key, "left_anti").unionByName(fresh), "levels")
        now = known.count()
        if now == total:
            return known
        total = now


def format_chats(messages: DataFrame, schemas: Schemas | None = None) -> DataFrame:
    """One row per message part: (conv_id, turn, place, kind, call_id, status,
    valid, order_turn, depth, json). Columns of ``messages``: conv_id, turn,
    role, text."""
    schemas = schemas or DEFAULT_SCHEMAS

    def parse(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, parts = [], []
        for k, (role, text) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            for place, p in enumerate(parse_message(role, text, schemas)):
                row.append(k)
                parts.append((place, *p))
        place, kind, call, refs, valid, out = zip(*parts)
        at = pa.array(row)
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), batch.column(1).take(at), pa.array(place, pa.int32()), pa.array(kind), pa.array(call, pa.string()), pa.array(refs, pa.list_(pa.string())), pa.array(valid), pa.array(out)],
            ["conv_id", "turn", "place", "kind", "call_id", "refs", "valid", "json"],
        )

    source = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    rows = written(map_batches(source, parse, "conv_id long, turn long, place int, kind string, call_id string, refs array<string>, valid boolean, json string"), "chat")
    tools = rows.filter("kind <> 'message'")
    first = Window.partitionBy("conv_id", "kind", "call_id").orderBy("turn", "place", "json")
    named = tools.filter("call_id is not null").withColumn("nth", F.row_number().over(first))
    tools = named.unionByName(tools.filter("call_id is null").withColumn("nth", F.lit(1)))
    calls = tools.filter("kind = 'call' and nth = 1 and call_id is not null").select("conv_id", "call_id", F.col("turn").alias("on_turn"), F.col("place").alias("on_place"))
    results = tools.filter("kind = 'result' and nth = 1").select("conv_id", "call_id", F.col("turn").alias("on_turn"), F.col("place").alias("on_place"))
    key = ["conv_id", "turn", "place"]
    after_call = tools.filter("kind = 'result' and nth = 1").select(*key, "call_id").join(calls.hint("shuffle_hash"), ["conv_id", "call_id"])
    linked_results = results.join(calls.select("conv_id", "call_id").hint("shuffle_hash"), ["conv_id", "call_id"])
    after_result = tools.filter("kind = 'call'").select(*key, F.explode(F.array_distinct("refs")).alias("call_id")).join(linked_results, ["conv_id", "call_id"])
    edges = written(after_call.unionByName(after_result).select(*key, "on_turn", "on_place"), "chat-edges")
    levels = _levels(tools.select(*key).distinct(), edges)
    both = calls.select("conv_id", "call_id").join(results.select("conv_id", "call_id"), ["conv_id", "call_id"]).withColumn("linked", F.lit(True))
    status = tools.select(*key, "call_id", "nth").join(both, ["conv_id", "call_id"], "left").join(levels, key, "left")
    status = status.select(*key, "order_turn", "depth", F.when(F.col("nth") > 1, "duplicate").when(F.col("depth").isNull(), "cycle").when(F.col("linked"), "linked").otherwise("orphan").alias("status")).dropDuplicates(key)
    plain = rows.filter("kind = 'message'").select("*", F.col("turn").alias("order_turn"), F.lit(0).alias("depth"), F.lit("plain").alias("status"))
    linked = rows.filter("kind <> 'message'").join(status, key, "left").select(*plain.columns[:8], F.coalesce("order_turn", "turn").alias("order_turn"), F.coalesce("depth", F.lit(-1)).alias("depth"), F.coalesce("status", F.lit("orphan")).alias("status"))
    return plain.unionByName(linked).select("conv_id", "turn", "place", "kind", "call_id", "status", "valid", "order_turn", "depth", "json")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


#: For tables of plain messages, as the test tables are.
OP8_SQL = """
SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, 0::INTEGER AS place, 'message' AS kind, NULL::VARCHAR AS call_id, 'plain' AS status,
  true AS valid, turn::BIGINT AS order_turn, 0::INTEGER AS depth,
  CAST(json_object('content', coalesce(text, ''), 'role', coalesce(role, 'unknown')) AS VARCHAR) AS json
FROM conversations
"""
