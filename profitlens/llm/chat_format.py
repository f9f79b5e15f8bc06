"""Chat formatting with linked tool calls.

Messages (conv_id, turn, role, text) become events.  A text that is a JSON object with "tool_calls" (a list
of {"id", "name", "arguments", "after"}) makes calls; a message of role "tool" whose text is a JSON object
with "tool_call_id" is a result.  In plain chat, every user message is the call "reply" with the text as
its argument, and the assistant message of the next turn answers it (identifier ``<conv>:<turn>``).

Calls and results are joined by a shuffled hash of (conversation, identifier).  Events are ordered
topologically: a call comes after the calls it names in "after", a result after its call.  Where all such
edges point forward, the turn order is that order, and nothing has to be gathered.  Conversations with an edge
that points back are ordered by levels, which also find cycles: those with at most ``GATHER`` edges in one
task each, larger ones in rounds of joins.  Arguments are
validated against a schema for each tool (type, required, additional properties), and each event is
serialised as canonical JSON (sorted keys, no spaces, UTF-8).

No unbounded conversation is gathered into one task: the result is a row for each event, placed by (conv_id, rank).

Defined results: a text with NaN, an infinite number (1e400) or deeper nesting than Python reads is not JSON, and an
object whose "tool_calls" is empty or no list of objects makes no calls: both are plain text; a lone surrogate in
JSON becomes U+FFFD; a null text is the empty text; a null role is "unknown"; a null conv_id or turn sorts as
the largest long; a repeated identifier links each of its calls to its first result, further results have
status "repeated"; a result without call is "orphan", a call without result "open"; a tool without schema
is invalid ("unknown tool"); a call in a cycle has status "cycle"; empty tables give empty results; extra
columns are ignored."""

from __future__ import annotations

import json
import math
from collections import defaultdict, deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from profitlens.llm.common import NULL_ID, stored

#: Argument schemas by tool; a caller gives its own.
SCHEMAS = {"reply": {"type": "object", "required": ["prompt"], "additionalProperties": False,
                     "properties": {"prompt": {"type": "string", "minLength": 1}}}}
_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}


#: Most edges of a conversation that one task puts in order.
GATHER = 100_000


def clean(text: str) -> str:
    """Text that UTF-8 can hold: a lone surrogate becomes U+FFFD."""
    return text if text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def canonical(value) -> str:
    return clean(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def validate(value, schema: dict, at: str = "$") -> list[str]:
    """What in ``value`` breaks the schema (type, enum, required, properties, items, minLength)."""
    kind = schema.get("type")
    if kind and (not isinstance(value, _TYPES[kind]) or isinstance(value, bool) and kind in ("integer", "number")):
        return [f"{at}: not {kind}"]
    wrong = [] if "enum" not in schema or value in schema["enum"] else [f"{at}: not allowed"]
    if isinstance(value, str) and len(value) < schema.get("minLength", 0):
        wrong.append(f"{at}: too short")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        wrong += [f"{at}.{k}: missing" for k in sorted(schema.get("required", ())) if k not in value]
        for k in sorted(value):
            if k in known:
                wrong += validate(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                wrong.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            wrong += validate(x, schema["items"], f"{at}[{i}]")
    return wrong


_EVENTS = ("conv_id long, ckey long, turn long, seq int, kind string, id string, name string, after array<string>, "
           "role string, body string, errors array<string>")


def _object(text: str):
    if not text.lstrip().startswith("{"):
        return None
    try:
        value = json.loads(text, parse_float=_finite, parse_constant=_finite)
        canonical(value)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _finite(text: str) -> float:
    x = float(text)
    if not math.isfinite(x):
        raise ValueError(text)
    return x


def _events(batches: Iterator[pa.RecordBatch], schemas: dict) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("ckey", pa.int64()), ("turn", pa.int64()), ("seq", pa.int32()), ("kind", pa.string()),
                        ("id", pa.string()), ("name", pa.string()), ("after", pa.list_(pa.string())), ("role", pa.string()),
                        ("body", pa.string()), ("errors", pa.list_(pa.string()))])
    for b in batches:
        rows = []
        for m in b.to_pylist():
            head = {"conv_id": m["conv_id"], "ckey": m["ckey"], "turn": m["turn"], "role": m["role"], "seq": 0, "after": [],
                    "errors": [], "name": None, "id": None}
            got = _object(m["text"])
            calls = got.get("tool_calls") if got else None
            if isinstance(calls, list) and calls and all(isinstance(c, dict) for c in calls):
                for k, c in enumerate(calls):
                    args = c.get("arguments", {})
                    if isinstance(args, str):
                        args = _object(args) if _object(args) is not None else args
                    name, own = clean(str(c.get("name"))), clean(str(c.get("id")))
                    wrong = validate(args, schemas[name]) if name in schemas else ["unknown tool"]
                    after = c.get("after") or []
                    rows.append(head | {"seq": k, "kind": "call", "id": own, "name": name, "errors": [clean(x) for x in wrong],
                                        "after": [clean(str(x)) for x in (after if isinstance(after, list) else [after])],
                                        "body": canonical({"arguments": args, "id": own, "name": name})})
            elif got and m["role"] == "tool" and "tool_call_id" in got:
                rows.append(head | {"kind": "result", "id": clean(str(got["tool_call_id"])), "body": canonical(got)})
            elif m["role"] == "user":
                own = f"{m['ckey']}:{m['turn']}"
                args = {"prompt": m["text"]}
                wrong = validate(args, schemas["reply"]) if "reply" in schemas else ["unknown tool"]
                rows.append(head | {"kind": "call", "id": own, "name": "reply", "errors": wrong,
                                    "body": canonical({"arguments": args, "id": own, "name": "reply"})})
            elif m["role"] == "assistant" and m["asked"] is not None:
                own = f"{m['ckey']}:{m['asked']}"
                rows.append(head | {"kind": "result", "id": own, "body": canonical({"content": m["text"], "tool_call_id": own})})
            else:
                rows.append(head | {"kind": "message", "body": canonical({"content": m["text"], "role": m["role"]})})
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def events(messages: DataFrame, schemas: dict) -> DataFrame:
    ckey = F.coalesce(F.col("conv_id").cast("long"), F.lit(NULL_ID))
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), ckey.alias("ckey"),
                           F.coalesce(F.col("turn").cast("long"), F.lit(NULL_ID)).alias("turn"),
                           F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
                           F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # the answer to a user message is the assistant message of the next turn: an equi-join, no window over a conversation
    asks = rows.where("role = 'user'").select("ckey", F.col("turn").alias("asked")).where(F.col("asked") < NULL_ID).distinct()
    asks = asks.withColumn("next", F.col("asked") + 1).withColumnRenamed("ckey", "ackey")
    rows = rows.join(asks, (F.col("ckey") == F.col("ackey")) & (F.col("turn") == F.col("next")) & (F.col("role") == "assistant"), "left")
    rows = rows.select("conv_id", "ckey", "turn", "role", "text", "asked")
    return rows.mapInArrow(lambda it: _events(it, schemas), _EVENTS)


def link_tool_calls(messages: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """One row an event: conv_id, turn, seq, kind, id, status, valid, errors, rank (level, turn, seq as one
    sortable string) and json."""
    ev = stored(events(messages, schemas), "chat-events")
    key = ["ckey", "id"]
    first = F.struct("turn", "seq")
    calls = ev.where("kind = 'call'").groupBy(*key).agg(F.min(first).alias("call_at"))
    results = ev.where("kind = 'result'").groupBy(*key).agg(F.min(first).alias("result_at"))
    # (ckey, id) are few rows each, as both sides are aggregated; an identifier repeated a million times is one row
    links = calls.join(results, key, "full_outer")
    # edges from a call to those it comes after, and from a result to its call
    edges = ev.where("kind = 'call' and size(after) > 0").select(
        "ckey", F.col("id").alias("to"), F.explode(F.array_distinct("after")).alias("from")).distinct()
    place = links.where("call_at is not null").select("ckey", "id", "call_at")
    ends = edges.join(place.withColumnsRenamed({"id": "to", "call_at": "to_at"}), ["ckey", "to"]).join(
        place.withColumnsRenamed({"id": "from", "call_at": "from_at"}), ["ckey", "from"])
    ends = stored(ends, "chat-edges")
    back = ends.where("from_at >= to_at").select("ckey").distinct()
    levels = _levels(ends.join(back, "ckey", "left_semi"), place.join(back, "ckey", "left_semi"))
    out = ev.join(links, key, "left").join(levels, key, "left")
    at = F.struct("turn", "seq")
    status = (F.when(F.col("kind") == "message", "message").when(F.col("level") < 0, "cycle")
              .when(F.col("kind") == "call", F.when(F.col("result_at").isNull(), "open").otherwise("linked"))
              .when(F.col("call_at").isNull(), "orphan").when(at > F.col("result_at"), "repeated").otherwise("linked"))
    level = F.when(F.col("level") < 0, F.lit(NULL_ID)).otherwise(F.coalesce("level", F.lit(0)))
    # where no edge points back the level is 0 and the turn decides; a result ranks after its call
    late = F.when((F.col("kind") == "result") & (F.col("call_at") > at), F.col("call_at")).otherwise(at)
    rank = F.format_string("%019d.%019d.%010d.%d", level, late["turn"], late["seq"], F.when(F.col("kind") == "result", 1).otherwise(0))
    return out.select("conv_id", "turn", "seq", "kind", "id", status.alias("status"), (F.size("errors") == 0).alias("valid"),
                      "errors", rank.alias("rank"), F.col("body").alias("json"))


def _ordered(pairs: pd.DataFrame) -> pd.DataFrame:
    """The levels of one conversation's calls (rows from, to; from is null in a row for each call)."""
    ids, after, waits = [], defaultdict(list), defaultdict(int)
    for a, b in zip(pairs["from"], pairs["to"]):
        if a is None:
            ids.append(b)
        else:
            after[a].append(b)
            waits[b] += 1
    level = {x: 0 for x in ids if not waits[x]}
    ready = deque(level)
    while ready:
        x = ready.popleft()
        for y in after[x]:
            waits[y] -= 1
            if not waits[y]:
                level[y] = level[x] + 1
                ready.append(y)
    return pd.DataFrame({"ckey": pairs["ckey"].iloc[0] if ids else 0, "id": ids, "level": [level.get(x, -1) for x in ids]})


def _levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ckey, id, level) of calls in conversations with an edge that points back; level -1 in or behind a cycle."""
    edges = stored(edges.select("ckey", "from", "to"), "chat-back-edges")
    nodes = stored(nodes.select("ckey", "id"), "chat-open")
    counted = edges.select("ckey").unionByName(nodes.select("ckey")).groupBy("ckey").count()
    large = stored(counted.where(F.col("count") > GATHER).select("ckey"), "chat-large")
    here = edges.unionByName(nodes.select("ckey", F.lit(None).cast("string").alias("from"), F.col("id").alias("to"))).join(large, "ckey", "left_anti")
    small = here.groupBy("ckey").applyInPandas(_ordered, "ckey long, id string, level long")
    return small.unionByName(_rounds(edges.join(large, "ckey", "left_semi"), nodes.join(large, "ckey", "left_semi")))


def _rounds(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Levels by joins: each round settles the calls all of whose predecessors are settled; it ends when a round
    settles none."""
    open_ = stored(nodes, "chat-open")
    done = nodes.withColumn("level", F.lit(0).cast("long")).limit(0)
    level = 0
    while not open_.isEmpty():
        waits = edges.join(open_.withColumnRenamed("id", "from"), ["ckey", "from"], "left_semi").select("ckey", F.col("to").alias("id"))
        ready = stored(open_.join(waits, ["ckey", "id"], "left_anti").withColumn("level", F.lit(level).cast("long")), "chat-ready")
        if ready.isEmpty():
            return done.unionByName(open_.withColumn("level", F.lit(-1).cast("long")))
        done = done.unionByName(ready)
        open_ = stored(open_.join(ready, ["ckey", "id"], "left_anti"), "chat-open")
        level += 1
    return done
