"""Linking, ordering and validation of tool calls against a plain Python version."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from profitlens.llm import chat_format
from profitlens.llm.common import NULL_ID, reach

SCHEMAS = {
    "add": {"type": "object", "required": ["a", "b"], "additionalProperties": False, "properties": {"a": {"type": "integer"}, "b": {"type": "number"}}},
    "say": {"type": "object", "properties": {"words": {"type": "array", "items": {"type": "string", "minLength": 1}}, "tone": {"type": "string", "enum": ["soft", "loud"]}}},
}


def _conversations(seed: int, n: int = 40):
    rng, rows = random.Random(seed), []
    for conv in range(n):
        calls = [f"c{i}" for i in range(rng.randint(1, 7))]
        turn = 0
        for i, c in enumerate(calls):
            name = rng.choice(["add", "say", "other"])
            args = rng.choice([{"a": 1, "b": 2.5}, {"a": True, "b": 1}, {"a": 1}, {"words": ["x", ""]}, {"tone": "shrill"}, {"b": 2, "a": 3, "z": "Ä"}, [1]])
            call = {"id": c, "name": name, "arguments": json.dumps(args) if rng.random() < 0.3 else args}
            if rng.random() < 0.6:
                call["after"] = rng.sample(calls + ["gone"], k=rng.randint(1, 2))
            rows.append((conv, turn, "assistant", json.dumps({"tool_calls": [call]})))
            turn += 1
            for _ in range(rng.choice([0, 1, 1, 2])):
                rows.append((conv, turn, "tool", json.dumps({"tool_call_id": rng.choice([c, "nobody"]), "content": i})))
                turn += 1
    return rows


def _plain(rows):
    """(conv, turn) -> kind, id, status, valid, level of the call."""
    out = {}
    for conv in {r[0] for r in rows}:
        calls, results, events = {}, {}, {}
        for c, turn, role, text in rows:
            if c != conv:
                continue
            got = json.loads(text)
            if "tool_calls" in got:
                call = got["tool_calls"][0]
                events[turn] = ("call", call)
                calls.setdefault(call["id"], (turn, call))
            else:
                events[turn] = ("result", got)
                results.setdefault(got["tool_call_id"], turn)
        before = {i: {a for a in call.get("after", ()) if a in calls} for i, (_, call) in calls.items()}
        back = any(calls[a][0] >= calls[i][0] for i in before for a in before[i])
        level, todo = {}, set(calls)
        while ready := {i for i in todo if not before[i] & todo}:
            level |= dict.fromkeys(ready, max(level.values(), default=-1) + 1)
            todo -= ready
        for turn, (kind, e) in events.items():
            own = e["id"] if kind == "call" else e["tool_call_id"]
            place = -1 if own in todo and back else level.get(own, 0) if back else 0
            valid = True
            if kind == "call":
                status = "cycle" if place < 0 else "linked" if own in results else "open"
                args = json.loads(e["arguments"]) if isinstance(e["arguments"], str) and e["arguments"].startswith("{") else e["arguments"]
                valid = _valid(e["name"], args)
            else:
                status = "cycle" if place < 0 else "orphan" if own not in calls else "repeated" if turn > results[own] else "linked"
            out[conv, turn] = (kind, own, status, valid, place)
    return out


def _valid(name, args):
    if name == "add":
        whole = lambda x: isinstance(x, int) and not isinstance(x, bool)
        return isinstance(args, dict) and set(args) == {"a", "b"} and whole(args["a"]) and (whole(args["b"]) or isinstance(args["b"], float))
    if name == "say":
        if not isinstance(args, dict):
            return False
        words, tone = args.get("words", []), args.get("tone", "soft")
        return isinstance(words, list) and all(isinstance(w, str) and w for w in words) and tone in ("soft", "loud")
    return False


@pytest.mark.parametrize("gather", [chat_format.GATHER, 0])
def test_generated_calls(spark, monkeypatch, gather):
    reach(spark)
    monkeypatch.setattr(chat_format, "GATHER", gather)
    rows = _conversations(3, 40 if gather else 12)
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("id", F.lit("clash"))
    want = _plain(rows)
    got = chat_format.link_tool_calls(messages, SCHEMAS).collect()
    assert len(got) == len(rows)
    for r in got:
        level = int(r.rank.split(".")[0])
        assert (r.kind, r.id, r.status, r.valid, -1 if level == NULL_ID else level) == want[r.conv_id, r.turn], r
        assert json.dumps(json.loads(r.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.json
    by = {}
    for r in sorted(got, key=lambda r: (r.conv_id, r.rank)):
        by.setdefault((r.conv_id, r.kind, r.id), r.rank)
    for r in got:  # a result comes after its call
        if r.kind == "result" and r.status == "linked":
            assert by[r.conv_id, "call", r.id] < r.rank


def test_texts_that_are_no_json(spark):
    reach(spark)
    bad = ['{"tool_calls": [{"id": "\\ud800", "name": "\\udc00x", "arguments": {"words": ["\\ud83d\\ude00"]}, "after": ["\\ud800"]}]}',
           '{"tool_calls": [{"id": 1, "name": "say", "arguments": {"x": NaN}}]}', '{"tool_calls": [{"id": 1, "name": "say", "arguments": {"x": 1e400}}]}',
           '{"tool_calls": []}', '{"tool_calls": [1]}', '{"tool_calls": {}}', "{" * 5000, '{"a":' * 5000 + "1" + "}" * 5000, "{}", " ", "x" * 300_000]
    rows = [(1, i, "assistant", t) for i, t in enumerate(bad)] + [(2, 0, "tool", '{"tool_call_id": "\\ud800"}'), (2, 1, "tool", '{"tool_call_id": -Infinity}'), (2, 1, "tool", "[1]")]
    rows += [(3, 0, "user", "hi"), (3, 1, "assistant", "yes"), (3, 1, "assistant", "yes"), (4, 0, "user", ""), (4, 2, "assistant", "late"), (None, None, "user", "q"), (None, None, "assistant", "a")]
    got = chat_format.link_tool_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), SCHEMAS).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): r for r in got}
    assert by[1, 0].id == "�" and "😀" in by[1, 0].json and "�" in by[1, 0].json
    assert all(by[1, i].kind == "message" for i in range(1, len(bad))) and by[2, 0].status == "orphan" and by[2, 1].kind == "message"
    assert json.loads(by[1, 1].json)["content"] == bad[1]
    assert [r.status for r in got if (r.conv_id, r.turn) == (3, 1)] == ["linked", "linked"] and by[4, 2].kind == "message"
