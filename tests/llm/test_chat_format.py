"""Chat formatting against brute force: links, order, validation and canonical lines."""

import hashlib
import json
import random

import pytest

from threadloom.llm import chat_format

TURNS = "conv_id long, turn long, role string, text string"
SCHEMAS = [("add", "x", "integer", True), ("add", "y", "number", False), ("say", "s", "string", True), ("say", "o", "object", False), ("say", "a", "array", False), ("say", "b", "boolean", False), ("reply", "text", "string", True)]


def fits(value, kind: str) -> bool:
    if isinstance(value, bool):
        return kind == "boolean"
    return {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list}[kind] is not None and isinstance(value, {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list}[kind])


def parsed(text: str):
    def once(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError
        return dict(pairs)

    return json.loads(text, object_pairs_hook=once)


def line(x) -> str:
    return json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def brute_force(rows) -> list[tuple]:
    copies: dict = {}
    for c, t, role, text in rows:
        k = (c, t, role or "", text or "")
        copies[k] = copies.get(k, 0) + 1
    calls, results, messages = [], [], []
    for (c, t, role, text), n in copies.items():
        known = c is not None and t is not None
        try:
            o = json.loads(text) if known and text.lstrip(" ").startswith("{") else {}
        except ValueError:
            o = {}
        issued, answer = o.get("tool_calls") or [], o.get("tool_call_id") if role == "tool" else None
        for i, x in enumerate(issued):
            id_, args = x.get("id"), x.get("arguments")
            args = "{}" if args is None else args if isinstance(args, str) else json.dumps(args, separators=(",", ":"))
            calls.append({"c": c, "t": t, "ord": i, "role": role, "n": n, "parent": f"id:{answer}" if answer is not None else None, "key": None if id_ is None else f"id:{id_}", "id": id_, "name": x.get("name"), "args": args})
        if answer is not None:
            results.append({"c": c, "t": t, "role": role, "n": n, "key": f"id:{answer}", "id": answer, "content": o.get("content") or ""})
        elif issued:
            if o.get("content"):
                messages.append((c, t, role, o["content"], n))
        elif known and role == "user":
            calls.append({"c": c, "t": t, "ord": 0, "role": role, "n": n, "parent": None, "key": f"turn-{t}", "id": f"turn-{t}", "name": "reply", "args": line({"text": text})})
        elif known and role == "assistant":
            results.append({"c": c, "t": t, "role": role, "n": n, "key": f"turn-{t - 1}", "id": f"turn-{t - 1}", "content": text})
        else:
            messages.append((c, t, role, text, n))
    call_order = lambda x: (x["t"], x["ord"], sha(x["args"]), x["name"] is not None, x["name"] or "", x["role"])
    result_order = lambda x: (x["t"], sha(x["content"]), x["role"])
    firsts, answers = {}, {}
    for x in sorted(calls, key=call_order):
        if x["key"] is not None:
            firsts.setdefault((x["c"], x["key"]), x)
    for x in sorted(results, key=result_order):
        answers.setdefault((x["c"], x["key"]), x)
    place: dict = {}

    def place_of(k, path=()):
        """(position, depth) along the chain of parents; None in a circle."""
        if k in path:
            return None
        x = firsts[k]
        up = (x["c"], x["parent"])
        if x["parent"] is None or up not in firsts:
            return x["t"], 0
        above = place_of(up, (*path, k))
        return above and (max(x["t"], above[0]), above[1] + 2)

    for k, x in firsts.items():
        place[k] = place_of(k) or (x["t"], 0)
    out = []
    for x in calls:
        k = (x["c"], x["key"])
        again = x["key"] is not None and call_order(x) != call_order(firsts[k])
        at = place[k] if x["key"] is not None and not again else (x["t"], 0)
        try:
            args = parsed(x["args"])
        except ValueError:
            args = None
        own = [s for s in SCHEMAS if s[0] == x["name"]]
        valid = isinstance(args, dict) and bool(own) and all((not req if args.get(f) is None else fits(args[f], kind)) for _, f, kind, req in own)
        try:
            shown = parsed(x["args"])
        except ValueError:
            shown = x["args"]
        text = line({"arguments": shown, "id": x["id"], "name": x["name"], "role": x["role"], "valid": valid})
        out.append((x["c"], x["t"], *at, "call", x["id"], k in answers, valid, again, x["n"], text))
    for x in results:
        k = (x["c"], x["key"])
        at = place.get(k)
        linked = at is not None
        position, depth = (max(x["t"], at[0]), at[1] + 1 if at[0] >= x["t"] else 0) if linked else (x["t"], 0)
        out.append((x["c"], x["t"], position, depth, "result", x["id"], linked, None, result_order(x) != result_order(answers[k]), x["n"], line({"call_id": x["id"], "content": x["content"], "linked": linked, "role": x["role"]})))
    for c, t, role, text, n in messages:
        out.append((c, t, t, 0, "message", None, False, None, False, n, line({"content": text, "role": role})))
    return sorted(out, key=str)


def check(spark, rows):
    df = chat_format.format_chats(spark.createDataFrame(rows, TURNS), chat_format.schema_table(spark, SCHEMAS))
    assert df.columns == ["conv_id", "turn", "position", "depth", "kind", "call_id", "linked", "valid", "repeated", "copies", "line"]
    got = sorted(map(tuple, df.collect()), key=str)
    want = brute_force(rows)
    assert got == want, [x for x in got if x not in want][:3] + [x for x in want if x not in got][:3]
    return got


ARGUMENTS = ['{"x": 1}', '{"x": "5"}', '{"x": 1.5}', '{"y": 2, "x": 3}', '{"x":3,"y":2}', '{"x": null}', '{"x": 1, "x": 2}', "no json", "[1]", '"text"', '{"s": "a", "o": {"k": {"z": 1, "b": [true, null]}}}', '{"s": {"k": 1}}', '{"s": "\\"q\\" é", "a": [], "b": false}', '{"x": 12345678901234567890}', None, "{}"]


@pytest.mark.parametrize("seed", range(3))
def test_random_conversations(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(260):
        c, t = rng.choice([1, 2, 3, None]) if rng.random() < 0.1 else rng.randrange(12), rng.choice([None, *range(10)]) if rng.random() < 0.1 else rng.randrange(10)
        call = lambda: {k: v for k, v in (("id", rng.choice([None, *"abcdef"])), ("name", rng.choice(["add", "say", "who", None])), ("arguments", rng.choice(ARGUMENTS))) if rng.random() < 0.95}
        kind = rng.randrange(6)
        if kind == 0:
            role, text = rng.choice(["user", "assistant", "system", None, "tool"]), rng.choice(["hi", "", None, "  {x", "{}", '{"a": 1}', "ok ok"])
        elif kind < 3:
            role, text = "assistant", json.dumps({"tool_calls": [call() for _ in range(rng.randrange(3))], "content": rng.choice([None, "", "let me see"])})
        elif kind < 5:
            role, text = "tool", json.dumps({"tool_call_id": rng.choice("abcdefg"), "content": rng.choice(["2", None, "x y"])} | ({"tool_calls": [call()]} if rng.random() < 0.3 else {}))
        else:
            role, text = rng.choice(["user", "assistant"]), f"word {rng.randrange(5)}"
        rows += [(c, t, role, text)] * rng.choice([1, 1, 1, 2])
    check(spark, rows)


def test_a_chain_is_ordered_by_depth(spark):
    call = lambda i: {"id": i, "name": "add", "arguments": '{"x": 1}'}
    rows = [(1, 9, "assistant", json.dumps({"tool_calls": [call("a")], "content": "first"}))]
    for i, (x, y) in enumerate(["ab", "bc", "cd", "de"]):
        rows.append((1, 4 - i, "tool", json.dumps({"tool_call_id": x, "content": x, "tool_calls": [call(y)]})))
    rows.append((1, 0, "tool", json.dumps({"tool_call_id": "e", "content": "end"})))
    got = sorted((x for x in check(spark, rows) if x[4] != "message"), key=lambda x: (x[2], x[3]))
    assert [(x[5], x[4], x[2], x[3]) for x in got] == [(i, k, 9, 2 * d + (k == "result")) for d, i in enumerate("abcde") for k in ("call", "result")]
    circle = [(2, 1, "tool", json.dumps({"tool_call_id": "p", "tool_calls": [call("q")]})), (2, 2, "tool", json.dumps({"tool_call_id": "q", "tool_calls": [call("p")]}))]
    check(spark, rows + circle)


def test_odd_tables(spark):
    assert check(spark, []) == []
    check(spark, [(None, None, None, None)] * 3 + [(1, 1, "user", "word " * 50_000), (1, 2, "assistant", "long " * 50_000)])
    extra = spark.createDataFrame([(1, 0, "user", "hi", "k", 5, True)], TURNS + ", key string, ord int, linked boolean")
    assert chat_format.format_chats(extra).count() == 1
    (row,) = chat_format.format_chats(extra, chat_format.schema_table(spark, [])).collect()
    assert not row.valid and row.line == '{"arguments":{"text":"hi"},"id":"turn-0","name":"reply","role":"user","valid":false}'
