import hashlib
import json
import random

import pytest

from docweir.llm import chat_format as c

CALL = json.dumps({"tool_calls": [{"id": "a", "name": "search", "arguments": {"query": "x", "limit": 3}}, {"id": "b", "name": "fetch", "arguments": {"url": {"$ref": "a"}}}]})
ROWS = [
    (1, 0, "user", 'say "hi"\n'), (1, 1, "assistant", CALL), (1, 2, "user", "wait"), (1, 3, "tool", '{"tool_call_id":"b","content":"page"}'),
    (1, 4, "tool", '{"content":"hits","tool_call_id":"a"}'), (1, 5, "tool", '{"tool_call_id":"zz","content":"lost"}'), (1, 6, "assistant", None),
    (2, 0, "assistant", '{"tool_calls":[{"id":"p","name":"fetch","arguments":{"url":{"$ref":"q"}}},{"id":"q","name":"fetch","arguments":{"url":{"$ref":"p"}}}]}'),
    (2, 1, "assistant", '{"tool_calls":[{"id":"r","name":"search","arguments":{"limit":"many","z":1}}]}'), (2, 2, "assistant", "{not json"), (2, 3, None, "x"),
    (3, 0, "user", "same"), (3, 0, "user", "same"), (None, None, "user", ""),
]


def test_links_order_and_json(spark):
    df = spark.createDataFrame([(*r, 7) for r in ROWS], "conv_id long, turn long, role string, text string, json int")
    rows = c.format_chats(df).collect()
    assert len(rows) == len(ROWS)
    one = sorted((r for r in rows if r.conv_id == 1), key=lambda r: r.position)
    assert [r.position for r in one] == list(range(7))
    assert [(r.turn, r.kind, r.status) for r in one] == [
        (0, "message", None), (1, "call", "linked"), (4, "result", "linked"), (3, "result", "linked"), (2, "message", None), (5, "result", "orphan"), (6, "message", None),
    ]
    assert one[0].json == '{"content":"say \\"hi\\"\\n","role":"user"}'
    assert one[1].json == '{"role":"assistant","tool_calls":[{"arguments":{"limit":3,"query":"x"},"id":"a","name":"search"},{"arguments":{"url":{"$ref":"a"}},"id":"b","name":"fetch"}]}'
    assert one[1].level == 1 and one[1].problems == []
    assert json.loads(one[6].json) == {"content": None, "role": "assistant"}
    assert one[2].json == '{"content":"hits","role":"tool","tool_call_id":"a"}'
    two = {r.turn: r for r in rows if r.conv_id == 2}
    assert two[0].status == "circular" and two[1].status == "unanswered"
    assert two[1].problems == ["limit is no integer", "missing query", "unexpected z"]
    assert two[2].kind == "message" and json.loads(two[3].json) == {"content": "x", "role": None}
    assert sorted(r.position for r in rows if r.conv_id == 3) == [0, 1]
    assert c.format_chats(df.limit(0)).count() == 0


def references(value):
    if isinstance(value, dict):
        if value.keys() == {"$ref"} and isinstance(value["$ref"], str):
            yield value["$ref"]
        else:
            for v in value.values():
                yield from references(v)
    elif isinstance(value, list):
        for v in value:
            yield from references(v)


def brute_force(rows):
    """(position, kind, status, level, unknown references) of each row of one conversation, in order of the rows given."""
    parsed, calls, results = {}, {}, {}
    for turn, role, text in set(rows):
        try:
            value = json.loads(text)
        except (TypeError, ValueError):
            value = None
        if role == "assistant" and isinstance(value, dict) and value.get("tool_calls"):
            parsed[turn, role, text] = value["tool_calls"]
            for call in value["tool_calls"]:
                calls.setdefault(call["id"], []).append((turn, {*references(call["arguments"])}))
        elif role == "tool" and isinstance(value, dict) and value.get("tool_call_id") is not None:
            parsed[turn, role, text] = value["tool_call_id"]
            results.setdefault(value["tool_call_id"], []).append((turn, hashlib.md5(text.encode()).hexdigest()))
    needs = {i: {o for _, refs in own for o in refs if o in calls} for i, own in calls.items()}
    known = {}
    for _ in calls:
        for i, own in needs.items():
            if i not in known and own <= known.keys():
                known[i] = (1 + max((known[o][0] for o in own), default=-1), max(max(t for t, _ in calls[i]), *(known[o][1] for o in own), 0))
    out = []
    for turn, role, text in rows:
        found, digest = parsed.get((turn, role, text)), hashlib.md5(text.encode()).hexdigest()
        if isinstance(found, list):
            ids = [c["id"] for c in found]
            each = ["duplicate" if len(calls[i]) > 1 else "circular" if i not in known else "linked" if i in results else "unanswered" for i in ids]
            levels = [known[i][0] for i in ids if i in known]
            anchor = max(known[i][1] if i in known else turn for i in ids)
            status = min(each, key=["circular", "duplicate", "unanswered", "linked"].index)
            unknown = sorted({f"unknown reference {o}" for c in found for i in [c["id"]] for _, refs in calls[i] for o in refs if o not in calls})
            out.append((anchor, 2 * min(levels, default=0), turn, role, digest, "call", status, max(levels, default=None), unknown))
        elif found is not None:
            own = calls.get(found)
            anchor, level = (turn, None) if not own else known[found][::-1] if found in known else (max(t for t, _ in own), None)
            status = "orphan" if not own else "linked" if (turn, digest) == min(results[found]) else "repeated"
            out.append((anchor, 2 * (level or 0) + 1, turn, role, digest, "result", status, level, []))
        else:
            out.append((turn, 0, turn, role, digest, "message", None, None, []))
    places = sorted(out, key=lambda r: r[:5])
    return [[places.index(r) + rows[:k].count(rows[k]), *r[5:]] for k, r in enumerate(out)]


@pytest.mark.parametrize("seed", range(2))
def test_random_call_graphs(spark, seed):
    """Circles, references to nothing, ids used twice, repeated and early results, repeated messages, several calls a message."""
    rng = random.Random(seed)
    chats = {}
    for conv in range(40):
        rows, ids = [], [f"c{k}" for k in range(rng.randrange(1, 8))]
        for turn in range(rng.randrange(3, 16)):
            kind = rng.random()
            if kind < 0.45:
                made = []
                for i in rng.sample(ids, rng.randrange(1, min(3, len(ids)) + 1)):
                    refs = [{"$ref": rng.choice([*ids, "nowhere", 'q"uo'])} for _ in range(rng.choice((0, 0, 1, 2)))]
                    made.append({"id": i, "name": "fetch", "arguments": {"url": refs[0] if refs else "u", "more": [*refs, {"$ref": "c0", "other": 1}, 'no {"$ref":"c1"}']}})
                rows.append((turn, "assistant", json.dumps({"tool_calls": made})))
            elif kind < 0.8:
                rows.append((turn, "tool", json.dumps({"tool_call_id": rng.choice([*ids, "nowhere"]), "content": str(turn)})))
            else:
                rows.append((turn, rng.choice(("user", "assistant")), f"text {turn}"))
            if rng.random() < 0.1:
                rows.append(rows[-1])
        chats[conv] = rows
    df = spark.createDataFrame([(k, *r) for k, rows in chats.items() for r in rows], "conv_id long, turn long, role string, text string")
    got = {}
    for r in c.format_chats(df).collect():
        unknown = sorted(p for p in r.problems if p.startswith("unknown reference"))
        got.setdefault(r.conv_id, []).append((r.turn, r.role, r.position, r.kind, r.status, r.level, unknown))
    statuses = set()
    for conv, rows in chats.items():
        want = sorted((*r[:2], *b) for r, b in zip(rows, brute_force(rows), strict=True))
        assert sorted(got[conv], key=str) == sorted(want, key=str), rows
        statuses |= {w[4] for w in want}
    assert statuses == {None, "linked", "unanswered", "duplicate", "circular", "orphan", "repeated"}


@pytest.mark.parametrize(("arguments", "want"), [
    ('{"query": "x", "limit": 3.0}', []), ('{"query": "x", "limit": 3.5}', ["limit is no integer"]), ('{"query": {"$ref": "a"}}', ["unknown reference a"]),
    ('{"query": {"$ref": "a", "other": 1}}', ["query is no string"]), ("[1]", ["arguments are no object"]), ("nonsense", ["arguments are no object"]),
    ('{"query": "x", "filters": [{"field": "f"}, {"value": 3, "z": 1}, null, 4]}', ["filters[] is no object", "filters[].value is no string", "missing filters[].field", "unexpected filters[].z"]),
    ('{"query": "x", "filters": {}}', ["filters is no array"]), ('{"query": null}', ["query is no string"]),
])
def test_arguments_against_schemas(spark, arguments, want):
    text = json.dumps({"tool_calls": [{"id": "x", "name": "search", "arguments": arguments}]})
    rows = c.format_chats(spark.createDataFrame([(1, 0, "assistant", text)], "conv_id long, turn long, role string, text string")).collect()
    assert rows[0].problems == want


def test_one_message_repeated_and_one_hot_id(spark):
    """A message that is most of a conversation is numbered without gaps over several ranges; an id that all calls use is a duplicate."""
    from docweir.llm.common import gapless

    rows = [("c", 1, "user", "again")] * 4000 + [("c", 2, "user", "end")]
    out = c.format_chats(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string"))
    assert sorted(r.position for r in out.collect()) == list(range(4001))
    dealt = gapless(spark.createDataFrame([(1, 2)] * 4000, "k int, v int").repartition(4), ["k"], ["v"], "n")
    assert sorted(r.n for r in dealt.collect()) == list(range(4000))
    call = '{"tool_calls": [{"id": "hot", "name": "f", "arguments": "{}"}]}'
    hot = spark.createDataFrame([("c", k, "assistant", call) for k in range(500)] + [("c", 501, "tool", '{"tool_call_id": "hot", "content": "x"}')], "conv_id string, turn int, role string, text string")
    assert {r.status for r in c.format_chats(hot).filter("kind = 'call'").collect()} == {"duplicate"}
