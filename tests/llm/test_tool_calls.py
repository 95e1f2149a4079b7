"""Tool calls: linking, order, validation, canonical JSON."""

from __future__ import annotations

import json
import random

from provisio.llm import tool_calls as X

SCHEMA = f"conv_id long, turn long, role string, text string, calls {X.CALL}, result_of string, status int"
TOOLS = {"add": {"a": ("number", True), "b": ("number", True)}, "say": {"t": ("string", False)}}


def call(id_, name="say", **args):
    return (id_, name, json.dumps(args))


MESSAGES = [
    (1, 0, "user", "hi", None, None, 0),
    (1, 1, "assistant", None, [call("a", "add", b=2, a=1), call("b", t={"$ref": "a"}), call("b", t="again")], None, 0),
    (1, 2, "tool", "3", None, "a", 0),
    (1, 3, "tool", "late", None, "a", 0),
    (1, 4, "tool", "?", None, "zz", 0),
    (2, 0, "assistant", None, [call("x", t={"$ref": "z"}), call("y", t={"$ref": "x"}), call("z", t="é")], None, 0),
    (3, 0, "assistant", None, [call("p", t={"$ref": "q"}), call("q", t={"$ref": "p"}), call("r")], None, 0),
    (4, 0, "assistant", None, [call("m", "add", a=1), call("n", "nope"), ("o", "say", "{bad"), ("", "say", "{}"), (None, "say", None), call("k", t={"$ref": "gone"}), call("l", t=1), call("j", u=1), ("i", "add", '{"a":NaN,"b":1}')], None, 0),
    (5, 0, "system", None, [], "", 0),
    (5, 0, "system", None, [], "", 0),
    (None, 0, "user", "no conversation", None, None, 0),
]


def _run(spark, rows):
    return X.link_calls(spark.createDataFrame(rows, SCHEMA), TOOLS).collect()


def test_links_order_and_faults(spark):
    got = _run(spark, MESSAGES)
    by = {(r.conv_id, r.id, r.status): r for r in got}
    assert by[1, "a", "linked"].json == '{"arguments":{"a":1,"b":2},"id":"a","name":"add","result":"3","role":"assistant"}'
    assert by[1, "b", "no_result"].place == 1 and (1, "b", "repeated_call") in by
    assert by[1, "a", "repeated_result"].turn == 3 and by[1, "zz", "orphan_result"].turn == 4
    assert {i: by[2, i, "no_result"].level for i in "xyz"} == {"z": 0, "x": 1, "y": 2}
    assert '"t":"é"' in by[2, "z", "no_result"].json
    assert {(i, s): r.level for (c, i, s), r in by.items() if c == 3} == {("p", "cycle"): None, ("q", "cycle"): None, ("r", "no_result"): 0}
    faults = {r.id: r.fault for r in got if r.conv_id == 4}
    assert faults == {"m": "missing b", "n": "unknown tool", "o": "not JSON", "": None, None: "not JSON", "k": "unknown reference gone", "l": "t is no string", "j": "unexpected u", "i": "not JSON"}
    assert sum(r.conv_id == 5 and r.status == "message" for r in got) == 2
    assert sum(r.conv_id is None for r in got) == 1
    assert not [r for r in got if json.loads(r.json) is None]


def test_canonical_json_round_trip():
    value = {"b": [1, 2.5, None, True], "a": {"é": "\n", "A": ""}}
    assert X.canonical(value) == '{"a":{"A":"","é":"\\n"},"b":[1,2.5,null,true]}' and json.loads(X.canonical(value)) == value


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    at = {(c, t): (r, x) for c, t, r, x in rows}
    got = X.op6_tool_calls(spark, sf_dir).collect()
    users = {k for k, (r, _) in at.items() if r == "user"}
    calls = {(r.conv_id, r.turn): r for r in got if r.role == "user"}
    assert sorted(calls) == sorted(users) and all(r.fault is None for r in calls.values())
    for (c, t), r in calls.items():
        behind = t
        while (c, behind - 2) in users:
            behind -= 2
        assert r.level == (t - behind) // 2
        answer = at.get((c, t + 1))
        linked = answer is not None and answer[0] == "assistant"
        want = {"prompt": at[c, t][1], "turn": t} | ({"after": {"$ref": f"{c}-{t - 2}"}} if (c, t - 2) in users else {})
        assert json.loads(r.json) == {"arguments": want, "id": f"{c}-{t}", "name": "reply", "result": answer[1] if linked else None, "role": "user"}
        assert r.status == ("linked" if linked else "no_result")
    assert len(got) == len(rows) - sum(r.status == "linked" for r in calls.values())


def test_edge_cases(spark):
    assert _run(spark, MESSAGES[:0] or [(9, 0, "user", "x" * 1_000_000, None, None, 0)])[0].status == "message"
    assert X.link_calls(spark.createDataFrame(MESSAGES, SCHEMA).limit(0)).count() == 0


def test_text_beside_calls_stays(spark):
    rows = [(1, 0, "assistant", "let me see", [call("a"), call("b")], None, 0), (1, 1, "assistant", "", [call("c")], None, 0)]
    got = _run(spark, rows)
    assert [r.json for r in got if r.status == "message"] == ['{"content":"let me see","role":"assistant"}']
    assert sorted(r.id for r in got if r.status != "message") == ["a", "b", "c"]


def test_levels_by_brute_force(spark):
    """Random graphs with chains, junctions and cycles, and one long chain."""
    rng = random.Random(6)
    edges = [(9, i, i - 1) for i in range(1, 600)]
    nodes = [(9, i) for i in range(600)]
    for c in range(8):
        nodes += [(c, i) for i in range(40)]
        for i in range(40):
            for j in rng.sample(range(40), rng.choice([0, 1, 1, 1, 2, 3])):
                if j < i or (c % 4 == 0 and rng.random() < 0.05):
                    edges.append((c, i, j))

    def level(c, i, seen=()):
        if i in seen:
            return None
        behind = [level(c, j, (*seen, i)) for j in refs.get((c, i), ())]
        return None if None in behind else 1 + max(behind) if behind else 0

    refs = {}
    for c, i, j in edges:
        refs.setdefault((c, i), []).append(j)
    want = {(c, f"n{i}"): i if c == 9 else level(c, i) for c, i in nodes}
    tables = spark.createDataFrame([(c, f"n{i}") for c, i in nodes], "conv_id long, id string"), spark.createDataFrame([(c, f"n{i}", f"n{j}") for c, i, j in edges], "conv_id long, id string, needs string")
    for small in (0, X.SMALL, 10_000):
        assert {(r.conv_id, r.id): r.level for r in X.levels(*tables, small).collect()} == want


def test_a_chain_of_junctions(spark):
    """Every call needs the two before it."""
    edges = [(1, f"n{i}", f"n{i - k}") for i in range(200) for k in (1, 2) if i >= k]
    got = X.levels(spark.createDataFrame([(1, f"n{i}") for i in range(200)], "conv_id long, id string"), spark.createDataFrame(edges, "conv_id long, id string, needs string"))
    assert {r.id: r.level for r in got.collect()} == {f"n{i}": i for i in range(200)}


def test_references_are_read_from_the_json(spark):
    """Identifiers with quotes, backslashes and escapes; a reference key written with an escape; text that only looks like one."""
    odd = ['a"b', "back\\slash", "é\n", "plain"]
    calls = [call(i) for i in odd] + [call(f"to {n}", t={"$ref": i}) for n, i in enumerate(odd)]
    calls += [("esc", "say", '{"t":{"\\u0024ref":"a\\u0022b"}}'), call("text", t='{"$ref": "plain"}'), call("lost", t={"$ref": 'no"ne'}), call("deep", t={"x": [{"y": {"$ref": "plain"}}]})]
    got = {r.id: r for r in _run(spark, [(1, 0, "assistant", None, calls, None, 0)])}
    assert all(got[f"to {n}"].level == 1 for n in range(len(odd))) and got["esc"].level == got["deep"].level == 1
    assert got["text"].level == 0 and got["lost"].fault == 'unknown reference no"ne' and got["to 0"].fault is None


def test_one_bad_call_does_no_harm(spark):
    """Numbers out of range, lone surrogates, deep nesting and rows without a conversation."""
    bad = [("a", "add", '{"a":1e999,"b":1}'), ("b", "say", '{"t":"\\ud800"}'), ("c", "say", '{"t":' * 50_000), ("d", "add", '{"a":' + "9" * 5000 + ',"b":1}'), ("e", "add", '{"a":-1e400,"b":[1e999]}')]
    rows = [(1, 0, "assistant", None, bad, None, 0), (None, 0, "assistant", None, [call("x"), call("y", t={"$ref": "x"})], None, 0), (None, 1, "tool", "out", None, "x", 0)]
    got = _run(spark, rows)
    assert {r.id: r.fault for r in got if r.conv_id == 1} == {"a": "number out of range", "b": "lone surrogate", "c": "not JSON", "d": "not JSON", "e": "number out of range"}
    assert sorted((r.id, r.status, r.level) for r in got if r.conv_id is None) == [("x", "no_result", 0), ("x", "orphan_result", None), ("y", "no_result", 0)]
    assert json.loads(next(r.json for r in got if r.id == "a"))["arguments"] == bad[0][2]
