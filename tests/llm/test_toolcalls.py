import json

from vetline.llm.toolcalls import link_tool_calls

TOOLS = {"sum": {"b": ("integer", True), "a": ("number", True), "note": ("string", False), "ok": ("boolean", False)}, "now": {}}
CALLS = "conv_id long, call_id string, turn long, name string, arguments string, after string, status string"
RESULTS = "conv_id long, call_id string, turn long, content string, depth string"


def run(spark, calls, results):
    c = spark.createDataFrame([(*r, "x") for r in calls], CALLS)
    r = spark.createDataFrame([(*r, "x") for r in results], RESULTS)
    return link_tool_calls(c, r, TOOLS).collect()


def test_validation_and_canonical_lines(spark):
    good = '{ "b": 2, "a": 1.5, "note": "é\\n\\"" }'
    cases = {"ok": ("sum", good), "int_as_number": ("sum", '{"a":1,"b":2,"note":null}'), "not_json": ("sum", "{a"),
             "array": ("sum", "[1]"), "null": ("sum", None), "missing": ("sum", '{"a":1}'), "unknown": ("sum", '{"a":1,"b":2,"z":0}'),
             "type": ("sum", '{"a":1,"b":"2"}'), "bool": ("sum", '{"a":1,"b":2,"ok":"true"}'), "tool": ("drop", "{}"),
             "no_args": ("now", " {} "), "no_tool": (None, "{}")}
    calls = [(1, k, i, n, a, None) for i, (k, (n, a)) in enumerate(cases.items())]
    out = {r.call_id: r for r in run(spark, calls, [(1, k, 99, "done") for k in cases])}
    want = {"ok": None, "int_as_number": None, "not_json": "not_json", "array": "not_json", "null": "not_json",
            "missing": "missing_field", "unknown": "unknown_field", "type": "wrong_type", "bool": "wrong_type",
            "tool": "unknown_tool", "no_args": None, "no_tool": "unknown_tool"}
    assert {k: r.problem for k, r in out.items()} == want
    assert out["ok"].line == '{"arguments":{"a":1.5,"b":2,"note":"é\\n\\""},"id":"ok","name":"sum","result":"done"}'
    for k, problem in want.items():
        assert (out[k].line is None) == (problem is not None)
        if out[k].line:
            parsed = json.loads(out[k].line)
            assert list(parsed) == sorted(parsed) and list(parsed["arguments"]) == sorted(parsed["arguments"])


def test_links_order_and_statuses(spark):
    ok = '{"a":1,"b":2}'
    calls = [(1, "c", 1, "sum", ok, "b"), (1, "b", 2, "sum", ok, "a"), (1, "a", 3, "sum", ok, "gone"),
             (1, "x", 4, "sum", ok, "y"), (1, "y", 5, "sum", ok, "x"), (1, "z", 6, "sum", ok, "x"), (1, "s", 7, "sum", ok, "s"),
             (1, "d", 8, "sum", ok, None), (1, "d", 8, "sum", ok, None), (1, "d", 9, "sum", ok, None), (1, None, 10, "sum", ok, None),
             (2, "a", 1, "sum", ok, None), (None, "a", 1, "sum", ok, None)]
    calls += [(3, f"k{i}", 1000 - i, "sum", ok, f"k{i - 1}") for i in range(150)]
    results = [(1, "a", 9, "second"), (1, "a", 8, "first"), (1, "b", 9, None), (1, "lost", 9, "who"), (1, None, 9, "none"),
               (2, "a", 2, "t" * 100_000)]
    out = run(spark, calls, results)
    one = [r for r in out if r.conv_id == 1]
    assert len(one) == 13 and sorted(r.position for r in one) == list(range(1, 14))
    by = {r.call_id: r for r in one if r.status != "repeated"}
    assert [by[k].status for k in "abcxyzsd"] == ["linked", "linked", "no_result", "cycle", "cycle", "cycle", "cycle", "no_result"]
    assert (by["a"].depth, by["b"].depth, by["c"].depth) == (0, 1, 2)
    assert by["a"].position < by["b"].position < by["c"].position
    assert (by["a"].n_results, json.loads(by["a"].line)["result"]) == (2, "first")
    assert json.loads(by["b"].line)["result"] is None
    assert by["lost"].status == "orphan_result" and sum(r.status == "repeated" for r in one) == 2
    assert sorted(r.status for r in one if r.call_id is None) == ["no_id", "orphan_result"]
    chain = {r.call_id: r for r in out if r.conv_id == 3}
    assert all(chain[f"k{i}"].depth == i and chain[f"k{i}"].position == i + 1 for i in range(150))
    assert len(out) == len(calls) + 2


def test_empty(spark):
    assert run(spark, [], []) == []
    assert [r.status for r in run(spark, [], [(1, "a", 1, "t")])] == ["orphan_result"]
