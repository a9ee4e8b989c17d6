from __future__ import annotations

import json

import pytest

from loomtrace.functions import jsonvalues
from loomtrace.operators import drift, nested

BASE = {
    "header": {"sessionId": ("string", True), "createdAt": ("string", True), "cwd": ("string", True), "parentSession": ("string", False)},
    "entry": {"id": ("string", True), "timestamp": ("string", True), "type": ("string", True), "parentId": ("string", False), "text": ("string", False), "message": ("object", False), "toolCalls": ("array", False), "toolCallId": ("string", False), "name": ("string", False), "result": ("string", False)},
}
LINES = [
    (1, 1, {"sessionId": "s1", "created": "2024-01-01T00:00:00.000Z", "cwd": ["ws", "a"], "more": 1}),
    (1, 2, {"entryId": "e1", "timestamp": 1704067200000, "type": {"name": "user"}, "text": "hi"}),
    (1, 3, {"id": "e2", "ms": 1704067201000, "kind": "tool_result", "name": "read", "result": "x", "toolCallId": "c1"}),
    (1, 4, {"id": "e3", "timestamp": "2024-01-01T00:00:02Z", "label": None, "type": None}),
    (1, 5, {"id": "e4", "timestamp": "2024-01-01T00:00:03Z", "text": 5}),
    (1, 6, "no json"),
    (1, 7, [1]),
    (2, 1, None),
]


def frame(spark):
    rows = [(f, n, x if isinstance(x, str) or x is None else json.dumps(x)) for f, n, x in LINES]
    return spark.createDataFrame(rows + rows[:2] + [(None, 3, "{}")], "file_id long, line_no int, raw_text string")


def truth(spark):
    h = spark.createDataFrame([(1, "s1", "sessionId", ["s1"]), (1, "s1", "createdAt", ["2024-01-01T00:00:00.000Z", "@1704067200000"]), (1, "s1", "cwd", ["/ws/a"])], "file_id long, session_id string, field_name string, truth array<string>")
    e = [("s1", f"e{i}", {"timestamp": [f"@{1704067199000 + i * 1000}"], "type": [t]}) for i, t in ((1, "user"), (2, "tool_result"), (3, "label"), (4, "user"))]
    return h, spark.createDataFrame(e, "session_id string, ref string, truths map<string,array<string>>")


def found(spark):
    r = drift.profile(frame(spark), BASE)
    return drift.changes(r, drift.evidence(r, *truth(spark)), BASE)


def test_changes(spark):
    got = {(r.file_id, r.record_kind, r.field_name, r.change_kind) for r in found(spark).collect()}
    h, e = (1, "header"), (1, "entry")
    assert got == {
        (*h, "createdAt", "renamed"), (*h, "cwd", "retyped"), (*h, "more", "added"),
        (*e, "id", "renamed"), (*e, "timestamp", "retyped"), (*e, "type", "retyped"),
        (*e, "timestamp", "renamed"), (*e, "type", "renamed"), (*e, "label", "added"), (*e, "type", "removed"), (*e, "text", "retyped"),
    }


def test_unified(spark):
    f = found(spark)
    h = [r.asDict() for r in drift.unify(frame(spark), BASE, f, "header", frozenset(["createdAt"])).collect()]
    assert h == [{"file_id": 1, "line_no": 1, "sessionId": "s1", "createdAt": "2024-01-01T00:00:00.000Z", "cwd": "/ws/a", "parentSession": None, "rest": {"more": "1"}}]
    e = {r.line_no: r for r in drift.unify(frame(spark), BASE, f, "entry", frozenset(["timestamp"])).collect()}
    assert sorted(e) == [2, 3, 4, 5]
    assert (e[2].id, e[2].timestamp, e[2].type, e[2].text, e[2].rest) == ("e1", "2024-01-01T00:00:00.000Z", "user", "hi", {})
    assert (e[3].id, e[3].timestamp, e[3].type, e[3].result, e[3].rest) == ("e2", "2024-01-01T00:00:01.000Z", "tool_result", "x", {})
    assert (e[4].type, e[4].rest, e[5].text) == (None, {"label": "null"}, "5")
    with pytest.raises(ValueError):
        drift.unify(frame(spark), {"header": {"rest": ("string", True)}}, f, "header")


def test_typed_values():
    assert [drift.typed(v, "boolean") for v in (True, "FALSE", 1, "x", None, [])] == [True, False, True, None, None, None]
    assert [drift.typed(v, "number") for v in (1, "2.5", True, "x", {})] == [1.0, 2.5, None, None, None]
    assert [drift.typed(v, "object") for v in ({"b": 1, "a": "é"}, [1], "x")] == ['{"a": "é", "b": 1}', None, None]
    assert [drift.typed(v, "string") for v in ("x", 1, True, {"a": 1})] == ["x", "1", "true", None]


@pytest.mark.parametrize("unit", [1, 1_000, 1_000_000, 1_000_000_000])
@pytest.mark.parametrize("second", [0, 86_400, 499_999_999, 1_704_067_200, 4_102_444_800])
def test_instants_in_any_unit_and_year(unit, second):
    for x in (second * unit, str(second * unit), float(second * unit)):
        assert second * 1000 in jsonvalues.instants(x)
    assert jsonvalues.instants(True) == jsonvalues.instants("x1") == jsonvalues.instants(float("nan")) == []
    if second > 200_000_000:
        assert jsonvalues.epoch_ms(second * unit) == second * 1000


def test_stamps_as_seconds_and_microseconds_are_renamed(spark):
    rows = [(1, 1, {"sessionId": "s1", "createdAt": "2024-01-01T00:00:00Z", "cwd": "/a"}), (1, 2, {"id": "e1", "type": "user", "sec": 1704067200}), (1, 3, {"id": "e2", "type": "user", "us": "1704067201000000"})]
    lines = spark.createDataFrame([(f, n, json.dumps(x)) for f, n, x in rows], "file_id long, line_no int, raw_text string")
    r = drift.profile(lines, BASE)
    got = {(x.field_name, x.change_kind, x.new_name) for x in drift.changes(r, drift.evidence(r, *truth(spark)), BASE).collect()}
    assert got == {("timestamp", "renamed", "sec"), ("timestamp", "retyped", "sec"), ("timestamp", "renamed", "us")}


def test_wide_records_stay_linear(spark):
    """A record without id whose foreign fields hold many values: rows go with the values, not with their square."""
    wide = {"timestamp": "2024-01-01T00:00:00Z", "type": "user", "eid": "e1"} | {f"x{i}": [f"v{i}_{j}" for j in range(10)] for i in range(300)}
    lines = spark.createDataFrame([(1, 1, '{"sessionId":"s1","createdAt":"2024-01-01T00:00:00Z","cwd":"/a"}'), (1, 2, json.dumps(wide))], "file_id long, line_no int, raw_text string")
    r = drift.profile(lines, BASE)
    proof = drift.evidence(r, *truth(spark))
    assert {(x.field_name, x.name) for x in proof.collect()} == {("id", None), ("id", "eid")}


def test_sketches_as_spark_hashes(spark):
    from pyspark.sql import functions as F

    for v in ("a", "", "é🙂", "x" * 200):
        h = jsonvalues.sketch(v)
        assert h == [r[0] for r in spark.createDataFrame([(f,) for f in jsonvalues.forms(v)], "f string").select(F.xxhash64("f")).collect()]


def test_empty(spark):
    lines = frame(spark).filter("false")
    r = drift.profile(lines, BASE)
    assert drift.changes(r, drift.evidence(r, *truth(spark)), BASE).collect() == []


def test_matching_takes_the_best_whole():
    assert drift.match({("a", "x"): 3, ("a", "y"): 2, ("b", "x"): 2.5}) == {"a": "y", "b": "x"}
    assert drift.match({("a", "x"): 1.0, ("b", "x"): 1.0}) == {"a": "x"}
    assert drift.match({}) == {}


def test_renamed_type_makes_a_result(spark):
    names = found(spark).filter("field_name = 'type' AND change_kind = 'renamed'").selectExpr("file_id", "version", "new_name AS name")
    n = nested.nodes(frame(spark), BASE, names)
    assert {(r.line_no, r.tool_call_id) for r in n.filter("semantic_kind = 'tool.result'").collect()} == {(3, "c1")}
    assert nested.nodes(frame(spark), BASE).filter("semantic_kind = 'tool.result'").count() == 0


def test_nested_objects(spark):
    inner = {"id": "c2", "name": "b", "arguments": {"x": [{"toolCallId": "c3", "name": "d", "arguments": None}]}}
    record = {"id": "e", "type": "message", "message": {"role": "assistant", "content": [{"type": "text", "text": "t"}, {"type": "toolCall", "id": "c1", "name": "a", "arguments": {"calls": [inner]}}], "details": {"toolResults": [{"content": "ok"}]}, "note": '{"toolCallId": "no"}'}}
    lines = spark.createDataFrame([(1, 2, json.dumps(record)), (1, 2, json.dumps(record)), (1, 3, "[]"), (1, 4, None)], "file_id long, line_no int, raw_text string")
    n = nested.nodes(lines, BASE)
    got = {(r.semantic_kind, r.tool_call_id, r.parent_call_id) for r in n.filter("semantic_kind LIKE 'tool.%'").collect()}
    assert got == {("tool.call", "c1", ""), ("tool.call", "c2", "c1"), ("tool.call", "c3", "c2"), ("tool.result", "", "")}
    tables = {k: nested.variant(n, k) for k in nested.VARIANTS}
    assert [r.body for r in tables["blocks"].collect()] == ["t"]
    by = {r.node: r for r in n.collect()}
    assert all(r.parent_node is None or r.parent_node in by for r in by.values())


def test_deep_nesting_is_defined(spark):
    deep = '{"type":"x","id":"e","timestamp":"","a":' + "[" * 200_000 + "]" * 200_000 + "}"
    lines = spark.createDataFrame([(1, 2, deep), (1, 3, '{"id":"f","timestamp":"","type":"x"}')], "file_id long, line_no int, raw_text string")
    assert {r.line_no for r in nested.nodes(lines, BASE).collect()} >= {3}


def test_the_automaton_reads_its_table():
    assert nested.VARIANT_OF["message", nested.RESULT_ROLE] == nested.RESULT and nested.VARIANT_OF["message", 0] == nested.MESSAGE
    call = nested._marks_of({"name": None, "arguments": [], "id": "x", "toolCallId": 5})
    assert all(nested.VARIANT_OF[e, call] == nested.CALL for e in (nested.ELSEWHERE, "message", "content[]", "toolResults[]"))
    assert nested.VARIANT_OF[nested.ELSEWHERE, nested._marks_of({"name": "n", "arguments": 1, "id": 5})] is None
    assert nested.VARIANT_OF["content[]", nested._marks_of({"type": "thinking"})] == nested.THINKING and nested.VARIANT_OF["content[]", nested._marks_of({"type": 1})] is None


@pytest.mark.parametrize("depth", [3, 20_000, 100_000])
def test_calls_in_deep_records_are_found(depth):
    call = '{"id":"c2","name":"n","arguments":' + '{"x":[' * depth + '{"id":"c3","name":"n","arguments":[1,-2.5e1,"\\u00e9",null,true,{}]}' + "]}" * depth + "}"
    record = jsonvalues.parse_record('{"type":"x","b": ' + "[" * depth + call + "]" * depth + ', "id":"e"}\n')
    rows = nested.flatten(record, False)
    assert [(r["semantic_kind"], r["tool_call_id"], r["parent_call_id"]) for r in rows] == [("entry", None, ""), ("tool.call", "c2", ""), ("tool.call", "c3", "c2")]
    assert rows[1]["body"] == '{"x": [' * depth + '{"arguments": [1, -25.0, "é", null, true, {}], "id": "c3", "name": "n"}' + "]}" * depth


@pytest.mark.parametrize("text", ["{}", "[]", "[1,]", '{"a":1,}', '{"a" 1}', '{"a":1}x', "01", "-", "NaN", '{"a":"\\ud83d"}', '{"a":[{"b":1},2],"a":{"c":"\\n"}}', "[1 2]", '{1:2}', '"a\nb"', "[1e5, 1.0, -0]", " \t{ }\r\n", "{", "[", "", '["', "[[]", "tru"])
def test_the_deep_reader_reads_as_json(text):
    def result(read):
        try:
            return repr(read(text))
        except ValueError:
            return "invalid"

    assert result(jsonvalues._read) == result(lambda t: json.loads(t, parse_constant=jsonvalues._reject))
