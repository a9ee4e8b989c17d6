from __future__ import annotations

import json
import sqlite3

import pytest

from loomtrace.errors import InvalidArgument, InvalidQuery, NotFound
from loomtrace.index import Index
from loomtrace.functions.tokens import parse_query, tokens_of
from loomtrace.operators.project import arguments_text, file_evidence, fragments, number_text, to_store
from loomtrace.operators.search import Execution, Request, search
from loomtrace.service import History, Read, bounded_integer
from loomtrace.sources.jsonl import parse


def line(i, parent, kind, second=0, **more):
    return {"id": i, "parentId": parent, "timestamp": f"2024-01-01T00:00:{second:02d}Z", "type": kind, **more}


TREE = [
    {"sessionId": "s1", "createdAt": "2024-01-01", "cwd": "/ws/a"},
    line("A", None, "user", 0, text="the quick fox"),
    line("B", "A", "assistant", 1, text="a lazy dog", thinking="secret fox", toolCalls=[{"toolCallId": "t1", "name": "read", "arguments": {"path": "x.py", "n": 1.0}}]),
    line("C", "B", "tool_result", 2, name="read", result="fox in x.py", toolCallId="t1", isError=True),
    line("D", "C", "assistant", 3, text="dead end fox"),
    line("E", "B", "user", 4, text="other way"),
    line("K", "E", "compaction", 5, summary="so far", firstKeptEntryId="E", retainedIds=["A", 7]),
    line("F", "K", "assistant", 6, text="昨整理了书架 done"),
    line("L", "F", "label", 7, targetId="A", label="x"),
    line("S", "L", "assistant", 8, text="", toolCalls=[{"toolCallId": "t2", "name": "event_search", "arguments": {"query": "fox"}}]),
]
FORK = [
    {"type": "session", "version": 1, "id": "s2", "timestamp": "2024-01-02", "cwd": "/ws/a/b", "parentSession": "s1"},
    TREE[1], TREE[2],
    line("X", "B", "user", 9, text="fork of the fox"),
]
AWAY = [{"sessionId": "s3", "createdAt": "2024-01-03", "cwd": "/other", "parentSession": "/logs//s1.jsonl"}, line("Z", None, "user", 0, text="fox elsewhere")]


def lines(spark, **files):
    rows = [(f"/logs/{n}.jsonl", i + 1, x if isinstance(x, str) else json.dumps(x)) for n, xs in files.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "file_path string, line_no int, raw_text string")


@pytest.fixture(scope="module")
def store(spark):
    from loomtrace.store import cached

    return cached(to_store(parse(lines(spark, s1=TREE, s2=FORK, s3=AWAY))))


def test_query_language():
    q = parse_query('  one "two  three"four 整理书架 "整理" foo/bar !!! ')
    assert q.terms == ("one", "four", "整理书架", "foo/bar", "!!!") and q.phrases == ("two  three", "整理")
    assert q.sequences == (("one",), ("four",), ("整",), ("理",), ("书",), ("架",), ("foo", "bar"), ("two", "three"), ("整", "理"))
    for bad in ("", "  ", '"open', 'a "  "'):
        with pytest.raises(InvalidQuery):
            parse_query(bad)
    assert parse_query("a OR b:c").terms == ("a", "OR", "b:c")


def test_tokens_as_in_sqlite(spark):
    texts = ["world. npm-install v1.2 my_tool", "Straße Éa ñ x² ½ ＡＢ", "foo/bar;baz", "résumé naïve", "áb", "İstanbul ALLCAPS", "", "日本語テキスト"]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize=\"unicode61 tokenchars '_-.'\")")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, instance)")
    from loomtrace.functions.tokens import segmented, tokens
    from pyspark.sql import functions as F

    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(tokens(F.col("t"))).collect()]
    for i, t in enumerate(texts):
        spaced = "".join(f" {c} " if "぀" <= c <= "鿿" else c for c in t)
        con.execute("DELETE FROM t")
        con.execute("INSERT INTO t VALUES (?)", (spaced,))
        want = [r[0] for r in con.execute("SELECT term FROM v ORDER BY offset")]
        if "İ" not in t:
            assert got[i] == want, t
        assert tokens_of(t) == got[i]
    assert segmented is not None


def test_scores_as_in_sqlite(spark, store):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(id, x, tokenize=\"unicode61 tokenchars '_-.'\")")
    con.execute("CREATE VIRTUAL TABLE u USING fts5(x, tokenize=\"unicode61 tokenchars '_-.'\")")
    rows = store.fragments.orderBy("session_id", "fragment_id").collect()
    for r in rows:
        con.execute("INSERT INTO u(x) VALUES (?)", ("".join(f" {c} " if "一" <= c <= "鿿" else c for c in r.frag_text),))
    want = sorted(round(r[0], 9) for r in con.execute("SELECT bm25(u) FROM u WHERE u MATCH '\"fox\"'"))
    r = Request("fox", kinds=[k for k in {x.semantic_kind for x in rows}], tool_names=())
    from loomtrace.operators.search import matches

    got = sorted(round(x.score, 9) for x in matches(store, parse_query("fox"), Request("fox", tool_names=("read", "event_search"))).collect())
    everything = sorted(round(x.score, 9) for x in matches(store, parse_query("fox"), r).collect())
    assert everything and set(everything) | set(got) == set(want)


def ids(df):
    return [(r.session_id, r.entry_id) for r in df.collect()]


def test_search(store):
    hits = ids(search(store, Request("fox")))
    assert set(hits) == {("s1", "A"), ("s1", "C"), ("s1", "D"), ("s2", "A"), ("s2", "X"), ("s3", "Z")}
    assert set(ids(search(store, Request("fox"), "/ws/a"))) == set(hits) - {("s3", "Z")}
    assert ids(search(store, Request("fox"), "/ws/")) != [] and ids(search(store, Request("fox"), "/w")) == []
    assert ids(search(store, Request("fox", cwd="/ws/a/b"), "/ws")) and all(s == "s2" for s, _ in ids(search(store, Request("fox", cwd="/ws/a/b"), "/ws")))
    assert ids(search(store, Request("fox", error_only=True))) == [("s1", "C")]
    assert ids(search(store, Request("fox", tool_names=["event_search"]))) == [("s1", "S")]
    assert ids(search(store, Request("secret"))) == []
    assert ids(search(store, Request("书架 整理"))) == [("s1", "F")] == ids(search(store, Request('"整理"')))
    assert ids(search(store, Request('"理书"'))) == []
    assert ids(search(store, Request("!!!"))) == []
    assert ids(search(store, Request("fox", branch_states=["alternate"], session_id="s1"))) and set(ids(search(store, Request("fox", branch_states=["alternate"], session_id="s1")))) == {("s1", "C"), ("s1", "D")}
    assert ids(search(store, Request("fox", selection_states=["summarized"], session_id="s1"))) == [("s1", "A")]
    for root, sid in (("/", "nope"), ("/ws", "s3")):
        with pytest.raises(NotFound) as e:
            search(store, Request("fox", session_id=sid), root)
        assert e.value.message == "no such session, entry or fragment"


def test_current_session(store):
    x = Execution("s1", "E")
    assert all(s != "s1" for s, _ in ids(search(store, Request("fox"), execution=x)))
    assert set(ids(search(store, Request("fox", session_id="s1"), execution=x))) == {("s1", "A"), ("s1", "C"), ("s1", "D")}
    late = Execution("s1", None, "2024-01-01T00:00:02Z")
    assert set(ids(search(store, Request("fox", session_id="s1"), execution=late))) == {("s1", "A")}
    with pytest.raises(InvalidArgument):
        search(store, Request("fox", session_id="s1"), execution=Execution("s1"))


def test_states(store):
    e = {r.entry_id: r for r in store.events.filter("session_id = 's1'").collect()}
    assert {k for k, r in e.items() if r.branch_state == "selected"} == {"A", "B", "E", "K", "F", "L", "S"}
    assert {k for k, r in e.items() if r.selection_state == "summarized"} == {"A", "B"}
    assert e["L"].selection_state == "not-applicable" and e["K"].selection_state == "direct" and e["D"].selection_state == "not-selected"
    assert e["B"].next_id == "E" and e["C"].next_id == "D" and e["S"].next_id is None and e["B"].n_children == 2


def test_read(store):
    h = History(store, "/ws")
    r = h.read("s1", "B", Read(before=9, after=2))
    assert [f["semantic_kind"] for f in r["fragments"]] == ["assistant.text", "tool.call"]
    assert r["fragments"][1]["preview"]["text"] == 'read\n{ "n": 1, "path": x.py }'
    assert [n["entry_id"] for n in r["neighbors"]["before"]] == ["A"] and [n["entry_id"] for n in r["neighbors"]["after"]] == ["E", "K"]
    fork = r["neighbors"]["forks"]
    assert [(f["kind"], f["at"]) for f in fork] == [("session-fork", ("s1", "B"))]
    assert fork[0]["candidates"] == [("s1", "C"), ("s1", "E"), ("s2", "X")] and fork[0]["chosen"] == ("s1", "E")
    assert History(store, "/ws/a/b").lineage("s2") == {"session_id": "s2", "parent_id": None, "child_ids": []}
    a = h.read("s1", "C", Read(order="append", before=1, after=1))["neighbors"]
    assert ([n["entry_id"] for n in a["before"]], [n["entry_id"] for n in a["after"]]) == (["B"], ["D"])
    w = h.read("s1", "A", Read(offset=4, window=5))["fragments"][0]["preview"]
    assert (w["text"], w["shown"], w["omitted"], w["truncated"]) == ("quick", [(4, 9)], [(0, 4), (9, 13)], True)
    past = h.read("s1", "A", Read(offset=99))["fragments"][0]["preview"]
    assert (past["text"], past["shown"], past["omitted"]) == ("", [], [(0, 13)])
    for bad in (lambda: h.read("s3", "Z"), lambda: h.read("s1", "nope"), lambda: h.read("s1", "A", Read(fragment_id="q"))):
        with pytest.raises(NotFound):
            bad()
    with pytest.raises(NotFound):
        History(store, "/ws", Execution("s1", "B")).read("current", "C")


def test_trace(store):
    t = History(store, "/ws").trace("s1", "B")
    assert t["parent"]["to"] == ("s1", "A") and [c["to"][1] for c in t["children"]] == ["C", "E"] and t["siblings"] == []
    kinds = [(r["type"], r["to"]) for r in t["related"]]
    assert ("tool-result-for", ("s1", "B")) in kinds and ("file-read", "file:x.py") in kinds and ("session-fork", ("s2", "X")) in kinds
    assert kinds.index(("tool-result-for", ("s1", "B"))) < kinds.index(("file-read", "file:x.py"))
    k = [(r["type"], r["to"]) for r in History(store, "/ws").trace("s1", "K")["related"]]
    assert k == [("compacts", ("s1", "E")), ("compacts", ("s1", "A"))]
    assert [c["to"][1] for c in History(store, "/ws", Execution("s1", "E")).trace("s1", "B")["children"]] == ["C"]
    assert History(store, "/").lineage("s1")["child_ids"] == ["s2", "s3"]
    assert History(store, "/ws").lineage("s1")["child_ids"] == ["s2"]


def test_envelopes(store):
    h = History(store, "/ws")
    assert h.call("read", "nope", "x") == {"ok": False, "code": "NOT_FOUND", "message": "no such session, entry or fragment"}
    assert h.call("search", Request('"'))["code"] == "INVALID_QUERY"
    assert h.call("read", "current", "x")["code"] == "INVALID_ARGUMENT"
    assert h.call("trace", "s1", "A")["ok"]
    assert h.call("drop") == {"ok": False, "code": "INVALID_ARGUMENT", "message": "unknown operation"}
    assert bounded_integer("n", None, 3, 0, 5) == 3 and bounded_integer("n", 99, 3, 0, 5) == 5
    for bad in (-1, 1.5, "2", True):
        with pytest.raises(InvalidArgument):
            bounded_integer("n", bad, 3, 0, 5)


def test_changed_copy_cancels_a_fork(spark):
    other = [FORK[0], TREE[1] | {"text": "changed"}, *FORK[2:]]
    from loomtrace.operators.relations import continuations

    s = to_store(parse(lines(spark, s1=TREE, s2=other)))
    assert continuations(s, s.sessions).collect() == []


def test_parse_errors(spark):
    files = {
        "good": TREE[:2], "blank": ["", "  "], "json": [TREE[0], "{oops"], "list": [TREE[0], "[1]"], "head": [{"id": "x", "timestamp": ""}], "id": [TREE[0], {"id": 5, "timestamp": "", "type": "user"}],
        "parent": [TREE[0], {"id": "a", "timestamp": "", "type": "user", "parentId": 4}], "twice": [TREE[0], "", TREE[1], TREE[1] | {"text": "b"}], "keys": [TREE[0], '{"id":"a","id":"b","timestamp":"","type":"user"}'],
    }
    p = parse(lines(spark, **files))
    got = {r.file_path.split("/")[-1][:-6]: (r.line_no, r.error) for r in p.errors.collect()}
    assert got == {
        "blank": (1, "no header"), "json": (2, "invalid JSON"), "list": (2, "no JSON object"), "head": (1, "header without creation time"), "id": (2, "entry without id"),
        "parent": (2, "entry with a parent that is no string"), "twice": (4, "repeated entry id"),
    }
    assert {r.entry_id for r in p.entries.collect()} == {"A", "b"}
    assert parse(lines(spark, good=TREE).filter("false")).entries.collect() == []


def test_projection():
    def kinds(record):
        return [(f["kind"], f["place"], f["text"]) for f in fragments(record)]

    blocks = [{"type": "thinking", "thinking": "no"}, {"type": "toolCall", "id": "c", "name": "ls", "arguments": {}}, {"type": "text", "text": "a"}, {"type": "text", "text": ""}, {"type": "text", "text": "b"}, 3]
    assert kinds({"type": "message", "message": {"role": "assistant", "content": blocks}}) == [("tool.call", 0, "ls\n{  }"), ("assistant.text", 0, "a"), ("assistant.text", 1, "b")]
    assert kinds({"type": "message", "message": {"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image"}, {"type": "text", "text": "b"}]}}) == [("user.text", 0, "a\nb")]
    assert kinds({"type": "bash", "output": "o"}) == [("bash.output", 1, "o")]
    assert kinds({"type": "custom", "customType": "x", "text": "t"}) == []
    assert [f["text"] for f in fragments({"type": "custom", "customType": "x", "text": "t"}, frozenset(["x"]))] == ["x\nt"]
    assert kinds({"type": "session_info", "name": " a   b "}) == [("session.name", 0, "a b")]
    assert kinds({"type": "message", "message": "text"}) == kinds({"type": "label"}) == kinds({}) == []
    assert next(fragments({"type": "bashExecution", "output": "o", "exitCode": 2}))["is_error"] is True
    assert arguments_text({"b": [1, "x", None, {"z": True}], "a": {}}) == '{ "a": {  }, "b": [1, x, , { "z": true }] }'
    assert [number_text(x) for x in (1.0, 1e21, 1.5e-7, 123456.789, -2.5, 0.000001)] == ["1", "1e+21", "1.5e-7", "123456.789", "-2.5", "0.000001"]
    assert file_evidence("write", {"to": "b", "path": "a", "files": ["c", "a", 3]}) == ("file-changed", ["a", "b", "c"])
    assert file_evidence("ls", {"path": "a"}) is None and file_evidence("read", {}) is None


def test_saved_store(spark, store, tmp_path):
    Index(spark, str(tmp_path), 3).apply(store)
    again = Index(spark, str(tmp_path)).store()
    assert set(ids(search(again, Request("fox")))) == set(ids(search(store, Request("fox"))))
