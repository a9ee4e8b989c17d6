from __future__ import annotations

import json
import os

import pytest

from loomtrace import index as index_module
from loomtrace.index import Index
from loomtrace.operators import maintain
from loomtrace.operators.incremental import Conflict
from loomtrace.operators.maintain import Maintainer
from loomtrace.operators.project import to_store
from loomtrace.operators.search import Request, search
from loomtrace.sources.jsonl import parse, read_headers, read_lines, split_lines
from loomtrace.store import Store, cached
from tests.test_search import AWAY, FORK, TREE, line, lines


def built(spark, tmp_path, name="index", **files):
    s = cached(to_store(parse(lines(spark, **files))))
    i = Index(spark, str(tmp_path / name), 3)
    i.apply(s)
    return i, s


def hits(store, query, **more):
    return [(r.session_id, r.entry_id, r.fragment_id, r.snippet, r.n_fragments, round(r.score, 9), r.branch_state, r.selection_state) for r in search(store, Request(query, **more)).collect()]


def same(a: Store, b: Store) -> None:
    """Two stores answer alike and hold the same rows."""
    for q in ("fox", "fox done", '"the quick" fox'):
        assert hits(a, q) == hits(b, q), q
    for t in ("sessions", "events", "fragments", "links", "hashes"):
        x, y = getattr(a, t), getattr(b, t)
        columns = sorted(set(y.columns) - {"fk"})
        assert sorted(map(str, x.select(columns).collect())) == sorted(map(str, y.select(columns).collect())), t


def test_index_answers_as_texts_do(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index_module, "PARTS", 2)
    i, s = built(spark, tmp_path, s1=TREE, s2=FORK, s3=AWAY)
    same(i.store(), s)
    for more in ({"error_only": True}, {"tool_names": ["event_search"]}, {"branch_states": ["alternate"], "session_id": "s1"}, {"kinds": ["user.text"]}, {"cwd": "/ws/a/b"}):
        assert hits(i.store(), "fox", **more) == hits(s, "fox", **more)
    assert hits(i.store(), "书架 整理") == hits(s, "书架 整理") and hits(i.store(), '"理书"') == hits(s, '"理书"') == [] == hits(i.store(), "nowhere")


def test_only_the_lists_of_the_terms_are_read(spark, tmp_path):
    i, _ = built(spark, tmp_path, s1=TREE)
    from loomtrace.functions.tokens import parse_query
    from loomtrace.operators.search import matches

    plan = matches(i.store(), parse_query("fox"), Request("fox"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [tb" in plan.replace("isnotnull(tb#", "tb").replace("(tb#", "tb") or "PartitionFilters: [isnotnull(tb" in plan
    assert "/fragments/" not in plan and "frag_text" not in plan


def test_append_rebuild_remove(spark, tmp_path):
    longer = [*TREE, line("N", "S", "user", 9, text="a new fox is done"), line("O", "N", "assistant", 10, text="the quick answer")]
    i, _ = built(spark, tmp_path, s1=TREE, s2=FORK, s3=AWAY)
    fresh = lambda **f: cached(to_store(parse(lines(spark, **f))))
    before = i.store()
    n = spark.createDataFrame([("s1", len(TREE) - 1)], "session_id string, n_before long")
    assert i.apply(maintain.only(fresh(s1=longer), n), appended=n) == 2
    same(i.store(), fresh(s1=longer, s2=FORK, s3=AWAY))
    new = spark.read.parquet(*[f"{i.root}/fragments/{x}" for x in i.log.children(f"{i.root}/fragments") if x.startswith("batch=2-")])
    assert {r.entry_id for r in new.collect()} == {"N", "O"}  # nothing else was written again
    assert hits(before, "new") == [] and hits(i.store(), "new") != []

    other = [TREE[0], line("A", None, "user", 0, text="another fox"), line("B", "A", "assistant", 1, text="done")]
    i.apply(fresh(s1=other))
    same(i.store(), fresh(s1=other, s2=FORK, s3=AWAY))
    i.delete(["s2", "gone"])
    left = fresh(s1=other, s3=AWAY)
    same(i.store(), left)
    assert sorted(r[0] for r in i.live_sessions().collect()) == ["s1", "s3"]
    i.compact()
    assert i.sweep() and len(i.log.children(f"{i.root}/fragments")) == 1
    same(i.store(), left)
    i.delete(["s1", "s3"])
    assert i.live_sessions().count() == 0


def test_two_writers(spark, tmp_path, monkeypatch):
    i, s = built(spark, tmp_path, s1=TREE)
    other = Index(spark, i.root)
    whole = other._write

    def slow(*a):
        i.delete(["s1"])
        return whole(*a)

    monkeypatch.setattr(other, "_write", slow)
    with pytest.raises(Conflict):
        other.apply(s)
    assert i.live_sessions().count() == 0 and i.log.numbers() == [1, 2] and len(i.log.children(f"{i.root}/fragments")) == 1


def write(path, rows, when):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    os.utime(path, (when, when))


def actions(report):
    return {(os.path.basename(r.file_path), r.action, r.session_id) for r in report.collect()}


def test_maintenance(spark, tmp_path):
    logs = tmp_path / "logs"
    write(logs / "one s1.jsonl", TREE, 100)
    write(logs / "s2+x.jsonl", FORK, 200)
    write(logs / "s3.jsonl", AWAY, 300)
    write(logs / "bad.jsonl", ["{nope"], 50)
    m = Maintainer(Index(spark, str(tmp_path / "index"), 3), [str(logs)], "/ws")
    report, coverage = m.start()
    assert actions(report) == {("one s1.jsonl", "indexed", "s1"), ("s2+x.jsonl", "indexed", "s2"), ("bad.jsonl", "error", None)} and not coverage.limited
    one = [(r.entry_id, r.fragment_id) for r in search(m.index.store(), Request("fox")).collect()]
    assert actions(m.start()[0]) == {("one s1.jsonl", "unchanged", "s1"), ("s2+x.jsonl", "unchanged", "s2"), ("bad.jsonl", "error", None)} and m.index.log.numbers() == [1]

    write(logs / "one s1.jsonl", [*TREE, line("N", "S", "user", 9, text="a new fox")], 400)
    assert actions(m.turn([str(logs / "one s1.jsonl")])) == {("one s1.jsonl", "appended", "s1")}
    assert {("N", "N::user.text::0")} == {(r.entry_id, r.fragment_id) for r in search(m.index.store(), Request("new")).collect()}

    write(logs / "one s1.jsonl", [*TREE, "{cut off"], 500)  # what was good stays
    write(logs / "s2+x.jsonl", ["broken header"], 500)
    assert actions(m.start()[0]) == {("one s1.jsonl", "error", "s1"), ("s2+x.jsonl", "error", "s2"), ("bad.jsonl", "error", None)}
    assert len(search(m.index.store(), Request("new")).collect()) == 1 and m.index.log.numbers() == [1, 2]
    assert actions(m.turn([str(logs / "nowhere.jsonl")])) == {("nowhere.jsonl", "error", None)}

    write(logs / "one s1.jsonl", [{**TREE[0], "sessionId": "s9"}, *TREE[1:]], 600)  # another session in its place
    (logs / "s2+x.jsonl").unlink()
    assert actions(m.start()[0]) == {("one s1.jsonl", "indexed", "s9"), ("s2+x.jsonl", "removed", "s2"), ("bad.jsonl", "error", None)}
    assert [r[0] for r in m.index.live_sessions().collect()] == ["s9"]
    assert {(e, f) for e, f in one if (e, f) != ("X", "X::user.text::0")} == {(r.entry_id, r.fragment_id) for r in search(m.index.store(), Request("fox")).collect()}
    m.max_files = 1
    write(logs / "s4.jsonl", [{"sessionId": "s4", "createdAt": "2024", "cwd": "/ws"}, line("A", None, "user", 0, text="fox four")], 900)
    report, coverage = m.start()
    assert coverage.limited and {("s4.jsonl", "indexed", "s4"), ("one s1.jsonl", "removed", "s9")} <= actions(report)


def test_large_files_are_read_by_splits(spark, tmp_path):
    rows = [f"line {i} " + "x" * (i % 7) + ("\r" if i % 3 == 0 else "") for i in range(500)]
    (tmp_path / "big.jsonl").write_text("\n".join(rows) + "\n")
    (tmp_path / "small one.jsonl").write_text("a\nb\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = {(r.file_path.rsplit("/", 1)[1], r.line_no): r.raw_text for r in read_lines(spark, [str(tmp_path)], whole=100).filter("raw_text <> ''").collect()}
        assert split_lines(spark, [str(tmp_path / "big.jsonl")]).count() == 500
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {("big.jsonl", i + 1): x.rstrip("\r") for i, x in enumerate(rows)} | {("small one.jsonl", 1): "a", ("small one.jsonl", 2): "b"}


def test_headers_without_bodies(spark, tmp_path):
    write(tmp_path / "a.jsonl", [{"sessionId": "a", "createdAt": "2024", "cwd": "/ws"}, "x" * 300_000], 1)
    write(tmp_path / "b.jsonl", ["y" * 100_000], 1)
    h = {os.path.basename(r.file_path): r for r in read_headers(spark, [str(tmp_path)]).collect()}
    assert (h["a.jsonl"].session_id, h["a.jsonl"].error, h["b.jsonl"].error) == ("a", None, "invalid JSON")
    assert "content" not in read_headers(spark, [str(tmp_path)])._jdf.queryExecution().executedPlan().toString().replace("MapInArrow", "")
