from __future__ import annotations

import json
import math
import os

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomtrace.functions.text import OMITTED, bounded_text, collapse, preview, snippet, window
from loomtrace.operators import maintain
from loomtrace.operators.tree import ancestors, append_neighbors, descendants, leaf_walks
from loomtrace.sources.jsonl import discover, read_headers, read_lines
from loomtrace.streaming.landing import append_batches, landed, lines_stream


def write(path, session, cwd, n, when):
    rows = [{"sessionId": session, "createdAt": "2024", "cwd": cwd}] + [{"id": f"e{i}", "timestamp": "", "type": "user", "text": "x" * 50} for i in range(n)]
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(map(json.dumps, rows)) + "\n")
    os.utime(path, (when, when))


def test_refresh(spark, tmp_path):
    root = tmp_path / "logs"
    write(root / "a.jsonl", "a", "/ws", 3, 100)
    write(root / "deep/b.JSONL", "b", "/ws/x", 1, 300)
    write(root / "c.jsonl", "c", "/other", 1, 200)
    (root / "bad.jsonl").write_text("{nope\n")
    (root / "note.txt").write_text("x")
    assert [os.path.basename(p) for p in discover([str(root), str(root / "gone")])] == ["a.jsonl", "bad.jsonl", "c.jsonl", "b.JSONL"]
    assert read_lines(spark, [str(root)]).filter("file_path LIKE '%a.jsonl' AND raw_text <> ''").count() == 4
    assert {r.session_id for r in read_headers(spark, [str(root)]).filter("error IS NULL").collect()} == {"a", "b", "c"}
    r = maintain.refresh(spark, [str(root)], root="/ws")
    assert {(x.session_id, x.decision) for x in r.decisions.collect()} == {("a", "new"), ("b", "new")}
    assert [x.error for x in r.errors.collect()] == ["invalid JSON"] and not r.coverage.limited
    from loomtrace.sources.jsonl import listing, source_info

    known = source_info(r.parsed).join(listing(spark, [str(root)]), "file_path")
    known = spark.createDataFrame(known.collect(), known.schema)
    write(root / "a.jsonl", "a", "/ws", 4, 400)
    (root / "deep/b.JSONL").unlink()
    again = maintain.refresh(spark, [str(root)], known, "/ws")
    assert [x.decision for x in again.decisions.collect()] == ["append"]
    assert [os.path.basename(x.file_path) for x in again.gone.collect()] == ["b.JSONL"]
    one = maintain.refresh(spark, [str(root)], None, "/", max_files=1)
    assert one.coverage.limited and one.coverage.selected_files == 1 and "only 1 of" in one.coverage.notice()


def greedy(files, most, size):
    out, used = [], 0
    for f in sorted(files, key=lambda f: (-f[2], f[0])):
        if len(out) < most and f[1] <= size - used:
            out.append(f[0])
            used += f[1]
    return out


def test_budget(spark, monkeypatch):
    monkeypatch.setattr(maintain, "_PAGE", 2)
    files = [("a", 5, 9), ("b", 50, 8), ("c", 4, 8), ("d", 1, 7), ("e", 3, 6), ("f", 1, 6)]
    df = spark.createDataFrame(files, "file_path string, size_bytes long, mtime_ms long")
    for most, size in ((3, 11), (99, 10), (1, 4), (0, 99), (math.inf, 12), (2, math.inf), (math.inf, math.inf)):
        got, c = maintain.select_within(df, most, size)
        assert {r.file_path for r in got.collect()} == set(greedy(files, most, size)) and c.selected_files == len(greedy(files, most, size))
    assert maintain.read_budget("unlimited", 5) == math.inf and maintain.read_budget("x", 5) == 5 and maintain.read_budget("7", 5) == 7


def test_decisions(spark):
    cases = [("h", 0, [], "h", 0, [], "same"), ("h", 0, [], "h", 1, ["a"], "rebuild"), ("h", 1, ["a"], "g", 1, ["a"], "rebuild"), ("h", 2, ["a", "b"], "h", 1, ["a"], "rebuild"), ("h", 1, ["a"], "h", 2, ["b", "a"], "rebuild"), ("h", 1, ["a"], "h", 2, ["a", "b"], "append"), ("h", 1, ["a"], "h", 1, ["a"], "same")]
    df = spark.createDataFrame(cases, "ph string, pn long, pe array<string>, ch string, cn long, ce array<string>, want string")
    p, c = (F.struct(F.col(f"{x}h").alias("header_hash"), F.col(f"{x}n").alias("entry_count"), F.col(f"{x}e").alias("entry_hashes")) for x in "pc")
    assert all(r.want == r.got for r in df.withColumn("got", maintain.decision(p, c)).collect())


def test_text(spark):
    df = spark.createDataFrame([("0123456789" * 10,), (None,), ("",), ("a  ﻿ b",)], "t string")
    got = df.select(bounded_text("t", 40), collapse("t"), preview("t", 11), window("t", 95, 10), snippet("t", ["789012"], 30)).collect()
    room = 40 - len(OMITTED)
    assert got[0][0] == ("0123456789" * 10)[: -(-room // 2)] + OMITTED + ("0123456789" * 10)[-(room // 2) :] and len(got[0][0]) == 40
    assert tuple(got[0][2]) == ("012345…56789", 100, True, 6, 95) and tuple(got[0][3]) == ("56789", 100, True, 95, 100)
    assert got[0][4] == ("0123456789" * 10)[:27]
    assert got[1][0] is None and got[1][1] is None and got[1][4] is None and got[3][1] == "a b" and got[2][0] == ""


def test_tokens_after_the_fiftieth(spark, tmp_path):
    from loomtrace.plans import registry

    spark.createDataFrame([(1, " ".join(f"W{i}" for i in range(120))), (2, None), (3, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = {r.doc_id: r for r in registry.QUERIES["document_tokens"](spark, str(tmp_path)).collect()}
    assert out[1].n == 120 and out[1].tokens.split(" ") == [f"w{i}" for i in range(120)] and out[2].tokens is None and out[3].tokens == ""


@settings(max_examples=30, deadline=None)
@given(st.text(max_size=40), st.integers(0, 50), st.integers(0, 50))
def test_windows_and_gaps_cover_all(text, offset, width):
    from loomtrace.service import _ranges

    start = min(offset, len(text))
    end = min(len(text), start + width)
    r = _ranges({"text": text[start:end], "total": len(text), "start": start, "end": end, "truncated": end - start < len(text)}, True)
    assert sorted(r["shown"] + r["omitted"]) == r["shown"] + r["omitted"] or sum(b - a for a, b in r["shown"] + r["omitted"]) == len(text)


def test_walks_of_any_size(spark):
    rows = [("g", f"n{i}", None if i == 0 else f"n{i - 1 if i % 7 else max(0, i - 5)}", i) for i in range(60)] + [("c", "x", "y", 0), ("c", "y", "x", 1), ("m", "a", "gone", 0)]
    df = spark.createDataFrame(rows, "k string, v string, p string, seq long")
    a, b = ({tuple(r) for r in leaf_walks(df, m).collect()} for m in (1000, 1))
    assert a == b and ("c", "y", 0) in a and ("m", "a", 0) in a


def test_steps(spark):
    e = spark.createDataFrame([("s", "a", None, "b", 0), ("s", "b", "a", "c", 1), ("s", "c", "b", "b", 2)], "session_id string, entry_id string, parent_id string, next_id string, append_seq long")
    for every in (None, e):
        for m in (1000, 2):
            up = {(r.target_id, r.entry_id, r.distance) for r in ancestors(e, every, 5, m).collect()}
            assert up == {("b", "a", 1), ("c", "b", 1), ("c", "a", 2)}
            down = {(r.target_id, r.entry_id, r.distance) for r in descendants(e, every, 5, m).collect()}
            assert down == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("c", "b", 1)}
    assert [tuple(r) for r in ancestors(e, e.filter("entry_id = 'c'"), 1).collect()] == [("s", "c", "b", 1)] and ancestors(e, None, 0).collect() == []
    assert {(r.entry_id, r.neighbor_id, r.distance) for r in append_neighbors(e, 1, 0).collect()} == {("b", "a", -1), ("c", "b", -1)}


def test_landing(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    (landing / "1.json").write_text('{"file_path":"f","line_no":1,"raw_text":"a"}\n{"file_path":"f","line_no":2,"raw_text":"b"}\n')
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for k in range(2):
        append_batches(lines_stream(spark, str(landing)), out, check).awaitTermination()
        (landing / f"{k + 2}.json").write_text('{"file_path":"f","line_no":2,"raw_text":"c"}\n')
    append_batches(lines_stream(spark, str(landing)), out, check).awaitTermination()
    assert {tuple(r) for r in landed(spark, out).collect()} == {("f", 1, "a"), ("f", 2, "c")}
