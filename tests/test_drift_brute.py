"""Problems 2 and 3 over whole small tables against their statements, record by record."""

from __future__ import annotations

import json
import os
from datetime import datetime, timezone

import duckdb
import pytest

from loomtrace.plans import p2, p3

FOLDER = os.environ.get("LOOMTRACE_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def data():
    con = duckdb.connect()

    def rows(q):
        return con.execute(q.replace("{", f"'{FOLDER}/").replace("}", ".parquet'")).fetchall()

    return {
        "lines": rows("SELECT DISTINCT file_id, file_path, line_no, raw_text FROM {raw_lines}"), "base": rows("SELECT record_kind, field_name, json_type, is_required FROM {baseline_fields}"),
        "sessions": rows("SELECT file_path, session_id, created_at, cwd FROM {sessions}"), "entries": rows("SELECT session_id, entry_id, entry_ts, entry_type FROM {entries}"),
    }


def kind_of(v):
    return "null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "object" if isinstance(v, dict) else "array"


def instant(v):
    if isinstance(v, str) and len(v) == 13 and v.isdigit():
        v = int(v)
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return v
    try:
        d = datetime.fromisoformat(v)
    except (TypeError, ValueError):
        return None
    return round((d if d.tzinfo else d.replace(tzinfo=timezone.utc)).timestamp() * 1000)


def stands(truth, v, stamp=False):
    """Whether a value holds the truth, perhaps in another form or wrapped."""
    if isinstance(v, dict):
        return any(stands(truth, x, stamp) for x in v.values())
    if isinstance(v, list):
        return any(stands(truth, x, stamp) for x in v) or (all(isinstance(x, str) for x in v) and "/" + "/".join(v).lstrip("/") == truth)
    return v is not None and (str(v) == truth or (stamp and instant(truth) is not None and instant(v) == instant(truth)))


def records(data):
    for f, path, n, raw in data["lines"]:
        try:
            r = json.loads(raw)
        except (TypeError, ValueError):
            continue
        if isinstance(r, dict):
            yield f, path, n, r


def changes(data):
    base = {k: {f: (t, q) for kk, f, t, q in data["base"] if kk == k} for k in ("header", "entry")}
    norm = os.path.normpath
    session = {norm(p): s for p, s, _, _ in data["sessions"] if p}
    headers = {(norm(p), f): {x for x in xs} for p, s, c, w in data["sessions"] if p for f, xs in (("sessionId", [s]), ("createdAt", [c]), ("cwd", [w]))}
    for p, s, c, w in data["sessions"]:
        for f, x in (("sessionId", s), ("createdAt", c), ("cwd", w)):
            headers[norm(p), f].add(x)
    entries = {}
    for s, i, ts, t in data["entries"]:
        e = entries.setdefault((s, i), {"timestamp": set(), "type": set(), "id": {i}})
        e["timestamp"].add(ts)
        e["type"].add(t)
    out, type_of = set(), {}
    for f, path, n, r in records(data):
        kind = "header" if n == 1 else "entry"
        b = base[kind]
        extras = [x for x in r if x not in b]
        sid = session.get(norm(path))
        if kind == "entry":
            own = [r["id"]] if "id" in r else [i for s, i in entries if s == sid and any(stands(i, r[x]) for x in extras)]
            ids = [i for i in own if isinstance(i, str) and (sid, i) in entries] or [v for x in [r.get("id")] if isinstance(x, (dict, list)) for v in [i for s, i in entries if s == sid and stands(i, x)]]
            truth = entries.get((sid, ids[0]), {}) if ids else {}
        else:
            truth = {x: headers.get((norm(path), x), set()) for x in ("sessionId", "createdAt", "cwd")}
        used = set()
        for x, (t, need) in b.items():
            if x in r:
                if r[x] is not None and kind_of(r[x]) != t:
                    out.add((f, kind, x, "retyped"))
                continue
            if not need or not truth.get(x):
                continue
            new = [y for y in extras if any(z is not None and stands(z, r[y], x in ("timestamp", "createdAt")) for z in truth[x])]
            if not new:
                out.add((f, kind, x, "removed"))
                continue
            used.add(new[0])
            out.add((f, kind, x, "renamed"))
            if kind_of(r[new[0]]) not in (t, "null"):
                out.add((f, kind, x, "retyped"))
            if x == "type":
                type_of[f, n] = r[new[0]]
        out |= {(f, kind, y, "added") for y in extras if y not in used}
    return out, type_of


def test_changes(spark, data):
    assert {tuple(r) for r in p2.p2_found(spark, FOLDER).collect()} == changes(data)[0]


def test_calls_and_results(spark, data):
    type_of = changes(data)[1]
    out = set()

    def walk(v, f, n, key, around, top):
        if isinstance(v, list):
            for x in v:
                walk(x, f, n, key + "[]", around, None)
        if not isinstance(v, dict):
            return
        ident = next((v[k] for k in ("toolCallId", "id") if isinstance(v.get(k), str)), None)
        own = v.get("toolCallId") if isinstance(v.get("toolCallId"), str) else ""
        if top is None and "name" in v and "arguments" in v and ident is not None:
            out.add((f, n, "tool.call", ident, around))
            around = ident
        elif top or key == "toolResults[]" or (top is None and v.get("role") == "toolResult" and (key == "message" or "toolCallId" in v or "content" in v)):
            out.add((f, n, "tool.result", own, around))
            around = own
        for k, x in v.items():
            walk(x, f, n, k, around, None)

    for f, _, n, r in records(data):
        if n > 1:
            walk(r, f, n, "", "", stands("tool_result", r["type"] if "type" in r else type_of.get((f, n))))
    assert {tuple(r) for r in p3.p3_found(spark, FOLDER).collect()} == out
