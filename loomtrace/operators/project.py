"""Entries to typed text fragments, roles and recorded links."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from decimal import Decimal
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import text_batches
from ..functions.jsonvalues import parse_record
from ..sources.jsonl import Parsed, string_at, type_at
from ..store import Store
from .relations import BRANCH_SUMMARY_FROM, COMPACTS, EDGE, LABELS

#: Tools that read and that change files, and the arguments that name files, in order.
READ_TOOLS = frozenset("read_file open_file list_files read_lints grep search_file search_content read".split())
WRITE_TOOLS = frozenset("write_file edit_file create_file delete_file apply_patch write edit".split())
PATH_KEYS = "filePath file path to from target target_file".split()

_ROLES = {"user": "user", "assistant": "assistant", "tool_result": "tool", "bash": "tool", "bashExecution": "tool", "bash_execution": "tool", "compaction": "summary", "branch_summary": "summary", "custom": "custom", "custom_message": "custom"}
_CONTROL = ("model_change", "thinking_change", "thinking_level_change", "extension_state")


def role_columns(v: Column) -> list[Column]:
    """entry_role and context_role of an entry record."""
    kind, inner = string_at(v, "type"), string_at(v, "message.role")
    message = kind == "message"
    role = F.when(message, F.when(inner.isin("user", "assistant"), inner).when(inner.isin("toolResult", "bashExecution"), "tool").otherwise("metadata"))
    for name, value in _ROLES.items():
        role = role.when(kind == name, value)
    hidden = message & (inner == "bashExecution") & F.coalesce(F.try_variant_get(v, "$.message.excludeFromContext", "boolean") & (type_at(v, "message.excludeFromContext") == "BOOLEAN"), F.lit(False))
    context = (
        F.when(hidden, "control")
        .when(message | kind.isin("user", "assistant", "tool_result", "bash", "bashExecution", "bash_execution", "custom", "custom_message"), "conversation")
        .when(kind.isin("compaction", "branch_summary"), "summary")
        .when(kind.isin("session_info", "label"), "metadata")
        .otherwise("control")
    )
    return [role.otherwise("metadata").alias("entry_role"), context.alias("context_role")]


def number_text(x: float) -> str:
    """A JSON number as scripts print it: no trailing zero, exponents from 1e21 on and below 1e-6."""
    if isinstance(x, int) and abs(x) <= 1 << 53:
        return str(x)
    x = float(x)
    if x == 0:
        return "0"
    if math.isinf(x):
        return "Infinity" if x > 0 else "-Infinity"
    digits, exponent = f"{Decimal(repr(abs(x))):e}".split("e")
    digits = digits.replace(".", "").rstrip("0")
    point = int(exponent) + 1
    n = len(digits)
    if n <= point <= 21:
        out = digits + "0" * (point - n)
    elif 0 < point <= 21:
        out = digits[:point] + "." + digits[point:]
    elif -6 < point <= 0:
        out = "0." + "0" * -point + digits
    else:
        out = digits[0] + ("." + digits[1:] if n > 1 else "") + f"e{'+' if point > 0 else '-'}{abs(point - 1)}"
    return ("-" if x < 0 else "") + out


def arguments_text(value: Any) -> str:
    """Arguments as one searchable text: keys sorted at every depth, strings bare, lists in brackets."""
    done: dict[int, str] = {}
    stack: list[tuple[Any, bool]] = [(value, False)]
    while stack:
        x, ready = stack.pop()
        inner = list(x.values()) if isinstance(x, dict) else x if isinstance(x, list) else []
        if inner and not ready:
            stack.append((x, True))
            stack.extend((y, False) for y in inner if isinstance(y, (dict, list)))
        elif isinstance(x, dict):
            keys = sorted(x, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
            done[id(x)] = "{ " + ", ".join(f"{json.dumps(k, ensure_ascii=False)}: {_scalar(x[k], done)}" for k in keys) + " }"
        elif isinstance(x, list):
            done[id(x)] = "[" + ", ".join(_scalar(y, done) for y in x) + "]"
    return _scalar(value, done)


def _scalar(x: Any, done: dict[int, str]) -> str:
    if isinstance(x, (dict, list)):
        return done[id(x)]
    if x is None:
        return ""
    if isinstance(x, bool):
        return "true" if x else "false"
    return x if isinstance(x, str) else number_text(x)


def file_evidence(tool: str, arguments: Any) -> tuple[str, list[str]] | None:
    """(file-read or file-changed, paths) of a recognised tool's arguments; None without paths."""
    kind = "file-read" if tool in READ_TOOLS else "file-changed" if tool in WRITE_TOOLS else None
    if kind is None:
        return None
    if isinstance(arguments, str):
        paths = [arguments]
    elif isinstance(arguments, dict):
        files = arguments.get("files")
        paths = [arguments.get(k) for k in PATH_KEYS] + (files if isinstance(files, list) else [])
    else:
        return None
    paths = list(dict.fromkeys(p for p in paths if isinstance(p, str) and p))
    return (kind, paths) if paths else None


def _string(record: dict[str, Any], *names: str) -> str:
    return next((record[n] for n in names if isinstance(record.get(n), str)), "")


def _content(value: Any) -> str:
    if isinstance(value, str):
        return value
    blocks = value if isinstance(value, list) else []
    return "\n".join(b["text"] for b in blocks if isinstance(b, dict) and b.get("type") == "text" and isinstance(b.get("text"), str))


def _calls(blocks: Any, id_key: str) -> Iterator[dict[str, Any]]:
    place = 0
    for b in blocks:
        name = _string(b, "name")
        if name:
            evidence = file_evidence(name, b.get("arguments"))
            own = b.get(id_key)
            yield {"kind": "tool.call", "place": place, "text": f"{name}\n{arguments_text(b.get('arguments'))}", "tool_name": name, "tool_call_id": own if isinstance(own, str) else None, "file_evidence_type": evidence and evidence[0], "file_paths": evidence and evidence[1]}
            place += 1


def _result(record: dict[str, Any], name: str, body: str, error: bool) -> Iterator[dict[str, Any]]:
    if name or body:
        own = record.get("toolCallId")
        yield {"kind": "tool.result", "place": 0, "text": f"{name}\n{body}" if name else body, "tool_name": name or None, "tool_call_id": own if isinstance(own, str) else None, "is_error": error}


def _shell(record: dict[str, Any], error: bool) -> Iterator[dict[str, Any]]:
    for place, (kind, key) in enumerate((("bash.command", "command"), ("bash.output", "output"))):
        text = _string(record, key)
        if text:
            yield {"kind": kind, "place": place, "text": text, "tool_name": "bash"} | ({"is_error": error} if place else {})


def _failed(record: dict[str, Any]) -> bool:
    code = record.get("exitCode")
    return isinstance(code, (int, float)) and not isinstance(code, bool) and code != 0


def _objects(value: Any) -> list[dict[str, Any]]:
    return [x for x in value if isinstance(x, dict)] if isinstance(value, list) else []


def fragments(record: dict[str, Any], searchable: frozenset[str] = frozenset()) -> Iterator[dict[str, Any]]:
    """The fragments of an entry record. Thinking is never among them, nor are custom entries of types that aren't
    searchable."""
    kind = record.get("type")
    message = record.get("message")
    if kind == "message":
        if not isinstance(message, dict):
            return
        role = message.get("role")
        if role == "user":
            yield from _text("user.text", _content(message.get("content")))
        elif role == "assistant":
            blocks = _objects(message.get("content"))
            texts = [b["text"] for b in blocks if b.get("type") == "text" and isinstance(b.get("text"), str) and b["text"]]
            own = iter([{"kind": "assistant.text", "place": i, "text": t} for i, t in enumerate(texts)])
            calls = _calls([b for b in blocks if b.get("type") == "toolCall"], "id")
            for b in blocks:  # in the order of the blocks
                if b.get("type") == "text" and isinstance(b.get("text"), str) and b["text"]:
                    yield next(own)
                elif b.get("type") == "toolCall" and _string(b, "name"):
                    yield next(calls)
        elif role == "toolResult":
            yield from _result(message, _string(message, "toolName"), _content(message.get("content")), message.get("isError") is True)
        elif role == "bashExecution":
            yield from _shell(message, _failed(message))
    elif kind == "user":
        yield from _text("user.text", _string(record, "text"))
    elif kind == "assistant":
        yield from _text("assistant.text", _string(record, "text"))
        yield from _calls(_objects(record.get("toolCalls")), "toolCallId")
    elif kind == "tool_result":
        error = next((record[k] for k in ("isError", "error") if isinstance(record.get(k), bool)), False)
        yield from _result(record, _string(record, "name", "toolName"), _string(record, "result", "text"), error)
    elif kind == "bash":
        yield from _shell(record, record.get("isError") is True)
    elif kind in ("bashExecution", "bash_execution"):
        yield from _shell(record, _failed(record))
    elif kind in ("compaction", "branch_summary"):
        yield from _text("summary.compaction" if kind == "compaction" else "summary.branch", _string(record, "summary", "text"))
    elif kind in ("custom", "custom_message"):
        custom = _string(record, "customType")
        text = _content(record.get("content")) if kind == "custom_message" else _string(record, "text") if custom in searchable else ""
        if text:
            yield {"kind": "custom.message", "place": 0, "text": f"{custom}\n{text}" if custom else text, "custom_type": custom or None}
    elif kind == "session_info":
        yield from _text("session.name", " ".join(_string(record, "name", "text").replace("﻿", " ").split()))


def _text(kind: str, text: str) -> Iterator[dict[str, Any]]:
    if text:
        yield {"kind": kind, "place": 0, "text": text}


_SCHEMA = pa.schema(
    [(c, pa.string()) for c in ("session_id", "entry_id", "fragment_id", "semantic_kind", "frag_text", "tool_name", "tool_call_id")]
    + [("is_error", pa.bool_()), ("custom_type", pa.string()), ("file_paths", pa.list_(pa.string())), ("file_evidence_type", pa.string()), ("frag_ord", pa.int32())]
)
_DDL = "session_id string, entry_id string, fragment_id string, semantic_kind string, frag_text string, tool_name string, tool_call_id string, is_error boolean, custom_type string, file_paths array<string>, file_evidence_type string, frag_ord int"


def project(entries: DataFrame, searchable: frozenset[str] = frozenset()) -> DataFrame:
    """The fragments, with full texts, of parsed entries (session_id, entry_id, raw_text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, "raw_text", 8_000_000):
            rows = []
            for s, e, raw in zip(*(b.column(c).to_pylist() for c in ("session_id", "entry_id", "raw_text"))):
                for i, f in enumerate(fragments(parse_record(raw) or {}, searchable)):
                    rows.append({"session_id": s, "entry_id": e, "fragment_id": f"{e}::{f['kind']}::{f['place']}", "semantic_kind": f["kind"], "frag_text": f["text"], "frag_ord": i} | {k: f.get(k) for k in ("tool_name", "tool_call_id", "is_error", "custom_type", "file_paths", "file_evidence_type")})
            yield from pa.Table.from_pylist(rows, schema=_SCHEMA).to_batches()

    return entries.select("session_id", "entry_id", "raw_text").mapInArrow(run, _DDL)


def recorded_links(entries: DataFrame) -> DataFrame:
    """Relationships that entries record: what a compaction compacts and retains, where a branch summary comes from,
    what a label labels. Columns as in relations.EDGE."""
    v = F.col("v")
    kind = F.col("entry_type")
    main = F.when(kind == "compaction", F.coalesce(string_at(v, "compactedUpToId"), string_at(v, "firstKeptEntryId"), string_at(v, "fromId"))).when(kind == "branch_summary", string_at(v, "fromId")).when(kind == "label", string_at(v, "targetId"))
    kept = F.filter(F.when(kind == "compaction", F.try_variant_get(v, "$.retainedIds", "array<variant>")), lambda x: F.schema_of_variant(x) == "STRING")
    kept = F.transform(kept, lambda x: F.try_variant_get(x, "$", "string"))
    targets = F.array_compact(F.concat(F.array(main), F.coalesce(kept, F.array().cast("array<string>"))))
    type_ = F.when(kind == "compaction", COMPACTS).when(kind == "branch_summary", BRANCH_SUMMARY_FROM).otherwise(LABELS)
    e = entries.filter(kind.isin("compaction", "branch_summary", "label")).select("session_id", F.col("entry_id").alias("source_id"), type_.alias("type"), "append_seq", F.posexplode(targets).alias("pos", "target_id"))
    return e.select("session_id", "source_id", "target_id", F.lit(None).cast("string").alias("target_ref"), "type", F.lit(True).alias("recorded"), F.lit(None).cast("string").alias("detail"), F.lit(1).alias("grp"), "append_seq", F.col("pos").cast("long").alias("ord")).select(*EDGE)


def to_store(parsed: Parsed, searchable: frozenset[str] = frozenset()) -> Store:
    """The searchable store of parsed files. Of several files of a session the last path counts."""
    one = parsed.headers.groupBy("session_id").agg(F.max(F.struct("file_path", "created_at", "cwd", "parent_session")).alias("h")).select("session_id", "h.*")
    e = parsed.entries.join(one.select("session_id", "file_path"), ["session_id", "file_path"], "left_semi")
    frags = project(e, searchable)
    names = frags.filter("semantic_kind = 'session.name'").join(e.select("session_id", "entry_id", "append_seq"), ["session_id", "entry_id"]).groupBy("session_id").agg(F.min_by("frag_text", "append_seq").alias("session_name"))
    sessions = one.join(names, "session_id", "left").select("session_id", "created_at", "cwd", "parent_session", "session_name", "file_path")
    columns = ["session_id", "entry_id", "append_seq", "parent_id", "entry_ts", "entry_type"]
    entries = e.select(*columns, *role_columns(F.col("v")), string_at(F.col("v"), "firstKeptEntryId").alias("first_kept_id"))
    return Store(sessions, entries, frags, recorded_links(e), e.select("session_id", "append_seq", "hash"))
