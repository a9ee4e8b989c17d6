"""Deeply nested records to flat tables of messages, blocks, calls and results with links to what encloses them.

A bottom-up tree automaton reads each record from its leaves. Scalars have states (LEAVES); the state of an object is the
set of marks that its fields' states make (MARKS); the edge under which it stands and its state give its variant
(VARIANT_OF), and whether it holds any other, which goes up to what encloses it. Only the parts that hold a variant are
then written, from the top, with links to what encloses them. Both passes keep worklists, so depth isn't bounded. Every
variant has a table of its own columns; all share (file_id, line_no, node, parent_node), the common supertype, by which
rows of any table can be joined with the row that encloses them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import text_batches
from ..functions.jsonvalues import json_type, parse_record, scalars, written
from .drift import Baseline, shape_of, version_of

#: Kinds of nodes.
ENTRY, MESSAGE, CALL, RESULT, TEXT, THINKING, OTHER = "entry", "message", "tool.call", "tool.result", "block.text", "block.thinking", "block.other"

_NODE = pa.schema(
    [
        ("file_id", pa.int64()),
        ("line_no", pa.int32()),
        ("line_hash", pa.int64()),
        ("node", pa.int32()),
        ("parent_node", pa.int32()),
        ("depth", pa.int32()),
        ("place", pa.string()),
        ("semantic_kind", pa.string()),
        ("tool_call_id", pa.string()),
        ("parent_call_id", pa.string()),
        ("name", pa.string()),
        ("role", pa.string()),
        ("body", pa.string()),
        ("is_error", pa.bool_()),
        ("version", pa.string()),
        ("if_named", pa.list_(pa.string())),
        ("reading", pa.string()),
    ]
)
_NODE_DDL = "file_id long, line_no int, line_hash long, node int, parent_node int, depth int, place string, semantic_kind string, tool_call_id string, parent_call_id string, name string, role string, body string, is_error boolean, version string, if_named array<string>, reading string"


def call_id(obj: dict[str, Any]) -> str | None:
    """The call id of a call: a string under toolCallId, else under id."""
    for key in ("toolCallId", "id"):
        if isinstance(obj.get(key), str):
            return obj[key]
    return None


#: States of leaves: strings that say something, other strings, all else; objects and arrays count as ANY to a field.
ANY, STRING = "any", "string"
LEAVES = {"toolResult": "toolResult", "text": "text", "thinking": "thinking"}
#: Marks of an object.
NAMED, ARGUED, IDENTIFIED, RESULT_ROLE, FILLED, TYPED, TYPED_TEXT, TYPED_THINKING = (1 << i for i in range(8))
#: What a field in a state marks its object with; a field of a string marks it with what ANY and STRING say, too.
MARKS = {
    ("name", ANY): NAMED, ("arguments", ANY): ARGUED, ("id", STRING): IDENTIFIED, ("toolCallId", STRING): IDENTIFIED, ("toolCallId", ANY): FILLED, ("content", ANY): FILLED,
    ("role", "toolResult"): RESULT_ROLE, ("type", STRING): TYPED, ("type", "text"): TYPED_TEXT, ("type", "thinking"): TYPED_THINKING,
}
_KEYS = frozenset(k for k, _ in MARKS)
#: Edges by the key under which an object stands, [] for each array between; all others are ELSEWHERE.
TOP, TOP_RESULT, ELSEWHERE = "top", "top result", "elsewhere"
EDGES = {"toolResults[]": "toolResults[]", "message": "message", "content[]": "content[]", "blocks[]": "content[]"}


def _variant(edge: str, marks: int) -> str | None:
    if edge in (TOP, TOP_RESULT):
        return RESULT if edge == TOP_RESULT else ENTRY
    if marks & (NAMED | ARGUED | IDENTIFIED) == NAMED | ARGUED | IDENTIFIED:
        return CALL
    if edge == "toolResults[]" or (marks & RESULT_ROLE and (edge == "message" or marks & FILLED)):
        return RESULT
    if edge == "message":
        return MESSAGE
    if edge == "content[]" and marks & TYPED:
        return TEXT if marks & TYPED_TEXT else THINKING if marks & TYPED_THINKING else OTHER
    return None


#: The variant of an object by its edge and its state.
VARIANT_OF = {(e, m): _variant(e, m) for e in (TOP, TOP_RESULT, ELSEWHERE, *EDGES.values()) for m in range(1 << 8)}


def _marks_of(obj: dict[str, Any]) -> int:
    """The state of an object from the states of its fields."""
    out = 0
    for key in _KEYS & obj.keys():
        value = obj[key]
        out |= MARKS.get((key, ANY), 0)
        if isinstance(value, str):
            out |= MARKS.get((key, STRING), 0) | MARKS.get((key, LEAVES.get(value)), 0)
    return out


def _text_of(value: Any) -> str | None:
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        return "\n".join(x["text"] for x in value if isinstance(x, dict) and isinstance(x.get("text"), str))
    return None


def flatten(record: dict[str, Any], is_result_entry: bool) -> list[dict[str, Any]]:
    """One row per classified object of a record, in document order; node 0 is the record itself."""
    seen: list[tuple[Any, str, int, int]] = []  # value, key, arrays between, place of what encloses it; parents first
    stack: list[tuple[Any, str, int, int]] = [(record, "", 0, -1)]
    while stack:
        x = stack.pop()
        value, key, lists, _ = x
        at = len(seen)
        seen.append(x)
        inner = ((v, key, lists + 1) for v in reversed(value)) if isinstance(value, list) else ((v, k, 0) for k, v in reversed(value.items()))
        stack.extend((v, k, n, at) for v, k, n in inner if isinstance(v, (dict, list)))
    kinds: list[str | None] = [None] * len(seen)
    holds = [False] * len(seen)
    for i in range(len(seen) - 1, -1, -1):  # children first
        value, key, lists, parent = seen[i]
        if isinstance(value, dict):
            edge = EDGES.get(key + "[]" * lists, ELSEWHERE) if parent >= 0 else TOP_RESULT if is_result_entry else TOP
            kinds[i] = VARIANT_OF[edge, _marks_of(value)]
        holds[i] |= kinds[i] is not None
        if parent >= 0 and holds[i]:
            holds[parent] = True
    rows: list[dict[str, Any]] = []
    above: list[tuple[int, int, str]] = [(-1, -1, "")] * len(seen)  # of each place: node, depth, call around what it encloses
    for i, (value, key, lists, parent) in enumerate(seen):
        if not holds[i]:
            continue
        node, depth, call = above[parent] if parent >= 0 else (-1, -1, "")
        if isinstance(value, list):
            above[i] = (node, depth, call)
            continue
        depth, kind = depth + 1, kinds[i]
        above[i] = (node, depth, call)
        if kind is None:
            continue
        own = call_id(value) if kind == CALL else value.get("toolCallId") if kind == RESULT else None
        own = own if isinstance(own, str) else "" if kind == RESULT else None
        error = value.get("isError")
        rows.append(
            {
                "node": len(rows),
                "parent_node": node if node >= 0 else None,
                "depth": depth,
                "place": key + "[]" * lists,
                "semantic_kind": kind,
                "tool_call_id": own,
                "parent_call_id": call,
                "name": next((value[x] for x in ("name", "toolName") if isinstance(value.get(x), str)), None),
                "role": value.get("role") if isinstance(value.get("role"), str) else None,
                "body": written(value.get("arguments")) if kind == CALL else next((s for x in ("text", "thinking", "result", "content", "output") if (s := _text_of(value.get(x))) is not None), None),
                "is_error": error if isinstance(error, bool) else None,
            }
        )
        above[i] = (len(rows) - 1, depth, (own or "") if kind in (CALL, RESULT) else call)
    return rows


def _is_result_type(value: Any) -> bool:
    return any(x == "tool_result" for x in scalars(value))


def nodes(lines: DataFrame, baseline: Baseline, type_names: DataFrame | None = None) -> DataFrame:
    """All classified objects of the entry records of lines (file_id, line_no, raw_text; line 1 is a header).

    type_names: file_id, version, name: under which name a version of a file keeps its entry type. A record without a
    type whose type would be tool_result under some foreign name is read both ways, and the reading that type_names
    confirms is kept; without a confirmation it is an entry of unknown type. Repeated rows of a line give its objects
    once. Invalid records, null texts and rows without file or line give none. The id of a result without call id is
    ''. Strings that hold JSON are text.
    """
    base = baseline["entry"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, "raw_text", 8_000_000):
            rows: list[dict[str, Any]] = []
            for f, n, t in zip(*(b.column(c).to_pylist() for c in ("file_id", "line_no", "raw_text"))):
                r = parse_record(t)
                if r is None or f is None or n is None:
                    continue
                own = {"file_id": f, "line_no": n, "line_hash": xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) >> 1}
                if "type" in r:
                    rows.extend(own | x for x in flatten(r, _is_result_type(r["type"])))
                    continue
                missing, extras = shape_of(r, base)
                if "type" not in missing:
                    missing = [*missing, "type"]
                names = [x for x in extras if json_type(r[x]) in ("string", "object", "array") and _is_result_type(r[x])]
                if not names:
                    rows.extend(own | x for x in flatten(r, False))
                    continue
                open_ = own | {"version": version_of(missing, extras), "if_named": names}
                rows.extend(open_ | {"reading": "result"} | x for x in flatten(r, True))
                rows.extend(open_ | {"reading": "entry"} | x for x in flatten(r, False))
            yield from pa.Table.from_pylist(rows, schema=_NODE).to_batches()

    found = lines.filter("line_no <> 1").select("file_id", "line_no", "raw_text").mapInArrow(run, _NODE_DDL)
    if type_names is None:
        return _once(found.filter("reading IS NULL OR reading = 'entry'"))
    sure = found.filter("reading IS NULL")
    names = type_names.groupBy("file_id", "version").agg(F.collect_set("name").alias("names"))
    both = found.filter("reading IS NOT NULL").join(names, ["file_id", "version"], "left")
    right = F.coalesce(F.arrays_overlap("if_named", "names"), F.lit(False)) == (F.col("reading") == "result")
    return _once(sure.unionByName(both.filter(right).drop("names")))


def _once(found: DataFrame) -> DataFrame:
    """The objects of repeated rows of a line once; only columns that are asked for travel."""
    return found.drop("version", "if_named", "reading").dropDuplicates(["file_id", "line_no", "line_hash", "node"]).drop("line_hash")


#: The columns of each variant's table beside file_id, line_no, node, parent_node and parent_call_id.
VARIANTS = {
    "messages": ([MESSAGE], ["role", "body"]),
    "blocks": ([TEXT, THINKING, OTHER], ["semantic_kind", "body"]),
    "calls": ([CALL], ["tool_call_id", "name", "body"]),
    "results": ([RESULT], ["tool_call_id", "name", "body", "is_error"]),
}


def variant(found: DataFrame, table: str) -> DataFrame:
    """The rows and columns of one variant's table out of nodes()."""
    kinds, columns = VARIANTS[table]
    return found.filter(F.col("semantic_kind").isin(kinds)).select("file_id", "line_no", "node", "parent_node", "parent_call_id", *columns)
