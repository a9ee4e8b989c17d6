"""Strict JSON records, their value types, and comparable forms of values."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from datetime import datetime, timezone
from json.decoder import scanstring
from typing import Any

import xxhash

_STAMP = re.compile(r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d")
_NUMBER = re.compile(r"-?[0-9]{1,19}(?:\.[0-9]{1,9})?")


def _reject(name: str) -> None:
    raise ValueError(name)


_SPACE = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"(true|false|null)|(-?(?:0|[1-9][0-9]*))(\.[0-9]+)?([eE][-+]?[0-9]+)?")
_WORDS = {"true": True, "false": False, "null": None}


def _skip(text: str, at: int) -> int:
    return _SPACE.match(text, at).end()


def _key(text: str, at: int) -> tuple[str, int]:
    """The key of an object at a place, and where its value begins."""
    if text[at : at + 1] != '"':
        raise ValueError("no key")
    key, at = scanstring(text, at + 1, True)
    at = _skip(text, at)
    if text[at : at + 1] != ":":
        raise ValueError("no colon")
    return key, _skip(text, at + 1)


def _read(text: str) -> Any:
    """The same as json.loads without constants, for any depth."""
    stack: list[tuple[Any, str | None]] = []
    at = _skip(text, 0)
    while True:
        ch, key = text[at : at + 1], None
        if ch in ("{", "["):
            value: Any = {} if ch == "{" else []
            at = _skip(text, at + 1)
            if text[at : at + 1] != ("}" if ch == "{" else "]"):
                if ch == "{":
                    key, at = _key(text, at)
                stack.append((value, key))
                continue
            at += 1
        elif ch == '"':
            value, at = scanstring(text, at + 1, True)
        else:
            m = _SCALAR.match(text, at)
            if not m:
                raise ValueError("no value")
            value = _WORDS[m[1]] if m[1] else float(m[0]) if m[3] or m[4] else int(m[0])
            at = m.end()
        while stack:
            holder, key = stack.pop()
            if key is None:
                holder.append(value)
            else:
                holder[key] = value
            at = _skip(text, at)
            ch = text[at : at + 1]
            if ch == ",":
                at = _skip(text, at + 1)
                if key is not None:
                    key, at = _key(text, at)
                stack.append((holder, key))
                break
            if ch != ("]" if key is None else "}"):
                raise ValueError("no end")
            value, at = holder, at + 1
        else:
            if _skip(text, at) != len(text):
                raise ValueError("more than one value")
            return value


def written(value: Any) -> str:
    """The value as JSON with sorted keys, for any depth."""
    try:
        return json.dumps(value, ensure_ascii=False, sort_keys=True)
    except RecursionError:
        pass
    out: list[str] = []
    stack: list[tuple[bool, Any]] = [(False, value)]
    while stack:
        done, x = stack.pop()
        if done:
            out.append(x)
        elif isinstance(x, dict):
            inner = [y for i, k in enumerate(sorted(x)) for y in ((True, ", " * (i > 0) + json.dumps(k, ensure_ascii=False) + ": "), (False, x[k]))]
            stack.extend(reversed([(True, "{"), *inner, (True, "}")]))
        elif isinstance(x, list):
            inner = [y for i, v in enumerate(x) for y in ((True, ", " * (i > 0)), (False, v))]
            stack.extend(reversed([(True, "["), *inner, (True, "]")]))
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)


def parse_record(text: str | None) -> dict[str, Any] | None:
    """The JSON object in a line, of any depth, or None for blank lines, invalid JSON (NaN and Infinity included) and
    anything but an object. Of a repeated key the last value counts."""
    if not text or not text.strip():
        return None
    try:
        value = json.loads(text, parse_constant=_reject)
    except RecursionError:
        try:
            value = _read(text)
        except ValueError:
            return None
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def json_type(value: Any) -> str:
    """null, boolean, number, string, object or array."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    return "object" if isinstance(value, dict) else "array"


def _number(value: Any) -> int | float | None:
    """The number that a value is or writes; None for booleans and all else."""
    if isinstance(value, bool):
        return None
    if isinstance(value, (int, float)):
        return value if math.isfinite(value) else None
    if isinstance(value, str) and _NUMBER.fullmatch(value):
        return float(value) if "." in value else int(value)
    return None


def _stamp_ms(value: Any) -> int | None:
    """Milliseconds since 1970 of an ISO stamp (without zone: UTC)."""
    if not isinstance(value, str) or not _STAMP.match(value):
        return None
    try:
        at = datetime.fromisoformat(value)
    except ValueError:
        return None
    at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
    return (at - datetime(1970, 1, 1, tzinfo=timezone.utc)) // _MS


def instants(value: Any) -> list[int]:
    """The milliseconds since 1970 that a value may stand for: an ISO stamp for one; a number, or its digits, for so
    many seconds, milliseconds, microseconds or nanoseconds, whichever they are."""
    ms = _stamp_ms(value)
    if ms is not None:
        return [ms]
    x = _number(value)
    if x is None:
        return []
    return list(dict.fromkeys([round(x * 1000), math.floor(x), math.floor(x / 1000) if isinstance(x, float) else x // 1000, math.floor(x / 1_000_000) if isinstance(x, float) else x // 1_000_000]))


def epoch_ms(value: Any) -> int | None:
    """The one of its instants that the size of a number makes likely: below 10^11 seconds, below 10^14 milliseconds,
    below 10^17 microseconds, else nanoseconds."""
    ms = instants(value)
    if len(ms) < 2:
        return ms[0] if ms else None
    size = abs(_number(value) or 0)
    return round(_number(value) * 1000) if size < 1e11 else int(_number(value) // (1 if size < 1e14 else 1000 if size < 1e17 else 1_000_000))


_MS = datetime(1970, 1, 1, 0, 0, 0, 1000) - datetime(1970, 1, 1)


def scalars(value: Any) -> Iterator[Any]:
    """The scalars in a value, at any depth, nulls left out."""
    stack = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            stack.extend(x.values())
        elif isinstance(x, list):
            stack.extend(x)
        elif x is not None:
            yield x


def forms(value: Any) -> list[str]:
    """What a value may be compared by: its own text and instants, those of what it wraps, and a list as a path."""
    out: dict[str, None] = {}
    for x in scalars(value):
        out["true" if x is True else "false" if x is False else str(x)] = None
        for ms in instants(x):
            out[f"@{ms}"] = None
    if isinstance(value, list) and value and all(isinstance(x, str) for x in value):
        out["/" + "/".join(value).lstrip("/")] = None
    return list(out)


def sketch(value: Any) -> list[int]:
    """The forms of a value, hashed to 64 bits as Spark's xxhash64 hashes strings."""
    return [h - (1 << 64) if (h := xxhash.xxh64_intdigest(f.encode("utf-8", "surrogatepass"), 42)) >> 63 else h for f in forms(value)]
