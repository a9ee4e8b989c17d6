"""Schemas that drift between files: detect added, renamed, removed and retyped fields, then unify them.

Records are profiled in one pass. Records with the same set of missing and foreign fields form a version of a file.
Each version is matched with the version that the baseline describes: a bipartite matching of its missing required
fields with its foreign fields, weighed by the values they share with a reference, by type and by name. Values travel as
sketches, 64-bit hashes of the forms they may be compared by. unify() then gives one table, a typed column a field.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import text_batches, whole_groups
from ..functions.joins import salted_join
from ..functions.jsonvalues import epoch_ms, json_type, parse_record, scalars, sketch, written

_RECORD = pa.schema(
    [
        ("file_id", pa.int64()),
        ("line_no", pa.int32()),
        ("record_kind", pa.string()),
        ("version", pa.string()),
        ("refs", pa.list_(pa.int64())),
        ("missing", pa.list_(pa.string())),
        ("extras", pa.list_(pa.struct([("name", pa.string()), ("kind", pa.string()), ("forms", pa.list_(pa.int64()))]))),
        ("retyped", pa.list_(pa.string())),
    ]
)
_RECORD_DDL = "file_id long, line_no int, record_kind string, version string, refs array<long>, missing array<string>, extras array<struct<name:string,kind:string,forms:array<long>>>, retyped array<string>"

Baseline = dict[str, dict[str, tuple[str, bool]]]
#: A baseline has so many fields at most; it is a parameter and goes into the plan.
MAX_BASELINE = 5_000


def read_baseline(df: DataFrame) -> Baseline:
    """record_kind -> field_name -> (json_type, is_required), from a table of that form and bounded size."""
    rows = df.select("record_kind", "field_name", "json_type", "is_required").filter("field_name IS NOT NULL").limit(MAX_BASELINE + 1).collect()
    if len(rows) > MAX_BASELINE:
        raise ValueError(f"the baseline has more than {MAX_BASELINE} fields")
    out: Baseline = {"header": {}, "entry": {}}
    for r in rows:
        out.setdefault(r.record_kind, {})[r.field_name] = (r.json_type, bool(r.is_required))
    return out


def version_of(missing: list[str], extras: list[str]) -> str:
    """The name of the version of records that lack and add these fields."""
    return json.dumps([sorted(missing), sorted(extras)], ensure_ascii=False)


def shape_of(record: dict[str, Any], base: dict[str, tuple[str, bool]]) -> tuple[list[str], list[str]]:
    """Required fields that a record lacks, and its fields outside the baseline."""
    return [f for f, (_, need) in base.items() if need and f not in record], [f for f in record if f not in base]


def profile(lines: DataFrame, baseline: Baseline, ref_field: str = "id") -> DataFrame:
    """One row per valid record of lines (file_id, line_no, raw_text); line 1 is a header, others are entries.

    refs: sketches of what the record may be called by in the reference: its own ref_field or, if that is missing, any
    value that its foreign fields hold. A null file_id, line_no or text gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, "raw_text", 8_000_000):
            rows = []
            for f, n, t in zip(*(b.column(c).to_pylist() for c in ("file_id", "line_no", "raw_text"))):
                record = parse_record(t)
                if record is None or f is None or n is None:
                    continue
                kind = "header" if n == 1 else "entry"
                base = baseline[kind]
                missing, extras = shape_of(record, base)
                wide = bool(missing)
                foreign = [{"name": x, "kind": json_type(record[x]), "forms": sketch(record[x]) if wide else []} for x in extras]
                if not wide or kind == "header":
                    refs = []
                elif ref_field in record:
                    refs = sketch(record[ref_field])
                else:
                    refs = [v for x in foreign for v in x["forms"]]
                retyped = [x for x, v in record.items() if x in base and v is not None and json_type(v) != base[x][0]]
                if missing or extras or retyped:
                    rows.append({"file_id": f, "line_no": n, "record_kind": kind, "version": version_of(missing, extras), "refs": refs, "missing": missing, "extras": foreign, "retyped": retyped})
            yield from pa.Table.from_pylist(rows, schema=_RECORD).to_batches()

    return lines.select("file_id", "line_no", "raw_text").mapInArrow(run, _RECORD_DDL)


def hashed(texts: F.Column) -> F.Column:
    """The sketch of an array of forms."""
    return F.transform(texts, lambda x: F.xxhash64(x))


def evidence(records: DataFrame, header_truth: DataFrame, entry_truth: DataFrame, ref_field: str = "id") -> DataFrame:
    """Which foreign field of a record holds the value that a missing field ought to have.

    header_truth: file_id, session_id, field_name, truth (an array of forms). entry_truth: session_id, ref, truths (map
    from field name to an array of forms). Result: file_id, line_no, record_kind, version, field_name, name (null where
    only the value that ought to be there is known), kind.

    Everything joined is slim: the values to find as one hash a row, and those that foreign fields hold likewise.
    """
    key = ["file_id", "line_no", "version"]
    lacking = records.filter(F.size("missing") > 0)
    wanted = lacking.filter("record_kind = 'header'").select(*key, "record_kind", F.explode("missing").alias("field_name"))
    truth = header_truth.select("file_id", "field_name", hashed(F.col("truth")).alias("truth"))
    h = salted_join(wanted, truth, ["file_id", "field_name"], ["line_no"]).select(*key, "record_kind", "field_name", "truth")
    e = lacking.filter("record_kind = 'entry'").select(*key, "record_kind", "missing", F.array_distinct("refs").alias("refs"))
    e = salted_join(e, header_truth.filter("field_name = 'sessionId'").select("file_id", "session_id").distinct(), ["file_id"], ["line_no"])
    known = entry_truth.select("session_id", F.xxhash64("ref").alias("ref"), F.transform_values("truths", lambda _, x: hashed(x)).alias("truths"))
    e = e.select(*key, "record_kind", "missing", "session_id", F.explode("refs").alias("ref")).join(known, ["session_id", "ref"])
    e = e.withColumn("field_name", F.explode("missing"))
    truth = F.when(F.col("field_name") == ref_field, F.array("ref")).otherwise(F.col("truths")[F.col("field_name")])
    e = e.select(*key, "record_kind", "field_name", truth.alias("truth")).filter("truth IS NOT NULL")
    want = h.unionByName(e)
    have = lacking.select(*key, F.explode("extras").alias("x")).select(*key, "x.name", "x.kind", F.explode("x.forms").alias("form"))
    held = want.select(*key, "record_kind", "field_name", F.explode("truth").alias("form")).join(have.distinct(), [*key, "form"])
    columns = ["file_id", "line_no", "record_kind", "version", "field_name", "name", "kind"]
    none = F.lit(None).cast("string")
    return want.withColumns({"name": none, "kind": none}).select(*columns).unionByName(held.select(*columns))


def name_similarity(a: str, b: str) -> float:
    """Share of common letter pairs (Dice) of two names, case and separators aside."""
    p, q = ({s[i : i + 2] for i in range(len(s) - 1)} for s in ("".join(c for c in x.lower() if c.isalnum()) for x in (a, b)))
    return 2 * len(p & q) / (len(p) + len(q)) if p and q else 0.0


def match(score: dict[tuple[str, str], float]) -> dict[str, str]:
    """The assignment of left names to right names with the greatest sum of positive scores (Hungarian by augmenting
    shortest paths); ties go to the names that sort first."""
    left, right = sorted({a for a, _ in score}), sorted({b for _, b in score})
    n = max(len(left), len(right))
    top = max(score.values(), default=0.0)
    cost = [[top - score.get((left[i], right[j]), 0.0) if i < len(left) and j < len(right) else top for j in range(n)] for i in range(n)]
    u, v, of, way = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        of[0], j0 = i, 0
        low, used = [float("inf")] * (n + 1), [False] * (n + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = of[j0], float("inf"), 0
            for j in range(1, n + 1):
                if not used[j]:
                    now = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if now < low[j]:
                        low[j], way[j] = now, j0
                    if low[j] < delta:
                        delta, j1 = low[j], j
            for j in range(n + 1):
                if used[j]:
                    u[of[j]] += delta
                    v[j] -= delta
                else:
                    low[j] -= delta
            j0 = j1
            if of[j0] == 0:
                break
        while j0:
            of[j0], j0 = of[way[j0]], way[j0]
    pairs = {left[of[j] - 1]: right[j - 1] for j in range(1, n + 1) if of[j] <= len(left) and j <= len(right)}
    return {a: b for a, b in pairs.items() if score.get((a, b), 0.0) > 0}


_CHANGES = "file_id long, record_kind string, version string, field_name string, change_kind string, new_name string"


def changes(records: DataFrame, proof: DataFrame, baseline: Baseline) -> DataFrame:
    """Every change that each version of a file shows: file_id, record_kind, version, field_name, change_kind
    (renamed, removed, retyped, added) and, for renamed, new_name.

    A missing field is renamed where the matching gives it a foreign field that holds its value in some record; where
    some record of the version holds the value nowhere, it is removed there and the foreign field is added.
    """
    one = F.lit(None).cast("string")
    key = ["file_id", "record_kind", "version"]
    facts = (
        records.select(*key, F.lit("missing").alias("fact"), F.explode("missing").alias("field"), one.alias("name"), one.alias("kind"))
        .unionByName(records.select(*key, F.lit("retyped").alias("fact"), F.explode("retyped").alias("field"), one.alias("name"), one.alias("kind")))
        .unionByName(records.select(*key, F.lit("extra").alias("fact"), one.alias("field"), F.explode("extras.name").alias("name"), one.alias("kind")))
        .groupBy(*key, "fact", "field", "name", "kind")
        .agg(F.count("*").alias("n"))
    )
    by_record = proof.groupBy(*key, "line_no", "field_name").agg(F.collect_set(F.when(F.col("name").isNotNull(), F.struct("name", "kind"))).alias("held"))
    held = by_record.select(*key, F.lit("held").alias("fact"), F.col("field_name").alias("field"), F.explode("held").alias("x"))
    held = held.select(*key, "fact", "field", "x.name", "x.kind")
    lost = by_record.filter(F.size("held") == 0).select(*key, F.lit("lost").alias("fact"), F.col("field_name").alias("field"), one.alias("name"), one.alias("kind"))
    facts = facts.unionByName(held.unionByName(lost).groupBy(*key, "fact", "field", "name", "kind").agg(F.count("*").alias("n")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file_id", pa.int64()), *[(c, pa.string()) for c in ("record_kind", "version", "field_name", "change_kind", "new_name")]])
        for t in whole_groups(batches, key):
            groups: dict[tuple, list[dict]] = defaultdict(list)
            for r in t.to_pylist():
                groups[r["file_id"], r["record_kind"], r["version"]].append(r)
            rows = [dict(zip(key, g)) | c for g, rs in groups.items() for c in _of_version(rs, baseline.get(g[1], {}))]
            yield from pa.Table.from_pylist(rows, schema=schema).to_batches()

    return facts.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, _CHANGES)


def _of_version(facts: list[dict], base: dict[str, tuple[str, bool]]) -> Iterator[dict[str, Any]]:
    missing = {r["field"] for r in facts if r["fact"] == "missing"}
    extras = {r["name"] for r in facts if r["fact"] == "extra"}
    lost = {r["field"] for r in facts if r["fact"] == "lost"}
    score: dict[tuple[str, str], float] = defaultdict(float)
    kinds: dict[tuple[str, str], set[str]] = defaultdict(set)
    for r in facts:
        if r["fact"] == "held":
            pair = (r["field"], r["name"])
            score[pair] += r["n"]
            kinds[pair].add(r["kind"])
    for f, g in score:
        score[f, g] += 0.1 * name_similarity(f, g) + 0.05 * (base[f][0] in kinds[f, g])
    to = match(score)
    named = set()
    for f in sorted(missing):
        if f in to:
            named.add(to[f])
            yield {"field_name": f, "change_kind": "renamed", "new_name": to[f]}
            if kinds[f, to[f]] - {base[f][0], "null"}:
                yield {"field_name": f, "change_kind": "retyped", "new_name": to[f]}
        if f not in to or f in lost:
            yield {"field_name": f, "change_kind": "removed", "new_name": None}
            if f in to:
                yield {"field_name": to[f], "change_kind": "added", "new_name": None}
    for f in sorted({r["field"] for r in facts if r["fact"] == "retyped"}):
        yield {"field_name": f, "change_kind": "retyped", "new_name": None}
    for g in sorted(extras - named):
        yield {"field_name": g, "change_kind": "added", "new_name": None}


def _text(value: Any) -> str | None:
    """One string for a required value, however it is wrapped."""
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, list) and len(value) > 1 and all(isinstance(x, str) for x in value):
        return "/" + "/".join(value).lstrip("/")
    first = next((x for x in scalars(value) if isinstance(x, str)), None)
    return first if first is not None else written(value)


def _instant(value: Any) -> str | None:
    """The instant that a value holds, as an ISO stamp; its text if it holds none."""
    best = next((m for m in map(epoch_ms, scalars(value)) if m is not None), None)
    try:
        return _text(value) if best is None else pa.scalar(best, pa.timestamp("ms")).as_py().isoformat(timespec="milliseconds") + "Z"
    except (ValueError, OverflowError):
        return _text(value)


def typed(value: Any, kind: str) -> Any:
    """A value as the baseline's type has it, None where it can't be read as one: strings and numbers out of each other,
    booleans out of their words and of 0 and 1, objects and arrays as JSON."""
    if kind in ("object", "array"):
        return written(value) if json_type(value) == kind else None
    if isinstance(value, (dict, list)) or value is None:
        return None
    if kind == "string":
        return value if isinstance(value, str) else written(value)
    if kind == "boolean":
        return value if isinstance(value, bool) else {"true": True, "false": False, "1": True, "0": False}.get(str(value).lower())
    try:
        return None if isinstance(value, bool) else float(value)
    except (ValueError, OverflowError):
        return None


_ARROW = {"boolean": (pa.bool_(), "boolean"), "number": (pa.float64(), "double")}


def unify(lines: DataFrame, baseline: Baseline, found: DataFrame, kind: str, stamps: frozenset[str] = frozenset()) -> DataFrame:
    """All valid records of a kind (header: line 1, entry: the others) as one table: file_id, line_no, a column for each
    field of the baseline, and rest.

    found: changes(). A required field that a version keeps under another name, or wrapped, comes out under its own as
    a string, those in stamps as ISO stamps; every other field has the baseline's type (objects and arrays as JSON). rest
    maps the names of all other fields, and of fields whose value can't be read as their type, to their JSON. Repeated
    rows give one row. Fields named file_id, line_no or rest raise ValueError.
    """
    base = baseline[kind]
    if {"file_id", "line_no", "rest", "version", "foreign"} & {*base}:
        raise ValueError("a field bears the name of another column")
    required = [x for x, (_, need) in base.items() if need]
    types = {x: (pa.string(), "string") if x in required else _ARROW.get(t, (pa.string(), "string")) for x, (t, _) in base.items()}
    pairs = pa.list_(pa.struct([("name", pa.string()), ("text", pa.string())]))
    schema = pa.schema([("file_id", pa.int64()), ("line_no", pa.int32()), ("version", pa.string()), *[(x, a) for x, (a, _) in types.items()], ("foreign", pa.list_(pa.struct([("name", pa.string()), ("text", pa.string()), ("stamp", pa.string())]))), ("rest", pairs)])
    ddl = ", ".join(["file_id long, line_no int, version string", *(f"`{x}` {d}" for x, (_, d) in types.items()), "foreign array<struct<name:string,text:string,stamp:string>>", "rest array<struct<name:string,text:string>>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, "raw_text", 8_000_000):
            rows = []
            for f, n, raw in zip(*(b.column(x).to_pylist() for x in ("file_id", "line_no", "raw_text"))):
                r = parse_record(raw)
                if r is None or f is None or n is None:
                    continue
                missing, extras = shape_of(r, base)
                row = {"file_id": f, "line_no": n, "version": version_of(missing, extras) if missing else None}
                rest = {x: r[x] for x in extras}
                for x, v in r.items():
                    if x in base:
                        row[x] = (_instant if x in stamps else _text)(v) if x in required else typed(v, base[x][0])
                        if row[x] is None and v is not None:
                            rest[x] = v
                row["foreign"] = [{"name": x, "text": _text(r[x]), "stamp": _instant(r[x])} for x in extras] if missing else []
                row["rest"] = [{"name": x, "text": written(rest[x])} for x in sorted(rest)]
                rows.append(row)
            yield from pa.Table.from_pylist(rows, schema=schema).to_batches()

    own = lines.filter("line_no = 1" if kind == "header" else "line_no <> 1").select("file_id", "line_no", "raw_text").distinct()
    read = own.mapInArrow(run, ddl)
    names = found.filter((F.col("change_kind") == "renamed") & (F.col("record_kind") == kind)).select("file_id", "version", "field_name", "new_name").distinct()
    names = names.groupBy("file_id", "version").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field_name", "new_name")))).alias("names"))
    plain = read.filter("version IS NULL").withColumn("names", F.lit(None).cast("map<string,string>"))
    every = plain.unionByName(read.filter("version IS NOT NULL").join(names, ["file_id", "version"], "left").select(*plain.columns))

    def column(x: str) -> F.Column:
        if x not in required:
            return F.col(f"`{x}`")
        there = F.filter("foreign", lambda y: y["name"] == F.col("names")[x])
        return F.coalesce(F.col(f"`{x}`"), F.get(there, F.lit(0))["stamp" if x in stamps else "text"]).alias(x)

    renamed = F.coalesce(F.map_values("names"), F.array().cast("array<string>"))
    rest = F.map_from_entries(F.filter("rest", lambda y: ~F.array_contains(renamed, y["name"])))
    return every.select("file_id", "line_no", *[column(x) for x in base], rest.alias("rest"))
