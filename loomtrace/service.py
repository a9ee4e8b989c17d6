"""The public operations on a store: search, read and trace, with authorization, cutoffs and bounds."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import InvalidArgument, NotFound, failure
from .functions.paths import workspace_root
from .functions.text import AGGREGATE_CHARS, NEIGHBOR_CHARS, PREVIEW_CHARS, READ_FRAGMENTS, preview, snippet, window
from .operators import relations, tree
from .operators.search import Execution, Request, authorized, cutoff_seq, search
from .store import Store

#: The most that a caller may ask for.
MAX_NEIGHBORS, MAX_WINDOW, MAX_CHILDREN, MAX_RELATED = 5, 4_000, 50, 20
#: Sessions that a plan names one by one at most.
_FAMILY = 1_000


def bounded_integer(name: str, value: Any, default: int, least: int, most: int) -> int:
    """value within its bounds: the default for None, cut at most; anything but an integer of at least least is an
    InvalidArgument."""
    if value is None:
        return default
    if isinstance(value, bool) or not (isinstance(value, int) or (isinstance(value, float) and value.is_integer())) or value < least:
        raise InvalidArgument(f"{name} must be an integer of {least} or more")
    return min(int(value), most)


@dataclass(frozen=True)
class Read:
    """How to read an event; order is branch or append."""

    order: str = "branch"
    before: int | None = None
    after: int | None = None
    fragment_id: str | None = None
    offset: int | None = None
    window: int | None = None


@dataclass
class History:
    """Operations on the sessions of a store that work below root."""

    store: Store
    root: str = "/"
    execution: Execution = field(default_factory=Execution)

    @classmethod
    def of_workspace(cls, store: Store, cwd: str, root: str | None = None, execution: Execution | None = None) -> History:
        return cls(store, workspace_root(root, cwd), execution or Execution())

    def session_id(self, name: str) -> str:
        """The id that a name stands for: current is the asking session."""
        if name != "current":
            return name
        if self.execution.current_session_id is None:
            raise InvalidArgument("there is no current session")
        return self.execution.current_session_id

    def search(self, request: Request) -> DataFrame:
        """The best events; the number of hits is not the caller's choice."""
        if request.session_id is not None:
            request = replace(request, session_id=self.session_id(request.session_id))
        return search(self.store, request, self.root, self.execution)

    def _cutoff(self, session_id: str) -> float:
        if self.execution.current_session_id != session_id:
            return math.inf
        return cutoff_seq(self.store, session_id, self.execution)

    def _event(self, session_id: str, entry_id: str) -> tuple[Any, DataFrame, float]:
        """The event, the session's events, and its cutoff. What isn't there, isn't allowed or comes after the cutoff
        is not found."""
        if authorized(self.store, self.root).filter(F.col("session_id") == session_id).isEmpty():
            raise NotFound(f"session {session_id}")
        events = self.store.events.filter(F.col("session_id") == session_id)
        cutoff = self._cutoff(session_id)
        e = events.filter(F.col("entry_id") == entry_id).first()
        if e is None or e.append_seq >= cutoff:
            raise NotFound(f"entry {session_id}/{entry_id}")
        return e, events, cutoff

    def _seen(self, df: DataFrame, cutoff: float) -> DataFrame:
        return df if math.isinf(cutoff) else df.filter(F.col("append_seq") < cutoff)

    def _previews(self, events: DataFrame, session_id: str) -> DataFrame:
        f = self.store.fragments.filter(F.col("session_id") == session_id)
        first = f.groupBy("entry_id").agg(F.min_by("frag_text", F.struct("frag_ord", "semantic_kind")).alias("t"))
        return events.join(first, "entry_id", "left").withColumn("preview", F.coalesce(snippet("t", [], NEIGHBOR_CHARS), F.lit(""))).drop("t")

    def read(self, session_id: str, entry_id: str, how: Read | None = None) -> dict[str, Any]:
        """An event: its states, its fragments within the reading budget, its neighbours, and forks on the way."""
        how = how or Read()
        session_id = self.session_id(session_id)
        if how.order not in ("branch", "append"):
            raise InvalidArgument("order must be branch or append")
        before, after = bounded_integer("before", how.before, 1, 0, MAX_NEIGHBORS), bounded_integer("after", how.after, 1, 0, MAX_NEIGHBORS)
        offset = None if how.offset is None else bounded_integer("offset", how.offset, 0, 0, 2**31 - 1)
        width = None if how.window is None else bounded_integer("window", how.window, 1, 1, MAX_WINDOW)
        e, events, cutoff = self._event(session_id, entry_id)
        own = self.store.fragments.filter((F.col("session_id") == session_id) & (F.col("entry_id") == entry_id))
        total = own.count()
        if how.fragment_id is not None:
            own = own.filter(F.col("fragment_id") == how.fragment_id)
            if own.isEmpty():
                raise NotFound(f"fragment {session_id}/{entry_id}/{how.fragment_id}")
        own = own.orderBy("frag_ord", "semantic_kind").limit(READ_FRAGMENTS)
        shown = min(total if how.fragment_id is None else 1, READ_FRAGMENTS)
        each = max(1, AGGREGATE_CHARS // shown) if shown else 0
        text = preview("frag_text", min(PREVIEW_CHARS, each)) if offset is None else window("frag_text", offset, each if width is None else min(width, each))
        rows = own.select("fragment_id", "semantic_kind", "tool_name", "is_error", "custom_type", text.alias("text")).collect()
        return {
            "session_id": session_id, "entry_id": entry_id, "entry_type": e.entry_type, "timestamp": e.entry_ts, "parent_id": e.parent_id, "branch_state": e.branch_state,
            "selection_state": e.selection_state, "role": e.entry_role, "context_role": e.context_role,
            "fragments": [{**{k: v for k, v in r.asDict().items() if k != "text"}, "preview": _ranges(r.text.asDict(), offset is not None)} for r in rows],
            "coverage": {"total": total, "returned": len(rows), "omitted": total - len(rows), "truncated": how.fragment_id is None and total > READ_FRAGMENTS},
            "neighbors": self._neighbors(e, events, cutoff, how.order, before, after),
        }

    def _neighbors(self, e: Any, events: DataFrame, cutoff: float, order: str, before: int, after: int) -> dict[str, Any]:
        keep = ["entry_id", "entry_type", "entry_ts", "branch_state", "selection_state", "preview", "append_seq", "distance"]
        if order == "append":
            near = events.filter((F.col("append_seq") >= e.append_seq - before) & (F.col("append_seq") <= e.append_seq + after) & (F.col("entry_id") != e.entry_id))
            near = self._previews(self._seen(near.withColumn("distance", F.col("append_seq") - e.append_seq), cutoff), e.session_id)
            rows = [r.asDict() for r in near.select(*keep).orderBy("append_seq").collect()]
            return {"order": order, "before": [r for r in rows if r["distance"] < 0], "after": [r for r in rows if r["distance"] > 0], "forks": []}
        me = events.filter(F.col("entry_id") == e.entry_id)
        up = tree.ancestors(events, me, before).select("entry_id", (-F.col("distance")).alias("distance"))
        near = events.join(up.unionByName(tree.descendants(events, me, after).select("entry_id", "distance")), "entry_id")
        near = near.select("entry_id", "entry_type", "entry_ts", "branch_state", "selection_state", "append_seq", "distance", "n_children", "session_id", "next_id")
        rows = [r.asDict() for r in self._previews(near, e.session_id).orderBy("distance").collect()]
        path = [r for r in rows if r["distance"] < 0] + [e.asDict() | {"distance": 0}] + [r for r in rows if r["distance"] > 0]
        forks = self._forks(path, events, cutoff, after)
        seen = [r for r in rows if r["append_seq"] < cutoff]
        across = self._forks_across([r for r in path if r["append_seq"] < cutoff or r["distance"] == 0], e.session_id)
        anchors = {f["at"][1] for f in across}
        pick = lambda rs: [{k: r[k] for k in keep} for r in rs]
        return {"order": order, "before": pick(r for r in seen if r["distance"] < 0), "after": pick(r for r in seen if r["distance"] > 0), "forks": [f for f in forks if f["at"][1] not in anchors] + across}

    def _forks(self, path: list[dict[str, Any]], events: DataFrame, cutoff: float, after: int) -> list[dict[str, Any]]:
        """Entries of the path with several visible children, and which one the path goes on with. The path's end is
        one of them if it was not cut by the limit."""
        out = []
        last = len(path) - 1
        for i, r in enumerate(path):
            if r["n_children"] < 2 or (i == last and (r["distance"] >= after or r["branch_state"] == tree.SELECTED)):
                continue
            kids = [k.entry_id for k in self._seen(events.filter(F.col("parent_id") == r["entry_id"]), cutoff).orderBy("append_seq").select("entry_id").collect()]
            chosen = path[i + 1]["entry_id"] if i < last else None
            if len(kids) > 1:
                out.append({"kind": "in-session", "at": (r["session_id"], r["entry_id"]), "candidates": [(r["session_id"], k) for k in kids], "chosen": (r["session_id"], chosen) if chosen in kids else None})
        return out

    def _groups(self, session_id: str) -> DataFrame:
        """Forks across sessions that a session takes part in and may be seen: authorized, and before the asking
        session's cutoff. Only the session, its parent, and both's children are compared."""
        allowed = authorized(self.store, self.root)
        p = relations.parents(allowed)
        up = p.filter(F.col("session_id") == session_id).select(F.col("parent_id").alias("session_id"))
        heads = up.unionByName(allowed.filter(F.col("session_id") == session_id).select("session_id"))
        family = heads.unionByName(p.join(heads.withColumnRenamed("session_id", "parent_id"), "parent_id").select("session_id")).distinct()
        ids = [r[0] for r in family.limit(_FAMILY + 1).collect()]
        near = F.col("session_id").isin(*ids)
        part = self.store
        if len(ids) <= _FAMILY:  # named in the plan, so that only their rows are read
            part = Store(*[None if x is None else x.filter(near) for x in (part.sessions, part.entries, part.fragments, part.links, part.hashes)])
            allowed = allowed.filter(near)
        groups = relations.fork_groups(part, allowed)
        current = self.execution.current_session_id
        if current is None or groups.filter(F.col("session_id") == current).isEmpty():
            return groups
        late = self.store.entries.filter((F.col("session_id") == current) & (F.col("append_seq") >= self._cutoff(current))).select("session_id", "entry_id")
        groups = groups.join(late, ["session_id", "entry_id"], "left_anti")
        many = groups.groupBy("at_session", "at_entry").count().filter("count > 1")
        return groups.join(many, ["at_session", "at_entry"], "left_semi")

    def _forks_across(self, path: list[dict[str, Any]], session_id: str) -> list[dict[str, Any]]:
        steps = {a["entry_id"]: b["entry_id"] for a, b in zip(path, path[1:])}
        if not steps:
            return []
        rows = self._groups(session_id).filter(F.col("at_entry").isin(*steps)).collect()
        out: dict[tuple[str, str], list[tuple[str, str]]] = {}
        for r in rows:
            out.setdefault((r.at_session, r.at_entry), []).append((r.session_id, r.entry_id))
        return [
            {"kind": "session-fork", "at": at, "candidates": sorted(c, key=lambda x: (x[0] != at[0], x)), "chosen": (session_id, steps[at[1]])}
            for at, c in sorted(out.items(), key=lambda x: (list(steps).index(x[0][1]), x[0])) if (session_id, steps[at[1]]) in c
        ]

    def trace(self, session_id: str, entry_id: str) -> dict[str, Any]:
        """An event's parent, children, siblings and relationships, each list cut at its limit."""
        session_id = self.session_id(session_id)
        e, events, cutoff = self._event(session_id, entry_id)
        seen = self._seen(events, cutoff)
        node = self._previews(events.filter(F.col("entry_id") == entry_id), session_id).first()

        def edge(row: Any, kind: str, recorded: bool) -> dict[str, Any]:
            state = row.branch_state if row is not None else "unknown"
            return {"type": kind, "from": (session_id, entry_id), "recorded": recorded, "target_branch_state": state, "leads_to_leaf": state == tree.SELECTED}

        parent = None
        if e.parent_id is not None:
            row = seen.filter(F.col("entry_id") == e.parent_id).first()
            if row is not None or math.isinf(cutoff):
                parent = edge(row, "parent", True) | {"to": (session_id, e.parent_id)}
        kids = seen.filter(F.col("parent_id") == entry_id).orderBy("append_seq").limit(MAX_CHILDREN + 1).collect()
        others = [] if e.parent_id is None else seen.filter((F.col("parent_id") == e.parent_id) & (F.col("entry_id") != entry_id)).orderBy("append_seq").limit(MAX_CHILDREN + 1).collect()
        related = self._related(e, events, seen, cutoff)
        return {
            "target": {k: node[k] for k in ("session_id", "entry_id", "entry_type", "entry_ts", "branch_state", "selection_state", "preview")},
            "parent": parent,
            "children": [edge(r, "child", True) | {"to": (session_id, r.entry_id)} for r in kids[:MAX_CHILDREN]],
            "siblings": [edge(r, "branch-sibling", False) | {"to": (session_id, r.entry_id)} for r in others[:MAX_CHILDREN]],
            "related": related[:MAX_RELATED],
            "truncated": len(kids) > MAX_CHILDREN or len(others) > MAX_CHILDREN or len(related) > MAX_RELATED,
        }

    def _related(self, e: Any, events: DataFrame, seen: DataFrame, cutoff: float) -> list[dict[str, Any]]:
        mine = Store(self.store.sessions, *[d.filter(F.col("session_id") == e.session_id) for d in (self.store.entries, self.store.fragments)], self.store.links)
        edges = relations.relationships(mine).filter((F.col("session_id") == e.session_id) & ((F.col("source_id") == e.entry_id) | (F.col("target_id") == e.entry_id)))
        if not math.isinf(cutoff):
            ids = seen.select(F.col("entry_id").alias("source_id"))
            edges = edges.join(ids, "source_id", "left_semi")
            edges = edges.filter("target_id IS NULL").unionByName(edges.filter("target_id IS NOT NULL").join(ids.withColumnRenamed("source_id", "target_id"), "target_id", "left_semi").select(*edges.columns))
        rows = relations.with_targets(edges, events).orderBy("grp", "append_seq", "ord").limit(MAX_RELATED + 1).collect()
        out = [
            {"type": r.type, "from": (e.session_id, r.source_id), "to": r.target_ref or (e.session_id, r.target_id), "recorded": r.recorded, "detail": r.detail, "target_branch_state": r.target_branch_state, "leads_to_leaf": r.leads_to_leaf}
            for r in rows
        ]
        groups = self._groups(e.session_id)
        me = (F.col("session_id") == e.session_id) & (F.col("entry_id") == e.entry_id)
        part = groups.filter((F.col("at_entry") == e.entry_id) & ((F.col("at_session") == e.session_id) | (F.col("session_id") == e.session_id))).select("at_session", "at_entry")
        at = part.unionByName(groups.filter(me).select("at_session", "at_entry")).distinct()
        ways = groups.join(at, ["at_session", "at_entry"], "left_semi").filter(~me)
        states = self.store.events.select("session_id", "entry_id", "branch_state")
        for r in ways.join(states, ["session_id", "entry_id"], "left").orderBy("at_session", "at_entry", F.col("session_id") != F.col("at_session"), "session_id", "entry_id").limit(MAX_RELATED + 1).collect():
            state = r.branch_state or "unknown"
            out.append({"type": relations.SESSION_FORK, "from": (e.session_id, e.entry_id), "to": (r.session_id, r.entry_id), "recorded": False, "detail": f"fork at {r.at_session}/{r.at_entry}", "target_branch_state": state, "leads_to_leaf": state == tree.SELECTED})
        return out

    def lineage(self, session_id: str) -> dict[str, Any]:
        """The parent session and the sorted child sessions, of those that may be seen."""
        session_id = self.session_id(session_id)
        allowed = authorized(self.store, self.root)
        if allowed.filter(F.col("session_id") == session_id).isEmpty():
            raise NotFound(f"session {session_id}")
        p = relations.parents(allowed).filter((F.col("session_id") == session_id) | (F.col("parent_id") == session_id)).collect()
        return {"session_id": session_id, "parent_id": next((r.parent_id for r in p if r.session_id == session_id), None), "child_ids": sorted(r.session_id for r in p if r.parent_id == session_id)}

    def call(self, operation: str, *args: Any) -> dict[str, Any]:
        """The result of search, read, trace or lineage in an envelope; failures show their code alone."""
        try:
            if operation not in ("search", "read", "trace", "lineage"):
                raise InvalidArgument("unknown operation")
            out = getattr(self, operation)(*args)
            return {"ok": True, "result": [r.asDict() for r in out.collect()] if isinstance(out, DataFrame) else out}
        except Exception as error:  # noqa: BLE001
            return failure(error)


def _ranges(p: dict[str, Any], windowed: bool) -> dict[str, Any]:
    """A preview with the ranges shown and left out."""
    n = p["total"]
    if windowed:
        shown = [(p["start"], p["end"])] if p["end"] > p["start"] else []
    elif p["truncated"]:
        shown = [(a, b) for a, b in ((0, p["head_end"]), (p["tail_start"], n)) if b > a]
    else:
        shown = [(0, n)]
    left, at = [], 0
    for a, b in shown:
        if a > at:
            left.append((at, a))
        at = max(at, b)
    if at < n:
        left.append((at, n))
    return {"text": p["text"], "total": n, "shown": shown, "omitted": left, "truncated": p["truncated"]}


