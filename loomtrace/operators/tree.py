"""Session trees: the selected branch, states of entries, successors, ancestors, descendants and neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import group_starts, whole_groups
from ..functions.joins import salted_join
from ..functions.positions import dense_position
from ..session import checkpointed
from .hierarchy import MAX_LOCAL, parent_rows, split_by_size

#: States of an entry.
SELECTED, ALTERNATE, UNKNOWN = "selected", "alternate", "unknown"
DIRECT, SUMMARIZED, NOT_SELECTED, NOT_APPLICABLE = "direct", "summarized", "not-selected", "not-applicable"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in whole_groups(batches, ["k"]):
        par = parent_rows(t)
        starts = group_starts(t, ["k"])
        last = np.append(starts[1:], t.num_rows)
        seq = t.column("seq").to_numpy()
        at = np.array([s + int(np.argmax(seq[s:e])) for s, e in zip(starts, last)], np.int64)
        seen = np.zeros(t.num_rows, bool)
        rows, backs, back = [], [], 0
        while len(at):
            seen[at] = True
            rows.append(at)
            backs.append(np.full(len(at), back, np.int64))
            at = par[at]
            at = at[at >= 0]
            at, back = at[~seen[at]], back + 1
        row = pa.array(np.concatenate(rows))
        out = pa.table({"k": t.column("k").combine_chunks().take(row), "v": t.column("v").combine_chunks().take(row), "back": pa.array(np.concatenate(backs))})
        yield from out.to_batches(max_chunksize=50_000)


def leaf_walks(nodes: DataFrame, max_local: int = MAX_LOCAL) -> DataFrame:
    """k, v, back: the entries on the walk from each group's last entry (greatest seq) up by parent, and how far back.

    nodes: k, v, p, seq, one row per (k, v). The walk ends at an entry without parent, before a parent that isn't
    there, and before an entry it has met. Groups over max_local rows are walked by doubling the reach of links.
    """
    small, large = split_by_size(nodes, max_local)
    out = small.repartition("k").sortWithinPartitions("k").mapInArrow(_walk, "k string, v string, back long")
    if large is None:
        return out
    rows = checkpointed(large)
    ends = rows.groupBy("k").agg(F.max_by("v", "seq").alias("v"))
    inner = rows.select("k", F.col("p").alias("v")).filter("v IS NOT NULL").unionByName(ends).distinct()
    jump = checkpointed(rows.join(inner, ["k", "v"], "left_semi").join(rows.select("k", F.col("v").alias("p")), ["k", "p"], "left_semi").select("k", "v", "p"))
    seen = checkpointed(ends.withColumn("back", F.lit(0).cast("long")))
    reach = 1
    while True:
        new = seen.join(jump, ["k", "v"]).select("k", F.col("p").alias("v"), (F.col("back") + reach).alias("back"))
        new = checkpointed(new.join(seen.select("k", "v"), ["k", "v"], "left_anti").groupBy("k", "v").agg(F.min("back").alias("back")))
        if new.isEmpty():
            return out.unionByName(seen)
        seen = checkpointed(seen.unionByName(new))
        jump = checkpointed(jump.join(jump.select("k", F.col("v").alias("p"), F.col("p").alias("q")), ["k", "p"]).select("k", "v", F.col("q").alias("p")))
        reach *= 2


def with_states(entries: DataFrame, max_local: int = MAX_LOCAL) -> DataFrame:
    """entries with branch_state, selection_state, back (place on the selected branch, from its end; null off it),
    n_children and next_id.

    entries: session_id, entry_id, parent_id, append_seq (dense), entry_type, context_role, first_kept_id; one row
    per (session_id, entry_id). An entry on the branch is summarized if a later compaction on the branch keeps only
    what comes after it; metadata and control are not-applicable, summaries direct. next_id continues the branch: the
    next entry on it, else the only child. Off the branch, an entry whose parent is missing is unknown.
    """
    nodes = entries.select(F.col("session_id").alias("k"), F.col("entry_id").alias("v"), F.col("parent_id").alias("p"), F.col("append_seq").alias("seq"))
    path = checkpointed(leaf_walks(nodes, max_local)).select(F.col("k").alias("session_id"), F.col("v").alias("entry_id"), "back")
    kids = entries.filter("parent_id IS NOT NULL").groupBy("session_id", F.col("parent_id").alias("entry_id")).agg(F.count("*").alias("n_children"), F.min_by("entry_id", "append_seq").alias("child"))
    after = path.select("session_id", (F.col("back") + 1).alias("back"), F.col("entry_id").alias("on_path"))
    path = path.join(after, ["session_id", "back"], "left")
    ids = entries.select("session_id", F.col("entry_id").alias("parent_id"), F.lit(True).alias("there"))
    e = entries.join(path, ["session_id", "entry_id"], "left").join(kids, ["session_id", "entry_id"], "left")
    e = salted_join(e, ids, ["session_id", "parent_id"], ["entry_id"], "left")
    selected = F.col("back").isNotNull()
    packs = e.filter(selected & (F.col("entry_type") == "compaction")).select("session_id", "append_seq", F.col("first_kept_id").alias("kept"))
    kept = entries.select("session_id", F.col("entry_id").alias("kept"), F.col("append_seq").alias("kept_seq"))
    packs = packs.join(kept, ["session_id", "kept"], "left").groupBy("session_id").agg(F.max(F.least("append_seq", F.coalesce("kept_seq", "append_seq"))).alias("until"))
    e = salted_join(e, packs, ["session_id"], ["entry_id"], "left")
    branch = F.when(selected, SELECTED).when(F.col("parent_id").isNotNull() & F.col("there").isNull(), UNKNOWN).otherwise(ALTERNATE)
    selection = (
        F.when(~selected, NOT_SELECTED)
        .when(F.col("context_role").isin("metadata", "control"), NOT_APPLICABLE)
        .when(F.col("context_role") == "summary", DIRECT)
        .when(F.coalesce(F.col("append_seq") < F.col("until"), F.lit(False)), SUMMARIZED)
        .otherwise(DIRECT)
    )
    n = F.coalesce("n_children", F.lit(0)).cast("long")
    following = F.when(selected, F.col("on_path")).when(n == 1, F.col("child"))
    return e.select(*entries.columns, branch.alias("branch_state"), selection.alias("selection_state"), "back", n.alias("n_children"), following.alias("next_id"))


def ancestors(events: DataFrame, targets: DataFrame | None, limit: int, max_local: int = MAX_LOCAL) -> DataFrame:
    """session_id, target_id, entry_id, distance: up to limit entries above each target (session_id, entry_id; None for
    every entry)."""
    return _steps(events.select(F.col("session_id").alias("k"), F.col("entry_id").alias("v"), F.col("parent_id").alias("p")), targets, limit, max_local)


def descendants(events: DataFrame, targets: DataFrame | None, limit: int, max_local: int = MAX_LOCAL) -> DataFrame:
    """session_id, target_id, entry_id, distance: up to limit entries that continue each target's branch."""
    return _steps(events.select(F.col("session_id").alias("k"), F.col("entry_id").alias("v"), F.col("next_id").alias("p")), targets, limit, max_local)


def _steps(links: DataFrame, targets: DataFrame | None, limit: int, max_local: int) -> DataFrame:
    """Steps along links (k, v, p) from the targets, none to an entry that was met. Sessions of up to max_local entries
    are walked whole, many in a task; larger ones by joins, one a step."""
    if limit < 1:
        return links.filter("false").select(F.col("k").alias("session_id"), F.col("v").alias("target_id"), F.col("v").alias("entry_id"), F.lit(0).cast("long").alias("distance"))
    if targets is None:
        links = links.withColumn("go", F.lit(True))
    else:
        wanted = targets.select(F.col("session_id").alias("k"), F.col("entry_id").alias("v"), F.lit(True).alias("go")).distinct()
        links = links.join(wanted, ["k", "v"], "left").withColumn("go", F.coalesce("go", F.lit(False)))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["k"], 50_000):
            nxt = parent_rows(t)
            k, v = t.column("k").combine_chunks(), t.column("v").combine_chunks()
            at = np.flatnonzero(t.column("go").to_numpy(zero_copy_only=False).astype(bool))
            met = [at]
            for d in range(1, limit + 1):
                to = nxt[met[-1]]
                keep = to >= 0
                for m in met:
                    keep &= to != m
                met = [m[keep] for m in met] + [to[keep]]
                start, now = pa.array(met[0]), pa.array(met[-1])
                whole = pa.table({"session_id": k.take(start), "target_id": v.take(start), "entry_id": v.take(now), "distance": pa.array(np.full(len(start), d, np.int64))})
                yield from whole.to_batches(max_chunksize=50_000)

    small, large = split_by_size(links, max_local)
    out = small.repartition("k").sortWithinPartitions("k").mapInArrow(walk, "session_id string, target_id string, entry_id string, distance long")
    if large is None:
        return out
    large = checkpointed(large)
    step = large.filter("p IS NOT NULL").select("k", F.col("v").alias("at"), F.col("p").alias("next")).join(large.select("k", F.col("v").alias("next")), ["k", "next"], "left_semi")
    at = large.filter("go").select("k", F.col("v").alias("target_id"), F.col("v").alias("at"), F.array("v").alias("met"))
    for d in range(1, limit + 1):
        at = at.join(step, ["k", "at"]).filter(~F.array_contains("met", F.col("next")))
        at = checkpointed(at.select("k", "target_id", F.col("next").alias("at"), F.concat("met", F.array("next")).alias("met")))
        out = out.unionByName(at.select(F.col("k").alias("session_id"), "target_id", F.col("at").alias("entry_id"), F.lit(d).cast("long").alias("distance")))
    return out


def append_neighbors(events: DataFrame, before: int, after: int) -> DataFrame:
    """session_id, entry_id, neighbor_id, distance (negative before) of the entries next to each in log order."""
    steps = F.explode(F.filter(F.sequence(F.lit(-before), F.lit(after)), lambda d: d != 0))
    want = events.select("session_id", "entry_id", "append_seq", steps.alias("distance")).withColumn("append_seq", F.col("append_seq") + F.col("distance"))
    there = events.select("session_id", "append_seq", F.col("entry_id").alias("neighbor_id"))
    return want.join(there, ["session_id", "append_seq"]).select("session_id", "entry_id", "neighbor_id", F.col("distance").cast("long").alias("distance"))


def children(events: DataFrame) -> DataFrame:
    """session_id, parent_id, entry_id, place: children of each entry and their places by log order, from 0. No task
    sorts all children of one parent."""
    c = events.filter("parent_id IS NOT NULL").select("session_id", "parent_id", "entry_id", "append_seq")
    return dense_position(c, ["session_id", "parent_id"], "append_seq", "entry_id", "place").drop("append_seq")


def siblings(events: DataFrame, limit: int = 50) -> DataFrame:
    """session_id, entry_id, sibling_id, n_siblings: up to limit other children of each entry's parent, the first in
    log order, and how many there are. Entries without parent or without siblings have no rows."""
    c = children(events)
    n = c.groupBy("session_id", "parent_id").agg(F.count("*").alias("n"))
    other = c.filter(F.col("place") <= limit).select("session_id", "parent_id", F.col("entry_id").alias("sibling_id"), F.col("place").alias("at"))
    other = other.join(n.filter("n > 1"), ["session_id", "parent_id"])  # limit + 1 rows a parent at most
    pairs = salted_join(c, other, ["session_id", "parent_id"], ["entry_id"])
    pairs = pairs.filter((F.col("entry_id") != F.col("sibling_id")) & (F.col("at") < limit + (F.col("place") < limit).cast("int")))
    return pairs.select("session_id", "entry_id", "sibling_id", (F.col("n") - 1).alias("n_siblings"))


def forks(events: DataFrame) -> DataFrame:
    """session_id, at_entry, candidate_id, chosen: every entry with several children, and which of them its branch
    goes on with (nothing is chosen off the selected branch)."""
    at = events.filter("n_children > 1").select("session_id", F.col("entry_id").alias("at_entry"), F.when(F.col("branch_state") == SELECTED, F.col("next_id")).alias("go"))
    kids = events.select("session_id", F.col("parent_id").alias("at_entry"), F.col("entry_id").alias("candidate_id"))
    return at.join(kids, ["session_id", "at_entry"]).select("session_id", "at_entry", "candidate_id", F.coalesce(F.col("candidate_id") == F.col("go"), F.lit(False)).alias("chosen"))
