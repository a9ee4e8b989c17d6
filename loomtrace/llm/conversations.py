"""Conversations out of message rows: one ordered walk per session, checked by a finite automaton.

Rows are gathered by conversation key and sorted within it. Groups of up to ``max_local`` rows are walked inside a
task, many groups at once. Larger ones are walked by DataFrame joins that double the reach of the links each round,
and their turns are checked in bounded stretches whose transitions are then combined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import gathered, group_starts, whole_groups
from ..functions.contraction import FREE, contract
from ..operators.hierarchy import MAX_LOCAL, parent_rows, split_by_size
from ..session import checkpointed

NONE, USER, ASSISTANT = 0, 1, 2
#: Turns of a stretch that is checked as one window.
STRETCH = 4_096
#: The automaton reads turns from the end to the start; its state is the turn read before (NONE at the end).
#: NEXT[state, turn] is the new state, FAULTY[state, turn] tells that a user turn gets no reply.
NEXT = np.array([[NONE, USER, ASSISTANT]] * 3)
NEXT[USER, NONE], NEXT[ASSISTANT, NONE] = USER, ASSISTANT
FAULTY = np.array([[False, True, False], [False, True, False], [False, False, False]])
_DDL = "k string, v string, back long, turn int, fault string"


def _walk(t: pa.Table) -> pa.Table:
    """The turns on the walk of each group (back: links from the leaf), and one row without v for its fault. Groups are
    sorted by seq, so that the walk starts at their last row."""
    par = parent_rows(t)
    starts = group_starts(t, ["k"])
    turn = t.column("turn").to_numpy()
    leaf = np.append(starts[1:], t.num_rows)[: len(starts)] - 1
    c = contract(np.where(par >= 0, par, -1))
    broken = (c.state[leaf] != FREE) | (par[c.root[leaf]] == -2)
    at, group = leaf[~broken], np.flatnonzero(~broken)
    state = np.zeros(len(leaf), np.int64)
    bad, some = np.zeros(len(leaf), bool), np.zeros(len(leaf), bool)
    rows, backs, back = [], [], 0
    while len(at):
        now = turn[at]
        bad[group] |= FAULTY[state[group], now]
        state[group] = NEXT[state[group], now]
        some[group] |= now > 0
        rows.append(at[now > 0])
        backs.append(np.full(int((now > 0).sum()), back, np.int64))
        go = par[at] >= 0
        at, group, back = par[at[go]], group[go], back + 1
    v, k = t.column("v").combine_chunks(), t.column("k").combine_chunks()
    row = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
    turns = pa.table({"k": k.take(row), "v": v.take(row), "back": pa.array(np.concatenate(backs) if backs else np.zeros(0, np.int64)), "turn": pa.array(turn[row.to_numpy()].astype(np.int32)), "fault": pa.nulls(len(row), pa.string())})
    fault = np.where(broken, "broken", np.where(~some, "empty", np.where(bad, "no_reply", "")))
    n = len(leaf)
    faults = pa.table({"k": k.take(pa.array(leaf)), "v": pa.nulls(n, pa.string()), "back": pa.nulls(n, pa.int64()), "turn": pa.nulls(n, pa.int32()), "fault": pa.array(fault, pa.string(), mask=fault == "")})
    return pa.concat_tables([turns, faults])


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in whole_groups(batches, ["k"]):
        yield from _walk(t).to_batches(max_chunksize=50_000)


def _doubled(rows: DataFrame) -> DataFrame:
    """The same as _walk for groups of any size."""
    rows = checkpointed(rows)
    leaf = rows.groupBy("k").agg(F.max(F.struct(F.col("seq").isNotNull(), "seq", "v")).alias("o"), F.count("*").alias("n"))
    size = leaf.agg(F.max("n")).first()[0] or 0
    ends = leaf.select("k", F.col("o.v").alias("v"))
    inner = rows.filter("p IS NOT NULL").select("k", F.col("p").alias("v")).unionByName(ends).distinct()
    jump = rows.filter("p IS NOT NULL").join(inner, ["k", "v"], "left_semi").join(rows.select("k", F.col("v").alias("p")), ["k", "p"], "left_semi").select("k", "v", "p")
    jump = checkpointed(jump)
    seen = checkpointed(ends.withColumn("back", F.lit(0).cast("long")))
    reach = 1
    while reach <= size:
        new = seen.join(jump, ["k", "v"]).select("k", F.col("p").alias("v"), (F.col("back") + reach).alias("back"))
        new = checkpointed(new.join(seen.select("k", "v"), ["k", "v"], "left_anti"))
        if new.isEmpty():
            break
        seen = checkpointed(seen.unionByName(new).groupBy("k", "v").agg(F.min("back").alias("back")))
        jump = checkpointed(jump.join(jump.select("k", F.col("v").alias("p"), F.col("p").alias("q")), ["k", "p"]).select("k", "v", F.col("q").alias("p")))
        reach *= 2
    on = checkpointed(seen.join(rows.select("k", "v", "p", "turn"), ["k", "v"]))
    whole = on.filter("p IS NULL").select("k").distinct()
    turns = on.join(whole, "k", "left_semi").filter("turn > 0").withColumn("part", F.floor(F.col("back") / STRETCH))
    before = F.lag("turn").over(Window.partitionBy("k", "part").orderBy("back"))
    inside = turns.withColumn("before", before).groupBy("k", "part").agg(
        F.max(F.coalesce((F.col("turn") == USER) & (F.col("before") == USER), F.lit(False))).alias("bad"), F.min_by("turn", "back").alias("first"), F.max_by("turn", "back").alias("last")
    )
    joint = F.coalesce(F.lag("last").over(Window.partitionBy("k").orderBy("part")), F.lit(USER))  # the end needs a reply too
    parts = inside.withColumn("bad", F.col("bad") | ((F.col("first") == USER) & (joint == USER)))
    faults = parts.groupBy("k").agg(F.max("bad").alias("bad"))
    ok = F.col("ok").isNotNull()
    f = F.when(~ok, "broken").when(F.col("bad").isNull(), "empty").when(F.col("bad"), "no_reply")
    faults = ends.select("k").join(whole.withColumn("ok", F.lit(True)), "k", "left").join(faults, "k", "left").select("k", F.lit(None).cast("string").alias("v"), F.lit(None).cast("long").alias("back"), F.lit(None).cast("int").alias("turn"), f.alias("fault"))
    return turns.select("k", "v", "back", "turn", F.lit(None).cast("string").alias("fault")).unionByName(faults)


def walks(rows: DataFrame, key: str, node: str, parent: str, seq: str, turn: str, max_local: int = MAX_LOCAL) -> DataFrame:
    """k, v, back, turn, fault: the turns on each group's walk (back: links from its end), and one row per group with
    v null that bears its fault: broken, empty, no_reply or null.

    The walk goes from the row with the greatest seq (null is the least, ties go to the greatest node) by parent to a
    row without parent. turn: 1 for a user turn, 2 for an assistant turn, 0 for any other row. Rows with a null key
    or node are left out; of repeated rows of a node one counts. An empty table gives an empty result.
    """
    clean = df_rows(rows, key, node, parent, seq, turn)
    small, large = split_by_size(clean, max_local)
    out = gathered(small, "k", "seq", "v").mapInArrow(_local, _DDL)
    return out if large is None else out.unionByName(_doubled(large))


def df_rows(rows: DataFrame, key: str, node: str, parent: str, seq: str, turn: str) -> DataFrame:
    """k, v, p, seq, turn of the rows, one for each node, checkpointed."""
    r = rows.select(F.col(key).cast("string").alias("k"), F.col(node).cast("string").alias("v"), F.col(parent).cast("string").alias("p"), F.col(seq).cast("long").alias("seq"), F.coalesce(F.col(turn).cast("int"), F.lit(0)).alias("turn"))
    top = F.max(F.struct(F.coalesce("seq", F.lit(-(2**62))).alias("s"), "p", "seq", "turn")).alias("o")
    return checkpointed(r.filter("k IS NOT NULL AND v IS NOT NULL").groupBy("k", "v").agg(top).select("k", "v", "o.p", "o.seq", "o.turn"))
