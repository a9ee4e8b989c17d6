"""Parent-child rows to full hierarchies: root, depth, path and descendants of each node, circles and dead links.

Groups of up to ``max_local`` nodes are contracted whole inside a task (many small groups share one). Larger groups,
of whatever size, are contracted by DataFrame rounds of leaf raking and unary-chain compression until what remains
is small enough for a task; the recorded rounds are then undone in reverse. Neither way holds more than ``max_local``
nodes of a group in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import gathered, group_starts, whole_groups
from ..functions.contraction import FREE, contract
from ..functions.joins import salted_join
from ..session import checkpointed

#: Nodes of one group that a task may hold (about 100 bytes each).
MAX_LOCAL = 300_000
STATES = pa.array(["free", "cycle", "to_cycle"])
SCHEMA = "k string, v string, p string, dead boolean, root string, depth long, state string"


def parent_rows(t: pa.Table) -> np.ndarray:
    """The row of the parent p of each row among the rows of its group k: -1 without parent, -2 where it isn't there."""
    n = t.num_rows
    gid = np.zeros(n, np.int64)
    gid[group_starts(t, ["k"])] = 1
    gid = np.cumsum(gid) - 1
    v = t.column("v").combine_chunks()
    names = v.dictionary_encode()
    vc = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    p = t.column("p").combine_chunks()
    pc_ = pc.index_in(p, value_set=names.dictionary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    width = len(names.dictionary) + 1
    own, want = gid * width + vc, gid * width + pc_
    order = np.argsort(own, kind="stable")
    at = np.clip(np.searchsorted(own[order], want), 0, max(n - 1, 0))
    row = order[at] if n else at
    found = (pc_ >= 0) & (own[row] == want) if n else np.zeros(0, bool)
    null = p.is_null().to_numpy(zero_copy_only=False)
    return np.where(null, -1, np.where(found, row, -2))


def _solve(t: pa.Table) -> pa.Table:
    par = parent_rows(t)
    w = t.column("w").to_numpy().astype(np.int64) if "w" in t.column_names else None
    c = contract(np.where(par >= 0, par, -1), w)
    v = t.column("v").combine_chunks()
    return pa.table(
        {
            "k": t.column("k"),
            "v": v,
            "p": t.column("p"),
            "dead": pa.array(par == -2),
            "root": v.take(pa.array(c.root)),
            "depth": pa.array(c.depth, mask=c.state != FREE),
            "state": STATES.take(pa.array(c.state)),
        }
    )


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in whole_groups(batches, ["k"]):
        yield from _solve(t).to_batches(max_chunksize=20_000)


def _coin(column: str, turn: int) -> F.Column:
    return F.pmod(F.xxhash64(F.col("k"), F.col(column), F.lit(turn)), F.lit(2)) == 1


def _rounds(nodes: DataFrame, max_local: int) -> DataFrame:
    """The same columns as _solve for groups of any size."""
    names = nodes.select("k", F.col("v").alias("p"), F.lit(True).alias("there"))
    linked = checkpointed(
        nodes.join(names, ["k", "p"], "left").select(
            "k", "v", "p", (F.col("p").isNotNull() & F.col("there").isNull()).alias("dead"), F.lit(1).cast("long").alias("w")
        )
    )
    alive = linked.filter(F.col("p").isNotNull() & ~F.col("dead")).select("k", "v", "p", "w")
    log: list[tuple[DataFrame, bool]] = []
    cores: list[DataFrame] = []  # what compression has made its own parent: one node of each circle
    turn = 0
    while True:
        own = alive.filter("v = p").select("k", "v")
        if not own.isEmpty():
            cores.append(own)
            alive = alive.filter("v <> p")
        if alive.count() <= max_local:
            break
        turn += 1
        used = alive.groupBy("k", F.col("p").alias("v")).agg(F.count("*").alias("n"), F.min("v").alias("child"))
        seen = checkpointed(alive.join(used, ["k", "v"], "left"))
        leaf = F.col("n").isNull()
        log.append((seen.filter(leaf).select("k", "v", "p", "w"), False))
        alive = seen.filter(~leaf).select("k", "v", "p", "w")
        used = alive.groupBy("k", F.col("p").alias("v")).agg(F.count("*").alias("n"), F.min("v").alias("child"))
        pick = (F.col("n") == 1) & _coin("v", turn) & ~_coin("p", turn)
        seen = checkpointed(alive.join(used, ["k", "v"], "left").withColumn("out", F.coalesce(pick, F.lit(False))))
        out = seen.filter("out").select("k", "v", "p", "w", "child")
        log.append((out, True))
        over = out.select("k", F.col("v").alias("p"), F.col("p").alias("np"), F.col("w").alias("nw"))
        alive = checkpointed(
            seen.filter("NOT out")
            .join(over, ["k", "p"], "left")
            .select("k", "v", F.coalesce("np", "p").alias("p"), (F.col("w") + F.coalesce("nw", F.lit(0))).alias("w"))
        )
    tops = linked.filter(F.col("p").isNull() | F.col("dead")).select("k", "v")
    ends = tops.withColumn("p", F.lit(None).cast("string"))
    for own in cores:
        ends = ends.unionByName(own.withColumn("p", F.col("v")))
    ends = checkpointed(ends)
    met = alive.select("k", F.col("p").alias("v")).distinct()
    rest = alive.unionByName(ends.join(met, ["k", "v"], "left_semi").withColumn("w", F.lit(0).cast("long")))
    solved = rest.coalesce(1).sortWithinPartitions("k").mapInArrow(_local, SCHEMA).select("k", "v", "root", "depth", "state")
    circle = F.col("p").isNotNull()
    other = ends.join(met, ["k", "v"], "left_anti").select("k", "v", F.col("v").alias("root"), F.when(~circle, F.lit(0).cast("long")).alias("depth"), F.when(circle, "cycle").otherwise("free").alias("state"))
    done = checkpointed(solved.unionByName(other))
    for part, chain in reversed(log):
        up = done.select("k", F.col("v").alias("p"), F.col("root"), F.col("depth").alias("pd"), F.col("state").alias("ps"))
        got = part.join(up, ["k", "p"])
        state = F.when(F.col("ps") == "free", "free").otherwise("to_cycle")
        if chain:
            got = got.join(done.select("k", F.col("v").alias("child"), F.col("state").alias("cs")), ["k", "child"])
            state = F.when(F.col("cs") == "cycle", "cycle").otherwise(state)
        got = got.select("k", "v", "root", (F.col("pd") + F.col("w")).alias("depth"), state.alias("state"))
        done = checkpointed(done.unionByName(got.withColumn("depth", F.when(F.col("state") == "free", F.col("depth")))))
    low = done.filter("state = 'cycle'").groupBy("k", "root").agg(F.min("v").alias("low"))
    done = done.join(low, ["k", "root"], "left").withColumn("root", F.coalesce("low", "root")).drop("low")
    return linked.select("k", "v", "p", "dead").join(done, ["k", "v"]).select("k", "v", "p", "dead", "root", "depth", "state")


def split_by_size(nodes: DataFrame, max_local: int) -> tuple[DataFrame, DataFrame | None]:
    """nodes (with k) of groups of at most max_local rows, and those of larger ones, None if there are none.

    The names of the larger groups are few by definition (at most rows / max_local), so they are broadcast.
    """
    big = nodes.groupBy("k").count().filter(F.col("count") > max_local).select("k")
    big = checkpointed(big)
    if big.isEmpty():
        return nodes, None
    big = F.broadcast(big)
    return nodes.join(big, "k", "left_anti"), nodes.join(big, "k", "left_semi")


def hierarchy(df: DataFrame, node: str, parent: str, key: str | None = None, max_local: int = MAX_LOCAL) -> DataFrame:
    """Root, depth and link state of every node.

    df: one row per (key, node); key None makes all rows one forest. Result: k, v (the node), p (its parent), dead
    (the node names a parent that isn't there), root, depth (links to the root), state (free, cycle, to_cycle).
    A node below a dead link has the node with the dead link as root. Nodes on or below a circle have the circle's
    smallest node as root and a null depth. A node that names itself is a circle. Rows with a null key or node are
    no nodes and are left out; of repeated rows of a node the one with the greatest parent counts. Other columns
    are not carried along. An empty table gives an empty result.
    """
    k = F.col(key).cast("string") if key else F.lit("")
    nodes = df.select(k.alias("k"), F.col(node).cast("string").alias("v"), F.col(parent).cast("string").alias("p"))
    nodes = nodes.filter("k IS NOT NULL AND v IS NOT NULL").groupBy("k", "v").agg(F.max("p").alias("p"))
    nodes = checkpointed(nodes)
    small, large = split_by_size(nodes, max_local)
    out = gathered(small, "k").mapInArrow(_local, SCHEMA)
    return out if large is None else out.unionByName(_rounds(large, max_local))


def link_states(h: DataFrame) -> DataFrame:
    """Of a hierarchy, the nodes on a circle, those that run into one, and those that name a missing parent."""
    state = F.when(F.col("state") != "free", F.col("state")).when(F.col("dead"), F.lit("dangling"))
    return h.select("k", "v", state.alias("link_state")).filter("link_state IS NOT NULL")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in whole_groups(batches, ["k"], 50_000):
        par = parent_rows(t)
        c = contract(np.where(par >= 0, par, -1))
        at = np.flatnonzero(c.state == FREE)
        up, far = at.copy(), 0
        k, v = t.column("k").combine_chunks(), t.column("v").combine_chunks()
        while len(at):
            for s in range(0, len(at), 50_000):
                a, u = pa.array(at[s : s + 50_000]), pa.array(up[s : s + 50_000])
                yield pa.record_batch({"k": k.take(a), "v": v.take(a), "ancestor": v.take(u), "distance": pa.array(np.full(len(a), far, np.int64))})
            keep = par[up] >= 0
            at, up, far = at[keep], par[up[keep]], far + 1


def ancestors(df: DataFrame, node: str, parent: str, key: str | None = None, max_local: int = MAX_LOCAL) -> DataFrame:
    """k, v, ancestor, distance for each node and each node above it, itself at distance 0.

    Read by v it gives paths, read by ancestor all descendants. Nodes on or below a circle have no finite path and
    no rows. Larger groups double the reach of their links each round.
    """
    h = hierarchy(df, node, parent, key, max_local).filter("state = 'free'").select("k", "v", F.when(~F.col("dead"), F.col("p")).alias("p"))
    h = checkpointed(h)
    small, large = split_by_size(h, max_local)
    out = gathered(small, "k").mapInArrow(_pairs, "k string, v string, ancestor string, distance long")
    if large is None:
        return out
    own = large.select("k", "v", F.col("v").alias("ancestor"), F.lit(0).cast("long").alias("distance"))
    jump = large.filter("p IS NOT NULL").select("k", "v", "p")
    reach = 1
    while not jump.isEmpty():
        far = own.select("k", F.col("v").alias("p"), "ancestor", (F.col("distance") + reach).alias("distance"))
        own = checkpointed(own.unionByName(jump.join(far, ["k", "p"]).select("k", "v", "ancestor", "distance")))
        on = jump.select("k", F.col("v").alias("p"), F.col("p").alias("q"))
        jump = checkpointed(jump.join(on, ["k", "p"]).select("k", "v", F.col("q").alias("p")))
        reach *= 2
    return out.unionByName(own)


def paths(pairs: DataFrame) -> DataFrame:
    """k, v, path (names from root to node, joined by /), depth out of ancestors()."""
    up = F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("o"), "ancestor")))
    return pairs.groupBy("k", "v").agg(F.array_join(F.transform(up, lambda x: x.ancestor), "/").alias("path"), F.max("distance").alias("depth"))


_SPAN = "k string, v string, root string, pre long, last long"


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in whole_groups(batches, ["k"], 50_000):
        par = parent_rows(t)
        c = contract(np.where(par >= 0, par, -1))
        v = t.column("v").combine_chunks()
        n = t.num_rows
        name = np.empty(n, np.int64)
        name[np.asarray(pc.sort_indices(v))] = np.arange(n)
        size, pre = np.ones(n, np.int64), np.zeros(n, np.int64)
        free = np.flatnonzero(c.state == FREE)
        by_depth = free[np.argsort(c.depth[free], kind="stable")]
        borders = np.searchsorted(c.depth[by_depth], np.arange(1, int(c.depth[by_depth].max(initial=0)) + 2))
        levels = [by_depth[a:b] for a, b in zip(borders[:-1], borders[1:])]
        for level in reversed(levels):
            np.add.at(size, par[level], size[level])
        for level in levels:
            level = level[np.lexsort((name[level], par[level]))]
            before = np.cumsum(size[level]) - size[level]
            first = np.flatnonzero(np.append(True, par[level][1:] != par[level][:-1]))
            before -= np.repeat(before[first], np.diff(np.append(first, len(level))))
            pre[level] = pre[par[level]] + 1 + before
        at = pa.array(free)
        out = pa.table({"k": t.column("k").combine_chunks().take(at), "v": v.take(at), "root": v.take(pa.array(c.root[free])), "pre": pa.array(pre[free]), "last": pa.array((pre + size - 1)[free])})
        yield from out.to_batches(max_chunksize=50_000)


def _in_line(kids: DataFrame) -> DataFrame:
    """k, v, p, beside (the next child of the parent by name), first (whether there is none before). The children of
    one parent may take any number of tasks."""
    order = ["k", "p", "v"]
    here = checkpointed(kids.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    ends = here.groupBy("part").agg(F.min(F.struct(*order)).alias("head"), F.max(F.struct(*order)).alias("tail"))  # one row a task
    over = Window.orderBy("part")
    ends = ends.select("part", F.lead("head").over(over).alias("head"), F.lag("tail").over(over).alias("tail"))
    within = Window.partitionBy("part").orderBy(*order)
    e = here.withColumns({"after": F.lead(F.struct(*order)).over(within), "before": F.lag(F.struct(*order)).over(within)}).join(ends, "part")
    after, before = F.coalesce("after", "head"), F.coalesce("before", "tail")
    of = lambda x: (x["k"] == F.col("k")) & (x["p"] == F.col("p"))
    return e.select(*order, F.when(of(after), after["v"]).alias("beside"), (~F.coalesce(of(before), F.lit(False))).alias("first"))


def _toured(nodes: DataFrame) -> DataFrame:
    """The same as _spans for trees (k, v, p, root) of any size: each node's place on a walk around its tree, by
    doubling the reach of the walk's steps."""
    up = F.col("p").isNotNull()
    kids = checkpointed(_in_line(nodes.filter(up)))
    first = kids.filter("first").select("k", F.col("p").alias("v"), F.col("v").alias("child"))
    n = nodes.join(kids.select("k", "v", "beside"), ["k", "v"], "left").join(first, ["k", "v"], "left")
    down = n.select("k", F.concat(F.lit("d"), "v").alias("a"), F.concat(F.when(F.col("child").isNotNull(), "d").otherwise("u"), F.coalesce("child", "v")).alias("b"), F.lit(1).cast("long").alias("w"))
    over = n.select("k", F.concat(F.lit("u"), "v").alias("a"), F.when(F.col("beside").isNotNull(), F.concat(F.lit("d"), "beside")).when(up, F.concat(F.lit("u"), "p")).alias("b"), F.lit(0).cast("long").alias("w"))
    walk = checkpointed(down.unionByName(over))  # w: nodes entered on the way from a to just before b
    while not walk.filter("b IS NOT NULL").isEmpty():
        ahead = walk.select("k", F.col("a").alias("b"), F.col("b").alias("c"), F.col("w").alias("more"))
        walk = checkpointed(walk.join(ahead, ["k", "b"], "left").select("k", "a", F.col("c").alias("b"), (F.col("w") + F.coalesce("more", F.lit(0))).alias("w")))
    left = walk.select("k", F.substring("a", 2, 1 << 30).alias("v"), F.substring("a", 1, 1).alias("side"), "w").groupBy("k", "v").agg(F.max(F.when(F.col("side") == "d", F.col("w"))).alias("d"), F.max(F.when(F.col("side") == "u", F.col("w"))).alias("u"))
    done = checkpointed(nodes.join(left, ["k", "v"]))  # d: nodes from v to the walk's end; u: those after v's descendants
    total = done.filter(F.col("v") == F.col("root")).select("k", "root", F.col("d").alias("all"))
    done = salted_join(done, total, ["k", "root"], ["v"])
    return done.select("k", "v", "root", (F.col("all") - F.col("d")).alias("pre"), (F.col("all") - F.col("u") - 1).alias("last"))


def spans(df: DataFrame, node: str, parent: str, key: str | None = None, max_local: int = MAX_LOCAL) -> DataFrame:
    """k, v, root, pre, last: each node's place in its tree, parents before children and these by name, and the place of
    its last descendant. All descendants of a node are the nodes of its root whose pre is above its own and not above
    its last, so one row a node gives them all. Nodes on or below a circle have none and no rows."""
    h = hierarchy(df, node, parent, key, max_local).filter("state = 'free'").select("k", "v", F.when(~F.col("dead"), F.col("p")).alias("p"), "root")
    h = checkpointed(h)
    small, large = split_by_size(h, max_local)
    out = gathered(small.select("k", "v", "p"), "k").mapInArrow(_spans, _SPAN)
    return out if large is None else out.unionByName(_toured(large))


def descendants_of(found: DataFrame, targets: DataFrame) -> DataFrame:
    """k, v, descendant of the nodes (k, v) in targets, out of spans()."""
    own = found.join(targets.select("k", "v").distinct(), ["k", "v"]).select("k", "root", "v", F.col("pre").alias("__from"), "last")
    below = found.select("k", "root", F.col("v").alias("descendant"), "pre")
    return below.join(own, ["k", "root"]).filter("pre > __from AND pre <= last").select("k", "v", "descendant")
