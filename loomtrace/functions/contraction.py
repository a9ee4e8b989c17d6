"""Tree contraction of a parent array: rake leaves, compress unary chains, then undo both in reverse."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

FREE, CYCLE, TO_CYCLE = 0, 1, 2


@dataclass
class Contracted:
    root: np.ndarray  #: the top of each node; the smallest index of the circle for nodes on or below a circle
    depth: np.ndarray  #: links from the node to its top; -1 where a circle is met
    state: np.ndarray  #: FREE, CYCLE or TO_CYCLE


def contract(parent: np.ndarray, weight: np.ndarray | None = None, seed: int = 1) -> Contracted:
    """parent: index of the parent or -1. weight: length of the link to the parent, 1 if not given.

    Each round removes every leaf (rake) and an independent set of nodes with one child (compress). What no round
    can remove are nodes that are their own parent after compression: these were circles.
    """
    n = len(parent)
    par = parent.astype(np.int64).copy()
    w = np.ones(n, np.int64) if weight is None else weight.astype(np.int64).copy()
    alive = np.flatnonzero(par >= 0)
    core: list[np.ndarray] = []
    log: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]] = []  # node, its parent, length, child
    rng = np.random.default_rng(seed)
    while len(alive):
        own = par[alive] == alive
        if own.any():
            core.append(alive[own])
            alive = alive[~own]
            continue
        children = np.bincount(par[alive], minlength=n)
        leaf = children[alive] == 0
        if leaf.any():
            v = alive[leaf]
            log.append((v, par[v], w[v], None))
            alive = alive[~leaf]
            children = np.bincount(par[alive], minlength=n)
        if not len(alive):
            break
        linked = np.zeros(n, bool)
        linked[alive] = True
        coin = rng.integers(0, 2, n).astype(bool)
        only = np.full(n, -1, np.int64)
        only[par[alive]] = alive  # the child, where there is only one
        unary = linked & (children == 1)
        pick = alive[unary[alive] & coin[alive] & ~(unary[par[alive]] & coin[par[alive]])]
        if len(pick):
            child = only[pick]
            log.append((pick, par[pick], w[pick], child))
            w[child] += w[pick]
            par[child] = par[pick]
            gone = np.zeros(n, bool)
            gone[pick] = True
            alive = alive[~gone[alive]]
    root = np.arange(n, dtype=np.int64)
    depth = np.zeros(n, np.int64)
    state = np.zeros(n, np.int8)
    for v in core:
        state[v], depth[v] = CYCLE, -1
    for v, p, length, child in reversed(log):
        root[v] = root[p]
        on = (state[child] == CYCLE) if child is not None else np.zeros(len(v), bool)
        state[v] = np.where(on, CYCLE, np.where(state[p] == FREE, FREE, TO_CYCLE))
        depth[v] = np.where(state[v] == FREE, depth[p] + length, -1)
    bad = state == CYCLE
    if bad.any():  # one name per circle, however its nodes were met
        low = np.full(n, n, np.int64)
        np.minimum.at(low, root[bad], np.flatnonzero(bad))
        stuck = state != FREE
        root[stuck] = low[root[stuck]]
    return Contracted(root, depth, state)
