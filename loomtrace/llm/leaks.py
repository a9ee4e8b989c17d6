"""Evaluation texts that leak into a corpus, by latent semantic retrieval.

Fit: one pass over all documents counts in how many each hashed word occurs and applies the Gram matrix of all
passages to a random test matrix; weights and a randomised (Nystroem) decomposition of a bounded size follow on the
driver. The result maps each word to a vector in the latent space of TF-IDF passages.

Search: windows of the documents and of the items become unit vectors there. Both searches find every pair with at
least a cosine without comparing all. For equal windows a grid serves: two unit vectors of a cosine of at least c
differ by sqrt(2 - 2c) at most in every coordinate. For reshaped ones, passages are gathered in balls: where a window
is farther from a ball's centre than the ball's radius and the cosine's angle together, none of its passages is near.
Candidates are then checked word by word.

For verbatim runs windows are laid so that nothing escapes: of n consecutive equal words, some window of w words at a
multiple of n - w + 1 in the document equals the window of the item at the same words, and so has a cosine of 1 with it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch
from .rolling import gathered, words

#: Hashed words (features), columns of the test matrix, dimensions kept, words of a passage when fitting.
FEATURES, COLUMNS, DIMENSIONS, PASSAGE = 1 << 14, 24, 16, 32
#: The same for reshaped passages, whose windows must be told apart at a lower cosine.
WIDE_COLUMNS, WIDE_DIMENSIONS = 64, 48
#: Cosine that equal windows surely reach in single precision, and coordinates that span the grid.
EQUAL, GRID = 0.9995, 12
#: Items that are searched in one pass over the documents; more items take more passes.
BLOCK_ITEMS = 20_000
_BATCH = 2_000_000
_ROWS = 1_024
#: Hashed words by which most candidates are told apart from a passage before the longest common subsequence is sought.
_MARKS = 1_024
#: Words and candidates that a search for reshaped passages works on at once, and candidates of a search in a grid.
_WORDS, _CANDIDATES, _FILED = 32_768, 2_048, 500_000


@lru_cache(maxsize=2)
def _test_matrix(seed: int, columns: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((FEATURES, columns)).astype(np.float32)


def _features(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(40)).astype(np.int64) % FEATURES


@dataclass(frozen=True)
class Space:
    """vectors: for each feature, its weighted vector in the latent space."""

    vectors: np.ndarray
    documents: int

    def embed(self, h: np.ndarray, starts: np.ndarray, width: int | np.ndarray) -> np.ndarray:
        """Unit vectors of the windows of width words at starts; NaN where a window has no direction. A width of its
        own for each start is allowed."""
        v = np.zeros((len(starts), self.vectors.shape[1]), np.float32)
        f = _features(h)
        width = np.broadcast_to(np.asarray(width, np.int64), np.shape(starts))
        least = int(width.min(initial=np.max(width, initial=0)))
        for i in range(least):
            v += self.vectors[f[starts + i]]
        for i in range(least, int(np.max(width, initial=0))):
            more = np.flatnonzero(width > i)
            v[more] += self.vectors[f[starts[more] + i]]
        with np.errstate(invalid="ignore", divide="ignore"):
            return v / np.linalg.norm(v, axis=1, keepdims=True)


def fit(docs: DataFrame, columns: int = COLUMNS, dimensions: int = DIMENSIONS, seed: int = 5) -> Space:
    """The latent space of the passages of all rows of docs (text); null texts hold no words. columns: of the test
    matrix; dimensions: kept of what they span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES, columns + 1))
        count = 0
        r = _test_matrix(seed, columns)
        for b in gathered(batches, _BATCH):
            h, at = words(b.column("text").to_pylist())
            count += b.num_rows
            if not len(h):
                continue
            f = _features(h)
            doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
            total[:, columns] += np.bincount(np.unique(doc * FEATURES + f) % FEATURES, minlength=FEATURES)
            place = np.arange(len(h)) - at[doc]
            new = np.flatnonzero(place % PASSAGE == 0)
            y = np.add.reduceat(r[f], new, axis=0)
            of = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(h))))
            for c in range(columns):
                total[:, c] += np.bincount(f, weights=y[of, c], minlength=FEATURES)
        for k in range(0, FEATURES, _ROWS):
            yield pa.record_batch({"part": pa.array([k], pa.int32()), "n": pa.array([count], pa.int64()), "sums": pa.array([total[k : k + _ROWS].tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            for k, n, s in zip(*(b.column(c).to_pylist() for c in ("part", "n", "sums"))):
                own = sums.setdefault(k, [0, np.zeros(_ROWS * (columns + 1))])
                own[0] += n
                own[1] += np.frombuffer(s)
        yield pa.record_batch({"part": pa.array(list(sums), pa.int32()), "n": pa.array([n for n, _ in sums.values()], pa.int64()), "sums": pa.array([x.tobytes() for _, x in sums.values()], pa.binary())})

    ddl = "part int, n long, sums binary"
    texts = docs.select("text").filter("text IS NOT NULL")
    rows = texts.mapInArrow(run, ddl).repartition(FEATURES // _ROWS, "part").mapInArrow(add, ddl).collect()  # FEATURES rows, whatever the corpus
    total = np.zeros((FEATURES, columns + 1))
    for row in rows:
        total[row["part"] : row["part"] + _ROWS] = np.frombuffer(row["sums"]).reshape(_ROWS, -1)
    n = max((row["n"] for row in rows), default=0)
    idf = np.log((1 + n) / (1 + total[:, columns])) + 0.1
    sketch = total[:, :columns]
    inner = _test_matrix(seed, columns).astype(np.float64).T @ sketch
    values, basis = np.linalg.eigh((inner + inner.T) / 2)
    good = values > max(values.max(initial=0.0), 0.0) * 1e-9
    if not good.any():
        return Space(_test_matrix(seed, columns)[:, :dimensions].copy(), n)
    left, _, _ = np.linalg.svd((idf[:, None] * sketch) @ (basis[:, good] / np.sqrt(values[good])), full_matrices=False)
    v = left[:, :dimensions] * idf[:, None]
    return Space((v / np.abs(v).max()).astype(np.float32), n)


@dataclass(frozen=True)
class Items:
    """Windows of items: unit vectors, item and place of each, and the words of all items."""

    ids: np.ndarray
    h: np.ndarray
    at: np.ndarray
    item: np.ndarray
    place: np.ndarray
    vectors: np.ndarray


def _items(space: Space, ids: list[int], texts: list[str], width: int) -> Items:
    h, at = words(texts)
    n = np.diff(at)
    item = [np.full(max(0, k - width + 1), i) for i, k in enumerate(n)]
    place = [np.arange(max(0, k - width + 1)) for k in n]
    item, place = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (item, place))
    return Items(np.array(ids, np.int64), h, at, item, place, space.embed(h, at[item] + place, width))


class Grid:
    """Unit vectors filed so that all within a cosine of another vector are found in that vector's cell. A vector is
    filed in the cells beside its own only where it lies near their border."""

    def __init__(self, vectors: np.ndarray, cosine: float) -> None:
        self.vectors, self.cosine = vectors, cosine
        far = float(np.sqrt(2 - 2 * cosine)) + 1e-6
        self.cell = 8 * far
        self.lost = np.flatnonzero(np.isnan(vectors).any(axis=1))  # without direction: they meet all of their kind
        which = np.flatnonzero(~np.isnan(vectors).any(axis=1))
        codes = np.zeros(len(which), np.uint64)
        for k in range(min(GRID, vectors.shape[1])):
            x = vectors[which, k]
            low, own, high = (np.floor((x + d) / self.cell).astype(np.int64) for d in (-far, 0, far))
            parts = [(slice(None), own), (low != own, low[low != own]), (high != own, high[high != own])]
            codes = np.concatenate([self._step(codes[at], c) for at, c in parts])
            which = np.concatenate([which[at] for at, _ in parts])
        o = np.argsort(codes, kind="stable")
        self.codes, self.which = codes[o], which[o]

    @staticmethod
    def _step(code: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """The code with one more coordinate; cells that share a code by chance only give more candidates."""
        return (code ^ (cell + 50_000).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(1)

    def pairs(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of v, row of the filed vectors) of every pair with at least the cosine."""
        none = np.isnan(v).any(axis=1)
        code = np.zeros(len(v), np.uint64)
        for k in range(min(GRID, v.shape[1])):
            code = self._step(code, np.floor(np.where(none, 0, v[:, k]) / self.cell).astype(np.int64))
        lo, hi = np.searchsorted(self.codes, code), np.searchsorted(self.codes, code, side="right")
        n = np.where(none, 0, hi - lo)
        end = np.cumsum(n)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        at = 0
        while at < len(v):
            to = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + _FILED, side="right")))
            m = n[at:to]
            a = np.repeat(np.arange(at, to), m)
            b = self.which[np.repeat(lo[at:to], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
            near = np.einsum("ij,ij->i", v[a], self.vectors[b]) >= self.cosine
            found.append((a[near], b[near]))
            at = to
        a, b = (np.concatenate(x) for x in zip(*found))
        if none.any() and len(self.lost):
            a = np.concatenate([a, np.repeat(np.flatnonzero(none), len(self.lost))])
            b = np.concatenate([b, np.tile(self.lost, int(none.sum()))])
        return a, b


class Balls:
    """Unit vectors gathered around centres, so that all within a cosine of another vector are found in the balls that
    are near it. Vectors without direction are near nothing."""

    def __init__(self, vectors: np.ndarray, cosine: float, seed: int = 3) -> None:
        self.cosine, self.angle = cosine, float(np.arccos(cosine)) + 1e-4
        good = np.flatnonzero(~np.isnan(vectors).any(axis=1))
        v = vectors[good]
        k = max(1, int(np.sqrt(len(good)))) if len(good) else 0
        self.centres = v[np.random.default_rng(seed).permutation(len(good))[:k]].copy()
        for _ in range(4):
            nearest = self._nearest(v)
            for c in range(k):
                total = v[nearest == c].sum(axis=0)
                if np.linalg.norm(total) > 0:
                    self.centres[c] = total / np.linalg.norm(total)
        nearest = self._nearest(v)
        self.members = [good[nearest == c] for c in range(k)]
        self.vectors = [v[nearest == c] for c in range(k)]
        self.reach = np.array([self.angle + (float(np.arccos(np.clip((x @ c).min(), -1, 1))) if len(x) else -9.0) for x, c in zip(self.vectors, self.centres)])

    def _nearest(self, v: np.ndarray) -> np.ndarray:
        return np.concatenate([np.argmax(v[i : i + 4096] @ self.centres.T, axis=1) for i in range(0, len(v), 4096)]) if len(v) else np.zeros(0, np.int64)

    def pairs(self, v: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row of v, row of the gathered vectors, cosine) of every pair with at least the cosine, in parts of a
        bounded size."""
        if not len(self.centres):
            return
        rows = np.flatnonzero(~np.isnan(v).any(axis=1))
        away = np.arccos(np.clip(v[rows] @ self.centres.T, -1, 1))
        for c, near in enumerate((away <= self.reach).T):
            own = rows[near]
            for i in range(0, len(own), 4096):
                for j in range(0, len(self.members[c]), 4096):
                    cos = v[own[i : i + 4096]] @ self.vectors[c][j : j + 4096].T
                    a, b = np.nonzero(cos >= self.cosine)
                    yield own[i + a], self.members[c][j + b], cos[a, b]


def longest_common_subsequence(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Its length for each row of two integer matrices; negative entries match nothing."""
    row = np.zeros((len(x), y.shape[1] + 1), np.int32)
    for i in range(x.shape[1]):
        before = row.copy()
        same = (y == x[:, i : i + 1]) & (x[:, i : i + 1] >= 0)
        step = np.where(same, before[:, :-1] + 1, before[:, 1:])
        row[:, 1:] = np.maximum.accumulate(step, axis=1)
    return row[:, -1]


def _run_of(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, a: np.ndarray, item: np.ndarray, ilo: np.ndarray, ihi: np.ndarray, b: np.ndarray, length: int, width: int) -> np.ndarray:
    """Whether a run of length equal words lies around the windows at a and b of the same words, within [lo, hi) of the
    document and [ilo, ihi) of the item."""
    best, run = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    for k in range(width - length, length):
        p, q = a + k, b + k
        inside = (p >= lo) & (p < hi) & (q >= ilo) & (q < ihi)
        same = inside & (doc[np.where(inside, p, 0)] == item[np.where(inside, q, 0)])
        run = np.where(same, run + 1, 0)
        best = np.maximum(best, run)
    return best >= length


def _blocks(items: DataFrame) -> Iterator[list]:
    """The items in blocks of a bounded size; rows without id or passage hold nothing to find."""
    rows: list = []
    for r in items.filter("item_id IS NOT NULL AND passage IS NOT NULL").select("item_id", "passage", "answer").distinct().toLocalIterator():
        rows.append(r)
        if len(rows) == BLOCK_ITEMS:
            yield rows
            rows = []
    if rows:
        yield rows


def _over_blocks(docs: DataFrame, items: DataFrame, search: Callable[[list], DataFrame], ddl: str) -> DataFrame:
    """What search finds for the items, block by block. Each block but the last is searched and written before the next
    one comes to the driver, so that only one is held at a time."""
    spark = docs.sparkSession
    parts: list[DataFrame] = []
    held = None
    for block in _blocks(items):
        if held is not None:
            folder = scratch(spark, "leaks")
            held.write.parquet(folder)
            parts.append(spark.read.schema(ddl).parquet(folder))
        held = search(block)
    if held is None:
        return spark.createDataFrame([], ddl)
    for p in parts:
        held = held.unionByName(p)
    return held


def leaked_runs(docs: DataFrame, items: DataFrame, length: int = 12, space: Space | None = None) -> DataFrame:
    """doc_id, item_id: the document (doc_id, text) holds at least length consecutive words of the item's passage
    (item_id, passage, answer), in order and with no other word between.

    Every such pair is found, once. Null texts and passages, and passages of fewer words, have no rows; rows of the
    same id count together; other columns are left out; empty tables give an empty result.
    """
    space = space or fit(docs)
    width = max(1, length // 2)
    step = length - width + 1
    texts = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")

    def search(block: list) -> DataFrame:
        q = _items(space, [r.item_id for r in block], [r.passage for r in block], width)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grid = Grid(q.vectors, EQUAL)
            for b in gathered(batches, _BATCH):
                h, at = words(b.column("text").to_pylist())
                n = np.diff(at)
                count = np.maximum(0, (n - width) // step + 1) * (n >= length)
                doc = np.repeat(np.arange(len(n)), count)
                start = at[doc] + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * step
                a, w = grid.pairs(space.embed(h, start, width))
                d, i = doc[a], q.item[w]
                hit = _run_of(h, at[d], at[d + 1], start[a], q.h, q.at[i], q.at[i + 1], q.at[i] + q.place[w], length, width)
                found = np.unique(np.stack([d[hit], i[hit]], axis=1), axis=0) if hit.any() else np.zeros((0, 2), np.int64)
                yield pa.record_batch({"doc_id": b.column("doc_id").take(pa.array(found[:, 0])), "item_id": pa.array(q.ids[found[:, 1]])})

        return texts.mapInArrow(run, "doc_id long, item_id long")

    return _over_blocks(docs, items, search, "doc_id long, item_id long").distinct()


@dataclass(frozen=True)
class Passages:
    """Whole passages: words, borders, words of the answers, and by width of the windows they are looked for with, the
    passages and their vectors in balls."""

    ids: np.ndarray
    h: np.ndarray
    at: np.ndarray
    answers: list[np.ndarray]
    by_width: dict[int, tuple[np.ndarray, Balls]]


def _passages(space: Space, block: list, cosine: float) -> Passages:
    h, at = words([r.passage for r in block])
    size = np.diff(at)
    width = np.maximum(4, (size * 7 // 8) // 4 * 4)
    by = {}
    for w in np.unique(width[size > 0]):
        own = np.flatnonzero((width == w) & (size > 0))
        by[int(w)] = (own, Balls(space.embed(h, at[own], size[own]), cosine))
    return Passages(np.array([r.item_id for r in block], np.int64), h, at, [words([r.answer or ""])[0] for r in block], by)


def _window_starts(at: np.ndarray, width: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, first word) of the windows of each document: one every step words and one that ends with it; a
    document of fewer words is one window."""
    n = np.diff(at)
    last = np.maximum(0, n - width)
    count = (-(-last // step) + 1) * (n > 0)
    doc = np.repeat(np.arange(len(n)), count)
    place = (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * step
    return doc, at[doc] + np.minimum(place, last[doc])


def _embedded(space: Space, h: np.ndarray, start: np.ndarray, width: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Unit vectors of windows with ascending starts, in parts: (place of the part's first window, vectors). Running
    sums give each window in one step, however wide."""
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(start, start[lo] + _WORDS)))
        base, end = start[lo], int((start[lo:hi] + width[lo:hi]).max())
        total = np.zeros((end - base + 1, space.vectors.shape[1]))
        np.cumsum(space.vectors[_features(h[base:end])], axis=0, out=total[1:])
        v = total[start[lo:hi] - base + width[lo:hi]] - total[start[lo:hi] - base]
        with np.errstate(invalid="ignore", divide="ignore"):
            yield lo, (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
        lo = hi


def paraphrases(docs: DataFrame, items: DataFrame, cosine: float = 0.5, share: float = 0.7, loose: tuple[float, float] = (0.8, 0.4), space: Space | None = None) -> DataFrame:
    """doc_id, item_id, cosine, lcs_share, word_share, holds_answer of documents that hold a passage whole, in part or
    reshaped.

    Each window of a document a little shorter than the passage (at every quarter of its length, and one that ends with
    the document; a shorter document is one window) is compared in the latent space. Of those with at least the cosine,
    these count: the longest common subsequence with the passage covers at least the share of the passage's words; or
    the words around the window cover loose[0] of them and the subsequence loose[1], as where parts have changed places.
    One row per pair, with its best window (by lcs_share, then word_share, then cosine). holds_answer: the words of the
    answer stand in the document one after another. Handling of nulls and repetitions as in leaked_runs.
    """
    space = space or fit(docs, WIDE_COLUMNS, WIDE_DIMENSIONS)
    texts = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    ddl = "doc_id long, item_id long, cosine double, lcs_share double, word_share double, holds_answer boolean"

    def search(block: list) -> DataFrame:
        q = _passages(space, block, cosine)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in gathered(batches, _BATCH):
                h, at = words(b.column("text").to_pylist())
                best: dict[tuple[int, int], tuple[float, float, float]] = {}
                for width, (own, balls) in q.by_width.items():
                    doc, start = _window_starts(at, width, width // 4)
                    marks = _marked(q, own)
                    for lo, v in _embedded(space, h, start, np.minimum(np.diff(at), width)[doc]):
                        for a, k, cos in balls.pairs(v):
                            for i in range(0, len(a), _CANDIDATES):
                                part = slice(i, i + _CANDIDATES)
                                _judge(q, h, at, doc[lo + a[part]], start[lo + a[part]], own[k[part]], marks[k[part]], cos[part], width, share, loose, best)
                rows = [(d, i, c, p, w, _holds(h[at[d] : at[d + 1]], q.answers[i])) for (d, i), (p, w, c) in best.items()]
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()]
                d, i, *rest = (pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, kinds))
                ids = [b.column("doc_id").take(d), pa.array(q.ids).take(i)]
                yield pa.record_batch([*ids, *rest], names=["doc_id", "item_id", "cosine", "lcs_share", "word_share", "holds_answer"])

        return texts.mapInArrow(run, ddl)

    found = _over_blocks(docs, items, search, ddl)
    top = F.max(F.struct("lcs_share", "word_share", "cosine", "holds_answer")).alias("o")
    return found.groupBy("doc_id", "item_id").agg(top).select("doc_id", "item_id", "o.cosine", "o.lcs_share", "o.word_share", "o.holds_answer")


def _marked(q: Passages, own: np.ndarray) -> np.ndarray:
    """Which of _MARKS hashed words each passage holds."""
    marks = np.zeros((len(own), _MARKS), bool)
    for j, i in enumerate(own):
        marks[j, (q.h[q.at[i] : q.at[i + 1]] >> np.uint64(1)).astype(np.int64) % _MARKS] = True
    return marks


def _judge(q: Passages, h: np.ndarray, at: np.ndarray, doc: np.ndarray, start: np.ndarray, item: np.ndarray, marks: np.ndarray, cos: np.ndarray, width: int, share: float, loose: tuple[float, float], best: dict[tuple[int, int], tuple[float, float, float]]) -> None:
    """Enter into best the candidates (windows of documents and passages) that hold their passage."""
    size = q.at[item + 1] - q.at[item]
    longest = int(size.max(initial=0))
    x = _matrix(h, at[doc], at[doc + 1], start - width // 2, longest + width)
    enough = (np.take_along_axis(marks, x % _MARKS, axis=1) & (x >= 0)).sum(axis=1) >= min(share, loose[0]) * size  # no subsequence is longer
    if not enough.any():
        return
    x, doc, item, size, cos = x[enough], doc[enough], item[enough], size[enough], cos[enough]
    y = _matrix(q.h, q.at[item], q.at[item + 1], q.at[item], longest)
    common = np.array([np.isin(b, a).sum() for a, b in zip(x, np.where(y >= 0, y, -2))]) / size
    some = common >= min(share, loose[0])
    x, y, doc, item, size, cos, common = x[some], y[some], doc[some], item[some], size[some], cos[some], common[some]
    if not len(doc):
        return
    part = longest_common_subsequence(x, y) / size
    for j in np.flatnonzero((part >= share) | ((common >= loose[0]) & (part >= loose[1]))):
        pair = (int(doc[j]), int(item[j]))
        best[pair] = max(best.get(pair, (0.0, 0.0, 0.0)), (float(part[j]), float(common[j]), float(cos[j])))


def _matrix(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """Words at start.. of each row as integers, -1 outside [lo, hi)."""
    p = start[:, None] + np.arange(width)
    inside = (p >= lo[:, None]) & (p < hi[:, None])
    return np.where(inside, (h[np.where(inside, p, 0)] >> np.uint64(1)).astype(np.int64), -1)


def _holds(doc: np.ndarray, answer: np.ndarray) -> bool:
    if not len(answer) or len(doc) < len(answer):
        return False
    return bool((np.lib.stride_tricks.sliding_window_view(doc, len(answer)) == answer).all(axis=1).any())
