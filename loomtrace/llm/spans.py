"""Long exact spans shared between documents, by difference-cover anchors.

Windows of w characters are hashed only at places whose residue modulo a period P lies in a perfect difference set.
Any two spans of w + P - 1 or more equal characters, wherever they stand, have an anchor in common. Anchors found in
two documents mark the places around which windows of the full length are hashed (in 120 bits and those that the bucket
tells) and compared; what these cover is what is shared. An anchor only makes a candidate, so 40 bits and those of the
bucket do for it.

Hashes travel in blocks, one a bucket, in which each task has already combined what it saw more than once. Of a passage
in a third of all documents each task sends one entry to the bucket of its hash; that the others are shared it knows
itself, and it sends this to buckets that go by the document. A bucket is a partition, so no two fall together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rolling import gathered, window_hashes

#: Bytes of hashes that come from a byte of table at most.
_BYTES_PER_BYTE = 4
#: Entries that a task gathers before it combines and sends them, and that a bucket gathers before it combines them.
_GATHER = 1_000_000
#: Bits of an anchor's key beside its bucket.
_KEY = 40


@lru_cache(maxsize=8)
def difference_set(q: int) -> tuple[int, ...]:
    """A perfect difference set of q + 1 residues modulo q*q + q + 1, for a prime q (Singer's construction): the
    exponents of a generator of GF(q^3) whose powers have no square term."""
    period = q * q + q + 1
    for c in range(1, q**3):
        a, b, d = c % q, c // q % q, c // (q * q)  # x^3 = a + b x + d x^2
        power, found = (1, 0, 0), set()
        for i in range(period):
            if power[2] == 0:
                found.add(i)
            top = power[2]
            power = (top * a % q, (power[0] + top * b) % q, (power[1] + top * d) % q)
        if len(found) == q + 1 and len({(x - y) % period for x in found for y in found}) == period:
            return tuple(sorted(found))
    raise ValueError(f"{q} is no prime")


def plan(length: int) -> tuple[int, int, tuple[int, ...]]:
    """(window, period, residues) for spans of a length: the largest prime order whose period leaves windows of three
    eighths of the length or more."""
    best = 0
    for q in range(2, 200):
        if all(q % d for d in range(2, int(q**0.5) + 1)) and q * q + q + 1 <= length * 5 // 8:
            best = q
    if not best:
        return length, 1, (0,)
    period = best * best + best + 1
    return length - period + 1, period, difference_set(best)


NEW, KNOWN = 0, 1
#: Columns of entries: hash, second hash (of windows), document, start (of windows), flag.
Entries = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def combine(h: np.ndarray, g: np.ndarray, doc: np.ndarray, start: np.ndarray, flag: np.ndarray, once: bool) -> tuple[Entries, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(entries to keep, hash, document and start of the entries found shared).

    An entry is shared if another document has its hashes, or if they are known to be shared. Of shared hashes one
    entry stays, flagged KNOWN. With once, an entry that a document repeats counts once.
    """
    o = np.lexsort((doc, h)) if once else np.argsort(h, kind="stable")
    same = h[o][1:] == h[o][:-1]
    if (same & (g[o][1:] != g[o][:-1])).any():
        o = np.lexsort((doc, g, h))
    h, g, doc, start, flag = h[o], g[o], doc[o], start[o], flag[o]
    if once and len(h):
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]) | (flag[1:] != flag[:-1])
        h, g, doc, start, flag = h[keep], g[keep], doc[keep], start[keep], flag[keep]
    if not len(h):
        return (h, g, doc, start, flag), (h, doc, start)
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(h)))
    shared = (np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)) | (np.maximum.reduceat(flag, first) > NEW)
    in_shared = np.repeat(shared, size)
    found = in_shared & (flag != KNOWN)
    stay = ~in_shared
    stay[first[shared]] = True
    out_flag = flag.copy()
    out_flag[first[shared]] = KNOWN
    return (h[stay], g[stay], doc[stay], start[stay], out_flag[stay]), (h[found], doc[found], start[found])


def _pack(a: np.ndarray, size: int) -> bytes:
    """The low bytes of integers, byte planes apart, so that equal high bytes compress."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def _unpack(data: bytes, size: int, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8).reshape(size, n).T
    return out.view("<u8").reshape(-1)


#: settled: the block's entries are known to be shared; it only passes through.
_BLOCK_DDL = "bucket int, n int, settled boolean, hashes binary, seconds binary, docs binary, starts binary, flags binary"


def _rows(bucket: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by bucket, document and start (which compresses), and the bucket and borders of each run in it."""
    o = np.lexsort((start, doc, bucket))
    b = bucket[o]
    first = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else np.zeros(0, np.int64)
    return o, [(int(b[s]), int(s), int(e)) for s, e in zip(first, np.append(first[1:], len(b)))]


def keyed(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash in the high bits, above _KEY bits of the rest."""
    n = np.uint64(buckets)
    return (h % n) << np.uint64(_KEY) | (h // n) & np.uint64((1 << _KEY) - 1)


def _block(h: np.ndarray, g: np.ndarray, doc: np.ndarray, start: np.ndarray, buckets: int, once: bool) -> pa.RecordBatch:
    """The entries of a block, combined, as one row for each bucket that they fall into; once: of anchors, whose h is
    their key, not of windows. What is found shared here goes to the buckets of the documents."""
    (h, g, doc, start, flag), (mh, md, ms) = combine(h, g, doc, start, np.zeros(len(h), np.uint8), once)
    bucket = (h >> np.uint64(_KEY) if once else h % np.uint64(buckets)).astype(np.int32)
    rest = h if once else h // np.uint64(buckets)
    o, runs = _rows(bucket, doc, start)
    rest, g, doc, start, flag = rest[o], g[o], doc[o], start[o], flag[o]
    out = [
        (b, e - s, False, _pack(rest[s:e], 5 if once else 7), b"" if once else _pack(g[s:e], 8), _pack(doc[s:e].view(np.uint64), 8), b"" if once else _pack(start[s:e].view(np.uint64), 5), flag[s:e].tobytes())
        for b, s, e in runs
    ]
    spread = (md.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(buckets)
    o, runs = _rows(spread.astype(np.int32), md, ms)
    mh, md, ms = mh[o], md[o], ms[o]
    out += [(b, e - s, True, _pack(mh[s:e], 8) if once else b"", b"", _pack(md[s:e].view(np.uint64), 8), b"" if once else _pack(ms[s:e].view(np.uint64), 5), b"") for b, s, e in runs]
    kinds = [pa.int32(), pa.int32(), pa.bool_(), *[pa.binary()] * 5]
    names = ["bucket", "n", "settled", "hashes", "seconds", "docs", "starts", "flags"]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * len(kinds), kinds)], names=names)


class _Gathered:
    """Entries of several blocks, sent together."""

    def __init__(self, buckets: int, once: bool) -> None:
        self.buckets, self.once = buckets, once
        self.held: list[tuple[np.ndarray, ...]] = []
        self.count = 0

    def add(self, *entries: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(entries)
        self.count += len(entries[0])
        if self.count >= _GATHER:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.count:
            yield _block(*(np.concatenate(x) for x in zip(*self.held)), self.buckets, self.once)
        self.held, self.count = [], 0


def _points(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, int]]:
    """(row, code points, document) of each text."""
    for i, (doc, t) in enumerate(zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist())):
        yield i, np.frombuffer(t.encode("utf-32-le"), np.uint32), doc


def _anchor_places(n: int, length: int) -> np.ndarray:
    width, period, residues = plan(length)
    if n < length:
        return np.zeros(0, np.int64)
    at = (np.arange(0, n, period)[:, None] + np.array(residues)).ravel()
    return at[at + width <= n]


def _anchors(length: int, buckets: int):
    width = plan(length)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Gathered(buckets, True)
        for whole in gathered(batches):
            texts, places, docs, base = [], [], [], 0
            for _, p, doc in _points(whole):
                at = _anchor_places(len(p), length)
                texts.append(p)
                places.append(at + base)
                docs.append(np.full(len(at), doc, np.int64))
                base += len(p)
            if places and sum(map(len, places)):
                h = keyed(window_hashes(np.concatenate(texts), np.concatenate(places), width), buckets)
                none = np.zeros(len(h), np.int64)
                yield from out.add(h, none.view(np.uint64), np.concatenate(docs), none)
        yield from out.flush()

    return run


def _windows(length: int, buckets: int):
    width = plan(length)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Gathered(buckets, False)
        for whole in gathered(batches):
            marks = whole.column("marks")
            for i, p, doc in _points(whole):
                at = _anchor_places(len(p), length)
                known = np.asarray(marks[i].values.to_numpy(zero_copy_only=False), np.int64).view(np.uint64)
                at = at[np.isin(keyed(window_hashes(p, at, width), buckets), known)]
                last = len(p) - length
                near = np.zeros(last + 2, np.int32)  # starts of spans around an anchor, by adding up borders
                np.add.at(near, np.clip(at + width - length, 0, last + 1), 1)
                np.add.at(near, np.minimum(at, last) + 1, -1)
                starts = np.flatnonzero(np.cumsum(near)[: last + 1] > 0)
                for k in range(0, len(starts), _GATHER):
                    s = starts[k : k + _GATHER]
                    yield from out.add(window_hashes(p, s, length, 7), window_hashes(p, s, length, 11), np.full(len(s), doc, np.int64), s)
        yield from out.flush()

    return run


def _shared(batches: Iterator[pa.RecordBatch], once: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, document, start) of the shared entries of a bucket, which is the whole partition."""
    kept: list[Entries] = []
    count = 0

    def flush() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        nonlocal kept, count
        keep, found = combine(*(np.concatenate(x) for x in zip(*kept)), once)
        kept, count = [keep], 0
        return found

    for b in batches:
        for bucket, n, settled, h, g, d, s, f in zip(*(b.column(c).to_pylist() for c in b.schema.names)):
            doc = _unpack(d, 8, n).view(np.int64)
            start = np.zeros(n, np.int64) if once else _unpack(s, 5, n).view(np.int64)
            if settled:
                yield _unpack(h, 8, n) if once else np.zeros(n, np.uint64), doc, start
                continue
            own = _unpack(h, 5 if once else 7, n)
            if once:
                own |= np.uint64(bucket << _KEY)
            kept.append((own, np.zeros(n, np.uint64) if once else _unpack(g, 8, n), doc, start, np.frombuffer(f, np.uint8)))
            count += n
            if count >= _GATHER:
                yield flush()
    if kept:
        yield flush()


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for h, d, _ in _shared(batches, True):
        o = np.argsort(d, kind="stable")
        yield from _by_document(d[o], h[o].view(np.int64))


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, d, s in _shared(batches, False):
        o = np.lexsort((s, d))
        yield from _by_document(d[o], s[o])


def _by_document(doc: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(doc):
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        at = pa.array(np.append(first, len(doc)).astype(np.int32))
        yield pa.record_batch({"doc": pa.array(doc[first]), "v": pa.ListArray.from_arrays(at, pa.array(value))})


def _cover(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column("v"):
                s = np.unique(np.concatenate([np.asarray(y.values.to_numpy(zero_copy_only=False)) for y in x.values]) if len(x.values) else np.zeros(0, np.int64))
                out.append(int(np.minimum(np.diff(s), length).sum()) + length if len(s) else 0)
            yield pa.record_batch({"doc": b.column("doc"), "shared": pa.array(out, pa.int64())})

    return run


def _bytes(setting: str) -> int:
    """A size as the session's settings write it."""
    number, unit = setting.lower().rstrip("b").rstrip("kmgt"), setting.lower().rstrip("b")[-1]
    return int(number) << {"k": 10, "m": 20, "g": 30, "t": 40}.get(unit, 0)


def _buckets(df: DataFrame) -> int:
    """From the planner's estimate of the input, so that a bucket has about the size that the session wants of a
    partition; where the planner knows no size, from the number of partitions. More than 2^23 buckets have no place in
    the keys; beyond that they grow."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = size * _BYTES_PER_BYTE // _bytes(spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64m")) if size < 1 << 55 else 4 * df._jdf.rdd().getNumPartitions()
    return int(min(max(wanted, least), 1 << 23))


def shared_starts(df: DataFrame, id_column: str, text_column: str, length: int) -> DataFrame:
    """doc, v: pieces of the list of places at which a span of length characters begins that another document holds."""
    texts = df.select(F.col(id_column).cast("long").alias("doc"), F.col(text_column).alias("text")).filter(F.col("doc").isNotNull() & (F.char_length("text") >= length))
    buckets = _buckets(df)
    anchors = texts.mapInArrow(_anchors(length, buckets), _BLOCK_DDL)
    marks = anchors.repartitionById(buckets, "bucket").mapInArrow(_marks, "doc long, v array<long>")
    marks = marks.groupBy("doc").agg(F.array_distinct(F.flatten(F.collect_list("v"))).alias("marks"))
    windows = texts.join(marks, "doc").mapInArrow(_windows(length, buckets), _BLOCK_DDL)
    return windows.repartitionById(buckets, "bucket").mapInArrow(_starts, "doc long, v array<long>")


def shared_chars(df: DataFrame, id_column: str, text_column: str, length: int = 300) -> DataFrame:
    """id_column and shared_chars: how many code points of a document lie in spans of length or more code points that
    occur verbatim in another document, overlaps counted once. Documents that share nothing have no row.

    All rows of one id are one document. A null id, a null text and a text shorter than length share nothing. Other
    columns are left out; an empty table gives an empty result.
    """
    if length < 1:
        raise ValueError(length)
    per = shared_starts(df, id_column, text_column, length).groupBy("doc").agg(F.collect_list("v").alias("v"))
    return per.mapInArrow(_cover(length), "doc long, shared long").select(F.col("doc").alias(id_column), F.col("shared").alias("shared_chars"))
