"""Splitting of oversized texts at natural boundaries, with an overlap, by agglomerative merging.

A text is cut into atomic segments at the strongest boundaries that make them small enough. Adjacent pairs wait in a
heap; the pair with the weakest boundary between them is merged first, as long as the merged piece and the overlap
before it stay within the limit. What can't be merged any more are the pieces.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import text_batches

#: Strength of a boundary: how much a text pauses there.
PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, CHARACTER = 5, 4, 3, 2, 1, 0
_BREAKS = re.compile(
    r"(?P<p>(?:\r\n|[\n\r  ])[ \t]*(?:\r\n|[\n\r  ])\s*)"
    r"|(?P<l>\r\n|[\n\r  \x0b\x0c\x85])"
    r"|(?P<s>[.!?…]+[\"')\]’”]*(?=[ \t ])[ \t ]+|[。！？]+[」』”]*)"
    r"|(?P<c>[,;:](?=[ \t])[ \t]+|[、，；：])"
    r"|(?P<w>\s+)"
)
_STRENGTH = {"p": PARAGRAPH, "l": LINE, "s": SENTENCE, "c": CLAUSE, "w": WORD}
_JOINED = {"‍", "︎", "️"}
#: A table of options has so many rows at most; it is a parameter and goes into the plan.
MAX_OPTIONS = 1_000


def boundaries(text: str) -> list[tuple[int, int]]:
    """Places where the text pauses, with their strength, ascending; a place lies behind the pause."""
    n = len(text)
    return [(m.end(), _STRENGTH[m.lastgroup]) for m in _BREAKS.finditer(text) if m.end() < n]


def _safe(text: str, place: int, low: int) -> int:
    """The last place at or before place, above low, that cuts no line end and no character from its marks."""
    p = place
    while p > low + 1 and (text[p] in _JOINED or text[p - 1] == "‍" or unicodedata.combining(text[p]) or text[p - 1 : p + 1] == "\r\n"):
        p -= 1
    return p if p > low + 1 or place <= low + 1 else place


def atoms(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Ends of the atomic segments and the strength of the boundary there; each segment fits the limit."""
    n = len(text)
    cuts = [(p, s) for p, s in boundaries(text) if p >= overlap]
    out: list[tuple[int, int]] = []

    def room(start: int) -> int:
        return limit if start == 0 else limit - overlap

    def fill(start: int, end: int, strength: int, inner: list[tuple[int, int]], level: int) -> None:
        """Segments of text[start:end], the last with this strength; inner: the boundaries within."""
        if end - start <= room(start):
            out.append((end, strength))
            return
        if level < 0:
            while end - start > room(start):
                at = _safe(text, start + room(start), max(start, overlap - 1))
                out.append((at, CHARACTER))
                start = at
            out.append((end, strength))
            return
        here = [(p, s) for p, s in inner if s >= level]
        rest = [(p, s) for p, s in inner if s < level]
        i, last = 0, start
        for p, s in [*here, (end, strength)]:
            j = i
            while j < len(rest) and rest[j][0] < p:
                j += 1
            fill(last, p, s, rest[i:j], level - 1)
            i, last = j, p

    fill(0, n, PARAGRAPH + 1, cuts, PARAGRAPH)
    return out


def merge(ends: list[tuple[int, int]], limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, strength at the end) of the pieces that merging the segments leaves."""
    n = len(ends)
    start = [0, *[e for e, _ in ends[:-1]]]
    end, strength = [e for e, _ in ends], [s for _, s in ends]
    left, right, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n

    def fits(i: int) -> bool:
        j = right[i]
        return j < n and end[j] - start[i] + (overlap if start[i] else 0) <= limit

    def entry(i: int) -> tuple[int, int, int, int]:
        return strength[i], end[right[i]] - start[i], i, right[i]

    heap = [entry(i) for i in range(n - 1) if fits(i)]
    heapq.heapify(heap)
    while heap:
        _, size, i, j = heapq.heappop(heap)
        if not alive[i] or not (j < n and alive[j]) or right[i] != j or end[j] - start[i] != size:
            continue
        end[i], strength[i], right[i], alive[j] = end[j], strength[j], right[j], False
        if right[i] < n:
            left[right[i]] = i
            if fits(i):
                heapq.heappush(heap, entry(i))
        if left[i] >= 0 and fits(left[i]):
            heapq.heappush(heap, entry(left[i]))
    return [(start[i], end[i], strength[i]) for i in range(n) if alive[i]]


def split(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, strength) of the pieces of a text, in code points. Piece k is text[start:end], with the overlap
    characters before start repeated in front of it where start > 0; with them it is no longer than limit. The
    pieces cover the text without gap. A text within the limit, the empty one too, is one piece."""
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError(f"limit {limit} and overlap {overlap} don't go together")
    if len(text) <= limit:
        return [(0, len(text), PARAGRAPH + 1)]
    return merge(atoms(text, limit, overlap), limit, overlap)


def read_options(df: DataFrame) -> dict[str | None, tuple[int, int]]:
    """kind -> (limit, overlap) from semantic_kind, max_indexed_text_chars, overlap_chars; None is for other kinds."""
    rows = df.select("semantic_kind", "max_indexed_text_chars", "overlap_chars").limit(MAX_OPTIONS + 1).collect()
    if len(rows) > MAX_OPTIONS:
        raise ValueError(f"more than {MAX_OPTIONS} options")
    return {r[0]: (int(r[1]), int(r[2] or 0)) for r in rows if r[1] is not None}


def _option(kind: Column, options: dict[str | None, tuple[int, int]], at: int) -> Column:
    out = F.lit(options[None][at] if None in options else None).cast("int")
    for name, values in sorted((k, v) for k, v in options.items() if k is not None):
        out = F.when(kind == name, F.lit(values[at])).otherwise(out)
    return out


def split_oversized(df: DataFrame, keys: list[str], text: str, kind: str, options: dict[str | None, tuple[int, int]], only_oversized: bool = False) -> DataFrame:
    """The pieces of every text: keys, piece_no, n_pieces, start_char, end_char, overlap_chars, strength, piece.

    A text over the limit of its kind (the limit under None for other and null kinds; none at all if there is no such
    limit) is split; other texts are one piece, left out with only_oversized. strength tells what the piece ends with: 6 end of text, 5 paragraph, 4 line, 3 sentence,
    2 clause, 1 word, 0 within a word. A null text has no piece, an empty one an empty piece. Exact repetitions of a
    row count once. Columns other than these are left out; keys may not bear the names of the result's columns.
    """
    out = ["piece_no", "n_pieces", "start_char", "end_char", "overlap_chars", "strength", "piece"]
    if {*keys} & {*out}:
        raise ValueError("keys bear names of the result's columns")
    rows = df.filter(F.col(text).isNotNull()).select(
        *keys, F.col(text).alias("__text"), _option(F.col(kind), options, 0).alias("__limit"), _option(F.col(kind), options, 1).alias("__overlap")
    )
    over = F.coalesce(F.char_length("__text") > F.col("__limit"), F.lit(False))
    names = ["piece_no", "n_pieces", "start_char", "end_char", "overlap_chars", "strength"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in text_batches(iter([whole]), "__text", 4_000_000):
                at: list[int] = []
                numbers: list[tuple[int, ...]] = []
                texts: list[str] = []
                for i, (t, limit, overlap) in enumerate(zip(*(b.column(c).to_pylist() for c in ("__text", "__limit", "__overlap")))):
                    pieces = split(t, limit, overlap)
                    for k, (start, end, strength) in enumerate(pieces):
                        o = overlap if start else 0
                        at.append(i)
                        numbers.append((k, len(pieces), start, end, o, strength))
                        texts.append(t[start - o : end])
                columns = [b.column(c).take(pa.array(at, pa.int32())) for c in keys]
                columns += [pa.array([x[j] for x in numbers], pa.int32()) for j in range(len(names))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], names=[*keys, *out])

    types = dict(df.dtypes)
    ddl = ", ".join([*(f"`{k}` {types[k]}" for k in keys), *(f"{c} int" for c in names), "piece string"])
    cut = rows.filter(over).distinct().mapInArrow(run, ddl)
    if only_oversized:
        return cut
    whole = rows.filter(~over).distinct().select(*keys, *[F.lit(x).alias(c) for c, x in zip(names[:3], (0, 1, 0))], F.char_length("__text").alias("end_char"), F.lit(0).alias("overlap_chars"), F.lit(PARAGRAPH + 1).alias("strength"), F.col("__text").alias("piece"))
    return cut.unionByName(whole)
