"""Text columns: white space, bounded index text, snippets, previews and windows. All offsets are code points."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Put in place of what bounded_text leaves out of the middle.
OMITTED = "\n[loomtrace text left out]\n"
INDEXED_CHARS, SNIPPET_CHARS, PREVIEW_CHARS, NEIGHBOR_CHARS = 10_000, 240, 2_000, 120
AGGREGATE_CHARS, READ_FRAGMENTS = 6_000, 20


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse(c: Column | str) -> Column:
    """Runs of (Unicode) white space as one space, none at the ends."""
    return F.btrim(F.regexp_replace(_c(c), r"(?U)[\s\x{FEFF}]+", " "), F.lit(" "))


def bounded_text(c: Column | str, limit: int = INDEXED_CHARS, marker: str = OMITTED) -> Column:
    """The text, or its head and tail around a marker so that the whole has limit characters; just the head where
    the limit leaves no room for both."""
    t = _c(c)
    if limit <= 0:
        return F.when(t.isNotNull(), F.lit(""))
    room = limit - len(marker)
    if room <= 1:
        return F.substring(t, 1, limit)
    head, tail = -(-room // 2), room // 2
    return F.when(F.char_length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, head), F.lit(marker), F.right(t, F.lit(tail))))


def first_match(text: Column, terms: list[str]) -> Column:
    """One-based place of the earliest of the terms in the text, whatever the case; 0 if none occurs."""
    low = F.lower(text)
    places = [F.locate(t.lower(), low) for t in terms if t]
    if not places:
        return F.lit(0)
    return F.coalesce(F.array_min(F.filter(F.array(*places), lambda p: p > 0)), F.lit(0))


def snippet(c: Column | str, terms: list[str], limit: int = SNIPPET_CHARS) -> Column:
    """At most limit characters of the collapsed text, a third of them before the earliest match; the head if nothing
    matches, the whole if it is short."""
    t = collapse(c)
    before = limit // 3
    m = first_match(t, terms)
    start = F.greatest(m - 1 - before, F.lit(0))
    size = F.least(F.char_length(t), m - 1 + limit - before) - start
    return F.when(F.char_length(t) <= limit, t).when(m == 0, F.substring(t, 1, limit)).otherwise(F.substring(t, start + 1, size))


def preview(c: Column | str, limit: Column | int = PREVIEW_CHARS) -> Column:
    """struct(text, total, truncated, head_end, tail_start): head and tail around an ellipsis if the text is longer
    than limit; [0, head_end) and [tail_start, total) are shown."""
    t = _c(c)
    n = F.char_length(t)
    cap = F.lit(limit) if isinstance(limit, int) else limit
    head, tail = F.ceil(cap / 2).cast("int"), F.floor(cap / 2).cast("int")
    cut = n > cap
    text = F.when(cut, F.concat(F.substring(t, F.lit(1), head), F.lit("…"), F.right(t, tail))).otherwise(t)
    return F.struct(
        text.alias("text"),
        n.cast("long").alias("total"),
        cut.alias("truncated"),
        F.when(cut, head).otherwise(n).cast("long").alias("head_end"),
        F.when(cut, n - tail).otherwise(n).cast("long").alias("tail_start"),
    )


def window(c: Column | str, offset: int, size: Column | int) -> Column:
    """struct(text, total, truncated, start, end): size characters from offset on, kept within the text."""
    t = _c(c)
    n = F.char_length(t)
    w = F.lit(max(0, size)) if isinstance(size, int) else size
    start = F.when(n.isNotNull(), F.least(F.lit(max(0, offset)), n))  # least() passes over nulls
    end = F.when(n.isNotNull(), F.least(n, start + w))
    return F.struct(
        F.substring(t, start + 1, end - start).alias("text"),
        n.cast("long").alias("total"),
        (end - start < n).alias("truncated"),
        start.cast("long").alias("start"),
        end.cast("long").alias("end"),
    )


def accents() -> tuple[str, str]:
    """Letters that are an ASCII letter with one diacritic, and these ASCII letters."""
    pairs = []
    for i in range(0xC0, 0x2000):
        d = unicodedata.normalize("NFD", chr(i))
        if len(d) == 2 and d[0].isascii() and d[0].isalpha() and unicodedata.category(d[1]) == "Mn":
            pairs.append((chr(i), d[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = accents()


def folded(c: Column) -> Column:
    """Lower case without diacritics."""
    return F.regexp_replace(F.translate(F.lower(c), ACCENTED, PLAIN), r"[\x{0300}-\x{036F}]+", "")
