"""The search language: queries, the tokenizer, phrase frequencies and their SQL."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidQuery
from .text import ACCENTED, PLAIN, folded

#: Scripts whose characters are tokens of their own.
SPLIT_SCRIPTS = ("Han", "Hiragana", "Katakana")
_TOKEN = r"[\p{L}\p{N}\p{Co}_.\-]+"
_SPLIT = "([" + "".join(rf"\p{{Is{s}}}" for s in SPLIT_SCRIPTS) + "])"


def segmented(c: Column) -> Column:
    """A space around each Han, Hiragana and Katakana character."""
    return F.regexp_replace(c, _SPLIT, " $1 ")


def tokens(c: Column) -> Column:
    """Array of tokens: runs of letters, digits, private-use characters and _ . - in folded form."""
    return F.regexp_extract_all(folded(segmented(c)), F.lit(f"({_TOKEN})"), 1)


def tokens_sql(column: str) -> str:
    """The same for DuckDB."""
    spaced = rf"regexp_replace({column}, '([\p{{Han}}\p{{Hiragana}}\p{{Katakana}}])', ' \1 ', 'g')"
    plain = f"regexp_replace(translate(lower({spaced}), '{ACCENTED}', '{PLAIN}'), '[\\x{{0300}}-\\x{{036F}}]+', '', 'g')"
    return rf"regexp_extract_all({plain}, '{_TOKEN}')"


def tokens_of(text: str) -> list[str]:
    """The same for one text on the driver."""
    import regex

    spaced = regex.sub(r"([\p{Han}\p{Hiragana}\p{Katakana}])", r" \1 ", text)
    low = spaced.lower().translate(str.maketrans(ACCENTED, PLAIN))
    return regex.findall(_TOKEN, re.sub("[̀-ͯ]+", "", low))


@dataclass(frozen=True)
class Query:
    """terms and phrases as written; sequences: token sequences that all must occur."""

    terms: tuple[str, ...]
    phrases: tuple[str, ...]
    sequences: tuple[tuple[str, ...], ...]


def parse_query(text: str) -> Query:
    """Words are terms, "quoted text" is a phrase; all must occur. A term is the AND of its space-separated pieces
    after segmentation, each an adjacent sequence of tokens; a phrase is one sequence. Pieces without tokens are left
    out. Nothing else has a meaning of its own. An empty query, an open quote or a blank phrase raises InvalidQuery.
    """
    space = "﻿" + "".join(chr(i) for i in range(0x3001) if chr(i).isspace() and unicodedata.category(chr(i)) != "Cf" and not 0x1C <= i <= 0x1F)
    rest = text.strip(space)
    terms, phrases = [], []
    while rest := rest.lstrip(space):
        if rest[0] == '"':
            phrase, closed, rest = rest[1:].partition('"')
            if not closed:
                raise InvalidQuery("a quoted phrase has no end")
            if not phrase.strip(space):
                raise InvalidQuery("a quoted phrase is blank")
            phrases.append(phrase.strip(space))
        else:
            term = re.match(rf'[^"{re.escape(space)}]+', rest)[0]
            terms.append(term)
            rest = rest[len(term) :]
    if not terms and not phrases:
        raise InvalidQuery("the query is empty")
    import regex

    pieces = [p for t in terms for p in regex.sub(r"([\p{Han}\p{Hiragana}\p{Katakana}])", r" \1 ", t).split()]
    sequences = [tuple(tokens_of(p)) for p in [*pieces, *phrases]]
    return Query(tuple(terms), tuple(phrases), tuple(s for s in sequences if s))


def frequency(tokens_: Column, sequence: tuple[str, ...]) -> Column:
    """At how many places of the tokens the sequence begins; places may overlap."""
    text = F.concat(F.lit(" "), F.array_join(tokens_, " "), F.lit(" "))
    return F.regexp_count(text, F.lit("(?=\\Q " + " ".join(sequence) + " \\E)"))


def frequency_sql(tokens_: str, sequence: tuple[str, ...]) -> str:
    """The same for DuckDB."""
    k = len(sequence)
    want = "[" + ", ".join("'" + s.replace("'", "''") + "'" for s in sequence) + "]"
    return f"len(list_filter(range(1, len({tokens_}) - {k} + 2), lambda i: {tokens_}[i:i + {k - 1}] = {want}))"
