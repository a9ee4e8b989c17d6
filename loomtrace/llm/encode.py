"""Encoding of a corpus with a public byte-level tokenizer, with offsets in characters and an exact way back.

The tokenizer file is a parameter and must be readable on every executor. Texts go to the tokenizers library in
Arrow batches; each Python worker loads the tokenizer once.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import text_batches

#: Where the public tokenizer files lie unless a caller says otherwise.
TOKENIZER = os.environ.get("LOOMTRACE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")
#: Bytes of text that are encoded at once in a worker.
BATCH_BYTES = 1_000_000


@lru_cache(maxsize=4)
def load(path: str) -> Any:
    """The tokenizer of a file; the strings of its special tokens are ordinary text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.no_padding()
    t.no_truncation()
    return t


@lru_cache(maxsize=1)
def byte_table() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable bytes stand for themselves, the others for the
    characters from 256 on, in the order of the bytes."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in printable}
    rest = (b for b in range(256) if chr(b) not in table)
    return table | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each token id."""
    table, t = byte_table(), load(path)
    names = {i: s for s, i in t.get_vocab(with_added_tokens=True).items()}
    size = max(names) + 1
    return [bytes(table[c] for c in names[i]) if i in names and all(c in table for c in names[i]) else names.get(i, "").encode() for i in range(size)]


def decode(ids: list[int], path: str = TOKENIZER) -> str:
    """The text of ids; a character whose bytes are cut comes out as U+FFFD. The inverse of encoding for all text."""
    table = token_bytes(path)
    return b"".join(table[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def _token_sizes(path: str) -> np.ndarray:
    return np.array([len(x) for x in token_bytes(path)], np.int64)


def token_spans(ids: np.ndarray, text: str, path: str = TOKENIZER) -> tuple[np.ndarray, np.ndarray]:
    """First character of each token and the place after its last, by the bytes that the tokens stand for."""
    begins = (np.frombuffer(text.encode("utf-8"), np.uint8) & 0xC0) != 0x80  # no continuation byte
    char_of = np.cumsum(begins) - 1
    end = np.cumsum(_token_sizes(path)[ids])
    start = end - _token_sizes(path)[ids]
    return char_of[start].astype(np.int32), (char_of[end - 1] + 1).astype(np.int32)


def _texts(batch: pa.RecordBatch) -> tuple[list[int], list[str]]:
    """Rows with text, and these texts."""
    texts = batch.column("text").to_pylist()
    rows = [i for i, t in enumerate(texts) if t]
    return rows, [texts[i] for i in rows]


def _lists(n: int, rows: list[int], each: list[np.ndarray]) -> pa.ListArray:
    sizes = np.zeros(n + 1, np.int64)
    sizes[np.asarray(rows, np.int64) + 1] = [len(x) for x in each]
    values = np.concatenate(each) if each else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), pa.array(values.astype(np.int32)))


def encode(df: DataFrame, id_column: str, text_column: str, path: str = TOKENIZER, offsets: bool = False) -> DataFrame:
    """id_column and ids (array of int), for every row of df.

    ids has no special tokens. A null text and an empty text have an empty array. With offsets there are also starts
    and ends: for each token the place of its first character in the text and of the one after its last (code
    points); tokens that share a character cut between them all span that character. Repeated rows give repeated
    rows, other columns of df are left out, an empty table gives an empty result.
    """
    schema = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32()))] + [(c, pa.list_(pa.int32())) for c in ("starts", "ends") if offsets])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load(path)
        for whole in batches:
            for b in text_batches(iter([whole]), "text", BATCH_BYTES):
                rows, texts = _texts(b)
                ids = [np.asarray(e.ids, np.int32) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
                columns = [b.column("id"), _lists(b.num_rows, rows, ids)]
                if offsets:
                    spans = [token_spans(x, text, path) for x, text in zip(ids, texts)]
                    columns += [_lists(b.num_rows, rows, [s[k] for s in spans]) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    ddl = "id long, ids array<int>" + (", starts array<int>, ends array<int>" if offsets else "")
    out = df.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).mapInArrow(run, ddl)
    return out.withColumnRenamed("id", id_column)


def decoded(df: DataFrame, id_column: str, ids_column: str, path: str = TOKENIZER) -> DataFrame:
    """id_column and text, from ids; null ids give a null text, an empty array an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if x is None else decode(x, path) for x in b.column("ids").to_pylist()]
            yield pa.record_batch({"id": b.column("id"), "text": pa.array(texts, pa.string())})

    out = df.select(F.col(id_column).cast("long").alias("id"), F.col(ids_column).alias("ids")).mapInArrow(run, "id long, text string")
    return out.withColumnRenamed("id", id_column)
