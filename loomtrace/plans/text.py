"""Queries of the text operators over whole documents and fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import AGGREGATE_CHARS, OMITTED, PREVIEW_CHARS, READ_FRAGMENTS, bounded_text, collapse, preview, snippet, window
from ..functions.tokens import segmented, tokens, tokens_sql
from ..tables import Tables
from .base import STORE, store


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return Tables(spark, folder).documents


def text_snippet(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", snippet("text", ["deadline", "tokenizer"]).alias("snippet"))


def neighbor_preview(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", snippet("text", [], 120).alias("preview"))


def preview_head_tail(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", preview("text").alias("p")).select("doc_id", "p.*")


def window_offset(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", window("text", 1500, 700).alias("w")).select("doc_id", "w.*")


def bounded_index_text(spark: SparkSession, folder: str) -> DataFrame:
    d = _documents(spark, folder)
    return d.select("doc_id", bounded_text("text").alias("indexed"), bounded_text("text", 500).alias("short"), bounded_text("text", 20).alias("tiny"))


def collapsed_text(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", collapse("text").alias("t"))


def segmented_text(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", collapse(segmented(F.col("text"))).alias("t"))


def document_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Every token of each document in order; tokens hold no spaces."""
    t = _documents(spark, folder).select("doc_id", tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.array_join("t", " ").alias("tokens"))


def fragment_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Of each entry: fragments, how many a read returns, the characters each of them may have."""
    f = store(spark, folder).fragments.groupBy("session_id", "entry_id").agg(F.count("*").alias("total"))
    shown = F.least("total", F.lit(READ_FRAGMENTS))
    each = F.greatest(F.lit(1), F.floor(F.lit(AGGREGATE_CHARS) / shown))
    return f.select("session_id", "entry_id", "total", shown.alias("returned"), (F.col("total") - shown).alias("omitted"), (F.col("total") > READ_FRAGMENTS).alias("truncated"), each.alias("budget"), F.least(F.lit(PREVIEW_CHARS), each).alias("preview_chars"))


def file_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Which files each tool call read or changed."""
    f = store(spark, folder).fragments.filter("semantic_kind = 'tool.call' AND file_evidence_type IS NOT NULL")
    return f.select("session_id", "entry_id", "fragment_id", "file_evidence_type", F.explode("file_paths").alias("path"))


QUERIES = {f.__name__: f for f in (text_snippet, neighbor_preview, preview_head_tail, window_offset, bounded_index_text, collapsed_text, segmented_text, document_tokens, fragment_budget, file_evidence)}

_SPACE = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
_T = f"trim(regexp_replace(text, '{_SPACE}', ' ', 'g'), ' ')"
_MARK = "'" + OMITTED.replace("\n", "' || chr(10) || '") + "'"


def _bounded(n: int) -> str:
    room = n - len(OMITTED)
    return f"CASE WHEN length(text) <= {n} THEN text ELSE substr(text, 1, {-(-room // 2)}) || {_MARK} || right(text, {room // 2}) END"


SQL = {
    "text_snippet": f"""
WITH d AS (SELECT doc_id, {_T} AS t FROM documents),
m AS (SELECT *, coalesce(least(nullif(instr(lower(t), 'deadline'), 0), nullif(instr(lower(t), 'tokenizer'), 0)), 0) AS m FROM d)
SELECT doc_id, CASE WHEN length(t) <= 240 THEN t WHEN m = 0 THEN substr(t, 1, 240)
  ELSE substr(t, greatest(m - 81, 0) + 1, least(length(t), m + 159) - greatest(m - 81, 0)) END AS snippet FROM m""",
    "neighbor_preview": f"SELECT doc_id, substr({_T}, 1, 120) AS preview FROM documents",
    "preview_head_tail": """
SELECT doc_id, CASE WHEN length(text) > 2000 THEN substr(text, 1, 1000) || '…' || right(text, 1000) ELSE text END AS text, length(text) AS total,
  length(text) > 2000 AS truncated, CASE WHEN length(text) > 2000 THEN 1000 ELSE length(text) END AS head_end,
  CASE WHEN length(text) > 2000 THEN length(text) - 1000 ELSE length(text) END AS tail_start FROM documents""",
    "window_offset": """
SELECT doc_id, substr(text, a + 1, b - a) AS text, length(text) AS total, b - a < length(text) AS truncated, a AS start, b AS "end"
FROM (SELECT *, CASE WHEN text IS NOT NULL THEN least(1500, length(text)) END AS a, CASE WHEN text IS NOT NULL THEN least(length(text), least(1500, length(text)) + 700) END AS b FROM documents)""",
    "bounded_index_text": f"SELECT doc_id, {_bounded(10_000)} AS indexed, {_bounded(500)} AS short, substr(text, 1, 20) AS tiny FROM documents",
    "collapsed_text": f"SELECT doc_id, {_T} AS t FROM documents",
    "segmented_text": rf"WITH d AS (SELECT doc_id, regexp_replace(text, '([\p{{Han}}\p{{Hiragana}}\p{{Katakana}}])', ' \1 ', 'g') AS text FROM documents) SELECT doc_id, {_T} AS t FROM d",
    "document_tokens": f"WITH d AS (SELECT doc_id, {tokens_sql('text')} AS t FROM documents) SELECT doc_id, len(t) AS n, array_to_string(t, ' ') AS tokens FROM d",
    "fragment_budget": f"""
WITH {STORE}, n AS (SELECT session_id, entry_id, count(*) AS total FROM f GROUP BY ALL)
SELECT session_id, entry_id, total, least(total, 20) AS returned, total - least(total, 20) AS omitted, total > 20 AS truncated,
  greatest(1, 6000 // least(total, 20)) AS budget, least(2000, greatest(1, 6000 // least(total, 20))) AS preview_chars FROM n""",
    "file_evidence": f"WITH {STORE} SELECT session_id, entry_id, fragment_id, file_evidence_type, unnest(file_paths) AS path FROM f WHERE semantic_kind = 'tool.call' AND file_evidence_type IS NOT NULL",
}
