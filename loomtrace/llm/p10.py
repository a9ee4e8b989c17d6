"""Problem 10: long verbatim stretches that documents share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import Tables
from .spans import shared_chars


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return shared_chars(Tables(spark, folder).documents, "doc_id", "text", 300)


def p10_by_source(spark: SparkSession, folder: str) -> DataFrame:
    """Per source: documents that share text, and how much of all text that is."""
    t = Tables(spark, folder)
    d = t.documents.select("doc_id", "source", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n"))
    d = d.join(p10_found(spark, folder), "doc_id", "left")
    return d.groupBy("source").agg(F.count("shared_chars").alias("n_sharing"), F.sum(F.coalesce("shared_chars", F.lit(0))).alias("shared_chars"), F.sum("n").alias("n_chars"))


QUERIES = {f.__name__: f for f in (p10_found, p10_by_source)}
#: Windows are told apart by hash; each starts where the one before it has been cut off, so that long texts stay cheap.
_SHARED = """
WITH t AS (SELECT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 300),
b AS (SELECT doc_id, k, substr(text, k + 1, 1299) AS part FROM (SELECT doc_id, text, unnest(range(0, length(text) - 299, 1000)) AS k FROM t)),
w AS (SELECT doc_id, k + j AS i, hash(substr(part, j + 1, 300)) AS h FROM (SELECT doc_id, k, part, unnest(range(0, least(1000, length(part) - 299))) AS j FROM b)),
s AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)),
p AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i AS gap FROM w SEMI JOIN s ON s.h = w.h),
found AS (SELECT doc_id, sum(least(300, coalesce(gap, 300)))::BIGINT AS shared_chars FROM p GROUP BY doc_id)"""
SQL = {
    "p10_found": _SHARED + " SELECT doc_id, shared_chars FROM found",
    "p10_by_source": _SHARED + """
SELECT source, count(shared_chars) AS n_sharing, coalesce(sum(shared_chars), 0)::BIGINT AS shared_chars, sum(coalesce(length(text), 0))::BIGINT AS n_chars
FROM documents LEFT JOIN found USING (doc_id) GROUP BY source""",
}
