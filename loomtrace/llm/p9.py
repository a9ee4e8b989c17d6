"""Problem 9: evaluation passages in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..tables import Tables
from .leaks import leaked_runs, paraphrases


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return leaked_runs(t.documents, t.eval_items, 12)


def p9_paraphrases(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return paraphrases(t.documents, t.eval_items)


QUERIES = {f.__name__: f for f in (p9_found, p9_paraphrases)}
_GRAMS = r"""SELECT DISTINCT id, array_to_string(w[i:i + 11], ' ') AS gram FROM (
  SELECT id, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT {id} AS id, regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+') AS w FROM {table}))"""
SQL = {
    "p9_found": f"""
WITH d AS ({_GRAMS.format(id="doc_id", text="text", table="documents")}), q AS ({_GRAMS.format(id="item_id", text="passage", table="eval_items")})
SELECT DISTINCT d.id AS doc_id, q.id AS item_id FROM d JOIN q ON q.gram = d.gram""",
}
