"""Problem 8: the corpus as token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..tables import Tables
from .encode import decoded, encode


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode(Tables(spark, folder).documents, "doc_id", "text")


def p8_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, ids, starts, ends: the tokens and the characters that each of them spans."""
    return encode(Tables(spark, folder).documents, "doc_id", "text", offsets=True)


def p8_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, text: the ids decoded again; equal to the text, '' for a null text."""
    return decoded(p8_ids(spark, folder), "doc_id", "ids")


QUERIES = {f.__name__: f for f in (p8_ids, p8_offsets, p8_decoded)}
SQL = {"p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
