"""Problem 7: personal information in fragments."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import Tables
from .pii import collisions, find, read_lexicon, redact

#: The secret that replacements depend on; production runs set their own.
KEY = os.environ.get("LOOMTRACE_PII_KEY", "not a secret")
_KEYS = ["session_id", "fragment_id"]


def _found(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return find(t.fragments, _KEYS, "frag_text", read_lexicon(t.name_parts))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _found(spark, folder).select(*_KEYS, "pii_type").distinct()


def _redacted(spark: SparkSession, folder: str, style: str) -> DataFrame:
    t = Tables(spark, folder)
    texts = t.fragments.select(*_KEYS, "frag_text")
    return redact(texts, "frag_text", read_lexicon(t.name_parts), KEY, style)


def p7_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of fragments with placeholders."""
    return _redacted(spark, folder, "placeholder")


def p7_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of fragments with surrogates."""
    return _redacted(spark, folder, "surrogate")


def p7_entities(spark: SparkSession, folder: str) -> DataFrame:
    """How many distinct entities of each type, and in how many fragments."""
    f = _found(spark, folder)
    return f.groupBy("pii_type").agg(F.countDistinct("value").alias("n_values"), F.countDistinct(*_KEYS).alias("n_fragments"))


def p7_collisions(spark: SparkSession, folder: str) -> DataFrame:
    return collisions(_found(spark, folder), KEY)


QUERIES = {f.__name__: f for f in (p7_found, p7_redacted, p7_surrogates, p7_entities, p7_collisions)}
SQL: dict[str, str] = {}
