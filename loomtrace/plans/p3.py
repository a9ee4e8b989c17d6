"""Problem 3: nested messages, blocks, calls and results of raw entry records as flat tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import nested
from ..tables import Tables
from .p2 import found_changes


def _nodes(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    changes, baseline = found_changes(t, (F.col("record_kind") == "entry") & F.array_contains("missing", "type"))
    renamed = changes.filter("change_kind = 'renamed' AND field_name = 'type'")
    return nested.nodes(t.raw_lines, baseline, renamed.select("file_id", "version", F.col("new_name").alias("name")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    n = _nodes(spark, folder).filter(F.col("semantic_kind").isin(nested.CALL, nested.RESULT))
    return n.select("file_id", "line_no", "semantic_kind", "tool_call_id", "parent_call_id").distinct()


def _table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: nested.variant(_nodes(spark, folder), name)


QUERIES = {"p3_found": p3_found} | {f"p3_{name}": _table(name) for name in nested.VARIANTS}
SQL: dict[str, str] = {}
