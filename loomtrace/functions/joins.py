"""Joins that stay even when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted_join(left: DataFrame, right: DataFrame, on: list[str], spread: list[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """left joined with a right side of few rows a key: left's rows of a key are spread over salts by the columns in
    spread, right's rows are repeated for each salt. how: inner, left, left_semi or left_anti.

    The repeated rows are exchanged before the join, as they would be for it, so that a broadcast is chosen by their
    size and not by that of the rows before they were repeated.
    """
    a = left.withColumn("__salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    b = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).repartition(*on, "__salt")
    return a.join(b, [*on, "__salt"], how).drop("__salt")
