"""The Parquet tables of a data folder and their current rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Reads ``{folder}/{name}.parquet``; a plain attribute access gives the table."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def latest_by(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """The row with the greatest order value of each key, with columns beside the keys.

    One shuffle with partial aggregation. A null order value is older than any other. Ties are settled by the
    greatest values of the columns, so that the result doesn't depend on the order of rows. Rows with a null key
    form keys of their own.
    """
    rest = [c for c in columns if c not in keys]
    top = F.max(F.struct(F.col(order).alias("__o"), *[F.col(c) for c in rest])).alias("__top")
    return df.groupBy(*keys).agg(top).select(*keys, *[F.col(f"__top.{c}").alias(c) for c in rest])
