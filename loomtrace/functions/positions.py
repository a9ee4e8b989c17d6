"""Dense positions within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dense_position(df: DataFrame, key: str | list[str], order: str, tie: str, name: str, stretch: int = 65_536) -> DataFrame:
    """df with the zero-based position of each row among the rows of its key by (order, tie).

    Rows are numbered within stretches of the order's range; the stretches' sizes, added up, shift them. So no task
    sorts a whole group. A null order comes first.
    """
    key = [key] if isinstance(key, str) else key
    part = F.coalesce(F.floor(F.col(order) / stretch), F.lit(-(2**62)))
    cut = df.withColumn("__part", part)
    sizes = cut.groupBy(*key, "__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy(*key, "__part").orderBy(F.col(order).asc_nulls_first(), tie)) - 1
    shifted = cut.withColumn("__w", within).join(sizes.withColumn("__b", before).drop("__n"), [*key, "__part"])
    return shifted.withColumn(name, (F.col("__b") + F.col("__w")).cast("long")).drop("__part", "__w", "__b")
