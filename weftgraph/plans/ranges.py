"""Neighbours in sorted groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.plans.durable import durable


def lead_in_ranges(df: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the ``value`` of the next row of its ``key`` in the total order ``order`` (nulls first), null at the end.

    Rows are range-partitioned by key and order, so a key of any size lies in many ranges. Within a
    range a window finds the next row; behind its last row stands the first one of the next range
    that holds the key.
    """
    placed = durable(df.repartitionByRange(key, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    inside = placed.withColumn(name, F.lead(value).over(Window.partitionBy(key, "__range").orderBy(*order)))
    firsts = placed.groupBy(key, "__range").agg(F.min(F.struct(*order, F.col(value).alias("__first"))).alias("__x")).select(key, "__range", F.col("__x.__first").alias("__first"))
    behind = firsts.withColumn("__behind", F.lead("__first").over(Window.partitionBy(key).orderBy("__range"))).filter("`__behind` is not null")
    joined = inside.join(behind.select(F.col(key).alias("__key"), F.col("__range").alias("__at"), "__behind"), (F.col(key) == F.col("__key")) & (F.col("__range") == F.col("__at")), "left")
    return joined.select(*df.columns, F.coalesce(name, "__behind").alias(name))
