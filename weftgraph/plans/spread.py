"""Work for all cores where a table comes in fewer pieces than there are cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df``, hashed over the cores by a key of many values if its scan has fewer partitions than that.

    A large table has more partitions than cores and is left as it is, so its texts never shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)
