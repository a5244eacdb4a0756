"""Intermediate results that survive the loss of an executor.

A durable table is written once to the shared folder named by ``spark.checkpoint.dir`` and read
back, which cuts the lineage and lets several later steps share it. Only where the setting is
absent (tests on one machine) is a temporary folder made and set.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="weft-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _forget() -> None:
    for spark, path in _made:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may be gone already
            pass
    _made.clear()


atexit.register(_forget)


def durable(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/weft/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def durable_counted(df: DataFrame, label: str = "step") -> tuple[DataFrame, int]:
    """As :func:`durable`, with the number of rows, told by the write itself."""
    seen = Observation()
    kept = durable(df.observe(seen, F.count(F.lit(1)).alias("n")), label)
    return kept, seen.get["n"]


def drop_durable(df: DataFrame) -> None:
    """Delete the files of a durable table that nothing reads any more."""
    spark = df.sparkSession
    roots = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for item in [x for x in _made if any(r.rstrip("/").endswith(x[1].rsplit("/", 1)[1]) for r in roots)]:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(item[1])
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        _made.remove(item)
