"""Nearest vectors of a query set by cosine, exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries of one block; each block passes over the rows once.
BLOCK = 4096


def nearest(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, similarity): the ``k`` rows nearest each query, itself left out, ties by id.

    Queries go to the tasks in blocks of bounded size; each task keeps ``k`` per query, so only
    ``k`` rows a task and query are shuffled. Null or zero vectors are no neighbours.
    """
    n = queries.count()
    blocks = max(1, -(-n // BLOCK))
    out = None
    for block in range(blocks):
        part = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block) if blocks > 1 else queries
        got = [(r["vec_id"], r["embedding"]) for r in part.collect() if r["embedding"] is not None]
        if not got:
            continue
        ids = np.array([g[0] for g in got])
        q = np.array([g[1] for g in got], float)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)

        def best(batches: Iterator[pd.DataFrame], ids=ids, q=q) -> Iterator[pd.DataFrame]:
            for b in batches:
                b = b[b["embedding"].notna()]
                if not len(b):
                    continue
                v = np.stack([np.asarray(x, float) for x in b["embedding"]])
                norm = np.linalg.norm(v, axis=1)
                s = np.round(q @ (v / np.maximum(norm, 1e-12)[:, None]).T, 5)
                vec = b["vec_id"].to_numpy()
                s[ids[:, None] == vec[None, :]] = -np.inf
                s[:, norm == 0] = -np.inf
                take = [np.lexsort((vec, -row))[:k] for row in s]
                yield pd.DataFrame({"query_id": np.repeat(ids, [len(t) for t in take]), "vec_id": np.concatenate([vec[t] for t in take]), "similarity": np.concatenate([r[t] for r, t in zip(s, take)])})

        found = rows.mapInPandas(best, "query_id long, vec_id long, similarity double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return queries.sparkSession.createDataFrame([], "query_id long, vec_id long, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return out.filter(F.col("similarity") > float("-inf")).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).drop("place")
