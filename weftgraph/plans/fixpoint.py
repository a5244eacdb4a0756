"""Semi-naive fixpoints over DataFrames.

Each round derives candidates from the rows found in the round before, drops those already known
and writes the rest, so a lost executor costs one round. The rounds are kept as tables that hold
one, two, four, ... of them: two of a size become one, as in a binary counter, so a round reads a
logarithmic number of tables and a row is rewritten that often at most. A bound on the rounds is
part of a query's meaning (depth); a budget stops and says so, it never filters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.durable import drop_durable, durable, durable_counted


def _all(tables: list[tuple[int, DataFrame]]) -> DataFrame:
    out = tables[0][1]
    for _, t in tables[1:]:
        out = out.unionByName(t)
    return out


def fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame], key: list[str], rounds: int | None = None, budget: int | None = None, falling: str | None = None) -> tuple[DataFrame, bool]:
    """All rows reachable from ``seed`` by ``step``, with the first ``round`` of each key; whether the budget stopped it.

    ``step`` maps the rows of one round to candidates with the same columns but ``round``; of
    candidates with one key the least row stays. With ``falling``, one of the other columns, a row
    whose value lies below all known ones of its key counts as found anew.
    """
    others = [c for c in seed.columns if c not in key]

    def least(df: DataFrame) -> DataFrame:
        if not others:
            return df.select(*key).distinct()
        return df.groupBy(*key).agg(F.min(F.struct(*others)).alias("x")).select(*key, *[F.col(f"x.{c}").alias(c) for c in others])

    found, new = durable_counted(least(seed).withColumn("round", F.lit(0)), "round")
    tables, count, n = [(1, found)], new, 0
    while new and (rounds is None or n < rounds):
        if budget is not None and count > budget:
            return _all(tables), True
        n += 1
        candidates = least(step(found.drop("round")).select(*seed.columns))
        known = _all(tables).select(*[F.col(k).alias(f"known_{k}") for k in [*key, *([falling] if falling else [])]])
        same = F.col(falling) >= F.col(f"known_{falling}") if falling else None
        for k in key:
            c = F.col(k).eqNullSafe(F.col(f"known_{k}"))
            same = c if same is None else same & c
        found, new = durable_counted(candidates.join(known, same, "left_anti").withColumn("round", F.lit(n)), "round")
        count += new
        if new:
            tables.append((1, found))
        while len(tables) > 2 and tables[-2][0] == tables[-3][0]:  # the last table is still the next round's input
            (a, x), (b, y) = tables[-3], tables[-2]
            tables[-3:-1] = [(a + b, durable(x.unionByName(y), "rounds"))]
            drop_durable(x)
            drop_durable(y)
    return _all(tables), False
