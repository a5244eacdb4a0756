"""Per-key results without a task that does most of the work.

Two stages: rows of heavy keys get a salt, partial results are computed per (key, salt), and the
partials are merged by the key alone. Which keys are heavy is found by a frequent-items sketch over
all rows, whose state and result are bounded by the share asked for and not by the data; the
verdict only steers the salting, never a result.

Defined cases: a null key is a group of its own (``key_value`` null), an empty table gives no rows,
repeated rows count each, columns of other names are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counters of the frequent-items sketch; its error is about 3.5 rows per counter of the rows seen.
SKETCH_ITEMS = 4096
#: Tasks over which one heavy key is spread.
SALTS = 32


@dataclass(frozen=True)
class HeavyKeys:
    """Rows seen and the values that may hold at least ``share`` of them (at most 2 / share values)."""

    total: int
    values: tuple[str, ...]


def heavy_keys(df: DataFrame, columns: Sequence[str], share: float) -> dict[str, HeavyKeys]:
    """Heavy values of several string columns by one pass over ``df``.

    The driver receives at most ``2 / share`` values a column.
    """
    k = min(SKETCH_ITEMS, max(1, int(2 / share)))
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.expr(f"approx_top_k(`{c}`, {k}, {SKETCH_ITEMS})").alias(f"k{i}") for i, c in enumerate(columns)]
    row = df.agg(*aggs).first()
    total = row["n"]
    return {
        c: HeavyKeys(total, tuple(x["item"] for x in row[f"k{i}"] or [] if x["item"] is not None and x["count"] >= share * total / 2))
        for i, c in enumerate(columns)
    }


def salt_of(key: Column, heavy: Sequence[str], spread_by: Column, salts: int = SALTS) -> Column:
    """The salt of a row: spread over ``salts`` for heavy keys, 0 for all others.

    ``spread_by`` is a 64-bit value that differs between rows; a hash, unlike a random number,
    gives a repeated task the same salts again.
    """
    spread = F.pmod(spread_by, F.lit(salts)).cast("int")
    if not heavy:
        return F.lit(0)
    return F.when(key.isin(list(heavy)), spread).otherwise(F.lit(0))


def salted_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    salt: Column,
    partials: Mapping[str, Column],
    merges: Mapping[str, Column],
) -> DataFrame:
    """Two-stage aggregation: ``partials`` by keys and salt, then ``merges`` of them by the keys.

    ``merges`` name columns of ``partials`` and must be decomposable (sum of counts, min of minima).
    A distinct count is decomposable if the salt is a function of the counted column.
    """
    first = df.withColumn("__salt", salt).groupBy(*keys, "__salt").agg(*[c.alias(n) for n, c in partials.items()])
    return first.groupBy(*keys).agg(*[c.alias(n) for n, c in merges.items()])
