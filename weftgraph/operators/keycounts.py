"""Results per key where a few keys hold most records (two-stage salted aggregation)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.skew import HeavyKeys, heavy_keys, salt_of, salted_aggregate

#: Share of a table's rows from which a value counts as heavy.
HEAVY_SHARE = 0.025


def key_rows(df: DataFrame, table_name: str, fields: list[str], row_hash) -> tuple[DataFrame, dict[str, HeavyKeys]]:
    """One row (table_name, field, key_value, salt) per row of ``df`` and field, and the heavy values."""
    heavy = heavy_keys(df, fields, HEAVY_SHARE)
    items = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("key_value"), salt_of(F.col(f), heavy[f].values, row_hash).alias("salt")) for f in fields])
    long = df.select(F.explode(items).alias("x")).select(F.lit(table_name).alias("table_name"), "x.field", "x.key_value", F.col("x.salt").alias("salt"))
    return long, heavy


def key_counts(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, dict[tuple[str, str], int]]:
    """Rows per value of edges.kind, edges.dst and nodes.kind, and the rows of each table and field.

    Nulls are a value of their own here (``key_value`` null). Repeated rows count each. Empty
    tables give no rows. The totals are two numbers found while the heavy values were looked for.
    """
    e, eh = key_rows(edges.select("kind", "dst", "row_id"), "edges", ["kind", "dst"], F.xxhash64("row_id", "dst"))
    n, nh = key_rows(nodes.select("kind", "id", "recorded_at"), "nodes", ["kind"], F.xxhash64("id", "recorded_at"))
    counts = salted_aggregate(e.unionByName(n), ["table_name", "field", "key_value"], F.col("salt"), {"n": F.count(F.lit(1))}, {"n": F.sum("n")})
    return counts, {("edges", f): h.total for f, h in eh.items()} | {("nodes", f): h.total for f, h in nh.items()}


def heavy_values(edges: DataFrame, nodes: DataFrame, share: float = HEAVY_SHARE) -> DataFrame:
    """(table_name, field, key_value, n): non-null values with at least ``share`` of all stored rows."""
    counts, totals = key_counts(edges, nodes)
    least = F.lit(None).cast("double")
    for (t, f), total in totals.items():
        least = F.when((F.col("table_name") == t) & (F.col("field") == f), F.lit(share * total)).otherwise(least)
    return counts.filter(F.col("key_value").isNotNull() & (F.col("n") >= least))


def edge_profile(edges: DataFrame, field: str) -> DataFrame:
    """Per value of ``field`` of the edges: rows, units, distinct sources, first and last record.

    Null values of ``field`` are left out; null sources and times are not counted. The salt is a
    function of the source id, so the distinct sources of the salts of a key are disjoint and their
    counts can be added.
    """
    heavy = heavy_keys(edges.select(field), [field], HEAVY_SHARE)[field].values
    rows = edges.select(F.col(field).alias("key_value"), "src", "recorded_at").filter(F.col("key_value").isNotNull())
    salt = salt_of(F.col("key_value"), heavy, F.xxhash64("src"))
    per_src = (
        rows.withColumn("salt", salt)
        .groupBy("key_value", "salt", "src")
        .agg(F.count(F.lit(1)).alias("n"), F.min("recorded_at").alias("first_at"), F.max("recorded_at").alias("last_at"))
    )
    merged = salted_aggregate(
        per_src,
        ["key_value"],
        F.col("salt"),
        {"n": F.sum("n"), "n_src": F.count("src"), "first_at": F.min("first_at"), "last_at": F.max("last_at")},
        {"n": F.sum("n"), "n_src": F.sum("n_src"), "first_at": F.min("first_at"), "last_at": F.max("last_at")},
    )
    return merged.select(F.lit(field).alias("field"), "key_value", "n", "n_src", "first_at", "last_at")
