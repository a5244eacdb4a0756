"""References to records that do not exist.

References and parent keys are partitioned alike and sorted by key; a merge of the two sorted
streams (Spark's sort-merge join, asked for by hint) sets each reference against the validity
interval of its parent. References of heavy keys are salted, and their one parent row repeated for
every salt, so a key with a third of all references is merged by many tasks.

Defined cases: a null reference is no reference; ids are compared exactly (case, blanks); a parent
with no recorded time always existed; without a retired time it lives on; several retired times
count as the first of them; an undated reference can only be ``missing``; empty tables are allowed;
repeated references count each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.skew import SALTS, heavy_keys, salt_of

#: Rows of the table of always existing ids up to which it is broadcast (about 10 MB).
BROADCAST_ROWS = 100_000
#: Share of the references from which a key is salted.
SALT_SHARE = 0.005


def validity(nodes: DataFrame) -> DataFrame:
    """(ref_id, first_at, retired_at): one validity interval per id; exact copies and later deliveries fold in."""
    return (
        nodes.filter(F.col("id").isNotNull())
        .groupBy(F.col("id").alias("ref_id"))
        .agg(F.min("recorded_at").alias("first_at"), F.min("retired_at").alias("retired_at"))
    )


def edge_references(edges: DataFrame) -> DataFrame:
    """(row_id, side, ref_id, at): two rows for each edge with both ends non-null."""
    ends = F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("ref_id")) for s in ("src", "dst")])
    return edges.select("row_id", F.col("recorded_at").alias("at"), F.explode(ends).alias("e")).select("row_id", "e.side", "e.ref_id", "at").filter(F.col("ref_id").isNotNull())


def orphans(refs: DataFrame, nodes: DataFrame, always: DataFrame) -> DataFrame:
    """(row_id, side, ref_id, at, cause) of the references whose record is missing, late or deleted.

    ``always`` holds the ids that exist at every time. If it is small (counted first) its
    references leave by a broadcast anti join before anything is shuffled, else by a shuffled one.
    """
    known = always.select(F.col("id").alias("ref_id")).filter(F.col("ref_id").isNotNull()).distinct()
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    open_refs = refs.join(known, "ref_id", "left_anti")
    hot = heavy_keys(open_refs.select("ref_id"), ["ref_id"], SALT_SHARE)["ref_id"].values
    open_refs = open_refs.withColumn("salt", salt_of(F.col("ref_id"), hot, F.xxhash64("row_id", "side")))
    parents = validity(nodes)
    if hot:
        copies = F.when(F.col("ref_id").isin(list(hot)), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        parents = parents.withColumn("salt", F.explode(copies))
        keys = ["ref_id", "salt"]
    else:
        keys = ["ref_id"]
    merged = open_refs.join(parents.withColumn("found", F.lit(True)).hint("merge"), keys, "left")
    cause = (
        F.when(F.col("found").isNull(), "missing")
        .when(F.col("first_at") > F.col("at"), "late")
        .when(F.col("retired_at") <= F.col("at"), "deleted")
    )
    return merged.select("row_id", "side", "ref_id", "at", cause.alias("cause")).filter(F.col("cause").isNotNull())


def orphan_report(found: DataFrame, refs: DataFrame) -> DataFrame:
    """(side, month, cause, n_refs): orphans and all references per end and month; month null if undated.

    ``cause`` is ``any`` for the count of all references.
    """
    month = F.date_format("at", "yyyy-MM")
    one = found.select("side", month.alias("month"), "cause").groupBy("side", "month", "cause").agg(F.count(F.lit(1)).alias("n_refs"))
    every = refs.select("side", month.alias("month")).groupBy("side", "month").agg(F.count(F.lit(1)).alias("n_refs"))
    return one.unionByName(every.withColumn("cause", F.lit("any")).select("side", "month", "cause", "n_refs"))
