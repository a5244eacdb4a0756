"""Mixing of sources to target shares of all tokens.

Texts get a hash-random key and are range-sorted by source and key. Prefix sums of their token
counts are computed over the sorted ranges (sums per range, then within each range), and every
source is cut at its budget; a budget beyond one pass repeats the source in whole epochs first.

The total is the largest at which no source that has tokens must be repeated more often than it
may. Shares of sources without tokens go to the others in proportion. The text at the cut is taken
if that brings the source nearer to its budget, so a source is off by at most half a text.

Defined cases: a text is used in one source only, however often it is stored (that of the lowest
doc_id among the sources that have a target), so no text exceeds the cap by its copies; null and
empty texts have no tokens and are never used; sources without a target (null included) are not
used; targets that are null, not positive or may not repeat take nothing; repeated targets count
once; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.tokenizer import VOCABULARY, count_tokens
from weftgraph.plans.durable import durable

#: Texts of one sorted range.
RANGE_ROWS = 200_000
#: Sources up to which targets and range sums are broadcast.
BROADCAST_ROWS = 50_000


def targets_of(mix_targets: DataFrame) -> DataFrame:
    t = mix_targets.filter("source is not null and target_share > 0 and max_repeats > 0")
    return t.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))


def sized_texts(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(source, doc_id, n_tokens): every distinct text once, with its size in tokens."""
    near = F.broadcast(targets.select("source")) if targets.count() <= BROADCAST_ROWS else targets.select("source")
    rows = documents.filter(F.length("text") > 0).join(near, "source", "left_semi")
    # sizes and keys are made where the texts are read, so no text is shuffled
    sized = count_tokens(rows.select("doc_id", "source", F.sha2("text", 256).alias("text_key"), "text"), vocabulary=vocabulary)
    return sized.groupBy("text_key").agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("x")).select("x.source", "x.doc_id", "x.n_tokens").dropDuplicates(["doc_id", "source"])


def mix(documents: DataFrame, mix_targets: DataFrame, vocabulary: str = VOCABULARY, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """The uses (source, doc_id, n_tokens, uses) of the chosen texts, and the report per source."""
    targets = durable(targets_of(mix_targets), "targets")
    texts = durable(sized_texts(documents, targets, vocabulary), "texts")
    sizes = texts.groupBy("source").agg(F.sum("n_tokens").alias("size"), F.count(F.lit(1)).alias("n_texts"))
    per = targets.join(sizes, "source", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    everything = Window.partitionBy(F.lit(1))  # one row per source that has a target
    has = F.col("size") > 0
    share = F.when(has, F.col("target_share") / F.sum(F.when(has, F.col("target_share"))).over(everything)).otherwise(F.lit(0.0))
    per = per.withColumn("share", share)
    per = per.withColumn("total", F.min(F.when(has, F.col("max_repeats") * F.col("size") / F.col("share"))).over(everything))
    budget = F.least(F.floor(F.col("total") * F.col("share")), F.col("max_repeats") * F.col("size"))
    per = per.withColumn("budget", F.when(has, budget).otherwise(F.lit(0)).cast("long"))
    per = per.withColumn("epochs", F.when(has, F.floor(F.col("budget") / F.col("size"))).otherwise(F.lit(0)).cast("long"))
    per = durable(per.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("size")), "budgets")

    n = texts.count()
    ranges = max(1, -(-n // RANGE_ROWS))
    keyed = texts.withColumn("key", F.xxhash64(F.lit(seed), "doc_id"))
    ordered = keyed.repartitionByRange(ranges, "source", "key", "doc_id") if ranges > 1 else keyed.coalesce(1)
    ordered = durable(ordered.withColumn("range_no", F.spark_partition_id()), "ordered")
    sums = ordered.groupBy("source", "range_no").agg(F.sum("n_tokens").alias("in_range"))
    before = F.sum("in_range").over(Window.partitionBy("source").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("source", "range_no", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("source", "range_no").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    if ranges + per.count() <= BROADCAST_ROWS:
        offsets, near = F.broadcast(offsets), F.broadcast(per)
    else:
        near = per
    summed = ordered.withColumn("upto", inside).join(offsets, ["source", "range_no"]).join(near.select("source", "epochs", "rest"), "source")
    middle = F.col("before") + F.col("upto") - F.col("n_tokens") / 2
    uses = F.col("epochs") + F.when(middle <= F.col("rest"), F.lit(1)).otherwise(F.lit(0))
    chosen = summed.withColumn("uses", uses.cast("long")).filter("uses > 0").select("source", "doc_id", "n_tokens", "uses")
    return chosen, per


def epochs_of(chosen: DataFrame) -> DataFrame:
    """One row per use of a text: (source, epoch, doc_id, n_tokens), epochs from 1."""
    return chosen.select("source", F.explode(F.sequence(F.lit(1).cast("long"), "uses")).alias("epoch"), "doc_id", "n_tokens")


def shares(chosen: DataFrame, per: DataFrame) -> DataFrame:
    """Target and actual share of every source that has a target."""
    used = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("used_tokens"), F.count(F.lit(1)).alias("used_texts"), F.max("uses").alias("most_uses"))
    zero = F.lit(0).cast("long")
    r = per.join(used, "source", "left").select("source", "target_share", "max_repeats", F.col("size").cast("long").alias("source_tokens"), "budget", *[F.coalesce(c, zero).alias(c) for c in ("used_tokens", "used_texts", "most_uses")])
    return r.withColumn("actual_share", F.round(F.col("used_tokens") / F.sum("used_tokens").over(Window.partitionBy(F.lit(1))), 6))
