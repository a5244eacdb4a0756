"""Typestate over ordered event tables; ids and budgets of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What an event means for the object of its user.
STATE_OF = {"signup": "alloc", "purchase": "free", "view": "use", "click": "use", "error": "escape"}


def state_of(event_type: Column) -> Column:
    return F.coalesce(*[F.when(event_type == e, s) for e, s in STATE_OF.items()])


def leaks(events: DataFrame) -> DataFrame:
    """(user_id, leaks): allocated, never freed, never escaped."""
    s = state_of(F.col("event_type"))
    g = events.groupBy("user_id").agg(F.count_if(s == "alloc").alias("a"), F.count_if(s == "free").alias("f"), F.count_if(s == "escape").alias("e"))
    return g.select("user_id", ((F.col("a") > 0) & (F.col("f") == 0) & (F.col("e") == 0)).alias("leaks"))


def misuses(events: DataFrame) -> DataFrame:
    """(user_id, event_id, finding): frees of what is free already and uses after a free; an allocation clears."""
    s = state_of(F.col("event_type"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    life = F.count_if(F.col("s") == "alloc").over(w)
    e = events.select("user_id", "event_id", "ts", s.alias("s")).withColumn("life", life)
    inside = Window.partitionBy("user_id", "life").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    freed = F.coalesce(F.max(F.col("s") == "free").over(inside), F.lit(False))
    finding = F.when((F.col("s") == "free") & F.col("freed"), "double-free").when((F.col("s") == "use") & F.col("freed"), "use-after-free")
    return e.withColumn("freed", freed).select("user_id", "event_id", finding.alias("finding")).filter("finding is not null")


def capsule_id(claim: Column, entry: Column, effect: Column) -> Column:
    """A finding's id, made of what it says."""
    return F.concat(F.lit("cap_"), F.substring(F.sha2(F.to_json(F.struct(claim.alias("claim"), entry.alias("entry"), effect.alias("effect"))), 256), 1, 16))


def fit_budget(rows: DataFrame, section: str, order: list, text: str, budget: int) -> DataFrame:
    """The first rows of each section whose running length stays within the budget, and whether it was cut."""
    w = Window.partitionBy(section).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy(section)
    sized = rows.withColumn("running", F.sum(F.length(text)).over(w))
    return sized.withColumn("truncated", F.max("running").over(every) > budget).filter(F.col("running") <= budget)
