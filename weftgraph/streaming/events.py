"""Event streams: late-tolerant windowed counts, and misuse of an object as its events arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftgraph.operators.lifetime import STATE_OF

FINDINGS = "user_id long, event_id long, finding string"


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n): events per window; what comes later than ``late`` is left out."""
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return e.groupBy(F.window("at", size), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    freed = state.get[0] if state.exists else False
    rows = []
    for b in batches:
        for e in b.sort_values(["ts", "event_id"]).itertuples():
            s = STATE_OF.get(e.event_type)
            if s == "alloc":
                freed = False
            elif s == "free":
                if freed:
                    rows.append((key[0], e.event_id, "double-free"))
                freed = True
            elif s == "use" and freed:
                rows.append((key[0], e.event_id, "use-after-free"))
    state.update((freed,))
    yield pd.DataFrame(rows, columns=["user_id", "event_id", "finding"])


def stream_misuses(events: DataFrame) -> DataFrame:
    """Findings as in the batch operator, for events that arrive in order; the state is one flag a key."""
    return events.select("user_id", "event_id", "ts", "event_type").groupBy("user_id").applyInPandasWithState(_advance, FINDINGS, "freed boolean", "append", GroupStateTimeout.NoTimeout)
