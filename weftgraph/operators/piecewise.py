"""Walks with matched calls, each connected piece of the graph solved by one task.

A round of a walk over DataFrames costs as much as its bookkeeping, and a recursion takes rounds for
every depth of its stack. So what the seeds reach without regard to calls is found first, by hashes
of the ids; nodes that no link leaves hold nothing together, and the connected pieces of the rest are
solved where they lie. Hashes that meet only make a piece larger. Seeds of a piece of more than
``LINKS`` links, or whose walk takes more than ``STATES`` states, are handed back to the caller.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.traverse import components
from weftgraph.plans.durable import durable
from weftgraph.plans.fixpoint import fixpoint

#: Links of a piece, and states of one seed's walk, that a task takes on.
LINKS = 200_000
STATES = 500_000
#: Steps that one round of the search for what is reached takes.
STEPS = 3
#: Rows that a task sends at once.
ROWS = 20_000
WAY = "seed string, node string, round int, p_node string, path array<string>"
WALKED = "seed string, a string, b string, push string, pop string"


def pieces(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """(piece, seed, a, b, push, pop, left): the seeds (id) and the links (a, b, push, pop, left) they reach, by piece; a row is one or the other."""
    hashed = durable(links.select("*", F.xxhash64("a").alias("ha"), F.xxhash64("b").alias("hb")), "hashed")
    on = durable(hashed.select(F.col("hb").alias("b"), F.col("ha").alias("a")).distinct().join(hashed.select(F.col("ha").alias("b")).distinct(), "b", "left_semi").select("a", "b"), "on")

    def step(found: DataFrame) -> DataFrame:
        every, at = None, found
        for _ in range(STEPS):
            at = at.join(on, at["node"] == on["a"]).select(F.col("b").alias("node")).distinct()
            every = at if every is None else every.unionByName(at)
        return every

    s = durable(seeds.select(F.col("id").alias("seed"), F.xxhash64("id").alias("node")).distinct(), "seeds")
    found, _ = fixpoint(s.select("node"), step, ["node"])
    met = durable(hashed.join(found.select(F.col("node").alias("ha")), "ha", "left_semi"), "met")
    inner = met.join(met.select(F.col("ha").alias("hb")).distinct(), "hb", "left_semi").select(F.col("ha").alias("a"), F.col("hb").alias("b"))
    part = durable(components(inner), "pieces")
    of = lambda df, key: df.join(part.withColumnRenamed("id", key), key, "left").withColumn("piece", F.coalesce("component", key))
    null = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    link = of(met, "ha").select("piece", *null("seed"), "a", "b", "push", "pop", "left")
    return durable(link.unionByName(of(s, "node").select("piece", "seed", *null("a", "b", "push", "pop"), F.lit(None).cast("boolean").alias("left"))), "by-piece")


def _seed_walk(seed: str, adj: dict[str, list], most: int, descend: bool, walked: set | None) -> dict[tuple[str, bool], tuple] | None:
    """The first arrivals of a walk by node and whether a step was taken, as (round, state); None if there are too many states.

    A state is (node, stack, depth, state before); of several arrivals in a round the least (depth, node, stack, depth before) stays.
    """
    start = (seed, (), 0, None)
    known, now, n = {(seed, ()): 0}, [start], 0
    first = {(seed, False): (0, start)}
    while now:
        n += 1
        new: dict[tuple, tuple] = {}
        for state in now:
            node, stack, depth, _ = state
            for link in adj.get(node, ()):
                _, b, push, pop, left = link
                s, d = stack, depth
                if push is not None:
                    if depth >= most:
                        continue
                    s, d = ((*stack, push) if left else ()), depth + 1
                elif pop is not None:
                    if not (stack and stack[-1] == pop or descend and depth == 0):
                        continue
                    s, d = stack[:-1], max(depth - 1, 0)
                if walked is not None:
                    walked.add(link[:4])
                key = (b, s)
                have = known.get(key)
                if have is not None and have <= d:
                    continue
                other = new.get(key)
                if other is None or (d, node, stack, depth) < (other[2], *other[3][:3]):
                    new[key] = (b, s, d, state)
        now = list(new.values())
        for state in now:
            known[state[:2]] = state[2]
            at = (state[0], True)
            have = first.get(at)
            if have is None or have[0] == n and state[1] < have[1][1]:
                first[at] = (n, state)
        if len(known) > STATES:
            return None
    return first


def _path(state: tuple | None) -> list[str]:
    out = []
    while state is not None:
        out.append(state[0])
        state = state[3]
    return out[::-1]


def _by_piece(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], dict[str, list]]]:
    """Seeds and outgoing links of each piece, whose rows follow one another."""
    rows = (r for b in batches for r in zip(*[b.column(i).to_pylist() for i in range(b.num_columns)]))
    for _, group in groupby(rows, key=lambda r: r[0]):
        seeds, adj = [], {}
        for _, seed, *link in group:
            if seed is not None:
                seeds.append(seed)
            else:
                adj.setdefault(link[0], []).append(tuple(link))
        yield seeds, adj


def _sent(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _ways(most: int, descend: bool, paths: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("seed", pa.string()), ("node", pa.string()), ("round", pa.int32()), ("p_node", pa.string()), ("path", pa.list_(pa.string()))])

    def rows(batches):
        for seeds, adj in _by_piece(batches):
            for seed in seeds:
                first = _seed_walk(seed, adj, most, descend, None)
                if first is None:
                    yield seed, None, None, None, None
                    continue
                for (node, _), (n, state) in first.items():
                    yield seed, node, n, state[3][0] if state[3] else None, _path(state) if paths else None

    return lambda batches: _sent(rows(batches), schema)


def _walked(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([(n, pa.string()) for n in ("seed", "a", "b", "push", "pop")])

    def rows(batches):
        for seeds, adj in _by_piece(batches):
            every: set[tuple] = set()
            for seed in seeds:
                own: set[tuple] = set()
                if _seed_walk(seed, adj, most, False, own) is None:
                    yield seed, None, None, None, None
                else:
                    every |= own
            for link in every:
                yield (None, *link)

    return lambda batches: _sent(rows(batches), schema)


def _solve(by_piece: DataFrame, task: Callable, shape: str) -> tuple[DataFrame, DataFrame | None]:
    spark = by_piece.sparkSession
    large = durable(by_piece.groupBy("piece").agg(F.count("a").alias("n")).filter(F.col("n") > LINKS).select("piece"), "large")
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    small = by_piece.join(large, "piece", "left_anti").select("piece", "seed", "a", "b", "push", "pop", "left")
    rows = durable(small.repartition(parts, "piece").sortWithinPartitions("piece").mapInArrow(task, shape), "solved")
    left = by_piece.filter("seed is not null").join(large, "piece", "left_semi").select(F.col("seed").alias("id"))
    left = left.unionByName(rows.filter("seed is not null and node is null" if "node" in rows.columns else "seed is not null").select(F.col("seed").alias("id")))
    left = durable(left, "left")
    return rows.filter("node is not null" if "node" in rows.columns else "seed is null"), None if left.isEmpty() else left


def ways(by_piece: DataFrame, most: int, descend: bool = False, paths: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(seed, node, round, p_node, path) of the first arrival of each walk at each node, the seed at round 0 and once more if it is met again; and the seeds (id) that are left."""
    return _solve(by_piece, _ways(most, descend, paths), WAY)


def walked(by_piece: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """(a, b, push, pop) of every link that some walk takes; and the seeds (id) that are left."""
    rows, left = _solve(by_piece, _walked(most), WALKED)
    return rows.select("a", "b", "push", "pop").distinct(), left
