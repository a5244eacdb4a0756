"""Parent-child links to full hierarchies by fragment contraction.

1. Links fold to one row per child; children with several parents are set apart.
2. Links are range-partitioned by a locality column and child, so a fragment holds neighbouring
   links and a hot locality value is cut over many fragments. In each fragment pointer doubling
   contracts every parent chain to the fragment's exit, with the hops and the smallest id passed;
   a chain without exit ends in a local cycle.
3. Exits that are children elsewhere, and children with several parents, form the smaller quotient
   graph. Chains that ended in a local cycle hang there from a mark of that cycle. It is solved by
   the same steps until one bounded task can solve it, where strongly connected parts show the
   cycles that cross fragments. A quotient beyond that bound in which no node has a single parent,
   or that ``LEVELS`` levels have not solved, is solved over all tasks: strongly connected parts by
   colouring, what hangs below them by falling least ids, the rest by falling depths.
4. Fragment rows are joined with the solution of their exits.

Defined cases: links with a null end do not count; repeated links count once; a link to itself is a
cycle; a node on or below a cycle has depth -1 and as root the smallest id on the cycles above it;
a node with several parents and no cycle above takes the least depth, then the smallest root; an
empty table gives no rows. Ids are compared exactly. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.durable import durable
from weftgraph.plans.fixpoint import fixpoint

#: Links of one fragment.
FRAGMENT_ROWS = 50_000
#: Links of a quotient graph that one task solves.
QUOTIENT_ROWS = 500_000
#: Levels of quotients; what is left then, or has no child with a single parent, is solved as a general graph.
LEVELS = 25
#: Rows of a solved quotient up to which it is broadcast for the expansion (about 10 MB).
BROADCAST_ROWS = 50_000
#: Copies of the solved exits among which the rows of one exit are spread when both sides shuffle.
EXPAND_SALTS = 16

#: What the ids of marks start with: they stand for local cycles in the quotients above.
MARK = "\x00cycle"

CONTRACTED = "child string, exit string, hops long, low string, cycle_low string, on_cycle boolean, path array<string>"
SOLVED = "node string, root string, depth long, cycle_low string, on_cycle boolean, path array<string>"


def contract_fragment(child: pa.Array, parent: pa.Array, hops: np.ndarray, low: pa.Array, steps: list | None) -> pa.RecordBatch:
    """Contract the parent chains of one fragment, in which every child has one parent.

    ``steps`` are the ids below the parent down to the child that a link stands for (None: no paths wanted).
    """
    n = len(child)
    nxt = pc.fill_null(pc.index_in(parent, value_set=child), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    parent_of = nxt.copy()
    order = pc.sort_indices(low).to_numpy()
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    hop, last, least = hops.astype(np.int64), np.arange(n), rank
    for _ in range(max(1, int(n - 1).bit_length()) + 1):
        inner = np.flatnonzero(nxt >= 0)
        if not len(inner):
            break
        to = nxt[inner]
        new_hop, new_last, new_least, new_next = hop[inner] + hop[to], last[to], np.minimum(least[inner], least[to]), nxt[to]
        hop, last, least = hop.copy(), last.copy(), least.copy()
        hop[inner], last[inner], least[inner], nxt[inner] = new_hop, new_last, new_least, new_next
    loops = nxt >= 0  # after more steps than there are nodes: nxt is on a cycle
    on_cycle = np.zeros(n, bool)
    on_cycle[nxt[loops]] = True
    hop[loops] = 0
    low_at = lambda at, where: pc.take(low, pa.array(order[at], mask=~where))
    paths = None
    if steps is not None:
        paths = [None] * n
        for i in np.lexsort((hop,)):
            if not loops[i]:
                up = parent_of[i]
                paths[i] = (paths[up] if up >= 0 else []) + list(steps[i])
    return pa.RecordBatch.from_arrays(
        [
            child,
            pc.take(parent, pa.array(last, mask=loops)),
            pa.array(hop),
            low_at(least, ~loops),
            low_at(least[np.where(loops, nxt, 0)], loops),
            pa.array(on_cycle),
            pa.array(paths if paths is not None else [None] * n, pa.list_(pa.string())),
        ],
        names=["child", "exit", "hops", "low", "cycle_low", "on_cycle", "path"],
    )


def _contract(with_paths: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if parts:
            t = pa.Table.from_batches(parts).combine_chunks()
            col = lambda c: t[c].combine_chunks() if isinstance(t[c], pa.ChunkedArray) else t[c]
            out = contract_fragment(col("child"), col("parent"), col("hops").to_numpy(), col("low"), t["steps"].to_pylist() if with_paths else None)
            for at in range(0, out.num_rows, 10_000):
                yield out.slice(at, 10_000)

    return run


def solve_quotient(rows: list[tuple]) -> list[tuple]:
    """Solve links (child, parent, hops, low, cycle_low, steps) of any shape; parent null: the chain ends in a cycle.

    Returns (node, root, depth, cycle_low, on_cycle, path) per child.
    """
    ids: dict[str, int] = {}
    for r in rows:
        ids.setdefault(r[0], len(ids))
    names = list(ids)
    up: list[list[tuple]] = [[] for _ in names]
    for r in rows:
        up[ids[r[0]]].append(r)
    inner = [[ids[r[1]] for r in links if r[1] in ids] for links in up]
    # Strongly connected parts come out parents first, as the links point to the parents (Tarjan, without recursion).
    number = [-1] * len(names)
    lowest = [0] * len(names)
    part_of = [-1] * len(names)
    stack: list[int] = []
    parts: list[list[int]] = []
    count = 0
    for start in range(len(names)):
        if number[start] >= 0:
            continue
        work = [(start, 0)]
        while work:
            v, k = work.pop()
            if k == 0:
                number[v] = lowest[v] = count
                count += 1
                stack.append(v)
            if k < len(inner[v]):
                work.append((v, k + 1))
                w = inner[v][k]
                if number[w] < 0:
                    work.append((w, 0))
                elif part_of[w] < 0:
                    lowest[v] = min(lowest[v], number[w])
                continue
            if lowest[v] == number[v]:
                part = []
                while True:
                    w = stack.pop()
                    part_of[w] = len(parts)
                    part.append(w)
                    if w == v:
                        break
                parts.append(part)
            if work:
                u = work[-1][0]
                lowest[u] = min(lowest[u], lowest[v])
    out: list[tuple] = [()] * len(names)
    for part in parts:
        members = set(part)
        looped = len(part) > 1 or part[0] in inner[part[0]]
        lows, best = [], None
        for v in part:
            for child, parent, hops, low, cycle_low, steps in up[v]:
                to = ids.get(parent) if parent is not None else None
                if parent is None:
                    lows.append(cycle_low)
                elif to in members:
                    lows.append(low)
                elif to is not None and out[to][3] is not None:
                    lows.append(out[to][3])
                elif not looped:
                    root, depth, path = (out[to][1], out[to][2], out[to][5]) if to is not None else (parent, 0, [parent])
                    found = (depth + hops, root, (path + list(steps)) if steps is not None and path is not None else None)
                    best = found if best is None or found[:2] < best[:2] else best
        for v in part:
            out[v] = (names[v], min(lows), -1, min(lows), looped, None) if lows else (names[v], best[1], best[0], None, False, best[2])
    return out


def _solve_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [tuple(r.values()) for b in batches for r in b.to_pylist()]
    if rows:
        done = solve_quotient(rows)
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=["node", "root", "depth", "cycle_low", "on_cycle", "path"])


def _solve_spread(quotient: DataFrame, paths: bool) -> DataFrame:
    """What :func:`solve_quotient` gives, for links of any number and shape, by joins over all tasks."""
    from weftgraph.operators.traverse import strong_components

    nodes = durable(quotient.select(F.col("child").alias("node")).distinct(), "quotient-nodes")
    inner = durable(quotient.filter(F.col("parent").isNotNull()).join(nodes.withColumnRenamed("node", "parent"), "parent", "left_semi").select("child", "parent", "hops", "low", "steps"), "inner")
    part = durable(strong_components(inner.select(F.col("child").alias("a"), F.col("parent").alias("b"))), "parts")
    of = lambda c: part.select(F.col("id").alias(c), F.col("component").alias(f"{c}_part"))
    looped = inner.join(of("child"), "child").join(of("parent"), "parent").filter("child_part = parent_part").groupBy(F.col("child_part").alias("component")).agg(F.min("low").alias("least"))
    on = durable(part.join(looped, "component").select(F.col("id").alias("node"), F.col("least").alias("low")), "on-cycles")
    ended = quotient.filter(F.col("parent").isNull()).select(F.col("child").alias("node"), F.col("cycle_low").alias("low"))
    down = inner.select(F.col("parent").alias("node"), "child").distinct()
    caught, _ = fixpoint(on.unionByName(ended), lambda f: f.join(down, "node").select(F.col("child").alias("node"), "low"), ["node"], falling="low")
    caught = durable(caught.groupBy("node").agg(F.min("low").alias("low")), "caught")
    caught = caught.join(on.select("node", F.lit(True).alias("on")), "node", "left")

    sound = durable(quotient.filter(F.col("parent").isNotNull()).join(caught.select(F.col("node").alias("child")), "child", "left_anti"), "sound")
    steps = (lambda before: F.concat(before, "steps")) if paths else (lambda before: F.lit(None).cast("array<string>"))
    tops = sound.join(nodes.withColumnRenamed("node", "parent"), "parent", "left_anti")
    best = lambda depth, root, path: F.struct(depth.alias("depth"), root.alias("root"), path.alias("path")).alias("best")
    start = tops.select(F.col("child").alias("node"), best(F.col("hops"), F.col("parent"), steps(F.array("parent"))))
    step = lambda f: f.join(sound, f["node"] == sound["parent"]).select(F.col("child").alias("node"), best(F.col("best.depth") + F.col("hops"), F.col("best.root"), steps(F.col("best.path"))))
    found, _ = fixpoint(start, step, ["node"], falling="best")
    found = found.groupBy("node").agg(F.min("best").alias("best"))
    none = F.lit(None).cast("array<string>")
    return found.select("node", "best.root", "best.depth", F.lit(None).cast("string").alias("cycle_low"), F.lit(False).alias("on_cycle"), F.col("best.path").alias("path")).unionByName(
        caught.select("node", F.col("low").alias("root"), F.lit(-1).cast("long").alias("depth"), F.col("low").alias("cycle_low"), F.coalesce("on", F.lit(False)).alias("on_cycle"), none.alias("path"))
    )


def _doubled(single: DataFrame) -> DataFrame:
    """One round of pointer doubling by a join, for a quotient that fragments no longer shrink."""
    p = single.select(*[F.col(c).alias(f"p_{c}") for c in ("child", "parent", "hops", "low", "steps")])
    j = single.join(p, (F.col("parent") == F.col("p_child")) & (F.col("p_child") != F.col("child")), "left")
    return durable(
        j.select(
            "child",
            F.coalesce("p_parent", "parent").alias("parent"),
            (F.col("hops") + F.coalesce("p_hops", F.lit(0))).alias("hops"),
            F.least("low", "p_low").alias("low"),
            F.when(F.col("p_child").isNull(), F.col("steps")).otherwise(F.concat("p_steps", "steps")).alias("steps"),
            "locality",
        ),
        "doubled",
    )


def _solve(links: DataFrame, paths: bool, level: int = 0) -> DataFrame:
    """Solve links (child, parent, hops, low, steps, locality): a row (node, root, depth, ...) per node."""
    folded = durable(
        links.groupBy("child").agg(
            F.min("parent").alias("parent"),
            F.max("parent").alias("other"),
            F.min(F.struct("hops", "low", "steps")).alias("x"),
            F.min("low").alias("low"),
            F.min("locality").alias("locality"),
        ),
        "folded",
    )
    several = F.col("parent") != F.col("other")
    n, n_several, n_marks = folded.agg(F.count(F.lit(1)), F.count_if(several), F.count_if(F.col("child").startswith(MARK))).first()
    single = folded.filter(~several).select("child", "parent", "x.hops", "low", "x.steps", "locality")
    fragments = max(1, -(-(n - n_several) // FRAGMENT_ROWS))
    placed = single.repartitionByRange(fragments, "locality", "child") if fragments > 1 else single.coalesce(1)
    contracted = durable(placed.select("child", "parent", "hops", "low", "steps").mapInArrow(_contract(paths), CONTRACTED), "contracted")

    exits = contracted.filter(F.col("exit").isNotNull()).select(F.col("exit").alias("node")).distinct()
    if n_several:
        heads = links.join(folded.filter(several).select("child"), "child", "left_semi").select("child", "parent", "hops", "low", "steps").distinct()
        c = contracted.select(F.col("child").alias("parent"), "exit", F.col("hops").alias("c_hops"), F.col("low").alias("c_low"), "cycle_low", F.col("path").alias("c_path"))
        up = heads.join(c, "parent", "left")
        ended = F.col("cycle_low").isNotNull()
        head_links = durable(
            up.select(
                "child",
                F.when(~ended | F.col("cycle_low").isNull(), F.coalesce("exit", "parent")).alias("parent"),
                (F.col("hops") + F.coalesce("c_hops", F.lit(0))).alias("hops"),
                F.least("low", "c_low").alias("low"),
                "cycle_low",
                F.when(F.col("c_path").isNull(), F.col("steps")).otherwise(F.concat("c_path", "steps")).alias("steps"),
            ),
            "heads",
        )
        exits = exits.unionByName(head_links.filter(F.col("parent").isNotNull()).select(F.col("parent").alias("node"))).distinct()
    exits = durable(exits, "exits")
    n_exits = exits.count()
    near = F.broadcast(exits) if n_exits <= BROADCAST_ROWS else exits
    quotient = contracted.join(near.withColumnRenamed("node", "child"), "child", "left_semi").select("child", F.col("exit").alias("parent"), "hops", "low", "cycle_low", F.col("path").alias("steps"))
    if n_several:
        quotient = quotient.unionByName(head_links)
    quotient = durable(quotient, "quotient")
    m = quotient.count()
    if m <= QUOTIENT_ROWS:
        solved = durable(quotient.coalesce(1).mapInArrow(_solve_task, SOLVED), "solved")
    elif n_several + n_marks == n or level >= LEVELS:
        solved = durable(_solve_spread(quotient, paths), "solved")
    else:
        # A chain that ended in a local cycle hangs from a mark, a cycle of one whose least id is that of the
        # cycle it stands for; the next quotient finds it like any other cycle, wherever its children are.
        mark = F.concat(F.lit(f"{MARK}{level}:"), "cycle_low")
        step = lambda c: F.array(c) if paths else F.lit(None).cast("array<string>")
        ended = quotient.filter(F.col("parent").isNull()).select("child", mark.alias("parent"), F.lit(1).cast("long").alias("hops"), F.col("cycle_low").alias("low"), step("child").alias("steps")).distinct()
        marks = ended.select(F.col("parent").alias("child"), "parent", "hops", "low", step("parent").alias("steps")).distinct()
        below = quotient.filter(F.col("parent").isNotNull()).select("child", "parent", "hops", "low", "steps")
        rest = below.unionByName(ended).unionByName(marks).withColumn("locality", F.xxhash64(F.lit(level), "parent").cast("string"))
        if m > 0.7 * n:
            heads_only = rest.groupBy("child").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("child")
            lone = rest.join(heads_only, "child", "left_anti")
            rest = _doubled(lone).unionByName(rest.join(heads_only, "child", "left_semi"))
        s = _solve(rest, paths, level + 1)
        own = (F.col("depth") != 0) & ~F.col("node").startswith(f"{MARK}{level}:")  # roots of the quotient are no children of it
        solved = durable(s.filter(own), "solved")

    roots = exits.join(solved.select("node"), "node", "left_anti").select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("cycle_low"), F.lit(False).alias("on_cycle"), F.when(F.lit(paths), F.array("node")).alias("path"))
    of_exit = solved.select(F.col("node").alias("exit"), F.col("root").alias("e_root"), F.col("depth").alias("e_depth"), F.col("cycle_low").alias("e_low"), F.col("path").alias("e_path"))
    if m <= BROADCAST_ROWS and not paths:
        j = contracted.join(F.broadcast(of_exit), "exit", "left")
    else:
        copies = of_exit.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(EXPAND_SALTS - 1))))
        j = contracted.withColumn("salt", F.pmod(F.xxhash64("child"), F.lit(EXPAND_SALTS)).cast("int")).join(copies, ["exit", "salt"], "left")
    low = F.coalesce("cycle_low", "e_low")
    expanded = j.select(
        F.col("child").alias("node"),
        F.coalesce(low, "e_root", "exit").alias("root"),
        F.when(low.isNotNull(), F.lit(-1)).otherwise(F.col("hops") + F.coalesce("e_depth", F.lit(0))).cast("long").alias("depth"),
        low.alias("cycle_low"),
        "on_cycle",
        (F.when(low.isNull(), F.concat(F.coalesce("e_path", F.array("exit")), "path")) if paths else F.lit(None).cast("array<string>")).alias("path"),
    )
    if n_several:
        heads_done = solved.join(folded.filter(several).select(F.col("child").alias("node")), "node", "left_semi")
        expanded = expanded.unionByName(heads_done)
    return expanded.unionByName(roots)


def resolve_links(links: DataFrame, paths: bool = False) -> DataFrame:
    """(node, root, depth, cycle_low, on_cycle, path) per end of the links (child, parent, locality).

    ``on_cycle`` is exact for local cycles and heads of crossing ones; :func:`cycle_members` tells
    the rest. ``path`` runs from root to node, null on and below cycles or without ``paths``.
    """
    clean = links.filter(F.col("child").isNotNull() & F.col("parent").isNotNull())
    steps = F.array("child") if paths else F.lit(None).cast("array<string>")
    return _solve(clean.select("child", "parent", F.lit(1).cast("long").alias("hops"), F.col("child").alias("low"), steps.alias("steps"), "locality"), paths)


def cycle_members(links: DataFrame, resolved: DataFrame) -> DataFrame:
    """(node, on_cycle) of every node with depth -1: on a cycle itself, or only below one.

    Nodes from which no marked child hangs are taken away until none is left to take; what stays
    lies on a cycle or between two.
    """
    caught = durable(resolved.filter("depth = -1").select("node"), "caught")
    inner = durable(
        links.select("child", "parent").distinct().join(caught.select(F.col("node").alias("child")), "child", "left_semi").join(caught.select(F.col("node").alias("parent")), "parent", "left_semi"),
        "caught-links",
    )
    left, n = inner, inner.count()
    while n:
        kept = durable(left.join(left.select(F.col("parent").alias("child")).distinct(), "child", "left_semi"), "trimmed")
        k = kept.count()
        if k == n:
            break
        left, n = kept, k
    stays = left.select(F.col("child").alias("node")).distinct().withColumn("on_cycle", F.lit(True))
    return caught.join(stays, "node", "left").select("node", F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"))


def descendants(resolved: DataFrame) -> DataFrame:
    """(ancestor, node, distance): every node below every ancestor, from the paths of the forest's nodes."""
    up = F.slice("path", 1, F.size("path") - 1)
    return resolved.filter(F.col("path").isNotNull() & (F.size("path") > 1)).select("node", F.posexplode(up).alias("at", "ancestor"), "depth").select("ancestor", "node", (F.col("depth") - F.col("at")).alias("distance"))


CONTAINMENT = ("PACKAGE_CONTAINS", "CONTAINS", "CONTAINS_BODY", "AST_CHILD")


def containment_links(edges: DataFrame) -> DataFrame:
    """(child, parent, locality) of the containment edges, by semantic kind where there is one."""
    kind = F.coalesce("semantic_kind", "kind")
    return edges.filter(kind.isin(*CONTAINMENT)).select(F.col("dst").alias("child"), F.col("src").alias("parent"), F.col("unit").alias("locality"))
