"""Traversals: context-sensitive value flow, closures, components, levels, label propagation."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.durable import durable
from weftgraph.plans.fixpoint import fixpoint

#: Contexts that a walk may be nested in.
CONTEXT_DEPTH = 12


def flow_links(edges: DataFrame, reverse: bool = False) -> DataFrame:
    """(a, b, push, pop): value-flow links with the context they enter or leave."""
    entering = F.when(F.col("reason") == "context-parameter", F.col("context_id"))
    leaving = F.when(F.col("reason") == "context-return", F.col("context_id"))
    usable = ~F.col("reason").isin("context-parameter", "context-return") | F.col("reason").isNull() | F.col("context_id").isNotNull()
    e = edges.filter(F.col("src").isNotNull() & F.col("dst").isNotNull() & usable)
    a, b, push, pop = ("dst", "src", leaving, entering) if reverse else ("src", "dst", entering, leaving)
    return e.select(F.col(a).alias("a"), F.col(b).alias("b"), push.alias("push"), pop.alias("pop")).distinct()


def context_reach(seeds: DataFrame, links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(seed, node, distance): nodes that values of each seed reach, calls matched with their returns.

    A walk is a node with a stack of contexts: entering one pushes it, leaving one needs it on top.
    Below a context that no link leaves nothing can be popped any more, so the stack is kept only
    above the last such one, with the depth of all; of equal stacks a deeper, later one adds nothing.
    """
    left = links.filter("pop is not null").select(F.col("pop").alias("push")).distinct().withColumn("left", F.lit(True))
    links = durable(links.join(left, "push", "left"), "links")

    def step(found: DataFrame) -> DataFrame:
        j = found.join(links, found["node"] == links["a"])
        top = F.when(F.size("stack") > 0, F.element_at("stack", -1))
        ok = F.when(F.col("push").isNotNull(), F.col("depth") < CONTEXT_DEPTH).when(F.col("pop").isNotNull(), top == F.col("pop")).otherwise(True)
        stack = (
            F.when(F.col("push").isNotNull() & F.col("left").isNull(), F.array().cast("array<string>"))
            .when(F.col("push").isNotNull(), F.concat("stack", F.array("push")))
            .when(F.col("pop").isNotNull(), F.slice("stack", F.lit(1), F.greatest(F.size("stack") - 1, F.lit(0))))
            .otherwise(F.col("stack"))
        )
        depth = F.col("depth") + F.when(F.col("push").isNotNull(), 1).when(F.col("pop").isNotNull(), -1).otherwise(0)
        return j.filter(ok).select("seed", F.col("b").alias("node"), stack.alias("stack"), depth.alias("depth"))

    start = seeds.select(F.col("id").alias("seed"), F.col("id").alias("node"), F.array().cast("array<string>").alias("stack"), F.lit(0).alias("depth"))
    found, _ = fixpoint(start, step, ["seed", "node", "stack"], rounds, falling="depth")
    return found.filter(F.col("seed") != F.col("node")).groupBy("seed", "node").agg(F.min("round").cast("long").alias("distance"))


def closure(seeds: DataFrame, links: DataFrame, depth: int | None = None, avoid: DataFrame | None = None) -> DataFrame:
    """(seed, node, distance) over links (a, b), the seed itself at distance 0; never through avoided ids."""
    if avoid is not None:
        links = links.join(avoid.select(F.col("id").alias("b")), "b", "left_anti")
    links = durable(links.select("a", "b").distinct(), "links")
    step = lambda found: found.join(links, found["node"] == links["a"]).select("seed", F.col("b").alias("node"))
    found, _ = fixpoint(seeds.select(F.col("id").alias("seed"), F.col("id").alias("node")), step, ["seed", "node"], depth)
    return found.select("seed", "node", F.col("round").cast("long").alias("distance"))


#: Links of a node from which on it is a hub.
HUB = 1_000
#: Seeds that are sent to the tasks at once.
SEEDS = 50_000


def closure_by_hubs(seeds: DataFrame, links: DataFrame, depth: int) -> DataFrame:
    """As :func:`closure`; what lies behind a hub is found once for all seeds and not carried through the rounds.

    A shortest way that leaves a hub is a way to the first such hub and a shortest way from there. Ways
    that leave no hub are walked for each seed, those from the hubs for each hub. Seeds that meet the same hubs
    at the same distances share a cone, which is joined with them only in the result: its rows are not shuffled.
    """
    links = durable(links.select("a", "b").filter("a is not null and b is not null").distinct(), "links")
    hubs = durable(links.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HUB).select("a"), "hubs")
    start = seeds.select(F.col("id").alias("seed"), F.col("id").alias("node"))
    walk = lambda over: lambda found: found.join(over, found["node"] == over["a"]).select("seed", F.col("b").alias("node"))
    if hubs.isEmpty():
        found, _ = fixpoint(start, walk(links), ["seed", "node"], depth)
        return found.select("seed", "node", F.col("round").cast("long").alias("distance"))
    plain = durable(links.join(F.broadcast(hubs) if hubs.count() <= SEEDS else hubs, "a", "left_anti"), "plain")
    found, _ = fixpoint(start, walk(plain), ["seed", "node"], depth)
    light = durable(found.select("seed", "node", F.col("round").cast("long").alias("distance")), "light")
    met = durable(light.join(hubs.withColumnRenamed("a", "node"), "node", "left_semi").filter(F.col("distance") < depth), "met")

    # around each hub as far as the nearest seed can still go
    rest = met.groupBy("node").agg((F.lit(depth) - F.min("distance")).alias("rest"))
    on = lambda f: f.filter("rest > 0").join(links, f["node"] == links["a"]).select("seed", F.col("b").alias("node"), (F.col("rest") - 1).alias("rest"))
    around, _ = fixpoint(rest.select(F.col("node").alias("seed"), "node", "rest"), on, ["seed", "node"], depth)
    around = around.select(F.col("seed").alias("hub"), "node", F.col("round").cast("long").alias("further"))

    # the hubs that a seed meets, and at what distance, make its cone
    of = durable(met.groupBy("seed").agg(F.array_sort(F.collect_list(F.struct(F.col("node").alias("hub"), "distance"))).alias("hubs")), "seeds")
    kinds = durable(of.select("hubs").distinct().withColumn("cone", F.monotonically_increasing_id()), "kinds")
    of = durable(of.join(kinds, "hubs").select("seed", "cone"), "cone-of")
    cone = kinds.select("cone", F.explode("hubs").alias("x")).select("cone", "x.*").join(around, "hub").filter(F.col("distance") + F.col("further") <= depth)
    cone = cone.groupBy("cone", "node").agg(F.min(F.col("distance") + F.col("further")).alias("there"))
    cone = durable(cone.withColumn("place", F.monotonically_increasing_id()), "cones")

    # a node that is met either way comes once, at the least distance
    both = light.join(of, "seed").join(cone, ["cone", "node"]).select("seed", "node", "place", "there")
    both = durable(both, "both")
    out = light.join(both, ["seed", "node"], "left").select("seed", "node", F.least("distance", "there").alias("distance"))
    own = durable(of.join(both.groupBy("seed").agg(F.collect_list("place").alias("own")), "seed", "left").withColumn("own", F.coalesce("own", F.array().cast("array<bigint>"))), "own")
    turns = -(-own.count() // SEEDS)
    parts = max(links.sparkSession.sparkContext.defaultParallelism, int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))) * 4
    cone = cone.repartition(parts, "place")
    for k in range(turns):
        few = own if turns == 1 else own.filter(F.pmod(F.xxhash64("seed"), F.lit(turns)) == k)
        far = cone.join(F.broadcast(few), "cone").filter(~F.array_contains("own", F.col("place")))
        out = out.unionByName(far.select("seed", "node", F.col("there").alias("distance")))
    return out


def components(links: DataFrame) -> DataFrame:
    """(id, component): connected components of links (a, b), named by their least id.

    Large-star and small-star rounds in turn: every node hooks onto the least neighbour, so the
    rounds grow with the logarithm of the diameter and a hub never gathers its neighbours in one task.
    """
    e = links.filter(F.col("a").isNotNull() & F.col("b").isNotNull()).select("a", "b").filter("a <> b").distinct()
    nodes = links.select(F.explode(F.array("a", "b")).alias("id")).filter(F.col("id").isNotNull()).distinct()
    e, last = durable(e, "star"), None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
        down = durable(down.distinct(), "star")
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").filter("a <> b").distinct()
        e = durable(small, "star")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    own = e.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id")
    return nodes.join(own, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def strong_components(links: DataFrame) -> DataFrame:
    """(id, component): strongly connected components of links (a, b), named by their least id.

    Nodes without a link in or out are components of their own and leave; the rest take the least
    id that reaches them as colour, and what its root reaches backwards inside the colour is one component.
    """
    left = durable(links.filter(F.col("a").isNotNull() & F.col("b").isNotNull()).select("a", "b").distinct(), "scc")
    nodes = links.select(F.explode(F.array("a", "b")).alias("id")).filter(F.col("id").isNotNull()).distinct()
    out = None
    while True:
        n = left.count()
        while n:  # trim
            kept = durable(left.join(left.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(left.select(F.col("a").alias("b")).distinct(), "b", "left_semi"), "scc")
            k = kept.count()
            left = kept
            if k == n:
                break
            n = k
        if not n:
            break
        colour = durable(left.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("colour", F.col("id")), "colour")
        while True:
            sent = left.join(colour.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg(F.min("colour").alias("other"))
            nxt = durable(colour.join(sent, "id", "left").select("id", F.least("colour", "other").alias("colour"), (F.col("other") < F.col("colour")).alias("moved")), "colour")
            moved = nxt.filter("moved").isEmpty()
            colour = nxt.drop("moved")
            if moved:
                break
        inside = durable(
            left.join(colour.select(F.col("id").alias("a"), F.col("colour").alias("ca")), "a").join(colour.select(F.col("id").alias("b"), F.col("colour").alias("cb")), "b").filter("ca = cb").select(F.col("b").alias("a"), F.col("a").alias("b")), "inside"
        )
        roots = colour.filter("id = colour").select("id")
        part = closure(roots, inside).select(F.col("node").alias("id"), F.col("seed").alias("component"))
        part = durable(part, "part")
        out = part if out is None else out.unionByName(part)
        left = durable(left.join(part.select(F.col("id").alias("a")), "a", "left_anti").join(part.select(F.col("id").alias("b")), "b", "left_anti"), "scc")
    if out is None:
        return nodes.select("id", F.col("id").alias("component"))
    return nodes.join(out, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def levels(links: DataFrame, parts: DataFrame) -> DataFrame:
    """(component, level) of the condensed graph: callees first, 1 + the highest level called."""
    p = parts.select("id", "component")
    arcs = links.join(p.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a").join(p.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b")
    arcs = durable(arcs.filter("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "arcs")
    level = durable(p.select("component").distinct().withColumn("level", F.lit(0).cast("long")), "level")
    while True:
        need = arcs.join(level.withColumnRenamed("component", "b"), "b").groupBy(F.col("a").alias("component")).agg((F.max("level") + 1).alias("need"))
        nxt = durable(level.join(need, "component", "left").select("component", F.greatest("level", "need").alias("level"), (F.col("need") > F.col("level")).alias("moved")), "level")
        done = nxt.filter("moved").isEmpty()
        level = nxt.drop("moved")
        if done:
            return level


def propagate_labels(links: DataFrame, rounds: int) -> DataFrame:
    """(id, label) after synchronous label propagation: the most frequent label around, the least of several."""
    e = links.filter("a <> b").select("a", "b").distinct()
    e = durable(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "sym")
    label = e.select(F.col("a").alias("id")).distinct().withColumn("label", F.col("id"))
    for _ in range(rounds):
        votes = e.join(label.withColumnRenamed("id", "b"), "b").groupBy("a", "label").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("a").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("x"))
        label = durable(best.select(F.col("a").alias("id"), F.col("x.label").alias("label")), "label")
    return label


def settle_order(links: list[tuple[str, str, int]]) -> dict[str, str]:
    """Label of each node of the links (a, b, weight): nodes in order of their ids take the heaviest label around, the least of several, until none changes.

    A change never lessens the weight of the links inside communities, and of equal ones it takes a lesser label, so it ends.
    """
    near: dict[str, list[tuple[str, int]]] = defaultdict(list)
    for a, b, w in links:
        near[a].append((b, w))
        near[b].append((a, w))
    order = sorted(near)
    label = {n: n for n in order}
    moved = True
    while moved:
        moved = False
        for n in order:
            weight: dict[str, int] = defaultdict(int)
            for other, w in near[n]:
                weight[label[other]] += w
            best = min(weight, key=lambda x: (-weight[x], x))
            if label[n] != best:
                label[n], moved = best, True
    return label


def settled_labels(links: DataFrame, apart: DataFrame) -> DataFrame:
    """(id, label) after sequential label propagation until nothing changes, without the nodes ``apart`` (id).

    Labels never leave a connected component, so each is one group and one task; links both ways weigh two.
    """
    nodes = links.filter("a <> b").select(F.explode(F.array("a", "b")).alias("id")).distinct().join(apart.select("id"), "id", "left_anti")
    e = without(links, apart).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("w"))
    e = durable(e, "weighted")
    part = components(e.select("a", "b")).withColumnRenamed("id", "a")

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(settle_order(list(zip(rows["a"], rows["b"], rows["w"]))).items()), columns=["id", "label"])

    done = e.join(part, "a").groupBy("component").applyInPandas(settle, "id string, label string")
    return nodes.join(done, "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def without(links: DataFrame, apart: DataFrame) -> DataFrame:
    """Links (a, b) between two nodes, none of them ``apart`` (id)."""
    e = links.filter("a <> b").select("a", "b").distinct()
    return e.join(apart.select(F.col("id").alias("a")), "a", "left_anti").join(apart.select(F.col("id").alias("b")), "b", "left_anti").select("a", "b")


def modularity(links: DataFrame, label: DataFrame, weighted: bool = False) -> DataFrame:
    """(n_communities, modularity) of a labelling of the undirected links (a, b); ``weighted``: links both ways weigh two."""
    e = links.filter("a <> b").select("a", "b").distinct().select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    e = e.groupBy("a", "b").agg((F.count(F.lit(1)) if weighted else F.lit(1).cast("long")).alias("w"))
    l = label.select("id", "label")
    j = e.join(l.select(F.col("id").alias("a"), F.col("label").alias("la")), "a").join(l.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b")
    ends = j.select(F.explode(F.array("la", "lb")).alias("label"), "w").groupBy("label").agg(F.sum("w").alias("k"))
    inner = j.filter("la = lb").groupBy(F.col("la").alias("label")).agg(F.sum("w").alias("n"))
    m = F.lit(e.agg(F.sum("w")).first()[0] or 0)
    q = F.coalesce("n", F.lit(0)) / m - F.pow(F.col("k") / (2 * m), 2)
    return ends.join(inner, "label", "left").agg(F.count(F.lit(1)).alias("n_communities"), F.round(F.sum(q), 6).alias("modularity"))
