"""Value flow: cones forwards and backwards over calls matched with their returns, witnesses, taint.

Defined cases: edges with a null end carry nothing; a context edge without a context is not walked;
a seed that no node has reaches nothing but itself; repeated edges count once; empty inputs give no
rows. A walk never runs out of rounds; a budget of states stops it and is told by ``truncated``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph import schema
from weftgraph.graph import Graph
from weftgraph.operators import piecewise
from weftgraph.operators.traverse import CONTEXT_DEPTH, flow_links
from weftgraph.plans.durable import durable
from weftgraph.plans.fixpoint import fixpoint

#: States of all walks together at which a walk stops and says so; None: never.
BUDGET: int | None = None
STACK = "array<string>"


def flow_edges(g: Graph) -> DataFrame:
    """(src, dst, reason, context_id, transition) of the edges that values flow along, by meaning.

    Every value that points to a heap object is linked back from it, so values that share an object meet.
    """
    e = g.edges.filter(schema.semantic_kind().isin(*schema.FLOW_EDGE_KINDS)).filter("src is not null and dst is not null")
    flow = e.select("src", "dst", "reason", "context_id", schema.semantic_kind().alias("transition"))
    there = F.struct("src", "dst", "reason", "context_id", "transition")
    back = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("alias-via-heap").alias("reason"), F.lit(None).cast("string").alias("context_id"), F.lit("ALIAS").alias("transition"))
    return flow.select(F.explode(F.when(F.col("transition") == "POINTS_TO", F.array(there, back)).otherwise(F.array(there))).alias("x")).select("x.*")


def with_left(links: DataFrame) -> DataFrame:
    """The links with ``left``: whether some link leaves the context that they enter."""
    left = links.filter("pop is not null").select(F.col("pop").alias("push")).distinct().withColumn("left", F.lit(True))
    return links.join(left, "push", "left").select("a", "b", "push", "pop", "left")


def walk(seeds: DataFrame, links: DataFrame, budget: int | None = BUDGET, most: int = CONTEXT_DEPTH, descend: bool = False) -> tuple[DataFrame, bool]:
    """States (seed, node, stack, depth, p_node, p_stack, p_depth, round) of walks from each seed (id) over links (a, b, push, pop).

    The stack is kept above the last context that no link leaves, as nothing below can be popped again; ``depth``
    counts all of it, ``most`` at most. With ``descend`` a walk that has entered nothing may leave any
    context, as one does that starts inside a callee. The parent is that of the first arrival, the least of several.
    """
    links = durable(links if "left" in links.columns else with_left(links), "links")
    none = F.array().cast(STACK)

    def step(found: DataFrame) -> DataFrame:
        j = found.join(links, found["node"] == links["a"])
        top = F.when(F.size("stack") > 0, F.element_at("stack", -1))
        loose = F.lit(descend) & (F.col("depth") == 0)
        ok = F.when(F.col("push").isNotNull(), F.col("depth") < most).when(F.col("pop").isNotNull(), F.coalesce(top == F.col("pop"), F.lit(False)) | loose).otherwise(True)
        stack = (
            F.when(F.col("push").isNotNull() & F.col("left").isNull(), none)
            .when(F.col("push").isNotNull(), F.concat("stack", F.array("push")))
            .when(F.col("pop").isNotNull(), F.slice("stack", F.lit(1), F.greatest(F.size("stack") - 1, F.lit(0))))
            .otherwise(F.col("stack"))
        )
        depth = F.greatest(F.col("depth") + F.when(F.col("push").isNotNull(), 1).when(F.col("pop").isNotNull(), -1).otherwise(0), F.lit(0))
        return j.filter(ok).select("seed", F.col("b").alias("node"), stack.alias("stack"), depth.alias("depth"), F.col("node").alias("p_node"), F.col("stack").alias("p_stack"), F.col("depth").alias("p_depth"))

    start = seeds.select("id").distinct().select(F.col("id").alias("seed"), F.col("id").alias("node"), none.alias("stack"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("p_node"), none.alias("p_stack"), F.lit(0).alias("p_depth"))
    return fixpoint(start, step, ["seed", "node", "stack"], budget=budget, falling="depth")


def first_states(states: DataFrame) -> DataFrame:
    """Of the states of each (seed, node) the first one."""
    cols = ["round", "stack", "depth", "p_node", "p_stack", "p_depth"]
    return states.groupBy("seed", "node").agg(F.min(F.struct(*cols)).alias("x")).select("seed", "node", *[F.col(f"x.{c}").alias(c) for c in cols])


def ways(seeds: DataFrame, links: DataFrame, budget: int | None = BUDGET, most: int = CONTEXT_DEPTH, descend: bool = False, paths: bool = False, by_piece: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """(seed, node, round, p_node, path) of the first arrival of the :func:`walk` from each seed at each node, ``path`` only with ``paths``.

    The seed is met at round 0, and once more if the walk comes back to it. Pieces of the graph that fit a
    task are solved there; the rest, and all with a budget, whose states count together, is walked in rounds.
    ``by_piece``: the :func:`piecewise.pieces` of seeds and links, where they are known.
    """
    if "left" not in links.columns:
        links = with_left(durable(links, "links"))
    found, cut = None, False
    if budget is None:
        found, seeds = piecewise.ways(piecewise.pieces(seeds, links) if by_piece is None else by_piece, most, descend, paths)
    if seeds is not None:
        states, cut = walk(seeds, links, budget, most, descend)
        states = durable(states, "states")
        hits = first_states(states.filter("round > 0")).unionByName(first_states(states.filter("round = 0")))
        if paths:
            hits = witnesses(states, hits.withColumn("before", F.col("p_node"))).select("seed", "node", F.col("hops").cast("int").alias("round"), F.col("before").alias("p_node"), "path")
        else:
            hits = hits.select("seed", "node", "round", "p_node", F.lit(None).cast("array<string>").alias("path"))
        found = hits if found is None else found.unionByName(hits)
    return found, cut


def first_ways(found: DataFrame) -> DataFrame:
    """Of :func:`ways` the first arrival only, which for the seed is its start."""
    return found.filter("round = 0 or node <> seed")


def cones(g: Graph, seeds: DataFrame, reverse: bool = False, budget: int | None = BUDGET) -> DataFrame:
    """(seed, node, distance, parent, truncated): what the values of each seed reach, or ``reverse`` what can feed them.

    ``parent`` is the node before on the way of the first arrival.
    """
    found, cut = ways(seeds, flow_links(flow_edges(g), reverse), budget)
    f = found.filter("node <> seed")
    return f.select("seed", "node", F.col("round").cast("long").alias("distance"), F.col("p_node").alias("parent"), F.lit(cut).alias("truncated"))


#: Calls that a backward question may be nested in.
CALLS_BACK = 4
# Reasons of a flow that give a variable its value, that only carry one along, and kinds that have none before them.
DEFINING = ("initializer", "assignment", "write", "field-write", "allocation", "out-parameter", "call-return")
CARRYING = ("read", "read-value", "value-preserving-expression", "arithmetic-operand", "call-argument", "field-read")
ORIGINS = ("parameter", "allocation", "heap-object")


def back_over_calls(g: Graph, seeds: DataFrame, depth: int = CALLS_BACK, budget: int | None = BUDGET) -> DataFrame:
    """(seed, node, distance, truncated): what can feed each seed (id) over at most ``depth`` nested calls; from inside a callee every caller counts."""
    found, cut = ways(seeds, flow_links(flow_edges(g), True), budget, depth, True)
    return found.filter("node <> seed").select("seed", "node", F.col("round").cast("long").alias("distance"), F.lit(cut).alias("truncated"))


def variable_context(g: Graph, seeds: DataFrame) -> DataFrame:
    """(seed, node, role, reason): going back from each seed (id), what defines its value, and the origins that nothing defines.

    A defining flow is recorded and not followed; only flows that carry a value along are.
    """
    e = g.semantic("VALUE_FLOWS_TO").filter("src is not null and dst is not null").select(F.col("dst").alias("a"), F.col("src").alias("b"), "reason").distinct()
    e = durable(e, "flow-back")
    along = e.filter(F.col("reason").isin(*CARRYING)).select("a", "b")
    found, _ = fixpoint(seeds.select(F.col("id").alias("seed"), F.col("id").alias("node")), lambda f: f.join(along, f["node"] == along["a"]).select("seed", F.col("b").alias("node")), ["seed", "node"])
    at = durable(found.select("seed", "node"), "carried")
    defs = at.join(e.filter(F.col("reason").isin(*DEFINING)).withColumnRenamed("a", "node"), "node").select("seed", F.col("b").alias("node"), F.lit("definition").alias("role"), "reason")
    origin = at.join(g.nodes.filter(F.col("kind").isin(*ORIGINS)).select(F.col("id").alias("node")), "node", "left_semi").filter("node <> seed").select("seed", "node", F.lit("origin").alias("role"), F.lit(None).cast("string").alias("reason"))
    return defs.unionByName(origin).distinct()


def shown(cone: DataFrame, limit: int = 200) -> DataFrame:
    """The rows of each cone that a page shows: the seed first, then nodes by id, ``limit`` with it; the cut is the feature."""
    from pyspark.sql import Window

    w = Window.partitionBy("seed").orderBy("node")
    ranked = cone.withColumn("place", F.row_number().over(w)).filter(F.col("place") < limit)
    size = cone.groupBy("seed").agg(F.count(F.lit(1)).alias("reached"))
    return ranked.join(size, "seed")


def witnesses(states: DataFrame, hits: DataFrame) -> DataFrame:
    """``hits`` (states of :func:`walk`) with ``path``, the nodes from the seed to each, walked back one parent a round."""
    keys = ["node", "stack", "depth", "round"]
    extra = [c for c in hits.columns if c not in ("seed", *keys, "p_node", "p_stack", "p_depth")]
    cur = hits.select("seed", *[F.col(k).alias(f"hit_{k}") for k in keys], *extra, *[F.col(k).alias(f"at_{k}") for k in keys], "p_node", "p_stack", "p_depth", F.array("node").alias("path"))
    parents = durable(states, "states")
    most = hits.agg(F.max("round")).first()[0] or 0
    done = cur.filter("at_round = 0")
    cur = durable(cur.filter("at_round > 0"), "back")
    for _ in range(most):
        p = parents.select("seed", F.col("node").alias("at_node"), F.col("stack").alias("at_stack"), F.col("depth").alias("at_depth"), F.col("round").alias("at_round"), F.col("p_node").alias("n_node"), F.col("p_stack").alias("n_stack"), F.col("p_depth").alias("n_depth"))
        asked = cur.select("seed", *[f"hit_{k}" for k in keys], *extra, F.concat(F.array("p_node"), "path").alias("path"), F.col("p_node").alias("at_node"), F.col("p_stack").alias("at_stack"), F.col("p_depth").alias("at_depth"), (F.col("at_round") - 1).alias("at_round"))
        back = asked.join(p, ["seed", "at_node", "at_stack", "at_depth", "at_round"]).withColumnsRenamed({"n_node": "p_node", "n_stack": "p_stack", "n_depth": "p_depth"})
        back = durable(back.select(cur.columns), "back")
        done = done.unionByName(back.filter("at_round = 0"))
        cur = back.filter("at_round > 0")
    return done.select("seed", F.col("hit_node").alias("node"), F.col("hit_round").cast("long").alias("hops"), *extra, "path")


def reaches(g: Graph, seeds: DataFrame, sinks: DataFrame, budget: int | None = BUDGET) -> DataFrame:
    """(seed, sink, reachable, hops, path, truncated): for each pair of a seed (id) and a sink (seed, sink) asked for, the first way or that there is none."""
    found, cut = ways(seeds, flow_links(flow_edges(g)), budget, paths=True)
    asked = sinks.select("seed", F.col("sink").alias("node")).distinct()
    found = first_ways(found).select("seed", "node", F.col("round").cast("long").alias("hops"), "path")
    return asked.join(found, ["seed", "node"], "left").select("seed", F.col("node").alias("sink"), F.col("path").isNotNull().alias("reachable"), "hops", "path", F.lit(cut).alias("truncated"))


# -- taint ----------------------------------------------------------------------------------------
def prop(name: str) -> Column:
    return F.get_json_object("props", f"$.{name}")


def arguments(g: Graph) -> DataFrame:
    """(call_id, argument_id, position): from argument nodes, for calls without such from HAS_ARGUMENT edges."""
    a = g.nodes.filter("kind = 'argument'").select(prop("callsite_id").alias("call_id"), F.col("id").alias("argument_id"), prop("position").cast("long").alias("position")).filter("call_id is not null")
    e = g.semantic("HAS_ARGUMENT").filter("src is not null and dst is not null").groupBy(F.col("src").alias("call_id"), F.col("dst").alias("argument_id")).agg(F.min("position").alias("position"))
    return a.unionByName(e.join(a.select("call_id").distinct(), "call_id", "left_anti"))


def call_values(g: Graph) -> DataFrame:
    """(call_id, value_id, receiver_id): the value that a call results in, and that of its receiver, where they are nodes."""
    c = g.nodes.filter(F.col("kind").isin(*schema.CALLSITE_KINDS)).select(F.col("id").alias("call_id"), prop("value_id").alias("value_id"), prop("receiver_value_id").alias("receiver_id"))
    known = g.nodes.select(F.col("id").alias("value_id"), F.lit(1).alias("has_value"))
    c = c.join(known, "value_id", "left").join(known.select(F.col("value_id").alias("receiver_id"), F.col("has_value").alias("has_receiver")), "receiver_id", "left")
    value = F.when(F.col("has_value").isNotNull() & (F.col("value_id") != F.col("call_id")), F.col("value_id"))
    return c.select("call_id", value.alias("value_id"), F.when(F.col("has_receiver").isNotNull(), F.col("receiver_id")).alias("receiver_id"))


def role_facts(g: Graph) -> tuple[DataFrame, DataFrame]:
    """Sources (fact_id, value_id, kind, confidence) and sinks (with call_id): nodes of these kinds, and values that carry the role."""
    facts = g.nodes.filter(F.col("kind").isin("source", "sink")).select(F.col("kind").alias("role"), F.col("id").alias("fact_id"), prop("value_id").alias("value_id"), F.coalesce(prop("source_kind"), prop("sink_kind")).alias("fact_kind"), F.coalesce("confidence", F.lit("high")).alias("confidence"), prop("callsite_id").alias("call_id"))
    facts = facts.join(g.nodes.select(F.col("id").alias("value_id")), "value_id", "left_semi")
    shape = "array<struct<role:string,subtype:string,confidence:string>>"
    carried = g.nodes.filter("props is not null").select("id", prop("callsite_id").alias("call_id"), F.explode(F.from_json(prop("roles"), shape)).alias("r")).filter(F.lower("r.role").isin("source", "sink"))
    role = F.lower("r.role")
    sub = F.coalesce("r.subtype", F.when(role == "source", "untrusted").otherwise("sensitive-operation"))
    made = carried.select(role.alias("role"), schema.stable_id("core", F.lit("taint"), role, F.col("id"), sub).alias("fact_id"), F.col("id").alias("value_id"), sub.alias("fact_kind"), F.coalesce("r.confidence", F.lit("high")).alias("confidence"), "call_id")
    every = durable(facts.select(made.columns).unionByName(made).dropDuplicates(["fact_id"]), "roles")
    return every.filter("role = 'source'").drop("role", "call_id"), every.filter("role = 'sink'").drop("role")


def taint_links(g: Graph, sinks: DataFrame) -> DataFrame:
    """Flow edges and what calls add: from arguments to the sink at their call, and through a call to its result."""
    base = g.edges.filter(schema.semantic_kind().isin(*schema.FLOW_EDGE_KINDS)).filter("src is not null and dst is not null").select("src", "dst", "reason", "context_id", schema.semantic_kind().alias("transition"))
    args = durable(arguments(g), "arguments")
    plain = lambda df, name: df.select("src", "dst", F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("context_id"), F.lit(name).alias("transition"))
    at_sink = plain(args.join(sinks.filter("call_id is not null").select("call_id", F.col("value_id").alias("dst")), "call_id").withColumnRenamed("argument_id", "src"), "SINK_ARGUMENT")
    values = durable(call_values(g), "values")
    through = args.join(values.filter("value_id is not null"), "call_id").select(F.col("argument_id").alias("src"), F.col("value_id").alias("dst"))
    held = values.filter("value_id is not null and receiver_id is not null").select(F.col("receiver_id").alias("src"), F.col("value_id").alias("dst"))
    return base.unionByName(at_sink).unionByName(plain(through.unionByName(held), "CALL_PASSTHROUGH")).filter("src <> dst")


def taint_ground(g: Graph, sources: DataFrame, sinks: DataFrame, budget: int | None = BUDGET) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """(sources, sinks, edges, seeds, links, pieces), written: what :func:`taint` and :func:`taint_flows` walk on."""
    sources, sinks = durable(sources, "sources"), durable(sinks, "sinks")
    edges = durable(taint_links(g, sinks), "taint-links")
    seeds, links = sources.select(F.col("value_id").alias("id")), with_left(durable(flow_links(edges), "links"))
    return sources, sinks, edges, seeds, links, piecewise.pieces(seeds, links) if budget is None else None


#: Call sites that a source without any sink is said to reach.
UNCLASSIFIED = 3


def taint(g: Graph, sources: DataFrame, sinks: DataFrame, budget: int | None = BUDGET, ground: tuple | None = None) -> DataFrame:
    """(source_id, sink_id, source_value, sink_value, confidence, hops, path, truncated): the first way from each source to each sink; no way of no hops.

    If there is no sink at all, each source reaches the first three call sites one of whose arguments it reaches, at low confidence.
    """
    sources, sinks, _, seeds, links, by_piece = ground or taint_ground(g, sources, sinks, budget)
    named = not sinks.isEmpty()
    every, cut = ways(seeds, links, budget, paths=True, by_piece=by_piece)
    if named:
        hits = every.filter("round > 0").join(sinks.select(F.col("value_id").alias("node"), F.col("fact_id").alias("sink_id")), "node")
        confidence = F.col("s_confidence")
    else:
        from pyspark.sql import Window

        cols = ["round", "node", "path"]
        at = first_ways(every).join(arguments(g).select(F.col("argument_id").alias("node"), "call_id"), "node")
        first = at.groupBy("seed", "call_id").agg(F.min(F.struct(*cols)).alias("x")).select("seed", "call_id", *[F.col(f"x.{c}").alias(c) for c in cols])
        few = first.withColumn("place", F.row_number().over(Window.partitionBy("seed").orderBy("call_id"))).filter(F.col("place") <= UNCLASSIFIED).drop("place")
        hits = few.withColumn("sink_id", schema.stable_id("core", F.lit("taint"), F.lit("unclassified-sink"), F.col("call_id"))).drop("call_id")
        confidence = F.lit("low")
    found = hits.withColumn("hops", F.col("round").cast("long"))
    s = sources.select(F.col("value_id").alias("seed"), F.col("fact_id").alias("source_id"), F.col("confidence").alias("s_confidence"))
    return found.join(s, "seed").select("source_id", "sink_id", F.col("seed").alias("source_value"), F.col("node").alias("sink_value"), confidence.alias("confidence"), "hops", "path", F.lit(cut).alias("truncated"))


def taint_flows(g: Graph, sources: DataFrame, sinks: DataFrame, budget: int | None = BUDGET, ground: tuple | None = None) -> DataFrame:
    """(src, dst, context_id, transition): every edge that a tainted value walks, once."""
    _, _, edges, seeds, links, by_piece = ground or taint_ground(g, sources, sinks, budget)
    taken = None
    if by_piece is not None:
        taken, seeds = piecewise.walked(by_piece, CONTEXT_DEPTH)
    if seeds is not None:
        states, _ = walk(seeds, links, budget)
        j = states.select(F.col("node").alias("a"), "stack", "depth").distinct().join(links, "a")
        top = F.when(F.size("stack") > 0, F.element_at("stack", -1))
        ok = F.when(F.col("push").isNotNull(), F.col("depth") < CONTEXT_DEPTH).when(F.col("pop").isNotNull(), F.coalesce(top == F.col("pop"), F.lit(False))).otherwise(True)
        step = j.filter(ok).select("a", "b", "push", "pop").distinct()
        taken = step if taken is None else taken.unionByName(step).distinct()
    # an edge is walked if the link is that it stands for
    enters, leaves = F.col("reason").eqNullSafe("context-parameter"), F.col("reason").eqNullSafe("context-return")
    own = (F.col("src") == F.col("a")) & (F.col("dst") == F.col("b")) & F.when(enters, F.col("context_id")).eqNullSafe(F.col("push")) & F.when(leaves, F.col("context_id")).eqNullSafe(F.col("pop"))
    usable = ~(enters | leaves) | F.col("context_id").isNotNull()
    return edges.filter(usable).join(taken, own, "left_semi").groupBy("src", "dst", "context_id").agg(F.min("transition").alias("transition"))


def unwitnessed(found: DataFrame, sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """(role, fact_id, value_id, fact_kind) of sources and sinks that take part in no way."""
    every = sources.select(F.lit("source").alias("role"), "fact_id", "value_id", "fact_kind").unionByName(sinks.select(F.lit("sink").alias("role"), "fact_id", "value_id", "fact_kind"))
    used = found.select(F.explode(F.array("source_value", "sink_value")).alias("value_id")).distinct()
    return every.join(used, "value_id", "left_anti").select("role", "fact_id", "value_id", "fact_kind")


# -- bounded walks --------------------------------------------------------------------------------
def paths(seeds: DataFrame, links: DataFrame, depth: int | None = None, avoid: DataFrame | None = None, budget: int | None = None) -> tuple[DataFrame, bool]:
    """(seed, node, distance, path) over links (a, b), the least of the shortest paths; never through avoided ids (id). Whether the budget stopped it."""
    if avoid is not None:
        links = links.join(avoid.select(F.col("id").alias("b")), "b", "left_anti")
    links = durable(links.select("a", "b").distinct(), "links")
    start = seeds.select("id").distinct().select(F.col("id").alias("seed"), F.col("id").alias("node"), F.array("id").alias("path"))
    step = lambda f: f.join(links, f["node"] == links["a"]).select("seed", F.col("b").alias("node"), F.concat("path", F.array("b")).alias("path"))
    found, cut = fixpoint(start, step, ["seed", "node"], depth, budget)
    return found.select("seed", "node", F.col("round").cast("long").alias("distance"), "path"), cut


# What an edge does to the value that is traced.
TRACE_KINDS = tuple("DEFINES READS_FROM WRITES_TO VALUE_FLOWS_TO READS_HEAP WRITES_HEAP REACHING_DEF CONDITION PROPERTY_READ PROPERTY_WRITE".split())


def trace_role(kind: Column) -> Column:
    return (
        F.when(kind.isin("DEFINES", "WRITES_TO", "WRITES_HEAP", "PROPERTY_WRITE"), "write")
        .when(kind.isin("READS_FROM", "READS_HEAP", "PROPERTY_READ"), "read")
        .when(kind == "CONDITION", "check")
        .otherwise("flow")
    )


def invariant_trace(g: Graph, seeds: DataFrame, depth: int = 4) -> DataFrame:
    """(seed, src, dst, kind, role, level): edges met within ``depth`` steps of each seed, walked either way, at the first level they are met."""
    e = durable(g.edges.filter(schema.semantic_kind().isin(*TRACE_KINDS)).filter("src is not null and dst is not null").select("src", "dst", schema.semantic_kind().alias("kind")).distinct(), "trace")
    both = e.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(e.select(F.col("dst").alias("a"), F.col("src").alias("b")))
    links = durable(both.distinct(), "links")
    start = seeds.select("id").distinct().select(F.col("id").alias("seed"), F.col("id").alias("node"))
    found, _ = fixpoint(start, lambda f: f.join(links, f["node"] == links["a"]).select("seed", F.col("b").alias("node")), ["seed", "node"], depth)
    at = found.filter(F.col("round") < depth).select("seed", "node", "round")
    met = at.join(e.withColumnRenamed("src", "node"), "node").select("seed", F.col("node").alias("src"), "dst", "kind", "round").unionByName(at.join(e.withColumnRenamed("dst", "node"), "node").select("seed", "src", F.col("node").alias("dst"), "kind", "round"))
    return met.groupBy("seed", "src", "dst", "kind").agg(F.min("round").cast("long").alias("level")).withColumn("role", trace_role(F.col("kind")))
