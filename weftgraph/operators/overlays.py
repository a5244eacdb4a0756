"""Derivation rules and the fold that applies them in order.

A rule is a name, a test whether it applies, and a function from the graph to the rows it adds: new
nodes and new edges, each with its evidence. The fold writes what a rule adds and hands the graph
with it to the next rule, counts what came, and never changes a row that is there. A rule of a
user's own is one more :class:`Rule` in the list.

Defined cases: a rule that does not apply adds nothing; nodes whose id is there and edges of equal
(kind, src, dst, context) are added once; edges from a node to itself and with a null end are none;
rows that lack the properties a rule reads are passed over; empty graphs stay empty.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph import schema
from weftgraph.graph import Graph, kept
from weftgraph.operators import access, navigate
from weftgraph.operators.reach import arguments
from weftgraph.plans.durable import durable, durable_counted
from weftgraph.plans.fixpoint import fixpoint

NODE_DELTA = ("id", "kind", "label", "confidence", "props", "evidence_ids")
EDGE_DELTA = ("src", "dst", "kind", "reason", "context_id", "confidence", "props", "evidence_ids")


@dataclass(frozen=True)
class Delta:
    nodes: DataFrame | None = None
    edges: DataFrame | None = None


@dataclass(frozen=True)
class Rule:
    """A rule that adds to the graph."""

    name: str
    applies: Callable[[Graph], bool]
    enrich: Callable[[Graph], Delta]


def prop(name: str) -> Column:
    return F.get_json_object("props", f"$.{name}")


def has_kind(*kinds: str) -> Callable[[Graph], bool]:
    return lambda g: not g.nodes.filter(F.col("kind").isin(*kinds)).isEmpty()


def _id(rule: str, kind: str, *parts: Column, owner: str = "core") -> Column:
    return schema.stable_id(owner, F.lit(rule), F.lit(kind), *parts)


def _nodes(df: DataFrame, id: Column, kind: str, label: Column, evidence: list[Column], confidence: Column | str = "high", **props: Column) -> DataFrame:
    sure = F.lit(confidence) if isinstance(confidence, str) else confidence
    body = F.to_json(F.struct(*[c.alias(k) for k, c in props.items()])) if props else F.lit(None).cast("string")
    return df.select(id.alias("id"), F.lit(kind).alias("kind"), label.alias("label"), sure.alias("confidence"), body.alias("props"), F.array_distinct(F.array_compact(F.array(*evidence))).alias("evidence_ids"))


def _edges(df: DataFrame, src: Column, dst: Column, kind: str | Column, evidence: list[Column], reason: Column | str | None = None, context: Column | None = None, confidence: Column | str = "high", **props: Column) -> DataFrame:
    say = lambda v: F.lit(v).cast("string") if v is None or isinstance(v, str) else v
    body = F.to_json(F.struct(*[c.alias(k) for k, c in props.items()])) if props else F.lit(None).cast("string")
    return df.select(src.alias("src"), dst.alias("dst"), say(kind).alias("kind"), say(reason).alias("reason"), say(context).alias("context_id"), say(confidence).alias("confidence"), body.alias("props"), F.array_distinct(F.array_compact(F.array(*evidence))).alias("evidence_ids"))


def _all(*parts: DataFrame | None) -> DataFrame | None:
    out = None
    for p in parts:
        if p is not None:
            out = p if out is None else out.unionByName(p)
    return out


#: Rows of a delta that are sent to the rows that are there; more are shuffled with them.
SENT = 10_000


def _unknown(rows: DataFrame, there: DataFrame, same: Column, label: str) -> tuple[DataFrame, int]:
    """The rows that have no ``same`` row in ``there``, and how many; a delta of few rows is sent, so that only what it meets is shuffled."""
    one, n = durable_counted(rows, "delta")
    if n:
        if "o_kind" in there.columns:
            kinds = [r[0] for r in one.select("kind").distinct().take(201)]
            if len(kinds) <= 200:
                there = there.filter(F.col("o_kind").isin(*[k for k in kinds if k is not None]))
        if n <= SENT:
            there = there.join(F.broadcast(one.select(*[c.removeprefix("o_") for c in there.columns])), same, "left_semi")
        one, n = durable_counted(one.join(there, same, "left_anti"), label)
    return one.withColumn("fact_origin", F.lit("core-inference")), n


def absorb(g: Graph, delta: Delta) -> tuple[Graph, int, int]:
    """The graph with the new rows of a delta, and how many nodes and edges these are."""
    nodes, edges, n_nodes, n_edges = g.nodes, g.edges, 0, 0
    if delta.nodes is not None:
        one = delta.nodes.filter("id is not null").groupBy("id").agg(*[F.min(c).alias(c) for c in NODE_DELTA if c != "id"])
        new, n_nodes = _unknown(one, nodes.select(F.col("id").alias("o_id")), F.col("id") == F.col("o_id"), "new-nodes")
        if n_nodes:
            nodes = nodes.unionByName(new.drop("evidence_ids") if "evidence_ids" not in nodes.columns else new, allowMissingColumns=True)
    if delta.edges is not None:
        key = ["src", "dst", "kind", "context_id"]
        one = delta.edges.filter("src is not null and dst is not null and src <> dst").groupBy(*key).agg(*[F.min(c).alias(c) for c in EDGE_DELTA if c not in key])
        there = edges.select(*[F.col(k).alias(f"o_{k}") for k in key])
        same = (F.col("src") == F.col("o_src")) & (F.col("dst") == F.col("o_dst")) & (F.col("kind") == F.col("o_kind")) & F.col("context_id").eqNullSafe(F.col("o_context_id"))
        new, n_edges = _unknown(one, there, same, "new-edges")
        if n_edges:
            edges = edges.unionByName(new.drop("evidence_ids") if "evidence_ids" not in edges.columns else new, allowMissingColumns=True)
    return Graph(nodes, edges), n_nodes, n_edges


def fold(g: Graph, rules: list[Rule], written: bool = False) -> tuple[Graph, list[tuple[str, int, int]]]:
    """The graph after all rules in order, and per rule the numbers of nodes and edges that it added; a ``written`` graph is not written again."""
    report = []
    g = g if written else kept(g)
    for rule in rules:
        if rule.applies(g):
            g, n, m = absorb(g, rule.enrich(g))
            report.append((rule.name, n, m))
        else:
            report.append((rule.name, 0, 0))
    return g, report


# -- dispatch ---------------------------------------------------------------------------------------
# Edges and reasons that keep a callable what it is.
ALIAS_EDGES = ("ALIASES", "ALIASES_VALUE", "READS_FROM", "PHI_INPUT")
DISPATCH_REASONS = tuple("initializer assignment write read read-value argument-value call-result context-call-result branch-reaching-definition phi-input".split())


def _callables(g: Graph) -> DataFrame:
    return g.nodes.filter(F.col("kind").isin(*schema.CALLABLE_KINDS)).select("id")


def override_closure(g: Graph) -> DataFrame:
    """(base, implementation): every callable that a base or interface member may stand for, over any number of steps."""
    c = _callables(g)
    up = g.semantic("OVERRIDES", "IMPLEMENTS_MEMBER").select(F.col("dst").alias("base"), F.col("src").alias("implementation"))
    down = g.semantic("IMPLEMENTED_BY").select(F.col("src").alias("base"), F.col("dst").alias("implementation"))
    direct = durable(up.unionByName(down).join(c.withColumnRenamed("id", "base"), "base", "left_semi").join(c.withColumnRenamed("id", "implementation"), "implementation", "left_semi").select("base", "implementation").distinct(), "overrides")
    nxt = direct.select(F.col("base").alias("a"), F.col("implementation").alias("b"))
    found, _ = fixpoint(direct, lambda f: f.join(nxt, f["implementation"] == nxt["a"]).select("base", F.col("b").alias("implementation")), ["base", "implementation"])
    return found.select("base", "implementation")


def callable_values(g: Graph) -> DataFrame:
    """(value, callable): callables that a value may be, along edges that keep identity."""
    own = _callables(g).select(F.col("id").alias("value"), F.col("id").alias("callable"))
    named = g.semantic("FUNCTION_VALUE").filter("src is not null and dst is not null").select(F.col("dst").alias("value"), F.col("src").alias("callable"))
    links = durable(identity_links(g, DISPATCH_REASONS), "identity")
    found, _ = fixpoint(own.unionByName(named), lambda f: f.join(links, f["value"] == links["a"]).select(F.col("b").alias("value"), "callable"), ["value", "callable"])
    return found.select("value", "callable")


def identity_links(g: Graph, reasons: tuple[str, ...]) -> DataFrame:
    """(a, b): edges along which a value stays itself; a definition is a version of what it defines."""
    e = g.edges.filter("src is not null and dst is not null")
    say = schema.semantic_kind()
    kept = say.isin(*ALIAS_EDGES) | ((say == "VALUE_FLOWS_TO") & F.col("reason").isin(*reasons))
    along = e.filter(kept).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    back = e.filter(say == "DEFINES").select(F.col("dst").alias("a"), F.col("src").alias("b"))
    return along.unionByName(back).distinct()


def _descendants(g: Graph, roots: DataFrame) -> DataFrame:
    """(root, node): what stands in the syntax below each root, itself included."""
    child = g.semantic("AST_CHILD").filter("src is not null and dst is not null").select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    start = durable(roots.select(F.col("id").alias("root"), F.col("id").alias("node")).distinct(), "roots")
    if not start.isEmpty():
        child = durable(child, "children")
    found, _ = fixpoint(start, lambda f: f.join(child, f["node"] == child["a"]).select("root", F.col("b").alias("node")), ["root", "node"])
    return found.select("root", "node")


def dispatch(g: Graph) -> Delta:
    """MAY_INVOKE edges: through overrides, function values, callbacks bound to parameters, callable receivers, and by name where nothing else decided."""
    calls = g.nodes.filter(F.col("kind").isin(*schema.CALLSITE_KINDS)).select("id", "label", "props")
    direct = durable(g.edges.filter(F.col("kind").isin("INVOKES", "MAY_INVOKE") & F.col("src").isNotNull() & F.col("dst").isNotNull()).select(F.col("src").alias("call_id"), "dst").distinct().join(calls.select(F.col("id").alias("call_id")), "call_id", "left_semi"), "direct")
    c = F.col
    over = direct.join(override_closure(g).withColumnRenamed("base", "dst"), "dst")
    parts = [_edges(over, c("call_id"), c("implementation"), "MAY_INVOKE", [c("call_id"), c("dst"), c("implementation")], "override-or-interface-implementation", declaration_target_id=c("dst"))]

    values = durable(callable_values(g), "callables")
    callee = durable(g.semantic("AST_CHILD").filter(prop("role") == "CALLEE").select(F.col("src").alias("call_id"), F.col("dst").alias("id")).join(calls.select(F.col("id").alias("call_id")), "call_id", "left_semi"), "callees")
    below = _descendants(g, callee).withColumnRenamed("root", "id").join(callee, "id").select("call_id", "node")
    referred = below.join(g.semantic("REFERS_TO").select(F.col("src").alias("node"), F.col("dst").alias("value")), "node").select("call_id", "value")
    read = below.join(g.semantic("READ_EVIDENCED_BY").select(F.col("dst").alias("node"), F.col("src").alias("value")), "node").select("call_id", "value")
    referred = durable(referred.unionByName(read).filter("value is not null").distinct(), "referred")
    named = referred.join(values, "value")
    parts.append(_edges(named, c("call_id"), c("callable"), "MAY_INVOKE", [c("call_id"), c("value"), c("callable")], "function-valued-reference"))
    bound = referred.join(g.nodes.filter("kind = 'parameter'").select(F.col("id").alias("value")), "value", "left_semi").join(g.semantic("ARGUMENT_BINDS_PARAMETER").select(F.col("dst").alias("value"), F.col("src").alias("argument_id")), "value")
    passed = g.semantic("PASSES_CALLBACK").select(F.col("src").alias("argument_id"), F.col("dst").alias("callable")).unionByName(values.select(F.col("value").alias("argument_id"), "callable")).distinct()
    back = bound.join(passed, "argument_id")
    parts.append(_edges(back, c("call_id"), c("callable"), "MAY_INVOKE", [c("call_id"), c("value"), c("argument_id"), c("callable")], "contextual-callback-binding", argument_id=c("argument_id")))
    received = calls.select(F.col("id").alias("call_id"), prop("receiver_value_id").alias("value")).join(values, "value")
    parts.append(_edges(received, c("call_id"), c("callable"), "MAY_INVOKE", [c("call_id"), c("value"), c("callable")], "callable-receiver"))
    decided = durable(_all(*parts).filter("src <> dst"), "decided")

    # by name: counts first, so that a name of many callables is told apart before its calls meet them
    left = calls.withColumnRenamed("id", "call_id").filter(prop("primary_target_id").isNull()).join(direct.select("call_id"), "call_id", "left_anti").join(decided.select(F.col("src").alias("call_id")), "call_id", "left_anti")
    left = left.select("call_id", F.coalesce(prop("method_name"), access.last_name(F.coalesce(prop("callee"), "label", F.lit("")))).alias("name"))
    by_name = g.nodes.filter(F.col("kind").isin(*schema.CALLABLE_KINDS)).select(F.col("id").alias("callable"), F.coalesce(prop("name"), access.last_name(F.coalesce("label", F.lit("")))).alias("name")).filter("name <> ''")
    many = by_name.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    guessed = left.join(many, "name").join(by_name, "name")
    reason = F.when(F.col("n") == 1, "name-fallback").otherwise("name-fallback-polymorphic")
    fallback = _edges(guessed, c("call_id"), c("callable"), "MAY_INVOKE", [c("call_id"), c("callable")], reason, confidence="low")
    return Delta(None, decided.unionByName(fallback))


# -- dynamic behaviour and contexts -------------------------------------------------------------------
def dynamic_behavior(g: Graph) -> Delta:
    """A dynamic-behavior node for every call that no edge decides, and a boundary for every such node."""
    c = F.col
    u = navigate.unresolved_calls(g).select("call_id")
    made = _nodes(u, _id("dynamic-behavior", "dynamic-behavior", c("call_id")), "dynamic-behavior", F.concat(F.lit("dynamic:"), "call_id"), [c("call_id")], "unresolved", site_id=c("call_id"), behavior_kind=F.lit("unresolved-call"))
    have = g.nodes.filter("kind = 'dynamic-behavior'").select("id", prop("site_id").alias("site_id"), prop("behavior_kind").alias("behavior_kind"), prop("key_value_id").alias("key_value_id"))
    every = durable(have.unionByName(made.select("id", prop("site_id").alias("site_id"), prop("behavior_kind").alias("behavior_kind"), F.lit(None).cast("string").alias("key_value_id"))), "dynamic")
    bound = _id("dynamic-behavior", "boundary", c("id"))
    edges = _all(
        _edges(every, c("id"), c("site_id"), "DYNAMIC_BEHAVIOR_AT", [c("id"), c("site_id")]),
        _edges(every, bound, c("id"), "EVIDENCED_BY", [c("id")]),
        _edges(every.filter("key_value_id is not null"), c("key_value_id"), c("id"), "DYNAMIC_INPUT", [c("key_value_id"), c("id")]),
    )
    return Delta(made.unionByName(_nodes(every, bound, "boundary", F.concat(F.lit("boundary:"), "id"), [c("id")], "conservative", boundary_kind=F.coalesce("behavior_kind", F.lit("dynamic-runtime")))), edges)


def contexts(g: Graph) -> Delta:
    """A context per call and target, one without target for calls that have none; its bound parameters and its return."""
    c = F.col
    calls = g.nodes.filter(F.col("kind").isin(*schema.CALLSITE_KINDS)).select(F.col("id").alias("call_id"), "label", F.col("owner_function_id").alias("caller"), prop("value_id").alias("value_id"), F.coalesce(prop("resolution"), F.lit("unresolved")).alias("resolution"))
    t = g.edges.filter(F.col("kind").isin("INVOKES", "MAY_INVOKE")).select(F.col("src").alias("call_id"), F.col("dst").alias("target")).distinct().join(g.nodes.select(F.col("id").alias("target")), "target", "left_semi")
    ctx = calls.join(t, "call_id", "left").withColumn("context_id", _id("interprocedural-contexts", "call-context", c("call_id"), F.coalesce("target", F.lit("unresolved"))))
    ctx = durable(ctx, "contexts")
    sure = F.when(c("target").isNotNull(), "exact").otherwise("unresolved")
    nodes = [_nodes(ctx, c("context_id"), "call-context", F.concat(F.lit("context:"), F.coalesce("label", "call_id")), [c("call_id"), c("target")], sure, callsite_id=c("call_id"), caller_function_id=c("caller"), callee_function_id=c("target"), resolution=c("resolution"))]
    edges = [_edges(ctx, c("call_id"), c("context_id"), "HAS_CALL_CONTEXT", [c("call_id"), c("target")], confidence=sure), _edges(ctx.filter("target is not null"), c("context_id"), c("target"), "CONTEXT_CALLS", [c("call_id"), c("target")])]

    b = g.edges.filter("kind = 'ARGUMENT_BINDS_PARAMETER'").select(F.col("src").alias("argument_id"), F.col("dst").alias("parameter_id"), "position")
    b = b.join(g.nodes.select(F.col("id").alias("argument_id"), prop("callsite_id").alias("call_id")), "argument_id").join(g.nodes.select(F.col("id").alias("parameter_id"), F.col("owner_function_id").alias("p_owner")), "parameter_id")
    bound = ctx.select("context_id", "call_id", "target").join(b, "call_id").filter("target is null or p_owner = target")
    bound = durable(bound.withColumn("binding_id", _id("interprocedural-contexts", "context-parameter", c("context_id"), c("argument_id"), c("parameter_id"))), "bindings")
    ev = [c("call_id"), c("argument_id"), c("parameter_id")]
    nodes.append(_nodes(bound, c("binding_id"), "context-parameter", F.concat_ws(" > ", "argument_id", "parameter_id"), ev, context_id=c("context_id"), callsite_id=c("call_id"), argument_id=c("argument_id"), parameter_id=c("parameter_id"), target_function_id=c("target"), callee_function_id=c("target"), position=c("position")))
    edges += [
        _edges(bound, c("argument_id"), c("binding_id"), "BINDS_PARAMETER", ev, position=c("position")),
        _edges(bound, c("binding_id"), c("parameter_id"), "CONTEXTUALIZES", ev),
        _edges(bound, c("argument_id"), c("binding_id"), "VALUE_FLOWS_TO", ev, "context-argument"),
    ]
    defs = parameter_definitions(g)
    edges.append(_edges(bound.join(defs, "parameter_id"), c("binding_id"), c("definition_id"), "VALUE_FLOWS_TO", ev, "context-parameter", c("context_id")))

    known = g.nodes.select(F.col("id").alias("value_id"))
    ret = durable(ctx.join(known, "value_id", "left_semi").withColumn("return_id", _id("interprocedural-contexts", "context-return", c("context_id"), c("value_id"))), "returns")
    nodes.append(_nodes(ret, c("return_id"), "context-return", F.concat(F.lit("return:"), F.coalesce("label", "call_id")), [c("call_id"), c("value_id")], sure, context_id=c("context_id"), callsite_id=c("call_id"), callee_function_id=c("target"), call_value_id=c("value_id")))
    gives = g.edges.filter("kind = 'RETURNS_VALUE'").select(F.col("dst").alias("target"), F.col("src").alias("returned_id"))
    edges += [
        _edges(ret, c("context_id"), c("return_id"), "CONTEXT_RETURNS", [c("call_id"), c("value_id")], confidence=sure),
        _edges(ret, c("return_id"), c("value_id"), "VALUE_FLOWS_TO", [c("call_id"), c("value_id")], "context-call-result", c("context_id")),
        _edges(ret.join(gives, "target"), c("returned_id"), c("return_id"), "VALUE_FLOWS_TO", [c("call_id"), c("value_id"), c("returned_id")], "context-return", c("context_id")),
    ]
    return Delta(_all(*nodes), _all(*edges))


def parameter_definitions(g: Graph) -> DataFrame:
    """(parameter_id, definition_id): the definitions that give a parameter its first value."""
    d = g.nodes.filter("kind = 'definition'").filter(prop("origin") == "parameter").select(F.col("id").alias("definition_id"))
    e = g.semantic("DEFINES").select(F.col("src").alias("parameter_id"), F.col("dst").alias("definition_id")).distinct()
    return e.join(d, "definition_id", "left_semi").join(g.nodes.filter("kind = 'parameter'").select(F.col("id").alias("parameter_id")), "parameter_id", "left_semi").select("parameter_id", "definition_id")


# -- heap -----------------------------------------------------------------------------------------------
def heap_objects(g: Graph) -> DataFrame:
    """(value, object, origin, owner): an object per allocation, and an abstract one per parameter that may hold a reference and is defined."""
    a = g.nodes.filter("kind = 'allocation'").select(F.col("id").alias("value"), _id("heap-identity", "heap-object", F.col("id")).alias("object"), F.lit("allocation").alias("origin"), F.col("owner_function_id").alias("owner"))
    p = g.nodes.filter("kind = 'parameter'").filter(F.coalesce(prop("value_category") != "primitive", F.lit(True))).select(F.col("id").alias("parameter_id"), F.col("owner_function_id").alias("owner"))
    d = durable(p.join(parameter_definitions(g), "parameter_id").withColumn("object", _id("heap-identity", "heap-object", F.lit("parameter"), F.col("parameter_id"))), "parameter-objects")
    own = d.select(F.col("parameter_id").alias("value"), "object", F.lit("parameter").alias("origin"), "owner").distinct()
    return a.unionByName(own).unionByName(d.select(F.col("definition_id").alias("value"), "object", F.lit("definition").alias("origin"), "owner"))


def property_steps(g: Graph) -> DataFrame:
    """(path_id, base, k, n, segment): the steps of each property path, from one; a dynamic step is ``[*]``, an opaque path one step."""
    shape = "array<struct<key:string,dynamic:boolean>>"
    p = g.nodes.filter("kind = 'property-path'").select(F.col("id").alias("path_id"), prop("base_value_id").alias("base"), F.from_json(prop("path_segments"), shape).alias("s"), F.coalesce(prop("path"), F.lit("?")).alias("opaque")).filter("base is not null")
    steps = F.when(F.coalesce(F.size("s"), F.lit(0)) > 0, F.transform("s", lambda x: F.when(F.coalesce(x["dynamic"], F.lit(False)), "[*]").otherwise(F.coalesce(x["key"], F.lit("?"))))).otherwise(F.array("opaque"))
    return p.select("path_id", "base", F.size(steps).alias("n"), F.posexplode(steps).alias("k", "segment")).withColumn("k", F.col("k") + 1)


def _with_owners(g: Graph) -> tuple[DataFrame, DataFrame]:
    """Writes (write_id, path_id, value_id, fn) and reads (read_id, path_id) of property paths."""
    w = g.nodes.filter("kind = 'write'").select(F.col("id").alias("write_id"), prop("target_id").alias("path_id"), prop("value_id").alias("value_id"), F.col("owner_function_id").alias("fn")).filter("path_id is not null")
    r = g.nodes.filter("kind = 'read'").select(F.col("id").alias("read_id"), prop("target_id").alias("path_id")).filter("path_id is not null")
    return w, r


def heap(g: Graph) -> Delta:
    """Points-to over allocations, parameters, contexts and property locations, to the common fixpoint; reads, writes and effects on the heap.

    Facts (what, place, object) grow together: a value or a property path so far points to objects, a
    location holds objects. Steps of a path whose location holds nothing when all is settled get an
    object of their own, and the facts grow on from there.
    """
    c = F.col
    objects = durable(heap_objects(g), "objects")
    defined = g.nodes.filter("kind = 'definition'").select(F.col("id").alias("a"), prop("target_id").alias("b")).filter("b is not null")
    # the values that contexts give back are bound below, not by plain flow
    links = durable(identity_links(g, tuple(r for r in schema.IDENTITY_REASONS if not r.startswith("context-"))).unionByName(defined).unionByName(_reason_links(g, ("context-argument", "context-call-result"))).distinct(), "identity")
    steps = durable(property_steps(g), "steps")
    writes, reads = _with_owners(g)
    writes, reads = durable(writes, "writes"), durable(reads, "reads")

    # context returns: what flows in, with the parameter objects of the callee exchanged for the caller's
    binding = g.nodes.filter("kind = 'context-parameter'").select(F.col("id").alias("binding"), prop("context_id").alias("ctx"), prop("argument_id").alias("argument"), prop("parameter_id").alias("parameter"))
    abstract = objects.filter("origin = 'parameter'").select(F.col("value").alias("parameter"), F.col("object").alias("formal"))
    binding = durable(binding.join(abstract, "parameter", "left"), "binding")
    returned = durable(_reason_edges(g, ("context-return",)).select(F.col("src").alias("from_value"), F.col("dst").alias("ret")).join(g.nodes.filter("kind = 'context-return'").select(F.col("id").alias("ret"), prop("context_id").alias("ctx"), prop("callee_function_id").alias("callee")), "ret"), "returned")
    owners = durable(objects.filter("origin = 'allocation'").select("object", "owner").distinct(), "owners")
    formals = durable(binding.filter("formal is not null").select("ctx", "formal", "argument").distinct(), "formals")

    # a write to a property of a parameter also goes to what the argument of each context points to
    applied = binding.select(F.col("parameter").alias("base"), "ctx", "argument").distinct()
    via = steps.join(applied, "base").select(F.concat_ws("@", "path_id", "ctx").alias("path_id"), F.col("argument").alias("base"), "n", "k", "segment", F.col("path_id").alias("of"), "ctx")
    via = durable(via.join(writes.select(F.col("path_id").alias("of")).distinct(), "of", "left_semi"), "via")
    own_steps, own_writes = steps, writes
    steps = own_steps.unionByName(via.select(own_steps.columns))
    writes = own_writes.unionByName(via.select("path_id", "of", "ctx").distinct().join(own_writes.withColumnRenamed("path_id", "of"), "of").select(own_writes.columns))

    key = ["what", "place", "object"]
    location = lambda obj, seg: _id("heap-identity", "heap-location", obj, seg)
    at = lambda path, k: F.concat_ws("#", path, k.cast("string"))
    seed = objects.select(F.lit("value").alias("what"), F.col("value").alias("place"), "object")

    def step(f: DataFrame) -> DataFrame:
        every = known()
        v, p, l = (f.filter(F.col("what") == w) for w in ("value", "path", "loc"))
        out = [v.join(links, v["place"] == links["a"]).select("what", F.col("b").alias("place"), "object")]
        # a base's objects start its paths; path#0 is the base
        first = steps.filter("k = 1").select(F.col("base").alias("place"), "path_id")
        out.append(v.join(first, "place").select(F.lit("path").alias("what"), at(c("path_id"), F.lit(0)).alias("place"), "object"))
        # objects before a step give its location; what the location holds is behind the step
        before = steps.select(at(c("path_id"), c("k") - 1).alias("place"), "path_id", "k", "n", "segment")
        reach = lambda df: df.join(before, "place").select("path_id", "k", "n", location(c("object"), c("segment")).alias("loc"))
        held = lambda df: df.select(F.col("place").alias("loc"), F.col("object").alias("held"))
        all_p, all_l, all_v = (every.filter(F.col("what") == w) for w in ("path", "loc", "value"))
        met = reach(p).join(held(all_l), "loc").unionByName(reach(all_p).join(held(l), "loc"))
        out.append(met.select(F.lit("path").alias("what"), at(c("path_id"), c("k")).alias("place"), c("held").alias("object")))
        # reads take what the last location holds, writes put there what their value points to
        out.append(met.filter("k = n").join(reads, "path_id").select(F.lit("value").alias("what"), c("read_id").alias("place"), c("held").alias("object")))
        puts = lambda pp, vv: reach(pp).filter("k = n").join(writes.filter("value_id is not null"), "path_id").join(vv.select(F.col("place").alias("value_id"), "object"), "value_id").select(F.lit("loc").alias("what"), c("loc").alias("place"), "object")
        out += [puts(p, all_v), puts(all_p, v)]
        # parameters of contexts and what comes back
        out.append(v.join(binding.select(F.col("argument").alias("place"), "binding"), "place").select("what", F.col("binding").alias("place"), "object"))
        come = v.join(returned, v["place"] == returned["from_value"]).select("ret", "ctx", "callee", "object")
        swapped = come.join(formals.withColumnRenamed("formal", "object"), ["ctx", "object"]).join(all_v.select(F.col("place").alias("argument"), F.col("object").alias("actual")), "argument").select("ret", "actual")
        late = all_v.join(returned, all_v["place"] == returned["from_value"]).select("ret", "ctx", "object").join(formals.withColumnRenamed("formal", "object"), ["ctx", "object"]).join(v.select(F.col("place").alias("argument"), F.col("object").alias("actual")), "argument").select("ret", "actual")
        out.append(swapped.unionByName(late).select(F.lit("value").alias("what"), F.col("ret").alias("place"), F.col("actual").alias("object")))
        plain = come.join(formals.select("ctx", F.col("formal").alias("object")).distinct(), ["ctx", "object"], "left_anti").join(owners, "object", "left")
        clone = F.when(c("owner") == c("callee"), _id("heap-identity", "heap-object", F.lit("context"), c("ctx"), c("object"))).otherwise(c("object"))
        out.append(plain.select(F.lit("value").alias("what"), F.col("ret").alias("place"), clone.alias("object")))
        return _all(*out)

    grown: list[DataFrame] = []
    known = lambda: _all(*grown)

    def settle(start: DataFrame) -> DataFrame:
        # the step joins new facts with all facts, so it keeps its own list of the rounds
        fresh = durable(start.select(key).distinct(), "facts")
        while not fresh.isEmpty():
            grown.append(fresh)
            if len(grown) > 8:
                grown[:] = [durable(known(), "facts")]
            fresh = durable(step(fresh).distinct().join(known(), key, "left_anti"), "facts")
        return known()

    facts = settle(seed)
    while True:
        pts = facts.filter("what = 'path'")
        inner = steps.filter("k < n").select(at(c("path_id"), c("k") - 1).alias("place"), "segment")
        need = pts.join(inner, "place").select(location(c("object"), c("segment")).alias("place"), F.lit("loc").alias("what"), _id("heap-identity", "heap-object", F.lit("property"), c("object"), c("segment")).alias("child")).distinct()
        empty = durable(need.join(facts.filter("what = 'loc'").select("place"), "place", "left_anti").select("what", "place", F.col("child").alias("object")), "children")
        if empty.isEmpty():
            break
        facts = settle(empty)
    facts = durable(facts.filter("object is not null"), "points")

    v, p, l = (facts.filter(F.col("what") == w) for w in ("value", "path", "loc"))
    before = steps.select(at(c("path_id"), c("k") - 1).alias("place"), "path_id", "k", "n", "segment")
    locs = durable(p.join(before, "place").select("path_id", "object", "segment", (c("k") == c("n")).alias("last"), location(c("object"), c("segment")).alias("loc")).distinct(), "locations")
    objs = v.select("object").unionByName(l.select("object")).distinct()
    nodes = _all(
        _nodes(objs, c("object"), "heap-object", F.concat(F.lit("object:"), "object"), [c("object")]),
        _nodes(locs.select("loc", "object", "segment").distinct(), c("loc"), "heap-location", F.concat_ws(".", "object", "segment"), [c("object")], object_id=c("object"), path=c("segment")),
    )
    effect = own_writes.join(locs.filter("last"), "path_id").join(own_steps.select("path_id", "base").distinct(), "path_id").join(abstract.select(F.col("parameter").alias("base")).distinct(), "base", "left_semi")
    effect = durable(effect.filter("fn is not null").withColumn("effect_id", _id("heap-identity", "function-effect", c("fn"), c("base"), c("path_id"), c("write_id"))).select("effect_id", "fn", "base", "path_id", "write_id", "value_id").distinct(), "effects")
    applied_at = durable(via.select("path_id", "of", "ctx").distinct().join(locs.filter("last"), "path_id").join(own_writes.select(F.col("path_id").alias("of"), "write_id"), "of").select("ctx", "write_id", "loc").distinct(), "applied")
    edges = _all(
        _edges(v, c("place"), c("object"), "POINTS_TO", [c("place"), c("object")]),
        _edges(l, c("place"), c("object"), "POINTS_TO", [c("place"), c("object")]),
        _edges(locs.select("object", "loc").distinct(), c("object"), c("loc"), "POINTS_TO", [c("object")], relationship=F.lit("property")),
        _edges(own_writes.join(locs.filter("last"), "path_id"), c("write_id"), c("loc"), "WRITES_HEAP", [c("write_id"), c("path_id"), c("loc")], property_path_id=c("path_id")),
        _edges(applied_at, c("write_id"), c("loc"), "WRITES_HEAP", [c("write_id"), c("ctx"), c("loc")], context=c("ctx")),
        _edges(applied_at, c("ctx"), c("loc"), "APPLIES_EFFECT", [c("write_id"), c("ctx"), c("loc")]),
        _edges(reads.join(locs.filter("last"), "path_id"), c("loc"), c("read_id"), "READS_HEAP", [c("read_id"), c("path_id"), c("loc")], property_path_id=c("path_id")),
        _edges(effect, c("fn"), c("effect_id"), "MUTATES", [c("fn"), c("base"), c("path_id"), c("write_id")]),
        _edges(effect, c("effect_id"), c("write_id"), "EVIDENCED_BY", [c("fn"), c("base"), c("path_id"), c("write_id")]),
        _edges(returned.join(v.select(F.col("place").alias("from_value"), "object"), "from_value").join(owners, "object").filter("owner = callee"), c("ctx"), _id("heap-identity", "heap-object", F.lit("context"), c("ctx"), c("object")), "CONTEXT_ALLOCATES", [c("ret"), c("ctx"), c("object")]),
    )
    nodes = nodes.unionByName(_nodes(effect, c("effect_id"), "function-effect", F.concat(F.lit("writes:"), "path_id"), [c("fn"), c("base"), c("path_id"), c("write_id")], function_id=c("fn"), effect_kind=F.lit("parameter-property-write"), parameter_id=c("base"), write_id=c("write_id"), value_id=c("value_id")))
    return Delta(nodes, edges)


def _reason_edges(g: Graph, reasons: tuple[str, ...]) -> DataFrame:
    return g.semantic("VALUE_FLOWS_TO").filter(F.col("reason").isin(*reasons) & F.col("src").isNotNull() & F.col("dst").isNotNull()).select("src", "dst").distinct()


def _reason_links(g: Graph, reasons: tuple[str, ...]) -> DataFrame:
    return _reason_edges(g, reasons).select(F.col("src").alias("a"), F.col("dst").alias("b"))


# -- modules ------------------------------------------------------------------------------------------------
def module_initialization(g: Graph) -> Delta:
    """Singletons and state of modules: file-level variables, what they were made from within three flows, and how they change; import cycles."""
    from weftgraph.operators.traverse import strong_components

    c = F.col
    files = g.nodes.filter("kind = 'file'").filter(F.coalesce(prop("declaration_file") != "true", F.lit(True))).select(F.col("id").alias("file_id"))
    var = g.semantic("DECLARES_VALUE").select(F.col("src").alias("file_id"), F.col("dst").alias("id")).join(files, "file_id", "left_semi").groupBy("id").agg(F.max("file_id").alias("file_id"))
    v = durable(g.nodes.filter("kind = 'variable'").select("id", "label", prop("symbol_kind").alias("binding")).join(var, "id").join(access.exported_ids(g).withColumn("exported", F.lit(True)), "id", "left"), "variables")
    made = g.nodes.filter(F.col("kind").isin("allocation", "call-value")).select(F.col("id").alias("source"), F.col("kind").alias("s_kind"), prop("allocation_kind").alias("a_kind"), F.coalesce(prop("allocated_type"), "type").alias("a_type"), F.coalesce(prop("value_category"), prop("type_facts.value_category")).alias("category"))
    made = durable(made.filter("s_kind = 'allocation' or category is null or category <> 'primitive'"), "made")
    flow = g.semantic("VALUE_FLOWS_TO").filter("src is not null and dst is not null").select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    if not made.isEmpty():
        flow = durable(flow, "flow")
    stop = v.select(F.col("id").alias("node"))
    # the walk goes on from everything but the variables it looks for
    found, _ = fixpoint(made.select("source", F.col("source").alias("node")), lambda f: f.join(stop, "node", "left_anti").join(flow, F.col("node") == flow["a"]).select("source", F.col("b").alias("node")), ["source", "node"], 3)
    born = durable(found.filter("round > 0").select("source", F.col("node").alias("id")).join(v, "id").join(made, "source"), "born")
    single = _id("module-initialization", "singleton", c("id"), c("source"))
    kind = F.when(c("s_kind") == "call-value", "factory").otherwise(F.coalesce("a_kind", F.lit("allocation")))
    ev = [c("file_id"), c("id"), c("source")]
    nodes = [_nodes(born, single, "singleton", F.coalesce("label", "id"), ev, file_id=c("file_id"), symbol_id=c("id"), value_source_id=c("source"), singleton_kind=kind, allocated_type=c("a_type"), exported=F.coalesce("exported", F.lit(False)))]
    edges = [_edges(born, c("file_id"), single, "HAS_SINGLETON", ev), _edges(born, single, c("id"), "SINGLETON_OF", ev)]
    later = g.semantic("DEFINES").select(F.col("src").alias("id"), F.col("dst").alias("d")).join(g.nodes.filter(prop("version").cast("int") > 0).select(F.col("id").alias("d")), "d", "left_semi").select("id")
    rewritten = g.semantic("WRITES_TO").select(F.col("dst").alias("id"), F.col("src").alias("w")).join(g.nodes.filter(F.coalesce(prop("write_kind") != "initializer", F.lit(True))).select(F.col("id").alias("w")), "w", "left_semi").select("id")
    changed = later.unionByName(rewritten).distinct().withColumn("changed", F.lit(True))
    mutable = born.filter("s_kind = 'allocation' and a_kind in ('object', 'array', 'class-instance')").select("id").distinct().withColumn("mutable", F.lit(True))
    state = F.when(c("binding").isin("let", "var"), "reassignable").when(c("changed"), "mutated").when(c("mutable"), "mutable-allocation")
    s = durable(v.join(changed, "id", "left").join(mutable, "id", "left").withColumn("state", state).filter("state is not null"), "state")
    state_id = _id("module-initialization", "module-state", c("id"))
    nodes.append(_nodes(s, state_id, "module-state", F.coalesce("label", "id"), [c("file_id"), c("id")], file_id=c("file_id"), symbol_id=c("id"), state_kind=c("state"), binding_kind=c("binding"), exported=F.coalesce("exported", F.lit(False))))
    edges += [_edges(s, c("file_id"), state_id, "HAS_MODULE_STATE", [c("file_id"), c("id")]), _edges(s, state_id, c("id"), "STATE_OF", [c("file_id"), c("id")])]
    fs = g.nodes.filter("kind = 'file'").select("id")
    dep = g.semantic("DEPENDS_ON", "RUNTIME_DEPENDS_ON", "RE_EXPORTS").select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    dep = dep.join(fs.withColumnRenamed("id", "a"), "a", "left_semi").join(fs.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b")
    part = durable(strong_components(dep), "cycles")
    own = dep.filter("a = b").select(F.col("a").alias("id")).withColumn("own", F.lit(True))
    size = part.join(own, "id", "left").groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.max("own").alias("own")).filter("size > 1 or own")
    cyc = part.join(size, "component")
    cyc_id = _id("module-initialization", "import-cycle", c("component"))
    nodes.append(_nodes(size, cyc_id, "import-cycle", F.concat(F.lit("import cycle ("), c("size").cast("string"), F.lit(" modules)")), [c("component")], "exact", size=c("size")))
    edges.append(_edges(cyc, c("id"), cyc_id, "PARTICIPATES_IN_IMPORT_CYCLE", [c("id"), c("component")], confidence="exact"))
    return Delta(_all(*nodes), _all(*edges))


# -- effects of parameters ------------------------------------------------------------------------------------
def parameter_effects(g: Graph) -> Delta:
    """Writes of a callee to properties of its parameters, applied at every call of it; calls of a member so written may invoke what was written."""
    c = F.col
    eff = g.edges.filter("kind = 'WRITES_PARAMETER_PROPERTY'").select(F.col("src").alias("fn"), F.col("dst").alias("property_id"), prop("receiver_position").cast("int").alias("rp"), prop("value_position").cast("int").alias("vp")).filter("rp is not null and vp is not null")
    calls = g.nodes.filter(F.col("kind").isin(*schema.CALLSITE_KINDS)).select(F.col("id").alias("call_id"), prop("primary_target_id").alias("fn"), F.from_json(prop("argument_value_ids"), "array<string>").alias("args"), prop("receiver_value_id").alias("receiver_id"), prop("receiver_member_id").alias("member_id"), "kind")
    calls = durable(calls, "calls")
    at = calls.join(eff, "fn").select("call_id", "fn", "property_id", F.get("args", c("rp")).alias("holder"), F.get("args", c("vp")).alias("value_id")).filter("holder is not null and value_id is not null")
    n = lambda name: g.nodes.select(F.col("id").alias(name), F.col("label").alias(f"{name}_label"), F.col("kind").alias(f"{name}_kind"))
    at = durable(at.join(n("holder"), "holder").join(n("value_id"), "value_id").withColumn("loc", _id("parameter-property-effects", "heap-location", c("call_id"), c("holder"), c("property_id"))), "effects")
    ev = [c("call_id"), c("fn"), c("property_id"), c("holder"), c("value_id")]
    nodes = _nodes(at.select("loc", "call_id", "property_id", "holder", "holder_label").distinct(), c("loc"), "heap-location", F.concat_ws(".", "holder_label", "property_id"), [c("call_id"), c("property_id"), c("holder")], receiver_value_id=c("holder"), property_id=c("property_id"), callsite_id=c("call_id"), context_sensitive=F.lit(True))
    member = calls.filter("kind = 'call'").select(F.col("call_id").alias("user"), F.col("receiver_id").alias("holder"), F.col("member_id").alias("property_id")).join(at.filter(c("value_id_kind").isin(*schema.CALLABLE_KINDS)), ["holder", "property_id"])
    edges = _all(
        _edges(at, c("call_id"), c("loc"), "APPLIES_EFFECT", ev, summary_function_id=c("fn")),
        _edges(at, c("holder"), c("loc"), "POINTS_TO", ev, callsite_id=c("call_id")),
        _edges(at, c("value_id"), c("loc"), "WRITES_HEAP", ev, callsite_id=c("call_id")),
        _edges(member, c("loc"), c("user"), "READS_HEAP", [c("user"), c("loc"), c("value_id")]),
        _edges(member, c("user"), c("value_id"), "MAY_INVOKE", [c("user"), c("loc"), c("value_id")], resolution=F.lit("interprocedural-property-effect"), heap_location_id=c("loc")),
    )
    return Delta(nodes, edges)


# -- routes and roles -----------------------------------------------------------------------------------------
# Methods that register a route.
ROUTE_METHODS = ("get", "post", "put", "delete", "patch", "options", "head", "all", "use")


def routes(g: Graph) -> Delta:
    """A route per registering call: its path the first literal argument, its handler what the last argument passes; the handler's first parameter is a source."""
    c = F.col
    call = g.nodes.filter("kind = 'call'").select(F.col("id").alias("call_id"), F.lower(prop("method_name")).alias("method"), prop("receiver_expression").alias("receiver")).filter(F.col("method").isin(*ROUTE_METHODS))
    arg = g.nodes.filter("kind = 'argument'").select(F.col("id").alias("argument_id"), prop("callsite_id").alias("call_id"), F.coalesce(prop("position").cast("int"), F.lit(-1)).alias("position"), F.when(F.coalesce(prop("literal"), F.lit("false")).isin("false", "0", ""), None).otherwise(prop("literal_value")).alias("literal"))
    per = arg.groupBy("call_id").agg(F.min(F.struct("position", "argument_id", "literal")).alias("first"), F.max(F.struct("position", "argument_id")).alias("last"), F.count(F.lit(1)).alias("n"))
    j = call.join(per, "call_id", "left").withColumn("path", c("first.literal")).filter("method = 'use' or path is not null")
    j = j.withColumn("argument_id", F.when((c("n") > 1) | (c("method") == "use"), c("last.argument_id")))
    fn = g.nodes.filter(F.col("kind").isin("function", "method")).select(F.col("id").alias("handler"))
    passed = g.semantic("PASSES_CALLBACK").select(F.col("src").alias("argument_id"), F.col("dst").alias("handler"), F.lit(0).alias("way"), "row_id")
    syntax = g.semantic("EXPANDS_TO", "EVIDENCED_BY").select(F.col("src").alias("argument_id"), F.col("dst").alias("s")).join(g.semantic("REFERS_TO").select(F.col("src").alias("s"), F.col("dst").alias("handler"), "row_id"), "s").select("argument_id", "handler", F.lit(1).alias("way"), "row_id")
    to = passed.unionByName(syntax).join(fn, "handler", "left_semi").groupBy("argument_id").agg(F.min(F.struct("way", F.coalesce("row_id", F.lit(1 << 62)).alias("r"), "handler")).alias("x")).select("argument_id", F.col("x.handler").alias("handler"))
    j = durable(j.join(to, "argument_id", "left").withColumn("route_id", _id("generic-web-routes", "route", c("call_id"), F.coalesce("path", F.lit("*")), owner="framework-model")), "routes")
    sure = F.when(c("handler").isNotNull(), "high").otherwise("conservative")
    ev = [c("call_id"), c("first.argument_id"), c("argument_id")]
    nodes = [_nodes(j, c("route_id"), "route", F.concat_ws(" ", F.upper("method"), F.coalesce("path", F.lit("*"))), ev, sure, method=c("method"), path=c("path"), callsite_id=c("call_id"), receiver_expression=c("receiver"), handler_id=c("handler"))]
    h = j.filter("handler is not null")
    p = g.nodes.filter("kind = 'parameter' and owner_function_id is not null").groupBy(F.col("owner_function_id").alias("handler")).agg(F.min(F.struct(F.coalesce(prop("parameter_position").cast("int"), F.lit(0)).alias("at"), F.col("id").alias("parameter_id"), F.col("label").alias("p_label"))).alias("p"))
    src = h.join(p, "handler").select("route_id", "call_id", "handler", "p.parameter_id", "p.p_label")
    source_id = _id("generic-web-routes", "source", c("route_id"), c("parameter_id"), owner="framework-model")
    sev = [c("route_id"), c("call_id"), c("handler"), c("parameter_id")]
    nodes.append(_nodes(src, source_id, "source", F.concat(F.lit("route input:"), F.coalesce("p_label", F.lit("parameter"))), sev, "conservative", value_id=c("parameter_id"), source_kind=F.lit("route-handler-parameter"), route_id=c("route_id"), function_id=c("handler")))
    edges = _all(
        _edges(j, c("route_id"), c("call_id"), "EVIDENCED_BY", ev, confidence=sure),
        _edges(h, c("route_id"), c("handler"), "ROUTE_HANDLED_BY", ev),
        _edges(h, c("route_id"), c("handler"), "ENTRY_POINT_OF", ev),
        _edges(src, source_id, c("parameter_id"), "TAINT_SOURCE", sev, confidence="conservative"),
    )
    return Delta(_all(*nodes), edges)


# Names and types of parameters that come from outside, and of what is none.
REQUEST_NAME = r"(?i)url|uri|href|endpoint|request|\breq\b|body|payload|\binput\b|param|\bquery\b|\bevent\b|header|cookie|\bform\b|upload|webhook|\bdata\b|content|message|\bmsg\b"
REQUEST_TYPE = r"\b(URL|URI|Request|Response|IncomingMessage|ServerRequest|Readable|Buffer|Stream|FormData|Headers|Uint8Array|ArrayBuffer|Blob|Socket)\b"
BOUNDARY_NAME = r"(?i)handle|webhook|route|controller|middleware|endpoint|\bserve\b|listen|subscribe|consume|dispatch|resolver"
IDENTIFIER_NAME = r"(^|_)(id|ids|uuid|guid|slug|ref|handle)$|(?<![A-Z])Id$|(?<![A-Z])Ids$|Uuid$|Guid$|Slug$"
NO_IDENTIFIER = r"(?i)secret|token|apikey|appid|clientid|tenantid|sessionid|requestid|traceid|nonce"
# Calls that matter by exact name, then by families of names, the first that fits.
SENSITIVE_CALLS = {
    "eval": "dynamic-code", "Function": "dynamic-code", "fetch": "network", "exec": "process", "execFile": "process", "spawn": "process", "writeFile": "filesystem-write", "writeFileSync": "filesystem-write",
    "query": "database", "execute": "database", "rename": "filesystem-write", "findById": "database", "findOne": "database", "send": "response", "json": "response", "redirect": "response",
}
SENSITIVE_FAMILIES = (
    (r"\beval\b|^Function$|runInContext|runInNewContext|createFunction", "dynamic-code", "high"),
    (r"^exec$|execSync|execFile|spawn(Sync)?|\bfork\b|execa", "process", "high"),
    (r"writeFile|appendFile|createWriteStream|unlink|rmdir|^rm$|mkdir|rename(Sync|File|Dir|Path)|copyFile|chmod|symlink", "filesystem-write", "medium"),
    (r"\bfetch\b|axios|\bgot\b|https?Request|createConnection|sendBeacon|XMLHttpRequest|\bky\b", "network", "medium"),
    (r"findOne|findById|findMany|\bfindAll\b|\bquery\b|execute(Query|Sql|SQL|Statement|Raw|Batch)|rawQuery|\.raw\b|aggregate|deleteMany|updateMany|insertMany|createQueryBuilder", "database", "medium"),
    (r"readFile|createReadStream|readdir|realpath", "filesystem-read", "low"),
    (r"deserialize|unserialize|parseXml|loadYaml|fromJSON", "deserialize", "low"),
)


def source_kind(name: Column, type_: Column, boundary: Column) -> Column:
    is_id = name.rlike(IDENTIFIER_NAME) & ~name.rlike(NO_IDENTIFIER)
    return F.when(name.rlike(REQUEST_NAME) | F.coalesce(type_.rlike(REQUEST_TYPE), F.lit(False)), "request-input").when(is_id, "resource-identifier").when(boundary, "boundary-parameter")


def sink_class(name: Column) -> tuple[Column, Column]:
    """Kind and confidence of a call that matters."""
    kind = F.when(name == "eval", "dynamic-code")
    sure = F.when(name.isin(*SENSITIVE_CALLS), "high")
    for n, k in SENSITIVE_CALLS.items():
        kind = kind.when(name == n, k)
    for pattern, k, s in SENSITIVE_FAMILIES:
        kind, sure = kind.when(name.rlike(pattern), k), sure.when(name.rlike(pattern), s)
    return kind, sure


def security_roles(g: Graph) -> Delta:
    """Sources for parameters of exported callables that look like input, sinks for calls whose names matter."""
    c = F.col
    owner = g.nodes.filter(F.col("kind").isin(*schema.CALLABLE_KINDS)).join(access.exported_ids(g), "id", "left_semi").select(F.col("id").alias("owner"), F.coalesce("label", F.lit("")).alias("owner_name"))
    routed = g.semantic("ROUTE_HANDLED_BY", "WIRES_TO").select(F.col("dst").alias("owner")).distinct().withColumn("routed", F.lit(True))
    p = g.nodes.filter("kind = 'parameter'").filter(F.coalesce(prop("provenance"), F.lit("application")).isin("application", "")).select(F.col("id").alias("value_id"), F.coalesce("label", F.lit("")).alias("name"), F.coalesce("type", F.lit("")).alias("type"), F.col("owner_function_id").alias("owner"))
    j = p.join(owner, "owner").join(routed, "owner", "left")
    boundary = c("routed").isNotNull() | c("owner_name").rlike(BOUNDARY_NAME)
    j = durable(j.withColumn("fact_kind", source_kind(c("name"), c("type"), boundary)).filter("fact_kind is not null"), "sources")
    sure = F.when(c("fact_kind") == "request-input", "high").otherwise("medium")
    sid = _id("generic-security-roles", "source", c("value_id"), owner="runtime-model")
    ev = [c("owner"), c("value_id")]
    nodes = [_nodes(j, sid, "source", F.concat(F.lit("public parameter:"), "name"), ev, sure, model_id=F.lit("generic-security-roles"), value_id=c("value_id"), source_kind=c("fact_kind"), function_id=c("owner"))]
    edges = [_edges(j, sid, c("value_id"), "TAINT_SOURCE", ev, confidence=sure)]
    call = g.nodes.filter(F.col("kind").isin(*schema.CALLSITE_KINDS)).select(F.col("id").alias("call_id"), "label", prop("value_id").alias("v"), F.coalesce(F.when(prop("method_name") != "", prop("method_name")), access.last_name(F.coalesce(prop("callee"), "label", F.lit("")))).alias("name"))
    call = durable(call, "named-calls")  # else every pattern decodes the name anew
    kind, sure = sink_class(c("name"))
    s = call.withColumn("fact_kind", kind).withColumn("sure", sure).filter("fact_kind is not null").join(g.nodes.select(F.col("id").alias("v"), F.lit(True).alias("known")), "v", "left").withColumn("value_id", F.when(c("known"), c("v")).otherwise(c("call_id")))
    s = durable(s, "sinks")
    kid = _id("generic-security-roles", "sink", c("call_id"), c("fact_kind"), owner="runtime-model")
    nodes.append(_nodes(s, kid, "sink", F.concat_ws(":", "fact_kind", F.coalesce("label", "name")), [c("call_id"), c("value_id")], c("sure"), model_id=F.lit("generic-security-roles"), value_id=c("value_id"), sink_kind=c("fact_kind"), callsite_id=c("call_id")))
    edges.append(_edges(s, kid, c("value_id"), "TAINT_SINK", [c("call_id"), c("value_id")], confidence=c("sure")))
    return Delta(_all(*nodes), _all(*edges))


# -- events ------------------------------------------------------------------------------------------------------
def async_events(g: Graph) -> Delta:
    """What runtime calls register, schedule and emit, by the behaviours of their effects, and where an await goes on."""
    c = F.col
    e = g.nodes.filter("kind = 'function-effect'").filter(prop("effect_kind") == "runtime-call")
    e = e.select(F.col("id").alias("effect_id"), prop("callsite_id").alias("call_id"), F.from_json(prop("behaviors"), "array<string>").alias("does"), prop("callback_argument").cast("int").alias("cb"), F.coalesce(prop("destination_argument").cast("int"), F.lit(0)).alias("dest"), prop("receiver_value_id").alias("receiver"), F.coalesce(prop("event_name"), F.lit("*")).alias("event"))
    e = e.withColumn("does", F.coalesce("does", F.array().cast("array<string>")))
    e = e.join(g.nodes.select(F.col("id").alias("call_id"), prop("value_id").alias("call_value")), "call_id")
    args = arguments(g).groupBy("call_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("position", F.lit(-1)).alias("p"), "argument_id"))), lambda x: x["argument_id"]).alias("args"))
    e = e.join(args, "call_id", "left").withColumn("args", F.coalesce("args", F.array().cast("array<string>")))
    e = e.withColumn("cb", F.when(c("cb") < 0, c("cb") + F.size("args")).otherwise(c("cb"))).withColumn("argument_id", F.when(c("cb") >= 0, F.get("args", c("cb"))))
    e = durable(e, "runtime-calls")
    passed = g.semantic("PASSES_CALLBACK").select(F.col("src").alias("argument_id"), F.col("dst").alias("callback")).join(g.nodes.select(F.col("id").alias("callback")), "callback", "left_semi")
    t = durable(e.filter("argument_id is not null").join(passed, "argument_id", "left").withColumn("target", F.coalesce("callback", "argument_id")), "callbacks")
    ev = [c("effect_id"), c("call_id"), c("target")]
    ev0 = [c("effect_id"), c("call_id")]
    does = lambda *b: F.arrays_overlap("does", F.array(*[F.lit(x) for x in b]))
    event = lambda kind, receiver=None, name=None: _id("async-events", "async-event", F.lit(kind) if isinstance(kind, str) else kind, F.coalesce("receiver", F.lit("global")) if receiver is None else receiver, c("event") if name is None else name)
    done = F.when(does("promise-continuation"), "fulfilled").when(does("promise-rejection"), "rejected").when(does("promise-finalizer"), "finally")
    category = F.when(does("worker-message"), "worker-message").when(does("message-publish"), "message-queue").otherwise("event")
    named = []
    for df, kind, cond in ((t, "event", does("event-registration")), (t, "message-queue", does("queue-consumer")), (e, category, does("emits-event")), (e, "message-queue", does("message-send", "message-publish"))):
        named.append(_nodes(df.filter(cond), event(kind), "async-event", F.concat_ws(":", F.lit(kind) if isinstance(kind, str) else kind, "event"), ev0, event_kind=F.lit(kind) if isinstance(kind, str) else kind, event_name=c("event"), receiver_value_id=c("receiver")))
    spawn = e.filter(does("worker-spawn"))
    named.append(_nodes(spawn, event("worker", c("call_id"), c("call_id")), "async-event", F.concat(F.lit("worker:"), "call_id"), ev0, event_kind=F.lit("worker"), event_name=c("call_id"), receiver_value_id=c("call_id")))
    edges = [
        _edges(t, c("call_id"), c("target"), "REGISTERS_CALLBACK", ev, effect_id=c("effect_id"), callback_position=c("cb")),
        _edges(t.filter(does("timer", "microtask")), c("call_id"), c("target"), "SCHEDULES", ev, queue=F.when(does("microtask"), "microtask").otherwise("timer")),
        _edges(t.filter(done.isNotNull()), F.coalesce("call_value", "call_id"), c("target"), "ASYNC_CONTINUES_AT", ev, completion=done),
        _edges(t.filter(does("event-registration")), event("event"), c("target"), "HANDLED_BY", ev, registration_call_id=c("call_id")),
        _edges(t.filter(does("queue-consumer")), event("message-queue"), c("target"), "HANDLED_BY", ev, registration_call_id=c("call_id")),
        _edges(e.filter(does("emits-event")), c("call_id"), event(category), "EMITS_EVENT", ev0, effect_id=c("effect_id")),
        _edges(e.filter(does("message-send", "message-publish")), c("call_id"), event("message-queue"), "SCHEDULES", ev0, queue=F.lit("message")),
        _edges(e.filter(does("stream-pipe", "stream-transform")).withColumn("to", F.get("args", c("dest"))), c("call_id"), c("to"), "SCHEDULES", ev0, queue=F.lit("stream")),
        _edges(spawn, c("call_id"), event("worker", c("call_id"), c("call_id")), "SCHEDULES", ev0, queue=F.lit("worker-thread")),
    ]
    waits = g.nodes.filter(F.col("kind").isin("expression", "operation")).filter(prop("operator") == "await").select("id")
    up = durable(g.semantic("AST_CHILD").filter("src is not null and dst is not null").groupBy(F.col("dst").alias("a")).agg(F.max("src").alias("b")), "parents")
    stmt = durable(g.nodes.filter("kind = 'statement'").select(F.col("id").alias("node")), "statements")
    found, _ = fixpoint(waits.select(F.col("id").alias("wait"), F.col("id").alias("node")), lambda f: f.join(stmt, "node", "left_anti").join(up, F.col("node") == up["a"]).select("wait", F.col("b").alias("node")), ["wait", "node"])
    nxt = g.semantic("CFG_NEXT", "TRUE_BRANCH", "FALSE_BRANCH", "SWITCH_CASE").select(F.col("src").alias("node"), F.col("dst").alias("next"))
    on = found.join(stmt, "node", "left_semi").join(nxt, "node")
    edges.append(_edges(on, c("wait"), c("next"), "ASYNC_CONTINUES_AT", [c("wait"), c("node"), c("next")], suspension=F.lit("await"), statement_id=c("node")))
    return Delta(_all(*named), _all(*edges))


# -- branches -----------------------------------------------------------------------------------------------------
def branch_history(g: Graph) -> Delta:
    """Phi nodes where control flow meets and the definitions that come in by its ways differ; what each read reads from then.

    A variable is a name in its owner; a statement that writes it is a definition. Where several ways
    into a statement bring different definitions of a variable, a phi takes their place; the reads are
    then solved anew, a phi standing for what it merges.
    """
    from weftgraph.operators import rules

    c = F.col
    nxt = durable(rules.cfg(g), "cfg")
    named = g.nodes.filter("label is not null and owner_function_id is not null").select(F.col("id").alias("dst"), F.concat_ws("/", "owner_function_id", "label").alias("variable"))
    touched = lambda kind: g.semantic(kind).filter("src is not null").select("src", "dst").distinct().join(named, "dst").select(F.col("src").alias("at"), "variable").distinct()
    w, r = durable(touched("WRITES_TO"), "writes"), durable(touched("READS_FROM"), "reads")
    merge = durable(nxt.filter("a <> b").groupBy(F.col("b").alias("at")).agg(F.count(F.lit(1)).alias("ways")).filter("ways > 1").select("at"), "merges")

    def solve(defs: DataFrame) -> DataFrame:
        """(def_id, variable, at): definitions that stand behind each statement, ``defs`` (def_id, variable, at, inside) stopping the others."""
        stops = durable(defs.select("at", "variable").distinct(), "stops")
        # behind a statement: its own definitions, and what came in and is not stopped there
        seed = defs.select("def_id", "variable", "at")
        step = lambda f: f.join(nxt, f["at"] == nxt["a"]).select("def_id", "variable", F.col("b").alias("at")).join(stops, ["at", "variable"], "left_anti").select("def_id", "variable", "at")
        found, _ = fixpoint(seed, step, ["def_id", "variable", "at"])
        return found.select("def_id", "variable", "at")

    own = w.select(F.col("at").alias("def_id"), "variable", "at")
    out = durable(solve(own), "solved")
    into = lambda o: nxt.select(F.col("a").alias("at"), F.col("b").alias("to")).join(o, "at").select("to", "variable", "at", "def_id")
    meet = into(out).join(merge.withColumnRenamed("at", "to"), "to", "left_semi").groupBy("to", "variable").agg(F.countDistinct("def_id").alias("n"), F.countDistinct("at").alias("ways")).filter("n > 1 and ways > 1")
    phi = durable(meet.select(_id("branch-history", "phi", c("to"), c("variable")).alias("phi"), "variable", F.col("to").alias("at")), "phi")
    # a phi stands before its statement: it replaces what comes in, and a write of the statement replaces it
    again = phi.join(w, ["at", "variable"], "left_anti").select(F.col("phi").alias("def_id"), "variable", "at")
    out2 = out if again.isEmpty() else durable(solve(again.unionByName(own)), "solved")
    # into a statement: its phi, else what stands behind the ways in
    came = into(out2).join(phi.select(F.col("at").alias("to"), "variable"), ["to", "variable"], "left_anti").select(F.col("to").alias("at"), "variable", "def_id").unionByName(phi.select("at", "variable", F.col("phi").alias("def_id"))).distinct()
    came = durable(came, "came")
    inputs = into(out2).join(phi.select(F.col("at").alias("to"), "variable", "phi"), ["to", "variable"]).select("phi", "def_id", "at").filter("phi <> def_id").distinct()
    reads = came.join(r, ["at", "variable"])
    prev = came.join(w, ["at", "variable"]).filter("def_id <> at")
    nodes = _nodes(phi, c("phi"), "phi", F.concat(F.lit("phi:"), "variable"), [c("at")], symbol=c("variable"), merge_id=c("at"))
    edges = _all(
        _edges(phi, c("phi"), c("at"), "PHI_AT", [c("at")]),
        _edges(inputs, c("def_id"), c("phi"), "PHI_INPUT", [c("def_id"), c("at")]),
        _edges(inputs, c("def_id"), c("phi"), "VALUE_FLOWS_TO", [c("def_id"), c("at")], "phi-input"),
        _edges(reads, c("at"), c("def_id"), "BRANCH_READS_FROM", [c("at"), c("def_id")]),
        _edges(reads, c("def_id"), c("at"), "VALUE_FLOWS_TO", [c("at"), c("def_id")], "branch-reaching-definition"),
        _edges(prev, c("at"), c("def_id"), "BRANCH_PREVIOUS", [c("at"), c("def_id")]),
    )
    return Delta(nodes, edges)


def out_parameters(g: Graph, written: DataFrame) -> Delta:
    """Flows from arguments (id) that a callee writes back to the one variable that each of them comes from."""
    from weftgraph.operators.tools import nearest_variables

    near = nearest_variables(g, written.select("id"), "variable")
    linked = g.semantic("VALUE_FLOWS_TO").select(F.col("src").alias("seed"), F.col("dst").alias("variable"))
    new = near.join(linked, ["seed", "variable"], "left_anti")
    return Delta(None, _edges(new, F.col("seed"), F.col("variable"), "VALUE_FLOWS_TO", [F.col("seed"), F.col("variable")], inference=F.lit("out-param-writeback")))


def taint_facts(g: Graph) -> Delta:
    """Taint witnesses as nodes between their source and sink, and the edges that tainted values walk."""
    from weftgraph.operators import reach

    c = F.col
    sources, sinks = reach.role_facts(g)
    ground = reach.taint_ground(g, sources, sinks)
    found = durable(reach.taint(g, sources, sinks, ground=ground), "taint")
    rid = _id("taint-propagation", "taint-reach", c("source_id"), c("sink_id"))
    nodes = found.select(rid.alias("id"), F.lit("taint-reach").alias("kind"), F.concat_ws(" > ", "source_id", "sink_id").alias("label"), "confidence", F.to_json(F.struct("source_id", "sink_id", F.col("source_value").alias("source_value_id"), F.col("sink_value").alias("sink_value_id"), F.col("path").alias("witness_ids"))).alias("props"), F.col("path").alias("evidence_ids"))
    flows = reach.taint_flows(g, sources, sinks, ground=ground)
    edges = _all(
        _edges(found, c("source_id"), rid, "TAINT_REACHES", [c("source_value"), c("sink_value")], confidence=c("confidence")),
        _edges(found, rid, c("sink_id"), "TAINT_REACHES", [c("source_value"), c("sink_value")], confidence=c("confidence")),
        _edges(flows, c("src"), c("dst"), "TAINT_FLOWS_TO", [c("src"), c("dst")], context=c("context_id"), transition=c("transition")),
    )
    return Delta(nodes, edges)


def with_exports(g: Graph, files: DataFrame) -> Graph:
    """The graph with an EXPORTS edge from each file to what it contains under a name that its record exports."""
    named = files.filter("file_id is not null").select(F.col("file_id").alias("src"), F.explode("exports").alias("label")).filter("label is not null").distinct()
    inside = g.semantic("CONTAINS").select("src", F.col("dst").alias("id")).distinct()
    e = inside.join(g.nodes.select("id", "label"), "id").join(named, ["src", "label"], "left_semi")
    return absorb(g, Delta(None, _edges(e, F.col("src"), F.col("id"), "EXPORTS", [F.col("src"), F.col("id")])))[0]


def _has_edges(*kinds: str) -> Callable[[Graph], bool]:
    return lambda g: not g.semantic(*kinds).isEmpty()


def all_rules() -> list[Rule]:
    """All rules in order, those of the runtimes before what reads their effects."""
    from weftgraph.operators.runtime import RULE

    at = next(i for i, r in enumerate(RULES) if r.name == "generic-security-roles")
    return [*RULES[:at], RULE, *RULES[at:]]


#: The rules of the core in the order in which they build on each other.
RULES: list[Rule] = [
    Rule("branch-history", _has_edges("CFG_NEXT"), branch_history),
    Rule("dynamic-dispatch", has_kind("call"), dispatch),
    Rule("dynamic-behavior", has_kind("call"), dynamic_behavior),
    Rule("interprocedural-contexts", has_kind("call", "construct"), contexts),
    Rule("heap-identity", has_kind("allocation"), heap),
    Rule("module-initialization", has_kind("file"), module_initialization),
    Rule("parameter-property-effects", _has_edges("WRITES_PARAMETER_PROPERTY"), parameter_effects),
    Rule("generic-web-routes", lambda g: not g.nodes.filter("kind = 'call'").filter(F.lower(prop("method_name")).isin(*ROUTE_METHODS)).isEmpty(), routes),
    Rule("generic-security-roles", has_kind("function", "method", "call", "construct"), security_roles),
    Rule("async-events", lambda g: has_kind("function-effect")(g) or not g.nodes.filter(prop("operator") == "await").isEmpty(), async_events),
    Rule("taint-propagation", has_kind("source"), taint_facts),
]
