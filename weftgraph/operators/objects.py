"""What functions do to objects: events of a variable, leaks and misuses, summaries of parameters, object states.

Events come from the graph: a call bound to a runtime model does to its first argument what the
model says, any other call lets it escape. Defined cases: calls without an argument or outside a
callable give no event; events on one place are taken in order of their call's id; a variable is a
name in its function; repeated edges count once; empty graphs give no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph import schema
from weftgraph.graph import Graph
from weftgraph.operators import navigate
from weftgraph.operators.reach import arguments, prop
from weftgraph.plans.durable import durable
from weftgraph.plans.fixpoint import fixpoint


def first_arguments(g: Graph) -> DataFrame:
    """(call_id, argument_id): the first argument of each call."""
    return arguments(g).groupBy("call_id").agg(F.min(F.struct(F.coalesce("position", F.lit(1 << 40)).alias("p"), "argument_id")).alias("x")).select("call_id", F.col("x.argument_id").alias("argument_id"))


def variable_events(g: Graph, bindings: DataFrame) -> DataFrame:
    """(function, variable, at, call_id, event): what calls do to the variables of each function, in order of place.

    ``bindings`` are (call_id, effect) with the effects alloc, free and use.
    """
    own = navigate.owner_callables(g).select(F.col("id").alias("call_id"), F.col("callable_id").alias("function"))
    site = g.nodes.filter(F.col("kind").isin(*schema.CALLSITE_KINDS)).select(F.col("id").alias("call_id"), F.coalesce("start_offset", F.lit(0)).alias("at")).join(own, "call_id")
    named = g.nodes.select(F.col("id").alias("argument_id"), F.col("label").alias("variable")).filter("variable is not null")
    event = bindings.filter(F.col("effect").isin("alloc", "free", "use")).groupBy("call_id").agg(F.min("effect").alias("event"))
    j = site.join(first_arguments(g), "call_id").join(named, "argument_id").join(event, "call_id", "left")
    return j.select("function", "variable", "at", "call_id", F.coalesce("event", F.lit("escape")).alias("event"))


def leaks(events: DataFrame) -> DataFrame:
    """(function, variable): allocated, never freed, never let go."""
    has = lambda e: F.count_if(F.col("event") == e) > 0
    per = events.groupBy("function", "variable").agg(has("alloc").alias("a"), has("free").alias("f"), has("escape").alias("e"))
    return per.filter("a and not f and not e").select("function", "variable")


def misuses(events: DataFrame) -> DataFrame:
    """(function, variable, call_id, finding): frees of what is free already and uses after a free; an allocation clears."""
    w = Window.partitionBy("function", "variable").orderBy("at", "call_id")
    e = events.withColumn("life", F.count_if(F.col("event") == "alloc").over(w))
    inside = Window.partitionBy("function", "variable", "life").orderBy("at", "call_id").rowsBetween(Window.unboundedPreceding, -1)
    freed = F.coalesce(F.max(F.col("event") == "free").over(inside), F.lit(False))
    finding = F.when((F.col("event") == "free") & freed, "double-free").when((F.col("event") == "use") & freed, "use-after-free")
    return e.withColumn("finding", finding).filter("finding is not null").select("function", "variable", "call_id", "finding")


def parameter_summaries(g: Graph, bindings: DataFrame) -> DataFrame:
    """(function, position, effect, distance): what a function does to each of its parameters, itself (0) or through calls.

    Bottom-up over all functions at once: a call that hands a parameter on has the effects that its
    target has on the parameter at that place; recursion is no matter to the fixpoint.
    """
    param = g.nodes.filter("kind = 'parameter' and owner_function_id is not null").select(F.col("id").alias("argument_id"), F.col("owner_function_id").alias("function"), F.coalesce(prop("parameter_position").cast("long"), F.lit(0)).alias("position"))
    handed = arguments(g).select("call_id", "argument_id", F.coalesce("position", F.lit(0)).alias("given")).join(param, "argument_id").select("call_id", "given", "function", "position").distinct()
    handed = durable(handed, "handed")
    direct = handed.filter("given = 0").join(bindings.filter(F.col("effect").isin("alloc", "free", "use")).select("call_id", "effect").distinct(), "call_id").select("function", "position", "effect")
    to = g.semantic("INVOKES", "CALLS").filter("src is not null and dst is not null").select(F.col("src").alias("call_id"), F.col("dst").alias("target")).distinct()
    links = durable(handed.join(to, "call_id").select("target", "given", F.col("function").alias("up"), F.col("position").alias("up_position")).distinct(), "hands-on")
    step = lambda f: f.join(links, (f["function"] == links["target"]) & (f["position"] == links["given"])).select(F.col("up").alias("function"), F.col("up_position").alias("position"), "effect")
    found, _ = fixpoint(direct, step, ["function", "position", "effect"])
    return found.select("function", "position", "effect", F.col("round").cast("long").alias("distance"))


def lifetime_slice(g: Graph, bindings: DataFrame) -> DataFrame:
    """(id): functions that calls connect, either way, with one in which an object is allocated, freed or let go."""
    p = durable(navigate.union_call_pairs(g), "pairs")
    both = durable(p.select(F.col("caller").alias("a"), F.col("callee").alias("b")).unionByName(p.select(F.col("callee").alias("a"), F.col("caller").alias("b"))).distinct(), "both")
    seeds = variable_events(g, bindings).filter("event <> 'use'").select(F.col("function").alias("id")).distinct()
    found, _ = fixpoint(seeds, lambda f: f.join(both, f["id"] == both["a"]).select(F.col("b").alias("id")), ["id"])
    return found.select("id")


# -- object states ----------------------------------------------------------------------------------
#: States of a function's place beyond which they are merged into one, each variable's objects and each object's facts joined.
DISJUNCTS = 64

OPS = "function string, node string, place long, op string, target string, source string"


def analyse(ops: list[tuple], nxt: list[tuple[str, str]], most: int = DISJUNCTS) -> list[tuple[str, str, str]]:
    """(node, variable, finding) of one function: ops (node, place, op, target, source) along the links between nodes.

    Ops are alloc, null, copy (target from source), free, use and clobber (anything). An object is an
    allocation site, its latest instance; a new allocation there ages the one before into a summary,
    of which nothing is told for sure. A state is what each variable holds and what each object is.
    """
    per: dict[str, list[tuple]] = {}
    nodes: list[str] = []
    for node, place, op, target, source in sorted(ops, key=lambda o: (str(o[0]), o[1])):
        per.setdefault(node, []).append((op, target, source))
    after: dict[str, list[str]] = {}
    before: set[str] = set()
    for a, b in nxt:
        after.setdefault(a, []).append(b)
        before.add(b)
        nodes += [a, b]
    nodes = sorted(set(nodes) | set(per))
    found: set[tuple[str, str, str]] = set()
    fact = dict[str, frozenset]

    def run(state: tuple, node: str) -> tuple:
        env, facts = dict(state[0]), dict(state[1])

        def objects(v: str) -> frozenset:
            if v not in env:
                env[v] = frozenset({f"unknown:{v}"})
                facts.setdefault(f"unknown:{v}", frozenset({"live"}))
            return env[v]

        for op, target, source in per.get(node, []):
            if op == "alloc":
                new, old = f"site:{node}", f"old:{node}"
                if new in facts:  # the instance before becomes one of many
                    facts[old] = facts.get(old, frozenset()) | facts.pop(new)
                    env = {v: frozenset(old if o == new else o for o in os) for v, os in env.items()}
                facts[new] = frozenset({"live"})
                env[target] = frozenset({new})
            elif op == "null":
                env[target] = frozenset({"null"})
            elif op == "copy":
                env[target] = objects(source)
            elif op == "clobber":
                env.pop(target, None)
                env[target] = frozenset({f"any:{node}:{target}"})
                facts[f"any:{node}:{target}"] = frozenset({"live"})
            elif op in ("free", "use"):
                held = objects(target) - {"null"}
                sure = [o for o in held if facts.get(o) == frozenset({"freed"}) and not o.startswith("old:")]
                may = [o for o in held if "freed" in facts.get(o, ()) and not o.startswith("old:")]
                name = "double-free" if op == "free" else "use-after-free"
                if held and (len(sure) == len(objects(target)) or (may and len(held) == len(objects(target)) == 1)):
                    found.add((node, target, name))
                if op == "free":
                    for o in held:
                        strong = len(held) == 1 and not o.startswith("old:")
                        facts[o] = frozenset({"freed"}) if strong else facts.get(o, frozenset()) | {"freed"}
        used = {o for os in env.values() for o in os}
        return (frozenset(env.items()), frozenset((o, f) for o, f in facts.items() if o in used))

    def merged(states: set) -> tuple:
        env: dict[str, frozenset] = {}
        facts: fact = {}
        for e, f in states:
            for v, os in e:
                env[v] = env.get(v, frozenset()) | os
            for o, x in f:
                facts[o] = facts.get(o, frozenset()) | x
        return (frozenset(env.items()), frozenset(facts.items()))

    empty = (frozenset(), frozenset())
    starts = [n for n in nodes if n not in before] or nodes[:1]
    into: dict[str, set] = {n: {empty} for n in starts}
    wide: set[str] = set()
    todo = list(starts)
    while todo:
        node = todo.pop(0)
        for s in after.get(node, []) or [None]:
            out = {run(x, node) for x in into[node]}
            if s is None:
                break
            have = into.setdefault(s, set())
            new = out | have
            if s in wide or len(new) > most:  # once wide, a place stays wide
                wide.add(s)
                new = {merged(new)}
            if new != have:
                into[s] = new
                if s not in todo:
                    todo.append(s)
    for node in nodes:
        for x in into.get(node, ()):
            run(x, node)
    return sorted(found)


def object_states(ops: DataFrame, cfg: DataFrame, most: int = DISJUNCTS) -> DataFrame:
    """(function, node, variable, finding) of :func:`analyse` for every function; ``ops`` as :data:`OPS`, ``cfg`` (function, a, b).

    A function is one group: its statements are few beside the table's rows.
    """
    kinds = "function string, node string, place long, op string, target string, source string, a string, b string"
    none = lambda *cs: [F.lit(None).cast("string").alias(c) for c in cs]
    rows = ops.select("function", "node", "place", "op", "target", "source", *none("a", "b")).unionByName(cfg.select("function", *none("node"), F.lit(None).cast("long").alias("place"), *none("op", "target", "source"), "a", "b"))
    assert [f.name for f in rows.schema] == [k.split()[0] for k in kinds.split(", ")]

    def run(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        t = t.astype(object).where(t.notna(), None)
        o = [tuple(r) for r in t[t["op"].notna()][["node", "place", "op", "target", "source"]].itertuples(index=False)]
        links = [tuple(r) for r in t[t["a"].notna()][["a", "b"]].itertuples(index=False)]
        return pd.DataFrame([(key[0], *f) for f in analyse(o, links, most)], columns=["function", "node", "variable", "finding"])

    return rows.filter("function is not null").groupBy("function").applyInPandas(run, "function string, node string, variable string, finding string")


def graph_operations(g: Graph, bindings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The operations on variables and the control flow of every function of the graph, for :func:`object_states`."""
    stmt = g.semantic("AST_CHILD").filter("src is not null and dst is not null").select(F.col("src").alias("node"), F.col("dst").alias("call_id"))
    ev = variable_events(g, bindings).join(stmt, "call_id").filter("event <> 'escape'")
    ops = ev.select("function", "node", F.col("at").alias("place"), F.col("event").alias("op"), F.col("variable").alias("target"), F.lit(None).cast("string").alias("source")).distinct()
    own = navigate.owner_callables(g).select(F.col("id").alias("a"), F.col("callable_id").alias("function"))
    cfg = g.semantic("CFG_NEXT").filter("src is not null and dst is not null").select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct().join(own, "a").select("function", "a", "b")
    return ops, cfg.join(ops.select("function").distinct(), "function", "left_semi")
