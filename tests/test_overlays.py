from __future__ import annotations

import json

import pytest

from weftgraph import schema
from weftgraph.graph import Graph
from weftgraph.operators import overlays

NODE = "id string, kind string, label string, confidence string, props string, file string, absolute_file string, owner_function_id string, function_id string, unit string, type string, start_line long, end_line long, start_offset long, end_offset long, language string"
EDGE = "row_id long, src string, dst string, kind string, semantic_kind string, reason string, context_id string, position long, confidence string, props string, unit string"


def graph(spark, nodes, edges):
    """Nodes (id, kind, props, columns) and edges (src, dst, kind, props, columns)."""
    ncols, ecols = [c.split()[0] for c in NODE.split(", ")], [c.split()[0] for c in EDGE.split(", ")]
    ns, es = [], []
    for n in nodes:
        row = {"id": n[0], "kind": n[1], "label": n[0], "props": json.dumps(n[2]) if len(n) > 2 and n[2] else None} | (n[3] if len(n) > 3 else {})
        ns.append(tuple(row.get(c) for c in ncols))
    for i, e in enumerate(edges):
        row = {"row_id": i, "src": e[0], "dst": e[1], "kind": e[2], "props": json.dumps(e[3]) if len(e) > 3 and e[3] else None} | (e[4] if len(e) > 4 else {})
        es.append(tuple(row.get(c) for c in ecols))
    return Graph(spark.createDataFrame(ns, NODE), spark.createDataFrame(es, EDGE))


def edges_of(delta):
    return {(r.kind, r.src, r.dst): r.reason for r in delta.edges.filter("src <> dst").collect()}


def ident(spark, rule, kind, *parts):
    from pyspark.sql import functions as F

    return spark.range(1).select(schema.stable_id("core", F.lit(rule), F.lit(kind), *[F.lit(p) for p in parts]).alias("x")).first().x


def test_dispatch(spark):
    nodes = [(f, "method") for f in ("base", "mid", "leaf", "cb", "fv", "twin1", "twin2", "lone")] + [(f"c{i}", "call", p) for i, p in enumerate([{}, {}, {}, {"receiver_value_id": "val"}, {"callee": "x.lone"}, {"callee": "twin()"}, {"callee": "lone", "primary_target_id": "z"}, {"callee": "nobody"}])]
    nodes += [("root", "expression"), ("inner", "identifier"), ("p", "parameter"), ("root2", "expression"), ("arg", "argument"), ("val", "variable"), ("rd", "read")]
    nodes[5], nodes[6] = ("twin1", "method", {"name": "twin"}), ("twin2", "function", {"name": "twin"})
    edges = [
        ("c0", "base", "INVOKES"), ("mid", "base", "OVERRIDES"), ("mid", "leaf", "IMPLEMENTED_BY"), ("c1", "root", "AST_CHILD", {"role": "CALLEE"}), ("root", "inner", "AST_CHILD"), ("inner", "val", "REFERS_TO"), ("fv", "val", "FUNCTION_VALUE"),
        ("c2", "root2", "AST_CHILD", {"role": "CALLEE"}), ("root2", "p", "REFERS_TO"), ("arg", "p", "ARGUMENT_BINDS_PARAMETER"), ("arg", "cb", "PASSES_CALLBACK"), (None, "val", "REFERS_TO"),
    ]
    got = edges_of(overlays.dispatch(graph(spark, nodes, edges)))
    assert got == {
        ("MAY_INVOKE", "c0", "mid"): "override-or-interface-implementation", ("MAY_INVOKE", "c0", "leaf"): "override-or-interface-implementation", ("MAY_INVOKE", "c1", "fv"): "function-valued-reference",
        ("MAY_INVOKE", "c2", "cb"): "contextual-callback-binding", ("MAY_INVOKE", "c3", "fv"): "callable-receiver", ("MAY_INVOKE", "c4", "lone"): "name-fallback",
        ("MAY_INVOKE", "c5", "twin1"): "name-fallback-polymorphic", ("MAY_INVOKE", "c5", "twin2"): "name-fallback-polymorphic",
    }


def test_contexts_and_heap(spark):
    nodes = [
        ("make", "function"), ("alloc", "allocation", {"allocation_kind": "object"}, {"owner_function_id": "make"}), ("ret", "return-value"), ("call", "call", {"value_id": "cv"}, {"owner_function_id": "main"}), ("cv", "call-value"), ("x", "variable"),
        ("fill", "function"), ("p", "parameter", {}, {"owner_function_id": "fill"}), ("pd", "definition", {"origin": "parameter", "target_id": "p"}), ("arg", "argument", {"callsite_id": "call2"}), ("call2", "call", {}, {"owner_function_id": "main"}),
        ("pp", "property-path", {"base_value_id": "p", "path_segments": [{"key": "f"}]}), ("w", "write", {"target_id": "pp", "value_id": "inner"}, {"owner_function_id": "fill"}), ("inner", "allocation", {}, {"owner_function_id": "fill"}),
        ("xp", "property-path", {"base_value_id": "x", "path": "f"}), ("rd", "read", {"target_id": "xp"}), ("deep", "property-path", {"base_value_id": "x", "path_segments": [{"key": "g"}, {"dynamic": True}]}), ("wd", "write", {"target_id": "deep", "value_id": "x"}), ("prim", "parameter", {"value_category": "primitive"}),
    ]
    edges = [
        ("call", "make", "INVOKES"), ("ret", "make", "RETURNS_VALUE"), ("alloc", "ret", "VALUE_FLOWS_TO", None, {"reason": "return"}), ("cv", "x", "VALUE_FLOWS_TO", None, {"reason": "initializer"}), ("x", "arg", "VALUE_FLOWS_TO", None, {"reason": "argument-value"}),
        ("call2", "fill", "INVOKES"), ("arg", "p", "ARGUMENT_BINDS_PARAMETER", None, {"position": 0}), ("p", "pd", "DEFINES"), ("x", "other", "VALUE_FLOWS_TO", None, {"reason": "arithmetic-operand"}),
    ]
    g, report = overlays.fold(graph(spark, nodes, edges), [r for r in overlays.RULES if r.name in ("interprocedural-contexts", "heap-identity")])
    assert [r[0] for r in report] == ["interprocedural-contexts", "heap-identity"] and all(n and m for _, n, m in report)
    ctx = ident(spark, "interprocedural-contexts", "call-context", "call", "make")
    ctx2 = ident(spark, "interprocedural-contexts", "call-context", "call2", "fill")
    obj = ident(spark, "heap-identity", "heap-object", "alloc")
    clone = ident(spark, "heap-identity", "heap-object", "context", ctx, obj)
    points = {}
    for r in g.edges.filter("kind = 'POINTS_TO'").collect():
        points.setdefault(r.src, set()).add(r.dst)
    assert points["alloc"] == {obj} and points["ret"] == {obj}
    assert points["x"] == points["cv"] == points["arg"] == {clone}
    inner = ident(spark, "heap-identity", "heap-object", "inner")
    assert points["rd"] == {inner}  # written in the callee, read in the caller
    formal = ident(spark, "heap-identity", "heap-object", "parameter", "p")
    assert formal in points["p"] and formal in points["pd"] and "prim" not in points
    child = ident(spark, "heap-identity", "heap-object", "property", clone, "g")
    loc_g = ident(spark, "heap-identity", "heap-location", clone, "g")
    star = ident(spark, "heap-identity", "heap-location", child, "[*]")
    assert points[loc_g] == {child} and points[star] == {clone} and {loc_g} <= points[clone]
    loc_f = ident(spark, "heap-identity", "heap-location", clone, "f")
    have = {(r.kind, r.src, r.dst) for r in g.edges.collect()}
    assert {("WRITES_HEAP", "w", loc_f), ("APPLIES_EFFECT", ctx2, loc_f), ("READS_HEAP", loc_f, "rd"), ("CONTEXT_ALLOCATES", ctx, clone), ("WRITES_HEAP", "wd", star), ("HAS_CALL_CONTEXT", "call", ctx)} <= have
    assert len([1 for k, s, d in have if k == "MUTATES" and s == "fill"]) == 1
    again, second = overlays.fold(g, [overlays.RULES[3]])
    assert second[0][1:] == (0, 0)  # nothing is added twice


def test_modules(spark):
    nodes = [
        ("f1", "file"), ("f2", "file"), ("f3", "file"), ("d", "file", {"declaration_file": True}), ("v", "variable", {"symbol_kind": "const"}), ("m", "variable", {"symbol_kind": "let"}), ("far", "variable"), ("typed", "variable"),
        ("a", "allocation", {"allocation_kind": "array", "allocated_type": "T"}), ("cv", "call-value", {"value_category": "primitive"}), ("cv2", "call-value"), ("s1", "expression"), ("s2", "expression"), ("s3", "expression"), ("w", "write", {"write_kind": "assignment"}),
    ]
    edges = [("f1", v, "DECLARES_VALUE") for v in ("v", "m", "far")] + [("d", "typed", "DECLARES_VALUE"), ("a", "s1", "VALUE_FLOWS_TO"), ("s1", "v", "VALUE_FLOWS_TO"), ("cv", "m", "VALUE_FLOWS_TO"), ("cv2", "s1", "VALUE_FLOWS_TO"), ("a", "s2", "VALUE_FLOWS_TO"), ("s2", "s3", "VALUE_FLOWS_TO"), ("s3", "far", "VALUE_FLOWS_TO"), ("cv2", "typed", "VALUE_FLOWS_TO")]
    edges += [("f1", "f2", "DEPENDS_ON"), ("f2", "f1", "RE_EXPORTS"), ("f2", "f3", "DEPENDS_ON"), ("f3", "f3", "RUNTIME_DEPENDS_ON"), (None, "v", "EXPORTS"), ("w", "far", "WRITES_TO")]
    delta = overlays.module_initialization(graph(spark, nodes, edges))
    rows = {(r.kind, json.loads(r.props).get("symbol_id"), json.loads(r.props).get("singleton_kind") or json.loads(r.props).get("state_kind")): json.loads(r.props) for r in delta.nodes.collect()}
    assert {k for k in rows if k[0] == "singleton"} == {("singleton", "v", "array"), ("singleton", "v", "factory"), ("singleton", "far", "array")}
    assert {k for k in rows if k[0] == "module-state"} == {("module-state", "m", "reassignable"), ("module-state", "far", "mutated"), ("module-state", "v", "mutable-allocation")}
    assert rows["module-state", "v", "mutable-allocation"]["exported"] is True
    assert {s for k, s, _ in edges_of(delta) if k == "PARTICIPATES_IN_IMPORT_CYCLE"} == {"f1", "f2", "f3"} and len({d for k, _, d in edges_of(delta) if k == "PARTICIPATES_IN_IMPORT_CYCLE"}) == 2


def test_effects_routes_and_roles(spark):
    nodes = [
        ("set", "function"), ("prop", "property"), ("o", "variable"), ("h", "function"), ("call", "call", {"primary_target_id": "set", "argument_value_ids": ["o", "h"]}), ("use", "call", {"receiver_value_id": "o", "receiver_member_id": "prop"}), ("short", "call", {"primary_target_id": "set", "argument_value_ids": ["o"]}),
        ("get", "call", {"method_name": "GET"}), ("ra", "argument", {"callsite_id": "get", "position": 0, "literal": True, "literal_value": "/x"}), ("rb", "argument", {"callsite_id": "get", "position": 1}), ("hp2", "parameter", {"parameter_position": 1}, {"owner_function_id": "h"}), ("hp1", "parameter", {"parameter_position": 0}, {"owner_function_id": "h"}),
        ("use2", "call", {"method_name": "use"}), ("ua", "argument", {"callsite_id": "use2", "position": 0}), ("nopath", "call", {"method_name": "post"}), ("exp", "function"), ("requestBody", "parameter", {}, {"owner_function_id": "exp"}), ("docId", "parameter", {}, {"owner_function_id": "exp"}), ("secretId", "parameter", {}, {"owner_function_id": "exp"}),
        ("typed", "parameter", {}, {"owner_function_id": "exp", "type": "a.Request"}), ("lib", "parameter", {"provenance": "dependency"}, {"owner_function_id": "exp"}), ("handleIt", "function"), ("plain", "parameter", {}, {"owner_function_id": "handleIt"}), ("hidden", "parameter", {}, {"owner_function_id": "set"}),
        ("k1", "call", {"callee": "db.query(x)", "value_id": "o"}), ("k2", "call", {"callee": "fs.renameSync"}), ("k3", "call", {"callee": "executeRoom"}),
    ]
    edges = [("set", "prop", "WRITES_PARAMETER_PROPERTY", {"receiver_position": 0, "value_position": 1}), ("rb", "h", "PASSES_CALLBACK"), ("ua", "syn", "EVIDENCED_BY"), ("syn", "h", "REFERS_TO"), ("f", "exp", "EXPORTS"), ("f", "handleIt", "EXPORTS"), ("f", "prop", "EXPORTS")]
    g = graph(spark, nodes, edges)
    d = overlays.parameter_effects(g)
    assert {k[0] for k in edges_of(d)} == {"APPLIES_EFFECT", "POINTS_TO", "WRITES_HEAP", "READS_HEAP", "MAY_INVOKE"} and ("MAY_INVOKE", "use", "h") in edges_of(d) and d.nodes.count() == 1
    d = overlays.routes(g)
    assert {r.label for r in d.nodes.filter("kind = 'route'").collect()} == {"GET /x", "USE *"}
    assert {r.confidence for r in d.nodes.filter("kind = 'route'").collect()} == {"high"} and {json.loads(r.props)["value_id"] for r in d.nodes.filter("kind = 'source'").collect()} == {"hp1"}
    d = overlays.security_roles(g)
    facts = {(r.kind, json.loads(r.props)["value_id"], json.loads(r.props).get("source_kind") or json.loads(r.props).get("sink_kind"), r.confidence) for r in d.nodes.collect()}
    assert facts == {
        ("source", "requestBody", "request-input", "high"), ("source", "docId", "resource-identifier", "medium"), ("source", "typed", "request-input", "high"), ("source", "plain", "boundary-parameter", "medium"),
        ("sink", "o", "database", "high"), ("sink", "k2", "filesystem-write", "medium"),
    }


def test_events(spark):
    nodes = [
        ("call", "call", {"value_id": "pv"}), ("cb", "function"), ("a0", "argument", {"callsite_id": "call", "position": 0}), ("a1", "argument", {"callsite_id": "call", "position": 1}),
        ("e1", "function-effect", {"effect_kind": "runtime-call", "callsite_id": "call", "behaviors": ["timer", "promise-rejection", "event-registration"], "callback_argument": -1, "receiver_value_id": "r", "event_name": "go"}),
        ("call2", "call"), ("e2", "function-effect", {"effect_kind": "runtime-call", "callsite_id": "call2", "behaviors": ["emits-event", "worker-spawn"], "receiver_value_id": "r", "event_name": "go"}), ("e3", "function-effect", {"effect_kind": "other", "callsite_id": "call2"}),
        ("aw", "expression", {"operator": "await"}), ("mid", "expression"), ("st", "statement"), ("nx", "statement"),
    ]
    edges = [("a1", "cb", "PASSES_CALLBACK"), ("mid", "aw", "AST_CHILD"), ("st", "mid", "AST_CHILD"), ("body", "st", "AST_CHILD"), ("st", "nx", "CFG_NEXT")]
    d = overlays.async_events(graph(spark, nodes, edges))
    got = edges_of(d)
    ev = ident(spark, "async-events", "async-event", "event", "r", "go")
    worker = ident(spark, "async-events", "async-event", "worker", "call2", "call2")
    assert set(got) == {("REGISTERS_CALLBACK", "call", "cb"), ("SCHEDULES", "call", "cb"), ("ASYNC_CONTINUES_AT", "pv", "cb"), ("HANDLED_BY", ev, "cb"), ("EMITS_EVENT", "call2", ev), ("SCHEDULES", "call2", worker), ("ASYNC_CONTINUES_AT", "aw", "nx")}
    assert {r.id for r in d.nodes.collect()} == {ev, worker}


def test_branches(spark):
    # s0: x=..; s1: if -> s2: x=.. | s3: y; both -> s4 reads x; s4 -> s5 writes x -> s6 reads x; a loop s6 -> s4
    nodes = [(f"s{i}", "statement", {}, {"owner_function_id": "f"}) for i in range(7)] + [("x1", "identifier", {}, {"owner_function_id": "f", "label": "x"})]
    edges = [("s0", "s1", "CFG_NEXT"), ("s1", "s2", "CFG_NEXT"), ("s1", "s3", "CFG_NEXT"), ("s2", "s4", "CFG_NEXT"), ("s3", "s4", "CFG_NEXT"), ("s4", "s5", "CFG_NEXT"), ("s5", "s6", "CFG_NEXT"), ("s6", "s4", "CFG_NEXT")]
    edges += [(s, "x1", "WRITES_TO") for s in ("s0", "s2", "s5")] + [(s, "x1", "READS_FROM") for s in ("s3", "s4", "s6")]
    d = overlays.branch_history(graph(spark, nodes, edges))
    got = edges_of(d)
    phi = ident(spark, "branch-history", "phi", "s4", "f/x")
    assert {r.id for r in d.nodes.collect()} == {phi}
    assert {s for k, s, t in got if k == "PHI_INPUT" and t == phi} == {"s0", "s2", "s5"}
    assert {(s, t) for k, s, t in got if k == "BRANCH_READS_FROM"} == {("s3", "s0"), ("s4", phi), ("s6", "s5")}
    assert {(s, t) for k, s, t in got if k == "BRANCH_PREVIOUS"} == {("s2", "s0"), ("s5", phi)}


def test_taint_rule_and_own_rules(spark):
    nodes = [("src", "source", {"value_id": "v"}), ("v", "parameter"), ("snk", "sink", {"value_id": "k"}), ("k", "call")]
    g = graph(spark, nodes, [("v", "k", "VALUE_FLOWS_TO")])
    own = overlays.Rule("mine", lambda g: True, lambda g: overlays.Delta(g.nodes.filter("kind = 'taint-reach'").selectExpr("concat('note:', id) id", "'note' kind", "label", "'low' confidence", "props", "array(id) evidence_ids")))
    out, report = overlays.fold(g, [overlays.RULES[-1], own, overlays.Rule("never", lambda g: False, lambda g: 1 / 0)])
    assert report == [("taint-propagation", 1, 3), ("mine", 1, 0), ("never", 0, 0)]
    assert {r.kind for r in out.edges.collect()} == {"VALUE_FLOWS_TO", "TAINT_REACHES", "TAINT_FLOWS_TO"}


def test_taint_rule_walks_one_ground(spark, monkeypatch):
    # the witnesses and the walked edges made the links and pieces of the graph twice
    from weftgraph.operators import piecewise

    calls, pieces = [], piecewise.pieces
    monkeypatch.setattr(piecewise, "pieces", lambda *a: calls.append(1) or pieces(*a))
    nodes = [("src", "source", {"value_id": "v"}), ("v", "parameter"), ("snk", "sink", {"value_id": "k"}), ("k", "call")]
    d = overlays.taint_facts(graph(spark, nodes, [("v", "k", "VALUE_FLOWS_TO")]))
    assert (d.nodes.count(), d.edges.count(), len(calls)) == (1, 3, 1)


@pytest.mark.parametrize("sent", [0, 50_000])
def test_absorb_few_and_many_rows(spark, monkeypatch, sent):
    # a small delta is sent to the rows that are there; either way the same rows are new
    monkeypatch.setattr(overlays, "SENT", sent, raising=True)
    g = graph(spark, [("a", "call"), ("b", "call")], [("a", "b", "K"), ("a", "b", "K"), ("a", "b", "K", None, {"context_id": "x"})])
    n = spark.createDataFrame([(i, "k", i, "high", None, [i]) for i in ("a", "n", "n", None)], "id string, kind string, label string, confidence string, props string, evidence_ids array<string>")
    e = spark.createDataFrame([(a, b, k, None, c, "high", None, [a]) for a, b, k, c in [("a", "b", "K", None), ("a", "b", "K", "x"), ("a", "b", "K", "y"), ("a", "b", "L", None), ("b", "a", "K", None), ("b", "b", "K", None), ("b", "a", None, None)]], "src string, dst string, kind string, reason string, context_id string, confidence string, props string, evidence_ids array<string>")
    out, nodes, edges = overlays.absorb(g, overlays.Delta(n, e))
    assert (nodes, edges, out.nodes.count(), out.edges.count()) == (1, 4, 3, 7)


@pytest.mark.parametrize("rule", overlays.RULES, ids=lambda r: r.name)
def test_empty_graphs(spark, rule):
    g = graph(spark, [], [])
    assert not rule.applies(g)


def test_out_parameters(spark):
    nodes = [("v", "variable"), ("u", "variable"), ("w", "variable"), ("a", "argument"), ("b", "argument"), ("c", "argument"), ("e", "expression")]
    flow = [("v", "e"), ("e", "a"), ("u", "b"), ("w", "b"), ("w", "c"), ("c", "w")]
    g = graph(spark, nodes, [(x, y, "VALUE_FLOWS_TO") for x, y in flow])
    assert set(edges_of(overlays.out_parameters(g, g.nodes.filter("kind = 'argument'")))) == {("VALUE_FLOWS_TO", "a", "v")}


def test_runtime(spark):
    from weftgraph.operators import runtime

    js, py = {"language": "typescript"}, {"language": "python"}
    nodes = [
        ("c1", "call", {"callee": "JSON?.parse", "value_id": "v1"}, js), ("a1", "argument", {"callsite_id": "c1", "position": 0}), ("c2", "call", {"callee": "x.emit", "receiver_value_id": "x"}, js), ("a2", "argument", {"callsite_id": "c2", "position": 0, "literal": True, "literal_value": "go"}),
        ("c3", "call", {"callee": "m.set", "receiver_value_id": "m"}, js), ("c4", "call", {"callee": "s.strip", "callee_name": "strip", "receiver": "s", "receiver_value_id": "s", "value_id": "v4"}, py), ("c5", "call", {"callee_name": "join"}, py), ("c6", "call", {"callee_name": "run", "receiver": "subprocess"}, py), ("c7", "call", {"callee": "fetch"}), ("c8", "call", {"callee": "a.b.exec"}, js),
    ]
    g = graph(spark, nodes, [])
    assert {(r.call_id, r.model) for r in runtime.bound_calls(g).collect()} == {("c1", "JSON.parse"), ("c2", "*.emit"), ("c3", "*.set"), ("c4", "*.strip"), ("c6", "subprocess.run")}
    out, report = overlays.fold(g, [runtime.RULE, next(r for r in overlays.RULES if r.name == "async-events")])
    assert report[0][:2] == ("runtime-behaviors", 5) and report[1][1] == 1
    have = {(r.kind, r.src, r.dst) for r in out.edges.collect()}
    assert {("VALUE_FLOWS_TO", "a1", "v1"), ("VALUE_FLOWS_TO", "s", "v4"), ("MUTATES", "c3", "m"), ("EMITS_EVENT", "c2", ident(spark, "async-events", "async-event", "event", "x", "go"))} <= have
    assert [r.name for r in overlays.all_rules()].index("runtime-behaviors") < [r.name for r in overlays.all_rules()].index("async-events")
