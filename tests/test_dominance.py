from __future__ import annotations

import pytest
from test_overlays import graph

from weftgraph.operators import dominance, objects


def sites(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "site_id string")


def at(a, b, host="h"):
    return {"owner_function_id": host, "absolute_file": "f", "start_offset": a, "end_offset": b}


def test_dominance_inside_a_function(spark):
    nodes = [("h", "function", {}, {"absolute_file": "f", "start_offset": 0, "end_offset": 1000}), ("i", "function"), ("cond", "statement", {}, at(0, 5)), ("region", "statement", {}, at(100, 300)), ("inner", "statement", {}, at(150, 200))]
    nodes += [("g_in", "call", {}, at(160, 165)), ("g_mid", "call", {}, at(250, 255)), ("s_before", "call", {}, at(110, 120)), ("s_inner", "call", {}, at(180, 190)), ("s_region", "call", {}, at(210, 220)), ("s_late", "call", {}, at(260, 270)), ("s_out", "call", {}, at(400, 410)), ("other", "call", {}, at(5, 6, "i")), ("nospan", "call", {}, {"owner_function_id": "h"})]
    edges = [("cond", "region", "TRUE_BRANCH"), ("region", "inner", "LOOP_TRUE")]
    steps = ("s_before", "s_inner", "s_region", "s_late", "s_out", "other", "nospan")
    got = {r.site_id: r.state for r in dominance.guarded_steps(graph(spark, nodes, edges), sites(spark, "g_in", "g_mid"), sites(spark, *steps)).collect()}
    assert got == {"s_before": "skippable", "s_inner": "dominates", "s_region": "skippable", "s_late": "dominates", "s_out": "skippable", "nospan": "undecided"}


def test_recognitions(spark):
    nodes = [(f, "function") for f in ("h", "checkPermission", "verifyToken", "verifyFields", "validateShape", "plain", "allowThing")]
    nodes += [(f"c{i}", "call", {}, at(i, i + 1)) for i in range(6)] + [("not", "expression"), ("if", "statement"), ("t", "throw", {}, {"owner_function_id": "plain"}), ("k", "expression", {}, {"owner_function_id": "plain"}), ("reg", "call"), ("a1", "argument", {"callsite_id": "reg"}, {"label": "authRequired"}), ("a2", "argument", {"callsite_id": "reg"}, {"label": "handler"})]
    edges = [(f"c{i}", f, "INVOKES") for i, f in enumerate(("checkPermission", "verifyToken", "verifyFields", "validateShape", "plain", "allowThing"))]
    edges += [("not", "c0", "AST_CHILD"), ("if", "not", "CONDITION"), ("if", "c2", "CONDITION"), ("if", "c3", "CONDITION"), ("t", "x", "THROWS_VALUE"), ("k", "y", "CONDITION"), ("a2", "h", "PASSES_CALLBACK")]
    got = {(r.site_id, r.recognition, r.role, r.suppresses) for r in dominance.recognitions(graph(spark, nodes, edges)).collect()}
    assert got == {
        ("c0", "named", "authz", True), ("c1", "named", "verify", False), ("c2", "named", "verify", False), ("c3", "named", "validate", False), ("c4", "structural", "validate", False), ("c5", "named", "authz", False), ("reg", "declarative", "authz", False),
    }


def test_verdicts_and_candidates(spark):
    nodes = [(f, "function") for f in ("e1", "e2", "e3", "svc", "eff", "ok")]
    nodes += [("g1", "call", {}, at(1, 2, "e1")), ("to1", "call", {}, at(5, 6, "e1")), ("to2", "call", {}, at(5, 6, "e2")), ("to3", "call", {}, at(5, 6, "e3")), ("late", "call", {}, at(9, 10, "e3")), ("on", "call", {}, at(5, 6, "svc")), ("x", "call", {}, at(7, 8, "eff")), ("src", "source", {"function_id": "e2", "source_kind": "request-input"})]
    edges = [("to1", "svc", "INVOKES"), ("to2", "svc", "INVOKES"), ("to3", "svc", "MAY_INVOKE"), ("on", "eff", "INVOKES"), ("e1", "svc", "CALLS"), ("e2", "svc", "CALLS"), ("svc", "eff", "CALLS")]
    g = graph(spark, nodes, edges)
    entries = spark.createDataFrame([("e1",), ("e2",), ("e3",)], "id string")
    guards, effects = sites(spark, "g1", "late"), spark.createDataFrame([("x", "database")], "site_id string, effect_kind string")
    got = {r.entry: (r.state, r.completeness, r.hops, r.path, r.n_guards) for r in dominance.verdicts(g, entries, effects, guards).collect()}
    assert got == {"e1": ("PROVEN_PRESERVED", "DETERMINISTIC", 2, ["e1", "svc", "eff"], 1), "e2": ("UNPROVEN", "DETERMINISTIC", 2, ["e2", "svc", "eff"], 0), "e3": ("UNPROVEN", "PARTIAL", 2, ["e3", "svc", "eff"], 1)}
    found = dominance.candidates(g, entries, effects, guards)
    rank = {r.entry: r.rank for r in found.collect()}
    assert rank["e2"] == pytest.approx(0.3 * 0.7 + 0.25 * 1.0 + 0.25 * 1.0 + 0.12 * 0.85 + 0.08 * 0.76, abs=1e-4)
    assert rank["e3"] == pytest.approx((0.3 * 0.7 + 0.25 * 0.25 + 0.25 * 0.55 + 0.12 * 0.85 + 0.08 * 0.76) * 0.75, abs=1e-4) and rank["e1"] < rank["e3"]
    page, cursor = dominance.registry_page(found, ["GUARD_DIFFERENTIAL"], None, 2)
    assert [r.place for r in page.collect()] == [1, 2] and page.columns == ["id", "family", "rank", "place"]
    last, end = dominance.registry_page(found, None, cursor, 2, "full")
    assert end is None and last.count() == 1 and last.first().entry == "e1"
    from weftgraph.operators.access import BadCursor

    with pytest.raises(BadCursor):
        dominance.registry_page(found, None, "zz", 2)
    assert {(r.state, r.completeness, r.n) for r in dominance.candidate_census(found).collect()} == {("PROVEN_PRESERVED", "DETERMINISTIC", 1), ("UNPROVEN", "DETERMINISTIC", 1), ("UNPROVEN", "PARTIAL", 1)}


OPS = [
    # a variable set to null after its free is not freed twice
    ("null", [("n0", "alloc", "p"), ("n1", "free", "p"), ("n2", "null", "p"), ("n3", "free", "p")], [], set()),
    ("twice", [("n0", "alloc", "p"), ("n1", "free", "p"), ("n2", "free", "p")], [], {("n2", "p", "double-free")}),
    ("alias", [("n0", "alloc", "p"), ("n1", "copy", "q", "p"), ("n2", "free", "p"), ("n3", "use", "q")], [], {("n3", "q", "use-after-free")}),
    ("branches", [("n0", "alloc", "p"), ("n1", "free", "p"), ("n2", "free", "p"), ("n3", "use", "z")], [("n0", "n1"), ("n0", "n2"), ("n1", "n3"), ("n2", "n3")], set()),
    ("loop", [("n0", "alloc", "p"), ("n1", "free", "p")], [("n0", "n1"), ("n1", "n1")], {("n1", "p", "double-free")}),
    ("fresh", [("n0", "alloc", "p"), ("n1", "free", "p")], [("n0", "n1"), ("n1", "n0")], set()),
    ("clobber", [("n0", "free", "p"), ("n1", "clobber", "p"), ("n2", "free", "p")], [], set()),
    ("realloc", [("n0", "free", "p"), ("n1", "alloc", "p"), ("n2", "use", "p")], [], set()),
]


@pytest.mark.parametrize("most", [64, 1])
def test_object_states(spark, most):
    ops, cfg = [], []
    for name, steps, links, _ in OPS:
        ops += [(name, s[0], i, s[1], s[2], s[3] if len(s) > 3 else None) for i, s in enumerate(steps)]
        cfg += [(name, a, b) for a, b in links or zip([s[0] for s in steps], [s[0] for s in steps[1:]])]
    found = objects.object_states(spark.createDataFrame(ops, objects.OPS), spark.createDataFrame(cfg, "function string, a string, b string"), most).collect()
    for name, _, _, want in OPS:
        if most > 1 or name not in ("branches", "loop", "fresh"):
            assert {(r.node, r.variable, r.finding) for r in found if r.function == name} == want, name


def test_events_and_summaries(spark):
    fn = lambda f: {"owner_function_id": f}
    nodes = [("f", "function"), ("w", "function"), ("r", "function"), ("p", "parameter", {"parameter_position": 0}, fn("f")), ("q", "parameter", {"parameter_position": 1}, fn("w")), ("s", "parameter", {"parameter_position": 0}, fn("r"))]
    nodes += [("v", "identifier", {}, fn("w")), ("u", "identifier", {}, fn("w")), ("t", "identifier", {}, fn("w"))]
    calls = [("c1", "f", "p", "free"), ("c2", "w", "q", None), ("c3", "r", "s", None), ("c4", "w", "v", "alloc"), ("c5", "w", "v", "free"), ("c6", "w", "v", "free"), ("c7", "w", "v", "use"), ("c8", "w", "u", "alloc"), ("c9", "w", "t", "alloc"), ("ca", "w", "t", None)]
    nodes += [(c, "call", {}, fn(f) | {"start_offset": i}) for i, (c, f, _, _) in enumerate(calls)]
    edges = [(c, a, "HAS_ARGUMENT", None, {"position": 0}) for c, _, a, _ in calls] + [("c2", "f", "INVOKES"), ("c3", "w", "INVOKES"), ("c3", "r", "INVOKES")]
    edges[2] = ("c3", "s", "HAS_ARGUMENT", None, {"position": 1})
    g = graph(spark, nodes, edges)
    bindings = spark.createDataFrame([(c, e) for c, _, _, e in calls if e], "call_id string, effect string")
    ev = objects.variable_events(g, bindings)
    assert {tuple(r) for r in objects.leaks(ev).collect()} == {("w", "u")}
    assert {(r.variable, r.call_id, r.finding) for r in objects.misuses(ev).collect()} == {("v", "c6", "double-free"), ("v", "c7", "use-after-free")}
    assert {tuple(r) for r in objects.parameter_summaries(g, bindings).collect()} == {("f", 0, "free", 0), ("w", 1, "free", 1), ("r", 0, "free", 2)}
    assert {r.id for r in objects.lifetime_slice(g, bindings).collect()} == {"f", "w", "r"}
