from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from weftgraph import graph, schema
from weftgraph.functions import paths
from weftgraph.operators import lifetime, nearest, traverse
from weftgraph.sources import store
from weftgraph.streaming import events as streams

LINK = "a string, b string"


def brute_reach(links):
    out = {}
    for s in {x for l in links for x in l}:
        seen, todo = set(), [b for a, b in links if a == s]
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += [b for a, b in links if a == n]
        out[s] = seen
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components_and_cycles(spark, seed):
    rng = random.Random(seed)
    links = [(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for _ in range(24)] + [("hub", f"m{i}") for i in range(9)]
    df = spark.createDataFrame([*links, (None, "x"), ("y", None)], LINK)
    up = brute_reach(links)
    around = brute_reach([*links, *[(b, a) for a, b in links]])
    got = {r.id: r.component for r in traverse.components(df).collect()}
    assert {n: got[n] for n in up} == {n: min({n} | around[n]) for n in up}
    scc = {r.id: r.component for r in traverse.strong_components(df).collect()}
    assert {n: scc[n] for n in up} == {n: min({n} | {m for m in up[n] if n in up[m]}) for n in up}
    level = {r.component: r.level for r in traverse.levels(df, traverse.strong_components(df)).collect()}
    assert all(level[scc[a]] > level[scc[b]] for a, b in links if scc[a] != scc[b])


def test_contexts_match_returns(spark):
    edges = [("x", "p", "context-parameter", "c1"), ("y", "p", "context-parameter", "c2"), ("p", "r", None, None), ("r", "rx", "context-return", "c1"), ("r", "ry", "context-return", "c2"), ("p", "p", None, None), ("x", "z", "context-parameter", None)]
    links = traverse.flow_links(spark.createDataFrame(edges, "src string, dst string, reason string, context_id string"))
    got = {(r.seed, r.node) for r in traverse.context_reach(spark.createDataFrame([("x",), ("y",)], "id string"), links).collect()}
    assert got == {("x", "p"), ("x", "r"), ("x", "rx"), ("y", "p"), ("y", "r"), ("y", "ry")}


def brute_contexts(links, seeds, most):
    """(seed, node): distance over states of node and whole stack, of at most so many contexts."""
    out = {}
    for s in seeds:
        seen, now, n = {(s, ())}, [(s, ())], 0
        while now:
            n, new = n + 1, []
            for node, stack in now:
                for a, b, push, pop in links:
                    if a != node or (push and len(stack) >= most) or (pop and stack[-1:] != (pop,)):
                        continue
                    state = (b, (*stack, push) if push else stack[:-1] if pop else stack)
                    if state not in seen:
                        seen.add(state)
                        new.append(state)
                        if b != s:
                            out.setdefault((s, b), n)
            now = new
    return out


def test_walks_go_to_their_end(spark, monkeypatch):
    monkeypatch.setattr(traverse, "CONTEXT_DEPTH", 4)
    rng = random.Random(7)
    links = {(f"k{i}", f"k{i + 1}", None, None) for i in range(11)}
    links |= {("x", "f", "c", None), ("f", "f", "c", None), ("f", "g", None, None), ("g", "g", None, "c"), ("g", "h", None, "c"), ("h", "x", "dead", None)}  # recursion
    for g in range(20):
        for _ in range(12):
            c = rng.choice("uvw")
            links.add((f"r{g}.{rng.randrange(6)}", f"r{g}.{rng.randrange(6)}", *rng.choice([(None, None), (c, None), ("dead", None), (None, c)])))
    seeds = sorted({x for a, b, *_ in links for x in (a, b)})
    got = traverse.context_reach(spark.createDataFrame([(s,) for s in seeds], "id string"), spark.createDataFrame(sorted(links, key=str), "a string, b string, push string, pop string"))
    assert {(r.seed, r.node): r.distance for r in got.collect()} == brute_contexts(links, seeds, 4)


def test_registered_walks_have_no_step_bound(spark, monkeypatch):
    from weftgraph import graph_queries, planner_queries, rule_queries

    kind = "id string, kind string, label string, owner_function_id string, props string"
    n = spark.createDataFrame([("v0", "read", "v", "o", None), ("heap", "heap-object", "h", "o", None)] + [(f"v{i}", "identifier", "v", "o", None) for i in range(1, 16)] + [("a", "identifier", "x", "f", None)], kind)
    rows = [(f"v{i}", f"v{i + 1}", "VALUE_FLOWS_TO") for i in range(15)] + [("v15", "heap", "POINTS_TO")] + [(f"s{i}", f"s{i + 1}", "CFG_NEXT") for i in range(15)] + [("s0", "a", "WRITES_TO"), ("s15", "a", "READS_FROM"), ("s0", "c0", "AST_CHILD"), ("s15", "c1", "AST_CHILD")]
    e = spark.createDataFrame([(i, *r, r[2], None, None, None) for i, r in enumerate(rows)], "row_id long, src string, dst string, kind string, semantic_kind string, reason string, context_id string, props string")
    free = spark.createDataFrame([("c0", "free"), ("c1", "free")], "call_id string, effect string")
    monkeypatch.setattr(graph, "load", lambda spark, d: graph.Graph(n, e))
    monkeypatch.setattr(planner_queries, "table", lambda spark, d, name: None)
    monkeypatch.setattr(planner_queries.planner.rules, "model_bindings", lambda g, m: free)
    assert ("v0", "heap") in {tuple(r) for r in graph_queries.flow_cones(spark, "").collect()}
    assert ("heap", "v0") in {tuple(r) for r in graph_queries.sources_of(spark, "").collect()}
    assert [tuple(r) for r in rule_queries.reaching_definitions(spark, "").collect()] == [("s0", "f/x", "s15")]
    assert [tuple(r) for r in planner_queries.double_frees(spark, "").collect()] == [("s0", "s15")]


def test_witnesses_of_any_length(spark, monkeypatch):
    from weftgraph import planner_queries

    n = spark.createDataFrame([(f"f{i}", "function", "f") for i in range(9)], "id string, kind string, label string")
    rows = [(f"f{i}", f"f{i + 1}", "CALLS") for i in range(8)] + [("f8", "f3", "CALLS"), ("f8", "guard", "GUARDED_BY"), ("f2", "guard", "GUARDED_BY")]
    e = spark.createDataFrame([(*r, r[2]) for r in rows], "src string, dst string, kind string, semantic_kind string")
    monkeypatch.setattr(graph, "load", lambda spark, d: graph.Graph(n, e))
    got = {tuple(r) for r in planner_queries.witnesses(spark, "").collect()}
    assert got == {("f0", "f2", "f0 > f1 > f2"), ("f0", "f8", " > ".join(f"f{i}" for i in range(9)))}


def brute_settle(links, apart):
    """The whole graph in one sequence, until stable."""
    near = {}
    for a, b in {(a, b) for a, b in links if a != b}:
        for x, y in ((a, b), (b, a)):
            if x not in apart:
                near.setdefault(x, []).extend([y] if y not in apart else [])
    label, before = {n: n for n in near}, None
    while label != before:
        before = dict(label)
        for n in sorted(near):
            if near[n]:
                heard = [label[o] for o in near[n]]
                label[n] = min(heard, key=lambda x: (-heard.count(x), x))
    return label


def test_communities_settle(spark):
    rng = random.Random(3)
    links = [(f"g{g}n{rng.randrange(8)}", f"g{g}n{rng.randrange(8)}") for g in range(9) for _ in range(14)] + [("hub", f"g{g}n{i}") for g in range(9) for i in range(8)] + [("x", "y"), ("hub", "alone")]
    df, apart = spark.createDataFrame(links, LINK).distinct(), spark.createDataFrame([("hub",)], "id string")
    label = traverse.settled_labels(df, apart)
    got = {r.id: r.label for r in label.collect()}
    assert got == brute_settle(links, {"hub"}) and got["y"] == got["x"] and got["alone"] == "alone"
    kept = {(a, b) for a, b in links if a != b and "hub" not in (a, b)}
    k = {c: sum((got[a] == c) + (got[b] == c) for a, b in kept) for c in set(got.values()) - {"alone"}}
    want = sum(sum(got[a] == got[b] == c for a, b in kept) / len(kept) - (k[c] / (2 * len(kept))) ** 2 for c in k)
    r = traverse.modularity(traverse.without(df, apart), label, weighted=True).first()
    assert r.n_communities == len([c for c in k if k[c]]) and r.modularity == pytest.approx(want, abs=1e-6)


def test_store_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "function", "f"), ("b", "file", "g"), ("t", "token", "h")], "id string, kind string, label string")
    edges = spark.createDataFrame([(1, "a", "b", "CALLS"), (2, "b", "a", "CONTAINS")], "row_id long, src string, dst string, kind string")
    path = str(tmp_path / "store")
    for _ in range(2):  # a second publication replaces the first
        store.write_store(graph.Graph(nodes, edges), path)
    g = store.read_store(spark, path)
    assert {r.id for r in g.nodes.collect()} == {"a", "b"} and g.edges.count() == 2
    assert "PartitionFilters: [isnotnull(kind" in g.edges.filter("kind = 'CALLS'")._jdf.queryExecution().toString()
    with pytest.raises(store.StoreMismatch):
        store.read_store(spark, str(tmp_path / "none"))
    assert store.versions(spark, path) and len(store.versions(spark, path)) == 2 and store.read_manifest(spark, path)["n_nodes"] == 2
    both = store.composite(g, graph.Graph(spark.createDataFrame([("a", "function", "other"), ("z", "file", "z")], "id string, kind string, label string"), edges.union(edges)))
    assert {(r.id, r.label) for r in both.nodes.collect()} == {("a", "f"), ("b", "g"), ("z", "z")} and both.edges.count() == 2
    over = store.apply_overlay(g, spark.createDataFrame([("a", "new")], "id string, label string"), spark.createDataFrame([("a", "x", "x"), ("c", "x", "y")], "id string, kind string, label string"))
    assert {(r.id, r.label) for r in over.nodes.collect()} == {("a", "new"), ("b", "g"), ("c", "y")}
    old = spark.createDataFrame([("f", "h1")], "file_id string, content_hash string")
    new = spark.createDataFrame([("f", "h1"), ("g", "h1"), ("f", "h2")], "file_id string, content_hash string")
    assert {tuple(r) for r in store.changed_files(new, old).collect()} == {("g", "h1"), ("f", "h2")}
    store.write_store(graph.Graph(nodes.withColumn("file", F.lit("a/test_x.py")), edges), path, drop_tests=True, keep=0)
    assert len(store.versions(spark, path)) == 1 and store.read_store(spark, path).nodes.count() == 0
    assert store.read_headers(spark, path).columns == ["id", "kind", "file"]


def test_cache_inventory_and_sinks(spark, tmp_path):
    files = spark.createDataFrame([("a.c", "1"), ("b.c", "2"), ("a.c", "1")], "path string, content_hash string")
    cache = store.GraphCache(spark, str(tmp_path / "cache"))
    assert cache.list() == [] and cache.prune(1) == []
    key = cache.key(files, {"tool": "1"})
    assert key == cache.key(files.orderBy("path").distinct(), {"tool": "1"}) != cache.key(files, {"tool": "2"}) and cache.get(key) is None
    g = graph.Graph(spark.createDataFrame([("a", "function", "f")], "id string, kind string, label string"), spark.createDataFrame([(1, "a", "a", "CALLS")], "row_id long, src string, dst string, kind string"))
    assert cache.put(key, g).nodes.count() == 1 and cache.get(key).edges.count() == 1 and cache.list() == [key]
    assert cache.prune(0) == [key] and cache.get(key) is None
    src = tmp_path / "dist" / "src"
    for p in ("x.py", "node_modules/y.js", "sub/test_z.py", "sub/w.ts", "note.txt"):
        (src / p).parent.mkdir(parents=True, exist_ok=True)
        (src / p).write_text("x")
    names = lambda df: {r.path.rsplit("/", 1)[-1] for r in df.collect()}
    assert names(store.source_inventory(spark, str(src))) == {"x.py", "test_z.py", "w.ts"}
    assert names(store.source_inventory(spark, str(src), include_tests=False)) == {"x.py", "w.ts"}
    df = spark.createDataFrame([(1, "x"), (None, "y")], "a long, b string")
    assert sorted(r.value for r in store.as_lines(df).collect()) == ['{"a":1,"b":"x"}', '{"b":"y"}'] and sorted(r.value for r in store.as_lines(df, True).collect()) == ["a=1  b=x", "b=y"]
    assert store.sink(df, None) is df and store.sink(df, str(tmp_path / "out")).count() == 2
    (tmp_path / "cat.json").write_text('{"method": "read", "kind": "source", "endpoint": "Argument[1]"}\n{"method": "run", "package": "os", "kind": "sink", "endpoint": "Argument[*]"}\n{"method": "dup", "kind": "summary", "endpoint": "Argument[0]->ReturnValue"}\n{"method": "esc", "kind": "sanitizer", "endpoint": "Receiver->ReturnValue"}\n')
    cat = {k: [tuple(r) for r in v.collect()] for k, v in store.load_catalog(spark, str(tmp_path / "cat.json")).items()}
    assert cat == {"sources": [("read", "source", "1")], "sinks": [("os.run", "sink", "*")], "summaries": [("dup", "summary", "0", "return")], "sanitizers": [("esc", "sanitizer", "receiver", "return")]}
    assert all(v.count() == 0 for v in store.load_catalog(spark, str(tmp_path / "none.json")).values())
    import subprocess

    run = lambda *a: subprocess.run(["git", "-C", str(src), "-c", "user.name=n", "-c", "user.email=e@e", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", "x.py")
    run("commit", "-qm", "first")
    assert [(c[1], c[3]) for c in store.git_history(str(src))] == [("n", "first")] and store.git_history(str(src), skip=1) == []


C, D = "c", "d"


@pytest.mark.parametrize("use,definition,want,left,excluded", [
    (["*", C], ["*", C], "EXACT_MATCH", [], None), ([C], [D], "NO_MATCH", [], None), ([C, D], [C], "PREFIX_MATCH", [D], None), ([C], [C, D], "EXTENDED_MATCH", [D], None),
    (["*"], ["*", "<2>"], "EXACT_MATCH", ["<-2>"], None), (["*", "<5>", "*"], ["*", "<2>"], "PREFIX_MATCH", ["<3>", "*"], None), (["?"], [C], "VARIABLE_EXACT_MATCH", [], None),
    (["<?>", "*"], ["<3>", "*"], "VARIABLE_EXACT_MATCH", [], None), ([C], [C, D], "NO_MATCH", [], [[D]]), ([C, D], [C, "?"], "VARIABLE_EXACT_MATCH", [], None),
])
def test_access_paths(use, definition, want, left, excluded):
    as_text = lambda steps: paths.normal(paths.text_of(steps))
    got = paths.match_columns([as_text(use)], [as_text(definition)], [[as_text(x) for x in excluded]] if excluded else None)
    assert got == ([want], [paths.text_of(left)])


@pytest.mark.parametrize("path,want", [(["&", "*"], []), (["*", "&"], []), (["<2>", "<-2>"], []), (["<2>", "<3>"], ["<5>"]), (["<0>"], []), (["<?>", "<3>"], ["<?>"]), (["&", "<2>", "<-2>", "*"], [])])
def test_normal_paths(path, want):
    assert paths.steps_of(paths.normal(paths.text_of(path))) == want


def test_path_columns(spark):
    rows = [("/*/f", "/*/f/<2>/<-2>"), ("/a/b", "/a"), (None, "/a"), ("/a", None), ("", ""), ("/<?>/*", "/<3>/*"), ("/*/f", "/*/g")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, use_path string, def_path string")
    got = [(r.result, r.rest) for r in paths.match_paths(df).orderBy("i").collect()]
    assert got == [("EXACT_MATCH", ""), ("PREFIX_MATCH", "/b"), (None, None), (None, None), ("EXACT_MATCH", ""), ("VARIABLE_EXACT_MATCH", ""), ("NO_MATCH", "")]
    rng = random.Random(9)
    for _ in range(200):  # a way and the way back cancel; the normal form is one
        steps = [rng.choice(["*", "&", "<1>", "<-2>", "<3>"]) for _ in range(rng.randrange(9))]
        text = paths.text_of(steps)
        assert paths.normal(text + paths.inverse(text)) == "" and paths.normal(paths.normal(text)) == paths.normal(text)
    files = spark.createDataFrame([("1", "x->a.b = 1;\ny = x->a.b + x->c == z[3];\nx->a = q;\nr(x->a.b)"), ("2", None), ("3", "")], "file_id string, text string")
    m = paths.member_paths(files)
    assert sorted(tuple(r)[1:] for r in m.collect()) == [(1, 0, "x", "/*/a/b", True), (2, 0, "x", "/*/a/b", False), (2, 1, "x", "/*/c", False), (2, 2, "z", "/<3>/*", False), (3, 0, "x", "/*/a", True), (4, 0, "x", "/*/a/b", False)]
    assert {(r.line, r.use_path, r.result, r.rest) for r in paths.reads_of_writes(m).collect()} == {(2, "/*/a/b", "EXACT_MATCH", ""), (2, "/*/c", "NO_MATCH", ""), (4, "/*/a/b", "PREFIX_MATCH", "/b")}


def test_stream_agrees_with_batch(spark, tmp_path):
    rows = [(i, f"2026-01-01 00:00:{i % 60:02d}", i % 3, random.Random(i).choice(["signup", "purchase", "view", "error"])) for i in range(40)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").selectExpr("event_id", "cast(ts as timestamp) ts", "user_id", "event_type")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = streams.stream_misuses(live).writeStream.format("memory").queryName("misuses").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("misuses").collect()} == {tuple(r) for r in lifetime.misuses(df).collect()}
    assert sum(r.n for r in streams.windowed_counts(df).collect()) == 40


def test_identities_and_ranks(spark):
    df = spark.createDataFrame([("Exact", "function"), (None, "odd"), ("low ", "file")], "confidence string, kind string")
    r = df.select(schema.confidence_rank(df.confidence), schema.tier(df.kind), schema.stable_id("core", df.kind, df.kind)).collect()
    assert [x[0] for x in r] == [0, 6, 4] and [x[1] for x in r] == ["T1", "T4", "T0"] and all(x[2].startswith("v2:core:") and len(x[2].split(":")[-1]) == 20 for x in r)


def test_nearest_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 2)
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 9)] + [(100, None), (101, [0.0, 0.0])], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in nearest.nearest(rows.filter("vec_id <= 5"), rows, 1).collect()}
    assert {q for q, _ in got} == {1, 2, 3, 4, 5} and (1, 2) in got and (4, 5) in got


def test_entry_queries_have_matching_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100


def test_next_row_over_ranges(spark):
    from weftgraph.plans.ranges import lead_in_ranges

    rows = [("hot", i, f"v{i:03d}") for i in range(200)] + [("hot", None, "v"), ("one", 1, "w"), ("two", 2, "b"), ("two", 2, "a")]
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "k string, o int, v string").repartition(3)
    got = {(r.k, r.v): r.after for r in lead_in_ranges(df, "k", ["o", "v"], "v", "after").collect()}
    assert got[("hot", "v")] == "v000" and all(got[("hot", f"v{i:03d}")] == f"v{i + 1:03d}" for i in range(199)) and got[("hot", "v199")] is None
    assert got[("one", "w")] is None and got[("two", "a")] == "b" and got[("two", "b")] is None
