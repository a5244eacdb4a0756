"""Derivation rules: each maps the graph to rows that can be added to it, as plain joins and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph import schema
from weftgraph.graph import Graph
from weftgraph.operators import navigate
from weftgraph.plans.durable import durable
from weftgraph.plans.fixpoint import fixpoint

# What the runtime's functions do to an object.
EFFECT_OF = {"mem_take": "alloc", "mem_drop": "free", "buf_copy": "use", "str_size": "use"}


def dynamic_behaviours(g: Graph) -> DataFrame:
    """(id, call_id, unit): a node for every call that no edge decides."""
    u = navigate.unresolved_calls(g)
    return u.select(schema.stable_id("core", F.lit("graph"), F.lit("dynamic-behavior"), F.col("call_id")).alias("id"), "call_id", "unit")


def call_contexts(g: Graph) -> DataFrame:
    """(id, call_id, target): a context per call and target, one with target null for calls without."""
    calls = g.nodes.filter("kind = 'call'").select(F.col("id").alias("call_id"))
    t = g.semantic("CALLS", "INVOKES").filter("src is not null and dst is not null").select(F.col("src").alias("call_id"), F.col("dst").alias("target")).distinct()
    j = calls.join(t, "call_id", "left")
    return j.select(schema.stable_id("core", F.lit("graph"), F.lit("call-context"), F.col("call_id"), F.coalesce("target", F.lit("unresolved"))).alias("id"), "call_id", "target")


def model_bindings(g: Graph, models: DataFrame) -> DataFrame:
    """(call_id, model_id, model, effect): call sites bound to runtime models by name; models are counted before they are sent."""
    m = models.filter("kind = 'function'").select(F.col("id").alias("model_id"), F.get_json_object("props", "$.model").alias("model")).filter("model is not null")
    if m.count() <= 50_000:
        m = F.broadcast(m)
    effect = F.coalesce(*[F.when(F.col("model") == k, v) for k, v in EFFECT_OF.items()], F.lit("none"))
    e = g.semantic("CALLS", "INVOKES").select(F.col("src").alias("call_id"), F.col("dst").alias("model_id")).filter("call_id is not null").distinct()
    return e.join(m, "model_id").select("call_id", "model_id", "model", effect.alias("effect"))


def control_links(g: Graph) -> DataFrame:
    """(src, dst, kind): entries, sequence, loop-backs and implicit false branches of the statements of each body."""
    body = g.semantic("CONTAINS_BODY").filter("src is not null and dst is not null").select(F.col("src").alias("owner"), F.col("dst").alias("id")).distinct()
    s = body.join(g.nodes.filter("kind = 'statement'").select("id", "start_line", F.get_json_object("props", "$.control_kind").alias("control")), "id")
    w = Window.partitionBy("owner").orderBy(F.asc_nulls_first("start_line"), "id")
    s = s.withColumn("follower", F.lead("id").over(w)).withColumn("place", F.row_number().over(w))
    loop = F.col("control").isin("for", "while")
    rows = F.array(
        F.when(F.col("place") == 1, F.struct(F.col("owner").alias("src"), F.col("id").alias("dst"), F.lit("CFG_ENTRY").alias("kind"))),
        F.when(F.col("follower").isNotNull() & F.coalesce(F.col("control") != "return", F.lit(True)), F.struct(F.col("id").alias("src"), F.col("follower").alias("dst"), F.lit("CFG_NEXT").alias("kind"))),
        F.when(loop, F.struct(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit("LOOP_BACK").alias("kind"))),
        F.when(F.col("control").isin("if", "for", "while") & F.col("follower").isNotNull(), F.struct(F.col("id").alias("src"), F.col("follower").alias("dst"), F.lit("FALSE_BRANCH").alias("kind"))),
    )
    return s.select(F.explode(rows).alias("x")).filter("x is not null").select("x.src", "x.dst", "x.kind")


def cfg(g: Graph) -> DataFrame:
    return g.semantic("CFG_NEXT").filter("src is not null and dst is not null").select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()


def reaching_definitions(g: Graph, rounds: int | None = None) -> DataFrame:
    """(def_id, variable, use_id): writes that reach a read of the same variable along the control flow, no other write between.

    A variable is a name in its owner. The rows that flow are (write, variable, statement); a
    statement that writes the variable stops them.
    """
    nxt = durable(cfg(g), "cfg")
    named = g.nodes.filter("label is not null and owner_function_id is not null").select(F.col("id").alias("dst"), F.concat_ws("/", "owner_function_id", "label").alias("variable"))
    touched = lambda kind: g.semantic(kind).filter("src is not null").select("src", "dst").distinct().join(named, "dst").select("src", "variable").distinct()
    w = durable(touched("WRITES_TO").withColumnRenamed("src", "id"), "writes")
    r = touched("READS_FROM").withColumnRenamed("src", "at")

    def step(found: DataFrame) -> DataFrame:
        kills = w.select(F.col("id").alias("at"), "variable")
        live = found.filter("def_id = at").unionByName(found.filter("def_id <> at").join(kills, ["at", "variable"], "left_anti").select(found.columns))
        return live.join(nxt, live["at"] == nxt["a"]).select("def_id", "variable", F.col("b").alias("at"))

    seed = w.select(F.col("id").alias("def_id"), "variable", F.col("id").alias("at"))
    found, _ = fixpoint(seed, step, ["def_id", "variable", "at"], rounds)
    return found.filter("round > 0").join(r, ["at", "variable"]).select("def_id", "variable", F.col("at").alias("use_id")).distinct()


def unreachable_statements(g: Graph) -> DataFrame:
    """(id): statements with control flow around them that no start of a flow reaches."""
    nxt = durable(cfg(g), "cfg")
    every = nxt.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    starts = nxt.select(F.col("a").alias("id")).distinct().join(nxt.filter("a <> b").select(F.col("b").alias("id")).distinct(), "id", "left_anti")
    found, _ = fixpoint(starts, lambda f: f.join(nxt, f["id"] == nxt["a"]).select(F.col("b").alias("id")), ["id"])
    return every.join(found.select("id"), "id", "left_anti")


def sink_reach(g: Graph, models: DataFrame) -> DataFrame:
    """(id): functions from which a call of a runtime function can be reached, by one closure backwards."""
    calls = durable(navigate.call_pairs(g), "calls")
    seed = calls.join(models.filter("kind = 'function'").select(F.col("id").alias("callee")), "callee", "left_semi").select(F.col("caller").alias("id"))
    found, _ = fixpoint(seed, lambda f: f.join(calls, f["id"] == calls["callee"]).select(F.col("caller").alias("id")), ["id"])
    return found.select("id")


def guard_differential(g: Graph, models: DataFrame, depth: int) -> DataFrame:
    """(entry, effects, guarded_effects, verdict) per entry point: functions with an effect in its closure, and how many are guarded."""
    from weftgraph.operators.traverse import closure

    calls = navigate.call_pairs(g)
    effect = calls.join(models.filter("kind = 'function'").select(F.col("id").alias("callee")), "callee", "left_semi").select(F.col("caller").alias("node")).distinct()
    guarded = g.semantic("GUARDED_BY").select(F.col("src").alias("node")).filter("node is not null").distinct().withColumn("has", F.lit(1))
    reach = closure(navigate.entry_points(g), calls.select(F.col("caller").alias("a"), F.col("callee").alias("b")), depth)
    per = reach.join(effect, "node", "left_semi").join(guarded, "node", "left").groupBy(F.col("seed").alias("entry")).agg(F.count(F.lit(1)).alias("effects"), F.count("has").alias("guarded_effects"))
    verdict = F.when(F.col("effects") == F.col("guarded_effects"), "preserved").when(F.col("guarded_effects") > 0, "differs").otherwise("unguarded")
    return per.withColumn("verdict", verdict)


def import_links(files: DataFrame) -> DataFrame:
    """(a, b): paths of files and of what they import, where that is resolved."""
    i = files.select("path", F.explode("imports").alias("i")).filter("i.resolved_path is not null and path is not null")
    return i.select(F.col("path").alias("a"), F.col("i.resolved_path").alias("b")).distinct()


def layered_edges(g: Graph) -> DataFrame:
    """(src_tier, dst_tier, kind, n): edges between the layers by meaning; a drill spans one layer."""
    t = g.nodes.select("id", schema.tier(F.col("kind")).alias("tier"))
    e = g.edges.select("src", "dst", schema.semantic_kind().alias("kind"))
    # first by end, so a hot end is one row a kind when it meets its tier
    per = e.groupBy("src", "dst", "kind").agg(F.count(F.lit(1)).alias("n"))
    j = per.join(t.select(F.col("id").alias("src"), F.col("tier").alias("src_tier")), "src").groupBy("dst", "kind", "src_tier").agg(F.sum("n").alias("n"))
    return j.join(t.select(F.col("id").alias("dst"), F.col("tier").alias("dst_tier")), "dst").groupBy("src_tier", "dst_tier", "kind").agg(F.sum("n").alias("n"))


def field_roles(g: Graph) -> DataFrame:
    """(id, reads, writes, flows_in, flows_out) of every id that value edges touch."""
    rows = [("READS_FROM", "dst", "reads"), ("WRITES_TO", "dst", "writes"), ("VALUE_FLOWS_TO", "dst", "flows_in"), ("VALUE_FLOWS_TO", "src", "flows_out")]
    every = None
    for kind, end, role in rows:
        part = g.semantic(kind).filter(F.col(end).isNotNull()).select(F.col(end).alias("id"), F.lit(role).alias("role"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("id").agg(*[F.count_if(F.col("role") == r).alias(r) for r in ("reads", "writes", "flows_in", "flows_out")])


def peer_calls(g: Graph) -> DataFrame:
    """(unit, callee_name, n_owners, owners, standing): calls that one owner of a unit makes alone, or that one alone lacks."""
    c = navigate.callsite_index(g).filter("owner_id is not null").select("unit", "callee_name", "owner_id").distinct()
    owners = c.groupBy("unit").agg(F.countDistinct("owner_id").alias("owners"))
    per = c.groupBy("unit", "callee_name").agg(F.count(F.lit(1)).alias("n_owners")).join(owners, "unit")
    standing = F.when(F.col("n_owners") == 1, "unique").when(F.col("n_owners") == F.col("owners") - 1, "missing").otherwise("shared")
    return per.filter("owners > 2").withColumn("standing", standing)


def unknowns(g: Graph) -> DataFrame:
    """(category, n): what the graph does not know, by reason."""
    parts = [
        navigate.unresolved_calls(g).select(F.lit("call-without-target").alias("category")),
        g.nodes.filter("kind = 'diagnostic'").select(F.lit("diagnostic").alias("category")),
        g.nodes.filter("confidence = 'unresolved'").select(F.lit("unresolved-node").alias("category")),
        g.edges.filter("lower(trim(confidence)) = 'unresolved'").select(F.lit("unresolved-edge").alias("category")),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def boundary_edges(g: Graph) -> DataFrame:
    """(src_unit, dst_unit, kind, n): edges that leave their unit, by meaning."""
    u = g.nodes.select("id", F.coalesce("unit", F.lit("builtin")).alias("unit"))
    per = g.edges.groupBy("src", "dst", schema.semantic_kind().alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    j = per.join(u.select(F.col("id").alias("src"), F.col("unit").alias("src_unit")), "src").groupBy("dst", "kind", "src_unit").agg(F.sum("n").alias("n"))
    return j.join(u.select(F.col("id").alias("dst"), F.col("unit").alias("dst_unit")), "dst").filter("src_unit <> dst_unit").groupBy("src_unit", "dst_unit", "kind").agg(F.sum("n").alias("n"))


def near_guards(g: Graph) -> DataFrame:
    """(id, distance): functions that call a guarded one within two steps; 0 if guarded themselves."""
    calls = durable(navigate.call_pairs(g), "calls")
    seed = g.semantic("GUARDED_BY").select(F.col("src").alias("id")).filter("id is not null").distinct()
    found, _ = fixpoint(seed, lambda f: f.join(calls, f["id"] == calls["callee"]).select(F.col("caller").alias("id")), ["id"], 2)
    return found.select("id", F.col("round").cast("long").alias("distance"))


def value_histories(g: Graph, depth: int) -> DataFrame:
    """(seed, node, distance): what lies within some steps of each variable or class, either way along value edges."""
    from weftgraph.operators.traverse import closure_by_hubs

    e = g.semantic("VALUE_FLOWS_TO", "READS_FROM", "WRITES_TO", "POINTS_TO").filter("src is not null and dst is not null").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return closure_by_hubs(g.nodes.filter("kind = 'heap-object'").select("id"), both, depth)


def file_infos(files: DataFrame) -> DataFrame:
    """(file_id, n_imports, n_bindings, n_exports, n_functions): the flat view of a file's record."""
    once = files.dropDuplicates(["file_id"])
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("long")
    bindings = F.aggregate(F.coalesce("imports", F.array().cast(files.schema["imports"].dataType)), F.lit(0).cast("long"), lambda acc, i: acc + F.when(i["bindings"].isNotNull(), F.size(i["bindings"])).otherwise(0))
    return once.select("file_id", size("imports").alias("n_imports"), bindings.alias("n_bindings"), size("exports").alias("n_exports"), size("functions").alias("n_functions"))


def function_bodies(files: DataFrame) -> DataFrame:
    """(file_id, function_id, body): the lines of each function, from the kept text."""
    f = files.filter("text is not null").dropDuplicates(["file_id"]).select("file_id", "text", F.explode("functions").alias("f"))
    lines = F.split("text", "\n")
    a = F.greatest(F.col("f.start_line"), F.lit(1)).cast("int")
    n = F.greatest(F.col("f.end_line").cast("int") - a + 1, F.lit(0))
    return f.filter("f is not null and f.start_line is not null and f.end_line is not null").select("file_id", F.col("f.id").alias("function_id"), F.array_join(F.slice(lines, a, n), "\n").alias("body"))
