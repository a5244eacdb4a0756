"""Candidates for review: entry points by strength, obligations, summaries, region order, witnesses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph import schema
from weftgraph.graph import Graph, degrees
from weftgraph.operators import navigate, rules
from weftgraph.plans.durable import durable
from weftgraph.plans.fixpoint import fixpoint

# Strengths of entry points, the strongest first.
ENTRY_STRENGTH = ("callback", "exported", "uncalled")


def ranked_entries(g: Graph, files: DataFrame) -> DataFrame:
    """(id, strength): each callable's strongest reason to be an entry point."""
    callable_ = g.nodes.filter(F.col("kind").isin("function", "method")).select("id", "label", "unit")
    back = g.semantic("MAY_INVOKE").filter("dst is not null").select(F.col("dst").alias("id"), F.lit(0).alias("s"))
    named = files.select("unit", F.explode("exports").alias("label")).filter("label is not null").distinct()
    exported = callable_.join(named, ["unit", "label"], "left_semi").select("id", F.lit(1).alias("s"))
    uncalled = navigate.entry_points(g).select("id", F.lit(2).alias("s"))
    best = back.unionByName(exported).unionByName(uncalled).groupBy("id").agg(F.min("s").alias("s"))
    names = F.array(*[F.lit(x) for x in ENTRY_STRENGTH])
    return callable_.select("id").join(best, "id").select("id", F.element_at(names, F.col("s") + 1).alias("strength"))


def sink_obligations(g: Graph, models: DataFrame) -> DataFrame:
    """(call_id, model, rank): every call of a runtime function with an effect; ranked, never suppressed."""
    shape = F.when(F.col("effect") == "free", 1.0).when(F.col("effect") == "alloc", 0.75).when(F.col("effect") == "use", 0.5)
    b = rules.model_bindings(g, models).filter("effect <> 'none'").join(g.nodes.select(F.col("id").alias("call_id"), "confidence"), "call_id", "left")
    sure = F.when(F.col("confidence").isin("exact", "high"), 1.0).when(F.col("confidence") == "medium", 0.7).when(F.col("confidence") == "low", 0.4).otherwise(0.5)
    return b.select("call_id", "model", F.round(0.75 * shape + 0.25 * sure, 4).alias("rank"))


def census(g: Graph) -> DataFrame:
    """(family, n): how many nodes each family of kinds has."""
    return g.nodes.groupBy(schema.family(F.col("kind"), schema.NODE_KINDS).alias("family")).agg(F.count(F.lit(1)).alias("n"))


def capabilities_present(g: Graph) -> DataFrame:
    """(capability, present): what the stored edges allow to be computed."""
    need = {"value-flow": ("VALUE_FLOWS_TO",), "points-to": ("POINTS_TO",), "regions": ("TRUE_BRANCH", "FALSE_BRANCH", "LOOP_TRUE", "TRY_BODY"), "control-flow": ("CFG_NEXT",), "guards": ("GUARDED_BY",)}
    row = g.edges.agg(*[F.coalesce(F.max(schema.semantic_kind().isin(*k)), F.lit(False)).alias(c) for c, k in need.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("capability"), F.col(f"`{c}`").alias("present")) for c in need])).alias("x")).select("x.*")


def function_summaries(g: Graph, models: DataFrame) -> DataFrame:
    """(id, n_callees, n_sinks, is_source, taxonomy) per callable: what it calls and whether anything calls it."""
    p = navigate.call_pairs(g)
    sink = models.filter("kind = 'function'").select(F.col("id").alias("callee"), F.lit(1).alias("sink"))
    out = p.join(sink, "callee", "left").groupBy(F.col("caller").alias("id")).agg(F.count(F.lit(1)).alias("n_callees"), F.count("sink").alias("n_sinks"))
    called = p.select(F.col("callee").alias("id")).distinct().withColumn("called", F.lit(1))
    j = g.nodes.filter(F.col("kind").isin("function", "method")).select("id").join(out, "id", "left").join(called, "id", "left")
    zero = F.lit(0).cast("long")
    taxonomy = F.when(F.col("n_callees").isNull(), "leaf").when(F.col("n_sinks") == 0, "inner").when(F.col("n_sinks") == F.col("n_callees"), "sink-only").otherwise("mixed")
    return j.select("id", F.coalesce("n_callees", zero).alias("n_callees"), F.coalesce("n_sinks", zero).alias("n_sinks"), F.col("called").isNull().alias("is_source"), taxonomy.alias("taxonomy"))


def witnesses(g: Graph, depth: int | None = None) -> DataFrame:
    """(seed, node, path): the least of the shortest call paths from each entry point to each guarded function."""
    calls = durable(navigate.call_pairs(g), "calls")
    guarded = g.semantic("GUARDED_BY").select(F.col("src").alias("node")).filter("node is not null").distinct()
    start = navigate.entry_points(g).select(F.col("id").alias("seed"), F.col("id").alias("node"), F.col("id").alias("path"))
    step = lambda f: f.join(calls, f["node"] == calls["caller"]).select("seed", F.col("callee").alias("node"), F.concat_ws(" > ", "path", "callee").alias("path"))
    found, _ = fixpoint(start, step, ["seed", "node"], depth)
    return found.filter("round > 0").join(guarded, "node", "left_semi").select("seed", "node", "path")


def stories(g: Graph, depth: int) -> DataFrame:
    """(seed, n_reached, n_frontier): what each entry point runs within some steps, and how much goes on behind."""
    from weftgraph.operators.traverse import closure

    p = navigate.call_pairs(g)
    c = closure(navigate.entry_points(g), p.select(F.col("caller").alias("a"), F.col("callee").alias("b")), depth)
    more = p.select(F.col("caller").alias("node")).distinct().withColumn("more", F.lit(1))
    j = c.join(more, "node", "left")
    return j.groupBy("seed").agg(F.count(F.lit(1)).alias("n_reached"), F.count_if((F.col("distance") == depth) & F.col("more").isNotNull()).alias("n_frontier"))


def type_consumers(g: Graph) -> DataFrame:
    """(type_id, kind, n): how many nodes of each kind have a type."""
    e = g.semantic("HAS_TYPE").filter("dst is not null").select("src", F.col("dst").alias("type_id"))
    return e.join(g.nodes.select(F.col("id").alias("src"), "kind"), "src").groupBy("type_id", "kind").agg(F.count(F.lit(1)).alias("n"))


def coverage(g: Graph) -> DataFrame:
    """(unit, language, nodes, unresolved, diagnostics): what a unit's graph covers."""
    return g.nodes.groupBy("unit", "language").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("confidence") == "unresolved").alias("unresolved"), F.count_if(F.col("kind") == "diagnostic").alias("diagnostics"))


def context_scores(g: Graph, words: list[str]) -> DataFrame:
    """(id, score): declarations by words in common (ten each), the exact name (twenty) and degree (up to ten)."""
    q = F.array(*[F.lit(w) for w in words])
    d = navigate.decl_index(g).join(degrees(g.edges).withColumnRenamed("id", "node_id"), "node_id", "left")
    common = F.size(F.array_intersect(navigate.name_tokens(F.col("name")), q))
    score = 10 * common + F.when(F.lower("name") == "_".join(words), 20).otherwise(0) + F.least(F.coalesce("degree", F.lit(0)), F.lit(10))
    return d.filter(common > 0).select(F.col("node_id").alias("id"), score.cast("long").alias("score"))


def sink_siblings(g: Graph, models: DataFrame) -> DataFrame:
    """(sink_id, guarded, unguarded): per runtime function, its callers by whether they are guarded."""
    p = navigate.call_pairs(g).join(models.filter("kind = 'function'").select(F.col("id").alias("callee")), "callee", "left_semi")
    guarded = g.semantic("GUARDED_BY").select(F.col("src").alias("caller")).filter("caller is not null").distinct().withColumn("has", F.lit(1))
    return p.join(guarded, "caller", "left").groupBy(F.col("callee").alias("sink_id")).agg(F.count("has").alias("guarded"), F.count_if(F.col("has").isNull()).alias("unguarded"))


def packages_of(files: DataFrame) -> DataFrame:
    """(path, package): the deepest folder above a file that holds a header, else '<root>'."""
    paths = files.filter("path is not null").select("path").distinct()
    holders = paths.filter(F.col("path").endswith(".h") & F.col("path").contains("/")).select(F.regexp_replace("path", "/[^/]*$", "").alias("package")).distinct()
    parts = F.split("path", "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).otherwise(F.array(F.lit("")))
    best = paths.select("path", F.explode(above).alias("package")).join(holders, "package", "left_semi").groupBy("path").agg(F.max_by("package", F.length("package")).alias("package"))
    return paths.join(best, "path", "left").select("path", F.coalesce("package", F.lit("<root>")).alias("package"))


def call_results(g: Graph) -> DataFrame:
    """(call_id, variable_id): the only call and the only identifier on a line of one owner."""
    n = g.nodes.filter("owner_function_id is not null and start_line is not null and kind in ('call', 'identifier')")
    per = n.groupBy("owner_function_id", "start_line").agg(
        F.count_if(F.col("kind") == "call").alias("c"), F.count_if(F.col("kind") == "identifier").alias("v"), F.min(F.when(F.col("kind") == "call", F.col("id"))).alias("call_id"), F.min(F.when(F.col("kind") == "identifier", F.col("id"))).alias("variable_id")
    )
    return per.filter("c = 1 and v = 1").select("call_id", "variable_id")


def returned_values(g: Graph) -> DataFrame:
    """(value_id, call_id): what a function returns, at every call that certainly invokes it; linked or equal pairs left out."""
    r = g.edges.filter("kind = 'VALUE_FLOWS_TO' and reason = 'return' and src is not null and dst is not null").select(F.col("src").alias("value_id"), F.col("dst").alias("fn")).distinct()
    i = g.semantic("INVOKES").filter("src is not null and dst is not null").select(F.col("src").alias("call_id"), F.col("dst").alias("fn")).distinct()
    linked = g.edges.filter("kind = 'VALUE_FLOWS_TO'").select(F.col("src").alias("value_id"), F.col("dst").alias("call_id"))
    return r.join(i, "fn").filter("value_id <> call_id").select("value_id", "call_id").distinct().join(linked, ["value_id", "call_id"], "left_anti")


def double_frees(g: Graph, models: DataFrame, rounds: int | None = None) -> DataFrame:
    """(free_id, again_id): statements that free, reached from another one that does, along the control flow with no allocation between."""
    nxt = durable(rules.cfg(g), "cfg")
    b = rules.model_bindings(g, models).select(F.col("call_id"), "effect")
    inside = g.semantic("AST_CHILD").filter("src is not null and dst is not null").select(F.col("src").alias("at"), F.col("dst").alias("call_id")).distinct()
    e = durable(inside.join(b, "call_id").select("at", "effect").distinct(), "effects")
    frees, allocs = e.filter("effect = 'free'").select("at"), e.filter("effect = 'alloc'").select("at")

    def step(f: DataFrame) -> DataFrame:
        live = f.filter("free_id = at").unionByName(f.filter("free_id <> at").join(allocs, "at", "left_anti").select(f.columns))
        return live.join(nxt, live["at"] == nxt["a"]).select("free_id", F.col("b").alias("at"))

    found, _ = fixpoint(frees.select(F.col("at").alias("free_id"), "at"), step, ["free_id", "at"], rounds)
    return found.filter("round > 0 and free_id <> at").join(frees, "at", "left_semi").select("free_id", F.col("at").alias("again_id"))


# Which frontend reads a file's extension.
FRONTENDS = {"c": "clang-c", "h": "clang-c", "py": "cpython-ast", "pyi": "cpython-ast", "ts": "ts-compiler", "tsx": "ts-compiler", "js": "ts-compiler"}


def frontend_files(files: DataFrame) -> DataFrame:
    """(unit, frontend, n_files): which frontend reads how many files of a unit, by extension."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    frontend = F.coalesce(*[F.when(ext == e, f) for e, f in FRONTENDS.items()], F.lit("none"))
    return files.filter("path is not null").select("unit", "path", frontend.alias("frontend")).distinct().groupBy("unit", "frontend").agg(F.count(F.lit(1)).alias("n_files"))


def text_scan(files: DataFrame, pattern: str) -> DataFrame:
    """(file_id, line, content): lines of the kept texts that match."""
    lines = F.posexplode(F.split("text", "\n")).alias("at", "content")
    once = files.filter("text is not null").select("file_id", "text").distinct()
    return once.select("file_id", lines).filter(F.col("content").rlike(pattern)).select("file_id", (F.col("at") + 1).cast("long").alias("line"), "content")


def unresolved_reasons(g: Graph) -> DataFrame:
    """(reason, n): why nodes are not resolved, the first reason of each."""
    resolution = F.get_json_object("props", "$.resolution")
    reason = (
        F.when(F.col("kind") == "diagnostic", "diagnostic")
        .when(F.col("kind").isin("boundary", "external-module"), "boundary")
        .when((F.col("kind") == "call") & (resolution == "dynamic"), "dynamic")
        .when((F.col("kind") == "call") & resolution.isNull(), "missing-model")
        .when(F.col("confidence") == "unresolved", "confidence")
    )
    return g.nodes.select(reason.alias("reason")).filter("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def definitions_before(g: Graph) -> DataFrame:
    """(read_id, def_id): for each read, the identifier of its name that stands last before it in its owner (an as-of join).

    Both streams are sorted by line within owner and name and swept once, definitions first on equal lines.
    """
    n = g.nodes.filter("owner_function_id is not null and start_line is not null and label is not null and kind in ('read', 'identifier')")
    w = Window.partitionBy("owner_function_id", "label").orderBy("start_line", F.col("kind") == "read", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = n.withColumn("def_id", F.last(F.when(F.col("kind") == "identifier", F.col("id")), ignorenulls=True).over(w))
    return swept.filter("kind = 'read'").select(F.col("id").alias("read_id"), "def_id")


def connectors(g: Graph, share: float = 0.05, least: int = 20) -> DataFrame:
    """(id, degree, is_connector): call-graph nodes that touch more than a share of all the others."""
    p = navigate.call_pairs(g).filter("caller <> callee")
    u = p.select(F.least("caller", "callee").alias("a"), F.greatest("caller", "callee").alias("b")).distinct()
    deg = durable(u.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree")), "degree")
    n = deg.count()
    return deg.select("id", "degree", (F.lit(n >= least) & (F.col("degree") > share * n)).alias("is_connector"))


def merge_points(g: Graph) -> DataFrame:
    """(id, n_before): statements where control flow from several others meets."""
    c = rules.cfg(g).filter("a <> b")
    return c.groupBy(F.col("b").alias("id")).agg(F.count(F.lit(1)).alias("n_before")).filter("n_before > 1")
