"""Accessors, roll-ups, rankings and name resolution over the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph import schema
from weftgraph.graph import Graph, degrees
from weftgraph.plans.durable import durable
from weftgraph.plans.ranges import lead_in_ranges


def owner(nodes: DataFrame) -> Column:
    return F.coalesce("owner_function_id", "function_id")


def file_key(nodes: DataFrame) -> Column:
    return F.coalesce("absolute_file", "file")


def targets(g: Graph, *kinds: str) -> DataFrame:
    """(src, dst, kind, label) of edges of the kinds whose far end is a node."""
    e = g.semantic(*kinds).select("src", "dst")
    return e.join(g.nodes.select(F.col("id").alias("dst"), "kind", "label"), "dst").select("src", "dst", "kind", "label")


# A fixed value: what makes a path one of tests.
TEST_PATH = r"(?i)\.(test|spec)\.|\.integration\.|\.e2e\.|(^|/)__tests__/|(^|/)tests?/|_test\.|(^|/)selftests/|(^|/)tools/testing/|(^|/)test_[^/]*\.py$|(^|/)conftest\.py$"


def is_test_path(path: Column) -> Column:
    return F.coalesce(path.rlike(TEST_PATH), F.lit(False))


def is_external_path(path: Column) -> Column:
    return F.coalesce(F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*[F.lit(x) for x in ("node_modules", "vendor", "vendors", "third_party", "third-party")])), F.lit(False))


def component_of(path: Column, depth: int) -> Column:
    """The first ``depth`` directories of a path, '.' for files at the root."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) <= 1, ".").otherwise(F.array_join(F.slice(parts, F.lit(1), F.least(F.lit(depth), F.size(parts) - 1)), "/"))


def call_pairs(g: Graph) -> DataFrame:
    """Distinct (caller, callee) of the call edges, as meant."""
    e = g.semantic("CALLS").filter(F.col("src").isNotNull() & F.col("dst").isNotNull())
    return e.select(F.col("src").alias("caller"), F.col("dst").alias("callee")).distinct()


def owner_callables(g: Graph) -> DataFrame:
    """(id, callable_id): the function, method or constructor that a node stands in, itself if it is one; nodes without one are left out.

    Owners are climbed by pointer doubling, so the rounds grow with the logarithm of the nesting; a
    chain of owners that closes on itself has no callable. Where owners lead nowhere the scopes
    above are climbed, at most 32 of them.
    """
    n = durable(g.nodes.select("id", F.col("kind").isin(*schema.CALLABLE_KINDS).alias("done"), owner(g.nodes).alias("own"), F.get_json_object("props", "$.scope_id").alias("scope")), "owners")
    found = _climb(n.select("id", "done", F.col("own").alias("up")), 31)
    left = n.filter("scope is not null and not done").join(found.select("id"), "id", "left_anti")
    if not left.isEmpty():
        chain = _climb(n.select("id", "done", F.col("scope").alias("up")), 5)  # two to the fifth scopes
        found = found.unionByName(left.select("id").join(chain, "id"))
    return found


def _climb(n: DataFrame, rounds: int) -> DataFrame:
    """(id, callable_id) by pointer doubling over (id, done, up), two to the power of ``rounds`` steps at most."""
    at = n.select("id", "done", F.when(F.col("done"), F.col("id")).otherwise(F.col("up")).alias("at")).filter("at is not null")
    pending = at.filter("not done").select("id", "at")
    out = at.filter("done").select("id", F.col("at").alias("callable_id"))
    ends = n.filter("done").select(F.col("id").alias("at"))
    for _ in range(rounds):
        here = pending.join(ends, "at", "left_semi")
        out = out.unionByName(here.select("id", F.col("at").alias("callable_id")))
        rest = durable(pending.join(ends, "at", "left_anti").select("id", "at"), "climb")
        if rest.isEmpty():
            break
        nxt = rest.select(F.col("id").alias("at"), F.col("at").alias("to"))
        jumped = durable(rest.join(nxt, "at").select("id", F.col("to").alias("at")).filter("id <> at"), "climb")
        # those whose next one has arrived already go to its end
        arrived = rest.join(out.select(F.col("id").alias("at"), "callable_id"), "at").select("id", "callable_id")
        out = durable(out.unionByName(arrived.join(ends.withColumnRenamed("at", "id"), "id", "left_anti")).dropDuplicates(["id"]), "climbed")
        pending = jumped.join(out.select("id"), "id", "left_anti")
    return out.dropDuplicates(["id"])


def caller_decls(g: Graph) -> DataFrame:
    """(id, decl): what a node's calls are laid to: a call context's caller, else the callable it stands in, else the node itself."""
    own = owner_callables(g).withColumnRenamed("callable_id", "own")
    named = F.when(F.col("kind") == "call-context", F.get_json_object("props", "$.caller_function_id"))
    j = g.nodes.select("id", named.alias("named")).join(own, "id", "left")
    known = g.nodes.select(F.col("id").alias("named"), F.lit(True).alias("known"))
    return j.join(known, "named", "left").select("id", F.coalesce(F.when(F.col("known"), F.col("named")), "own", "id").alias("decl"))


def union_call_pairs(g: Graph, resolved_only: bool = False) -> DataFrame:
    """Distinct (caller, callee) over direct and indirect calls, callers lifted to their declarations; ``resolved_only`` keeps direct calls that are exact, high or unstamped."""
    e = g.semantic(*schema.DIRECT_CALLS) if resolved_only else g.semantic(*schema.DIRECT_CALLS, *schema.INDIRECT_CALLS)
    if resolved_only:
        e = e.filter("confidence is null or lower(trim(confidence)) in ('exact', 'high')")
    e = e.filter("src is not null and dst is not null").select(F.col("src").alias("id"), F.col("dst").alias("callee")).distinct()
    return e.join(caller_decls(g), "id").select(F.col("decl").alias("caller"), "callee").distinct()


def file_provenance(g: Graph) -> DataFrame:
    """(file, foreign): files of the graph and whether they say they are not the application's."""
    said = F.get_json_object("props", "$.provenance")
    return g.nodes.filter("kind = 'file' and file is not null").groupBy("file").agg(F.coalesce(F.max(said != "application"), F.lit(False)).alias("foreign"))


def hubs(g: Graph, include_external: bool = False, include_tests: bool = False, resolved_only: bool = False) -> DataFrame:
    """(id, label, file, fan_in, fan_out, degree, flags) of callables with a body that calls touch, over distinct declaration pairs.

    Flags tell what is exported, reached by dispatch, or registered as a callback. Files of tests and
    foreign ones are left out unless asked for.
    """
    marked = {"exported": ("EXPORTS",), "dispatch_target": tuple(schema.INDIRECT_CALLS), "callback": schema.CALLBACK_EDGES}
    p = durable(union_call_pairs(g, resolved_only), "pairs")
    ends = p.select(F.explode(F.array(F.struct(F.col("callee").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("caller").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("x"))
    fans = ends.select("x.*").groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    own = g.nodes.filter(F.col("kind").isin(*schema.CALLABLE_KINDS)).filter(F.coalesce(F.get_json_object("props", "$.declaration_only") != "true", F.lit(True))).select("id", "label", "file")
    if not include_tests:
        own = own.filter(~is_test_path(F.col("file")))
    if not include_external:
        own = own.filter(~is_external_path(F.col("file"))).join(file_provenance(g).filter("foreign").select("file"), "file", "left_anti")
    is_ = lambda ks: F.col("kind").isin(*ks) | schema.semantic_kind().isin(*ks)
    found = F.array_compact(F.array(*[F.when(is_(ks), F.lit(flag)) for flag, ks in marked.items()]))
    marks = g.edges.filter("dst is not null").select(F.col("dst").alias("id"), F.explode(found).alias("flag")).distinct()
    order = F.array(*[F.lit(flag) for flag in marked])
    flags = marks.groupBy("id").agg(F.array_join(F.array_intersect(order, F.collect_set("flag")), ",").alias("flags"))
    return fans.join(own, "id").join(flags, "id", "left").select("id", "label", "file", "fan_in", "fan_out", (F.col("fan_in") + F.col("fan_out")).alias("degree"), F.coalesce("flags", F.lit("")).alias("flags"))


def top_hubs(g: Graph, n: int) -> DataFrame:
    return hubs(g).orderBy(F.desc("degree"), F.desc("fan_in"), F.lower("label"), "id").limit(n)


# Names that look like security, by weight; edges that guard, by what they do.
SECURITY_HIGH = r"(?i)verif|hmac|\bsign|signature|digest|sanit|escape|\bhash\b"
SECURITY_MEDIUM = r"(?i)valid|auth|token|assert|allow|deny|permit|forbid|trust|scope|origin|redirect|secret|cred|\bcheck|guard|authoriz|permission|owner\b|tenant"
GUARD_EDGES = {
    "conditions": ("CONDITION",),
    "short_circuits": ("SHORT_CIRCUIT_LEFT", "SHORT_CIRCUIT_RIGHT"),
    "throws": ("THROWS_VALUE",),
    "exception_branches": ("EXCEPTION_BRANCH",),
    "handles": ("TRY_BODY", "HANDLED_BY"),
}


def security_weight(name: Column) -> Column:
    return F.when(name.rlike(SECURITY_HIGH), 1.0).when(name.rlike(SECURITY_MEDIUM), 0.6).otherwise(0.0)


def guard_profile(g: Graph) -> DataFrame:
    """(owner_id, conditions, short_circuits, throws, exception_branches, handles, security_weight, score, class, owned) of callables with a guarding edge.

    An edge is laid to the callable of its source, else of its target.
    """
    own = durable(owner_callables(g), "owned")
    kinds = [k for ks in GUARD_EDGES.values() for k in ks]
    e = g.semantic(*kinds).select("row_id", "src", "dst", schema.semantic_kind().alias("sem"), "kind")
    j = e.join(own.select(F.col("id").alias("src"), F.col("callable_id").alias("a")), "src", "left").join(own.select(F.col("id").alias("dst"), F.col("callable_id").alias("b")), "dst", "left")
    is_ = lambda ks: F.col("kind").isin(*ks) | F.col("sem").isin(*ks)
    per = j.withColumn("owner_id", F.coalesce("a", "b")).filter("owner_id is not null").groupBy("owner_id").agg(*[F.count_if(is_(ks)).alias(name) for name, ks in GUARD_EDGES.items()])
    called = g.semantic("CALLS", "INVOKES", "MAY_INVOKE").filter("src is not null").select(F.col("src").alias("owner_id"), F.col("dst").alias("id")).distinct()
    weight = called.join(per.select("owner_id"), "owner_id", "left_semi").join(g.nodes.select("id", security_weight(F.coalesce("label", F.lit(""))).alias("w")), "id").groupBy("owner_id").agg(F.max("w").alias("security_weight"))
    size = g.nodes.select(owner(g.nodes).alias("owner_id")).groupBy("owner_id").agg(F.count(F.lit(1)).alias("owned"))
    j = per.join(weight, "owner_id", "left").join(size, "owner_id", "left")
    sec = F.coalesce("security_weight", F.lit(0.0))
    events = 0.15 * F.col("conditions") + 0.2 * F.col("short_circuits") + 0.3 * F.col("throws") + 0.1 * F.col("exception_branches")
    branching = (F.col("conditions") > 0) | (F.col("short_circuits") > 0)
    shape = F.when((F.col("throws") > 0) & branching, "guard").when(branching, "validate").otherwise("passthrough")
    return j.select("owner_id", *GUARD_EDGES, sec.alias("security_weight"), F.round(F.least(F.lit(1.0), events) * (0.5 + 0.5 * sec), 3).alias("score"), shape.alias("class"), F.coalesce("owned", F.lit(0)).cast("long").alias("owned"))


def unit_rollup(g: Graph) -> DataFrame:
    """(unit, semantic, n, n_src): edges of each unit by meaning."""
    return g.edges.groupBy("unit", schema.semantic_kind().alias("semantic")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("src").alias("n_src"))


def call_rollup(g: Graph) -> DataFrame:
    """(src_file, dst_file, weight, witness): calls between files, through what each file contains."""
    inside = g.semantic("CONTAINS").join(g.nodes.filter("kind = 'file'").select(F.col("id").alias("src")), "src", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("file_id"))
    p = call_pairs(g)
    j = p.join(inside.select(F.col("id").alias("caller"), F.col("file_id").alias("src_file")), "caller").join(inside.select(F.col("id").alias("callee"), F.col("file_id").alias("dst_file")), "callee")
    return j.filter("src_file <> dst_file").groupBy("src_file", "dst_file").agg(F.count(F.lit(1)).alias("weight"), F.min("caller").alias("witness"))


def roles_of(nodes: DataFrame) -> DataFrame:
    """(id, role): the roles that nodes carry in their properties."""
    kind = "array<struct<role:string>>"
    return nodes.filter("props is not null").select("id", F.explode(F.from_json(F.get_json_object("props", "$.roles"), kind)).alias("r")).select("id", F.col("r.role").alias("role")).filter("role is not null")


def unresolved_reason(nodes: DataFrame) -> Column:
    """Why a node is not resolved, the first reason that holds; null if it is."""
    p = lambda k: F.get_json_object("props", f"$.{k}")
    left = p("resolution").isin("unresolved", "dynamic-or-unresolved", "external")
    return (
        F.when(F.col("kind") == "diagnostic", "compiler-diagnostic")
        .when(F.col("kind") == "boundary", F.coalesce(p("boundary_kind"), F.lit("runtime-boundary")))
        .when(F.col("kind") == "dynamic-behavior", F.coalesce(p("behavior_kind"), F.lit("dynamic-runtime")))
        .when(left, F.when(F.col("kind").isin(*schema.CALLSITE_KINDS), "unresolved-call").otherwise(p("resolution")))
        .when(F.col("confidence") == "unresolved", "unresolved-fact")
    )


def file_of(g: Graph) -> DataFrame:
    """(id, file_id): the file node that a node belongs to, by absolute path, else by path or label."""
    f = g.nodes.filter("kind = 'file'")
    by_absolute = f.filter("absolute_file is not null").groupBy("absolute_file").agg(F.max("id").alias("by_absolute"))
    names = f.select(F.col("label").alias("file"), "id").unionByName(f.select("file", "id")).filter("file is not null")
    by_name = names.groupBy("file").agg(F.max("id").alias("by_name"))
    j = g.nodes.select("id", "kind", "absolute_file", "file").join(by_absolute, "absolute_file", "left").join(by_name, "file", "left")
    return j.select("id", F.when(F.col("kind") == "file", F.col("id")).otherwise(F.coalesce("by_absolute", "by_name")).alias("file_id")).filter("file_id is not null")


def component_scores(g: Graph) -> DataFrame:
    """(id, label, nodes, unresolved, score) per file: sources and boundaries weigh one, sinks two, entry points three, unresolved nodes one."""
    worth = F.when(F.col("role").isin("Source", "Boundary"), 1).when(F.col("role") == "Sink", 2).when(F.col("role") == "EntryPoint", 3).otherwise(0)
    role = roles_of(g.nodes).select("id", worth.alias("w")).groupBy("id").agg(F.sum("w").alias("w"))
    open_ = g.nodes.select("id", unresolved_reason(g.nodes).isNotNull().cast("int").alias("u"))
    per = file_of(g).join(open_, "id").join(role, "id", "left").groupBy("file_id").agg(F.count(F.lit(1)).alias("nodes"), F.sum("u").alias("unresolved"), (F.sum("u") + F.sum(F.coalesce("w", F.lit(0)))).alias("score"))
    return per.join(g.nodes.select(F.col("id").alias("file_id"), "label"), "file_id").select(F.col("file_id").alias("id"), "label", "nodes", "unresolved", "score")


def top_components(g: Graph, n: int = 25) -> DataFrame:
    return component_scores(g).orderBy(F.desc("score"), "label", "id").limit(n)


def rarity(nodes: DataFrame) -> DataFrame:
    """(kind, n, rarity): one over the number of nodes of a kind."""
    return nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).withColumn("rarity", F.round(1 / F.col("n"), 9))


def capability_levels(snapshots: DataFrame) -> DataFrame:
    """(capability, level): the highest level that a snapshot declares."""
    rank = F.array_position(F.array(*[F.lit(x) for x in schema.CAPABILITY_LEVELS]), F.col("level"))
    c = snapshots.select(F.explode("capabilities").alias("capability", "level"))
    return c.filter(F.col("level").isNotNull()).groupBy("capability").agg(F.max_by("level", rank).alias("level"))


def strongest_call(g: Graph) -> DataFrame:
    """(dst, src, confidence): per callee the strongest call, ties by least caller."""
    e = g.semantic("CALLS", "INVOKES", "MAY_INVOKE").filter("src is not null and dst is not null")
    best = F.min(F.struct(schema.confidence_rank(F.col("confidence")).alias("r"), "src")).alias("x")
    return e.groupBy("dst").agg(best).select("dst", F.col("x.src").alias("src"), F.element_at(F.array(*[F.lit(c) for c in (*schema.CONFIDENCE_RANK, "unknown")]), F.col("x.r") + 1).alias("confidence"))


def next_siblings(g: Graph) -> DataFrame:
    """(parent, node, follower): children in order of position, the next one of each."""
    e = g.semantic("AST_CHILD").filter("src is not null and dst is not null").groupBy("src", "dst").agg(F.min("position").alias("position"))
    return lead_in_ranges(e, "src", ["position", "dst"], "dst", "follower").select(F.col("src").alias("parent"), F.col("dst").alias("node"), "follower")


# -- names
def name_tokens(name: Column) -> Column:
    """Lower-case words of a name: camel humps, runs of letters, digits."""
    return F.transform(F.regexp_extract_all(name, F.lit(r"[A-Z]+(?![a-z])|[A-Z][a-z]+|[a-z]+|[0-9]+"), F.lit(0)), lambda t: F.lower(t))


def decl_index(g: Graph) -> DataFrame:
    """(node_id, name, kind, unit, declaration_only) of the declarations."""
    flag = F.coalesce(F.get_json_object("props", "$.declaration_only") == "true", F.lit(False))
    return g.nodes.filter(F.col("kind").isin("function", "method", "class", "variable")).select(F.col("id").alias("node_id"), F.col("label").alias("name"), "kind", "unit", flag.alias("declaration_only"))


def callsite_index(g: Graph) -> DataFrame:
    """(node_id, callee_name, owner_id, unit, form) of the call sites."""
    return g.nodes.filter("kind = 'call'").select(F.col("id").alias("node_id"), F.coalesce(F.get_json_object("props", "$.callee"), "label").alias("callee_name"), owner(g.nodes).alias("owner_id"), "unit", F.get_json_object("props", "$.resolution").alias("form"))


def resolve_calls(g: Graph) -> DataFrame:
    """(call_id, rung, n_candidates): the first rung of the ladder that decides a call.

    Trusted edges (one exact, several conservative), then the sole declaration of the name in the
    unit, then homonyms there, then possible edges, else unresolved. Counts come first, so a hot
    callee or a common name never meets all its calls.
    """
    sites = callsite_index(g)
    trusted = g.semantic("INVOKES", "CALLS").filter("src is not null and dst is not null").groupBy(F.col("src").alias("node_id")).agg(F.countDistinct("dst").alias("n_trusted"))
    possible = g.semantic("MAY_INVOKE").filter("src is not null and dst is not null").groupBy(F.col("src").alias("node_id")).agg(F.countDistinct("dst").alias("n_possible"))
    named = decl_index(g).filter(F.col("kind").isin("function", "method") & F.col("name").isNotNull()).groupBy(F.col("name").alias("callee_name"), "unit").agg(F.count(F.lit(1)).alias("n_named"))
    j = sites.join(trusted, "node_id", "left").join(possible, "node_id", "left").join(named, ["callee_name", "unit"], "left")
    rung = F.when(F.col("n_trusted") == 1, "exact").when(F.col("n_trusted") > 1, "conservative").when(F.col("n_named") == 1, "sole-candidate").when(F.col("n_named") > 1, "homonyms").when(F.col("n_possible") > 0, "indirect").otherwise("unresolved")
    return j.select(F.col("node_id").alias("call_id"), rung.alias("rung"), F.coalesce("n_trusted", "n_named", "n_possible", F.lit(0)).alias("n_candidates"))


def callers(g: Graph) -> DataFrame:
    """(callee, caller, via): direct callers, and indirect ones that are not direct."""
    direct = g.semantic("CALLS", "INVOKES").select(F.col("dst").alias("callee"), F.col("src").alias("caller"), F.lit(0).alias("v"))
    indirect = g.semantic("MAY_INVOKE").select(F.col("dst").alias("callee"), F.col("src").alias("caller"), F.lit(1).alias("v"))
    every = direct.unionByName(indirect).filter("callee is not null and caller is not null")
    return every.groupBy("callee", "caller").agg(F.min("v").alias("v")).select("callee", "caller", F.when(F.col("v") == 0, "direct").otherwise("indirect").alias("via"))


def search(g: Graph, query: str) -> DataFrame:
    """(id, label, kind, score, degree) of declarations by likeness of their name: 100 exact to 40 all words inside."""
    q = query.lower()
    words = F.array(*[F.lit(w) for w in q.replace("_", " ").split()])
    d = decl_index(g)
    name, tokens = F.lower("name"), name_tokens(F.col("name"))
    score = (
        F.when(name == q, 100)
        .when(name.startswith(q), 85)
        .when(F.array_contains(tokens, q), 70)
        .when(name.contains(q), 55)
        .when(F.forall(words, lambda w: F.exists(tokens, lambda t: t.contains(w))), 40)
    )
    hit = d.withColumn("score", score).filter("score is not null")
    return hit.join(degrees(g.edges).withColumnRenamed("id", "node_id"), "node_id", "left").select(F.col("node_id").alias("id"), F.col("name").alias("label"), "kind", "score", F.coalesce("degree", F.lit(0)).alias("degree"))


def page(df: DataFrame, order: list, offset: int, size: int) -> DataFrame:
    """One page of a ranked result with its place and the total: the feature is the cut."""
    total = df.count()
    ranked = df.orderBy(*order).limit(offset + size)
    w = Window.orderBy(*order)  # over the rows of the pages so far only
    return ranked.withColumn("place", F.row_number().over(w)).filter(F.col("place") > offset).withColumn("total", F.lit(total).cast("long"))


def homonyms(g: Graph) -> DataFrame:
    """(name, n_decls, n_units, first_id): names that several declarations share."""
    return decl_index(g).groupBy("name").agg(F.count(F.lit(1)).alias("n_decls"), F.countDistinct("unit").alias("n_units"), F.min("node_id").alias("first_id")).filter("n_decls > 1")


def folder_links(files: DataFrame) -> DataFrame:
    """(folder, child): every folder of every path with what it holds directly."""
    parts = F.split("path", "/")
    pairs = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("folder"), F.array_join(F.slice(parts, F.lit(1), k + 1), "/").alias("child")))
    return files.filter(F.col("path").contains("/")).select(F.explode(pairs).alias("x")).select("x.folder", "x.child").distinct()


def template_families(files: DataFrame) -> DataFrame:
    """(template, n_folders): folders alike but for one part of their path."""
    folder = files.filter(F.col("path").contains("/")).select(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).distinct()
    parts = F.split("folder", "/")
    blanked = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.transform(parts, lambda p, i: F.when(i + 1 == k, F.lit("*")).otherwise(p)), "/"))
    return folder.filter(F.size(parts) > 1).select("folder", F.explode(blanked).alias("template")).groupBy("template").agg(F.count(F.lit(1)).alias("n_folders")).filter("n_folders > 1")


def peer_guards(g: Graph) -> DataFrame:
    """(stem, guarded, unguarded, peers_guard): functions alike by the first word of their name, and how many are guarded."""
    guarded = g.semantic("GUARDED_BY").select(F.col("src").alias("id")).distinct().withColumn("has", F.lit(1))
    f = g.nodes.filter(F.col("kind").isin("function", "method")).select("id", F.element_at(name_tokens(F.col("label")), 1).alias("stem"))
    per = f.join(guarded, "id", "left").groupBy("stem").agg(F.count("has").alias("guarded"), F.count_if(F.col("has").isNull()).alias("unguarded"))
    return per.withColumn("peers_guard", (F.col("guarded") >= 2) & (F.col("guarded") > F.col("unguarded")))


def alias_classes(g: Graph) -> DataFrame:
    """(value, heap_object, n_aliases): what each value points to and how many others do as well; classes, not pairs."""
    p = g.semantic("POINTS_TO").filter("src is not null and dst is not null").select(F.col("src").alias("value"), F.col("dst").alias("heap_object")).distinct()
    n = p.groupBy("heap_object").agg(F.count(F.lit(1)).alias("n"))
    return p.join(n, "heap_object").select("value", "heap_object", (F.col("n") - 1).alias("n_aliases"))


def enclosing_statements(g: Graph) -> DataFrame:
    """(id, statement_id): the smallest statement of the same file and owner whose lines hold a node's."""
    cols = ["file", F.coalesce("owner_function_id", F.lit("")).alias("o"), "start_line", "end_line"]
    s = g.nodes.filter("kind = 'statement' and file is not null and start_line is not null and end_line is not null").select(F.col("id").alias("statement_id"), *cols)
    n = g.nodes.filter("kind in ('expression','call','read') and file is not null and start_line is not null").select("id", *cols[:3], F.coalesce("end_line", "start_line").alias("end_line"))
    j = n.alias("n").join(s.alias("s"), (F.col("n.file") == F.col("s.file")) & (F.col("n.o") == F.col("s.o")) & (F.col("s.start_line") <= F.col("n.start_line")) & (F.col("n.end_line") <= F.col("s.end_line")))
    best = F.min(F.struct((F.col("s.end_line") - F.col("s.start_line")).alias("size"), F.col("s.statement_id").alias("statement_id"))).alias("x")
    return j.groupBy(F.col("n.id").alias("id")).agg(best).select("id", F.col("x.statement_id").alias("statement_id"))


def unresolved_calls(g: Graph) -> DataFrame:
    """(call_id, unit): calls that no call edge leaves."""
    decided = g.semantic("CALLS", "INVOKES", "MAY_INVOKE").select(F.col("src").alias("id")).distinct()
    return g.nodes.filter("kind = 'call'").join(decided, "id", "left_anti").select(F.col("id").alias("call_id"), "unit")


def entry_points(g: Graph) -> DataFrame:
    """(id, label): callables that nothing calls."""
    called = g.semantic("CALLS", "INVOKES", "MAY_INVOKE").select(F.col("dst").alias("id")).filter("id is not null").distinct()
    return g.nodes.filter(F.col("kind").isin(*schema.CALLABLE_KINDS)).join(called, "id", "left_anti").select("id", "label")
