"""Index accessors, full name resolution, set operations and pages over the graph.

Defined cases: edges whose far end is no node give no neighbour; null labels resolve to nothing; a
call without any rung is ``none``; repeated rows count once; an empty graph gives no rows.
"""

from __future__ import annotations

import base64

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph import schema
from weftgraph.graph import Graph, degrees
from weftgraph.operators import navigate
from weftgraph.plans.durable import durable

# Kinds that names resolve to, and their order of preference (others stand in between, at 3).
INDEXED_KINDS = "file class interface enum type function method constructor record union variable property constant macro".split()
KIND_RANK = {0: ("function", "method", "constructor"), 1: ("class", "interface", "enum", "type", "record", "union"), 2: ("file",), 5: ("variable", "property", "constant")}
# What a decided call edge says of itself.
TRUSTED_RESOLUTIONS = ("exact", "compiler-local", "cross-tu", "binding", "registration")
TRUSTED_CONFIDENCES = ("exact", "high")
#: Candidates of one call from which the row says that the list is long; all of them are kept.
MANY_CANDIDATES = 64


def prop(name: str) -> Column:
    return F.get_json_object("props", f"$.{name}")


def is_true(name: str) -> Column:
    return F.coalesce(prop(name) == "true", F.lit(False))


def kind_rank(kind: Column) -> Column:
    out = F.lit(3)
    for rank, kinds in KIND_RANK.items():
        out = F.when(kind.isin(*kinds), rank).otherwise(out)
    return out


def kinds_present(g: Graph) -> DataFrame:
    """(kind, present) for every kind of the vocabulary."""
    spark = g.nodes.sparkSession
    every = spark.createDataFrame([(k,) for ks in schema.NODE_KINDS.values() for k in ks], "kind string")
    have = g.nodes.select("kind").distinct().withColumn("has", F.lit(True))
    return every.join(have, "kind", "left").select("kind", F.coalesce("has", F.lit(False)).alias("present"))


def neighbours(g: Graph, *kinds: str) -> DataFrame:
    """(id, direction, row_id, other, other_kind): both ends of the edges of the kinds, where the far end is a node."""
    e = g.semantic(*kinds).filter("src is not null and dst is not null")
    far = g.nodes.select(F.col("id").alias("other"), F.col("kind").alias("other_kind"))
    out = e.select(F.col("src").alias("id"), F.lit("out").alias("direction"), "row_id", F.col("dst").alias("other"))
    into = e.select(F.col("dst").alias("id"), F.lit("in").alias("direction"), "row_id", F.col("src").alias("other"))
    return out.unionByName(into).join(far, "other").select("id", "direction", "row_id", "other", "other_kind")


def first_targets(g: Graph, *kinds: str) -> DataFrame:
    """(id, target): of each node's targets that exist the one of the first edge."""
    n = neighbours(g, *kinds).filter("direction = 'out'")
    return n.groupBy("id").agg(F.min_by("other", "row_id").alias("target"))


def exported_ids(g: Graph) -> DataFrame:
    return g.semantic("EXPORTS").filter("dst is not null").select(F.col("dst").alias("id")).distinct()


def endpoint_nodes(g: Graph, *kinds: str) -> DataFrame:
    """(id, kind) of the nodes that edges of the kinds touch."""
    ends = g.semantic(*kinds).select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return g.nodes.select("id", "kind").join(ends, "id", "left_semi")


def external_nodes(g: Graph) -> DataFrame:
    """(id, file): nodes in files that are not the application's, by provenance or by folder."""
    n = g.nodes.filter("file is not null").select("id", "file")
    said = navigate.file_provenance(g).filter("foreign").select("file")
    by_path = n.filter(navigate.is_external_path(F.col("file")))
    return by_path.unionByName(n.join(said, "file", "left_semi").select("id", "file")).distinct()


def tiers(g: Graph) -> DataFrame:
    """(id, tier): symbols of scopes inside functions stand with the bodies."""
    local = g.nodes.filter(F.col("kind") == "scope").filter("owner_function_id is not null").select(F.col("id").alias("src"))
    inside = g.semantic("DECLARES_SYMBOL").join(local, "src", "left_semi").select(F.col("dst").alias("id")).distinct().withColumn("local", F.lit(True))
    return g.nodes.select("id", "kind").join(inside, "id", "left").select("id", schema.tier(F.col("kind"), F.col("local")).alias("tier"))


def unresolved(g: Graph) -> DataFrame:
    """(id, kind, reason) of every node that is not resolved."""
    return g.nodes.select("id", "kind", navigate.unresolved_reason(g.nodes).alias("reason")).filter("reason is not null")


def rollups(g: Graph) -> DataFrame:
    """(kind, src, dst, weight, witnesses): CALLS_SUMMARY between declarations and DEPENDS_ON_SUMMARY between files, with their edges.

    A witness is the call site an edge names, else the edge's row.
    """
    t = tiers(g)
    say = schema.semantic_kind()
    e = g.edges.filter(say.isin("CALLS", "DEPENDS_ON", "RUNTIME_DEPENDS_ON", "RE_EXPORTS") & F.col("src").isNotNull() & F.col("dst").isNotNull())
    calls = say == "CALLS"
    e = e.select(F.when(calls, "CALLS_SUMMARY").otherwise("DEPENDS_ON_SUMMARY").alias("kind"), F.when(calls, "T1").otherwise("T0").alias("layer"), "src", "dst", F.coalesce(F.when(calls, prop("callsite")), F.col("row_id").cast("string")).alias("witness"))
    per = e.groupBy("kind", "layer", "src", "dst").agg(F.count(F.lit(1)).alias("weight"), F.array_join(F.sort_array(F.collect_list("witness")), " ").alias("witnesses"))
    at = lambda end: t.select(F.col("id").alias(end), F.col("tier").alias("layer"))
    return per.join(at("src"), ["src", "layer"], "left_semi").join(at("dst"), ["dst", "layer"], "left_semi").select("kind", "src", "dst", "weight", "witnesses")


# -- names ----------------------------------------------------------------------------------------
def last_name(value: Column) -> Column:
    """The bare name at the end of a callee expression: ``a?.b.c(x)`` is ``c``, ``handlers['run']`` is ``run``."""
    v = F.regexp_replace(value, r"^[\s\S]*\?\.", "")
    v = F.regexp_replace(v, r"^[\s\S]*\.", "")
    v = F.regexp_replace(v, r"^[\s\S]*\[", "")
    v = F.regexp_replace(v, r"\([\s\S]*$", "")
    return F.regexp_replace(v, r"^['\"`\] ]+|['\"`\] ]+$", "")


def callee_name(label: Column) -> Column:
    """What a call site calls: the name that the frontend gives, else the end of the expression."""
    given = F.coalesce(*[F.when(prop(k) != "", prop(k)) for k in ("callee_name", "method_name")])
    return F.coalesce(given, last_name(F.coalesce(F.when(prop("callee") != "", prop("callee")), label, F.lit(""))))


def declarations(g: Graph) -> DataFrame:
    """(node_id, name, kind, file, line, namespace, language, declaration_only, storage_class) of what names can resolve to."""
    n = g.nodes.filter(F.col("kind").isin(*INDEXED_KINDS) & F.col("label").isNotNull() & (F.col("label") != ""))
    return n.select(F.col("id").alias("node_id"), F.col("label").alias("name"), "kind", "file", F.col("start_line").alias("line"), namespace(F.col("id")).alias("namespace"), "language", is_true("declaration_only").alias("declaration_only"), prop("storage_class").alias("storage_class"))


def namespace(node_id: Column) -> Column:
    """The frontend that an id belongs to; null for ids of another owner or form."""
    parts = F.split(node_id, ":")
    return F.when(node_id.startswith("v2:frontend:"), F.get(parts, F.lit(2)))


def resolve_ladder(g: Graph) -> DataFrame:
    """(call_id, via, confidence, target, n_candidates, long): what each call site calls, by the first rung that decides.

    The frontend's target; decided call edges (one exact, several conservative); for C the static
    definition of the same file, then the only external one; the only candidate by name among
    declarations of the same frontend or language, callables preferred; homonyms; possible edges; none.
    Counts and least ids per name are made first, so a hot name never meets all its calls.
    """
    sites = g.nodes.filter(F.col("kind").isin(*schema.CALLSITE_KINDS)).select(F.col("id").alias("call_id"), callee_name(F.col("label")).alias("name"), "file", namespace(F.col("id")).alias("namespace"), "language", prop("primary_target_id").alias("primary"))
    known = g.nodes.select(F.col("id").alias("primary"), F.lit(True).alias("has_primary"))
    e = g.semantic("INVOKES", "CALLS").filter("src is not null and dst is not null")
    sure = e.filter(prop("resolution").isin(*TRUSTED_RESOLUTIONS) | F.lower(F.trim("confidence")).isin(*TRUSTED_CONFIDENCES))
    trusted = sure.groupBy(F.col("src").alias("call_id")).agg(F.countDistinct("dst").alias("n_trusted"), F.min("dst").alias("trusted"))
    possible = g.semantic("MAY_INVOKE", "READS_CALLEE", "CONTEXT_CALLS").filter("src is not null and dst is not null").groupBy(F.col("src").alias("call_id")).agg(F.countDistinct("dst").alias("n_possible"))
    d = durable(declarations(g), "declarations")
    # per name and group (frontend, else language): how many callables, how many others, and the least of each
    is_callable = F.col("kind").isin(*schema.CALLABLE_KINDS)
    group = F.coalesce(F.concat(F.lit("n:"), "namespace"), F.concat(F.lit("l:"), "language"), F.lit("?"))
    counts = lambda df, keys: df.groupBy(*keys).agg(
        F.count_if(is_callable).alias("n_call"), F.min(F.when(is_callable, F.col("node_id"))).alias("a_call"), F.count(F.lit(1)).alias("n_any"), F.min("node_id").alias("a_any"),
        F.count_if(is_callable & ~F.col("declaration_only")).alias("n_def"), F.count_if(is_callable & ~F.col("declaration_only") & (F.coalesce("storage_class", F.lit("")) != "static")).alias("n_ext"),
        F.min(F.when(is_callable & ~F.col("declaration_only") & (F.coalesce("storage_class", F.lit("")) != "static"), F.col("node_id"))).alias("a_ext"),
    )
    named = counts(d.withColumn("grp", group), ["name", "grp"])
    static = d.filter(~F.col("declaration_only") & (F.col("storage_class") == "static") & is_callable).groupBy("name", "file", group.alias("grp")).agg(F.count(F.lit(1)).alias("n_static"), F.min("node_id").alias("a_static"))
    j = sites.withColumn("grp", group).join(known, "primary", "left").join(trusted, "call_id", "left").join(possible, "call_id", "left").join(named, ["name", "grp"], "left").join(static, ["name", "file", "grp"], "left")
    c = F.lower(F.col("file")).rlike(r"\.[ch]$")
    n_cand = F.when(F.col("n_call") > 0, F.col("n_call")).otherwise(F.coalesce("n_any", F.lit(0)))
    a_cand = F.when(F.col("n_call") > 0, F.col("a_call")).otherwise(F.col("a_any"))
    has_name = F.coalesce(F.col("name") != "", F.lit(False))
    rungs = [
        (F.col("has_primary").isNotNull(), "primary-target", "exact", F.col("primary"), F.lit(1)),
        (F.col("n_trusted") == 1, "invokes-edge", "exact", F.col("trusted"), F.lit(1)),
        (F.col("n_trusted") > 1, "invokes-edges", "conservative", None, F.col("n_trusted")),
        (has_name & c & (F.col("n_static") == 1), "static-same-file", "exact", F.col("a_static"), F.lit(1)),
        (has_name & c & (F.col("n_ext") == 1) & (F.col("n_def") <= MANY_CANDIDATES), "sole-definition", "exact", F.col("a_ext"), F.lit(1)),
        (has_name & (n_cand == 1), "sole-candidate", "high", a_cand, F.lit(1)),
        (has_name & (n_cand > 1), "homonyms", "conservative", None, n_cand),
        (F.col("n_possible") > 0, "indirect", "unresolved", None, F.col("n_possible")),
    ]

    def pick(at: int, last):
        out = None
        for r in rungs:
            v = r[at] if not isinstance(r[at], str) else F.lit(r[at])
            v = F.lit(None).cast("string") if v is None else v
            out = F.when(r[0], v) if out is None else out.when(r[0], v)
        return out.otherwise(last)

    n = pick(4, F.lit(0)).cast("long")
    return j.select("call_id", "name", pick(1, F.lit("none")).alias("via"), pick(2, F.lit("unresolved")).alias("confidence"), pick(3, F.lit(None).cast("string")).alias("target"), n.alias("n_candidates"), (n > MANY_CANDIDATES).alias("long"))


def call_candidates(g: Graph, ladder: DataFrame) -> DataFrame:
    """(call_id, candidate): every candidate of the calls that the ladder leaves at homonyms."""
    d = declarations(g)
    group = F.coalesce(F.concat(F.lit("n:"), "namespace"), F.concat(F.lit("l:"), "language"), F.lit("?"))
    d = d.withColumn("grp", group).withColumn("can", F.col("kind").isin(*schema.CALLABLE_KINDS))
    best = d.groupBy("name", "grp").agg(F.max("can").alias("any_call"))
    d = d.join(best, ["name", "grp"]).filter("can or not any_call").select("name", "grp", F.col("node_id").alias("candidate"))
    open_ = ladder.filter("via = 'homonyms'").select("call_id", "name")
    sites = g.nodes.select(F.col("id").alias("call_id"), namespace(F.col("id")).alias("namespace"), "language").withColumn("grp", group).select("call_id", "grp")
    return open_.join(sites, "call_id").join(d, ["name", "grp"]).select("call_id", "candidate")


def call_relations(g: Graph) -> DataFrame:
    """(caller, callee, via, resolved): who calls whom, over direct edges, indirect ones, and what the ladder adds.

    Of several ways that join a pair the direct one counts, else the first of the indirect ones, ``resolved``, ``candidate``.
    """
    decl = durable(navigate.caller_decls(g), "decls")
    labels = {"CALLS": "direct"} | {k: f"indirect({v})" for k, v in schema.INDIRECT_CALLS.items()}
    e = g.semantic(*labels).filter("src is not null and dst is not null").select("src", "dst", schema.semantic_kind().alias("sem"), "kind")
    kind = F.when(F.col("sem").isin(*labels), F.col("sem")).otherwise(F.col("kind"))
    names = list(labels)
    place = F.array_position(F.array(*[F.lit(k) for k in names]), kind).cast("int")
    edge = e.select(F.col("src").alias("id"), F.col("dst").alias("callee"), place.alias("place"))
    ladder = durable(resolve_ladder(g), "ladder")
    decided = ladder.filter("target is not null").select(F.col("call_id").alias("id"), F.col("target").alias("callee"), F.lit(len(names) + 1).alias("place"))
    maybe = call_candidates(g, ladder).select(F.col("call_id").alias("id"), F.col("candidate").alias("callee"), F.lit(len(names) + 2).alias("place"))
    every = edge.unionByName(decided).unionByName(maybe).join(decl, "id").groupBy(F.col("decl").alias("caller"), "callee").agg(F.min("place").alias("place"))
    known = g.nodes.select(F.col("id").alias("callee"), "kind")
    via = F.element_at(F.array(*[F.lit(v) for v in [*labels.values(), "resolved", "candidate"]]), F.col("place"))
    resolved = F.when(F.col("place").isin(1, len(names) + 1), True).when(F.col("place") == len(names) + 2, False).otherwise(F.col("kind").isin(*schema.CALLABLE_KINDS))
    return every.join(known, "callee").select("caller", "callee", via.alias("via"), resolved.alias("resolved"))


def unresolved_callees(g: Graph) -> DataFrame:
    """(caller, call_id, callee, via): call sites that nothing could decide or narrow, as rows of their own."""
    left = resolve_ladder(g).filter("target is null and n_candidates = 0 or via = 'indirect'").filter("via <> 'indirect'")
    decl = navigate.caller_decls(g).withColumnRenamed("id", "call_id")
    return left.join(decl, "call_id").select(F.col("decl").alias("caller"), "call_id", F.col("name").alias("callee"), "via")


def name_entries(g: Graph) -> DataFrame:
    """(node_id, name, kind, file, line, handle, exported, is_test, declaration_only, degree): what search and resolution look at."""
    ext = external_nodes(g).select(F.col("id").alias("node_id"))
    d = declarations(g).join(ext, "node_id", "left_anti")
    j = d.join(degrees(g.edges).withColumnRenamed("id", "node_id"), "node_id", "left").join(exported_ids(g).select(F.col("id").alias("node_id"), F.lit(True).alias("x")), "node_id", "left")
    handle = F.when(F.col("file").isNotNull() & (F.col("line") > 0), F.concat_ws(":", "file", F.col("line").cast("string")))
    return j.select("node_id", "name", "kind", "file", "line", handle.alias("handle"), F.coalesce("x", F.lit(False)).alias("exported"), navigate.is_test_path(F.col("file")).alias("is_test"), "declaration_only", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def resolution_order() -> list[Column]:
    return [kind_rank(F.col("kind")), F.col("declaration_only"), F.desc("degree"), ~F.col("exported"), F.col("is_test"), F.coalesce("file", F.lit("")), F.coalesce("line", F.lit(0)), F.col("node_id")]


def resolve_names(entries: DataFrame) -> DataFrame:
    """(name, node_id, n_hits): what each name resolves to, the first in the order of resolution."""
    w = Window.partitionBy("name")
    return entries.withColumn("place", F.row_number().over(w.orderBy(*resolution_order()))).withColumn("n_hits", F.count(F.lit(1)).over(w)).filter("place = 1").select("name", "node_id", "n_hits")


def name_peers(entries: DataFrame) -> DataFrame:
    """(name, node_id): the declarations of a name that tie for best on kind, body, export and test; degree does not count."""
    what = F.struct(kind_rank(F.col("kind")).alias("a"), F.col("declaration_only").alias("b"), (~F.col("exported")).alias("c"), F.col("is_test").alias("d"))
    best = entries.groupBy("name").agg(F.min(what).alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return entries.withColumn("what", what).join(best, "name").filter(F.col("what") == F.col("best")).select("name", "node_id")


def resolve_handles(entries: DataFrame) -> DataFrame:
    """(handle, node_id): what a ``path:line`` addresses, callables before what stands on the same line."""
    order = [kind_rank(F.col("kind")), F.col("declaration_only"), F.desc("degree"), F.col("is_test"), F.col("node_id")]
    return entries.filter("handle is not null").withColumn("place", F.row_number().over(Window.partitionBy("handle").orderBy(*order))).filter("place = 1").select("handle", "node_id")


def find_handle(entries: DataFrame, handle: str) -> DataFrame:
    """Entries at one ``path:line``; the path may be the end of a file's path. The tightest match comes first."""
    import re

    m = re.fullmatch(r"(?P<path>.+):(?P<line>\d+)", handle.strip())
    if not m:
        return entries.limit(0)
    hit = entries.filter(F.col("file").endswith(m["path"]) & (F.col("line") == int(m["line"])))
    return hit.orderBy(F.col("file") != m["path"], kind_rank(F.col("kind")), "declaration_only", F.desc("degree"), "is_test", "file", "node_id")


def ranked_search(entries: DataFrame, query: str, mode: str = "fuzzy") -> DataFrame:
    """(node_id, name, kind, score) of entries whose name is like the query, and what else the order of search needs."""
    q = query.lower()
    low, tokens = F.lower("name"), navigate.name_tokens(F.col("name"))
    words = navigate.name_tokens(F.lit(query))
    fuzzy = F.when(low == q, 100).when(low.startswith(q), 85).when(F.array_contains(tokens, q), 70).when(low.contains(q), 55).when((F.size(words) > 0) & F.forall(words, lambda w: F.exists(tokens, lambda t: t.contains(w))), 40)
    score = {"exact": F.when(low == q, 100), "prefix": F.when(low.startswith(q), 90)}.get(mode, fuzzy)
    return entries.withColumn("score", score).filter("score is not null")


def search_order() -> list[Column]:
    return [F.desc("score"), kind_rank(F.col("kind")), F.col("declaration_only"), F.desc("degree"), ~F.col("exported"), F.lower("name"), F.coalesce("file", F.lit("")), F.col("node_id")]


class BadCursor(ValueError):
    """A cursor that no page gave out."""


def cursor_page(df: DataFrame, order: list, cursor: str | None, size: int) -> tuple[DataFrame, str | None]:
    """One page of a ranked result from an opaque cursor, and the cursor of the next page; sizes are held between 1 and 200."""
    size = max(1, min(200, size))
    start = 0
    if cursor is not None:
        try:
            version, number = base64.urlsafe_b64decode(cursor.encode()).decode().split(":")
            start = int(number)
        except Exception as e:
            raise BadCursor(cursor) from e
        if version != "v1" or start < 0:
            raise BadCursor(cursor)
    total = df.count()
    ranked = df.orderBy(*order).limit(start + size).withColumn("place", F.row_number().over(Window.orderBy(*order))).filter(F.col("place") > start)
    nxt = base64.urlsafe_b64encode(f"v1:{start + size}".encode()).decode() if start + size < total else None
    return ranked, nxt


# -- sets -----------------------------------------------------------------------------------------
def owner_wins(nodes: DataFrame, owners: DataFrame) -> DataFrame:
    """(id, unit): of the deliveries of a node by several units that of the unit which owns its file, else the least unit.

    ``owners`` are (file, owner).
    """
    j = nodes.filter("id is not null").select("id", "unit", "file").distinct().join(owners, "file", "left")
    return j.groupBy("id").agg(F.min(F.struct(F.coalesce(F.col("unit") != F.col("owner"), F.lit(True)).alias("foreign"), "unit")).alias("x")).select("id", F.col("x.unit").alias("unit"))


def merge_units(g: Graph, owners: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges of the winners of their sources whose ends are there, and per unit how many were left out as dangling."""
    win = durable(owner_wins(nodes, owners), "winners")
    own = edges.join(win.select(F.col("id").alias("src"), F.col("unit").alias("w")), "src", "left").filter(F.col("w").isNull() | (F.col("w") == F.col("unit")))
    there = win.select(F.col("id").alias("dst"), F.lit(True).alias("there"))
    j = durable(own.join(there, "dst", "left"), "merged")
    ok = F.col("w").isNotNull() & F.col("there").isNotNull()
    return j.filter(ok).drop("w", "there"), j.filter(~ok).groupBy("unit").agg(F.count(F.lit(1)).alias("n_dropped"))


def call_differences(g: Graph) -> DataFrame:
    """(caller, callee, side): pairs that only direct edges know, or only call sites by their owners."""
    direct = g.semantic("CALLS").filter("src is not null and dst is not null").join(navigate.caller_decls(g).withColumnRenamed("id", "src"), "src").select(F.col("decl").alias("caller"), F.col("dst").alias("callee")).distinct()
    invoked = g.semantic("INVOKES").filter("src is not null and dst is not null").join(navigate.caller_decls(g).withColumnRenamed("id", "src"), "src").select(F.col("decl").alias("caller"), F.col("dst").alias("callee")).distinct()
    direct, invoked = durable(direct, "direct"), durable(invoked, "invoked")
    left = direct.join(invoked, ["caller", "callee"], "left_anti").withColumn("side", F.lit("calls-only"))
    return left.unionByName(invoked.join(direct, ["caller", "callee"], "left_anti").withColumn("side", F.lit("invokes-only")))


def shared_sinks(g: Graph) -> DataFrame:
    """(sink, n_guarded, n_open): callees that guarded and unguarded functions have in common."""
    guarded = g.semantic("GUARDED_BY").filter("src is not null").select(F.col("src").alias("caller")).distinct().withColumn("has", F.lit(1))
    per = navigate.union_call_pairs(g).join(guarded, "caller", "left").groupBy(F.col("callee").alias("sink")).agg(F.count("has").alias("n_guarded"), F.count_if(F.col("has").isNull()).alias("n_open"))
    return per.filter("n_guarded > 0 and n_open > 0")


def additive_delta(before: Graph, after: Graph) -> DataFrame:
    """(kind, n_nodes, n_edges): what an enriched graph has over its base, by kind."""
    n = after.nodes.join(before.nodes.select("id"), "id", "left_anti").groupBy("kind").agg(F.count(F.lit(1)).alias("n_nodes"), F.lit(0).cast("long").alias("n_edges"))
    key = ["kind", "src", "dst"]
    old = before.edges.select(*[F.col(k).alias(f"o_{k}") for k in key]).distinct()
    same = F.col("kind").eqNullSafe(F.col("o_kind")) & F.col("src").eqNullSafe(F.col("o_src")) & F.col("dst").eqNullSafe(F.col("o_dst"))
    e = after.edges.select(*key).distinct().join(old, same, "left_anti").groupBy("kind").agg(F.lit(0).cast("long").alias("n_nodes"), F.count(F.lit(1)).alias("n_edges"))
    return n.unionByName(e).groupBy("kind").agg(F.sum("n_nodes").alias("n_nodes"), F.sum("n_edges").alias("n_edges"))


def argument_order(g: Graph) -> DataFrame:
    """(call_id, argument_id, place): the arguments of each call in order, counted from one."""
    from weftgraph.operators.reach import arguments

    a = arguments(g).groupBy("call_id", "argument_id").agg(F.min("position").alias("position"))
    w = Window.partitionBy("call_id").orderBy(F.asc_nulls_last("position"), "argument_id")
    return a.select("call_id", "argument_id", F.row_number().over(w).alias("place"))
