"""Guards and what they protect: recognition, dominance inside a function, verdicts from entry to effect, ranks, the candidate list.

Defined cases: sites without a span are undecided; a guard that starts where the step starts does
not come before it; repeated sites count once; functions without guards or steps give no rows;
empty graphs give none. Spans are half open offsets in one file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph import schema
from weftgraph.graph import Graph
from weftgraph.operators import access, lifetime, navigate
from weftgraph.operators.reach import paths, prop
from weftgraph.plans.durable import durable
from weftgraph.plans.fixpoint import fixpoint

# What a call is for, by its name, the first that fits.
CALL_ROLES = (
    ("verify", r"(?i)verif|hmac|\bsign|signature|digest|\bhash\b"),
    ("sanitize", r"(?i)sanit|escap|encod|\bstrip|\bclean|\bquote"),
    ("authz", r"(?i)authoriz|permission|permit|forbid|\bdeny|\ballow|\bscope|tenant|\bowner\b|\brole|entitl|\bacl\b"),
    ("validate", r"(?i)valid|assert|\bcheck|guard|\btoken|trust|origin|\bcred|secret|\bauth"),
)
# What a verification must name to be one of the caller; words that name a permission.
AUTHENTICATION_OBJECTS = tuple("signature signatures hmac token tokens credential credentials password secret secrets session jwt otp challenge certificate cert nonce key keys".split())
PERMISSION_TOKENS = tuple("permission permissions authz authorization acl role roles scope scopes entitlement entitlements privilege privileges".split())
# Edges to what runs only under a condition.
CONDITIONAL_REGIONS = ("TRUE_BRANCH", "FALSE_BRANCH", "LOOP_TRUE", "SWITCH_CASE", "EXCEPTION_BRANCH", "SHORT_CIRCUIT_RIGHT")
#: Steps up the syntax from a call to the condition that tests it.
CONSUMPTION_HOPS = 5
#: Calls from an entry to an effect.
CALL_DEPTH = 6


def role_of_name(name: Column) -> Column:
    out = None
    for role, pattern in CALL_ROLES:
        out = F.when(name.rlike(pattern), role) if out is None else out.when(name.rlike(pattern), role)
    return out


def call_roles(g: Graph) -> DataFrame:
    """(caller, callee, role, origin): what each direct call is for, by the callee's name, else by the callee guarding itself."""
    calls = g.semantic("CALLS").filter("src is not null and dst is not null").select(F.col("src").alias("caller"), F.col("dst").alias("callee")).distinct()
    j = calls.join(g.nodes.select(F.col("id").alias("callee"), F.coalesce("label", F.lit("")).alias("name")), "callee").withColumn("named", role_of_name(F.col("name")))
    shaped = navigate.guard_profile(g).filter(F.col("class").isin("guard", "validate")).select(F.col("owner_id").alias("callee"), F.lit("validate").alias("shaped"))
    j = j.join(shaped, "callee", "left")
    origin = F.when(F.col("named").isNotNull(), "name").when(F.col("shaped").isNotNull(), "callee-shape").otherwise("none")
    return j.select("caller", "callee", F.coalesce("named", "shaped", F.lit("none")).alias("role"), origin.alias("origin"))


def authorizes(role: Column, name: Column) -> Column:
    """Whether a guard answers that the caller may be here: authorization does, a verification if it names what authenticates."""
    named = F.arrays_overlap(navigate.name_tokens(name), F.array(*[F.lit(t) for t in AUTHENTICATION_OBJECTS]))
    return F.coalesce((role == "authz") | ((role == "verify") & named), F.lit(False))


def acted_on(g: Graph, sites: DataFrame) -> DataFrame:
    """(site_id): calls whose result a condition tests, within a few steps up the syntax, over a write and a read of it if need be."""
    tested = g.semantic("CONDITION").select(F.col("dst").alias("node")).unionByName(g.semantic("SHORT_CIRCUIT_LEFT", "SHORT_CIRCUIT_RIGHT").select(F.explode(F.array("src", "dst")).alias("node"))).filter("node is not null").distinct()
    tested = durable(tested, "tested")
    up = g.semantic("AST_CHILD", "EXPANDS_TO").filter("src is not null and dst is not null").select(F.col("dst").alias("a"), F.col("src").alias("b"))
    back = g.nodes.filter("kind = 'write'").select(prop("value_id").alias("a"), prop("target_id").alias("t")).join(g.nodes.filter("kind = 'read'").select(F.col("id").alias("b"), prop("target_id").alias("t")), "t").select("a", "b").filter("a is not null")
    links = durable(up.unionByName(back).distinct(), "consumption")
    found, _ = fixpoint(sites.select("site_id", F.col("site_id").alias("node")).distinct(), lambda f: f.join(links, f["node"] == links["a"]).select("site_id", F.col("b").alias("node")), ["site_id", "node"], CONSUMPTION_HOPS)
    return found.join(tested, "node", "left_semi").select("site_id").distinct()


def recognitions(g: Graph) -> DataFrame:
    """(host, site_id, callee, recognition, role, suppresses): guards that functions call, by name, else by the callee's shape; and what a registration declares.

    Only a guard that authorizes and is acted on, by a condition or because its callee throws, suppresses.
    """
    own = durable(navigate.owner_callables(g), "owners")
    e = g.semantic("CALLS", "INVOKES").filter("src is not null and dst is not null").select(F.col("src").alias("site_id"), F.col("dst").alias("callee")).distinct()
    e = e.join(g.nodes.filter(F.col("kind").isin(*schema.CALLSITE_KINDS)).select(F.col("id").alias("site_id")), "site_id", "left_semi").join(own.select(F.col("id").alias("site_id"), F.col("callable_id").alias("host")), "site_id")
    e = e.join(g.nodes.select(F.col("id").alias("callee"), F.coalesce("label", F.lit("")).alias("name")), "callee").withColumn("named", role_of_name(F.col("name")))
    profile = navigate.guard_profile(g).select(F.col("owner_id").alias("callee"), F.col("class"), (F.col("throws") > 0).alias("throws"))
    e = durable(e.join(profile, "callee", "left").filter("named is not null or class = 'guard'"), "guard-calls")
    used = acted_on(g, e.filter("named is not null").select("site_id")).withColumn("used", F.lit(True))
    j = e.join(used, "site_id", "left")
    enforced = F.coalesce(F.col("throws"), F.lit(False)) | F.coalesce(F.col("used"), F.lit(False))
    made = j.select("host", "site_id", "callee", F.when(F.col("named").isNotNull(), "named").otherwise("structural").alias("recognition"), F.coalesce("named", F.lit("validate")).alias("role"), (authorizes(F.col("named"), F.col("name")) & enforced).alias("suppresses"))
    # what stands in the arguments of a registration may rank, never suppress: the value of the key is not seen
    back = g.semantic(*schema.CALLBACK_EDGES, "PASSES_CALLBACK").filter("src is not null and dst is not null").select(F.col("src").alias("a"), F.col("dst").alias("host")).distinct()
    args = g.nodes.filter("kind = 'argument'").select(F.col("id").alias("a"), prop("callsite_id").alias("site_id"), F.coalesce("label", F.lit("")).alias("name"))
    words = navigate.name_tokens(F.col("name"))
    says = F.arrays_overlap(words, F.array(*[F.lit(t) for t in PERMISSION_TOKENS])) | (F.array_contains(words, "auth") & F.array_contains(words, "required"))
    declared = args.filter(says).select("site_id", F.col("a").alias("callee")).distinct()
    at_call = back.join(args.select("a", "site_id"), "a").select("host", "site_id").unionByName(back.select("host", F.col("a").alias("site_id"))).distinct()
    return made.unionByName(at_call.join(declared, "site_id").select("host", "site_id", "callee", F.lit("declarative").alias("recognition"), F.lit("authz").alias("role"), F.lit(False).alias("suppresses")))


def spans(g: Graph, sites: DataFrame) -> DataFrame:
    """(site_id, host, file, a, b): where sites stand, in the callable that they belong to."""
    own = navigate.owner_callables(g)
    n = g.nodes.select(F.col("id").alias("site_id"), F.coalesce("absolute_file", "file").alias("file"), F.col("start_offset").alias("a"), F.col("end_offset").alias("b"))
    return sites.select("site_id").distinct().join(n, "site_id").join(own.select(F.col("id").alias("site_id"), F.col("callable_id").alias("host")), "site_id")


def guarded_steps(g: Graph, guards: DataFrame, steps: DataFrame) -> DataFrame:
    """(site_id, host, state, n_guards): whether a guard (site_id) of its function dominates each step (site_id).

    A guard protects what comes behind it up to the end of the innermost conditional region that it
    stands in, since what is outside can be reached around it. So each guard is an interval, and one
    sweep over a function's sites with the furthest end so far answers for all steps.
    """
    gs, ss = durable(spans(g, guards), "guard-spans"), durable(spans(g, steps), "step-spans")
    region = g.semantic(*CONDITIONAL_REGIONS).filter("dst is not null").select(F.col("dst").alias("site_id")).distinct()
    rs = spans(g, region).filter("a is not null and b is not null").select("host", "file", F.col("a").alias("ra"), F.col("b").alias("rb"))
    placed = gs.filter("a is not null and b is not null and file is not null")
    inside = placed.join(rs, ["host", "file"]).filter("ra <= a and b <= rb").groupBy("site_id").agg(F.min_by("rb", F.col("rb") - F.col("ra")).alias("reach"))
    placed = placed.join(inside, "site_id", "left").withColumn("reach", F.coalesce("reach", F.lit((1 << 63) - 1)))
    rows = placed.select("host", "file", "a", F.lit(1).alias("late"), "reach", F.lit(None).cast("string").alias("site_id"), F.lit(None).cast("long").alias("b")).unionByName(
        ss.filter("a is not null and b is not null and file is not null").select("host", "file", "a", F.lit(0).alias("late"), F.lit(None).cast("long").alias("reach"), "site_id", "b")
    )
    w = Window.partitionBy("host", "file").orderBy("a", "late").rowsBetween(Window.unboundedPreceding, -1)
    swept = rows.withColumn("furthest", F.max("reach").over(w)).filter("site_id is not null").select("site_id", (F.coalesce("furthest", F.lit(-1)) >= F.col("b")).alias("dominated"))
    count = gs.groupBy("host").agg(F.count(F.lit(1)).alias("n_guards"))
    j = ss.select("site_id", "host").join(swept, "site_id", "left").join(count, "host")
    return j.select("site_id", "host", F.when(F.col("dominated").isNull(), "undecided").when(F.col("dominated"), "dominates").otherwise("skippable").alias("state"), "n_guards")


def verdicts(g: Graph, entries: DataFrame, effects: DataFrame, guards: DataFrame, depth: int = CALL_DEPTH, budget: int | None = None) -> DataFrame:
    """(entry, effect, state, completeness, hops, path, n_guards): for each entry (id) and each function with an effect (site_id) within reach, whether a guard is proven on the way.

    The way is the least of the shortest ones. It is preserved if in one of its functions every call
    to the next one is dominated, or at its end every effect. Indirect calls on it make it partial, a
    budget that ran out opaque.
    """
    decl = navigate.caller_decls(g)
    e = g.semantic(*schema.DIRECT_CALLS, *schema.INDIRECT_CALLS).filter("src is not null and dst is not null").select(F.col("src").alias("site_id"), F.col("dst").alias("b"), (schema.semantic_kind() == "CALLS").alias("direct"))
    e = durable(e.join(decl.select(F.col("id").alias("site_id"), F.col("decl").alias("a")), "site_id"), "call-sites")
    links = e.groupBy("a", "b").agg(F.max("direct").alias("direct"))
    sites = e.filter("site_id <> a").select("site_id", "a", "b").distinct()
    effect_sites = durable(effects.select("site_id").distinct(), "effect-sites")
    steps = guarded_steps(g, guards, sites.select("site_id").unionByName(effect_sites))
    steps = durable(steps, "steps")
    state = sites.join(steps.select("site_id", "state"), "site_id", "left").groupBy("a", "b").agg(F.bool_and(F.coalesce(F.col("state") == "dominates", F.lit(False))).alias("guarded"))
    at_end = effect_sites.join(decl.select(F.col("id").alias("site_id"), F.col("decl").alias("effect")), "site_id").join(steps.select("site_id", "state"), "site_id", "left")
    at_end = durable(at_end.groupBy("effect").agg(F.bool_and(F.coalesce(F.col("state") == "dominates", F.lit(False))).alias("end_guarded")), "effects")
    found, cut = paths(entries, links.select("a", "b"), depth, budget=budget)
    hits = durable(found.join(at_end.withColumnRenamed("effect", "node"), "node"), "hits")
    hop = hits.filter("distance > 0").select("seed", "node", F.explode(F.expr("transform(sequence(1, size(path) - 1), i -> struct(path[i - 1] as a, path[i] as b))")).alias("x")).select("seed", "node", "x.a", "x.b")
    along = hop.join(links, ["a", "b"]).join(state, ["a", "b"], "left").groupBy("seed", "node").agg(F.bool_or(F.coalesce("guarded", F.lit(False))).alias("way_guarded"), F.bool_and("direct").alias("all_direct"))
    on = hits.select("seed", "node", F.explode("path").alias("host")).join(guards.join(navigate.owner_callables(g).withColumnRenamed("id", "site_id"), "site_id").groupBy(F.col("callable_id").alias("host")).agg(F.count(F.lit(1)).alias("k")), "host").groupBy("seed", "node").agg(F.sum("k").alias("n_guards"))
    j = hits.join(along, ["seed", "node"], "left").join(on, ["seed", "node"], "left")
    preserved = F.coalesce(F.col("way_guarded"), F.lit(False)) | F.col("end_guarded")
    completeness = F.when(F.lit(cut), "OPAQUE").when(F.coalesce(F.col("all_direct"), F.lit(True)), "DETERMINISTIC").otherwise("PARTIAL")
    return j.select(F.col("seed").alias("entry"), F.col("node").alias("effect"), F.when(preserved, "PROVEN_PRESERVED").otherwise("UNPROVEN").alias("state"), completeness.alias("completeness"), F.col("distance").alias("hops"), "path", F.coalesce("n_guards", F.lit(0)).cast("long").alias("n_guards"))


# How bad an effect is, how directly input comes in, how far evidence is trusted, and what each term weighs.
SEVERITY = {"dynamic-code": 1.0, "process": 0.95, "deserialize": 0.8, "database": 0.7, "filesystem-write": 0.7, "network": 0.5, "filesystem-read": 0.35, "response": 0.2}
DIRECTNESS = {"request-input": 1.0, "route-handler-parameter": 0.9, "resource-identifier": 0.75, "boundary-parameter": 0.5}
COMPLETENESS = {"DETERMINISTIC": 1.0, "RESOLVED": 0.9, "PARTIAL": 0.75, "CONFLICTING": 0.6, "OPAQUE": 0.5}
PROVENANCE = {"STATIC_PROVEN": 1.0, "RUNTIME_OBSERVED": 1.0, "AGENT_INFERRED": 0.8}
WEIGHTS = {"sink_severity": 0.30, "input_directness": 0.25, "guard_absence": 0.25, "differential": 0.12, "path_directness": 0.08}


def _of(value: Column, table: dict[str, float], other: float) -> Column:
    out = F.lit(None).cast("double")
    for k, v in table.items():
        out = F.when(value == k, v).otherwise(out)
    return F.coalesce(out, F.lit(other))


def ranks(found: DataFrame) -> DataFrame:
    """``found`` (effect_kind, input_kind, dominated, n_guards, has_peer, hops, completeness, provenance, ...) with its five terms weighed into ``rank``."""
    terms = {
        "sink_severity": _of(F.col("effect_kind"), SEVERITY, 0.4),
        "input_directness": F.when(F.col("input_kind").isNull(), 0.25).otherwise(_of(F.col("input_kind"), DIRECTNESS, 0.4)),
        "guard_absence": F.when(F.col("dominated"), 0.0).when(F.col("n_guards") > 0, 0.55).otherwise(1.0),
        "differential": F.when(F.col("has_peer"), 0.85).otherwise(0.25),
        "path_directness": F.greatest(F.lit(0.2), 1.0 - 0.12 * F.greatest(F.col("hops"), F.lit(0))),
    }
    trust = F.least(F.lit(1.0), F.greatest(F.lit(0.3), _of(F.col("completeness"), COMPLETENESS, 0.5) * _of(F.col("provenance"), PROVENANCE, 0.8)))
    base = None
    for name, value in terms.items():
        base = value * WEIGHTS[name] if base is None else base + value * WEIGHTS[name]
    return found.withColumn("rank", F.round(base * trust, 4))


def candidates(g: Graph, entries: DataFrame, effects: DataFrame, guards: DataFrame, depth: int = CALL_DEPTH) -> DataFrame:
    """(id, family, entry, effect, effect_kind, state, completeness, hops, n_guards, has_peer, rank): every entry that reaches an effect, guarded or not, ranked.

    ``effects`` are (site_id, effect_kind). A peer is another entry whose way to the same effect is preserved.
    """
    decl = navigate.caller_decls(g)
    kind = effects.join(decl.select(F.col("id").alias("site_id"), F.col("decl").alias("effect")), "site_id").groupBy("effect").agg(F.min("effect_kind").alias("effect_kind"))
    v = durable(verdicts(g, entries, effects, guards, depth), "verdicts")
    peers = v.filter("state = 'PROVEN_PRESERVED'").groupBy("effect").agg(F.count(F.lit(1)).alias("n_kept"))
    source = g.nodes.filter("kind = 'source'").groupBy(prop("function_id").alias("entry")).agg(F.max_by(prop("source_kind"), _of(prop("source_kind"), DIRECTNESS, 0.4)).alias("input_kind"))
    kept = F.col("state") == "PROVEN_PRESERVED"
    j = v.join(kind, "effect").join(peers, "effect", "left").join(source, "entry", "left").withColumn("has_peer", F.coalesce(F.col("n_kept"), F.lit(0)) - kept.cast("int") > 0)
    j = j.withColumn("dominated", kept).withColumn("provenance", F.lit("STATIC_PROVEN")).withColumn("family", F.lit("GUARD_DIFFERENTIAL")).withColumn("id", lifetime.capsule_id(F.col("family"), F.col("entry"), F.col("effect")))
    return ranks(j).select("id", "family", "entry", "effect", "effect_kind", "state", "completeness", "hops", "n_guards", "has_peer", "rank")


def registry_page(found: DataFrame, families: list[str] | None, cursor: str | None, size: int, detail: str = "brief") -> tuple[DataFrame, str | None]:
    """A page of the candidate list, the highest ranks first, in one of the tiers brief, compact and full, and the next cursor."""
    if families:
        found = found.filter(F.col("family").isin(*families))
    columns = {"brief": ["id", "family", "rank"], "compact": ["id", "family", "entry", "effect", "state", "rank"]}.get(detail, found.columns)
    page, nxt = access.cursor_page(found, [F.desc("rank"), F.col("id")], cursor, size)
    return page.select(*columns, "place"), nxt


def candidate_census(found: DataFrame) -> DataFrame:
    """(family, state, completeness, n): how many candidates there are of each kind."""
    return found.groupBy("family", "state", "completeness").agg(F.count(F.lit(1)).alias("n"))
