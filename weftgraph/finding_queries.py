"""Queries of guards, dominance, candidates and object lifetimes, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import graph
from weftgraph import graph_queries as gq
from weftgraph import planner_queries as pq
from weftgraph.operators import dominance, navigate, objects, rules
from weftgraph.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
_NE, _RNE, _OWNED = gq._NE, gq._RNE, gq._OWNED


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _loaded(spark: SparkSession, d: str) -> graph.Graph:
    return graph.kept(graph.load(spark, d))


def _bindings(spark: SparkSession, d: str, g: graph.Graph) -> DataFrame:
    return rules.model_bindings(g, table(spark, d, "builtin_nodes"))


# What a call is for by its callee's name, the first that fits.
_ROLE = r"""CASE WHEN regexp_matches(name, '(?i)verif|hmac|\bsign|signature|digest|\bhash\b') THEN 'verify' WHEN regexp_matches(name, '(?i)sanit|escap|encod|\bstrip|\bclean|\bquote') THEN 'sanitize'
 WHEN regexp_matches(name, '(?i)authoriz|permission|permit|forbid|\bdeny|\ballow|\bscope|tenant|\bowner\b|\brole|entitl|\bacl\b') THEN 'authz' WHEN regexp_matches(name, '(?i)valid|assert|\bcheck|guard|\btoken|trust|origin|\bcred|secret|\bauth') THEN 'validate' END"""


@query(f"""{gq._GUARDS}, CR AS (SELECT DISTINCT src AS caller, dst AS callee FROM E WHERE (kind = 'CALLS' OR sem = 'CALLS') AND src IS NOT NULL AND dst IS NOT NULL), CX AS (SELECT caller, callee, coalesce(label, '') AS name FROM CR JOIN N ON N.id = callee),
 CY AS (SELECT caller, callee, {_ROLE} AS named, CASE WHEN G.class IN ('guard','validate') THEN 'validate' END AS shaped FROM CX LEFT JOIN G ON G.owner_id = callee)
 SELECT caller, callee, coalesce(named, shaped, 'none') AS role, CASE WHEN named IS NOT NULL THEN 'name' WHEN shaped IS NOT NULL THEN 'callee-shape' ELSE 'none' END AS origin FROM CY""")
def call_roles(spark: SparkSession, d: str) -> DataFrame:
    return dominance.call_roles(_loaded(spark, d))


_GSITES = f"GS0 AS (SELECT DISTINCT e.src AS site_id, e.dst AS callee, coalesce(n.label, '') AS name FROM E e JOIN N c ON c.id = e.src JOIN N n ON n.id = e.dst WHERE (e.kind IN ('CALLS','INVOKES') OR sem IN ('CALLS','INVOKES')) AND c.kind IN ('call','construct')), GS1 AS (SELECT DISTINCT site_id FROM GS0 WHERE {_ROLE} IS NOT NULL)"


@query(f"""{_RNE}, {_OWNED}, {_GSITES}, OFS AS (SELECT id, min(start_offset) AS a, min(end_offset) AS b FROM (SELECT id, start_offset, end_offset FROM nodes UNION ALL SELECT id, start_offset, end_offset FROM builtin_nodes) GROUP BY id),
 SP AS (SELECT N.id AS site_id, O.callable_id AS host, coalesce(absolute_file, file) AS file, a, b, N.kind FROM N JOIN O ON O.id = N.id JOIN OFS ON OFS.id = N.id),
 GP AS (SELECT SP.* FROM SP JOIN GS1 USING (site_id)), RG AS (SELECT DISTINCT SP.host, SP.file, SP.a, SP.b FROM SP JOIN E ON E.dst = SP.site_id WHERE sem IN ('TRUE_BRANCH','FALSE_BRANCH','LOOP_TRUE','SWITCH_CASE','EXCEPTION_BRANCH','SHORT_CIRCUIT_RIGHT')),
 GR AS (SELECT g.*, coalesce((SELECT arg_min(r.b, r.b - r.a) FROM RG r WHERE r.host = g.host AND r.file = g.file AND r.a <= g.a AND g.b <= r.b), 9223372036854775807) AS reach FROM GP g)
 SELECT s.site_id, s.host, CASE WHEN s.a IS NULL OR s.b IS NULL OR s.file IS NULL THEN 'undecided' WHEN EXISTS (SELECT 1 FROM GR g WHERE g.host = s.host AND g.file = s.file AND g.a < s.a AND g.reach >= s.b) THEN 'dominates' ELSE 'skippable' END AS state, (SELECT count(*) FROM GP g WHERE g.host = s.host) AS n_guards
 FROM SP s WHERE s.kind IN ('call','construct') AND s.host IN (SELECT host FROM GP)""")
def guarded_steps(spark: SparkSession, d: str) -> DataFrame:
    """Whether a call that checks something comes before every other call of its function on all ways."""
    g = _loaded(spark, d)
    calls = g.nodes.filter(F.col("kind").isin("call", "construct")).select(F.col("id").alias("site_id"))
    named = dominance.recognitions(g).filter("recognition = 'named'").select("site_id")
    return dominance.guarded_steps(g, named, calls)


@query()
def guard_recognitions(spark: SparkSession, d: str) -> DataFrame:
    """Guards that functions call, why they are taken for such, and which of them authorize."""
    return dominance.recognitions(_loaded(spark, d))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    g = _loaded(spark, d)
    effects = _bindings(spark, d, g).filter("effect <> 'none'").select(F.col("call_id").alias("site_id"), F.col("effect").alias("effect_kind"))
    guards = dominance.recognitions(g).select("site_id").distinct()
    return dominance.candidates(g, navigate.entry_points(g), effects, guards)


@query()
def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Every entry that reaches a call with an effect, whether a guard is proven on the way, and its rank."""
    return _candidates(spark, d)


@query()
def candidate_census(spark: SparkSession, d: str) -> DataFrame:
    return dominance.candidate_census(_candidates(spark, d))


# Events of variables: what calls do to their first argument, by the model that they are bound to.
_EVENTS = f"""{_RNE}, {_OWNED}, {pq._BIND}, HA AS (SELECT src AS call_id, dst AS argument_id, min(position) AS p FROM E WHERE (kind = 'HAS_ARGUMENT' OR sem = 'HAS_ARGUMENT') AND src IS NOT NULL AND dst IS NOT NULL GROUP BY 1, 2),
 FA AS (SELECT call_id, arg_min(argument_id, {{'p': coalesce(p, 1099511627776), 'a': argument_id}}) AS argument_id FROM HA GROUP BY 1), ME AS (SELECT call_id, min(effect) AS event FROM M WHERE effect IN ('alloc','free','use') GROUP BY 1),
 OFS AS (SELECT id, min(start_offset) AS a FROM (SELECT id, start_offset FROM nodes UNION ALL SELECT id, start_offset FROM builtin_nodes) GROUP BY id),
 EV AS (SELECT O.callable_id AS function, v.label AS variable, coalesce(OFS.a, 0) AS place, c.id AS call_id, coalesce(ME.event, 'escape') AS event FROM N c JOIN O ON O.id = c.id JOIN OFS ON OFS.id = c.id JOIN FA ON FA.call_id = c.id JOIN N v ON v.id = FA.argument_id LEFT JOIN ME ON ME.call_id = c.id WHERE c.kind IN ('call','construct') AND v.label IS NOT NULL)"""


@query(f"{_EVENTS} SELECT function, variable, place AS \"at\", call_id, event FROM EV")
def variable_events(spark: SparkSession, d: str) -> DataFrame:
    """What calls do to the variables of each function."""
    g = _loaded(spark, d)
    return objects.variable_events(g, _bindings(spark, d, g))


@query(f"{_EVENTS} SELECT function, variable FROM EV GROUP BY 1, 2 HAVING count(*) FILTER (WHERE event = 'alloc') > 0 AND count(*) FILTER (WHERE event IN ('free','escape')) = 0")
def leaks(spark: SparkSession, d: str) -> DataFrame:
    """Variables allocated, never freed, never let go."""
    return objects.leaks(variable_events(spark, d))


@query(f"""{_EVENTS}, EL AS (SELECT *, count(*) FILTER (WHERE event = 'alloc') OVER (PARTITION BY function, variable ORDER BY place, call_id ROWS UNBOUNDED PRECEDING) AS life FROM EV),
 EF AS (SELECT *, coalesce(bool_or(event = 'free') OVER (PARTITION BY function, variable, life ORDER BY place, call_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS freed FROM EL)
 SELECT function, variable, call_id, CASE WHEN event = 'free' THEN 'double-free' ELSE 'use-after-free' END AS finding FROM EF WHERE freed AND event IN ('free','use')""")
def misuses(spark: SparkSession, d: str) -> DataFrame:
    """Variables freed again, or used after they were freed."""
    return objects.misuses(variable_events(spark, d))


@query(f"""{_RNE}, {pq._BIND}, PA AS (SELECT id, owner_function_id AS function, coalesce(json_extract_string(props, '$.parameter_position')::BIGINT, 0) AS position FROM N WHERE kind = 'parameter' AND owner_function_id IS NOT NULL),
 HA AS (SELECT src AS call_id, dst AS argument_id, min(position) AS p FROM E WHERE (kind = 'HAS_ARGUMENT' OR sem = 'HAS_ARGUMENT') AND src IS NOT NULL AND dst IS NOT NULL GROUP BY 1, 2), HD AS (SELECT DISTINCT call_id, coalesce(p, 0) AS given, function, position FROM HA JOIN PA ON PA.id = argument_id),
 TG AS (SELECT DISTINCT src AS call_id, dst AS target FROM E WHERE (kind IN ('INVOKES','CALLS') OR sem IN ('INVOKES','CALLS')) AND src IS NOT NULL AND dst IS NOT NULL), HO AS (SELECT DISTINCT target, given, function AS up, position AS up_position FROM HD JOIN TG USING (call_id)),
 PS(function, position, effect) AS (SELECT function, position, effect FROM HD JOIN M USING (call_id) WHERE given = 0 AND effect IN ('alloc','free','use') UNION SELECT h.up, h.up_position, s.effect FROM PS s JOIN HO h ON h.target = s.function AND h.given = s.position) SELECT DISTINCT function, position, effect FROM PS""")
def parameter_summaries(spark: SparkSession, d: str) -> DataFrame:
    """What functions do to their parameters, themselves or through the functions they call."""
    g = _loaded(spark, d)
    return objects.parameter_summaries(g, _bindings(spark, d, g)).select("function", "position", "effect")


@query(f"""{_EVENTS}, {gq._UNION_PAIRS}, BO AS (SELECT caller AS a, callee AS b FROM UP UNION SELECT callee, caller FROM UP), LS(id) AS (SELECT DISTINCT function FROM EV WHERE event <> 'use' UNION SELECT BO.b FROM LS JOIN BO ON BO.a = LS.id) SELECT id FROM LS""")
def lifetime_slice(spark: SparkSession, d: str) -> DataFrame:
    """Functions that calls connect with one in which an object lives or dies."""
    g = _loaded(spark, d)
    return objects.lifetime_slice(g, _bindings(spark, d, g))


@query()
def object_findings(spark: SparkSession, d: str) -> DataFrame:
    """Double frees and uses after a free along the control flow, aliases and branches told apart."""
    g = _loaded(spark, d)
    return objects.object_states(*objects.graph_operations(g, _bindings(spark, d, g)))


def _copies(spark: SparkSession, d: str, g: graph.Graph) -> DataFrame:
    """Calls of the runtime's copy with their destination (first argument) and size (last of three and more)."""
    from weftgraph.operators.access import argument_order

    calls = _bindings(spark, d, g).filter("model = 'buf_copy'").select("call_id").distinct()
    args = argument_order(g).join(calls, "call_id", "left_semi").join(g.nodes.select(F.col("id").alias("argument_id"), "label", "type"), "argument_id")
    per = args.groupBy("call_id").agg(F.max("place").alias("n"), F.min_by("label", "place").alias("destination"), F.min_by("type", "place").alias("type"), F.max_by("label", "place").alias("last"))
    per = per.join(g.nodes.select(F.col("id").alias("call_id"), "confidence"), "call_id")
    return per.select("call_id", F.when(F.col("n") >= 3, F.col("last")).alias("size"), (F.col("n") >= 3).alias("has_size"), "destination", "type", "confidence")


@query()
def copy_capacity(spark: SparkSession, d: str) -> DataFrame:
    """Every call of the runtime's copy, how its size and place are spelled, and whether it is known to fit."""
    from weftgraph.operators.copies import copy_capacity

    return copy_capacity(_copies(spark, d, _loaded(spark, d)))


@query(f"""{_NE}, TY AS (SELECT id, min(type) AS type FROM (SELECT id, type FROM nodes UNION ALL SELECT id, type FROM builtin_nodes) GROUP BY id), TP AS (SELECT DISTINCT lower(TY.type) AS type, owner_function_id AS function FROM N JOIN TY ON TY.id = N.id WHERE kind = 'parameter' AND TY.type IS NOT NULL AND owner_function_id IS NOT NULL),
 WR AS (SELECT DISTINCT src AS id FROM E WHERE sem IN ('WRITES_TO','WRITES_PARAMETER_PROPERTY','MUTATES') AND src IS NOT NULL), CH AS (SELECT id AS function FROM WR UNION SELECT owner_function_id FROM N WHERE kind = 'write' AND owner_function_id IS NOT NULL UNION SELECT owner_function_id FROM N JOIN WR ON WR.id = N.id WHERE owner_function_id IS NOT NULL)
 SELECT type, function, CASE WHEN kind = 'constructor' OR lower(label) IN ('__init__','new','create') THEN 'constructor' WHEN regexp_matches(lower(label), 'free|destroy|dispose|close|release') THEN 'destructor' WHEN function IN (SELECT function FROM CH) THEN 'mutator' ELSE 'consumer' END AS role FROM TP JOIN N ON N.id = function WHERE kind IN ('function','method','constructor')""")
def type_roles(spark: SparkSession, d: str) -> DataFrame:
    """What functions are to the types of their parameters."""
    from weftgraph.operators.copies import type_roles

    g = _loaded(spark, d)
    return type_roles(g.nodes, g.edges)
