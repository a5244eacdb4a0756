"""Queries of the derivation rules and of the fold, and their SQL, with the fixed patterns as literals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import graph
from weftgraph import access_queries as aq
from weftgraph import graph_queries as gq
from weftgraph.operators import overlays, reach
from weftgraph.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
_N, _NE, _RNE = gq._N, gq._NE, gq._RNE


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _exported(spark: SparkSession, d: str) -> graph.Graph:
    """The graph, with what the files' records export."""
    return overlays.with_exports(graph.kept(graph.load(spark, d)), table(spark, d, "files"))


_LAST = aq._LAST


@query(f"""{_NE}, CB AS (SELECT id, coalesce(json_extract_string(props, '$.name'), {_LAST.format(x="coalesce(label, '')")}) AS name FROM N WHERE kind IN ('function','method','constructor')),
 DI AS (SELECT DISTINCT src FROM E WHERE kind IN ('INVOKES','MAY_INVOKE') AND src IS NOT NULL AND dst IS NOT NULL),
 OP AS (SELECT id AS call_id, coalesce(json_extract_string(props, '$.method_name'), {_LAST.format(x="coalesce(json_extract_string(props, '$.callee'), label, '')")}) AS name FROM N WHERE kind IN ('call','construct') AND json_extract_string(props, '$.primary_target_id') IS NULL AND id NOT IN (SELECT src FROM DI)),
 NM AS (SELECT name, count(*) AS n FROM CB WHERE name <> '' GROUP BY 1)
 SELECT call_id AS src, CB.id AS dst, CASE WHEN n = 1 THEN 'name-fallback' ELSE 'name-fallback-polymorphic' END AS reason FROM OP JOIN NM USING (name) JOIN CB USING (name) WHERE call_id <> CB.id""")
def dispatch_edges(spark: SparkSession, d: str) -> DataFrame:
    """Possible calls that dispatch adds; where the tables hold no overrides, callbacks or function values, those by name."""
    e = overlays.dispatch(graph.load(spark, d)).edges.filter("src <> dst")
    return e.groupBy("src", "dst").agg(F.min("reason").alias("reason"))


@query(f"""{_RNE}, OD AS (SELECT DISTINCT CASE WHEN sem = 'IMPLEMENTED_BY' THEN src ELSE dst END AS base, CASE WHEN sem = 'IMPLEMENTED_BY' THEN dst ELSE src END AS impl FROM E WHERE sem IN ('OVERRIDES','IMPLEMENTS_MEMBER','IMPLEMENTED_BY')),
 OC AS (SELECT base, impl FROM OD JOIN N a ON a.id = base JOIN N b ON b.id = impl WHERE a.kind IN ('function','method','constructor') AND b.kind IN ('function','method','constructor')),
 OX(base, impl) AS (SELECT base, impl FROM OC UNION SELECT x.base, c.impl FROM OX x JOIN OC c ON c.base = x.impl) SELECT base, impl AS implementation FROM OX""")
def override_closure(spark: SparkSession, d: str) -> DataFrame:
    return overlays.override_closure(graph.load(spark, d))


@query(f"""{_RNE}, IL AS (SELECT src AS a, dst AS b FROM E WHERE src IS NOT NULL AND dst IS NOT NULL AND (sem IN ('ALIASES','ALIASES_VALUE','READS_FROM','PHI_INPUT') OR sem = 'VALUE_FLOWS_TO' AND reason IN ('initializer','assignment','write','read','read-value','argument-value','call-result','context-call-result','branch-reaching-definition','phi-input'))
 UNION SELECT dst, src FROM E WHERE sem = 'DEFINES' AND src IS NOT NULL AND dst IS NOT NULL),
 CV(value, callable) AS (SELECT id, id FROM N WHERE kind IN ('function','method','constructor') UNION SELECT dst, src FROM E WHERE (kind = 'FUNCTION_VALUE' OR sem = 'FUNCTION_VALUE') AND src IS NOT NULL AND dst IS NOT NULL UNION SELECT i.b, c.callable FROM CV c JOIN IL i ON i.a = c.value) SELECT DISTINCT value, callable FROM CV""")
def callable_values(spark: SparkSession, d: str) -> DataFrame:
    """Which callables each value may be."""
    return overlays.callable_values(graph.load(spark, d))


@query(f"{_NE}, CT AS (SELECT DISTINCT e.src, e.dst FROM E e JOIN N t ON t.id = e.dst WHERE e.kind IN ('INVOKES','MAY_INVOKE')) SELECT N.id AS call_id, CT.dst AS target FROM N LEFT JOIN CT ON CT.src = N.id WHERE kind IN ('call','construct')")
def context_targets(spark: SparkSession, d: str) -> DataFrame:
    """The contexts of every call: one per target, one without for calls that have none."""
    made = overlays.contexts(graph.load(spark, d)).nodes.filter("kind = 'call-context'")
    return made.select(F.get_json_object("props", "$.callsite_id").alias("call_id"), F.get_json_object("props", "$.callee_function_id").alias("target"))


@query()
def phi_facts(spark: SparkSession, d: str) -> DataFrame:
    """What merging control flow makes of definitions: phis, their inputs, and what each read reads from."""
    e = overlays.branch_history(graph.load(spark, d)).edges
    return e.filter(F.col("kind").isin("PHI_AT", "PHI_INPUT", "BRANCH_READS_FROM", "BRANCH_PREVIOUS")).select("kind", "src", "dst")


_REQ = r"(?i)url|uri|href|endpoint|request|\breq\b|body|payload|\binput\b|param|\bquery\b|\bevent\b|header|cookie|\bform\b|upload|webhook|\bdata\b|content|message|\bmsg\b"
_BOUND = r"(?i)handle|webhook|route|controller|middleware|endpoint|\bserve\b|listen|subscribe|consume|dispatch|resolver"
_SENSITIVE = {
    "dynamic-code": ["eval", "Function"], "network": ["fetch"], "process": ["exec", "execFile", "spawn"], "filesystem-write": ["writeFile", "writeFileSync", "rename"],
    "database": ["query", "execute", "findById", "findOne"], "response": ["send", "json", "redirect"],
}
_FAMILY = [
    (r"\beval\b|^Function$|runInContext|runInNewContext|createFunction", "dynamic-code"), (r"^exec$|execSync|execFile|spawn(Sync)?|\bfork\b|execa", "process"),
    (r"writeFile|appendFile|createWriteStream|unlink|rmdir|^rm$|mkdir|rename(Sync|File|Dir|Path)|copyFile|chmod|symlink", "filesystem-write"),
    (r"\bfetch\b|axios|\bgot\b|https?Request|createConnection|sendBeacon|XMLHttpRequest|\bky\b", "network"),
    (r"findOne|findById|findMany|\bfindAll\b|\bquery\b|execute(Query|Sql|SQL|Statement|Raw|Batch)|rawQuery|\.raw\b|aggregate|deleteMany|updateMany|insertMany|createQueryBuilder", "database"),
    (r"readFile|createReadStream|readdir|realpath", "filesystem-read"), (r"deserialize|unserialize|parseXml|loadYaml|fromJSON", "deserialize"),
]
_SINK = "CASE " + " ".join(f"WHEN name IN ({', '.join(repr(n) for n in ns)}) THEN '{k}'" for k, ns in _SENSITIVE.items()) + " " + " ".join(f"WHEN regexp_matches(name, '{p}') THEN '{k}'" for p, k in _FAMILY) + " END"


@query(f"""{_NE}, XP AS (SELECT DISTINCT n.id FROM E e JOIN (SELECT DISTINCT file_id, unnest(exports) AS x FROM files) f ON f.file_id = e.src JOIN N n ON n.id = e.dst AND n.label = f.x WHERE (e.kind = 'CONTAINS' OR sem = 'CONTAINS') AND n.kind IN ('function','method','constructor')),
 PR AS (SELECT p.id AS value_id, p.label AS name, coalesce(p.type, '') AS type, o.label AS owner_name FROM (SELECT N.*, t.type FROM N LEFT JOIN (SELECT id, min(type) AS type FROM nodes GROUP BY id) t ON t.id = N.id) p JOIN N o ON o.id = p.owner_function_id WHERE p.kind = 'parameter' AND o.id IN (SELECT id FROM XP) AND coalesce(json_extract_string(p.props, '$.provenance'), 'application') IN ('application', '')),
 SR AS (SELECT value_id, 'source' AS role, CASE WHEN regexp_matches(name, '{_REQ}') OR regexp_matches(type, '\\b(URL|URI|Request|Response|IncomingMessage|ServerRequest|Readable|Buffer|Stream|FormData|Headers|Uint8Array|ArrayBuffer|Blob|Socket)\\b') THEN 'request-input'
 WHEN regexp_matches(name, '(^|_)(id|ids|uuid|guid|slug|ref|handle)$|(^|[^A-Z])Ids?$|Uuid$|Guid$|Slug$') AND NOT regexp_matches(name, '(?i)secret|token|apikey|appid|clientid|tenantid|sessionid|requestid|traceid|nonce') THEN 'resource-identifier' WHEN regexp_matches(owner_name, '{_BOUND}') THEN 'boundary-parameter' END AS role_kind FROM PR),
 CL AS (SELECT id, coalesce(nullif(json_extract_string(props, '$.method_name'), ''), {_LAST.format(x="coalesce(json_extract_string(props, '$.callee'), label, '')")}) AS name, json_extract_string(props, '$.value_id') AS v FROM N WHERE kind IN ('call','construct')),
 SK AS (SELECT coalesce(n.id, c.id) AS value_id, 'sink' AS role, {_SINK} AS role_kind FROM CL c LEFT JOIN N n ON n.id = c.v) SELECT * FROM (SELECT * FROM SR UNION ALL SELECT * FROM SK) WHERE role_kind IS NOT NULL""")
def security_roles(spark: SparkSession, d: str) -> DataFrame:
    """Parameters of exported callables that look like input, and calls whose names matter."""
    n = overlays.security_roles(_exported(spark, d)).nodes
    p = lambda k: F.get_json_object("props", f"$.{k}")
    return n.select(p("value_id").alias("value_id"), F.col("kind").alias("role"), F.coalesce(p("source_kind"), p("sink_kind")).alias("role_kind"))


def _with_roles(spark: SparkSession, d: str) -> graph.Graph:
    g = _exported(spark, d)
    return overlays.absorb(g, overlays.security_roles(g))[0]


@query()
def taint_reaches(spark: SparkSession, d: str) -> DataFrame:
    """The first way from each source to each sink; where there is no sink at all, to the first call sites that are reached."""
    g = _with_roles(spark, d)
    return reach.taint(g, *reach.role_facts(g)).select("source_value", "sink_value", "confidence", "hops", F.array_join("path", " > ").alias("path"), "truncated")


@query()
def taint_flows(spark: SparkSession, d: str) -> DataFrame:
    """Every edge that a tainted value walks."""
    g = _with_roles(spark, d)
    return reach.taint_flows(g, *reach.role_facts(g))


@query()
def unwitnessed(spark: SparkSession, d: str) -> DataFrame:
    """Sources and sinks that take part in no way."""
    g = _with_roles(spark, d)
    sources, sinks = reach.role_facts(g)
    return reach.unwitnessed(reach.taint(g, sources, sinks), sources, sinks)


@query()
def fold_report(spark: SparkSession, d: str) -> DataFrame:
    """What every rule adds when all are applied in order."""
    _, report = overlays.fold(_exported(spark, d), overlays.all_rules(), written=True)
    return spark.createDataFrame([(i, *r) for i, r in enumerate(report)], "place int, rule string, n_nodes long, n_edges long")


@query()
def runtime_effects(spark: SparkSession, d: str) -> DataFrame:
    """Calls whose names the runtimes' models know, and what they do."""
    from weftgraph.operators.runtime import bound_calls

    return bound_calls(graph.load(spark, d)).select("call_id", "model_id", "model", F.array_join("behaviors", " ").alias("behaviors"))
