"""Queries of the graph engine's own operators and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import graph, schema
from weftgraph.operators import lifetime, navigate, reach, traverse
from weftgraph.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_N = """N AS (SELECT id, min(kind) AS kind, arg_max(label, {'t': recorded_at, 'l': label}) AS label, min(file) AS file, min(absolute_file) AS absolute_file, min(start_line) AS start_line,
 min(end_line) AS end_line, min(owner_function_id) AS owner_function_id, min(function_id) AS function_id, min(package_name) AS package_name, min(unit) AS unit, min(props) AS props,
 min(lower(trim(confidence))) AS confidence FROM (SELECT * FROM nodes UNION ALL SELECT * FROM builtin_nodes) WHERE id IS NOT NULL GROUP BY id)"""
_E = """E AS (SELECT *, coalesce(semantic_kind, kind) AS sem FROM edges QUALIFY row_number() OVER (PARTITION BY kind, src, dst, props ORDER BY row_id) = 1)"""
_NE = f"WITH {_N}, {_E}"
_RNE = f"WITH RECURSIVE {_N}, {_E}"
_PAIRS = "P AS (SELECT DISTINCT src AS caller, dst AS callee FROM E WHERE (kind = 'CALLS' OR sem = 'CALLS') AND src IS NOT NULL AND dst IS NOT NULL)"
_DECL = "D AS (SELECT id AS node_id, label AS name, kind, unit, coalesce(json_extract_string(props, '$.declaration_only') = 'true', false) AS declaration_only FROM N WHERE kind IN ('function','method','class','variable'))"
_CONF = "CASE lower(trim(confidence)) " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(schema.CONFIDENCE_RANK)) + f" ELSE {len(schema.CONFIDENCE_RANK)} END"


def _kinds(kinds: tuple[str, ...]) -> str:
    return ", ".join(f"'{k}'" for k in kinds)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# -- scans and accessors
@query(f"WITH {_N} SELECT id, kind, label FROM N WHERE kind IN ('function','method','class')")
def nodes_of_kind(spark: SparkSession, d: str) -> DataFrame:
    return graph.load(spark, d).nodes.filter(F.col("kind").isin("function", "method", "class")).select("id", "kind", "label")


@query(f"WITH {_N} SELECT coalesce(absolute_file, file) AS file_key, count(*) AS n FROM N WHERE coalesce(absolute_file, file) IS NOT NULL GROUP BY 1")
def nodes_in_file(spark: SparkSession, d: str) -> DataFrame:
    n = graph.load(spark, d).nodes
    return n.select(navigate.file_key(n).alias("file_key")).filter("file_key is not null").groupBy("file_key").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_N} SELECT coalesce(owner_function_id, function_id) AS owner_id, kind, count(*) AS n FROM N WHERE coalesce(owner_function_id, function_id) IS NOT NULL GROUP BY 1, 2")
def nodes_owned_by(spark: SparkSession, d: str) -> DataFrame:
    n = graph.load(spark, d).nodes
    return n.select(navigate.owner(n).alias("owner_id"), "kind").filter("owner_id is not null").groupBy("owner_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_E} SELECT row_id, src, dst FROM E WHERE kind = 'AST_CHILD' OR sem = 'AST_CHILD'")
def edges_of_kind(spark: SparkSession, d: str) -> DataFrame:
    return graph.load(spark, d).semantic("AST_CHILD").select("row_id", "src", "dst")


@query(f"{_NE} SELECT e.src, e.dst, n.kind, n.label FROM E e JOIN N n ON n.id = e.dst WHERE e.kind = 'CONTAINS' OR sem = 'CONTAINS'")
def targets(spark: SparkSession, d: str) -> DataFrame:
    return navigate.targets(graph.load(spark, d), "CONTAINS")


@query(f"WITH {_N} SELECT DISTINCT coalesce(package_name, label) AS package FROM N WHERE kind = 'package'")
def package_inventory(spark: SparkSession, d: str) -> DataFrame:
    return graph.load(spark, d).nodes.filter("kind = 'package'").select(F.coalesce("package_name", "label").alias("package")).distinct()


@query(r"""SELECT DISTINCT path, coalesce(regexp_matches(path, '(?i)\.(test|spec)\.|\.integration\.|\.e2e\.|(^|/)__tests__/|(^|/)tests?/|_test\.|(^|/)selftests/|(^|/)tools/testing/|(^|/)test_[^/]*\.py$|(^|/)conftest\.py$'), false) AS is_test,
 coalesce(list_has_any(string_split(lower(path), '/'), ['node_modules','vendor','vendors','third_party','third-party']), false) AS is_external,
 CASE WHEN len(string_split(path, '/')) <= 1 THEN '.' ELSE array_to_string(string_split(path, '/')[1:least(2, len(string_split(path, '/')) - 1)], '/') END AS component FROM files WHERE path IS NOT NULL""")
def path_predicates(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    f = table(spark, d, "files").filter("path is not null").select("path").distinct()
    return f.select("path", navigate.is_test_path(p).alias("is_test"), navigate.is_external_path(p).alias("is_external"), navigate.component_of(p, 2).alias("component"))


# The layers as the blueprint lists them, for the kinds that the tables can hold.
_TIER = """CASE WHEN kind = 'symbol' THEN 'T1' WHEN kind IN ('project','package','module','file','external-module','import-cycle') THEN 'T0'
 WHEN kind IN ('function','method','constructor','class','interface','type','enum','record','dynamic-behavior','singleton','module-state','module-initializer','static-initializer','function-effect','route','boundary','decorator') THEN 'T1'
 WHEN kind IN ('source','sink','taint-reach') THEN 'T2'
 WHEN kind IN ('statement','expression','identifier','operation','call','construct','argument','return-value','cfg-entry','cfg-exit','cfg-condition','cfg-merge','cfg-block','unreachable-region','phi','type-refinement','scope') THEN 'T3' ELSE 'T4' END"""


@query(f"WITH {_N} SELECT kind, {_TIER} AS tier, count(*) AS n FROM N GROUP BY 1, 2")
def tiers(spark: SparkSession, d: str) -> DataFrame:
    return graph.load(spark, d).nodes.groupBy("kind", schema.tier(F.col("kind")).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_N}, S AS (SELECT id, file, coalesce(owner_function_id, '') AS o, start_line AS a, end_line AS b FROM N WHERE kind = 'statement' AND file IS NOT NULL AND start_line IS NOT NULL AND end_line IS NOT NULL),
 X AS (SELECT id, file, coalesce(owner_function_id, '') AS o, start_line AS a, coalesce(end_line, start_line) AS b FROM N WHERE kind IN ('expression','call','read') AND file IS NOT NULL AND start_line IS NOT NULL)
 SELECT x.id, s.id AS statement_id FROM X x JOIN S s ON s.file = x.file AND s.o = x.o AND s.a <= x.a AND x.b <= s.b QUALIFY row_number() OVER (PARTITION BY x.id ORDER BY s.b - s.a, s.id) = 1"""
)
def enclosing_statements(spark: SparkSession, d: str) -> DataFrame:
    return navigate.enclosing_statements(graph.load(spark, d))


# -- composition and validation
@query("SELECT id, count(*) AS n_rows, count(DISTINCT label) AS n_labels FROM nodes WHERE id IS NOT NULL GROUP BY id HAVING count(DISTINCT label) > 1")
def node_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return graph.node_conflicts(table(spark, d, "nodes"))


@query(f"WITH {_E} SELECT row_id, kind, sem AS semantic, src, dst FROM E")
def compose_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.compose_edges(table(spark, d, "edges")).select("row_id", "kind", schema.semantic_kind().alias("semantic"), "src", "dst")


@query(f"{_NE}, X AS (SELECT kind, 'src' AS side, src AS id FROM E UNION ALL SELECT kind, 'dst', dst FROM E) SELECT kind, side, count(*)::BIGINT AS n FROM X WHERE id IS NULL OR id NOT IN (SELECT id FROM N) GROUP BY ALL")
def dangling(spark: SparkSession, d: str) -> DataFrame:
    g = graph.load(spark, d)
    return graph.dangling(g.edges, g.nodes)


@query(
    f"""SELECT unnest([{{'rule': 'node-kind-unknown', 'n': a}}, {{'rule': 'node-without-id', 'n': b}}, {{'rule': 'node-identity-namespace', 'n': c}}, {{'rule': 'node-without-evidence', 'n': e}}, {{'rule': 'node-span-reversed', 'n': f}}], recursive := true) FROM (
 SELECT count(*) FILTER (WHERE kind NOT IN ({', '.join(_kinds(k) for k in schema.NODE_KINDS.values())})) AS a, count(*) FILTER (WHERE id IS NULL) AS b, count(*) FILTER (WHERE NOT starts_with(id, 'v2:')) AS c,
 count(*) FILTER (WHERE coalesce(fact_origin, '') <> 'compiler' AND coalesce(len(evidence_ids), 0) = 0) AS e, count(*) FILTER (WHERE end_line < start_line) AS f FROM nodes)
 UNION ALL SELECT unnest([{{'rule': 'edge-kind-unknown', 'n': a}}, {{'rule': 'edge-without-end', 'n': b}}, {{'rule': 'edge-without-evidence', 'n': c}}, {{'rule': 'edge-without-meaning', 'n': e}}], recursive := true) FROM (
 SELECT count(*) FILTER (WHERE coalesce(semantic_kind, kind) NOT IN ({', '.join(_kinds(k) for k in schema.EDGE_KINDS.values())})) AS a, count(*) FILTER (WHERE src IS NULL OR dst IS NULL) AS b,
 count(*) FILTER (WHERE coalesce(fact_origin, '') <> 'compiler' AND coalesce(len(evidence_ids), 0) = 0) AS c, count(*) FILTER (WHERE kind = 'EXPANDS_TO' AND semantic_kind IS NULL) AS e FROM edges)"""
)
def violations(spark: SparkSession, d: str) -> DataFrame:
    return graph.violations(table(spark, d, "nodes"), table(spark, d, "edges"))


@query(f"WITH {_E}, X AS (SELECT src AS id FROM E UNION ALL SELECT dst FROM E) SELECT id, count(*) AS degree FROM X WHERE id IS NOT NULL GROUP BY id")
def degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(graph.load(spark, d).edges)


@query()
def graph_hash(spark: SparkSession, d: str) -> DataFrame:
    return graph.bag_hash(graph.load(spark, d))


@query(
    """WITH K AS (SELECT DISTINCT id FROM nodes WHERE kind IN ('file','function','method')), E AS (SELECT * FROM edges QUALIFY row_number() OVER (PARTITION BY kind, src, dst, props ORDER BY row_id) = 1)
 SELECT row_id, src, dst, kind FROM E WHERE src IN (SELECT id FROM K) AND dst IN (SELECT id FROM K)"""
)
def induced_subgraph(spark: SparkSession, d: str) -> DataFrame:
    g = graph.load(spark, d)
    return g.induced(table(spark, d, "nodes").filter(F.col("kind").isin("file", "function", "method"))).edges.select("row_id", "src", "dst", "kind")


@query(
    """WITH F AS (SELECT DISTINCT id FROM nodes WHERE retired_at IS NULL), S AS (SELECT DISTINCT id FROM nodes)
 SELECT id, 'fresh' AS origin FROM F UNION ALL SELECT id, 'stored' FROM S WHERE id NOT IN (SELECT id FROM F)"""
)
def fresh_over_stored(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nodes")
    fresh = n.filter("retired_at is null").select("id").distinct().withColumn("origin", F.lit("fresh"))
    return graph.overlay_join(fresh, n.select("id").distinct().withColumn("origin", F.lit("stored")))


@query("SELECT file_id, content_hash, sha256(text) = content_hash AS unchanged FROM (SELECT DISTINCT file_id, content_hash, text FROM files) WHERE text IS NOT NULL")
def file_digests(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files").filter("text is not null").select("file_id", "content_hash", "text").distinct()
    return f.select("file_id", "content_hash", (F.sha2("text", 256) == F.col("content_hash")).alias("unchanged"))


# -- rankings and roll-ups
# The callable that a node stands in: owners are climbed to the first function, method or constructor.
_OWNED = """CL(id, up, hops) AS (SELECT id, CASE WHEN kind IN ('function','method','constructor') THEN id ELSE coalesce(owner_function_id, function_id) END, 0 FROM N
 UNION SELECT c.id, coalesce(n.owner_function_id, n.function_id), c.hops + 1 FROM CL c JOIN N n ON n.id = c.up WHERE n.kind NOT IN ('function','method','constructor') AND c.hops < 32),
 O AS (SELECT c.id, any_value(c.up) AS callable_id FROM CL c JOIN N n ON n.id = c.up WHERE n.kind IN ('function','method','constructor') GROUP BY c.id)"""
_UNION_PAIRS = """UP AS (SELECT DISTINCT coalesce(o.callable_id, n.id) AS caller, e.dst AS callee FROM E e JOIN N n ON n.id = e.src LEFT JOIN O o ON o.id = e.src
 WHERE (e.kind IN ('CALLS','INVOKES','MAY_INVOKE','CONTEXT_CALLS','READS_CALLEE') OR sem IN ('CALLS','INVOKES','MAY_INVOKE','CONTEXT_CALLS','READS_CALLEE')) AND e.dst IS NOT NULL)"""
_HUBS = f"""{_RNE}, {_OWNED}, {_UNION_PAIRS}, X AS (SELECT callee AS id, 1 AS i, 0 AS o FROM UP UNION ALL SELECT caller, 0, 1 FROM UP), FN AS (SELECT id, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out FROM X GROUP BY id),
 FP AS (SELECT file FROM N WHERE kind = 'file' AND json_extract_string(props, '$.provenance') <> 'application'),
 H AS (SELECT n.id, label, file, fan_in, fan_out, fan_in + fan_out AS degree,
 concat_ws(',', CASE WHEN n.id IN (SELECT dst FROM E WHERE kind = 'EXPORTS' OR sem = 'EXPORTS') THEN 'exported' END,
 CASE WHEN n.id IN (SELECT dst FROM E WHERE kind IN ('INVOKES','MAY_INVOKE','CONTEXT_CALLS','READS_CALLEE') OR sem IN ('INVOKES','MAY_INVOKE','CONTEXT_CALLS','READS_CALLEE')) THEN 'dispatch_target' END,
 CASE WHEN n.id IN (SELECT dst FROM E WHERE kind IN ('REGISTERS_CALLBACK','HANDLED_BY','SCHEDULES') OR sem IN ('REGISTERS_CALLBACK','HANDLED_BY','SCHEDULES')) THEN 'callback' END) AS flags
 FROM FN JOIN N n ON n.id = FN.id WHERE kind IN ('function','method','constructor') AND coalesce(json_extract_string(props, '$.declaration_only'), 'false') <> 'true'
 AND NOT coalesce(regexp_matches(file, '(?i)\\.(test|spec)\\.|\\.integration\\.|\\.e2e\\.|(^|/)__tests__/|(^|/)tests?/|_test\\.|(^|/)selftests/|(^|/)tools/testing/|(^|/)test_[^/]*\\.py$|(^|/)conftest\\.py$'), false)
 AND NOT coalesce(list_has_any(string_split(lower(file), '/'), ['node_modules','vendor','vendors','third_party','third-party']), false) AND (file IS NULL OR file NOT IN (SELECT file FROM FP WHERE file IS NOT NULL)))"""


@query(f"{_HUBS} SELECT * FROM H")
def hubs(spark: SparkSession, d: str) -> DataFrame:
    return navigate.hubs(graph.load(spark, d))


@query(f"{_HUBS} SELECT * FROM H ORDER BY degree DESC, fan_in DESC, lower(label), id LIMIT 20")
def hubs_top(spark: SparkSession, d: str) -> DataFrame:
    return navigate.top_hubs(graph.load(spark, d), 20)


_GUARDS = f"""{_RNE}, {_OWNED}, GE AS (SELECT e.kind, sem, coalesce(a.callable_id, b.callable_id) AS owner_id FROM E e LEFT JOIN O a ON a.id = e.src LEFT JOIN O b ON b.id = e.dst),
 GC AS (SELECT owner_id, count(*) FILTER (WHERE kind = 'CONDITION' OR sem = 'CONDITION') AS conditions, count(*) FILTER (WHERE kind IN ('SHORT_CIRCUIT_LEFT','SHORT_CIRCUIT_RIGHT') OR sem IN ('SHORT_CIRCUIT_LEFT','SHORT_CIRCUIT_RIGHT')) AS short_circuits,
 count(*) FILTER (WHERE kind = 'THROWS_VALUE' OR sem = 'THROWS_VALUE') AS throws, count(*) FILTER (WHERE kind = 'EXCEPTION_BRANCH' OR sem = 'EXCEPTION_BRANCH') AS exception_branches, count(*) FILTER (WHERE kind IN ('TRY_BODY','HANDLED_BY') OR sem IN ('TRY_BODY','HANDLED_BY')) AS handles
 FROM GE WHERE owner_id IS NOT NULL GROUP BY 1),
 GW AS (SELECT e.src AS owner_id, max(CASE WHEN regexp_matches(n.label, '(?i)verif|hmac|\\bsign|signature|digest|sanit|escape|\\bhash\\b') THEN 1.0 WHEN regexp_matches(n.label, '(?i)valid|auth|token|assert|allow|deny|permit|forbid|trust|scope|origin|redirect|secret|cred|\\bcheck|guard|authoriz|permission|owner\\b|tenant') THEN 0.6 ELSE 0.0 END)::DOUBLE AS w
 FROM E e JOIN N n ON n.id = e.dst WHERE e.kind IN ('CALLS','INVOKES','MAY_INVOKE') OR sem IN ('CALLS','INVOKES','MAY_INVOKE') GROUP BY 1),
 GS AS (SELECT coalesce(owner_function_id, function_id) AS owner_id, count(*) AS owned FROM N GROUP BY 1),
 G AS (SELECT c.*, coalesce(w, 0.0)::DOUBLE AS security_weight, round(least(1.0, 0.15 * conditions + 0.2 * short_circuits + 0.3 * throws + 0.1 * exception_branches)::DOUBLE * (0.5 + 0.5 * coalesce(w, 0.0))::DOUBLE, 3) AS score,
 CASE WHEN throws > 0 AND conditions + short_circuits > 0 THEN 'guard' WHEN conditions + short_circuits > 0 THEN 'validate' ELSE 'passthrough' END AS class, coalesce(owned, 0)::BIGINT AS owned
 FROM GC c LEFT JOIN GW ON GW.owner_id = c.owner_id LEFT JOIN GS ON GS.owner_id = c.owner_id WHERE conditions + short_circuits + throws + exception_branches + handles > 0)"""


@query(f"{_GUARDS} SELECT * FROM G")
def guard_profile(spark: SparkSession, d: str) -> DataFrame:
    return navigate.guard_profile(graph.load(spark, d))


@query(f"{_GUARDS} SELECT * FROM G ORDER BY score DESC, owner_id LIMIT 20")
def guards_top(spark: SparkSession, d: str) -> DataFrame:
    return navigate.guard_profile(graph.load(spark, d)).orderBy(F.desc("score"), "owner_id").limit(20)


@query(f"WITH {_E} SELECT unit, sem AS semantic, count(*) AS n, count(DISTINCT src) AS n_src FROM E GROUP BY 1, 2")
def unit_rollup(spark: SparkSession, d: str) -> DataFrame:
    return navigate.unit_rollup(graph.load(spark, d))


@query(f"""{_NE}, {_PAIRS}, I AS (SELECT dst AS id, min(src) AS file_id FROM E WHERE (kind = 'CONTAINS' OR sem = 'CONTAINS') AND src IN (SELECT id FROM N WHERE kind = 'file') GROUP BY dst)
 SELECT a.file_id AS src_file, b.file_id AS dst_file, count(*) AS weight, min(caller) AS witness FROM P JOIN I a ON a.id = caller JOIN I b ON b.id = callee WHERE a.file_id <> b.file_id GROUP BY 1, 2""")
def call_rollup(spark: SparkSession, d: str) -> DataFrame:
    return navigate.call_rollup(graph.load(spark, d))


_COMPONENTS = f"""WITH {_N}, FB AS (SELECT absolute_file, max(id) AS f FROM N WHERE kind = 'file' AND absolute_file IS NOT NULL GROUP BY 1),
 FL AS (SELECT file, max(id) AS f FROM (SELECT label AS file, id FROM N WHERE kind = 'file' UNION ALL SELECT file, id FROM N WHERE kind = 'file') WHERE file IS NOT NULL GROUP BY 1),
 RW AS (SELECT id, sum(CASE role WHEN 'Source' THEN 1 WHEN 'Boundary' THEN 1 WHEN 'Sink' THEN 2 WHEN 'EntryPoint' THEN 3 ELSE 0 END) AS w FROM (SELECT id, unnest(from_json((props->'$.roles'), '["JSON"]'))->>'$.role' AS role FROM N WHERE (props->'$.roles') IS NOT NULL) GROUP BY 1),
 U AS (SELECT n.id, CASE WHEN kind = 'file' THEN n.id ELSE coalesce(FB.f, FL.f) END AS file_id, (kind IN ('diagnostic','boundary','dynamic-behavior') OR coalesce(json_extract_string(props, '$.resolution') IN ('unresolved','dynamic-or-unresolved','external'), false) OR coalesce(confidence = 'unresolved', false))::INT AS u
 FROM N n LEFT JOIN FB ON FB.absolute_file = n.absolute_file LEFT JOIN FL ON FL.file = n.file),
 C AS (SELECT file_id AS id, count(*) AS nodes, sum(u)::BIGINT AS unresolved, (sum(u) + sum(coalesce(w, 0)))::BIGINT AS score FROM U LEFT JOIN RW ON RW.id = U.id WHERE file_id IS NOT NULL GROUP BY 1)
 SELECT C.id, N.label, nodes, unresolved, score FROM C JOIN N ON N.id = C.id"""


@query(_COMPONENTS)
def component_scores(spark: SparkSession, d: str) -> DataFrame:
    return navigate.component_scores(graph.load(spark, d))


@query(f"{_COMPONENTS} ORDER BY score DESC, label, C.id LIMIT 25")
def top_components(spark: SparkSession, d: str) -> DataFrame:
    return navigate.top_components(graph.load(spark, d))


@query(f"WITH {_N} SELECT kind, count(*) AS n, round(1.0::DOUBLE / count(*), 9) AS rarity FROM N GROUP BY kind")
def rarity(spark: SparkSession, d: str) -> DataFrame:
    return navigate.rarity(graph.load(spark, d).nodes)


@query("""WITH C AS (SELECT unnest(map_entries(capabilities)) AS e FROM snapshots) SELECT e.key AS capability, arg_max(e.value, list_position(['none','partial','complete'], e.value)) AS level FROM C WHERE e.value IS NOT NULL GROUP BY 1""")
def capability_levels(spark: SparkSession, d: str) -> DataFrame:
    return navigate.capability_levels(table(spark, d, "snapshots"))


@query(f"""WITH {_E}, R AS (SELECT dst, src, {_CONF} AS r FROM E WHERE (kind IN ('CALLS','INVOKES','MAY_INVOKE') OR sem IN ('CALLS','INVOKES','MAY_INVOKE')) AND src IS NOT NULL AND dst IS NOT NULL)
 SELECT dst, src, [{_kinds(schema.CONFIDENCE_RANK)}, 'unknown'][r + 1] AS confidence FROM R QUALIFY row_number() OVER (PARTITION BY dst ORDER BY r, src) = 1""")
def strongest_call(spark: SparkSession, d: str) -> DataFrame:
    return navigate.strongest_call(graph.load(spark, d))


@query(f"""WITH {_E}, C AS (SELECT src, dst, min(position) AS p FROM E WHERE (kind = 'AST_CHILD' OR sem = 'AST_CHILD') AND src IS NOT NULL AND dst IS NOT NULL GROUP BY 1, 2)
 SELECT src AS parent, dst AS node, lead(dst) OVER (PARTITION BY src ORDER BY p NULLS FIRST, dst) AS follower FROM C""")
def next_siblings(spark: SparkSession, d: str) -> DataFrame:
    return navigate.next_siblings(graph.load(spark, d))


@query(f"""{_NE}, G AS (SELECT DISTINCT src AS id FROM E WHERE kind = 'GUARDED_BY' OR sem = 'GUARDED_BY'), F AS (SELECT id, lower(regexp_extract_all(label, '[A-Z]+|[A-Z][a-z]+|[a-z]+|[0-9]+')[1]) AS stem FROM N WHERE kind IN ('function','method'))
 SELECT stem, count(g.id) AS guarded, count(*) FILTER (WHERE g.id IS NULL) AS unguarded, count(g.id) >= 2 AND count(g.id) > count(*) FILTER (WHERE g.id IS NULL) AS peers_guard FROM F LEFT JOIN G g ON g.id = F.id GROUP BY stem""")
def peer_guards(spark: SparkSession, d: str) -> DataFrame:
    return navigate.peer_guards(graph.load(spark, d))


# -- names
@query(f"WITH {_N}, {_DECL} SELECT node_id, name, kind, unit, declaration_only FROM D")
def decl_index(spark: SparkSession, d: str) -> DataFrame:
    return navigate.decl_index(graph.load(spark, d))


@query(f"WITH {_N} SELECT id AS node_id, coalesce(json_extract_string(props, '$.callee'), label) AS callee_name, coalesce(owner_function_id, function_id) AS owner_id, unit, json_extract_string(props, '$.resolution') AS form FROM N WHERE kind = 'call'")
def callsite_index(spark: SparkSession, d: str) -> DataFrame:
    return navigate.callsite_index(graph.load(spark, d))


@query(f"""{_NE}, {_DECL}, T AS (SELECT src AS id, count(DISTINCT dst) AS n FROM E WHERE (kind IN ('INVOKES','CALLS') OR sem IN ('INVOKES','CALLS')) AND src IS NOT NULL AND dst IS NOT NULL GROUP BY 1),
 M AS (SELECT src AS id, count(DISTINCT dst) AS n FROM E WHERE (kind = 'MAY_INVOKE' OR sem = 'MAY_INVOKE') AND src IS NOT NULL AND dst IS NOT NULL GROUP BY 1),
 H AS (SELECT name, unit, count(*) AS n FROM D WHERE kind IN ('function','method') AND name IS NOT NULL GROUP BY 1, 2)
 SELECT c.id AS call_id, CASE WHEN t.n = 1 THEN 'exact' WHEN t.n > 1 THEN 'conservative' WHEN h.n = 1 THEN 'sole-candidate' WHEN h.n > 1 THEN 'homonyms' WHEN m.n > 0 THEN 'indirect' ELSE 'unresolved' END AS rung, coalesce(t.n, h.n, m.n, 0) AS n_candidates
 FROM N c LEFT JOIN T t ON t.id = c.id LEFT JOIN M m ON m.id = c.id LEFT JOIN H h ON h.name = coalesce(json_extract_string(c.props, '$.callee'), c.label) AND h.unit = c.unit WHERE c.kind = 'call'""")
def resolve_calls(spark: SparkSession, d: str) -> DataFrame:
    return navigate.resolve_calls(graph.load(spark, d))


@query(f"""WITH {_E}, X AS (SELECT dst AS callee, src AS caller, CASE WHEN kind IN ('CALLS','INVOKES') OR sem IN ('CALLS','INVOKES') THEN 0 ELSE 1 END AS v FROM E WHERE kind IN ('CALLS','INVOKES','MAY_INVOKE') OR sem IN ('CALLS','INVOKES','MAY_INVOKE'))
 SELECT callee, caller, CASE WHEN min(v) = 0 THEN 'direct' ELSE 'indirect' END AS via FROM X WHERE callee IS NOT NULL AND caller IS NOT NULL GROUP BY 1, 2""")
def callers(spark: SparkSession, d: str) -> DataFrame:
    return navigate.callers(graph.load(spark, d))


@query(f"WITH {_N}, {_DECL} SELECT name, count(*) AS n_decls, count(DISTINCT unit) AS n_units, min(node_id) AS first_id FROM D GROUP BY name HAVING count(*) > 1")
def homonyms(spark: SparkSession, d: str) -> DataFrame:
    return navigate.homonyms(graph.load(spark, d))


_HITS = f"""{_NE}, {_DECL}, X AS (SELECT src AS id FROM E UNION ALL SELECT dst FROM E), G AS (SELECT id, count(*) AS degree FROM X GROUP BY 1), T AS (SELECT *, list_transform(regexp_extract_all(name, '[A-Z]?[a-z]+|[0-9]+|[A-Z]+'), lambda t: lower(t)) AS tokens FROM D),
 S AS (SELECT node_id AS id, name AS label, kind, CASE WHEN lower(name) = '{{q}}' THEN 100 WHEN starts_with(lower(name), '{{q}}') THEN 85 WHEN list_contains(tokens, '{{q}}') THEN 70 WHEN contains(lower(name), '{{q}}') THEN 55 END AS score FROM T),
 H AS (SELECT S.id, label, kind, score, coalesce(degree, 0) AS degree FROM S LEFT JOIN G ON G.id = S.id WHERE score IS NOT NULL)"""


@query(f"{_HITS.replace('{q}', 'table')} SELECT * FROM H")
def search_names(spark: SparkSession, d: str) -> DataFrame:
    return navigate.search(graph.load(spark, d), "table")


@query(f"""{_HITS.replace('{q}', 'pack')}, R AS (SELECT *, row_number() OVER (ORDER BY score DESC, degree DESC, lower(label), id)::INT AS place, count(*) OVER () AS total FROM H) SELECT * FROM R WHERE place BETWEEN 11 AND 20""")
def search_page(spark: SparkSession, d: str) -> DataFrame:
    hits = navigate.search(graph.load(spark, d), "pack")
    return navigate.page(hits, [F.desc("score"), F.desc("degree"), F.lower("label"), "id"], 10, 10)


@query("""WITH P AS (SELECT DISTINCT path, string_split(path, '/') AS s FROM files WHERE contains(path, '/')), K AS (SELECT s, unnest(generate_series(1, len(s) - 1)) AS k FROM P)
 SELECT DISTINCT array_to_string(s[1:k], '/') AS folder, array_to_string(s[1:k + 1], '/') AS child FROM K""")
def folder_links(spark: SparkSession, d: str) -> DataFrame:
    return navigate.folder_links(table(spark, d, "files"))


@query("""WITH F AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS folder FROM files WHERE contains(path, '/')), S AS (SELECT folder, string_split(folder, '/') AS s FROM F WHERE contains(folder, '/')),
 K AS (SELECT s, unnest(generate_series(1, len(s))) AS k FROM S) SELECT array_to_string(list_concat(list_concat(s[1:k - 1], ['*']), s[k + 1:]), '/') AS template, count(*) AS n_folders FROM K GROUP BY 1 HAVING count(*) > 1""")
def template_families(spark: SparkSession, d: str) -> DataFrame:
    return navigate.template_families(table(spark, d, "files"))


@query(f"""WITH {_E}, P AS (SELECT DISTINCT src, dst FROM E WHERE (kind = 'POINTS_TO' OR sem = 'POINTS_TO') AND src IS NOT NULL AND dst IS NOT NULL)
 SELECT src AS value, dst AS heap_object, count(*) OVER (PARTITION BY dst) - 1 AS n_aliases FROM P""")
def alias_classes(spark: SparkSession, d: str) -> DataFrame:
    return navigate.alias_classes(graph.load(spark, d))


@query(f"{_NE} SELECT id AS call_id, unit FROM N WHERE kind = 'call' AND id NOT IN (SELECT src FROM E WHERE (kind IN ('CALLS','INVOKES','MAY_INVOKE') OR sem IN ('CALLS','INVOKES','MAY_INVOKE')) AND src IS NOT NULL)")
def unresolved_calls(spark: SparkSession, d: str) -> DataFrame:
    return navigate.unresolved_calls(graph.load(spark, d))


_ENTRY = "R AS (SELECT id, label FROM N WHERE kind IN ('function','method','constructor') AND id NOT IN (SELECT dst FROM E WHERE (kind IN ('CALLS','INVOKES','MAY_INVOKE') OR sem IN ('CALLS','INVOKES','MAY_INVOKE')) AND dst IS NOT NULL))"


@query(f"{_NE}, {_ENTRY} SELECT id, label FROM R")
def entry_points(spark: SparkSession, d: str) -> DataFrame:
    return navigate.entry_points(graph.load(spark, d))


# -- traversals
def _calls(g: graph.Graph) -> DataFrame:
    return navigate.call_pairs(g).select(F.col("caller").alias("a"), F.col("callee").alias("b"))


@query(f"""{_RNE}, {_PAIRS}, {_ENTRY}, W(seed, node, distance) AS (SELECT id, id, 0::BIGINT FROM R UNION SELECT w.seed, p.callee, w.distance + 1 FROM W w JOIN P p ON p.caller = w.node WHERE w.distance < 6)
 SELECT seed, node, min(distance) AS distance FROM W GROUP BY 1, 2""")
def call_closure(spark: SparkSession, d: str) -> DataFrame:
    g = graph.load(spark, d)
    return traverse.closure(navigate.entry_points(g), _calls(g), depth=6)


@query(f"""{_RNE}, {_PAIRS}, {_ENTRY}, V AS (SELECT DISTINCT src AS id FROM E WHERE (kind = 'GUARDED_BY' OR sem = 'GUARDED_BY') AND src IS NOT NULL),
 W(seed, node, distance) AS (SELECT id, id, 0::BIGINT FROM R UNION SELECT w.seed, p.callee, w.distance + 1 FROM W w JOIN P p ON p.caller = w.node WHERE w.distance < 6 AND p.callee NOT IN (SELECT id FROM V))
 SELECT seed, node, min(distance) AS distance FROM W GROUP BY 1, 2""")
def paths_avoiding_guards(spark: SparkSession, d: str) -> DataFrame:
    g = graph.load(spark, d)
    avoid = g.semantic("GUARDED_BY").select(F.col("src").alias("id")).filter("id is not null").distinct()
    return traverse.closure(navigate.entry_points(g), _calls(g), depth=6, avoid=avoid)


# The fourteen kinds of flow as the blueprint lists them, with the way back from every heap object.
_FLOW_KINDS = "'DEFINES','VALUE_FLOWS_TO','READS_FROM','PROPERTY_READ','ALIASES','ALIASES_VALUE','PHI_INPUT','BRANCH_READS_FROM','BRANCH_PREVIOUS','POINTS_TO','WRITES_HEAP','READS_HEAP','DYNAMIC_INPUT','REACHING_DEF'"
_FLOW = f"""FL AS (SELECT src AS a, dst AS b, reason, context_id FROM E WHERE sem IN ({_FLOW_KINDS}) AND src IS NOT NULL AND dst IS NOT NULL
 UNION SELECT dst, src, 'alias-via-heap', NULL FROM E WHERE sem = 'POINTS_TO' AND src IS NOT NULL AND dst IS NOT NULL),
 L AS (SELECT DISTINCT {{a}} AS a, {{b}} AS b, CASE WHEN reason = '{{push}}' THEN context_id END AS push, CASE WHEN reason = '{{pop}}' THEN context_id END AS pop FROM FL WHERE coalesce(reason, '') NOT IN ('context-parameter','context-return') OR context_id IS NOT NULL)"""
_FORWARD = _FLOW.format(a="a", b="b", push="context-parameter", pop="context-return")
_REVERSE = _FLOW.format(a="b", b="a", push="context-return", pop="context-parameter")
_WALK = """W(seed, node, stack) AS (SELECT id, id, []::VARCHAR[] FROM S UNION SELECT w.seed, l.b, CASE WHEN l.push IS NOT NULL THEN list_append(w.stack, l.push) WHEN l.pop IS NOT NULL THEN w.stack[1:len(w.stack) - 1] ELSE w.stack END
 FROM W w JOIN L l ON l.a = w.node WHERE CASE WHEN l.push IS NOT NULL THEN len(w.stack) < 12 WHEN l.pop IS NOT NULL THEN w.stack[-1] = l.pop ELSE true END)
 SELECT DISTINCT seed, node FROM W WHERE seed <> node"""


@query(f"{_RNE}, {_FORWARD}, S AS (SELECT id FROM N WHERE kind = 'read'), {_WALK}")
def flow_cones(spark: SparkSession, d: str) -> DataFrame:
    """What the values of every read reach, calls matched with returns."""
    g = graph.load(spark, d)
    return reach.cones(g, g.nodes.filter("kind = 'read'")).select("seed", "node")


@query(f"{_RNE}, {_REVERSE}, S AS (SELECT id FROM N WHERE kind = 'heap-object'), {_WALK}")
def sources_of(spark: SparkSession, d: str) -> DataFrame:
    """What can feed every heap object."""
    g = graph.load(spark, d)
    return reach.cones(g, g.nodes.filter("kind = 'heap-object'"), reverse=True).select("seed", "node")


@query()
def back_over_calls(spark: SparkSession, d: str) -> DataFrame:
    """What can feed every heap object over at most four nested calls; that depth is the question's own bound."""
    g = graph.kept(graph.load(spark, d))
    return reach.back_over_calls(g, g.nodes.filter("kind = 'heap-object'"))


@query(f"""{_RNE}, VF AS (SELECT DISTINCT dst AS a, src AS b, reason FROM E WHERE (kind = 'VALUE_FLOWS_TO' OR sem = 'VALUE_FLOWS_TO') AND src IS NOT NULL AND dst IS NOT NULL),
 VC(seed, node) AS (SELECT id, id FROM N WHERE kind = 'expression' UNION SELECT c.seed, v.b FROM VC c JOIN VF v ON v.a = c.node WHERE v.reason IN ('read','read-value','value-preserving-expression','arithmetic-operand','call-argument','field-read'))
 SELECT DISTINCT c.seed, v.b AS node, 'definition' AS role, v.reason FROM VC c JOIN VF v ON v.a = c.node WHERE v.reason IN ('initializer','assignment','write','field-write','allocation','out-parameter','call-return')
 UNION SELECT c.seed, c.node, 'origin', NULL FROM VC c JOIN N ON N.id = c.node WHERE N.kind IN ('parameter','allocation','heap-object') AND c.node <> c.seed""")
def variable_contexts(spark: SparkSession, d: str) -> DataFrame:
    """What defines the value of every expression, and where it comes from."""
    g = graph.kept(graph.load(spark, d))
    return reach.variable_context(g, g.nodes.filter("kind = 'expression'"))


@query()
def flow_pages(spark: SparkSession, d: str) -> DataFrame:
    """The first 200 nodes of each read's cone with the node before each; the cut is the feature."""
    g = graph.load(spark, d)
    return reach.shown(reach.cones(g, g.nodes.filter("kind = 'read'"))).select("seed", "place", "node", "parent", "distance", "reached", "truncated")


@query()
def flow_witnesses(spark: SparkSession, d: str) -> DataFrame:
    """For each read and each heap object, the first way from one to the other, if there is one."""
    from weftgraph.operators.traverse import flow_links

    g = graph.load(spark, d)
    found, _ = reach.ways(g.nodes.filter("kind = 'read'"), flow_links(reach.flow_edges(g)), paths=True)
    heap = g.nodes.filter("kind = 'heap-object'").select(F.col("id").alias("node"))
    return reach.first_ways(found).join(heap, "node", "left_semi").select("seed", "node", F.col("round").cast("long").alias("hops"), F.array_join("path", " > ").alias("path"))


@query()
def invariant_traces(spark: SparkSession, d: str) -> DataFrame:
    """What reads, writes and checks stand within four steps of each heap object."""
    g = graph.kept(graph.load(spark, d))
    return reach.invariant_trace(g, g.nodes.filter("kind = 'heap-object'"))


@query(f"""{_RNE}, I AS (SELECT DISTINCT src AS a, dst AS b FROM E WHERE kind = 'VALUE_FLOWS_TO' AND reason IN ('allocation','initializer','assignment','write','read','read-value','argument-value','context-argument','context-call-result','return','call-result','branch-reaching-definition','phi-input','call-argument','value-preserving-expression') AND src IS NOT NULL AND dst IS NOT NULL),
 Q(value, heap_object) AS (SELECT src, dst FROM E WHERE kind = 'POINTS_TO' AND src IS NOT NULL AND dst IS NOT NULL UNION SELECT i.b, q.heap_object FROM Q q JOIN I i ON i.a = q.value) SELECT DISTINCT value, heap_object FROM Q""")
def points_to(spark: SparkSession, d: str) -> DataFrame:
    """Inclusion-based points-to over the edges that keep a value's identity."""
    from weftgraph.plans.durable import durable
    from weftgraph.plans.fixpoint import fixpoint

    g = graph.kept(graph.load(spark, d))
    links = durable(g.edges.filter("kind = 'VALUE_FLOWS_TO' and src is not null and dst is not null").filter(F.col("reason").isin(*schema.IDENTITY_REASONS)).select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct(), "identity")
    seed = g.edges.filter("kind = 'POINTS_TO' and src is not null and dst is not null").select(F.col("src").alias("value"), F.col("dst").alias("heap_object"))
    found, _ = fixpoint(seed, lambda f: f.join(links, f["value"] == links["a"]).select(F.col("b").alias("value"), "heap_object"), ["value", "heap_object"])
    return found.select("value", "heap_object")


@query(f"""{_RNE}, {_PAIRS}, U AS (SELECT caller AS a, callee AS b FROM P UNION SELECT callee, caller FROM P UNION SELECT caller, caller FROM P UNION SELECT callee, callee FROM P),
 W(id, other) AS (SELECT a, b FROM U UNION SELECT w.id, u.b FROM W w JOIN U u ON u.a = w.other) SELECT id, min(other) AS component FROM W GROUP BY id""")
def call_components(spark: SparkSession, d: str) -> DataFrame:
    return traverse.components(_calls(graph.load(spark, d)))


@query(f"""{_RNE}, {_PAIRS}, W(id, other) AS (SELECT caller, callee FROM P UNION SELECT w.id, p.callee FROM W w JOIN P p ON p.caller = w.other), X AS (SELECT caller AS id FROM P UNION SELECT callee FROM P)
 SELECT x.id, least(x.id, coalesce(min(w.other), x.id)) AS component FROM X x LEFT JOIN W w ON w.id = x.id AND EXISTS (SELECT 1 FROM W v WHERE v.id = w.other AND v.other = w.id) GROUP BY x.id""")
def call_cycles(spark: SparkSession, d: str) -> DataFrame:
    return traverse.strong_components(_calls(graph.load(spark, d)))


@query(f"""{_RNE}, {_PAIRS}, W(id, other) AS (SELECT caller, callee FROM P UNION SELECT w.id, p.callee FROM W w JOIN P p ON p.caller = w.other), X AS (SELECT caller AS id FROM P UNION SELECT callee FROM P),
 C AS (SELECT x.id, least(x.id, coalesce(min(w.other), x.id)) AS component FROM X x LEFT JOIN W w ON w.id = x.id AND EXISTS (SELECT 1 FROM W v WHERE v.id = w.other AND v.other = w.id) GROUP BY x.id),
 A AS (SELECT DISTINCT a.component AS a, b.component AS b FROM P JOIN C a ON a.id = caller JOIN C b ON b.id = callee WHERE a.component <> b.component),
 V(component, level) AS (SELECT DISTINCT component, 0::BIGINT FROM C UNION SELECT A.a, v.level + 1 FROM V v JOIN A ON A.b = v.component) SELECT component, max(level) AS level FROM V GROUP BY 1""")
def call_levels(spark: SparkSession, d: str) -> DataFrame:
    links = _calls(graph.load(spark, d))
    return traverse.levels(links, traverse.strong_components(links))


def _label_rounds(rounds: int) -> str:
    parts = ["Y AS (SELECT caller AS a, callee AS b FROM P WHERE caller <> callee UNION SELECT callee, caller FROM P WHERE caller <> callee)", "L0 AS (SELECT DISTINCT a AS id, a AS label FROM Y)"]
    for i in range(rounds):
        parts.append(f"L{i + 1} AS (SELECT a AS id, label FROM (SELECT y.a, l.label, count(*) AS n FROM Y y JOIN L{i} l ON l.id = y.b GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY a ORDER BY n DESC, label) = 1)")
    return ", ".join(parts)


@query(f"{_NE}, {_PAIRS}, {_label_rounds(5)} SELECT id, label FROM L5")
def call_communities(spark: SparkSession, d: str) -> DataFrame:
    """Labels after five synchronous rounds, not settled; :func:`settled_communities` are the communities."""
    return traverse.propagate_labels(_calls(graph.load(spark, d)), 5)


@query(f"""{_NE}, {_PAIRS}, {_label_rounds(5)}, U AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM Y), J AS (SELECT x.label AS la, y.label AS lb FROM U JOIN L5 x ON x.id = U.a JOIN L5 y ON y.id = U.b),
 K AS (SELECT label, count(*) AS k FROM (SELECT la AS label FROM J UNION ALL SELECT lb FROM J) GROUP BY 1), I AS (SELECT la AS label, count(*) AS n FROM J WHERE la = lb GROUP BY 1), M AS (SELECT count(*) AS m FROM U)
 SELECT count(*) AS n_communities, round(sum(coalesce(n, 0)::DOUBLE / (SELECT m FROM M) - pow(k::DOUBLE / (2 * (SELECT m FROM M)), 2)), 6) AS modularity FROM K LEFT JOIN I USING (label)""")
def community_modularity(spark: SparkSession, d: str) -> DataFrame:
    """Modularity of the labels after five synchronous rounds."""
    links = _calls(graph.load(spark, d))
    return traverse.modularity(links, traverse.propagate_labels(links, 5))


def _settled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    from weftgraph.operators.planner import connectors
    from weftgraph.plans.durable import durable

    g = graph.load(spark, d)
    links = durable(_calls(g), "calls")
    apart = durable(connectors(g).filter("is_connector").select("id"), "connectors")
    return traverse.without(links, apart), traverse.settled_labels(links, apart)


@query()
def settled_communities(spark: SparkSession, d: str) -> DataFrame:
    """Communities of the call graph without its connectors, by sequential label propagation until nothing changes."""
    return _settled(spark, d)[1]


@query()
def settled_modularity(spark: SparkSession, d: str) -> DataFrame:
    """Number of linked settled communities and their modularity."""
    return traverse.modularity(*_settled(spark, d), weighted=True)


# -- findings
@query(f"""{_NE}, D AS (SELECT unit, id, label FROM N WHERE kind IN ('function','method') AND unit IS NOT NULL), W AS (SELECT *, sum(length(label)) OVER (PARTITION BY unit ORDER BY label, id ROWS UNBOUNDED PRECEDING) AS running FROM D),
 X AS (SELECT *, max(running) OVER (PARTITION BY unit) > 200 AS truncated FROM W) SELECT unit, id, running::BIGINT AS running, truncated FROM X WHERE running <= 200""")
def budgeted_slices(spark: SparkSession, d: str) -> DataFrame:
    """Declarations of each unit as far as 200 characters reach; the cut is the feature."""
    n = graph.load(spark, d).nodes.filter(F.col("kind").isin("function", "method") & F.col("unit").isNotNull()).select("unit", "id", "label")
    return lifetime.fit_budget(n, "unit", ["label", "id"], "label", 200).select("unit", "id", "running", "truncated")


# -- concept search
@query("""WITH T AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents WHERE text IS NOT NULL), F AS (SELECT token, count(*) AS df FROM T GROUP BY 1)
 SELECT token, df, round(ln(((SELECT count(*) FROM documents WHERE text IS NOT NULL) + 1.0) / (df + 1)) + 1, 6) AS idf FROM F""")
def token_idf(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", "text")
    n = docs.count()
    t = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("token"))
    return t.groupBy("token").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", F.round(F.log((F.lit(n) + 1.0) / (F.col("df") + 1)) + 1, 6))


@query("""WITH Q AS (SELECT vec_id AS q, embedding AS e FROM embeddings WHERE vec_id % 100 = 0), S AS (SELECT q, vec_id, list_cosine_similarity(Q.e::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM Q, embeddings b WHERE vec_id <> q)
 SELECT q AS query_id, vec_id, round(s, 5) AS similarity FROM S QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(s, 5) DESC, vec_id) <= 5""")
def nearest_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest rows of every query row (id divisible by 100), the query set sent to all rows in blocks."""
    from weftgraph.operators.nearest import nearest

    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return nearest(e.filter("vec_id % 100 = 0"), e, 5)
