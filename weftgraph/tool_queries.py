"""Queries of the views and questions over the graph, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import access_queries as aq
from weftgraph import graph
from weftgraph import graph_queries as gq
from weftgraph.operators import navigate, tools
from weftgraph.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
_N, _NE, _RNE, _OWNED, _UP = gq._N, gq._NE, gq._RNE, gq._OWNED, gq._UNION_PAIRS


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _loaded(spark: SparkSession, d: str) -> graph.Graph:
    return graph.kept(graph.load(spark, d))


_FILE_OF = """FB AS (SELECT absolute_file, max(id) AS f FROM N WHERE kind = 'file' AND absolute_file IS NOT NULL GROUP BY 1), FL AS (SELECT file, max(id) AS f FROM (SELECT label AS file, id FROM N WHERE kind = 'file' UNION ALL SELECT file, id FROM N WHERE kind = 'file') WHERE file IS NOT NULL GROUP BY 1),
 FO AS (SELECT * FROM (SELECT n.id, CASE WHEN kind = 'file' THEN n.id ELSE coalesce(FB.f, FL.f) END AS file_id FROM N n LEFT JOIN FB ON FB.absolute_file = n.absolute_file LEFT JOIN FL ON FL.file = n.file) WHERE file_id IS NOT NULL)"""


@query(f"""{_NE}, {_FILE_OF}, {aq._EXTERNAL}, DE AS (SELECT N.id, file_id FROM N JOIN FO ON FO.id = N.id WHERE kind IN ('function','method','class','interface','enum','constructor')),
 CA AS (SELECT DISTINCT src, dst FROM E WHERE (kind = 'CALLS' OR sem = 'CALLS') AND dst IN (SELECT id FROM N)), CJ AS (SELECT a.file_id, src, dst, coalesce(b.file_id = a.file_id, false) AS inside FROM CA JOIN DE a ON a.id = src LEFT JOIN DE b ON b.id = dst)
 SELECT DISTINCT src AS file_id, lower(E.kind) AS relation, src, dst FROM E JOIN N f ON f.id = src WHERE E.kind IN ('DEPENDS_ON','RE_EXPORTS','RUNTIME_DEPENDS_ON') AND f.kind = 'file' AND dst IN (SELECT id FROM N)
 UNION SELECT file_id, 'declares', file_id, id FROM DE UNION SELECT file_id, CASE WHEN inside THEN 'calls' ELSE 'jump' END, src, CASE WHEN inside THEN dst ELSE 'nav:stub:' || dst END FROM CJ WHERE inside OR dst NOT IN (SELECT id FROM X)""")
def open_files(spark: SparkSession, d: str) -> DataFrame:
    """The view of every file."""
    return tools.open_files(_loaded(spark, d))


@query(f"""{_NE}, UC AS (SELECT id, coalesce(json_extract_string(props, '$.resolution'), 'missing-target') AS resolution FROM N WHERE kind IN ('call','construct') AND coalesce(json_extract_string(props, '$.resolution'), '') NOT IN ('exact','compiler-local','cross-tu','binding','registration') AND id NOT IN (SELECT src FROM E WHERE (kind IN ('INVOKES','MAY_INVOKE') OR sem IN ('INVOKES','MAY_INVOKE')) AND src IS NOT NULL AND dst IS NOT NULL))
 SELECT id, 'unresolved-call' AS frontier, resolution FROM UC UNION ALL SELECT id, 'dynamic-behavior', coalesce(json_extract_string(props, '$.resolution'), 'runtime') FROM N WHERE kind = 'dynamic-behavior' AND coalesce(json_extract_string(props, '$.site_id'), '') NOT IN (SELECT id FROM UC)
 UNION ALL SELECT id, 'diagnostic', json_extract_string(props, '$.category') FROM N WHERE kind = 'diagnostic' UNION ALL SELECT id, 'missing-body', 'declaration-only' FROM N WHERE kind IN ('function','method','constructor') AND id NOT IN (SELECT coalesce(owner_function_id, function_id) FROM N WHERE coalesce(owner_function_id, function_id) IS NOT NULL)""")
def frontiers(spark: SparkSession, d: str) -> DataFrame:
    """Where the graph ends."""
    return tools.frontiers(_loaded(spark, d))


@query(f"""{_NE}, {_FILE_OF}, FE AS (SELECT a.file_id AS x, b.file_id AS y FROM E JOIN FO a ON a.id = src JOIN FO b ON b.id = dst WHERE (kind IN ('CALLS','DEPENDS_ON','RUNTIME_DEPENDS_ON','RE_EXPORTS') OR sem IN ('CALLS','DEPENDS_ON','RUNTIME_DEPENDS_ON','RE_EXPORTS')) AND a.file_id <> b.file_id)
 SELECT least(x, y) AS a, greatest(x, y) AS b, count(*)::BIGINT AS w FROM FE GROUP BY 1, 2""")
def file_links(spark: SparkSession, d: str) -> DataFrame:
    return tools.file_links(_loaded(spark, d))


@query()
def architecture_map(spark: SparkSession, d: str) -> DataFrame:
    """Communities of files with their most called callables."""
    return tools.architecture_map(_loaded(spark, d))


@query()
def community_report(spark: SparkSession, d: str) -> DataFrame:
    """The settled communities of the call graph with their size, cohesion, files and members."""
    from weftgraph.operators import traverse
    from weftgraph.operators.planner import connectors

    g = _loaded(spark, d)
    p = navigate.union_call_pairs(g).select(F.col("caller").alias("a"), F.col("callee").alias("b"))
    apart = connectors(g).filter("is_connector").select("id")
    return tools.community_report(traverse.without(p, apart), traverse.settled_labels(p, apart), g.nodes)


@query(f"""{_RNE}, {_OWNED}, {_UP}, WR AS (SELECT id, CASE WHEN regexp_matches(lower(label), 'alloc|malloc|calloc|realloc|new|create') THEN 'allocator' END AS a, CASE WHEN regexp_matches(lower(label), 'free|delete|destroy|release|close') THEN 'deallocator' END AS b,
 CASE WHEN regexp_matches(lower(label), 'read|write|recv|send|fread|fwrite|open') THEN 'io' END AS c, CASE WHEN regexp_matches(lower(label), 'check|valid|verify|parse|sanitize') THEN 'validator' END AS e FROM N)
 SELECT caller AS wrapper, callee, role FROM UP JOIN (SELECT id, unnest([a, b, c, e]) AS role FROM WR) w ON w.id = callee WHERE role IS NOT NULL""")
def wrappers(spark: SparkSession, d: str) -> DataFrame:
    """Functions by what the names of their callees say."""
    return tools.wrappers(_loaded(spark, d))


@query(f"{_NE} SELECT DISTINCT src AS call_id, dst AS target, 'may-invoke' AS via FROM E WHERE (kind = 'MAY_INVOKE' OR sem = 'MAY_INVOKE') AND src IS NOT NULL AND dst IS NOT NULL AND NOT EXISTS (SELECT 1 FROM E r WHERE r.sem = 'READS_CALLEE')")
def indirect_targets(spark: SparkSession, d: str) -> DataFrame:
    """What calls that are not decided may reach; the SQL holds for tables without slots."""
    return tools.indirect_targets(_loaded(spark, d))


_ENTRY = gq._ENTRY


@query(f"""{_RNE}, {_OWNED}, {_UP}, {_ENTRY}, SW(entry, node, level) AS (SELECT id, id, 0::BIGINT FROM R UNION SELECT w.entry, p.callee, w.level + 1 FROM SW w JOIN UP p ON p.caller = w.node WHERE w.level < 6)
 SELECT entry, node, min(level) AS level, min(level) = 6 AND node IN (SELECT caller FROM UP) AS frontier FROM SW GROUP BY 1, 2""")
def story_steps(spark: SparkSession, d: str) -> DataFrame:
    """What each entry point runs within six calls; depth is the question's own bound and what lies behind is told."""
    return tools.story_steps(_loaded(spark, d))


@query(f"""{_RNE}, XW(seed, node, distance) AS (SELECT id, id, 0::BIGINT FROM N WHERE kind = 'project' UNION SELECT w.seed, e.dst, w.distance + 1 FROM XW w JOIN E e ON e.src = w.node WHERE w.distance < 3 AND e.dst IS NOT NULL) SELECT seed, node, min(distance) AS distance FROM XW GROUP BY 1, 2""")
def expansions(spark: SparkSession, d: str) -> DataFrame:
    """What stands within three edges of every project."""
    g = _loaded(spark, d)
    return tools.expand(g, g.nodes.filter("kind = 'project'"), 3)


@query(f"""{aq._LADDER.replace('WITH ', 'WITH RECURSIVE ', 1)}, {_OWNED}, {_ENTRY}, DL AS (SELECT DISTINCT coalesce(o.callable_id, l.call_id) AS a, target AS b FROM LD l LEFT JOIN O o ON o.id = l.call_id WHERE target IS NOT NULL),
 DW(seed, node) AS (SELECT id, id FROM R UNION SELECT w.seed, x.b FROM DW w JOIN DL x ON x.a = w.node) SELECT seed, node FROM DW""")
def decided_cones(spark: SparkSession, d: str) -> DataFrame:
    """What each entry point runs through decided calls, to the end."""
    g = _loaded(spark, d)
    return tools.decided_cones(g, navigate.entry_points(g)).select("seed", "node")


@query(f"""{_RNE}, {_OWNED}, {_UP}, {_ENTRY}, NW(entry, node, distance) AS (SELECT id, id, 0::BIGINT FROM R UNION SELECT w.entry, p.callee, w.distance + 1 FROM NW w JOIN UP p ON p.caller = w.node WHERE w.distance < 2) SELECT node AS function, entry, min(distance) AS distance FROM NW GROUP BY 1, 2""")
def near_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entry points within two calls above each callable."""
    return tools.near_entries(_loaded(spark, d))


@query()
def nearest_variables(spark: SparkSession, d: str) -> DataFrame:
    """For each read, the one identifier that its value comes from first."""
    g = _loaded(spark, d)
    return tools.nearest_variables(g, g.nodes.filter("kind = 'read'"), "identifier", "parameter")


@query(f"""WITH {_N}, TW AS (SELECT DISTINCT path, unnest(regexp_extract_all(text, '[A-Za-z_]\\w*')) AS name FROM files WHERE text IS NOT NULL AND regexp_matches(path, '{aq._TEST}')) SELECT DISTINCT name, path FROM TW WHERE name IN (SELECT label FROM N WHERE kind IN ('function','method','constructor') AND label IS NOT NULL)""")
def tests_of(spark: SparkSession, d: str) -> DataFrame:
    """Files of tests that name a declared callable."""
    return tools.tests_of(graph.load(spark, d), table(spark, d, "files"))


@query(f"""{aq.ORACLE['call_relations'].rsplit(' SELECT caller, callee, [', 1)[0]}, MV AS (SELECT callee AS id, 'callers' AS move FROM RP JOIN N n ON n.id = callee UNION ALL SELECT caller, 'callees' FROM RP JOIN N n ON n.id = callee UNION ALL SELECT coalesce(owner_function_id, function_id), 'body' FROM N)
 SELECT MV.id, move, count(*) AS n FROM MV JOIN N ON N.id = MV.id WHERE kind IN ('function','method','class','interface','enum','constructor') GROUP BY 1, 2""")
def moves(spark: SparkSession, d: str) -> DataFrame:
    """Where one can go from each declaration."""
    return tools.moves(_loaded(spark, d))


@query()
def report(spark: SparkSession, d: str) -> DataFrame:
    return tools.report(_loaded(spark, d))


@query("SELECT unnest(['range_analysis','object_lifecycle','error_path_summary']) AS question, 'blocked' AS status")
def blocked(spark: SparkSession, d: str) -> DataFrame:
    return tools.blocked(spark)


_PLACE = " OR ".join(f"{c} IS NULL" for c in "frontend_id language absolute_file content_hash start_offset end_offset start_line end_line compiler_node_id".split())
_SOURCE = """'scope','symbol','declaration','function','method','constructor','class','interface','type','enum','record','parameter','variable','binding','property','constant','value','decorator','type-parameter','macro','statement','expression','operation','identifier','call','construct','call-value','argument','return','return-value','throw',
 'definition','read','write','literal','property-path','allocation','type-refinement','generic-substitution','dynamic-behavior','module-initializer','static-initializer','source-span','token'"""


@query(f"""WITH NI AS (SELECT DISTINCT id FROM nodes WHERE id IS NOT NULL), ND AS (SELECT id FROM (SELECT DISTINCT * EXCLUDE (evidence_ids) FROM nodes WHERE id IS NOT NULL) GROUP BY id HAVING count(*) > 1),
 V AS (SELECT 'node-kind-forbidden' AS rule, count(*) FILTER (WHERE kind IN ('heap-object','heap-location','function-effect','async-event','source','sink','boundary','guard','taint-reach','call-context','context-parameter','context-return','singleton','module-state','import-cycle','cfg-entry','cfg-block','cfg-condition','cfg-merge','cfg-exit','phi','unreachable-region') AND fact_origin = 'compiler') AS n FROM nodes
 UNION ALL SELECT 'node-without-place', count(*) FILTER (WHERE kind IN ({_SOURCE}) AND fact_origin = 'compiler' AND ({_PLACE})) FROM nodes UNION ALL SELECT 'node-offsets-reversed', count(*) FILTER (WHERE end_offset < start_offset) FROM nodes
 UNION ALL SELECT 'node-outside-namespace', count(*) FILTER (WHERE starts_with(id, 'v2:frontend:') AND string_split(id, ':')[3] <> frontend_id) FROM nodes UNION ALL SELECT 'node-confidence-unknown', count(*) FILTER (WHERE coalesce(lower(trim(confidence)), '') NOT IN ('exact','high','medium','conservative','low','unresolved')) FROM nodes
 UNION ALL SELECT 'edge-kind-forbidden', count(*) FILTER (WHERE coalesce(semantic_kind, kind) IN ('POINTS_TO','MUTATES','APPLIES_EFFECT','REGISTERS_CALLBACK','HANDLED_BY','ASYNC_CONTINUES_AT','TAINT_FLOWS_TO','GUARDED_BY','HAS_CALL_CONTEXT','CONTEXT_CALLS','CONTEXTUALIZES','CONTEXT_RETURNS','WRITES_HEAP','READS_HEAP','REACHING_DEF') AND fact_origin = 'compiler') FROM edges
 UNION ALL SELECT 'snapshot-without-frontend', count(*) FILTER (WHERE coalesce(frontend_id, '') = '') FROM snapshots UNION ALL SELECT 'snapshot-without-language', count(*) FILTER (WHERE coalesce(len(languages), 0) = 0) FROM snapshots
 UNION ALL SELECT 'snapshot-capability-level-unknown', count(*) FILTER (WHERE coalesce(len(list_filter(map_values(capabilities), lambda v: coalesce(v, '') NOT IN ('none','partial','complete'))) > 0, false)) FROM snapshots
 UNION ALL SELECT 'node-id-with-several-contents', (SELECT count(*) FROM ND) UNION ALL SELECT 'edge-end-unknown', (SELECT count(*) FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM NI))
 UNION ALL SELECT 'edge-evidence-unknown', (SELECT count(*) FROM (SELECT unnest(evidence_ids) AS id FROM edges) WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM NI))) SELECT rule, n::BIGINT AS n FROM V""")
def contract_violations(spark: SparkSession, d: str) -> DataFrame:
    """How often the delivered tables break each rule of their contract."""
    return tools.contract_violations(table(spark, d, "nodes"), table(spark, d, "edges"), table(spark, d, "snapshots"))


@query("""WITH P AS (SELECT DISTINCT path, string_split(path, '/')[1] AS package FROM files WHERE path IS NOT NULL), S AS (SELECT path, CASE WHEN contains(path, '/') THEN package ELSE '<root>' END AS package FROM P), Q AS (SELECT DISTINCT regexp_replace(path, '/?[^/]*$', '') AS package FROM S WHERE regexp_matches(path, '(^|/)(package\\.json|pyproject\\.toml|setup\\.py|setup\\.cfg)$')),
 B AS (SELECT s.path, coalesce((SELECT arg_max(q.package, length(q.package)) FROM Q q WHERE q.package <> '' AND starts_with(s.path, q.package || '/')), '<root>') AS package FROM S s),
 C AS (SELECT *, row_number() OVER (PARTITION BY package ORDER BY path) - 1 AS i, count(*) OVER (PARTITION BY package) AS k FROM B) SELECT path, package, CASE WHEN k > 500 THEN format('{}::shard-{:04d}', package, i // 500) ELSE package END AS chunk FROM C""")
def package_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The package of every file, large ones in chunks."""
    return tools.packages(table(spark, d, "files"))


@query("SELECT path, CASE WHEN starts_with(path, 'delta-relay-00000/') THEN 'moved/here' || substr(path, 18) ELSE path END AS mapped FROM (SELECT DISTINCT path FROM files WHERE path IS NOT NULL)")
def remapped_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths after a rewrite of leading folders."""
    f = table(spark, d, "files").filter("path is not null").select("path").distinct()
    return f.select("path", tools.remap_path(F.col("path"), "delta-relay-00000/=moved/here,other=x").alias("mapped"))


@query(f"{_NE} SELECT row_id, src, dst, kind FROM E WHERE src IS NULL OR dst IS NULL OR src NOT IN (SELECT id FROM N) OR dst NOT IN (SELECT id FROM N)")
def deferred_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges an end of which is no node here, kept for when it comes."""
    g = _loaded(spark, d)
    ids = g.nodes.select("id")
    whole = g.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("row_id")
    return g.edges.join(whole, "row_id", "left_anti").select("row_id", "src", "dst", "kind")


@query(f"""{_NE}, {aq._NL}, {aq._DECLS}, CT AS (SELECT node_id, file, line, list_distinct(list_transform(regexp_extract_all(name, '[A-Z]?[a-z]+|[0-9]+|[A-Z]+'), lambda t: lower(t))) AS tokens FROM DC), CQ AS (SELECT node_id, file, line, unnest(list_intersect(tokens, ['save', 'table', 'limit'])) AS token FROM CT),
 CW AS (SELECT token, ln(((SELECT count(*) FROM CT) + 1.0) / (count(*) + 1)) + 1 AS w FROM CQ GROUP BY 1), CH AS (SELECT node_id, any_value(file) AS file, any_value(line) AS line, sum(w) / (SELECT sum(w) FROM CW) AS lexical FROM CQ JOIN CW USING (token) GROUP BY 1)
 SELECT node_id, round(lexical, 6) AS lexical, round(lexical, 6) AS score, row_number() OVER (ORDER BY round(lexical, 9) DESC, coalesce(file, ''), coalesce(line, 0), node_id)::INT AS place FROM CH QUALIFY place <= 32""")
def concept_search(spark: SparkSession, d: str) -> DataFrame:
    """Declarations by the words of a question; the cut at 32 is the feature."""
    return tools.concept_search(graph.load(spark, d), "save table limit")
