"""Queries of the accessors, name resolution and set operations, and their SQL, written from the operators' definitions with literal lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import graph, schema
from weftgraph import graph_queries as gq
from weftgraph.operators import access, navigate
from weftgraph.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_N, _NE, _RNE = gq._N, gq._NE, gq._RNE
_TEST = r"(?i)\.(test|spec)\.|\.integration\.|\.e2e\.|(^|/)__tests__/|(^|/)tests?/|_test\.|(^|/)selftests/|(^|/)tools/testing/|(^|/)test_[^/]*\.py$|(^|/)conftest\.py$"


@query(f"WITH {_N} SELECT id, kind FROM N WHERE label = 'clean_block'")
def nodes_named(spark: SparkSession, d: str) -> DataFrame:
    return graph.load(spark, d).nodes.filter(F.col("label") == "clean_block").select("id", "kind")


@query(f"WITH {_N} SELECT coalesce(absolute_file, file) AS file_key, id, kind FROM N WHERE coalesce(absolute_file, file) IS NOT NULL")
def file_nodes(spark: SparkSession, d: str) -> DataFrame:
    n = graph.load(spark, d).nodes
    return n.select(navigate.file_key(n).alias("file_key"), "id", "kind").filter("file_key is not null")


@query(f"WITH {_N} SELECT coalesce(owner_function_id, function_id) AS owner_id, kind, id FROM N WHERE coalesce(owner_function_id, function_id) IS NOT NULL")
def owned_nodes(spark: SparkSession, d: str) -> DataFrame:
    n = graph.load(spark, d).nodes
    return n.select(navigate.owner(n).alias("owner_id"), "kind", "id").filter("owner_id is not null")


@query(f"WITH V AS (SELECT unnest([{', '.join(gq._kinds(k) for k in schema.NODE_KINDS.values())}]) AS kind), K AS (SELECT DISTINCT kind FROM (SELECT kind FROM nodes WHERE id IS NOT NULL UNION ALL SELECT kind FROM builtin_nodes)) SELECT kind, kind IN (SELECT kind FROM K WHERE kind IS NOT NULL) AS present FROM V")
def kinds_present(spark: SparkSession, d: str) -> DataFrame:
    return access.kinds_present(graph.load(spark, d))


@query(f"""{_NE}, X AS (SELECT src, dst, row_id FROM E WHERE (kind = 'READS_FROM' OR sem = 'READS_FROM') AND src IS NOT NULL AND dst IS NOT NULL)
 SELECT src AS id, 'out' AS direction, row_id, dst AS other, n.kind AS other_kind FROM X JOIN N n ON n.id = dst UNION ALL SELECT dst, 'in', row_id, src, n.kind FROM X JOIN N n ON n.id = src""")
def neighbours(spark: SparkSession, d: str) -> DataFrame:
    return access.neighbours(graph.load(spark, d), "READS_FROM")


@query(f"{_NE} SELECT src AS id, arg_min(dst, row_id) AS target FROM E WHERE (kind = 'HAS_TYPE' OR sem = 'HAS_TYPE') AND src IS NOT NULL AND dst IN (SELECT id FROM N) GROUP BY src")
def first_targets(spark: SparkSession, d: str) -> DataFrame:
    return access.first_targets(graph.load(spark, d), "HAS_TYPE")


@query(f"{_RNE}, {gq._OWNED} SELECT id, callable_id FROM O")
def owner_callables(spark: SparkSession, d: str) -> DataFrame:
    return navigate.owner_callables(graph.load(spark, d))


@query(f"{_RNE}, {gq._OWNED} SELECT N.id, coalesce(O.callable_id, N.id) AS decl FROM N LEFT JOIN O ON O.id = N.id")
def caller_decls(spark: SparkSession, d: str) -> DataFrame:
    return navigate.caller_decls(graph.load(spark, d))


_EXTERNAL = """X AS (SELECT DISTINCT id, file FROM N WHERE file IS NOT NULL AND (list_has_any(string_split(lower(file), '/'), ['node_modules','vendor','vendors','third_party','third-party'])
 OR file IN (SELECT file FROM N WHERE kind = 'file' AND file IS NOT NULL AND json_extract_string(props, '$.provenance') <> 'application')))"""


@query(f"WITH {_N}, {_EXTERNAL} SELECT id, file FROM X")
def external_nodes(spark: SparkSession, d: str) -> DataFrame:
    return access.external_nodes(graph.load(spark, d))


@query(f"{_NE} SELECT DISTINCT dst AS id FROM E WHERE (kind = 'EXPORTS' OR sem = 'EXPORTS') AND dst IS NOT NULL")
def exported_ids(spark: SparkSession, d: str) -> DataFrame:
    return access.exported_ids(graph.load(spark, d))


@query(f"{_NE} SELECT id, kind FROM N WHERE id IN (SELECT src FROM E WHERE (kind = 'GUARDED_BY' OR sem = 'GUARDED_BY') AND src IS NOT NULL UNION SELECT dst FROM E WHERE (kind = 'GUARDED_BY' OR sem = 'GUARDED_BY') AND dst IS NOT NULL)")
def endpoint_nodes(spark: SparkSession, d: str) -> DataFrame:
    return access.endpoint_nodes(graph.load(spark, d), "GUARDED_BY")


@query(f"""WITH {_N}, R AS (SELECT id, unnest(from_json((props->'$.roles'), '["JSON"]'))->>'$.role' AS role FROM N WHERE (props->'$.roles') IS NOT NULL) SELECT id, role FROM R WHERE role IS NOT NULL""")
def node_roles(spark: SparkSession, d: str) -> DataFrame:
    return navigate.roles_of(graph.load(spark, d).nodes)


@query(f"""{_NE}, L AS (SELECT DISTINCT e.dst AS id FROM E e JOIN N s ON s.id = e.src WHERE (e.kind = 'DECLARES_SYMBOL' OR sem = 'DECLARES_SYMBOL') AND s.kind = 'scope' AND s.owner_function_id IS NOT NULL)
 SELECT id, CASE WHEN kind = 'symbol' AND id IN (SELECT id FROM L WHERE id IS NOT NULL) THEN 'T3' ELSE {gq._TIER} END AS tier FROM N""")
def node_tiers(spark: SparkSession, d: str) -> DataFrame:
    return access.tiers(graph.load(spark, d))


@query(f"""WITH {_N}, R AS (SELECT id, kind, CASE WHEN kind = 'diagnostic' THEN 'compiler-diagnostic' WHEN kind = 'boundary' THEN coalesce(json_extract_string(props, '$.boundary_kind'), 'runtime-boundary')
 WHEN kind = 'dynamic-behavior' THEN coalesce(json_extract_string(props, '$.behavior_kind'), 'dynamic-runtime')
 WHEN json_extract_string(props, '$.resolution') IN ('unresolved','dynamic-or-unresolved','external') THEN CASE WHEN kind IN ('call','construct') THEN 'unresolved-call' ELSE json_extract_string(props, '$.resolution') END
 WHEN confidence = 'unresolved' THEN 'unresolved-fact' END AS reason FROM N) SELECT * FROM R WHERE reason IS NOT NULL""")
def unresolved_nodes(spark: SparkSession, d: str) -> DataFrame:
    return access.unresolved(graph.load(spark, d))


@query("""SELECT id, CASE WHEN coalesce(min(frontend_id), '') = '' THEN 'SEMANTIC' WHEN min(kind) IN ('file','module','package','namespace','function','method','class','interface','record','enum','struct','definition','declaration','variable','parameter','field','property','symbol','binding','import','export','type','typedef','call','route','sink','external-module','scope','module-initializer','constructor','type-parameter','macro','decorator','static-initializer') THEN 'SPINE' ELSE 'BODY' END AS layer
 FROM (SELECT id, kind, frontend_id FROM nodes UNION ALL SELECT id, kind, frontend_id FROM builtin_nodes) WHERE id IS NOT NULL GROUP BY id""")
def partitions(spark: SparkSession, d: str) -> DataFrame:
    """Which of the three layers of storage each node belongs to."""
    every = table(spark, d, "nodes").select("id", "kind", "frontend_id").unionByName(table(spark, d, "builtin_nodes").select("id", "kind", "frontend_id"))
    n = every.filter("id is not null").groupBy("id").agg(F.min("kind").alias("kind"), F.min("frontend_id").alias("frontend_id"))
    return n.select("id", schema.partition_of(F.col("kind"), F.col("frontend_id")).alias("layer"))


@query(f"""{_NE}, T AS (SELECT id, {gq._TIER} AS tier FROM N), X AS (SELECT CASE WHEN sem = 'CALLS' THEN 'CALLS_SUMMARY' ELSE 'DEPENDS_ON_SUMMARY' END AS kind, CASE WHEN sem = 'CALLS' THEN 'T1' ELSE 'T0' END AS layer, src, dst,
 coalesce(CASE WHEN sem = 'CALLS' THEN json_extract_string(props, '$.callsite') END, row_id::VARCHAR) AS w FROM E WHERE sem IN ('CALLS','DEPENDS_ON','RUNTIME_DEPENDS_ON','RE_EXPORTS'))
 SELECT x.kind, src, dst, count(*) AS weight, string_agg(w, ' ' ORDER BY w) AS witnesses FROM X x JOIN T a ON a.id = src AND a.tier = layer JOIN T b ON b.id = dst AND b.tier = layer GROUP BY 1, 2, 3""")
def rollups(spark: SparkSession, d: str) -> DataFrame:
    return access.rollups(graph.load(spark, d))


_LAST = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '^.*\?\.', '', 's'), '^.*\.', '', 's'), '^.*\[', '', 's'), '\(.*$', '', 's'), '^[''"`\] ]+|[''"`\] ]+$', '', 'g')"""
_NAME = f"coalesce(nullif(json_extract_string(props, '$.callee_name'), ''), nullif(json_extract_string(props, '$.method_name'), ''), {_LAST.format(x='''coalesce(nullif(json_extract_string(props, '$.callee'), ''), label, '')''')})"
_DECLS = """DC AS (SELECT id AS node_id, label AS name, kind, file, start_line AS line, CASE WHEN starts_with(id, 'v2:frontend:') THEN string_split(id, ':')[3] END AS ns, language, coalesce(json_extract_string(props, '$.declaration_only') = 'true', false) AS proto, json_extract_string(props, '$.storage_class') AS storage
 FROM NL WHERE kind IN ('file','class','interface','enum','type','function','method','constructor','record','union','variable','property','constant','macro') AND label <> '')"""
_NL = "NL AS (SELECT N.*, l.language FROM N LEFT JOIN (SELECT id, min(language) AS language FROM (SELECT id, language FROM nodes UNION ALL SELECT id, language FROM builtin_nodes) GROUP BY id) l ON l.id = N.id)"
_GRP = "coalesce('n:' || ns, 'l:' || language, '?')"
_LADDER = f"""{_NE}, {_NL}, {_DECLS}, ST AS (SELECT id AS call_id, {_NAME} AS name, file, language, CASE WHEN starts_with(id, 'v2:frontend:') THEN string_split(id, ':')[3] END AS ns, json_extract_string(props, '$.primary_target_id') AS prim FROM NL WHERE kind IN ('call','construct')),
 TR AS (SELECT src AS call_id, count(DISTINCT dst) AS n, min(dst) AS t FROM E WHERE (kind IN ('INVOKES','CALLS') OR sem IN ('INVOKES','CALLS')) AND dst IS NOT NULL AND (json_extract_string(props, '$.resolution') IN ('exact','compiler-local','cross-tu','binding','registration') OR lower(trim(confidence)) IN ('exact','high')) GROUP BY 1),
 PO AS (SELECT src AS call_id, count(DISTINCT dst) AS n FROM E WHERE (kind IN ('MAY_INVOKE','READS_CALLEE','CONTEXT_CALLS') OR sem IN ('MAY_INVOKE','READS_CALLEE','CONTEXT_CALLS')) AND dst IS NOT NULL GROUP BY 1),
 CA AS (SELECT d.*, {_GRP} AS grp, kind IN ('function','method','constructor') AS can FROM DC d), CN AS (SELECT name, grp, bool_or(can) AS any_can FROM CA GROUP BY 1, 2), CC AS (SELECT CA.* FROM CA JOIN CN USING (name, grp) WHERE can OR NOT any_can),
 K AS (SELECT name, grp, count(*) AS n, min(node_id) AS t, count(*) FILTER (WHERE can AND NOT proto) AS n_def, count(*) FILTER (WHERE can AND NOT proto AND coalesce(storage, '') <> 'static') AS n_ext, min(node_id) FILTER (WHERE can AND NOT proto AND coalesce(storage, '') <> 'static') AS t_ext FROM CC GROUP BY 1, 2),
 SF AS (SELECT name, grp, file, count(*) AS n, min(node_id) AS t FROM CC WHERE can AND NOT proto AND storage = 'static' GROUP BY 1, 2, 3),
 LJ AS (SELECT s.call_id, s.name, p.id AS prim, tr.n AS tn, tr.t AS tt, po.n AS pn, k.n AS kn, k.t AS kt, n_def, n_ext, t_ext, sf.n AS sn, sf.t AS stt, coalesce(regexp_matches(lower(s.file), '\\.[ch]$'), false) AS c
 FROM ST s LEFT JOIN N p ON p.id = s.prim LEFT JOIN TR tr ON tr.call_id = s.call_id LEFT JOIN PO po ON po.call_id = s.call_id LEFT JOIN K k ON k.name = s.name AND k.grp = {_GRP} AND s.name <> '' LEFT JOIN SF sf ON sf.name = s.name AND sf.file = s.file AND sf.grp = {_GRP} AND s.name <> ''),
 LV AS (SELECT *, CASE WHEN prim IS NOT NULL THEN 'primary-target' WHEN tn = 1 THEN 'invokes-edge' WHEN tn > 1 THEN 'invokes-edges' WHEN c AND sn = 1 THEN 'static-same-file' WHEN c AND n_ext = 1 AND n_def <= 64 THEN 'sole-definition' WHEN kn = 1 THEN 'sole-candidate' WHEN kn > 1 THEN 'homonyms' WHEN pn > 0 THEN 'indirect' ELSE 'none' END AS via FROM LJ),
 LD AS (SELECT call_id, name, via, CASE via WHEN 'primary-target' THEN 'exact' WHEN 'invokes-edge' THEN 'exact' WHEN 'invokes-edges' THEN 'conservative' WHEN 'static-same-file' THEN 'exact' WHEN 'sole-definition' THEN 'exact' WHEN 'sole-candidate' THEN 'high' WHEN 'homonyms' THEN 'conservative' ELSE 'unresolved' END AS confidence,
 CASE via WHEN 'primary-target' THEN prim WHEN 'invokes-edge' THEN tt WHEN 'static-same-file' THEN stt WHEN 'sole-definition' THEN t_ext WHEN 'sole-candidate' THEN kt END AS target,
 (CASE via WHEN 'invokes-edges' THEN tn WHEN 'homonyms' THEN kn WHEN 'indirect' THEN pn WHEN 'none' THEN 0 ELSE 1 END)::BIGINT AS n_candidates FROM LV)"""


@query(f"{_LADDER} SELECT *, n_candidates > 64 AS long FROM LD")
def resolve_ladder(spark: SparkSession, d: str) -> DataFrame:
    return access.resolve_ladder(graph.load(spark, d))


_CANDIDATES = f"HC AS (SELECT l.call_id, c.node_id AS candidate FROM LD l JOIN ST s ON s.call_id = l.call_id JOIN CC c ON c.name = l.name AND c.grp = {_GRP.replace('ns', 's.ns').replace('language', 's.language')} WHERE l.via = 'homonyms')"


@query(f"{_LADDER}, {_CANDIDATES} SELECT call_id, candidate FROM HC")
def call_candidates(spark: SparkSession, d: str) -> DataFrame:
    g = graph.load(spark, d)
    return access.call_candidates(g, access.resolve_ladder(g))


@query(f"""{_LADDER.replace('WITH ', 'WITH RECURSIVE ', 1)}, {_CANDIDATES}, {gq._OWNED}, RL AS (SELECT src AS id, dst AS callee, CASE coalesce(semantic_kind, kind) WHEN 'CALLS' THEN 1 WHEN 'INVOKES' THEN 2 WHEN 'MAY_INVOKE' THEN 3 WHEN 'CONTEXT_CALLS' THEN 4 WHEN 'READS_CALLEE' THEN 5 END AS p FROM E WHERE sem IN ('CALLS','INVOKES','MAY_INVOKE','CONTEXT_CALLS','READS_CALLEE')
 UNION ALL SELECT call_id, target, 6 FROM LD WHERE target IS NOT NULL UNION ALL SELECT call_id, candidate, 7 FROM HC),
 RP AS (SELECT coalesce(o.callable_id, n.id) AS caller, callee, min(p) AS p FROM RL r JOIN N n ON n.id = r.id LEFT JOIN O o ON o.id = r.id WHERE callee IS NOT NULL GROUP BY 1, 2)
 SELECT caller, callee, ['direct','indirect(invokes)','indirect(may_invoke)','indirect(context)','indirect(fn-pointer)','resolved','candidate'][p] AS via, CASE WHEN p IN (1, 6) THEN true WHEN p = 7 THEN false ELSE n.kind IN ('function','method','constructor') END AS resolved FROM RP JOIN N n ON n.id = callee""")
def call_relations(spark: SparkSession, d: str) -> DataFrame:
    return access.call_relations(graph.load(spark, d))


@query(f"{_LADDER.replace('WITH ', 'WITH RECURSIVE ', 1)}, {gq._OWNED} SELECT coalesce(o.callable_id, l.call_id) AS caller, l.call_id, l.name AS callee, l.via FROM LD l LEFT JOIN O o ON o.id = l.call_id WHERE via = 'none'")
def unresolved_callees(spark: SparkSession, d: str) -> DataFrame:
    return access.unresolved_callees(graph.load(spark, d))


_ENTRIES = f"""{_NE}, {_NL}, {_DECLS}, {_EXTERNAL}, DG AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM E UNION ALL SELECT dst FROM E) GROUP BY 1),
 EN AS (SELECT node_id, name, kind, file, line, CASE WHEN file IS NOT NULL AND line > 0 THEN file || ':' || line END AS handle, node_id IN (SELECT dst FROM E WHERE sem = 'EXPORTS' AND dst IS NOT NULL) AS exported, coalesce(regexp_matches(file, '{_TEST}'), false) AS is_test, proto AS declaration_only, coalesce(degree, 0) AS degree,
 CASE WHEN kind IN ('function','method','constructor') THEN 0 WHEN kind IN ('class','interface','enum','type','record','union') THEN 1 WHEN kind = 'file' THEN 2 WHEN kind IN ('variable','property','constant') THEN 5 ELSE 3 END AS kr
 FROM DC LEFT JOIN DG ON DG.id = node_id WHERE node_id NOT IN (SELECT id FROM X))"""


@query(f"{_ENTRIES} SELECT * EXCLUDE (kr) FROM EN")
def name_entries(spark: SparkSession, d: str) -> DataFrame:
    return access.name_entries(graph.load(spark, d))


@query(f"{_ENTRIES} SELECT name, node_id, count(*) OVER (PARTITION BY name) AS n_hits FROM EN QUALIFY row_number() OVER (PARTITION BY name ORDER BY kr, declaration_only, degree DESC, NOT exported, is_test, coalesce(file, ''), coalesce(line, 0), node_id) = 1")
def resolve_names(spark: SparkSession, d: str) -> DataFrame:
    return access.resolve_names(access.name_entries(graph.load(spark, d)))


@query(f"{_ENTRIES} SELECT name, node_id FROM EN QUALIFY count(*) OVER (PARTITION BY name) > 1 AND rank() OVER (PARTITION BY name ORDER BY kr, declaration_only, NOT exported, is_test) = 1")
def name_peers(spark: SparkSession, d: str) -> DataFrame:
    return access.name_peers(access.name_entries(graph.load(spark, d)))


@query(f"{_ENTRIES} SELECT handle, node_id FROM EN WHERE handle IS NOT NULL QUALIFY row_number() OVER (PARTITION BY handle ORDER BY kr, declaration_only, degree DESC, is_test, node_id) = 1")
def resolve_handles(spark: SparkSession, d: str) -> DataFrame:
    return access.resolve_handles(access.name_entries(graph.load(spark, d)))


@query(f"""{_ENTRIES}, SC AS (SELECT *, CASE WHEN lower(name) = 'split' THEN 100 WHEN starts_with(lower(name), 'split') THEN 85 WHEN list_contains(list_transform(regexp_extract_all(name, '[A-Z]?[a-z]+|[0-9]+|[A-Z]+'), lambda t: lower(t)), 'split') THEN 70 WHEN contains(lower(name), 'split') THEN 55 END AS score FROM EN)
 SELECT node_id, name, kind, score, row_number() OVER (ORDER BY score DESC, kr, declaration_only, degree DESC, NOT exported, lower(name), coalesce(file, ''), node_id)::INT AS place FROM SC WHERE score IS NOT NULL QUALIFY place <= 25""")
def search_cursor(spark: SparkSession, d: str) -> DataFrame:
    """The first page of a search in the full order; the cut is the feature."""
    hits = access.ranked_search(access.name_entries(graph.load(spark, d)), "split")
    return access.cursor_page(hits, access.search_order(), None, 25)[0].select("node_id", "name", "kind", "score", "place")


_OWNERS = "OW AS (SELECT path AS file, min(unit) AS owner FROM files WHERE path IS NOT NULL GROUP BY 1)"


@query(f"WITH {_OWNERS} SELECT id, arg_min(unit, {{'f': coalesce(unit <> owner, true), 'u': unit}}) AS unit FROM (SELECT DISTINCT n.id, n.unit, owner FROM nodes n LEFT JOIN OW ON OW.file = n.file WHERE id IS NOT NULL) GROUP BY id")
def owner_wins(spark: SparkSession, d: str) -> DataFrame:
    owners = table(spark, d, "files").filter("path is not null").groupBy(F.col("path").alias("file")).agg(F.min("unit").alias("owner"))
    return access.owner_wins(table(spark, d, "nodes"), owners)


@query(f"""{_RNE}, {gq._OWNED}, DA AS (SELECT DISTINCT coalesce(o.callable_id, n.id) AS caller, dst AS callee FROM E e JOIN N n ON n.id = src LEFT JOIN O o ON o.id = src WHERE (e.kind = 'CALLS' OR sem = 'CALLS') AND dst IS NOT NULL),
 DB AS (SELECT DISTINCT coalesce(o.callable_id, n.id) AS caller, dst AS callee FROM E e JOIN N n ON n.id = src LEFT JOIN O o ON o.id = src WHERE (e.kind = 'INVOKES' OR sem = 'INVOKES') AND dst IS NOT NULL)
 SELECT *, 'calls-only' AS side FROM (SELECT * FROM DA EXCEPT SELECT * FROM DB) UNION ALL SELECT *, 'invokes-only' FROM (SELECT * FROM DB EXCEPT SELECT * FROM DA)""")
def call_differences(spark: SparkSession, d: str) -> DataFrame:
    return access.call_differences(graph.load(spark, d))


@query(f"""{_RNE}, {gq._OWNED}, {gq._UNION_PAIRS}, G AS (SELECT DISTINCT src AS id FROM E WHERE (kind = 'GUARDED_BY' OR sem = 'GUARDED_BY') AND src IS NOT NULL)
 SELECT callee AS sink, count(*) FILTER (WHERE caller IN (SELECT id FROM G)) AS n_guarded, count(*) FILTER (WHERE caller NOT IN (SELECT id FROM G)) AS n_open FROM UP GROUP BY 1 HAVING n_guarded > 0 AND n_open > 0""")
def shared_sinks(spark: SparkSession, d: str) -> DataFrame:
    return access.shared_sinks(graph.load(spark, d))


@query(f"""{_NE}, A AS (SELECT src AS call_id, dst AS argument_id, min(position) AS p FROM E WHERE (kind = 'HAS_ARGUMENT' OR sem = 'HAS_ARGUMENT') AND src IS NOT NULL AND dst IS NOT NULL GROUP BY 1, 2),
 B AS (SELECT call_id, argument_id, min(p) AS p FROM (SELECT json_extract_string(props, '$.callsite_id') AS call_id, id AS argument_id, json_extract_string(props, '$.position')::BIGINT AS p FROM N WHERE kind = 'argument') WHERE call_id IS NOT NULL GROUP BY 1, 2),
 C AS (SELECT * FROM B UNION ALL SELECT * FROM A WHERE call_id NOT IN (SELECT call_id FROM B)) SELECT call_id, argument_id, row_number() OVER (PARTITION BY call_id ORDER BY p NULLS LAST, argument_id)::INT AS place FROM C""")
def argument_order(spark: SparkSession, d: str) -> DataFrame:
    return access.argument_order(graph.load(spark, d))
