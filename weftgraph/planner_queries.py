"""Queries of the planner's operators and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftgraph import graph, schema
from weftgraph import graph_queries as gq
from weftgraph import rule_queries as rq
from weftgraph.operators import planner
from weftgraph.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
_NE, _RNE, _N, _E, _PAIRS, _ENTRY, _GUARDED, _DECL = gq._NE, gq._RNE, gq._N, gq._E, gq._PAIRS, gq._ENTRY, rq._GUARDED, gq._DECL
_sem = rq._sem
_FNS = "SELECT id FROM builtin_nodes WHERE kind = 'function'"
_BIND = "M AS (SELECT call_id, model_id, model, effect FROM (" + rq.ORACLE["model_bindings"].split("SELECT DISTINCT src AS call_id", 1)[0].replace(f"WITH {_E}, M AS", "WITH MM AS") + "SELECT DISTINCT src AS call_id" + rq.ORACLE["model_bindings"].split("SELECT DISTINCT src AS call_id", 1)[1].replace("M.id", "MM.id").replace("JOIN M ON", "JOIN MM ON") + "))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"""{_NE}, {_ENTRY}, F AS (SELECT id, label, unit FROM N WHERE kind IN ('function','method')), X AS (SELECT dst AS id, 0 AS s FROM E WHERE (kind = 'MAY_INVOKE' OR sem = 'MAY_INVOKE') AND dst IS NOT NULL
 UNION ALL SELECT id, 1 FROM F WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT unit, unnest(exports) AS label FROM files) x WHERE x.unit = F.unit AND x.label = F.label) UNION ALL SELECT id, 2 FROM R)
 SELECT F.id, ['callback','exported','uncalled'][min(s) + 1] AS strength FROM F JOIN X ON X.id = F.id GROUP BY F.id""")
def ranked_entries(spark: SparkSession, d: str) -> DataFrame:
    return planner.ranked_entries(graph.load(spark, d), table(spark, d, "files"))


@query(f"""{_NE}, {_BIND} SELECT call_id, model, round(0.75 * CASE effect WHEN 'free' THEN 1.0 WHEN 'alloc' THEN 0.75 WHEN 'use' THEN 0.5 END + 0.25 * CASE WHEN confidence IN ('exact','high') THEN 1.0 WHEN confidence = 'medium' THEN 0.7 WHEN confidence = 'low' THEN 0.4 ELSE 0.5 END, 4)::DOUBLE AS rank
 FROM M LEFT JOIN N ON N.id = call_id WHERE effect <> 'none'""")
def sink_obligations(spark: SparkSession, d: str) -> DataFrame:
    return planner.sink_obligations(graph.load(spark, d), table(spark, d, "builtin_nodes"))


@query(f"WITH {_N} SELECT CASE {' '.join(f'WHEN kind IN ({gq._kinds(k)}) THEN {chr(39)}{f}{chr(39)}' for f, k in schema.NODE_KINDS.items())} ELSE 'unknown' END AS family, count(*) AS n FROM N GROUP BY 1")
def census(spark: SparkSession, d: str) -> DataFrame:
    return planner.census(graph.load(spark, d))


@query(f"""WITH {_E}, C AS (SELECT unnest([{{'capability': 'value-flow', 'k': ['VALUE_FLOWS_TO']}}, {{'capability': 'points-to', 'k': ['POINTS_TO']}}, {{'capability': 'regions', 'k': ['TRUE_BRANCH','FALSE_BRANCH','LOOP_TRUE','TRY_BODY']}}, {{'capability': 'control-flow', 'k': ['CFG_NEXT']}}, {{'capability': 'guards', 'k': ['GUARDED_BY']}}], recursive := true))
 SELECT capability, EXISTS (SELECT 1 FROM E WHERE list_contains(C.k, E.sem)) AS present FROM C""")
def capabilities_present(spark: SparkSession, d: str) -> DataFrame:
    return planner.capabilities_present(graph.load(spark, d))


@query(f"""{_NE}, {_PAIRS}, O AS (SELECT caller AS id, count(*) AS n_callees, count(*) FILTER (WHERE callee IN ({_FNS})) AS n_sinks FROM P GROUP BY 1)
 SELECT N.id, coalesce(n_callees, 0) AS n_callees, coalesce(n_sinks, 0) AS n_sinks, N.id NOT IN (SELECT callee FROM P) AS is_source, CASE WHEN n_callees IS NULL THEN 'leaf' WHEN n_sinks = 0 THEN 'inner' WHEN n_sinks = n_callees THEN 'sink-only' ELSE 'mixed' END AS taxonomy
 FROM N LEFT JOIN O ON O.id = N.id WHERE kind IN ('function','method')""")
def function_summaries(spark: SparkSession, d: str) -> DataFrame:
    return planner.function_summaries(graph.load(spark, d), table(spark, d, "builtin_nodes"))


@query()
def witnesses(spark: SparkSession, d: str) -> DataFrame:
    """The least of the shortest call paths from each entry point to each guarded function, of any length."""
    return planner.witnesses(graph.load(spark, d))


@query(f"""{_RNE}, {_PAIRS}, {_ENTRY}, W(seed, node, n) AS (SELECT id, id, 0 FROM R UNION SELECT w.seed, p.callee, w.n + 1 FROM W w JOIN P p ON p.caller = w.node WHERE w.n < 3), X AS (SELECT seed, node, min(n) AS n FROM W GROUP BY 1, 2)
 SELECT seed, count(*) AS n_reached, count(*) FILTER (WHERE n = 3 AND node IN (SELECT caller FROM P)) AS n_frontier FROM X GROUP BY seed""")
def stories(spark: SparkSession, d: str) -> DataFrame:
    return planner.stories(graph.load(spark, d), 3)


@query(f"{_NE} SELECT e.dst AS type_id, N.kind, count(*) AS n FROM E e JOIN N ON N.id = e.src WHERE (e.kind = 'HAS_TYPE' OR sem = 'HAS_TYPE') AND e.dst IS NOT NULL GROUP BY 1, 2")
def type_consumers(spark: SparkSession, d: str) -> DataFrame:
    return planner.type_consumers(graph.load(spark, d))


@query("""WITH N AS (SELECT id, min(unit) AS unit, min(language) AS language, min(kind) AS kind, min(lower(trim(confidence))) AS confidence FROM (SELECT * FROM nodes UNION ALL SELECT * FROM builtin_nodes) WHERE id IS NOT NULL GROUP BY id)
 SELECT unit, language, count(*) AS nodes, count(*) FILTER (WHERE confidence = 'unresolved') AS unresolved, count(*) FILTER (WHERE kind = 'diagnostic') AS diagnostics FROM N GROUP BY 1, 2""")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    return planner.coverage(graph.load(spark, d))


@query(f"""{_NE}, {_DECL}, X AS (SELECT src AS id FROM E UNION ALL SELECT dst FROM E), G AS (SELECT id, count(*) AS degree FROM X GROUP BY 1), T AS (SELECT *, len(list_intersect(list_transform(regexp_extract_all(name, '[A-Z]?[a-z]+|[0-9]+|[A-Z]+'), lambda t: lower(t)), ['merge','table'])) AS c FROM D)
 SELECT node_id AS id, (10 * c + CASE WHEN lower(name) = 'merge_table' THEN 20 ELSE 0 END + least(coalesce(degree, 0), 10))::BIGINT AS score FROM T LEFT JOIN G ON G.id = T.node_id WHERE c > 0""")
def context_scores(spark: SparkSession, d: str) -> DataFrame:
    return planner.context_scores(graph.load(spark, d), ["merge", "table"])


@query(f"{_NE}, {_PAIRS}, {_GUARDED} SELECT callee AS sink_id, count(*) FILTER (WHERE caller IN (SELECT id FROM V)) AS guarded, count(*) FILTER (WHERE caller NOT IN (SELECT id FROM V)) AS unguarded FROM P WHERE callee IN ({_FNS}) GROUP BY 1")
def sink_siblings(spark: SparkSession, d: str) -> DataFrame:
    return planner.sink_siblings(graph.load(spark, d), table(spark, d, "builtin_nodes"))


@query("""WITH P AS (SELECT DISTINCT path FROM files WHERE path IS NOT NULL), H AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS package FROM P WHERE ends_with(path, '.h') AND contains(path, '/'))
 SELECT P.path, coalesce(arg_max(H.package, length(H.package)), '<root>') AS package FROM P LEFT JOIN H ON starts_with(P.path, H.package || '/') GROUP BY P.path""")
def packages(spark: SparkSession, d: str) -> DataFrame:
    return planner.packages_of(table(spark, d, "files"))


@query(f"WITH {_N} SELECT min(id) FILTER (WHERE kind = 'call') AS call_id, min(id) FILTER (WHERE kind = 'identifier') AS variable_id FROM N WHERE owner_function_id IS NOT NULL AND start_line IS NOT NULL AND kind IN ('call','identifier') GROUP BY owner_function_id, start_line HAVING count(*) FILTER (WHERE kind = 'call') = 1 AND count(*) FILTER (WHERE kind = 'identifier') = 1")
def call_results(spark: SparkSession, d: str) -> DataFrame:
    return planner.call_results(graph.load(spark, d))


@query(f"""WITH {_E}, R AS (SELECT DISTINCT src AS v, dst AS f FROM E WHERE kind = 'VALUE_FLOWS_TO' AND reason = 'return' AND src IS NOT NULL AND dst IS NOT NULL), I AS (SELECT DISTINCT src AS c, dst AS f FROM E WHERE {_sem('INVOKES')})
 SELECT DISTINCT v AS value_id, c AS call_id FROM R JOIN I ON I.f = R.f WHERE v <> c AND NOT EXISTS (SELECT 1 FROM E WHERE kind = 'VALUE_FLOWS_TO' AND src = v AND dst = c)""")
def returned_values(spark: SparkSession, d: str) -> DataFrame:
    return planner.returned_values(graph.load(spark, d))


@query(f"""WITH RECURSIVE {_N}, {_E}, {_BIND}, X AS (SELECT DISTINCT src AS a, dst AS b FROM E WHERE {_sem('CFG_NEXT')}), S AS (SELECT DISTINCT src AS pos, effect FROM E JOIN M ON M.call_id = dst WHERE {_sem('AST_CHILD')}),
 F(free_id, pos) AS (SELECT pos, pos FROM S WHERE effect = 'free' UNION SELECT f.free_id, x.b FROM F f JOIN X x ON x.a = f.pos WHERE (f.free_id = f.pos OR NOT EXISTS (SELECT 1 FROM S WHERE S.pos = f.pos AND effect = 'alloc')))
 SELECT DISTINCT free_id, pos AS again_id FROM F WHERE free_id <> pos AND pos IN (SELECT pos FROM S WHERE effect = 'free')""")
def double_frees(spark: SparkSession, d: str) -> DataFrame:
    return planner.double_frees(graph.load(spark, d), table(spark, d, "builtin_nodes"))


@query(f"""SELECT unit, CASE lower(regexp_extract(path, '\\.([^./]*)$', 1)) {' '.join(f"WHEN '{e}' THEN '{f}'" for e, f in planner.FRONTENDS.items())} ELSE 'none' END AS frontend, count(DISTINCT path) AS n_files FROM files WHERE path IS NOT NULL GROUP BY 1, 2""")
def frontend_files(spark: SparkSession, d: str) -> DataFrame:
    return planner.frontend_files(table(spark, d, "files"))


@query("""WITH F AS (SELECT DISTINCT file_id, text FROM files WHERE text IS NOT NULL), S AS (SELECT file_id, string_split(text, chr(10)) AS s FROM F), L AS (SELECT file_id, unnest(s) AS content, unnest(generate_series(1, len(s))) AS line FROM S)
 SELECT file_id, line, content FROM L WHERE regexp_matches(content, 'log_write\\(')""")
def text_scan(spark: SparkSession, d: str) -> DataFrame:
    return planner.text_scan(table(spark, d, "files"), r"log_write\(")


@query(f"""WITH {_N}, X AS (SELECT CASE WHEN kind = 'diagnostic' THEN 'diagnostic' WHEN kind IN ('boundary','external-module') THEN 'boundary' WHEN kind = 'call' AND json_extract_string(props, '$.resolution') = 'dynamic' THEN 'dynamic'
 WHEN kind = 'call' AND json_extract_string(props, '$.resolution') IS NULL THEN 'missing-model' WHEN confidence = 'unresolved' THEN 'confidence' END AS reason FROM N) SELECT reason, count(*) AS n FROM X WHERE reason IS NOT NULL GROUP BY 1""")
def unresolved_reasons(spark: SparkSession, d: str) -> DataFrame:
    return planner.unresolved_reasons(graph.load(spark, d))


@query(f"""WITH {_N}, X AS (SELECT id, kind, last_value(CASE WHEN kind = 'identifier' THEN id END IGNORE NULLS) OVER (PARTITION BY owner_function_id, label ORDER BY start_line, kind = 'read', id ROWS UNBOUNDED PRECEDING) AS def_id
 FROM N WHERE owner_function_id IS NOT NULL AND start_line IS NOT NULL AND label IS NOT NULL AND kind IN ('read','identifier')) SELECT id AS read_id, def_id FROM X WHERE kind = 'read'""")
def definitions_before(spark: SparkSession, d: str) -> DataFrame:
    return planner.definitions_before(graph.load(spark, d))


@query(f"""{_NE}, {_PAIRS}, U AS (SELECT DISTINCT least(caller, callee) AS a, greatest(caller, callee) AS b FROM P WHERE caller <> callee), G AS (SELECT id, count(*) AS degree FROM (SELECT a AS id FROM U UNION ALL SELECT b FROM U) GROUP BY 1)
 SELECT id, degree, (SELECT count(*) FROM G) >= 20 AND degree > 0.05 * (SELECT count(*) FROM G) AS is_connector FROM G""")
def connectors(spark: SparkSession, d: str) -> DataFrame:
    return planner.connectors(graph.load(spark, d))


@query(f"WITH {_E}, X AS (SELECT DISTINCT src AS a, dst AS b FROM E WHERE {_sem('CFG_NEXT')} AND src <> dst) SELECT b AS id, count(*) AS n_before FROM X GROUP BY b HAVING count(*) > 1")
def merge_points(spark: SparkSession, d: str) -> DataFrame:
    return planner.merge_points(graph.load(spark, d))
