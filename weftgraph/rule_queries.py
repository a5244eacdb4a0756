"""Queries of the derivation rules and analyses and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import graph
from weftgraph.functions import paths
from weftgraph import graph_queries as gq
from weftgraph.operators import rules, traverse
from weftgraph.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
_NE, _RNE, _N, _E = gq._NE, gq._RNE, gq._N, gq._E
_SITES = "C AS (SELECT id AS node_id, coalesce(json_extract_string(props, '$.callee'), label) AS callee_name, coalesce(owner_function_id, function_id) AS owner_id, unit FROM N WHERE kind = 'call')"
_OPEN = "U AS (SELECT id AS call_id, unit FROM N WHERE kind = 'call' AND id NOT IN (SELECT src FROM E WHERE (kind IN ('CALLS','INVOKES','MAY_INVOKE') OR sem IN ('CALLS','INVOKES','MAY_INVOKE')) AND src IS NOT NULL))"
_GUARDED = "V AS (SELECT DISTINCT src AS id FROM E WHERE (kind = 'GUARDED_BY' OR sem = 'GUARDED_BY') AND src IS NOT NULL)"


def _id(kind: str, *parts: str) -> str:
    joined = " || chr(0) || ".join(["'v2'", "'core'", "'graph'", f"'{kind}'", *parts])
    return f"'v2:core:graph:{kind}:' || substr(sha256({joined}), 1, 20)"


def _sem(*kinds: str) -> str:
    k = ", ".join(f"'{x}'" for x in kinds)
    return f"(kind IN ({k}) OR sem IN ({k})) AND src IS NOT NULL AND dst IS NOT NULL"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"{_NE}, {_OPEN} SELECT {_id('dynamic-behavior', 'call_id')} AS id, call_id, unit FROM U")
def dynamic_behaviours(spark: SparkSession, d: str) -> DataFrame:
    return rules.dynamic_behaviours(graph.load(spark, d))


@query(f"""{_NE}, T AS (SELECT DISTINCT src, dst AS target FROM E WHERE {_sem('CALLS', 'INVOKES')})
 SELECT {_id('call-context', 'N.id', "coalesce(target, 'unresolved')")} AS id, N.id AS call_id, target FROM N LEFT JOIN T ON T.src = N.id WHERE kind = 'call'""")
def call_contexts(spark: SparkSession, d: str) -> DataFrame:
    return rules.call_contexts(graph.load(spark, d))


@query(f"""WITH {_E}, M AS (SELECT id, json_extract_string(props, '$.model') AS model FROM builtin_nodes WHERE kind = 'function') SELECT DISTINCT src AS call_id, M.id AS model_id, model, CASE model {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.EFFECT_OF.items())} ELSE 'none' END AS effect
 FROM E JOIN M ON M.id = E.dst WHERE {_sem('CALLS', 'INVOKES')} AND model IS NOT NULL""")
def model_bindings(spark: SparkSession, d: str) -> DataFrame:
    return rules.model_bindings(graph.load(spark, d), table(spark, d, "builtin_nodes"))


@query(f"""{_NE}, B AS (SELECT DISTINCT src AS owner, dst AS id FROM E WHERE {_sem('CONTAINS_BODY')}), S AS (SELECT owner, B.id, json_extract_string(props, '$.control_kind') AS c, lead(B.id) OVER w AS f, row_number() OVER w AS p FROM B JOIN N ON N.id = B.id WHERE kind = 'statement' WINDOW w AS (PARTITION BY owner ORDER BY start_line NULLS FIRST, B.id))
 SELECT owner AS src, id AS dst, 'CFG_ENTRY' AS kind FROM S WHERE p = 1 UNION ALL SELECT id, f, 'CFG_NEXT' FROM S WHERE f IS NOT NULL AND coalesce(c <> 'return', true) UNION ALL SELECT id, id, 'LOOP_BACK' FROM S WHERE c IN ('for','while')
 UNION ALL SELECT id, f, 'FALSE_BRANCH' FROM S WHERE c IN ('if','for','while') AND f IS NOT NULL""")
def control_links(spark: SparkSession, d: str) -> DataFrame:
    return rules.control_links(graph.load(spark, d))


@query(f"""{_RNE}, X AS (SELECT DISTINCT src AS a, dst AS b FROM E WHERE {_sem('CFG_NEXT')}), Z AS (SELECT id, concat_ws('/', owner_function_id, label) AS v FROM N WHERE label IS NOT NULL AND owner_function_id IS NOT NULL),
 W AS (SELECT DISTINCT src AS id, v FROM E JOIN Z ON Z.id = dst WHERE {_sem('WRITES_TO')}), R AS (SELECT DISTINCT src AS pos, v FROM E JOIN Z ON Z.id = dst WHERE {_sem('READS_FROM')}),
 F(def_id, v, pos) AS (SELECT id, v, id FROM W UNION SELECT f.def_id, f.v, x.b FROM F f JOIN X x ON x.a = f.pos WHERE (f.def_id = f.pos OR NOT EXISTS (SELECT 1 FROM W w WHERE w.id = f.pos AND w.v = f.v)))
 SELECT DISTINCT def_id, F.v AS variable, F.pos AS use_id FROM F JOIN R ON R.pos = F.pos AND R.v = F.v WHERE F.def_id <> F.pos""")
def reaching_definitions(spark: SparkSession, d: str) -> DataFrame:
    return rules.reaching_definitions(graph.load(spark, d)).filter("def_id <> use_id")


@query(f"""{_RNE}, X AS (SELECT DISTINCT src AS a, dst AS b FROM E WHERE {_sem('CFG_NEXT')}), R(id) AS (SELECT a FROM X WHERE a NOT IN (SELECT b FROM X WHERE a <> b) UNION SELECT x.b FROM R r JOIN X x ON x.a = r.id)
 SELECT id FROM (SELECT a AS id FROM X UNION SELECT b FROM X) WHERE id NOT IN (SELECT id FROM R)""")
def unreachable_statements(spark: SparkSession, d: str) -> DataFrame:
    return rules.unreachable_statements(graph.load(spark, d))


@query(f"{_RNE}, {gq._PAIRS}, R(id) AS (SELECT caller FROM P WHERE callee IN (SELECT id FROM builtin_nodes WHERE kind = 'function') UNION SELECT p.caller FROM R r JOIN P p ON p.callee = r.id) SELECT id FROM R")
def sink_reach(spark: SparkSession, d: str) -> DataFrame:
    return rules.sink_reach(graph.load(spark, d), table(spark, d, "builtin_nodes"))


@query(f"""{_RNE}, {gq._PAIRS}, {gq._ENTRY}, {_GUARDED}, W(seed, node, distance) AS (SELECT id, id, 0 FROM R UNION SELECT w.seed, p.callee, w.distance + 1 FROM W w JOIN P p ON p.caller = w.node WHERE w.distance < 6),
 X AS (SELECT DISTINCT seed, node FROM W WHERE node IN (SELECT caller FROM P WHERE callee IN (SELECT id FROM builtin_nodes WHERE kind = 'function'))), Y AS (SELECT seed AS entry, count(*) AS effects, count(V.id) AS guarded_effects FROM X LEFT JOIN V ON V.id = X.node GROUP BY 1)
 SELECT *, CASE WHEN effects = guarded_effects THEN 'preserved' WHEN guarded_effects > 0 THEN 'differs' ELSE 'unguarded' END AS verdict FROM Y""")
def guard_differential(spark: SparkSession, d: str) -> DataFrame:
    return rules.guard_differential(graph.load(spark, d), table(spark, d, "builtin_nodes"), 6)


@query("""WITH RECURSIVE I AS (SELECT path, unnest(imports) AS i FROM files), L AS (SELECT DISTINCT path AS a, i.resolved_path AS b FROM I WHERE i.resolved_path IS NOT NULL AND path IS NOT NULL),
 W(id, other) AS (SELECT a, b FROM L UNION SELECT w.id, l.b FROM W w JOIN L l ON l.a = w.other), X AS (SELECT a AS id FROM L UNION SELECT b FROM L)
 SELECT x.id AS path, least(x.id, coalesce(min(w.other), x.id)) AS component FROM X x LEFT JOIN W w ON w.id = x.id AND EXISTS (SELECT 1 FROM W v WHERE v.id = w.other AND v.other = w.id) GROUP BY x.id""")
def import_cycles(spark: SparkSession, d: str) -> DataFrame:
    return traverse.strong_components(rules.import_links(table(spark, d, "files"))).select(F.col("id").alias("path"), "component")


_TIER_CASE = "CASE" + gq.ORACLE["tiers"].split("SELECT kind, CASE", 1)[1].split(" AS tier", 1)[0]


@query(f"{_NE}, T AS (SELECT id, {_TIER_CASE} AS tier FROM N) SELECT a.tier AS src_tier, b.tier AS dst_tier, sem AS kind, count(*)::BIGINT AS n FROM E JOIN T a ON a.id = src JOIN T b ON b.id = dst GROUP BY ALL")
def layered_edges(spark: SparkSession, d: str) -> DataFrame:
    return rules.layered_edges(graph.load(spark, d))


@query(f"""WITH {_E}, X AS (SELECT dst AS id, 'r' AS k FROM E WHERE (kind = 'READS_FROM' OR sem = 'READS_FROM') UNION ALL SELECT dst, 'w' FROM E WHERE (kind = 'WRITES_TO' OR sem = 'WRITES_TO') UNION ALL SELECT dst, 'i' FROM E WHERE (kind = 'VALUE_FLOWS_TO' OR sem = 'VALUE_FLOWS_TO')
 UNION ALL SELECT src, 'o' FROM E WHERE (kind = 'VALUE_FLOWS_TO' OR sem = 'VALUE_FLOWS_TO')) SELECT id, count(*) FILTER (WHERE k = 'r') AS reads, count(*) FILTER (WHERE k = 'w') AS writes, count(*) FILTER (WHERE k = 'i') AS flows_in, count(*) FILTER (WHERE k = 'o') AS flows_out FROM X WHERE id IS NOT NULL GROUP BY id""")
def field_roles(spark: SparkSession, d: str) -> DataFrame:
    return rules.field_roles(graph.load(spark, d))


@query(f"""WITH {_N}, {_SITES}, K AS (SELECT DISTINCT unit, callee_name, owner_id FROM C WHERE owner_id IS NOT NULL), O AS (SELECT unit, count(DISTINCT owner_id) AS owners FROM K GROUP BY 1)
 SELECT K.unit, callee_name, count(*) AS n_owners, any_value(owners) AS owners, CASE WHEN count(*) = 1 THEN 'unique' WHEN count(*) = any_value(owners) - 1 THEN 'missing' ELSE 'shared' END AS standing FROM K JOIN O ON O.unit = K.unit WHERE owners > 2 GROUP BY 1, 2""")
def peer_calls(spark: SparkSession, d: str) -> DataFrame:
    return rules.peer_calls(graph.load(spark, d))


@query(f"""{_NE}, {_OPEN} SELECT 'call-without-target' AS category, count(*) AS n FROM U HAVING count(*) > 0 UNION ALL SELECT 'diagnostic', count(*) FROM N WHERE kind = 'diagnostic' HAVING count(*) > 0
 UNION ALL SELECT 'unresolved-node', count(*) FROM N WHERE confidence = 'unresolved' HAVING count(*) > 0 UNION ALL SELECT 'unresolved-edge', count(*) FROM E WHERE lower(trim(confidence)) = 'unresolved' HAVING count(*) > 0""")
def unknowns(spark: SparkSession, d: str) -> DataFrame:
    return rules.unknowns(graph.load(spark, d))


@query(f"{_NE}, X AS (SELECT id, coalesce(unit, 'builtin') AS unit FROM N) SELECT a.unit AS src_unit, b.unit AS dst_unit, sem AS kind, count(*)::BIGINT AS n FROM E JOIN X a ON a.id = src JOIN X b ON b.id = dst WHERE a.unit <> b.unit GROUP BY ALL")
def boundary_edges(spark: SparkSession, d: str) -> DataFrame:
    return rules.boundary_edges(graph.load(spark, d))


@query(f"{_RNE}, {gq._PAIRS}, {_GUARDED}, W(id, distance) AS (SELECT id, 0::BIGINT FROM V UNION SELECT p.caller, w.distance + 1 FROM W w JOIN P p ON p.callee = w.id WHERE w.distance < 2) SELECT id, min(distance) AS distance FROM W GROUP BY id")
def near_guards(spark: SparkSession, d: str) -> DataFrame:
    return rules.near_guards(graph.load(spark, d))


@query(f"""{_RNE}, L AS (SELECT src AS a, dst AS b FROM E WHERE {_sem('VALUE_FLOWS_TO', 'READS_FROM', 'WRITES_TO', 'POINTS_TO')}), Y AS (SELECT a, b FROM L UNION SELECT b, a FROM L),
 W(seed, node, distance) AS (SELECT id, id, 0::BIGINT FROM N WHERE kind = 'heap-object' UNION SELECT w.seed, y.b, w.distance + 1 FROM W w JOIN Y y ON y.a = w.node WHERE w.distance < 4) SELECT seed, node, min(distance) AS distance FROM W GROUP BY 1, 2""")
def value_histories(spark: SparkSession, d: str) -> DataFrame:
    return rules.value_histories(graph.load(spark, d), 4)


@query("""WITH F AS (SELECT DISTINCT ON (file_id) * FROM files) SELECT file_id, coalesce(len(imports), 0) AS n_imports, coalesce(list_sum(list_transform(imports, lambda i: coalesce(len(i.bindings), 0))), 0)::BIGINT AS n_bindings, coalesce(len(exports), 0) AS n_exports, coalesce(len(functions), 0) AS n_functions FROM F""")
def file_infos(spark: SparkSession, d: str) -> DataFrame:
    return rules.file_infos(table(spark, d, "files"))


@query("""WITH F AS (SELECT DISTINCT ON (file_id) file_id, text, functions FROM files WHERE text IS NOT NULL), X AS (SELECT file_id, text, unnest(functions) AS f FROM F)
 SELECT file_id, f.id AS function_id, array_to_string(list_slice(string_split(text, chr(10)), greatest(f.start_line, 1), f.end_line), chr(10)) AS body FROM X WHERE f IS NOT NULL AND f.start_line IS NOT NULL AND f.end_line IS NOT NULL""")
def function_bodies(spark: SparkSession, d: str) -> DataFrame:
    return rules.function_bodies(table(spark, d, "files"))


# -- sources and streams
def _python(spark: SparkSession, d: str) -> DataFrame:
    from weftgraph.plans.durable import durable
    from weftgraph.sources.pyfacts import python_facts

    return durable(python_facts(table(spark, d, "files")), "python-facts")


@query()
def python_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Declarations, definitions, reads, calls, statements and values of the kept Python texts."""
    return _python(spark, d).filter("fact = 'node'").select("file_id", "id", "kind", "label", "owner_id", F.col("a").alias("start_offset"), F.col("b").alias("end_offset"), "line", "props")


@query()
def python_edges(spark: SparkSession, d: str) -> DataFrame:
    """Scopes, control flow and value flow of the kept Python texts."""
    return _python(spark, d).filter("fact = 'edge'").select("file_id", "src", "dst", "kind", "reason", "props")


@query()
def python_imports(spark: SparkSession, d: str) -> DataFrame:
    """What the imports of Python files lead to."""
    from weftgraph.sources.pyfacts import import_targets

    return import_targets(_python(spark, d), table(spark, d, "files"))


@query()
def python_overrides(spark: SparkSession, d: str) -> DataFrame:
    from weftgraph.sources.pyfacts import overrides

    return overrides(_python(spark, d))


@query()
def python_calls(spark: SparkSession, d: str) -> DataFrame:
    """What the calls in Python texts may reach, by name, class and number of candidates."""
    from weftgraph.sources.pyfacts import call_candidates

    return call_candidates(_python(spark, d))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    from weftgraph.streaming.events import windowed_counts

    return windowed_counts(table(spark, d, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT file_id, i.source AS imported, i.source_kind AS source_kind, count(*) AS n_bindings FROM (SELECT DISTINCT ON (file_id) file_id, imports FROM files), unnest(imports) AS u(i) WHERE i IS NOT NULL GROUP BY 1, 2, 3")
def file_imports(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files").dropDuplicates(["file_id"]).select("file_id", F.explode("imports").alias("i")).filter("i is not null")
    return f.groupBy("file_id", F.col("i.source").alias("imported"), F.col("i.source_kind").alias("source_kind")).agg(F.count(F.lit(1)).alias("n_bindings"))


@query()
def member_paths(spark: SparkSession, d: str) -> DataFrame:
    """Access paths of the member expressions in the kept texts, written or read."""
    return paths.member_paths(table(spark, d, "files"))


@query()
def path_uses(spark: SparkSession, d: str) -> DataFrame:
    """How often each field of each base is written and read in a file."""
    return paths.path_uses(paths.member_paths(table(spark, d, "files")))


@query()
def reads_of_writes(spark: SparkSession, d: str) -> DataFrame:
    """How each read of a member meets the last write before it to its base."""
    return paths.reads_of_writes(paths.member_paths(table(spark, d, "files")))
