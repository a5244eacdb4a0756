"""Queries of the core problems and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import drift, flatten, hierarchy, keycounts, references
from weftgraph.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _links(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.containment_links(table(spark, d, "edges"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Root and depth of every node of the containment forest; depth -1 on and below cycles."""
    return hierarchy.resolve_links(_links(spark, d)).select(F.col("node").alias("node_id"), F.col("root").alias("root_id"), "depth")


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    """Full path of every node of the forest, outermost first, joined with ' > '."""
    r = hierarchy.resolve_links(_links(spark, d), paths=True)
    return r.filter(F.col("path").isNotNull()).select(F.col("node").alias("node_id"), F.array_join("path", " > ").alias("path"), "depth")


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All descendants of every node of the forest with their distance."""
    r = hierarchy.resolve_links(_links(spark, d), paths=True)
    return hierarchy.descendants(r).select(F.col("ancestor").alias("ancestor_id"), F.col("node").alias("node_id"), F.col("distance").cast("long").alias("distance"))


def p1_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Nodes caught in loops, told apart: on a cycle, or only below one."""
    links = _links(spark, d)
    links = links.filter(F.col("child").isNotNull() & F.col("parent").isNotNull())
    return hierarchy.cycle_members(links, hierarchy.resolve_links(links)).select(F.col("node").alias("node_id"), "on_cycle")


def _orphans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    refs = references.edge_references(table(spark, d, "edges"))
    return references.orphans(refs, table(spark, d, "nodes"), table(spark, d, "builtin_nodes")), refs


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Ends of edges whose record is missing, late or deleted."""
    return _orphans(spark, d)[0].select("row_id", "side", "cause")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans and all references of the table per end, month and cause."""
    return references.orphan_report(*_orphans(spark, d)).select(F.lit("edges").alias("table_name"), "side", "month", "cause", "n_refs")


def _elements(spark: SparkSession, d: str) -> DataFrame:
    wire = flatten.wire_elements(table(spark, d, "wire_nodes"), table(spark, d, "shards"))
    return wire.unionByName(flatten.import_elements(table(spark, d, "files")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Paths of the scalars of all nested records, as the flat tables hold them: row and inlined column."""
    return flatten.inlined_leaves(_elements(spark, d)).select("origin", "record_key", "leaf_path")


def p4_tables(spark: SparkSession, d: str) -> DataFrame:
    """The flat tables as cells, each with the key of its row and of the row above."""
    return flatten.flat_cells(_elements(spark, d))


def p4_schema(spark: SparkSession, d: str) -> DataFrame:
    """The schema graph: path patterns with their types and numbers of elements."""
    g = flatten.schema_graph(_elements(spark, d))
    return g.select("origin", F.array_join("pattern", "/").alias("pattern"), "type", "n")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Fields added, removed, renamed and retyped from shard to shard."""
    return drift.schema_changes(table(spark, d, "wire_nodes"), table(spark, d, "shards"))


def p6_matches(spark: SparkSession, d: str) -> DataFrame:
    """Fields that correspond by similarity flooding, their scores, and whether the values bear a rename out."""
    return drift.correspondences(table(spark, d, "wire_nodes"), table(spark, d, "shards"))


def p6_table(spark: SparkSession, d: str) -> DataFrame:
    """All records of complete shards in one consistent table of named, typed values."""
    return drift.consistent_table(table(spark, d, "wire_nodes"), table(spark, d, "shards"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Values that hold at least 2.5 percent of the rows of their table."""
    return keycounts.heavy_values(table(spark, d, "edges"), table(spark, d, "nodes")).select("table_name", "field", "key_value")


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows per value of edges.kind, edges.dst and nodes.kind."""
    counts, _ = keycounts.key_counts(table(spark, d, "edges"), table(spark, d, "nodes"))
    return counts.select("table_name", "field", "key_value", "n")


def p7_profile(spark: SparkSession, d: str) -> DataFrame:
    """Rows, distinct sources and time range per value of edges.kind and edges.dst."""
    e = table(spark, d, "edges")
    return keycounts.edge_profile(e, "kind").unionByName(keycounts.edge_profile(e, "dst"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_paths, p1_descendants, p1_cycles, p3_found, p3_report, p4_found, p4_tables, p4_schema, p6_found, p6_matches, p6_table, p7_found, p7_counts, p7_profile)}

_LINKS = """links AS (SELECT DISTINCT dst AS child, src AS parent FROM edges
 WHERE coalesce(semantic_kind, kind) IN ('PACKAGE_CONTAINS','CONTAINS','CONTAINS_BODY','AST_CHILD')
 AND src IS NOT NULL AND dst IS NOT NULL),
 ends AS (SELECT child AS node FROM links UNION SELECT parent FROM links),
 above(node, anc) AS (SELECT child, parent FROM links UNION SELECT a.node, l.parent FROM above a JOIN links l ON l.child = a.anc),
 looped AS (SELECT DISTINCT node FROM above WHERE node = anc),
 caught AS (SELECT node, min(c) AS root FROM (SELECT node, node AS c FROM looped UNION ALL SELECT a.node, a.anc FROM above a JOIN looped l ON l.node = a.anc) GROUP BY node),
 sound AS (SELECT * FROM links WHERE child NOT IN (SELECT node FROM caught)),
 walk(node, anc, dist) AS (SELECT child, parent, 1::BIGINT FROM sound UNION SELECT w.node, l.parent, w.dist + 1 FROM walk w JOIN sound l ON l.child = w.anc),
 forest AS (SELECT node, min_by(anc, {'d': dist, 'a': anc}) AS root, min(dist) AS depth FROM walk WHERE anc NOT IN (SELECT child FROM sound) GROUP BY node)"""

_REFS = """refs AS (SELECT row_id, 'src' AS side, src AS id, recorded_at AS t FROM edges WHERE src IS NOT NULL
 UNION ALL SELECT row_id, 'dst', dst, recorded_at FROM edges WHERE dst IS NOT NULL),
 lives AS (SELECT id, min(recorded_at) AS first_at, min(retired_at) AS retired_at FROM nodes WHERE id IS NOT NULL GROUP BY id),
 judged AS (SELECT row_id, side, t, CASE WHEN l.id IS NULL THEN 'missing' WHEN first_at > t THEN 'late' WHEN l.retired_at <= t THEN 'deleted' END AS cause
 FROM refs r LEFT JOIN lives l ON l.id = r.id WHERE r.id NOT IN (SELECT id FROM builtin_nodes WHERE id IS NOT NULL))"""

_COUNTS = """counts AS (SELECT 'edges' AS table_name, 'kind' AS field, kind AS key_value, count(*) AS n, (SELECT count(*) FROM edges) AS total FROM edges GROUP BY kind
 UNION ALL SELECT 'edges', 'dst', dst, count(*), (SELECT count(*) FROM edges) FROM edges GROUP BY dst
 UNION ALL SELECT 'nodes', 'kind', kind, count(*), (SELECT count(*) FROM nodes) FROM nodes GROUP BY kind)"""

_PROFILE = "SELECT '{f}' AS field, {f} AS key_value, count(*) AS n, count(DISTINCT src) AS n_src, min(recorded_at) AS first_at, max(recorded_at) AS last_at FROM edges WHERE {f} IS NOT NULL GROUP BY {f}"

ORACLE: dict[str, str] = {
    "p1_found": f"""WITH RECURSIVE {_LINKS}
 SELECT e.node AS node_id, coalesce(c.root, f.root, e.node) AS root_id, CASE WHEN c.root IS NOT NULL THEN -1 ELSE coalesce(f.depth, 0) END::BIGINT AS depth
 FROM ends e LEFT JOIN caught c ON c.node = e.node LEFT JOIN forest f ON f.node = e.node""",
    "p1_descendants": f"WITH RECURSIVE {_LINKS} SELECT anc AS ancestor_id, node AS node_id, min(dist) AS distance FROM walk GROUP BY ALL",
    "p1_paths": f"""WITH RECURSIVE {_LINKS}
 SELECT e.node AS node_id, coalesce(string_agg(w.anc, ' > ' ORDER BY w.dist DESC) || ' > ', '') || e.node AS path, coalesce(max(w.dist), 0)::BIGINT AS depth
 FROM ends e LEFT JOIN walk w ON w.node = e.node WHERE e.node NOT IN (SELECT node FROM caught) GROUP BY e.node""",
    "p1_cycles": f"WITH RECURSIVE {_LINKS} SELECT node AS node_id, node IN (SELECT node FROM looped) AS on_cycle FROM caught",
    "p3_found": f"WITH {_REFS} SELECT row_id, side, cause FROM judged WHERE cause IS NOT NULL",
    "p3_report": f"""WITH {_REFS} SELECT 'edges' AS table_name, side, strftime(t, '%Y-%m') AS month, cause, count(*) AS n_refs FROM judged WHERE cause IS NOT NULL GROUP BY ALL
 UNION ALL SELECT 'edges', side, strftime(t, '%Y-%m'), 'any', count(*) FROM refs GROUP BY ALL""",
    "p7_found": f"WITH {_COUNTS} SELECT table_name, field, key_value FROM counts WHERE key_value IS NOT NULL AND n >= 0.025 * total",
    "p7_counts": f"WITH {_COUNTS} SELECT table_name, field, key_value, n FROM counts",
    "p7_profile": f"{_PROFILE.format(f='kind')} UNION ALL {_PROFILE.format(f='dst')}",
}
