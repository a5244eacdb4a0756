"""The property graph: one row per node and edge identity, composition, validation, subgraphs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import schema
from weftgraph.plans.durable import durable
from weftgraph.sources.tables import table

NODE_COLUMNS = ("kind", "file", "absolute_file", "start_line", "end_line", "start_offset", "end_offset", "owner_function_id", "function_id", "type", "package_name", "unit", "language", "fact_origin", "props")


@dataclass(frozen=True)
class Graph:
    """Two lazy tables: nodes by unique id, edges by unique identity."""

    nodes: DataFrame
    edges: DataFrame

    def semantic(self, *kinds: str) -> DataFrame:
        """Edges of the kinds, as stored or as meant."""
        # two plain tests, which a scan can pass over its pages by; a meaning that is null is the kind
        return self.edges.filter(F.col("kind").isin(*kinds) | F.col("semantic_kind").isin(*kinds))

    def induced(self, keep: DataFrame) -> Graph:
        """The subgraph of the kept ids: an edge stays iff both its ends do."""
        ids = keep.select("id").distinct()
        edges = self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return Graph(self.nodes.join(ids, "id", "left_semi"), edges)


def compose_nodes(*tables: DataFrame) -> DataFrame:
    """One row per id: the label of the latest delivery, the least value of all else, all spread by partial aggregation."""
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    latest = F.max_by("label", F.struct("recorded_at", "label")).alias("label")
    return every.filter(F.col("id").isNotNull()).groupBy("id").agg(*[F.min(c).alias(c) for c in NODE_COLUMNS], latest, F.min(F.lower(F.trim("confidence"))).alias("confidence"))


def node_conflicts(nodes: DataFrame) -> DataFrame:
    """(id, n_rows, n_labels): ids delivered with different content."""
    return nodes.filter(F.col("id").isNotNull()).groupBy("id").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("label").alias("n_labels")).filter("n_labels > 1")


def compose_edges(edges: DataFrame) -> DataFrame:
    """One row per identity (kind, src, dst, props): the first by row number.

    What says how an edge is walked stands apart from the rest, so that a walk doesn't carry the rest along.
    """
    rest = [c for c in edges.columns if c not in ("kind", "src", "dst", "props", "row_id", "evidence_ids")]
    part = {c: "w" if c in ("semantic_kind", "reason", "context_id") else "x" for c in rest}
    firsts = [F.min_by(F.struct(*[c for c in rest if part[c] == p]), "row_id").alias(p) for p in sorted(set(part.values()))]
    one = edges.groupBy("kind", "src", "dst", "props").agg(F.min("row_id").alias("row_id"), *firsts)
    return one.select("row_id", "kind", "src", "dst", "props", *[F.col(f"{part[c]}.{c}").alias(c) for c in rest])


def load(spark: SparkSession, d: str) -> Graph:
    return Graph(compose_nodes(table(spark, d, "nodes"), table(spark, d, "builtin_nodes")), compose_edges(table(spark, d, "edges")))


def kept(g: Graph) -> Graph:
    """The graph as written tables, for walks and rules that read it many times."""
    return Graph(durable(g.nodes, "nodes"), durable(g.edges, "edges"))


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(kind, side, n): edge ends that no node has, per kind; null ends count as dangling."""
    ends = edges.select("kind", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("id")) for s in ("src", "dst")])).alias("e")).select("kind", "e.*")
    per = ends.groupBy("kind", "side", "id").agg(F.count(F.lit(1)).alias("n"))  # a hot end becomes one row before the join
    return per.join(nodes.select("id"), "id", "left_anti").groupBy("kind", "side").agg(F.sum("n").alias("n"))


def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, n) of the rules that a delivery must keep, each table read once."""
    n = nodes.agg(
        F.count_if(schema.family(F.col("kind"), schema.NODE_KINDS) == "unknown").alias("node-kind-unknown"),
        F.count_if(F.col("id").isNull()).alias("node-without-id"),
        F.count_if(~F.col("id").startswith("v2:")).alias("node-identity-namespace"),
        F.count_if((F.coalesce("fact_origin", F.lit("")) != "compiler") & (F.coalesce(F.size("evidence_ids"), F.lit(0)) <= 0)).alias("node-without-evidence"),
        F.count_if(F.col("end_line") < F.col("start_line")).alias("node-span-reversed"),
    )
    e = edges.agg(
        F.count_if(schema.family(schema.semantic_kind(), schema.EDGE_KINDS) == "unknown").alias("edge-kind-unknown"),
        F.count_if(F.col("src").isNull() | F.col("dst").isNull()).alias("edge-without-end"),
        F.count_if((F.coalesce("fact_origin", F.lit("")) != "compiler") & (F.coalesce(F.size("evidence_ids"), F.lit(0)) <= 0)).alias("edge-without-evidence"),
        F.count_if((F.col("kind") == "EXPANDS_TO") & F.col("semantic_kind").isNull()).alias("edge-without-meaning"),
    )

    def long(df: DataFrame) -> DataFrame:
        return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(f"`{c}`").alias("n")) for c in df.columns])).alias("x")).select("x.rule", "x.n")

    return long(n).unionByName(long(e))


def bag_hash(graph: Graph) -> DataFrame:
    """(n_nodes, n_edges, node_hash, edge_hash): an order-free identity of ids and edge triples, aggregated in parts."""
    n = graph.nodes.select(F.lit(1).alias("n"), F.lit(0).alias("e"), F.xxhash64("id").alias("h"))
    e = graph.edges.select(F.lit(0).alias("n"), F.lit(1).alias("e"), F.xxhash64("kind", "src", "dst").alias("h"))
    part = lambda c: F.sum(F.when(F.col(c) == 1, F.col("h")).cast("decimal(38,0)")).cast("string")
    return n.unionByName(e).agg(F.sum("n").alias("n_nodes"), F.sum("e").alias("n_edges"), part("n").alias("node_hash"), part("e").alias("edge_hash"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): outgoing and incoming edges per id."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).filter(F.col("id").isNotNull())
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def overlay_join(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """Nodes of a fresh and a stored delivery, the fresh ones winning by id."""
    return fresh.unionByName(stored.join(fresh.select("id"), "id", "left_anti"))
