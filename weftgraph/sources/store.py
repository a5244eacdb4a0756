"""The stored graph: parquet partitioned by kind, a manifest, publication by a pointer, incremental digests, overlays, a cache by content.

A store is a folder of versions and one small pointer file that names the current one. A new version
is written in full beside the others, then the pointer is replaced in one step; a crash at any time
leaves the old version or the new one, never none. Readers that hold the old version go on reading it
until it is dropped.
"""

from __future__ import annotations

import hashlib
import json
import re
import subprocess
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftgraph.graph import Graph, bag_hash

FORMAT_VERSION = 1
#: Kinds that the store leaves out.
PRUNED_KINDS = ("token", "source-span")
# Folders of dependencies, builds and tools.
PRUNED_FOLDERS = tuple(
    """.git node_modules graph_out dist build .venv venv __pycache__ .tox .nox .mypy_cache .pytest_cache .ruff_cache site-packages .eggs .next .nuxt
    .svelte-kit .output .turbo .angular .cache coverage htmlcov .gradle target bazel-out""".split()
)


class StoreMismatch(ValueError):
    """The folder holds no store, or one of another format."""


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


#: Kinds that a store may leave out as well, if asked to, and kinds of edges that most questions read.
DIAGNOSTIC_KINDS = ("diagnostic",)
HOT_EDGES = ("CALLS", "INVOKES", "MAY_INVOKE", "CONTAINS", "CONTAINS_BODY", "AST_CHILD", "VALUE_FLOWS_TO", "POINTS_TO", "CFG_NEXT")
POINTER = "CURRENT"


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, where = _fs(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return bytes(b & 0xFF for b in stream.readAllBytes()).decode()
    finally:
        stream.close()


def _put_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file in one step: write it beside, then rename over it."""
    fs, where = _fs(spark, path)
    _, beside = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(beside, where, options)


def _current(spark: SparkSession, path: str) -> str:
    name = _read_text(spark, f"{path.rstrip('/')}/{POINTER}")
    if name is None:
        raise StoreMismatch(f"no store at {path}")
    return f"{path.rstrip('/')}/{name.strip()}"


def _open(spark: SparkSession, at: str, shape: dict) -> Graph:
    table = lambda name: spark.read.schema(StructType.fromJson(shape[name])).parquet(f"{at}/{name}")
    return Graph(table("nodes"), table("edges").drop("heat"))


def write_store(g: Graph, path: str, drop_diagnostics: bool = False, drop_tests: bool = False, keep: int = 1) -> str:
    """Write a version of the store and make it the current one; older versions but the last ``keep`` are dropped. Returns its folder.

    Nodes are partitioned by kind; edges by whether most questions read them, then by kind.
    """
    from weftgraph.operators.navigate import is_test_path

    spark = g.nodes.sparkSession
    root = path.rstrip("/")
    name = f"v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    kept = g.nodes.filter(~F.col("kind").isin(*PRUNED_KINDS, *(DIAGNOSTIC_KINDS if drop_diagnostics else ())))
    if drop_tests and "file" in kept.columns:
        kept = kept.filter(~is_test_path(F.col("file")))
    kept.write.partitionBy("kind").option("compression", "zstd").parquet(f"{root}/{name}/nodes")
    hot = g.edges.withColumn("heat", F.when(F.col("kind").isin(*HOT_EDGES), "hot").otherwise("cold"))
    hot.write.partitionBy("heat", "kind").option("compression", "zstd").parquet(f"{root}/{name}/edges")
    # the schemas are kept, since a table without rows has no file to tell it
    shape = {"nodes": json.loads(kept.schema.json()), "edges": json.loads(hot.schema.json())}
    facts = bag_hash(_open(spark, f"{root}/{name}", shape)).first().asDict() | {"format_version": FORMAT_VERSION, "schema": shape}
    _put_text(spark, f"{root}/{name}/manifest", json.dumps(facts))
    before = versions(spark, path)
    _put_text(spark, f"{root}/{POINTER}", name)
    fs, _ = _fs(spark, root)
    for old in [v for v in before if v != name][: max(0, len(before) - 1 - keep)]:
        fs.delete(_fs(spark, f"{root}/{old}")[1], True)
    return f"{root}/{name}"


def versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the versions that the folder holds, the oldest first."""
    fs, where = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory() and s.getPath().getName().startswith("v-")) if fs.exists(where) else []


def read_manifest(spark: SparkSession, path: str) -> dict:
    try:
        facts = json.loads(_read_text(spark, f"{_current(spark, path)}/manifest") or "")
    except ValueError as e:
        raise StoreMismatch(f"no manifest at {path}") from e
    if facts.get("format_version") != FORMAT_VERSION:
        raise StoreMismatch(f"format {facts.get('format_version')}, need {FORMAT_VERSION}")
    return facts


def read_store(spark: SparkSession, path: str) -> Graph:
    """The stored graph; filters on kind prune partitions, selections prune columns."""
    return _open(spark, _current(spark, path), read_manifest(spark, path)["schema"])


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """(id, kind, file) of all nodes: a scan of three columns."""
    return read_store(spark, path).nodes.select("id", "kind", "file")


def composite(*graphs: Graph) -> Graph:
    """Several stored graphs as one, an id and an edge of several of them once; the first graph that has it wins."""
    def once(tables: list[DataFrame], key: list[str]) -> DataFrame:
        every = None
        for i, t in enumerate(tables):
            t = t.withColumn("__at", F.lit(i))
            every = t if every is None else every.unionByName(t, allowMissingColumns=True)
        rest = [c for c in every.columns if c not in (*key, "__at")]
        return every.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col("__at")).alias("x")).select(*key, *[F.col(f"x.{c}").alias(c) for c in rest])

    return Graph(once([g.nodes for g in graphs], ["id"]), once([g.edges for g in graphs], ["kind", "src", "dst"]))


class GraphCache:
    """Graphs by what they were made of: the digests of their files and of all else that bears on the result."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def key(self, files: DataFrame, environment: dict[str, str]) -> str:
        """A digest of (path, content_hash) of all files, in any order, and of the environment."""
        h = F.xxhash64("path", "content_hash").cast("decimal(38,0)")
        row = files.select("path", "content_hash").distinct().agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("a"), F.sum(F.xxhash64(F.lit(1), "content_hash", "path").cast("decimal(38,0)")).alias("b")).first()
        text = json.dumps([FORMAT_VERSION, row["n"], str(row["a"]), str(row["b"]), sorted(environment.items())])
        return hashlib.sha256(text.encode()).hexdigest()[:32]

    def get(self, key: str) -> Graph | None:
        try:
            return read_store(self.spark, f"{self.folder}/{key}")
        except StoreMismatch:
            return None

    def put(self, key: str, g: Graph) -> Graph:
        write_store(g, f"{self.folder}/{key}", keep=0)
        return read_store(self.spark, f"{self.folder}/{key}")

    def list(self) -> list[str]:
        fs, where = _fs(self.spark, self.folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory()) if fs.exists(where) else []

    def prune(self, keep: int) -> list[str]:
        """Drop all but the ``keep`` entries written last; returns the dropped ones."""
        fs, where = _fs(self.spark, self.folder)
        entries = sorted((s.getModificationTime(), s.getPath().getName()) for s in fs.listStatus(where) if s.isDirectory()) if fs.exists(where) else []
        dropped = [n for _, n in entries[: max(0, len(entries) - keep)]]
        for n in dropped:
            fs.delete(_fs(self.spark, f"{self.folder}/{n}")[1], True)
        return dropped


def changed_files(files: DataFrame, digests: DataFrame) -> DataFrame:
    """Files whose digest the manifest of an earlier build lacks: what an incremental build must read again."""
    return files.join(digests.select("file_id", "content_hash").distinct(), ["file_id", "content_hash"], "left_anti")


def apply_overlay(g: Graph, node_patch: DataFrame | None = None, new_nodes: DataFrame | None = None, new_edges: DataFrame | None = None) -> Graph:
    """A sidecar over a base graph: labels patched by id, derived rows added; nothing of the base is lost."""
    nodes, edges = g.nodes, g.edges
    if node_patch is not None:
        p = node_patch.groupBy("id").agg(F.max("label").alias("patched"))
        nodes = nodes.join(p, "id", "left").withColumn("label", F.coalesce("patched", "label")).drop("patched").select(*g.nodes.columns)
    if new_nodes is not None:
        nodes = nodes.unionByName(new_nodes.join(nodes.select("id"), "id", "left_anti"), allowMissingColumns=True)
    if new_edges is not None:
        edges = edges.unionByName(new_edges, allowMissingColumns=True)
    return Graph(nodes, edges)


def source_inventory(spark: SparkSession, root: str, include_tests: bool = True) -> DataFrame:
    """(path, bytes, modified) of the source files below a folder, without dependency and build folders."""
    from weftgraph.operators.navigate import is_test_path

    pruned = "(^|/)(" + "|".join(re.escape(d) for d in PRUNED_FOLDERS) + ")/"
    base = root.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).select(F.col("path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    # folders are judged below the root, so a root inside such a folder is read all the same
    below = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + re.escape(re.sub("^file:/+", "/", base)) + "/?", "")
    found = found.withColumn("below", below).filter(F.lower("path").rlike(r"\.(c|h|py|pyi|ts|tsx|js)$") & ~F.col("below").rlike(pruned))
    found = found if include_tests else found.filter(~is_test_path(F.col("below")))
    return found.drop("below")


def git_history(repository: str, skip: int = 0, n: int = 200) -> list[tuple[str, str, str, str]]:
    """(commit, author, date, subject) of a page of a repository's history, read by one command on the driver; a page is bounded by ``n``."""
    out = subprocess.run(["git", "-C", repository, "log", f"--skip={skip}", "-n", str(n), "--format=%H%x1f%an%x1f%aI%x1f%s"], capture_output=True, text=True, check=True).stdout
    return [tuple(line.split("\x1f", 3)) for line in out.splitlines() if line]


def load_catalog(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables sources, sinks, summaries and sanitizers of a catalogue of models in JSON lines; four empty ones where there is none.

    A model is (method, package, kind, endpoint). ``Argument[n]``, ``Argument[*]``, ``ReturnValue`` and
    ``Receiver`` tell where; ``a->b`` is a summary, or for the kind ``sanitizer`` a sanitizer. Keys are
    the method, or ``package.method`` where the package is not ``builtins``.
    """
    kind = "method string, package string, kind string, endpoint string"
    fs, where = _fs(spark, path)
    rows = spark.read.schema(kind).json(path) if fs.exists(where) else spark.createDataFrame([], kind)
    key = F.when(F.coalesce("package", F.lit("builtins")).isin("builtins", ""), F.col("method")).otherwise(F.concat_ws(".", "package", "method"))
    place = lambda c: F.when(c.startswith("Argument["), F.regexp_extract(c, r"\[(\d+|\*)\]", 1)).when(c == "ReturnValue", "return").when(c == "Receiver", "receiver")
    flow = F.split("endpoint", "->")
    rows = rows.filter("method is not null and endpoint is not null").withColumn("key", key)
    one = rows.filter(F.size(flow) == 1).select("key", "kind", place(F.trim("endpoint")).alias("place"))
    two = rows.filter(F.size(flow) == 2).select("key", "kind", place(F.trim(F.get(flow, F.lit(0)))).alias("from_place"), place(F.trim(F.get(flow, F.lit(1)))).alias("to_place"))
    return {"sources": one.filter("kind = 'source'"), "sinks": one.filter("kind = 'sink'"), "summaries": two.filter("kind <> 'sanitizer'"), "sanitizers": two.filter("kind = 'sanitizer'")}


def as_lines(df: DataFrame, compact: bool = False) -> DataFrame:
    """(value): rows as JSON, or as ``column=value`` text without the nulls, for a text sink."""
    if not compact:
        return df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    return df.select(F.concat_ws("  ", *[F.concat(F.lit(f"{c}="), F.col(f"`{c}`").cast("string")) for c in df.columns]).alias("value"))


def sink(df: DataFrame, where: str | None) -> DataFrame:
    """Rows written as parquet and read back, or kept as they are where no folder is named."""
    if where is None:
        return df
    df.write.mode("errorifexists").option("compression", "zstd").parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)
