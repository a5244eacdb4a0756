"""Deeply nested records to related flat tables by shared inlining.

Records are opened into elements (containers and scalars) with their paths. The distinct path
patterns, with list positions struck out, are the schema graph. Elements that are list items,
shared by several parents or nested in themselves become tables of their own; all singletons are
inlined into the row of the nearest table above. Rows carry the record and the row they came from.

Defined cases: null or malformed properties give no rows; null scalars give no rows, empty strings
do; repeated records (equal record number or file) count once; records without a key are one
record; null arrays and null array items give no rows, later items keep their positions; text that
holds JSON stays one scalar; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.functions import wirejson
from weftgraph.plans.durable import durable

ELEMENTS = "origin string, record_key string, path array<string>, type string, value string"
#: Path patterns up to which the schema plan is joined by broadcast (about 10 MB).
BROADCAST_PATTERNS = 50_000


_ARROW = pa.schema([("origin", pa.string()), ("record_key", pa.string()), ("path", pa.list_(pa.string())), ("type", pa.string()), ("value", pa.string())])
#: Elements of one batch that leaves a task.
BATCH = 20_000


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made(rows: list[tuple]) -> pa.RecordBatch:
        keys, paths, types, values = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(["wire"] * len(rows), pa.string()), pa.array(keys, pa.string()), pa.array(paths, pa.list_(pa.string())), pa.array(types, pa.string()), pa.array(values, pa.string())], schema=_ARROW)

    out: list[tuple] = []
    for b in batches:
        for key, text, version in zip(*(b.column(i).to_pylist() for i in range(3))):
            props = wirejson.decode(text, version)
            if props is not None:
                k = None if key is None else str(key)
                out += [(k, p, t, v) for p, t, v in wirejson.walk(props)]
                if len(out) > BATCH:
                    yield made(out)
                    out = []
    if out:
        yield made(out)


def versioned_records(wire: DataFrame, shards: DataFrame) -> DataFrame:
    """Each record once, with the format version of its shard (null if the shard is not known)."""
    v = shards.filter(F.col("shard_id").isNotNull()).groupBy("shard_id").agg(F.max("format_version").alias("format_version"))
    once = wire.select("record_no", "shard_id", "id", "properties").dropDuplicates(["record_no"])
    return once.join(v, "shard_id", "left")


def wire_elements(wire: DataFrame, shards: DataFrame) -> DataFrame:
    """Elements of all properties; the root object of a record has the empty path."""
    return versioned_records(wire, shards).select("record_no", "properties", "format_version").mapInArrow(_open, ELEMENTS)


def _struct_elements(x: Column, path: Column, t: T.DataType) -> Column:
    """Array of (path, type, value) of the not-null elements of a column, by built-in functions only."""
    none = F.lit(None).cast("string")
    if isinstance(t, T.StructType):
        own = F.array(F.struct(path.alias("path"), F.lit("object").alias("type"), none.alias("value")))
        parts = [_struct_elements(x[f.name], F.concat(path, F.array(F.lit(f.name))), f.dataType) for f in t.fields]
        found = F.concat(own, *parts)
    elif isinstance(t, T.ArrayType):
        own = F.array(F.struct(path.alias("path"), F.lit("list").alias("type"), none.alias("value")))
        items = F.flatten(F.transform(x, lambda y, i: _struct_elements(y, F.concat(path, F.array(F.concat(F.lit("["), i.cast("string"), F.lit("]")))), t.elementType)))
        found = F.concat(own, items)
    else:
        kind = {"string": "text", "bigint": "integer", "int": "integer", "double": "real", "boolean": "boolean"}.get(t.simpleString(), "text")
        found = F.array(F.struct(path.alias("path"), F.lit(kind).alias("type"), x.cast("string").alias("value")))
    return F.when(x.isNotNull(), found).otherwise(F.array().cast("array<struct<path:array<string>,type:string,value:string>>"))


def import_elements(files: DataFrame) -> DataFrame:
    """Elements of the imports of each file."""
    once = files.select("file_id", "imports").dropDuplicates(["file_id"])
    t = once.schema["imports"].dataType
    found = F.explode(_struct_elements(F.col("imports"), F.array().cast("array<string>"), t))
    return once.select(F.lit("import").alias("origin"), F.col("file_id").alias("record_key"), found.alias("e")).select("origin", "record_key", "e.path", "e.type", "e.value")


def leaves(elements: DataFrame) -> DataFrame:
    """(origin, record_key, leaf_path, type, value) of the scalars."""
    return elements.filter(~F.col("type").isin("object", "list")).select("origin", "record_key", F.array_join("path", "/").alias("leaf_path"), "type", "value")


def pattern_of(path: Column) -> Column:
    return F.transform(path, lambda s: F.regexp_replace(s, r"^\[\d+\]$", "[]"))


def schema_graph(elements: DataFrame) -> DataFrame:
    """(origin, pattern, type, n): the distinct path patterns with list positions struck out."""
    return elements.groupBy("origin", pattern_of(F.col("path")).alias("pattern"), "type").agg(F.count(F.lit(1)).alias("n"))


def inlining_plan(patterns: list[tuple[str, tuple[str, ...], str]]) -> dict[tuple[str, tuple[str, ...]], tuple[str, tuple[str, ...], str]]:
    """For each (origin, pattern): (table, pattern of the table's element, column).

    A table starts at the root, at every list item, at every object nested in one of its own name
    and at every object whose name and inner names stand under several parents.
    """
    kinds: dict[tuple[str, tuple[str, ...]], set[str]] = defaultdict(set)
    inner: dict[tuple[str, tuple[str, ...]], set[str]] = defaultdict(set)
    for origin, p, kind in patterns:
        kinds[origin, p].add(kind)
        if p:
            inner[origin, p[:-1]].add(p[-1])
    shapes: dict[tuple[str, str, frozenset], set[tuple[str, ...]]] = defaultdict(set)
    for (origin, p), ks in kinds.items():
        if p and "object" in ks and p[-1] != "[]":
            shapes[origin, p[-1], frozenset(inner[origin, p])].add(p[:-1])
    starts: dict[tuple[str, tuple[str, ...]], str] = {}
    for origin, p in kinds:
        named = [s for s in p if s != "[]"]
        last = named[-1] if named else "record"
        if not p:
            starts[origin, p] = f"{origin}_record"
        elif p[-1] == "[]":
            starts[origin, p] = f"{origin}_{last}" if named.count(last) > 1 else f"{origin}_{'_'.join(named) or 'item'}"
        elif "object" in kinds[origin, p] and (named.count(last) > 1 or len(shapes[origin, last, frozenset(inner[origin, p])]) > 1):
            starts[origin, p] = f"{origin}_{last}"
    plan = {}
    for origin, p in kinds:
        cut = next(k for k in range(len(p), -1, -1) if (origin, p[:k]) in starts or k == 0)
        plan[origin, p] = (starts.get((origin, p[:cut]), f"{origin}_record"), p[:cut], ".".join(p[cut:]) or "value")
    return plan


def _cells(elements: DataFrame) -> DataFrame:
    """The cells of :func:`flat_cells` with their ``origin``, the length ``cut`` of the row's path and the ``steps`` of the column."""
    spark = elements.sparkSession
    elements = durable(elements, "elements")  # opened once, read for the schema and for the cells
    graph = [(r["origin"], tuple(r["pattern"]), r["type"]) for r in schema_graph(elements).collect()]  # the schema's size, not the data's
    plan = inlining_plan(graph)
    starts = {(o, cut) for (o, _), (_, cut, _) in plan.items()}
    rows = []
    for (o, p), (name, cut, column) in plan.items():
        above = next((k for k in range(len(cut) - 1, -1, -1) if (o, cut[:k]) in starts), -1)
        rows.append((o, list(p), name, len(cut), above, column, list(p[len(cut) :])))
    plan_df = spark.createDataFrame(rows, "origin string, pattern array<string>, table_name string, cut int, above int, column_name string, steps array<string>")
    if len(rows) <= BROADCAST_PATTERNS:
        plan_df = F.broadcast(plan_df)
    scalar = ~F.col("type").isin("object", "list")
    starts_row = F.size("path") == F.col("cut")
    j = elements.withColumn("pattern", pattern_of(F.col("path"))).join(plan_df, ["origin", "pattern"])
    return j.filter(scalar | starts_row).select(
        "origin",
        "table_name",
        "record_key",
        F.array_join(F.slice("path", F.lit(1), F.col("cut")), "/").alias("row_path"),
        F.when(F.col("above") >= 0, F.array_join(F.slice("path", F.lit(1), F.greatest("above", F.lit(0))), "/")).alias("parent_path"),
        F.when(scalar, F.col("column_name")).alias("column_name"),
        F.when(scalar, F.col("type")).alias("type"),
        "value",
        "cut",
        "steps",
    )


def flat_cells(elements: DataFrame) -> DataFrame:
    """(table_name, record_key, row_path, parent_path, column_name, type, value): the flat tables, one row per cell.

    ``row_path`` and ``parent_path`` with ``record_key`` are a row's key and its foreign key. A
    container that starts a row without a scalar of its own gives a cell without a column.
    """
    return _cells(elements).drop("origin", "cut", "steps")


def inlined_leaves(elements: DataFrame) -> DataFrame:
    """(origin, record_key, leaf_path, type, value) of the scalars in the flat tables: the row's path and the column's steps."""
    below = F.array_join("steps", "/")
    path = F.when(F.col("cut") == 0, below).when(F.size("steps") == 0, F.col("row_path")).otherwise(F.concat_ws("/", "row_path", below))
    return _cells(elements).filter("column_name is not null").select("origin", "record_key", path.alias("leaf_path"), "type", "value")


def flat_tables(elements: DataFrame) -> dict[str, DataFrame]:
    """The flat tables by name, one column per inlined scalar."""
    cells = flat_cells(elements)
    columns = defaultdict(list)
    for t, c in sorted(tuple(r) for r in cells.select("table_name", "column_name").filter("column_name is not null").distinct().collect()):
        columns[t].append(c)
    names = [r[0] for r in cells.select("table_name").distinct().collect()]
    return {n: cells.filter(F.col("table_name") == n).groupBy("record_key", "row_path", "parent_path").pivot("column_name", columns[n]).agg(F.max("value")) if columns[n] else cells.filter(F.col("table_name") == n).select("record_key", "row_path", "parent_path").distinct() for n in names}
