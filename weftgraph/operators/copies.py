"""Copies into memory: how their size and place are spelled, what fits, and which patterns of use they make.

Spelling orders, it never suppresses: every copy is a row. Defined cases: a copy without a size argument is
unbounded; null or blank expressions are opaque; types that are no fixed array have no capacity; repeated
arguments count once; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.access import last_name
from weftgraph.plans.fixpoint import fixpoint

_STRINGS = r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'"
_SIZEOF = r"sizeof\s*(?:\([^()]*\)|\w+)"



def size_class(expression: Column, has_size: Column) -> Column:
    """What a size is made of, strings and sizes of types struck out first."""
    e = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(expression, F.lit("")), _STRINGS, ""), _SIZEOF, "1"))
    return (
        F.when(~has_size, "unbounded-no-length")
        .when(F.trim(F.coalesce(expression, F.lit(""))) == "", "opaque")
        .when(e.rlike(r"[\w)\]]\s*-(?!>)\s*[\w(]"), "arithmetic-subtraction")
        .when(e.rlike(r"[\w)\]]\s*(?:[+*/%]|<<|>>)\s*[\w(&*]"), "arithmetic")
        .when(e.rlike(r"^(?:0[xX][0-9a-fA-F]+|\d+)[uUlL]*$"), "constant")
        .when(e.rlike(r"\w\s*\("), "dynamic-call")
        .when(e.rlike(r"^[A-Za-z_]"), "dynamic-identifier")
        .otherwise("opaque")
    )


# How much each spelling of a size and of a destination is worth a look, and what a rank weighs.
SIZE_WORTH = {"unbounded-no-length": 1.0, "arithmetic-subtraction": 1.0, "arithmetic": 0.9, "dynamic-identifier": 0.75, "dynamic-call": 0.7, "opaque": 0.4, "constant": 0.2}
PLACE_WORTH = {"offset-write": 1.0, "unknown": 0.3}
CONFIDENCE_WORTH = {"exact": 1.0, "high": 1.0, "medium": 0.7, "low": 0.4}


def _worth(value: Column, table: dict[str, float], other: float) -> Column:
    out = F.lit(other)
    for k, v in table.items():
        out = F.when(value == k, v).otherwise(out)
    return out


def place_class(expression: Column) -> Column:
    """Where a copy writes, by how it is spelled."""
    e = F.trim(F.coalesce(expression, F.lit("")))
    return (
        F.when(e == "", "unknown")
        .when(e.rlike(r"[\w)\]]\s*\+\s*[\w(]"), "offset-write")
        .when(e.contains("["), "indexed-write")
        .when(e.rlike(r"^[*&]"), "indirect-write")
        .when(e.contains("->") | e.contains("."), "field-write")
        .otherwise("named-buffer")
    )


_ARRAY = r"^(.*?\S)\s*\[\s*(\d+)\s*\]$"
_BYTES = ("char", "signed char", "unsigned char", "int8_t", "uint8_t", "u8", "s8", "__u8", "__s8")


def capacity_status(type_: Column, size: Column) -> tuple[Column, Column]:
    """What is known of a destination's capacity against a literal size, and the capacity in bytes of arrays of one-byte elements."""
    t = F.trim(F.coalesce(type_, F.lit("")))
    count = F.when(t.rlike(_ARRAY), F.regexp_extract(t, _ARRAY, 2).cast("long"))
    element = F.regexp_replace(F.regexp_extract(t, _ARRAY, 1), r"\s+", " ")
    capacity = F.when(element.isin(*_BYTES), count)
    s = F.trim(F.coalesce(size, F.lit("")))
    literal = F.when(s.rlike(r"^0[xX][0-9a-fA-F]{1,15}$"), F.conv(F.substring(s, 3, 20), 16, 10).cast("long")).when(s.rlike(r"^\d{1,18}$"), s.cast("long"))
    status = F.when(count.isNull(), "unknown").when(capacity.isNull(), "capacity-known-in-elements").when(literal.isNull(), "capacity-known-size-unknown").when(literal > capacity, "exceeds-capacity").otherwise("within-capacity")
    return status, capacity


def copy_capacity(copies: DataFrame) -> DataFrame:
    """``copies`` (call_id, size, has_size, destination, type, confidence; a row per destination) as (call_id, size_class, place_class, status, capacity, rank): every copy once, its smallest destination and furthest spelling counting."""
    status, capacity = capacity_status(F.col("type"), F.col("size"))
    c = copies.withColumn("place", place_class(F.col("destination"))).withColumn("capacity", capacity).withColumn("status", status)
    order = F.when(F.col("capacity").isNotNull(), F.col("capacity")).otherwise(F.when(F.col("status") == "unknown", F.lit((1 << 62) + 1)).otherwise(F.lit(1 << 62)))
    worth = F.when(F.col("place") == "unknown", 0.3).when(F.col("place") == "offset-write", 1.0).otherwise(0.6)
    one = c.groupBy("call_id").agg(F.first("size").alias("size"), F.max("has_size").alias("has_size"), F.max("confidence").alias("confidence"), F.min_by(F.struct("status", "capacity"), order).alias("k"), F.max(F.struct(worth.alias("w"), "place")).alias("p"))
    one = one.withColumn("size_class", size_class(F.col("size"), F.col("has_size")))
    rank = 0.6 * _worth(F.col("size_class"), SIZE_WORTH, 0.4) + 0.2 * F.col("p.w") + 0.2 * _worth(F.col("confidence"), CONFIDENCE_WORTH, 0.5)
    return one.select("call_id", "size_class", F.col("p.place").alias("place_class"), F.col("k.status").alias("status"), F.col("k.capacity").alias("capacity"), F.round(rank, 4).alias("rank"))


# -- canonical callees and patterns -----------------------------------------------------------------
def canonical_names(aliases: DataFrame) -> DataFrame:
    """(alias, canonical): where chains of aliases (alias, name) end, over any number of steps; a chain that closes on itself ends at its least name."""
    a = aliases.filter("alias is not null and name is not null and alias <> name").filter(F.col("alias").rlike(r"^\w+$") & F.col("name").rlike(r"^\w+$")).groupBy("alias").agg(F.min("name").alias("name"))
    found, _ = fixpoint(a, lambda f: f.join(a.select(F.col("alias").alias("x"), F.col("name").alias("y")), f["name"] == F.col("x")).select("alias", F.col("y").alias("name")), ["alias", "name"])
    ends = found.join(a.select(F.col("alias").alias("name"), F.lit(True).alias("goes_on")), "name", "left")
    return ends.groupBy("alias").agg(F.min_by("name", F.struct(F.coalesce("goes_on", F.lit(False)).alias("g"), "name")).alias("canonical"))


def canonical_callees(calls: DataFrame, aliases: DataFrame) -> DataFrame:
    """``calls`` (call_id, callee, ...) with ``canonical``, the callee's bare name after all aliases."""
    named = calls.withColumn("bare", last_name(F.coalesce("callee", F.lit(""))))
    return named.join(canonical_names(aliases).withColumnRenamed("alias", "bare"), "bare", "left").withColumn("canonical", F.coalesce("canonical", "bare")).drop("bare")


# What decides whether a use of each kind of sink is a lead.
PATTERNS = {
    "reachability": tuple("command-injection code-injection sql-injection nosql-injection xss path-traversal ssrf template-injection deserialization format-string xxe open-redirect prototype-pollution ldap-injection xpath-injection redos".split()),
    "relational": ("alloc-size", "buffer-size", "buffer-write"),
    "presence": ("weak-crypto", "insecure-tls", "insecure-temp-file"),
}


def pattern_of(kind: Column, tainted: Column, bound: Column) -> Column:
    """The pattern that a use of a sink makes: reached by input, by input of unbounded length, or there at all; null if none."""
    t = F.coalesce(tainted, F.lit(False))
    return (
        F.when(kind.isin(*PATTERNS["reachability"]) & t, "reachability")
        .when(kind.isin(*PATTERNS["relational"]) & t & F.coalesce(bound == "unbounded", F.lit(False)), "relational")
        .when(kind.isin(*PATTERNS["presence"]), "presence")
    )


# -- types --------------------------------------------------------------------------------------------
def type_roles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(type, function, role): functions that take a type by a parameter of it, as constructor, destructor, mutator or consumer."""
    from weftgraph import schema

    p = nodes.filter("kind = 'parameter' and type is not null and owner_function_id is not null").select(F.lower("type").alias("type"), F.col("owner_function_id").alias("function")).distinct()
    write = edges.filter(schema.semantic_kind().isin("WRITES_TO", "WRITES_PARAMETER_PROPERTY", "MUTATES") & F.col("src").isNotNull()).select(F.col("src").alias("id")).distinct()
    by_edge = write.withColumnRenamed("id", "function")
    by_write = nodes.filter("kind = 'write' and owner_function_id is not null").select(F.col("owner_function_id").alias("function"))
    by_owned = nodes.select("id", F.col("owner_function_id").alias("function")).filter("function is not null").join(write, "id", "left_semi").select("function")
    changes = by_edge.unionByName(by_write).unionByName(by_owned).distinct().withColumn("changes", F.lit(True))
    f = nodes.filter(F.col("kind").isin(*schema.CALLABLE_KINDS)).select(F.col("id").alias("function"), "kind", F.lower(F.coalesce("label", F.lit(""))).alias("name"))
    role = F.when((F.col("kind") == "constructor") | F.col("name").isin("__init__", "new", "create"), "constructor").when(F.col("name").rlike("free|destroy|dispose|close|release"), "destructor").when(F.col("changes"), "mutator").otherwise("consumer")
    return p.join(f, "function").join(changes, "function", "left").select("type", "function", role.alias("role"))
