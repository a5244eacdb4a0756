from __future__ import annotations

from pyspark.sql import functions as F
from test_overlays import graph

from weftgraph.operators import copies


def test_sizes_and_places(spark):
    sizes = {"len - 1": "arithmetic-subtraction", "n*sizeof(int)": "arithmetic", "n << 2": "arithmetic", "len": "dynamic-identifier", "p->len": "dynamic-identifier", "strlen(s)": "dynamic-call", "sizeof(buf)": "constant", "0x10": "constant", '"a-b"': "opaque", "": "opaque", None: "opaque"}
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "e string, want string")
    assert [(r.e, r.got) for r in df.select("e", copies.size_class(F.col("e"), F.lit(True)).alias("got")).collect()] == list(sizes.items())
    assert df.select(copies.size_class(F.col("e"), F.lit(False)).alias("x")).distinct().first().x == "unbounded-no-length"
    places = {"buf + off": "offset-write", "buf[i]": "indexed-write", "*p": "indirect-write", "&x": "indirect-write", "s->b": "field-write", "s.b": "field-write", "buf": "named-buffer", " ": "unknown", None: "unknown"}
    df = spark.createDataFrame([(k, v) for k, v in places.items()], "e string, want string")
    assert [(r.e, r.got) for r in df.select("e", copies.place_class(F.col("e")).alias("got")).collect()] == list(places.items())


def test_capacity(spark):
    rows = [
        ("over", "64", True, "buf", "char [16]", "high"), ("over", "64", True, "big", "char [128]", "high"), ("fits", "0x10", True, "buf", "unsigned  char[16]", "low"), ("named", "n", True, "buf + k", "char[16]", "medium"), ("wide", "8", True, "a", "int [4]", None), ("ptr", "8", True, "p", "char *", "high"), ("none", None, False, "p", None, "exact"),
    ]
    got = {r.call_id: (r.status, r.capacity, r.size_class, r.place_class, r.rank) for r in copies.copy_capacity(spark.createDataFrame(rows, "call_id string, size string, has_size boolean, destination string, type string, confidence string")).collect()}
    assert got == {
        "over": ("exceeds-capacity", 16, "constant", "named-buffer", 0.44), "fits": ("within-capacity", 16, "constant", "named-buffer", 0.32), "named": ("capacity-known-size-unknown", 16, "dynamic-identifier", "offset-write", 0.79),
        "wide": ("capacity-known-in-elements", None, "constant", "named-buffer", 0.34), "ptr": ("unknown", None, "constant", "named-buffer", 0.44), "none": ("unknown", None, "unbounded-no-length", "named-buffer", 0.92),
    }


def test_names_and_patterns(spark):
    aliases = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("self", "self"), ("bad name", "c"), (None, "c")], "alias string, name string")
    assert {tuple(r) for r in copies.canonical_names(aliases).collect()} == {("a", "c"), ("b", "c"), ("x", "x"), ("y", "x")}
    calls = spark.createDataFrame([("1", "m.a(z)"), ("2", "other"), ("3", None)], "call_id string, callee string")
    assert {(r.call_id, r.canonical) for r in copies.canonical_callees(calls, aliases).collect()} == {("1", "c"), ("2", "other"), ("3", "")}
    facts = [("xss", True, None, "reachability"), ("xss", False, None, None), ("buffer-write", True, "unbounded", "relational"), ("buffer-write", True, "bounded", None), ("weak-crypto", False, None, "presence"), ("odd", True, "unbounded", None), (None, None, None, None)]
    df = spark.createDataFrame(facts, "kind string, tainted boolean, bound string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", copies.pattern_of(F.col("kind"), F.col("tainted"), F.col("bound"))).collect())


def test_type_roles(spark):
    par = lambda f, t: (f"p{f}{t}", "parameter", {}, {"owner_function_id": f, "type": t})
    nodes = [(f, "function", {}, {"label": n}) for f, n in (("f1", "create"), ("f2", "box_free"), ("f3", "touch"), ("f4", "look"))] + [par(f, "Box") for f in ("f1", "f2", "f3", "f4")] + [("st", "statement", {}, {"owner_function_id": "f3"})]
    g = graph(spark, nodes, [("st", "x", "WRITES_TO")])
    assert {tuple(r) for r in copies.type_roles(g.nodes, g.edges).collect()} == {("box", "f1", "constructor"), ("box", "f2", "destructor"), ("box", "f3", "mutator"), ("box", "f4", "consumer")}
