from __future__ import annotations

import json
from collections import Counter
from datetime import datetime

import pytest

from weftgraph.functions import wirejson
from weftgraph.operators import drift, flatten, keycounts, references

T = datetime


def edges(spark, rows):
    return spark.createDataFrame(rows, "row_id long, src string, dst string, kind string, recorded_at timestamp_ntz, salt int, n long, unit string")


def nodes(spark, rows):
    return spark.createDataFrame(rows, "id string, kind string, recorded_at timestamp_ntz, retired_at timestamp_ntz, salt int, first_at string")


def test_heavy_values_and_counts(spark):
    rows = [(i, f"s{i % 7}", "hot" if i % 3 else f"d{i}", None if i % 10 == 0 else "K", None, 1, 2, "u") for i in range(300)]
    rows += rows[:20]
    e, n = edges(spark, rows), nodes(spark, [("a", "k", None, None, 0, "")] * 3)
    counts, totals = keycounts.key_counts(e, n)
    got = {(r.table_name, r.field, r.key_value): r.n for r in counts.collect()}
    want = Counter(("edges", "kind", r[3]) for r in rows) + Counter(("edges", "dst", r[2]) for r in rows)
    want[("nodes", "kind", "k")] = 3
    assert got == dict(want) and totals[("edges", "kind")] == 320
    heavy = {(r.table_name, r.field, r.key_value) for r in keycounts.heavy_values(e, n).collect()}
    assert heavy == {k for k, v in want.items() if k[2] is not None and v >= 0.025 * (3 if k[0] == "nodes" else 320)}
    profile = {r.key_value: r for r in keycounts.edge_profile(e, "dst").collect()}
    assert profile["hot"].n == want[("edges", "dst", "hot")] and profile["hot"].n_src == 7


def test_key_counts_of_empty_tables(spark):
    assert keycounts.heavy_values(edges(spark, []), nodes(spark, [])).collect() == []
    assert keycounts.edge_profile(edges(spark, []), "kind").collect() == []


def orphan_rows(spark, e, n, always):
    refs = references.edge_references(e)
    known = spark.createDataFrame([(x,) for x in always], "id string")
    return {(r.row_id, r.side): r.cause for r in references.orphans(refs, n, known).collect()}


def test_orphans(spark):
    n = nodes(spark, [
        ("a", "k", T(2026, 1, 2), None, 0, ""), ("a", "k2", T(2026, 1, 5), None, 0, ""),
        ("gone", "k", T(2026, 1, 1), T(2026, 2, 1), 0, ""), ("gone", "k", T(2026, 1, 1), T(2026, 2, 1), 0, ""),
        ("undated", "k", None, None, 0, ""), (None, "k", None, None, 0, ""),
    ])
    e = edges(spark, [
        (1, "a", "gone", "k", T(2026, 1, 3), 0, 0, "u"),
        (2, "a", "gone", "k", T(2026, 2, 1), 0, 0, "u"),
        (3, "a", "nope", "k", T(2026, 1, 1), 0, 0, "u"),
        (4, "A", None, "k", None, 0, 0, "u"),
        (5, "gone", "builtin", "k", None, 0, 0, "u"),
        (6, "undated", "builtin", "k", T(2020, 1, 1), 0, 0, "u"),
        (7, "a", "nope", "k", T(2026, 1, 1), 0, 0, "u"),
    ])
    want = {(2, "dst"): "deleted", (3, "src"): "late", (3, "dst"): "missing", (4, "src"): "missing", (7, "src"): "late", (7, "dst"): "missing"}
    assert orphan_rows(spark, e, n, ["builtin", None]) == want
    refs = references.edge_references(e)
    report = references.orphan_report(references.orphans(refs, n, spark.createDataFrame([("builtin",)], "id string")), refs)
    got = {(r.side, r.month, r.cause): r.n_refs for r in report.collect()}
    assert got[("dst", "2026-01", "missing")] == 2 and got[("src", None, "any")] == 2
    assert orphan_rows(spark, edges(spark, []), n, []) == {}


def test_orphans_of_a_hot_key(spark):
    e = edges(spark, [(i, "hot", f"x{i % 5}", "k", T(2026, 1, 1), 0, 0, "u") for i in range(400)])
    got = orphan_rows(spark, e, nodes(spark, [("hot", "k", T(2026, 3, 1), None, 0, "")]), [])
    assert Counter(c for (_, s), c in got.items() if s == "src") == {"late": 400} and len(got) == 800


FIELDS = [{"key": "a", "value": {"integer": 1}}, {"key": "a", "value": {"integer": 2}}, {"key": "l", "value": {"list": [{"text": ""}, {"null_value": {}}, {"object": [{"key": "x", "value": {"real": 1}}]}]}}]


@pytest.mark.parametrize("text,version,want", [
    ('{"a": 1, "a": 2.5}', 1, {"a": 2.5}),
    ('{"a": 1', 1, None),
    (None, 1, None),
    ('{"a": NaN}', 1, None),
    (json.dumps(FIELDS), 2, {"a": 2, "l": ["", None, {"x": 1.0}]}),
    ('[{"key":"a","value":{"list":{"values":[{"integer":"7"}]}}},{"key":"o","value":{"object":{"fields":[]}}}]', 3, {"a": [7], "o": {}}),
    ('[{"key":"a","value":{"odd":1}}]', 2, None),
    ("[1]", None, None),
    ('{"a": true}', None, {"a": True}),
])
def test_decode(text, version, want):
    got = wirejson.decode(text, version)
    assert got == want
    if got and "a" in got and version == 1:
        assert wirejson.type_name(got["a"]) == "real"


def test_deep_nesting_does_not_break():
    assert wirejson.decode("[" * 100_000, 1) is None
    deep = {}
    for _ in range(500):
        deep = {"d": deep, "x": 1}
    assert sum(1 for _, t, _ in wirejson.walk(deep) if t == "integer") == 500


WIRE = "record_no long, shard_id string, id string, properties string, origin string, path string"
SHARD = "shard_id string, unit string, shard_seq long, format_version long, status string, record_no long"


def test_flatten(spark):
    wire = spark.createDataFrame([
        (1, "s", "i", '{"a":{"b":{"line":1,"col":2},"e":{"b":{"line":3,"col":4}}},"r":[{"k":"x","t":[1,2]},{"k":""}],"n":null,"d":{"d":{"v":1}}}', "clash", "clash"),
        (1, "s", "i", '{"a":{"b":{"line":1,"col":2},"e":{"b":{"line":3,"col":4}}},"r":[{"k":"x","t":[1,2]},{"k":""}],"n":null,"d":{"d":{"v":1}}}', "clash", "clash"),
        (2, "s", "i", None, None, None), (3, "s", "i", '{"a":', None, None), (4, "unknown", "i", '{"z": 0}', None, None),
    ], WIRE)
    shards = spark.createDataFrame([("s", "u", 0, 1, "complete", 0), ("s", "u", 0, 1, "complete", 0)], SHARD)
    el = flatten.wire_elements(wire, shards)
    got = Counter((r.record_key, r.leaf_path) for r in flatten.leaves(el).collect())
    assert got == Counter([("1", p) for p in ("a/b/line", "a/b/col", "a/e/b/line", "a/e/b/col", "r/[0]/k", "r/[0]/t/[0]", "r/[0]/t/[1]", "r/[1]/k", "d/d/v")] + [("4", "z")])
    cells = flatten.flat_cells(el).collect()
    tables = {c.table_name for c in cells}
    assert {"wire_record", "wire_r", "wire_r_t", "wire_b", "wire_d"} <= tables  # repeated, shared, recursive
    keys = {(c.record_key, c.row_path) for c in cells}
    assert all((c.record_key, c.parent_path) in keys for c in cells if c.parent_path is not None)
    wide = flatten.flat_tables(el)["wire_b"].collect()
    assert {(r.row_path, r.line, r.col) for r in wide} == {("a/b", "1", "2"), ("a/e/b", "3", "4")}
    assert flatten.leaves(flatten.wire_elements(wire.limit(0), shards.limit(0))).collect() == []


def test_found_scalars_come_from_the_flat_tables(spark, monkeypatch):
    from weftgraph import core_queries

    deep = '{"":{"":1,"x":[2,[3,{"y":"a/b"}]]},"p.q":{"r":1},"p":{"q":{"r":2}},"[0]":{"v":4},"l":[{"same":{"k":1}},[],{"l":[{"k":""}]}],"same":{"k":5},"mix":[1,{"value":2}]}'
    wire = spark.createDataFrame([(1, "s", "i", deep, None, None), (None, "s", "i", '{"mix":[{"value":1},7]}', None, None), (3, "s", "i", "{}", None, None)], WIRE)
    el = flatten.wire_elements(wire, spark.createDataFrame([("s", "u", 0, 1, "complete", 0)], SHARD))
    want = Counter(tuple(r) for r in flatten.leaves(el).collect())
    assert Counter(tuple(r) for r in flatten.inlined_leaves(el).collect()) == want and len(want) == 14
    monkeypatch.setattr(core_queries, "_elements", lambda spark, d: el)
    lost = lambda patterns: {k: v for k, v in plan(patterns).items() if k[1] != ("same", "k")}
    plan = flatten.inlining_plan
    monkeypatch.setattr(flatten, "inlining_plan", lost)  # what the tables lose, the query does not find
    got = Counter(tuple(r) for r in core_queries.p4_found(spark, "").collect())
    assert Counter(k[:3] for k in want.elements()) - got == Counter([("wire", "1", "same/k")])


def test_flatten_imports(spark):
    kind = "file_id string, text string, imports array<struct<source:string,bindings:array<struct<imported:string,local:string>>>>, path string"
    rows = [("f", "t", [None, ("m", [("a", None), None, ("b", "")])], "p"), ("f", "t", [None, ("m", [("a", None), None, ("b", "")])], "p"), ("g", None, None, None)]
    got = Counter((r.record_key, r.leaf_path) for r in flatten.leaves(flatten.import_elements(spark.createDataFrame(rows, kind))).collect())
    assert got == Counter([("f", p) for p in ("[1]/source", "[1]/bindings/[0]/imported", "[1]/bindings/[2]/imported", "[1]/bindings/[2]/local")])


def drift_rows(spark, records, shards):
    return {tuple(r) for r in drift.schema_changes(spark.createDataFrame(records, WIRE), spark.createDataFrame(shards, SHARD)).collect()}


def test_drift(spark):
    def rec(no, shard, i, props):
        return (no, shard, i, json.dumps(props), "clash", "clash")

    shards = [("u/0", "u", 0, 1, "complete", 0), ("u/1", "u", 1, 1, "failed", 0), ("u/2", "u", 2, 1, "complete", 0), ("u/2", "u", 2, 1, "complete", 0), ("u/3", "u", 3, 1, "complete", 0)]
    records = [
        rec(1, "u/0", "a", {"start": 5, "gone": "x", "same": 1, "none": None, "flag": True}),
        rec(2, "u/0", "b", {"start": 6, "same": 2}),
        rec(3, "u/1", "a", {"other": 1}),
        rec(4, "u/2", "a", {"begin": 5, "new": "y", "same": "1", "none": None, "flag": True}),
        rec(4, "u/2", "a", {"begin": 5, "new": "y", "same": "1", "none": None, "flag": True}),
        rec(5, "u/2", "c", {"begin": 9, "same": "q"}),
    ]
    assert drift_rows(spark, records, shards) == {
        ("u/2", "start", "begin", "renamed"), ("u/2", "gone", "", "removed"), ("u/2", "", "new", "added"), ("u/2", "same", "same", "retyped"),
        *{("u/3", f, "", "removed") for f in ("begin", "new", "same", "none", "flag")},
    }
    assert drift_rows(spark, [], []) == set()
    table = drift.consistent_table(spark.createDataFrame(records, WIRE), spark.createDataFrame(shards, SHARD)).collect()
    assert {r.field for r in table} == {"begin", "gone", "new", "same", "flag"} or {r.field for r in table} == {"start", "gone", "new", "same", "flag"}
    assert {r.type for r in table if r.field == "same"} == {"text"}


def test_flooding_prefers_like_fields():
    s = drift.flood([("start_offset", ["integer"], []), ("role", ["list"], ["kind"])], [("begin_offset", ["integer"], []), ("roles", ["list"], ["kind"])])
    assert s[0, 0] > s[0, 1] and s[1, 1] > s[1, 0]
