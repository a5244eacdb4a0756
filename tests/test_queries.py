"""The registered queries against their SQL on the smallest data: a few of each kind, with ALL_QUERIES=1 in the environment all of them."""

from __future__ import annotations

import math
import os
from collections import Counter

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
NAMES = "p1_found p1_cycles p3_found p3_report p7_counts hubs violations compose_edges resolve_calls flow_cones resolve_ladder call_relations security_roles call_closure control_links guard_differential ranked_entries function_summaries misuses token_idf nearest_vectors".split()
if os.environ.get("ALL_QUERIES"):
    import __spark_entry__

    NAMES = sorted(__spark_entry__.oracle_sql())
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no data")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return str(v) if hasattr(v, "isoformat") else v


def rows(t):
    return Counter(tuple(plain(v) for v in r) for r in zip(*[t[c].to_pylist() for c in sorted(t.column_names)]))


def test_every_sql_has_its_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 150


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, db, name):
    import __spark_entry__ as entry

    got = entry.queries()[name](spark, DATA).toArrow()
    want = db.sql(entry.oracle_sql()[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)
