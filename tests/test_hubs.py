from __future__ import annotations

import random

import pytest

from weftgraph.graph import Graph
from weftgraph.operators import rules, traverse

EDGE = "row_id long, src string, dst string, kind string, semantic_kind string"


def histories(spark, seeds, links):
    nodes = spark.createDataFrame([(s, "heap-object") for s in seeds] + [(b, "variable") for _, b in links if b not in seeds], "id string, kind string").distinct()
    edges = spark.createDataFrame([(i, a, b, "POINTS_TO", None) for i, (a, b) in enumerate(links)], EDGE)
    return rules.value_histories(Graph(nodes, edges), 4)


def by_search(seeds, links):
    near: dict[str, set[str]] = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for s in seeds:
        at, k = {s}, 0
        while at and k <= 4:
            out |= {(s, n): k for n in at}
            at, k = {m for n in at for m in near.get(n, ()) if (s, m) not in out}, k + 1
    return out


@pytest.mark.parametrize(("hub", "sent"), [(1_000, 50_000), (5, 50_000), (3, 2), (0, 4)])
def test_histories_by_hubs(spark, monkeypatch, hub, sent):
    monkeypatch.setattr(traverse, "HUB", hub)
    monkeypatch.setattr(traverse, "SEEDS", sent)
    r = random.Random(hub)
    names = [f"n{i}" for i in range(40)]
    links = [(r.choice(names), r.choice(names)) for _ in range(38)] + [("n0", n) for n in names[5:15]] + [("n1", n) for n in names[12:20]] + [("n0", "n1"), ("n2", "n2")]
    seeds = ["n0", "n2", "n7", "n13", "n21", "n30", "alone"]
    got = histories(spark, seeds, links).collect()
    assert len(got) == len({(x.seed, x.node) for x in got})
    assert {(x.seed, x.node): x.distance for x in got} == by_search(seeds, links)


def test_rounds_hold_no_rows_behind_a_hub(spark, monkeypatch):
    # each of 20 seeds carried the hub's 60 neighbours through the rounds
    monkeypatch.setattr(traverse, "HUB", 50, raising=False)
    sizes, fixpoint = [], traverse.fixpoint

    def counted(*args):
        found, cut = fixpoint(*args)
        sizes.append(found.count())
        return found, cut

    monkeypatch.setattr(traverse, "fixpoint", counted)
    seeds = [f"s{i}" for i in range(20)]
    links = [(s, "hub") for s in seeds] + [("hub", f"v{i}") for i in range(40)]
    got = {(x.seed, x.node): x.distance for x in histories(spark, seeds, links).collect()}
    assert got == by_search(seeds, links) and len(got) == 20 * 61
    assert sum(sizes) < 200
