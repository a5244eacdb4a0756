from __future__ import annotations

import random
from collections import defaultdict

import pytest

from weftgraph.operators import hierarchy

LINK = "child string, parent string, locality string, root string, salt int"


def brute(links):
    par, nodes = defaultdict(set), set()
    for c, p in links:
        if c is not None and p is not None:
            par[c].add(p)
            nodes |= {c, p}

    def up(n):
        seen, todo = set(), list(par[n])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += par[x]
        return seen

    above = {n: up(n) for n in nodes}
    cyclic = {n for n in nodes if n in above[n]}
    out = {}

    def place(n):
        if not par[n]:
            return (0, n)
        return min((place(p)[0] + 1, place(p)[1]) for p in par[n])

    for n in nodes:
        loops = ({n} | above[n]) & cyclic
        out[n] = (min(loops), -1) if loops else (place(n)[1], place(n)[0])
    return out, cyclic


def table(spark, links):
    return spark.createDataFrame([(c, p, (c or "")[:1], "clash", 7) for c, p in links], LINK)


def resolved(df, paths=False):
    return {r["node"]: r for r in hierarchy.resolve_links(df, paths).collect()}


@pytest.mark.parametrize("fragment,quotient", [(50_000, 500_000), (3, 500_000), (6, 8)])
def test_random_forests_with_loops(spark, monkeypatch, fragment, quotient):
    monkeypatch.setattr(hierarchy, "FRAGMENT_ROWS", fragment)
    monkeypatch.setattr(hierarchy, "QUOTIENT_ROWS", quotient)
    rng = random.Random(fragment + quotient)
    names = [f"{rng.choice('abcd')}{i}" for i in range(40)]
    links = [(names[i], names[rng.randrange(i)]) for i in range(1, 40) if rng.random() < 0.9]
    links += [(names[3], names[20]), (names[7], names[7]), (names[30], names[2])]
    links += links[:5] + [(None, "x"), ("x", None)]
    want, cyclic = brute(links)
    df = table(spark, links)
    got = resolved(df)
    assert {n: (r["root"], r["depth"]) for n, r in got.items()} == want
    if quotient > 8:
        clean = df.filter("child is not null and parent is not null")
        members = {r["node"]: r["on_cycle"] for r in hierarchy.cycle_members(clean, hierarchy.resolve_links(df)).collect()}
        assert {n for n, on in members.items() if on} >= cyclic & set(members)
        assert set(members) == {n for n, (_, d) in want.items() if d == -1}


def test_paths_and_descendants(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "FRAGMENT_ROWS", 2)
    df = table(spark, [("b", "a"), ("c", "b"), ("d", "c"), ("e", "b"), ("y", "x"), ("x", "y")])
    got = resolved(df, paths=True)
    assert got["d"]["path"] == ["a", "b", "c", "d"] and got["a"]["path"] == ["a"] and got["x"]["path"] is None
    pairs = {tuple(r) for r in hierarchy.descendants(hierarchy.resolve_links(df, True)).collect()}
    assert pairs == {("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("a", "e", 2), ("b", "c", 1), ("b", "d", 2), ("b", "e", 1), ("c", "d", 1)}


def test_long_chain_over_many_fragments(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "FRAGMENT_ROWS", 40)
    links = [(f"n{i:04d}", f"n{i - 1:04d}") for i in range(1, 300)]
    random.Random(5).shuffle(links)
    got = resolved(table(spark, links))
    assert got["n0299"]["depth"] == 299 and {r["root"] for r in got.values()} == {"n0000"}


def test_empty(spark):
    assert resolved(table(spark, [])) == {}


@pytest.mark.parametrize("fragment,quotient,paths", [(4, 1, False), (3, 6, True)])
def test_ended_chains_through_the_recursion(spark, monkeypatch, fragment, quotient, paths):
    monkeypatch.setattr(hierarchy, "FRAGMENT_ROWS", fragment)
    monkeypatch.setattr(hierarchy, "QUOTIENT_ROWS", quotient)
    links = [("b", "a"), ("a", "b"), ("m", "a"), ("z1", "m"), ("z2", "z1"), ("two", "m"), ("two", "top"), ("under", "two")]  # a loop with children in other fragments
    rng = random.Random(fragment)
    for g in range(12):
        names = [f"{rng.choice('pqrs')}{g}.{i}" for i in range(12)]
        links += [(names[i], names[rng.randrange(i)]) for i in range(1, 12) if rng.random() < 0.9]
        links += [(rng.choice(names), rng.choice(names)) for _ in range(rng.randrange(4))]
    want, _ = brute(links)
    rows = hierarchy.resolve_links(table(spark, links), paths).collect()
    assert sorted((r["node"], r["root"], r["depth"]) for r in rows) == sorted((n, root, depth) for n, (root, depth) in want.items())
    if paths:
        parents = set(links)
        for r in rows:
            p = r["path"]
            assert (p is None) == (r["depth"] == -1)
            assert p is None or (p[0] == r["root"] and p[-1] == r["node"] and len(p) == r["depth"] + 1 and all((c, u) in parents for u, c in zip(p, p[1:])))


@pytest.mark.parametrize("paths", [False, True])
def test_general_graphs_over_all_tasks(spark, monkeypatch, paths):
    monkeypatch.setattr(hierarchy, "FRAGMENT_ROWS", 5)
    monkeypatch.setattr(hierarchy, "QUOTIENT_ROWS", 0)
    monkeypatch.setattr(hierarchy, "LEVELS", 0)
    rng = random.Random(11 + paths)
    links = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "b"), ("e", "e"), ("e", "top"), ("f", "e"), ("f", "top")]
    for g in range(6):
        names = [f"{g}.{i}" for i in range(9)]
        links += [(names[i], names[rng.randrange(i)]) for i in range(1, 9) for _ in range(2)]
        links += [(names[0], names[5])] if g % 3 == 0 else []
    want, _ = brute(links)
    rows = hierarchy.resolve_links(table(spark, links), paths).collect()
    assert sorted((r["node"], r["root"], r["depth"]) for r in rows) == sorted((n, root, depth) for n, (root, depth) in want.items())
    known = set(links)
    for r in rows if paths else ():
        p = r["path"]
        assert (p is None) == (r["depth"] == -1) and (p is None or (len(p) == r["depth"] + 1 and p[0] == r["root"] and p[-1] == r["node"] and all((c, u) in known for u, c in zip(p, p[1:]))))
