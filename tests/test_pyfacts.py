from __future__ import annotations

import ast
import glob
import json
import os

from weftgraph.sources import pyfacts

TEXT = '''import os, a.b as ab
from .near import thing as t, gone
__all__ = ["f", "K"]
x = 1
x = x + 2
class K(Base, mod.Other):
    y = [i for i in range(3) if i]
    def m(self, p, *q):
        self.z = p
        def inner():
            return p
        return self.m(inner) or t(p)
def f(é, b=x):
    while é:
        é -= 1
    for u, (v, w) in b:
        print(f"{u}{v}", end="")
    try:
        with open("n") as h: raise h
    except OSError as e:
        e
    finally:
        pass
    return (n := b) if x else None
def stub(): ...
'''


def parts(text=TEXT, path="u/pkg/m.py"):
    rows = pyfacts.facts_of("1", path, text)
    nodes = {r[2]: r for r in rows if r[1] == "node"}
    return nodes, [r for r in rows if r[1] == "edge"], [r[4] for r in rows if r[1] == "export"]


def test_one_file():
    nodes, edges, exports = parts()
    assert exports == ["K", "f"]
    name = lambda i: (nodes[i][3], nodes[i][4])
    have = {(e[3], name(e[5]), name(e[6])) for e in edges}
    assert {("CONTAINS", ("class", "K"), ("method", "m")), ("CAPTURES", ("function", "inner"), ("method", "m")), ("DEFINES", ("parameter", "p"), ("definition", "p")), ("RETURNS_VALUE", ("read", "p"), ("function", "inner")), ("DEFINES", ("variable", "x"), ("definition", "x"))} <= have
    kinds = {e[3] for e in edges}
    assert {"CONDITION", "LOOP_BACK", "LOOP_TRUE", "ITERATES", "TRY_BODY", "EXCEPTION_BRANCH", "RUNS_FINALLY", "SHORT_CIRCUIT_LEFT", "SHORT_CIRCUIT_RIGHT", "THROWS_VALUE", "WRITES_PARAMETER_PROPERTY", "PREVIOUS_VERSION", "CFG_NEXT", "HAS_ARGUMENT"} <= kinds
    reasons = {e[7] for e in edges if e[3] == "VALUE_FLOWS_TO"}
    assert {"initializer", "assignment", "destructuring", "iteration", "context-manager", "exception", "template-substitution", "arithmetic-operand", "field-write", "array-element", "read-value", "call-argument", "conditional-true"} <= reasons
    for i, n in nodes.items():  # every place is that of the text, in characters
        if n[3] in ("read", "parameter"):
            assert TEXT[n[9] : n[10]].lstrip("*").startswith(n[4])
    props = {n[4]: json.loads(n[12]) for n in nodes.values() if n[3] == "function"}
    assert props["stub"]["declaration_only"] and not props["f"]["declaration_only"]
    # the read in ``x = x + 2`` sees the version before its own
    seen = [json.loads(nodes[e[6]][12])["version"] for e in edges if e[3] == "READS_FROM" and name(e[5]) == ("read", "x") and nodes[e[5]][11] == 5]
    assert seen == [0]


def test_faulty_and_library_files():
    nodes, edges, exports = parts("def f(:\n")
    assert [n[3] for n in nodes.values()] == ["diagnostic"] and not edges and not exports
    assert parts("")[0] and parts("﻿x = 1\n")[0]
    for f in sorted(glob.glob(os.path.dirname(ast.__file__) + "/*.py"))[:25]:
        nodes, edges, _ = parts(open(f, encoding="utf8").read(), f)
        assert all(e[5] in nodes and e[6] in nodes for e in edges), f


def test_over_files(spark):
    kind = "file_id string, unit string, path string, text string"
    rows = [
        ("1", "u", "u/pkg/__init__.py", ""), ("2", "u", "u/pkg/near.py", "def thing(): pass\nclass Base:\n  def m(self): pass\n"), ("3", "u", "u/pkg/m.py", TEXT), ("4", "u", "u/top.py", "import pkg.near\nfrom pkg import near\nfrom pkg.m import x\nnear.thing()\n"),
        ("5", "v", "v/other.py", "class Q(K):\n  def m(self): self.k()\n  def k(self): pass\n"), ("5", "v", "v/other.py", "class Q(K):\n  def m(self): self.k()\n  def k(self): pass\n"), ("6", "v", "v/c.c", "int x;"), ("7", "v", "v/n.py", None),
    ]
    files = spark.createDataFrame(rows, kind)
    facts = pyfacts.python_facts(files).cache()
    label = {r.id: r.label for r in facts.filter("fact = 'node'").collect()}
    imports = {(r.file_id, r.label): r.id for r in facts.filter("kind = 'import'").collect()}
    to = {r.import_id: (label.get(r.target, r.target), r.how) for r in pyfacts.import_targets(facts, files).collect()}
    assert to[imports["4", "pkg.near"]] == ("2", "module") and to[imports["4", "near"]] == ("2", "submodule") and to[imports["4", "x"]] == ("x", "declaration")
    assert to[imports["3", "thing"]] == ("thing", "declaration") and to[imports["3", "gone"]] == ("2", "module") and to[imports["3", "os"]] == ("external:os", "external-module")
    over = {(label[r.method], label[r.base_method], r.confidence) for r in pyfacts.overrides(facts).collect()}
    assert over == {("m", "m", "exact")} and pyfacts.overrides(facts).count() == 3
    cand = {(label[r.call_id], label.get(r.target), r.rung, r.n) for r in pyfacts.call_candidates(facts).collect()}
    assert ("self.k", "k", "lexical-mro", 1) in cand and ("self.m", "m", "lexical-mro", 1) in cand
