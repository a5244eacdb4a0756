"""Python sources to facts: scopes, values, control flow, exports, and links over files.

Each file is read on its own where its text lies; names that lead to other files are joined afterwards.
A definition is one version of a name in its scope; a read sees the last definition that starts at or
before it, and one inside its own value the version before. Offsets are in characters.

Defined cases: a text that is no Python gives one diagnostic; null texts and other languages give
nothing; repeated files fold; names without a definition get an implicit one; a name bound several
times in a module is conservative; star imports and dynamic attributes are left unresolved.
"""

from __future__ import annotations

import ast
import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.spread import spread

FACTS = "file_id string, fact string, id string, kind string, label string, src string, dst string, reason string, owner_id string, a long, b long, line long, props string"
#: Declarations of a method's name up to which a call of an unknown receiver keeps them all.
DUCKS = 8


class _Reader(ast.NodeVisitor):
    """Facts of one file in the order of its text."""

    def __init__(self, file_id: str, path: str, text: str):
        self.file_id, self.path, self.rows = file_id, path, []
        self.starts = [0]
        for line in text.split("\n"):
            self.starts.append(self.starts[-1] + len(line) + 1)
        self.lines = [x.encode() for x in text.split("\n")]
        self.stub = path.endswith(".pyi")
        self.scopes: list[dict] = []
        self.handlers: list[str] = []

    # -- places and rows
    def at(self, line: int, column: int) -> int:
        """Characters before a place that the parser gives in bytes."""
        return self.starts[line - 1] + len(self.lines[line - 1][:column].decode("utf-8", "replace"))

    def span(self, n: ast.AST) -> tuple[int, int, int]:
        return self.at(n.lineno, n.col_offset), self.at(n.end_lineno, n.end_col_offset), n.lineno

    def node(self, kind: str, label: str, n: ast.AST | None, *parts: object, **props) -> str:
        text = "\x00".join(["v2", "frontend", "python-ast", kind, self.file_id, *map(str, parts)])
        i = f"v2:frontend:python-ast:{kind}:{hashlib.sha256(text.encode()).hexdigest()[:20]}"
        a, b, line = self.span(n) if n is not None else (0, self.starts[-1] - 1, 1)
        owner = next((s["id"] for s in reversed(self.scopes) if s["kind"] == "function"), None)
        self.rows.append((self.file_id, "node", i, kind, label, None, None, None, owner, a, b, line, json.dumps(props) if props else None))
        return i

    def edge(self, src: str | None, dst: str | None, kind: str, reason: str | None = None, **props) -> None:
        if src and dst and src != dst:
            self.rows.append((self.file_id, "edge", None, kind, None, src, dst, reason, None, None, None, None, json.dumps(props) if props else None))

    # -- scopes
    def open(self, kind: str, i: str, bound: set[str]) -> None:
        self.scopes.append({"kind": kind, "id": i, "bound": bound, "defs": {}})

    def scope_of(self, name: str) -> dict | None:
        for depth, s in enumerate(reversed(self.scopes)):
            if name in s["bound"] and (depth == 0 or s["kind"] != "class"):
                return s
        return None

    @staticmethod
    def bindings(body: list[ast.stmt], args: ast.arguments | None = None) -> set[str]:
        found, outer = set(), set()
        todo: list[ast.AST] = list(body)
        while todo:
            n = todo.pop()
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                found.add(n.name)
                continue
            if isinstance(n, ast.Lambda):
                continue
            if isinstance(n, (ast.Global, ast.Nonlocal)):
                outer |= set(n.names)
            elif isinstance(n, ast.Name) and isinstance(n.ctx, (ast.Store, ast.Del)):
                found.add(n.id)
            elif isinstance(n, (ast.Import, ast.ImportFrom)):
                found |= {(a.asname or a.name).split(".")[0] for a in n.names if a.name != "*"}
            elif isinstance(n, ast.ExceptHandler) and n.name:
                found.add(n.name)
            elif isinstance(n, (ast.MatchAs, ast.MatchStar)) and n.name:
                found.add(n.name)
            todo += ast.iter_child_nodes(n)
        if args:
            found |= {a.arg for a in [*args.posonlyargs, *args.args, *args.kwonlyargs, *filter(None, (args.vararg, args.kwarg))]}
        return found - outer

    # -- definitions and reads
    def define(self, name: str, n: ast.AST, origin: str, value: str | None = None, reason: str | None = None, until: int | None = None) -> str:
        scope = self.scope_of(name) or self.scopes[0]
        versions = scope["defs"].setdefault(name, [])
        d = self.node("definition", name, n, scope["id"], name, len(versions), *self.span(n)[:2], origin=origin, version=len(versions), scope_id=scope["id"], value_end_offset=until)
        if versions:
            self.edge(d, versions[-1][1], "PREVIOUS_VERSION")
        versions.append((self.span(n)[0], d, until))
        if value:
            self.edge(value, d, "VALUE_FLOWS_TO", reason or "assignment")
        return d

    def read(self, n: ast.Name) -> str:
        a = self.span(n)[0]
        r = self.node("read", n.id, n, n.id, a)
        scope = self.scope_of(n.id)
        if scope is None:
            return r
        seen = [d for d in scope["defs"].get(n.id, []) if d[0] <= a and not (d[2] is not None and d[0] <= a < d[2])]
        if seen:
            self.edge(r, seen[-1][1], "READS_FROM")
            self.edge(seen[-1][1], r, "VALUE_FLOWS_TO", "read-value")
        else:
            self.edge(r, self.define(n.id, n, "implicit"), "READS_FROM")
        if scope is not self.scopes[-1] and scope["kind"] == "function":
            self.edge(self.scopes[-1]["id"], scope["id"], "CAPTURES", name=n.id)
        return r

    def bind(self, target: ast.expr, value: str | None, reason: str, until: int) -> None:
        if isinstance(target, ast.Name):
            d = self.define(target.id, target, "assignment", value, reason, until)
            here = self.scopes[-1]
            if here["kind"] in ("module", "class") and here is self.scope_of(target.id):
                self.edge(self.node("variable", target.id, target, here["id"], target.id), d, "DEFINES")
        elif isinstance(target, (ast.Tuple, ast.List)):
            for t in target.elts:
                self.bind(t, value, "destructuring", until)
        elif isinstance(target, ast.Starred):
            self.bind(target.value, value, "destructuring", until)
        elif isinstance(target, ast.Attribute):
            base = self.value(target.value)
            w = self.node("write", target.attr, target, *self.span(target)[:2])
            self.edge(value, w, "VALUE_FLOWS_TO", "field-write")
            fn = next((s for s in reversed(self.scopes) if s["kind"] == "function"), None)
            if fn and isinstance(target.value, ast.Name) and target.value.id in fn.get("args", ()):
                self.edge(fn["id"], w, "WRITES_PARAMETER_PROPERTY", receiver=target.value.id, property=target.attr)
            self.edge(base, w, "HAS_PROPERTY_PATH")
        elif isinstance(target, ast.Subscript):
            self.value(target.value)
            self.value(target.slice)

    # -- expressions
    def value(self, n: ast.expr | None) -> str | None:
        """The id of an expression's value, its parts visited on the way."""
        if n is None:
            return None
        if isinstance(n, ast.Name):
            return self.read(n)
        here = self.span(n)[:2]
        if isinstance(n, ast.Constant):
            return self.node("literal", str(n.value)[:60], n, *here)
        if isinstance(n, ast.Call):
            c = self.node("call", ast.unparse(n.func)[:120], n, *here, callee=ast.unparse(n.func)[:120], method_name=n.func.attr if isinstance(n.func, ast.Attribute) else None, receiver=ast.unparse(n.func.value)[:60] if isinstance(n.func, ast.Attribute) else None)
            self.value(n.func.value if isinstance(n.func, ast.Attribute) else n.func)
            for k, arg in enumerate([*n.args, *[w.value for w in n.keywords]]):
                v = self.value(arg.value if isinstance(arg, ast.Starred) else arg)
                self.edge(c, v, "HAS_ARGUMENT", position=k)
                self.edge(v, c, "VALUE_FLOWS_TO", "call-argument", position=k)
            return c
        if isinstance(n, (ast.List, ast.Dict, ast.Set, ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp, ast.Lambda)):
            o = self.node("allocation", type(n).__name__, n, *here, allocation_kind={"Dict": "object", "Lambda": "function"}.get(type(n).__name__, "array"))
            if isinstance(n, ast.Lambda):
                return o
            for g in getattr(n, "generators", []):
                self.bind_local(g.target, self.value(g.iter), "iteration", self.span(g.iter)[1])
                for c in g.ifs:
                    self.edge(o, self.value(c), "CONDITION")
            parts = n.elts if isinstance(n, (ast.List, ast.Set)) else [*(k for k in n.keys if k), *n.values] if isinstance(n, ast.Dict) else [n.key, n.value] if isinstance(n, ast.DictComp) else [n.elt]
            for p in parts:
                self.edge(self.value(p.value if isinstance(p, ast.Starred) else p), o, "VALUE_FLOWS_TO", "object-property" if isinstance(n, ast.Dict) else "array-element")
            return o
        if isinstance(n, ast.NamedExpr):
            v = self.value(n.value)
            self.bind(n.target, v, "assignment", self.span(n)[1])
            return v
        e = self.node("expression", type(n).__name__, n, type(n).__name__, *here, operator="await" if isinstance(n, ast.Await) else type(getattr(n, "op", None)).__name__ if hasattr(n, "op") else None)
        if isinstance(n, ast.BoolOp):
            before = None
            for k, operand in enumerate(n.values):
                v = self.value(operand)
                self.edge(e if k == 0 else before, v, "SHORT_CIRCUIT_LEFT" if k == 0 else "SHORT_CIRCUIT_RIGHT")
                before = v
        elif isinstance(n, ast.IfExp):
            self.edge(e, self.value(n.test), "CONDITION")
            self.edge(self.value(n.body), e, "VALUE_FLOWS_TO", "conditional-true")
            self.edge(self.value(n.orelse), e, "VALUE_FLOWS_TO", "conditional-false")
        elif isinstance(n, ast.Attribute):
            self.edge(self.value(n.value), e, "VALUE_FLOWS_TO", "field-read")
        elif isinstance(n, ast.JoinedStr):
            for p in n.values:
                if isinstance(p, ast.FormattedValue):
                    self.edge(self.value(p.value), e, "VALUE_FLOWS_TO", "template-substitution")
        else:
            reason = {"BinOp": "arithmetic-operand", "UnaryOp": "unary-operand"}.get(type(n).__name__, "value-preserving-expression")
            for c in ast.iter_child_nodes(n):
                if isinstance(c, ast.expr):
                    self.edge(self.value(c.value if isinstance(c, ast.Starred) else c), e, "VALUE_FLOWS_TO", reason)
        return e

    def bind_local(self, target: ast.expr, value: str | None, reason: str, until: int) -> None:
        """Bind a comprehension's name in a scope that ends with it."""
        self.scopes[-1]["bound"] |= {x.id for x in ast.walk(target) if isinstance(x, ast.Name)}
        self.bind(target, value, reason, until)

    # -- statements
    def block(self, body: list[ast.stmt], parent: str) -> str | None:
        """Statements in a row; returns the first one's id."""
        first = before = None
        for s in body:
            i = self.statement(s, parent)
            self.edge(before, i, "CFG_NEXT")
            first, before = first or i, i if not isinstance(s, (ast.Return, ast.Raise, ast.Break, ast.Continue)) else None
        return first

    def statement(self, n: ast.stmt, parent: str) -> str:
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            return self.function(n, parent)
        if isinstance(n, ast.ClassDef):
            return self.klass(n, parent)
        s = self.node("statement", type(n).__name__, n, type(n).__name__, *self.span(n)[:2], control_kind=type(n).__name__.lower())
        self.edge(parent, s, "CONTAINS_BODY")
        if isinstance(n, (ast.Assign, ast.AnnAssign, ast.AugAssign)):
            v = self.value(n.value)
            for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                if isinstance(n, ast.AugAssign) and isinstance(t, ast.Name):
                    old = self.read(ast.copy_location(ast.Name(t.id, ast.Load()), t))
                    self.bind(t, v, "arithmetic-operand", self.span(n)[1])
                    self.edge(old, (self.scope_of(t.id) or self.scopes[0])["defs"][t.id][-1][1], "VALUE_FLOWS_TO", "arithmetic-operand")
                elif n.value is not None:
                    first = isinstance(t, ast.Name) and not (self.scope_of(t.id) or {"defs": {}})["defs"].get(t.id)
                    self.bind(t, v, "initializer" if first else "assignment", self.span(n.value)[1])
        elif isinstance(n, (ast.If, ast.While)):
            self.edge(s, self.value(n.test), "CONDITION")
            first = self.block(n.body, s)
            self.edge(s, first, "LOOP_TRUE" if isinstance(n, ast.While) else "TRUE_BRANCH")
            if isinstance(n, ast.While):
                self.edge(first, s, "LOOP_BACK")
            self.edge(s, self.block(n.orelse, s), "FALSE_BRANCH")
        elif isinstance(n, (ast.For, ast.AsyncFor)):
            over = self.value(n.iter)
            self.edge(s, over, "ITERATES")
            self.bind(n.target, over, "iteration", self.span(n.iter)[1])
            first = self.block(n.body, s)
            self.edge(s, first, "LOOP_TRUE")
            self.edge(first, s, "LOOP_BACK")
            self.edge(s, self.block(n.orelse, s), "FALSE_BRANCH")
        elif isinstance(n, (ast.With, ast.AsyncWith)):
            for item in n.items:
                v = self.value(item.context_expr)
                if item.optional_vars is not None:
                    self.bind(item.optional_vars, v, "context-manager", self.span(item.context_expr)[1])
            self.block(n.body, s)
        elif isinstance(n, (ast.Try, ast.TryStar)):
            entry = self.block(n.body, s)
            self.edge(s, entry, "TRY_BODY")
            for h in n.handlers:
                caught = self.value(h.type)
                if h.name:
                    self.define(h.name, h, "exception", caught, "exception", self.span(h.type)[1] if h.type else None)
                self.edge(entry, self.block(h.body, s), "EXCEPTION_BRANCH")
            self.block(n.orelse, s)
            self.edge(s, self.block(n.finalbody, s), "RUNS_FINALLY")
        elif isinstance(n, ast.Match):
            self.edge(s, self.value(n.subject), "CONDITION")
            for case in n.cases:
                for name in [x.name for x in ast.walk(case.pattern) if isinstance(x, (ast.MatchAs, ast.MatchStar)) and x.name]:
                    self.define(name, case.pattern, "pattern")
                if case.guard is not None:
                    self.edge(s, self.value(case.guard), "CONDITION")
                self.edge(s, self.block(case.body, s), "SWITCH_CASE")
        elif isinstance(n, ast.Return):
            fn = next((x["id"] for x in reversed(self.scopes) if x["kind"] == "function"), None)
            self.edge(self.value(n.value), fn, "RETURNS_VALUE")
        elif isinstance(n, ast.Raise):
            self.edge(s, self.value(n.exc), "THROWS_VALUE")
        elif isinstance(n, (ast.Import, ast.ImportFrom)):
            module = "." * getattr(n, "level", 0) + (getattr(n, "module", None) or "")
            for a in n.names:
                i = self.node("import", a.name, n, module, a.name, a.asname, self.span(n)[0], module=module if isinstance(n, ast.ImportFrom) else a.name, name=a.name if isinstance(n, ast.ImportFrom) else None, bound=a.asname or a.name.split(".")[0])
                if a.name != "*":
                    self.define(a.asname or a.name.split(".")[0], n, "import", i, "initializer")
        else:
            for c in ast.iter_child_nodes(n):
                if isinstance(c, ast.expr):
                    self.value(c)
        return s

    def function(self, n: ast.FunctionDef | ast.AsyncFunctionDef, parent: str) -> str:
        inside = self.scopes[-1]["kind"] == "class"
        bare = all(isinstance(x, ast.Pass) or isinstance(x, ast.Expr) and isinstance(x.value, ast.Constant) for x in n.body)
        f = self.node("method" if inside else "function", n.name, n, self.scopes[-1]["id"], n.name, self.span(n)[0], declaration_only=self.stub or bare, public=not n.name.startswith("_"), signature=f"{n.name}({ast.unparse(n.args)})", class_id=self.scopes[-1]["id"] if inside else None)
        self.edge(parent, f, "CONTAINS")
        for d in n.decorator_list:
            self.edge(self.value(d), f, "DECORATES")
        for d in [*n.args.defaults, *filter(None, n.args.kw_defaults)]:
            self.value(d)
        self.define(n.name, n, "declaration", f, "initializer")
        self.open("function", f, self.bindings(n.body, n.args))
        every = [*n.args.posonlyargs, *n.args.args, *filter(None, [n.args.vararg]), *n.args.kwonlyargs, *filter(None, [n.args.kwarg])]
        self.scopes[-1]["args"] = [a.arg for a in every]
        for k, a in enumerate(every):
            p = self.node("parameter", a.arg, a, f, k, parameter_position=k, annotation=ast.unparse(a.annotation) if a.annotation else None)
            self.edge(p, self.define(a.arg, a, "parameter"), "DEFINES")
        self.block(n.body, f)
        self.scopes.pop()
        return f

    def klass(self, n: ast.ClassDef, parent: str) -> str:
        c = self.node("class", n.name, n, self.scopes[-1]["id"], n.name, self.span(n)[0], bases=[ast.unparse(b) for b in n.bases], public=not n.name.startswith("_"))
        self.edge(parent, c, "CONTAINS")
        for b in [*n.bases, *n.decorator_list]:
            self.value(b)
        self.define(n.name, n, "declaration", c, "initializer")
        self.open("class", c, self.bindings(n.body))
        self.block(n.body, c)
        self.scopes.pop()
        return c

    def module(self, tree: ast.Module) -> None:
        m = self.node("module", self.path, None, "module")
        self.open("module", m, self.bindings(tree.body))
        self.block(tree.body, m)
        said = next((n.value for n in tree.body if isinstance(n, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in n.targets)), None)
        names = [e.value for e in said.elts if isinstance(e, ast.Constant)] if isinstance(said, (ast.List, ast.Tuple)) else [x for x in self.scopes[0]["bound"] if not x.startswith("_")]
        self.rows += [(self.file_id, "export", None, None, x, None, None, None, None, None, None, None, None) for x in sorted(set(names))]


def facts_of(file_id: str, path: str, text: str) -> list[tuple]:
    r = _Reader(file_id, path, text)
    for version in (None, (3, 8), (3, 7)):  # an older grammar may read what the newest does not
        try:
            r.module(ast.parse(text, feature_version=version))
            return r.rows
        except (SyntaxError, ValueError, RecursionError, MemoryError, UnicodeError) as e:
            fault, r = e, _Reader(file_id, path, text)
    r.node("diagnostic", type(fault).__name__, None, "diagnostic", message=str(fault)[:200], line=getattr(fault, "lineno", None))
    return r.rows


def _facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in FACTS.split(", ")]
    for b in batches:
        rows = [x for f, p, t in zip(b["file_id"], b["path"], b["text"]) for x in facts_of(f, p, t)]
        yield pd.DataFrame(rows, columns=names).astype({"a": "Int64", "b": "Int64", "line": "Int64"})


def python_facts(files: DataFrame) -> DataFrame:
    """Facts of all kept Python texts: rows of nodes, edges and exports."""
    kept = files.filter(F.col("text").isNotNull() & F.col("file_id").isNotNull() & F.col("path").rlike(r"\.pyi?$"))
    return spread(kept.select("file_id", "path", "text"), "file_id").mapInPandas(_facts, FACTS).distinct()


# -- over files -----------------------------------------------------------------------------------
def modules(files: DataFrame) -> DataFrame:
    """(file_id, unit, module, folder): the dotted name of each Python file below its unit's root, and of the package that it stands in."""
    f = files.filter(F.col("path").rlike(r"\.pyi?$") & F.col("file_id").isNotNull()).select("file_id", "unit", "path").distinct()
    bare = F.regexp_replace(F.regexp_replace("path", r"^[^/]*/", ""), r"\.pyi?$", "")
    dotted = F.regexp_replace(F.regexp_replace(bare, "/__init__$", ""), "/", ".")
    folder = F.when(F.col("path").rlike(r"/__init__\.pyi?$"), dotted).otherwise(F.when(dotted.contains("."), F.regexp_replace(dotted, r"\.[^.]*$", "")).otherwise(""))
    return f.select("file_id", "unit", dotted.alias("module"), folder.alias("folder"))


def import_targets(facts: DataFrame, files: DataFrame) -> DataFrame:
    """(import_id, target, how): what each import leads to: a submodule, else a name of the module, one declaration exactly, else an external module."""
    p = lambda k: F.get_json_object("props", f"$.{k}")
    m = modules(files)
    i = facts.filter("fact = 'node' and kind = 'import'").select("file_id", F.col("id").alias("import_id"), p("module").alias("said"), p("name").alias("name")).join(m.select("file_id", "unit", "folder"), "file_id")
    dots = F.length(F.regexp_extract("said", r"^(\.*)", 1))
    rest = F.regexp_replace("said", r"^\.+", "")
    parts = F.split("folder", r"\.")
    up = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - dots + 1, F.lit(0))), ".")
    base = F.when(dots == 0, rest).otherwise(F.regexp_replace(F.concat_ws(".", F.when(up != "", up), F.when(rest != "", rest)), r"^\.|\.$", ""))
    i = i.withColumn("base", base)
    by = m.groupBy("unit", "module").agg(F.min("file_id").alias("to"))
    sub = i.filter("name is not null").withColumn("module", F.concat_ws(".", F.when(F.col("base") != "", F.col("base")), "name")).join(by, ["unit", "module"]).select("import_id", F.col("to").alias("target"), F.lit("submodule").alias("how"), F.lit(0).alias("r"))
    decl = facts.filter("fact = 'node' and kind in ('function', 'class', 'variable') and owner_id is null").select(F.col("file_id").alias("to"), F.col("label").alias("name"), F.col("id").alias("d"))
    named = i.join(by.withColumnRenamed("module", "base"), ["unit", "base"])
    one = decl.groupBy("to", "name").agg(F.countDistinct("d").alias("n"), F.min("d").alias("d"))
    name = named.filter("name is not null").join(one, ["to", "name"]).select("import_id", F.when(F.col("n") == 1, F.col("d")).alias("target"), F.when(F.col("n") == 1, "declaration").otherwise("rebound").alias("how"), F.lit(1).alias("r"))
    whole = named.select("import_id", F.col("to").alias("target"), F.lit("module").alias("how"), F.lit(2).alias("r"))
    out = i.select("import_id", F.concat(F.lit("external:"), F.coalesce(F.when(F.col("base") != "", F.col("base")), "said")).alias("target"), F.lit("external-module").alias("how"), F.lit(3).alias("r"))
    best = sub.unionByName(name).unionByName(whole).unionByName(out).groupBy("import_id").agg(F.min(F.struct("r", "target", "how")).alias("x"))
    return best.select("import_id", "x.target", "x.how")


def overrides(facts: DataFrame) -> DataFrame:
    """(method, base_method, confidence): methods that redefine one of a base class, over any number of bases; exact where every name on the way is one class."""
    from weftgraph.plans.fixpoint import fixpoint

    p = lambda k: F.get_json_object("props", f"$.{k}")
    c = facts.filter("fact = 'node' and kind = 'class'").select(F.col("id").alias("class"), "label", F.explode_outer(F.from_json(p("bases"), "array<string>")).alias("base"))
    by_name = c.select("class", "label").distinct()
    many = by_name.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    up = c.filter("base is not null").select("class", F.regexp_replace("base", r"^.*\.|\[.*$", "").alias("label")).join(by_name.select(F.col("class").alias("above"), "label"), "label").join(many, "label").filter("class <> above").select("class", "above", (F.col("n") > 1).alias("vague")).distinct()
    step = lambda f: f.join(up.select(F.col("class").alias("x"), F.col("above").alias("y"), F.col("vague").alias("v")), f["above"] == F.col("x")).select("class", F.col("y").alias("above"), (F.col("vague") | F.col("v")).alias("vague"))
    found, _ = fixpoint(up, step, ["class", "above"])
    m = facts.filter("fact = 'node' and kind = 'method'").select(F.col("id").alias("method"), "label", p("class_id").alias("class"))
    j = found.filter("class <> above").join(m, "class").join(m.select(F.col("method").alias("base_method"), "label", F.col("class").alias("above")), ["label", "above"])
    return j.groupBy("method", "base_method").agg(F.min("vague").alias("vague")).select("method", "base_method", F.when(F.col("vague"), "high").otherwise("exact").alias("confidence"))


def call_candidates(facts: DataFrame) -> DataFrame:
    """(call_id, target, rung, n): bare names by their module's declarations, ``self.m()`` in its class, other methods by name alone if few declare it; too many give a row without a target."""
    p = lambda k: F.get_json_object("props", f"$.{k}")
    call = facts.filter("fact = 'node' and kind = 'call'").select("file_id", F.col("id").alias("call_id"), p("callee").alias("callee"), p("method_name").alias("method"), p("receiver").alias("receiver"), "owner_id")
    decl = facts.filter("fact = 'node' and kind in ('function', 'class')").select("file_id", F.col("label").alias("callee"), F.col("id").alias("target"))
    n = decl.groupBy("file_id", "callee").agg(F.countDistinct("target").alias("n"))
    bare = call.filter("method is null").join(n, ["file_id", "callee"]).join(decl, ["file_id", "callee"]).select("call_id", "target", F.when(F.col("n") == 1, "exact").otherwise("rebound").alias("rung"), "n")
    m = facts.filter("fact = 'node' and kind = 'method'").select(F.col("label").alias("method"), F.col("id").alias("target"), p("class_id").alias("class"))
    own = facts.filter("fact = 'node' and kind = 'method'").select(F.col("id").alias("owner_id"), p("class_id").alias("class"))
    mine = call.filter("receiver in ('self', 'cls')").join(own, "owner_id").join(m, ["method", "class"]).select("call_id", "target", F.lit("lexical-mro").alias("rung"), F.lit(1).cast("long").alias("n"))
    k = m.groupBy("method").agg(F.count(F.lit(1)).alias("n"))
    rest = call.filter("method is not null").join(mine.select("call_id"), "call_id", "left_anti").join(k, "method")
    few = rest.filter(F.col("n") <= DUCKS).join(m, "method").select("call_id", "target", F.lit("duck").alias("rung"), "n")
    over = rest.filter(F.col("n") > DUCKS).select("call_id", F.lit(None).cast("string").alias("target"), F.lit("over-cap").alias("rung"), "n")
    return bare.unionByName(mine).unionByName(few).unionByName(over).distinct()
