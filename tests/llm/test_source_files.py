from __future__ import annotations

import ast
import glob
import os

import pytest

parsing = pytest.importorskip("weftgraph.llm.parsing")
from weftgraph.llm import handwritten, syntax  # noqa: E402

GOOD = {
    "python": ["", "x = 1\n", "def f(a, /, b=1, *c, d, **e):\n  return f'{a!r:>{b}} {{}}'\n", "match x:\n  case [1, *_] if y: pass\n", "with (open(a) as b, c):\n\tpass\n", "a = [i async for i in x]\n", "try:\n pass\nexcept* E as e:\n pass\n", "\ufeffx: int = (yield)\n"],
    "c": ["", "#include <a.h>\n", "typedef struct s { int a : 3; } s_t;\nstatic s_t *f(const char *p, ...) { for (int i = 0; i < 3; i++) { x[i] = (s_t){ .a = 1 }; } return (void *)p; }\n", "#if 0\nbroken (\n#else\nint x;\n#endif\n", "int a['}'] = { 1, 0x1fUL, 1.5e3f, 'a' };", "u32 *f(struct q *, int (*cb)(void *, int));\n", "int f(a, b) int a; char *b; { goto out; out: return sizeof(int) * a; }"],
    "javascript": ["", "import a, { b as c } from 'x';\nexport default async function () { await a; }\n", "const f = ({ a, ...b } = {}) => a ?? /[/]x/g.test(`q${b}`);\n", "label: for (const x of y) { if (x) continue label; else break }\n", "class A extends B { static #p = 1; get x() { return this.#p } async *[k]() {} }\n", "a = b\n++c\n", "x = { async f() {}, get: 1, [k]: 2, 'q': 3 }"],
    "typescript": ["function f<T extends keyof U = any>(this: Window, a?: T[], ...b: [x: number, y?: string]): a is T { return <any>a!; }\n", "type M<T> = { readonly [K in keyof T]?: T[K] extends (infer R)[] ? R : never };\n", "declare module 'x' { export const y: typeof import('z'); }\n", "abstract class A<T> implements B, C<T> { constructor(private readonly a: number) { super() } abstract f(): void; [k: string]: any }\n", "const x = f<number>(1) as unknown as Map<string, Array<number>>;\nenum E { A = 1, B }\n", "let g = async <T,>(x: T): Promise<T> => x satisfies T;\n"],
    "tsx": ["const a = <div className=\"x\" {...p}>it's {b} <br/></div>;\n", "const b = <><A.B x={1}>{/* c */}</A.B></>;\n"],
}
BAD = {
    "python": ["x = (\n", "def f(:\n  pass\n", "if x:\npass\n", "x = 09\n", "f(a=1, b)\n", "1 = x\n", "<<<<<<< HEAD\n", "a\n  b\n", "print 'x'\n", "'''open\n", "x = f'{'\n", "try:\n  pass\n"],
    "c": ["int f( {", "int x = 1\nint y;", "export function f() {}", "int f() { return 1; ", "char c = 'a;\n", "/* open", "int a = 29bb;", "#if X\nint a;", "# Part\nint a;", "<html></html>"],
    "javascript": ["const x: number = 1;", "function f( {", "let = ;", "a b", "<<<<<<< HEAD\n", "return 1", "`open", "const a;", "x = {a: }", "{\"a\": 1, \"b\": 2}", "1 = 2"],
    "typescript": ["const x: = 1;", "function f(a: number { }", "interface A { x: }", "class { x", "type A number", "Notes for\nthe reader", "<div>"],
    "tsx": ["const a = <div>;", "const a = <div></span>;", "const b = <T>x;"],
}


@pytest.mark.parametrize("language,text", [(k, t) for k, ts in GOOD.items() for t in ts])
def test_good(language, text):
    assert parsing.parse(text, language) == []


@pytest.mark.parametrize("language,text", [(k, t) for k, ts in BAD.items() for t in ts])
def test_bad(language, text):
    errors = parsing.parse(text, language)
    assert errors and all(0 <= at <= len(text) + 1 for at, _ in errors)


def test_recovery_finds_later_errors():
    assert len(parsing.parse("int f() { a b c; }\nint g() { return ; }\nint h( { }\nint k() { x = ; }\n", "c")) >= 2
    assert len(parsing.parse("x = = 1\ny = 2\nz = ) 3\n", "python")) >= 2
    assert len(parsing.parse("let a = ;\nlet b = 2;\nlet c = ];\n", "javascript")) >= 2


def test_python_agrees_with_the_interpreter():
    files = sorted(glob.glob(os.path.dirname(os.__file__) + "/*.py"))[:60]
    for f in files:
        text = open(f, encoding="utf8").read()
        assert parsing.parse(text, "python") == [], f
        cut = text[: int(len(text) * 0.6)]
        try:
            ast.parse(cut)
            whole = True
        except SyntaxError:
            whole = False
        assert (parsing.parse(cut, "python") == []) == whole, f


def test_depth_and_length_do_not_break():
    for language in ("python", "c", "javascript", "typescript"):
        deep = ("int x = " if language == "c" else "x = ") + "(" * 20_000 + "1" + ")" * 20_000
        end = "\n" if language == "python" else ";"
        assert parsing.parse(deep + end, language) == [] and parsing.parse(deep[:-1] + end, language)
        assert parsing.parse("x = 1 " + "+ 1 " * 20_000 + ("\n" if language == "python" else ";"), language) == [] or language == "c"


FILE = "file_id string, path string, lines long, bytes long, text string, unit string, content_hash string, reason string, errors string"


def files(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], FILE)


def test_faulty_files(spark):
    rows = [("a", "u/x.py", 1, 1, "x = 1\n", "u", "h"), ("b", "u/y.py", 1, 1, "x = (\n", "u", "h"), ("b", "u/y.py", 1, 1, "x = (\n", "u", "h"), ("c", "u/z.c", None, None, None, "u", None), ("d", "u/q.md", 1, 1, "(", None, "h"), ("e", None, 1, 1, "(", None, "h"), (None, "v/w.js", 1, 1, "a b", None, "h")]
    got = {r.file_id: r.n_errors for r in syntax.faulty_files(files(spark, rows)).collect()}
    assert set(got) == {"b", None}
    rates = {(r.unit, r.language): (r.n_files, r.n_faulty, r.rate) for r in syntax.error_rates(files(spark, rows)).collect()}
    assert rates == {("u", "python"): (2, 1, 0.5), (None, "javascript"): (1, 1, 1.0)}
    assert syntax.faulty_files(files(spark, [])).collect() == []


def test_handwritten(spark):
    code = "int f(int a)\n{\n    return a + 1;\n}\n" * 10
    rows = [
        ("hand", "u/a/b.c", 4, 80, code, "u", "1"), ("copy1", "u/dep/one.c", 4, 400, code + "x", "u", "2"), ("copy2", "v/q/dep/one.c", 4, 400, code + "x", "v", "2"),
        ("lone", "w/dep2/one.c", 4, 400, code + "x", "w", "3"), ("vendor", "w/third_party/kit/z.c", 4, 80, code, "w", "4"), ("versioned", "w/lib/kit-1.2/z.c", 4, 80, code, "w", "5"), ("lib", "w/lib/z.c", 4, 80, code, "w", "6"),
        ("head", "w/h.c", 4, 80, "/*\n * Code generated by x 1. DO NOT EDIT.\n */\n" + code, "w", "7"), ("tail", "w/t.py", 4, 80, "x = 1\n# @generated by q\n", "w", "8"), ("string", "w/s.py", 4, 80, 'B = "Code generated by this writer. DO NOT EDIT."\n', "w", "9"),
        ("min", "w/m.js", 1, 500, "!function(){" + "var a=b?c(1):d;" * 40 + "}();", "w", "10"), ("longline", "w/l.py", 9, 900, "x = 1\n" * 8 + "# " + "word " * 150 + "\n", "w", "11"),
        ("data", "w/d.py", 20, 900, "DATA = [\n" + "    (1, 2, 0x1f),\n" * 20 + "]\n", "w", "12"), ("bigmin", "w/k.js", 3, 300_000, None, "w", "13"), ("bigdata", "w/k.py", 20_000, 1_400_000, None, "w", "14"), ("bighand", "w/k.c", 2_000, 60_000, None, "w", "15"),
        ("empty1", "w/e/x.py", 0, 0, "", "w", "e"), ("empty2", "v/e/x.py", 0, 0, "", "v", "e"), ("nulls", None, None, None, None, None, None), ("pb", "w/a_pb2.py", 1, 1, "x = 1\n", "w", "16"),
    ]
    got = {r.file_id for r in handwritten.not_handwritten(files(spark, rows + rows[:3])).select("file_id").distinct().collect()}
    assert got == {"copy1", "copy2", "vendor", "versioned", "head", "tail", "min", "data", "bigmin", "bigdata", "pb"}
    assert handwritten.not_handwritten(files(spark, [])).collect() == []
