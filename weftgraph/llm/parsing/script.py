"""A parser of JavaScript modules, TypeScript and TSX.

Tokens are read on demand, since what ``/``, ``<``, ``}`` and a quote mean depends on the place.
Where a construct shows only behind its first tokens (arrow functions, type arguments) the parser
tries it and goes back if it fails.
"""

from __future__ import annotations

import re

from weftgraph.llm.parsing.base import Errors, Fault

_SPACE = re.compile(r"(?:[\s﻿]|//[^\n\r  ]*|/\*.*?\*/)+", re.S)
_LINE = re.compile(r"[\n\r  ]")
_TOKEN = re.compile(
    r"""(?P<name>(?:[^\W\d]|[$]|\\u(?:[0-9a-fA-F]{4}|\{[0-9a-fA-F]+\}))(?:[\w$‌‍]|\\u(?:[0-9a-fA-F]{4}|\{[0-9a-fA-F]+\}))*)
    |(?P<private>\#[^\W\d][\w$]*|\#[$][\w$]*)
    |(?P<number>0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[bB][01](?:_?[01])*n?|0[oO][0-7](?:_?[0-7])*n?|(?:(?:0|[1-9](?:_?[0-9])*)(?:n|\.?(?:[0-9](?:_?[0-9])*)?(?:[eE][+-]?[0-9](?:_?[0-9])*)?)|\.[0-9](?:_?[0-9])*(?:[eE][+-]?[0-9](?:_?[0-9])*)?))
    |(?P<string>"(?:[^"\\\n\r]|\\(?:\r\n|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|u\{[0-9a-fA-F]+\}|[^xu]))*"|'(?:[^'\\\n\r]|\\(?:\r\n|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|u\{[0-9a-fA-F]+\}|[^xu]))*')
    |(?P<template>`)
    |(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?![0-9])|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[-+*/%&|^!~<>=?:;,.(){}\[\]@])""",
    re.X | re.S,
)
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[\w$]*")
_JSX_NAME = re.compile(r"[^\W\d][\w$-]*(?:[:.][^\W\d][\w$-]*)*")
_JSX_TEXT = re.compile(r"[^{}<>]*")
_JSX_STRING = re.compile(r"\"[^\"]*\"|'[^']*'")

RESERVED = set("break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with enum".split())
STRICT = {"let", "static", "yield", "await", "implements", "interface", "package", "private", "protected", "public"}
MODIFIERS = {"public", "private", "protected", "readonly", "static", "abstract", "override", "declare", "accessor"}
BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="}
PREFIX = {"+", "-", "!", "~", "typeof", "void", "delete"}


class _Parser:
    def __init__(self, text: str, types: bool, jsx: bool):
        self.text, self.types, self.jsx = text, types, jsx
        self.errors = Errors()
        self.depth = 0
        self.cache: dict[int, tuple] = {}
        self.in_function = self.in_async = self.in_generator = False
        self.no_in = self.ambient = self.no_arrow_type = False
        self.last_end = 0
        start = re.match(r"#![^\n]*", text)
        self.go(start.end() if start else 0)

    # -- tokens: (kind, value, start, end, newline before)
    def read(self, at: int) -> tuple:
        t = self.cache.get(at)
        if t is None:
            text, begin, fresh = self.text, at, at == 0
            m = _SPACE.match(text, at)
            if m:
                fresh = fresh or bool(_LINE.search(m[0]))
                begin = m.end()
            if begin >= len(text):
                t = ("end", "", begin, begin, True)
            else:
                m = _TOKEN.match(text, begin)
                if not m or text.startswith("/*", begin):
                    t = ("bad", text[begin], begin, begin + 1, fresh)
                else:
                    kind, end = m.lastgroup, m.end()
                    if kind == "number" and end < len(text) and (text[end].isalnum() or text[end] in "_$\\"):
                        t = ("bad", m[0] + text[end], begin, end + 1, fresh)
                    else:
                        t = (kind, m[0], begin, end, fresh)
            self.cache[at] = t
        return t

    def go(self, at: int) -> None:
        self.at = at
        self.token = self.read(at)

    @property
    def value(self) -> str:
        return self.token[1] if self.token[0] in ("name", "op", "template") else ""

    @property
    def kind(self) -> str:
        return self.token[0]

    def next(self) -> None:
        if self.token[0] == "bad":
            self.fail("no token")
        self.last_end = self.token[3]
        self.go(self.token[3])

    def ahead(self, k: int = 1) -> tuple:
        t = self.token
        for _ in range(k):
            t = self.read(t[3])
        return t

    def fail(self, message: str, at: int | None = None):
        kind, value, start = self.token[:3]
        raise Fault(start if at is None else at, f"{message}, found {value[:20]!r}" if kind != "end" else f"{message}, found the end")

    def take(self, value: str) -> bool:
        if self.token[1] == value and self.token[0] in ("op", "name"):
            self.next()
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            self.fail(f"expected {value!r}")

    def word(self, value: str) -> bool:
        return self.token[0] == "name" and self.token[1] == value

    def is_name(self) -> bool:
        if self.token[0] != "name":
            return False
        v = self.token[1]
        return v not in RESERVED and (v not in STRICT or self.types and v not in ("yield", "await")) or v in ("await",) and self.types and not self.in_async

    def name(self) -> None:
        if not self.is_name():
            self.fail("expected a name")
        self.next()

    def deeper(self) -> None:
        self.depth += 1

    def state(self) -> tuple:
        return self.at, self.depth, self.in_function, self.in_async, self.in_generator, self.no_in, self.ambient, self.last_end, self.no_arrow_type

    def back(self, s: tuple) -> None:
        at, self.depth, self.in_function, self.in_async, self.in_generator, self.no_in, self.ambient, self.last_end, self.no_arrow_type = s
        self.go(at)

    def attempt(self, what, *args) -> bool:
        s, n = self.state(), len(self.errors)
        try:
            what(*args)
            if len(self.errors) == n:
                return True
        except Fault:
            pass
        del self.errors[n:]
        self.back(s)
        return False

    def end_statement(self) -> None:
        if self.take(";"):
            return
        if self.value == "}" or self.kind == "end" or self.token[4]:
            return
        self.fail("expected ';'")

    # -- panic mode
    def recover(self, start: int) -> None:
        """Skip to behind the next ';', before a '}' of this level or to a line that begins a statement."""
        level = 0
        if self.at <= start:
            self.go(start)
            if self.value != "}":
                self.go(self.token[3])
        while self.kind != "end":
            v = self.value
            if v == "{":
                level += 1
            elif v == "}":
                if level == 0:
                    return
                level -= 1
                if level == 0:
                    self.go(self.token[3])
                    return
            elif level == 0 and v == ";":
                self.go(self.token[3])
                return
            elif level == 0 and self.token[4] and v in ("function", "const", "let", "var", "class", "export", "import", "if", "for", "while", "return"):
                return
            if self.kind == "template":
                m = _TEMPLATE.match(self.text, self.token[3])
                self.go(min(len(self.text), m.end() + 1))
            else:
                self.go(self.token[3])

    # -- statements
    def module(self) -> None:
        while self.kind != "end":
            at = self.at
            self.statement_or_note(top=True)
            if self.value == "}" and self.at == at:
                self.errors.note(Fault(self.token[2], "unexpected '}'"))
                self.go(self.token[3])

    def statement_or_note(self, top: bool = False) -> None:
        s = self.state()
        try:
            if top and self.value == "}":
                self.fail("expected a statement")
            self.statement(top)
        except Fault as f:
            self.errors.note(f)
            at = self.at
            self.back(s)
            if at > s[0]:
                self.go(at)
            self.recover(s[0])

    def block(self) -> None:
        opened = self.token[2]
        self.need("{")
        self.deeper()
        saved, self.no_in = self.no_in, False
        while not self.take("}"):
            if self.kind == "end":
                raise Fault(opened, "block without end")
            self.statement_or_note()
        self.no_in = saved
        self.depth -= 1

    def statement(self, top: bool = False) -> None:
        self.deeper()
        v = self.value
        method = _STATEMENTS.get(v) if self.kind != "template" else None
        if v == "{":
            self.block()
        elif v == ";":
            self.next()
        elif v == "@":
            self.decorators()
            if not self.word("export") and not self.word("class") and not self.word("abstract"):
                self.fail("expected a class")
            self.statement(top)
        elif v == "import" and self.ahead()[1] not in ("(", "."):
            if not top:
                self.fail("import inside a block")
            self.import_statement()
        elif v == "export":
            if not top:
                self.fail("export inside a block")
            self.export_statement(top)
        elif v == "async" and self.ahead()[1] == "function" and not self.ahead()[4]:
            self.next()
            self.function(True)
        elif v == "let" and (self.ahead()[0] == "name" and self.ahead()[1] not in ("in", "instanceof", "of") or self.ahead()[1] in ("[", "{")):
            self.variables()
            self.end_statement()
        elif method is not None:
            method(self)
        elif self.types and self.kind == "name" and self.type_statement(top):
            pass
        elif self.is_name() and self.ahead()[1] == ":" and self.ahead()[0] == "op":
            self.next()
            self.next()
            self.statement()
        else:
            self.expression()
            self.end_statement()
        self.depth -= 1

    def type_statement(self, top: bool) -> bool:
        v, nxt = self.value, self.ahead()
        if v == "type" and nxt[0] == "name" and not nxt[4] and self.ahead(2)[1] in ("=", "<"):
            self.next()
            self.name()
            self.type_parameters()
            self.need("=")
            self.type()
            self.end_statement()
        elif v == "interface" and nxt[0] == "name" and not nxt[4]:
            self.next()
            self.name()
            self.type_parameters()
            if self.take("extends"):
                self.heritage()
            self.type_members()
        elif v in ("namespace", "module") and (nxt[0] == "name" or nxt[0] == "string") and not nxt[4]:
            self.next()
            if self.kind == "string":
                self.next()
            else:
                self.name()
                while self.take("."):
                    self.next()
            if self.value == "{":
                self.next()
                while not self.take("}"):
                    if self.kind == "end":
                        self.fail("expected '}'")
                    self.statement_or_note(top=True)
            else:
                self.end_statement()
        elif v == "global" and nxt[1] == "{":
            self.next()
            self.next()
            while not self.take("}"):
                if self.kind == "end":
                    self.fail("expected '}'")
                self.statement_or_note(top=True)
        elif v == "abstract" and nxt[1] == "class":
            self.next()
            self.class_()
        elif v == "declare" and nxt[0] == "name" and not nxt[4]:
            self.next()
            saved, self.ambient = self.ambient, True
            self.statement(top)
            self.ambient = saved
        else:
            return False
        return True

    def import_statement(self) -> None:
        self.need("import")
        if self.kind == "string":
            self.next()
            self.import_attributes()
            return self.end_statement()
        if self.types and self.word("type") and self.ahead()[1] not in (",", "from", "="):
            self.next()
        elif self.types and self.word("type") and self.ahead()[1] == "from" and self.ahead(2)[1] == "from":
            self.next()
        found = False
        if self.is_name():
            self.next()
            found = True
            if self.types and self.take("="):
                if self.word("require") and self.ahead()[1] == "(":
                    self.next()
                    self.next()
                    if self.kind != "string":
                        self.fail("expected a module name")
                    self.next()
                    self.need(")")
                else:
                    self.type()
                return self.end_statement()
        if not found or self.take(","):
            if self.take("*"):
                self.need("as")
                self.name()
            elif self.value == "{":
                self.specifiers(False)
            else:
                self.fail("expected what to import")
        self.need("from")
        if self.kind != "string":
            self.fail("expected a module name")
        self.next()
        self.import_attributes()
        self.end_statement()

    def import_attributes(self) -> None:
        if (self.word("with") or self.word("assert") and not self.token[4]) and self.ahead()[1] == "{":
            self.next()
            self.object_literal()

    def specifiers(self, exporting: bool) -> bool:
        """A braced list of names; whether one of them can only come from another module."""
        foreign = False
        self.need("{")
        while not self.take("}"):
            if self.types and self.word("type") and self.ahead()[1] not in (",", "}", "as"):
                self.next()
            if self.kind not in ("name", "string"):
                self.fail("expected a name")
            plain = self.is_name()
            foreign = foreign or not plain
            self.next()
            if self.take("as"):
                if self.kind not in ("name", "string") or not exporting and not self.is_name():
                    self.fail("expected a name")
                self.next()
            elif not exporting and not plain:
                self.fail("expected 'as'")
            if not self.take(","):
                self.need("}")
                break
        return foreign

    def export_statement(self, top: bool) -> None:
        self.need("export")
        if self.take("default"):
            if self.word("function") or self.word("async") and self.ahead()[1] == "function" and not self.ahead()[4]:
                self.take("async")
                self.function(True, optional_name=True)
            elif self.word("class") or self.value == "@":
                self.decorators()
                self.class_()
            elif self.types and self.word("abstract") and self.ahead()[1] == "class":
                self.next()
                self.class_()
            elif self.types and self.word("interface"):
                self.type_statement(top)
            else:
                self.assignment()
                self.end_statement()
        elif self.take("*"):
            if self.take("as"):
                self.next()
            self.module_name()
        elif self.value == "{" or self.types and self.word("type") and self.ahead()[1] in ("{", "*"):
            if self.word("type"):
                self.next()
            if self.take("*"):
                if self.take("as"):
                    self.next()
                return self.module_name()
            foreign = self.specifiers(True)
            if foreign or self.word("from"):
                self.module_name()
            else:
                self.end_statement()
        elif self.types and self.take("="):
            self.expression()
            self.end_statement()
        elif self.types and self.word("as") and self.ahead()[1] == "namespace":
            self.next()
            self.next()
            self.name()
            self.end_statement()
        elif self.types and self.word("import"):
            self.import_statement()
        elif self.value in ("function", "class", "const", "let", "var", "async", "@") or self.types and self.value in ("type", "interface", "enum", "namespace", "module", "declare", "abstract"):
            before = self.at
            self.statement(False)
            if self.at == before:
                self.fail("expected a declaration")
        else:
            self.fail("expected a declaration")

    def module_name(self) -> None:
        self.need("from")
        if self.kind != "string":
            self.fail("expected a module name")
        self.next()
        self.import_attributes()
        self.end_statement()

    def variables(self) -> None:
        kind = self.value
        self.next()
        if kind == "const" and self.types and self.word("enum"):
            return self.enum()
        while True:
            pattern = self.value in ("[", "{")
            self.binding()
            if self.types:
                self.take("!")
                if self.take(":"):
                    self.type()
            if self.take("="):
                self.assignment()
            elif not self.no_in and (pattern or kind == "const") and not self.ambient:
                self.fail("expected '='")
            if not self.take(","):
                return

    def variable_statement(self) -> None:
        was_enum = self.ahead()[1] == "enum"
        self.variables()
        if not was_enum:
            self.end_statement()

    def enum(self) -> None:
        if not self.types:
            self.fail("enum")
        self.need("enum")
        self.name()
        self.need("{")
        while not self.take("}"):
            if self.kind not in ("name", "string"):
                self.property_name()
            else:
                self.next()
            if self.take("="):
                self.assignment()
            if not self.take(","):
                self.need("}")
                break

    def binding(self) -> None:
        self.deeper()
        if self.take("["):
            while not self.take("]"):
                if self.take(","):
                    continue
                self.take("...")
                self.binding()
                if self.take("="):
                    self.plain_assignment()
                if not self.take(","):
                    self.need("]")
                    break
        elif self.take("{"):
            while not self.take("}"):
                if self.take("..."):
                    self.name()
                else:
                    plain = self.is_name()
                    self.property_name()
                    if self.take(":"):
                        self.binding()
                    elif not plain:
                        self.fail("expected ':'")
                    if self.take("="):
                        self.plain_assignment()
                if not self.take(","):
                    self.need("}")
                    break
        else:
            self.name()
        self.depth -= 1

    def plain_assignment(self) -> None:
        saved, self.no_in = self.no_in, False
        self.assignment()
        self.no_in = saved

    def if_(self) -> None:
        self.next()
        self.condition()
        self.statement()
        if self.take("else"):
            self.statement()

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def for_(self) -> None:
        self.next()
        if self.word("await"):
            self.next()
        self.need("(")
        saved, self.no_in = self.no_in, True
        if self.value != ";":
            if self.value in ("var", "const") or self.word("let") and (self.ahead()[0] == "name" or self.ahead()[1] in ("[", "{")):
                self.variables()
            else:
                self.expression()
        self.no_in = saved
        if self.word("of"):
            self.next()
            self.assignment()
        elif self.take("in"):
            self.expression()
        else:
            self.need(";")
            if self.value != ";":
                self.expression()
            self.need(";")
            if self.value != ")":
                self.expression()
        self.need(")")
        self.statement()

    def while_(self) -> None:
        self.next()
        self.condition()
        self.statement()

    def do_(self) -> None:
        self.next()
        self.statement()
        self.need("while")
        self.condition()
        self.take(";")

    def jump(self) -> None:
        self.next()
        if self.kind == "name" and not self.token[4] and self.is_name():
            self.next()
        self.end_statement()

    def return_(self) -> None:
        if not self.in_function:
            self.fail("return outside a function")
        self.next()
        if self.value not in (";", "}") and self.kind != "end" and not self.token[4] or self.kind == "template":
            self.expression()
        self.end_statement()

    def throw_(self) -> None:
        self.next()
        if self.token[4]:
            self.fail("expected what to throw")
        self.expression()
        self.end_statement()

    def try_(self) -> None:
        self.next()
        self.block()
        found = False
        if self.take("catch"):
            found = True
            if self.take("("):
                self.binding()
                if self.types and self.take(":"):
                    self.type()
                self.need(")")
            self.block()
        if self.take("finally"):
            found = True
            self.block()
        if not found:
            self.fail("expected 'catch' or 'finally'")

    def switch_(self) -> None:
        self.next()
        self.condition()
        self.need("{")
        while not self.take("}"):
            if self.take("case"):
                self.expression()
                self.need(":")
            elif self.take("default"):
                self.need(":")
            else:
                self.fail("expected 'case'")
            while self.value not in ("case", "default", "}"):
                if self.kind == "end":
                    self.fail("expected '}'")
                self.statement_or_note()

    def debugger_(self) -> None:
        self.next()
        self.end_statement()

    def function_statement(self) -> None:
        self.function(True)

    def class_statement(self) -> None:
        self.class_()

    # -- functions and classes
    def function(self, statement: bool, optional_name: bool = False) -> None:
        is_async = self.text[max(0, self.token[2] - 200) : self.token[2]].rstrip().endswith("async")
        self.need("function")
        generator = self.take("*")
        if self.is_name() or self.kind == "name" and self.value in ("yield", "await") and not statement:
            self.next()
        elif statement and not optional_name:
            self.fail("expected a name")
        self.signature_and_body(is_async, generator, bodiless=self.types)

    def signature_and_body(self, is_async: bool, generator: bool, bodiless: bool = False) -> None:
        saved = self.in_function, self.in_async, self.in_generator, self.no_in
        self.in_function, self.in_async, self.in_generator, self.no_in = True, is_async, generator, False
        if self.types:
            self.type_parameters()
        self.parameters()
        if self.types and self.take(":"):
            self.return_type()
        if self.value == "{":
            saved_ambient, self.ambient = self.ambient, False
            self.block()
            self.ambient = saved_ambient
        elif bodiless:
            self.end_statement()
        else:
            self.fail("expected '{'")
        self.in_function, self.in_async, self.in_generator, self.no_in = saved

    def parameters(self) -> None:
        self.need("(")
        while not self.take(")"):
            self.decorators()
            if self.types:
                while self.kind == "name" and self.value in MODIFIERS and (self.ahead()[0] == "name" or self.ahead()[1] in ("{", "[")):
                    self.next()
            rest = self.take("...")
            if self.types and self.word("this"):
                self.next()
            else:
                self.binding()
            if self.types:
                self.take("?")
                if self.take(":"):
                    self.type()
            if self.take("="):
                self.plain_assignment()
            if rest and self.value != ")":
                self.fail("expected ')'")
            if not self.take(","):
                self.need(")")
                break

    def decorators(self) -> None:
        while self.value == "@":
            self.next()
            self.left_hand_side()

    def class_(self) -> None:
        self.need("class")
        if self.kind == "name" and not self.word("extends") and not (self.types and self.word("implements")):
            self.name()
        if self.types:
            self.type_parameters()
        if self.take("extends"):
            self.left_hand_side()
            if self.types and self.value == "<":
                self.type_arguments()
        if self.types and self.take("implements"):
            self.heritage()
        opened = self.token[2]
        self.need("{")
        self.deeper()
        while not self.take("}"):
            if self.kind == "end":
                raise Fault(opened, "class without end")
            if self.take(";"):
                continue
            s = self.state()
            try:
                self.class_member()
            except Fault as f:
                self.errors.note(f)
                at = self.at
                self.back(s)
                if at > s[0]:
                    self.go(at)
                self.recover(s[0])
        self.depth -= 1

    def heritage(self) -> None:
        while True:
            self.type()
            if not self.take(","):
                return

    def class_member(self) -> None:
        self.decorators()
        ends = ("(", "=", ";", "}", ":", "?", "!", "<", ",")
        while self.kind == "name" and (self.value == "static" or self.types and self.value in MODIFIERS) and self.ahead()[1] not in ends:
            static = self.value == "static"
            self.next()
            if static and self.value == "{":
                return self.block()
        if self.word("accessor") and self.ahead()[1] not in ends:
            self.next()
        is_async = generator = False
        if self.word("async") and self.ahead()[1] not in ends and not self.ahead()[4]:
            self.next()
            is_async = True
        if self.take("*"):
            generator = True
        if self.kind == "name" and self.value in ("get", "set") and self.ahead()[1] not in ends and not self.ahead()[4]:
            self.next()
        if self.types and self.value == "[" and self.attempt(self.index_signature):
            return self.end_statement()
        if self.kind == "private":
            self.next()
        else:
            self.property_name()
        if self.types:
            if not self.take("?"):
                self.take("!")
        if self.value == "(" or self.types and self.value == "<":
            return self.signature_and_body(is_async, generator, bodiless=self.types)
        if self.types and self.take(":"):
            self.type()
        if self.take("="):
            saved = self.in_function, self.in_async
            self.in_function = self.in_async = False
            self.plain_assignment()
            self.in_function, self.in_async = saved
        self.end_statement()

    def index_signature(self) -> None:
        self.need("[")
        self.name()
        self.need(":")
        self.type()
        self.need("]")
        self.take("?")
        if self.take(":"):
            self.type()

    # -- expressions
    def expression(self) -> None:
        self.assignment()
        while self.take(","):
            self.assignment()

    def arrow(self, is_async: bool) -> None:
        saved = self.in_function, self.in_async, self.in_generator, self.no_in
        self.in_function, self.in_async, self.in_generator = True, is_async, False
        if self.types and self.value == "<":
            self.type_parameters()
        if self.value == "(":
            self.no_in = False
            self.parameters()
            if self.types and self.take(":"):
                self.return_type()
            if self.value != "=>":
                self.fail("expected '=>'")
        else:
            self.name()
        if self.token[4]:
            self.fail("unexpected line break")
        self.need("=>")
        self.no_in = saved[3]
        self.arrow_body()
        self.in_function, self.in_async, self.in_generator, self.no_in = saved

    def arrow_body(self) -> None:
        if self.value == "{":
            self.block()
        else:
            self.assignment()

    def arrow_head(self, is_async: bool) -> None:
        """Only the part of an arrow function up to its arrow."""
        if self.types and self.value == "<":
            self.type_parameters()
        self.parameters()
        if self.types and self.take(":"):
            self.return_type()
        if self.value != "=>" or self.token[4]:
            self.fail("expected '=>'")

    def could_be_arrow(self) -> bool:
        """After '(': whether a parameter list can begin so (cheap test before an attempt)."""
        if self.value == "<":
            return True
        t = self.ahead()
        return t[1] in (")", "...", "{", "[", "@") or t[0] == "name"

    def assignment(self) -> None:
        self.deeper()
        v = self.value
        if v == "async" and not self.ahead()[4]:
            t = self.ahead()
            if t[0] == "name" and t[1] not in RESERVED and self.ahead(2)[1] == "=>":
                self.next()
                self.arrow(True)
                self.depth -= 1
                return
            if t[1] == "(" or self.types and t[1] == "<":
                s = self.state()
                self.next()
                if self.attempt(self.arrow_head, True):
                    self.back(s)
                    self.next()
                    self.arrow(True)
                    self.depth -= 1
                    return
                self.back(s)
        if self.kind == "name" and self.ahead()[1] == "=>" and self.is_name():
            self.arrow(False)
            self.depth -= 1
            return
        if (v == "(" or self.types and v == "<" and self.kind == "op" and not (self.jsx and self.ahead(2)[1] not in (",", "extends"))) and self.could_be_arrow():
            s = self.state()
            if self.attempt(self.arrow_head, False):
                self.back(s)
                self.arrow(False)
                self.depth -= 1
                return
        if v == "yield" and self.in_generator:
            self.next()
            if not self.token[4]:
                star = self.take("*")
                if star or self.value not in (")", "]", "}", ",", ";", ":", "in", "of") and self.kind != "end":
                    self.assignment()
            self.depth -= 1
            return
        start = self.token
        begin = self.at
        target = self.conditional()
        if self.kind == "op" and self.value in ASSIGN:
            if not target:
                self.fail("cannot be assigned to", start[2])
            if start[1] in ("{", "[") and self.value == "=":
                end = self.last_end
                del begin, end
            self.next()
            self.assignment()
        self.depth -= 1

    def conditional(self) -> bool:
        target = self.binary(1)
        if self.value == "?" and self.kind == "op":
            self.next()
            saved, self.no_in = self.no_in, False
            self.assignment()
            self.no_in = saved
            self.need(":")
            self.assignment()
            return False
        return target

    def binary(self, least: int) -> bool:
        unary_start = self.token
        target = self.unary()
        while True:
            v = self.token[1] if self.token[0] in ("op", "name") else ""
            if self.types and v in ("as", "satisfies") and self.token[0] == "name" and not self.token[4]:
                if least > 8:
                    return target
                self.next()
                if self.word("const"):
                    self.next()
                else:
                    self.type()
                continue
            level = BINARY.get(v, 0)
            if not level or level < least or v == "in" and self.no_in:
                return target
            if v == "**" and unary_start[1] in PREFIX and unary_start[0] in ("op", "name"):
                self.fail("needs brackets")
            self.next()
            self.binary(level if v == "**" else level + 1)
            target = False
            unary_start = ("", "")

    def unary(self) -> bool:
        v = self.token[1] if self.token[0] in ("op", "name") else ""
        if v in PREFIX:
            self.deeper()
            self.next()
            self.unary()
            self.depth -= 1
            return False
        if v in ("++", "--"):
            self.next()
            at = self.token[2]
            if not self.unary():
                self.fail("cannot be changed", at)
            return False
        if v == "await" and (self.in_async or not self.in_function):
            self.next()
            self.unary()
            return False
        if v == "<" and self.types and not self.jsx:
            self.next()
            if self.word("const"):
                self.next()
            else:
                self.type()
            self.need(">")
            self.unary()
            return False
        at = self.token[2]
        target = self.left_hand_side()
        if self.value in ("++", "--") and self.kind == "op" and not self.token[4]:
            if not target:
                self.fail("cannot be changed", at)
            self.next()
            return False
        return target

    def left_hand_side(self) -> bool:
        """A primary expression with its suffixes; whether it can be assigned to."""
        self.deeper()
        if self.word("new"):
            self.new()
            target = False
        elif self.word("super"):
            self.next()
            if self.value not in (".", "[", "("):
                self.fail("expected '.' or '('")
            target = False
        elif self.word("import"):
            self.next()
            if self.take("."):
                self.next()
            elif self.value != "(":
                self.fail("expected '('")
            target = False
        else:
            target = self.primary()
        while True:
            v = self.value
            if v == "." :
                self.next()
                self.member_name()
                target = True
            elif v == "?.":
                self.next()
                if self.value == "[":
                    self.next()
                    self.inner_expression()
                    self.need("]")
                elif self.value == "(":
                    self.arguments()
                elif self.kind == "template":
                    self.fail("unexpected template")
                elif self.types and self.value == "<":
                    self.type_arguments()
                    self.arguments()
                else:
                    self.member_name()
                target = False
            elif v == "[":
                self.next()
                self.inner_expression()
                self.need("]")
                target = True
            elif v == "(":
                self.arguments()
                target = False
            elif self.kind == "template":
                self.template()
                target = False
            elif self.types and v == "!" and not self.token[4] and self.ahead()[1] != "=":
                self.next()
            elif self.types and v in ("<", "<<") and self.attempt(self.call_types):
                target = False
            else:
                break
        self.depth -= 1
        return target

    def call_types(self) -> None:
        self.type_arguments()
        t = self.token
        if t[1] == "(" or t[0] == "template":
            return
        if t[0] in ("name", "number", "string", "private", "bad") and not t[4] or t[1] in ("[", "{", "+", "-", "!", "~", "<"):
            self.fail("no type arguments")

    def inner_expression(self) -> None:
        saved, self.no_in = self.no_in, False
        self.expression()
        self.no_in = saved

    def member_name(self) -> None:
        if self.kind not in ("name", "private"):
            self.fail("expected a name")
        self.next()

    def arguments(self) -> None:
        self.need("(")
        saved, self.no_in = self.no_in, False
        while not self.take(")"):
            self.take("...")
            self.assignment()
            if not self.take(","):
                self.need(")")
                break
        self.no_in = saved

    def new(self) -> None:
        self.need("new")
        if self.take("."):
            self.next()
            return
        if self.word("new"):
            self.new()
        elif self.word("import"):
            self.fail("unexpected import")
        else:
            if self.word("super"):
                self.next()
            else:
                self.primary()
            while True:
                if self.take("."):
                    self.member_name()
                elif self.value == "[":
                    self.next()
                    self.inner_expression()
                    self.need("]")
                elif self.kind == "template":
                    self.template()
                elif self.types and self.value == "!" and not self.token[4]:
                    self.next()
                else:
                    break
            if self.types and self.value == "<":
                self.attempt(self.type_arguments)
        if self.value == "(":
            self.arguments()

    def primary(self) -> bool:
        kind, v, start = self.token[:3]
        if kind == "name":
            if v == "function":
                self.function(False)
                return False
            if v == "async" and self.ahead()[1] == "function" and not self.ahead()[4]:
                self.next()
                self.function(False)
                return False
            if v == "class":
                self.class_()
                return False
            if v in ("this", "null", "true", "false"):
                self.next()
                return False
            if self.is_name():
                self.next()
                return True
            self.fail("expected an expression")
        if kind in ("number", "string"):
            self.next()
            return False
        if kind == "template":
            self.template()
            return False
        if kind == "private" and self.ahead()[1] == "in":
            self.next()
            return False
        if v == "(":
            self.next()
            saved, self.no_in = self.no_in, False
            self.expression()
            self.no_in = saved
            self.need(")")
            return True
        if v == "[":
            self.next()
            saved, self.no_in = self.no_in, False
            while not self.take("]"):
                if self.take(","):
                    continue
                self.take("...")
                self.assignment()
                if not self.take(","):
                    self.need("]")
                    break
            self.no_in = saved
            return True
        if v == "{":
            self.object_literal()
            return True
        if v in ("/", "/="):
            m = _REGEX.match(self.text, start)
            if not m:
                self.fail("regular expression without end")
            flags = m[0][m[0].rindex("/") + 1 :]
            if not set(flags) <= set("dgimsuvy") or len(set(flags)) != len(flags):
                self.fail("no flags of a regular expression")
            self.last_end = m.end()
            self.go(m.end())
            return False
        if v == "@":
            self.decorators()
            self.class_()
            return False
        if v == "<" and self.jsx:
            self.jsx_element()
            return False
        self.fail("expected an expression")
        return False

    def object_literal(self) -> None:
        self.need("{")
        self.deeper()
        saved, self.no_in = self.no_in, False
        while not self.take("}"):
            if self.take("..."):
                self.assignment()
            else:
                ends = (",", ":", "(", "}", "=", "<")
                is_async = generator = False
                if self.word("async") and self.ahead()[1] not in ends and not self.ahead()[4]:
                    self.next()
                    is_async = True
                if self.take("*"):
                    generator = True
                accessor = self.kind == "name" and self.value in ("get", "set") and self.ahead()[1] not in ends
                if accessor:
                    self.next()
                plain = self.is_name() or self.kind == "name" and self.value in ("yield", "await") and not self.in_async and not self.in_generator
                self.property_name()
                if self.value == "(" or self.types and self.value == "<":
                    self.signature_and_body(is_async, generator)
                elif accessor or is_async or generator:
                    self.fail("expected '('")
                elif self.take(":"):
                    self.assignment()
                elif not plain:
                    self.fail("expected ':'")
                elif self.take("="):
                    self.assignment()
            if not self.take(","):
                self.need("}")
                break
        self.no_in = saved
        self.depth -= 1

    def property_name(self) -> None:
        if self.take("["):
            saved, self.no_in = self.no_in, False
            self.assignment()
            self.no_in = saved
            self.need("]")
        elif self.kind in ("name", "string", "number"):
            self.next()
        else:
            self.fail("expected a property name")

    def template(self, of_type: bool = False) -> None:
        opened, at = self.token[2], self.token[3]
        self.deeper()
        while True:
            m = _TEMPLATE.match(self.text, at)
            at = m.end()
            if at >= len(self.text) or self.text[at] == "\\":
                raise Fault(opened, "template without end")
            if self.text[at] == "`":
                self.last_end = at + 1
                self.go(at + 1)
                self.depth -= 1
                return
            self.go(at + 2)
            if of_type:
                self.type()
            else:
                self.inner_expression()
            if self.value != "}":
                self.fail("expected '}'")
            at = self.token[3]

    # -- JSX, read from the characters
    def jsx_element(self) -> None:
        self.deeper()
        at = self.token[3]
        name, at, closed = self.jsx_open(at)
        while not closed:
            at = _JSX_TEXT.match(self.text, at).end()
            c = self.text[at : at + 1]
            if c == "{":
                self.go(at + 1)
                if self.value == "...":
                    self.next()
                if self.value != "}":
                    self.expression()
                if self.value != "}":
                    self.fail("expected '}'")
                at = self.token[3]
            elif c == "<":
                t = self.read(at + 1)
                if t[1] == "/":
                    m = _SPACE.match(self.text, t[3])
                    at = m.end() if m else t[3]
                    m = _JSX_NAME.match(self.text, at)
                    other = m[0] if m else ""
                    at = m.end() if m else at
                    m = _SPACE.match(self.text, at)
                    at = m.end() if m else at
                    if other != name or self.text[at : at + 1] != ">":
                        raise Fault(at, f"expected </{name}>")
                    at += 1
                    closed = True
                else:
                    self.go(at)
                    self.jsx_element()
                    at = self.last_end
            else:
                raise Fault(at, f"element {name} without end" if not c else f"unexpected {c!r}")
        self.last_end = at
        self.go(at)
        self.depth -= 1

    def jsx_open(self, at: int) -> tuple[str, int, bool]:
        def skip(k: int) -> int:
            m = _SPACE.match(self.text, k)
            return m.end() if m else k

        at = skip(at)
        if self.text[at : at + 1] == ">":
            return "", at + 1, False
        m = _JSX_NAME.match(self.text, at)
        if not m:
            raise Fault(at, "expected an element name")
        name, at = m[0], skip(m.end())
        if self.types and self.text[at : at + 1] == "<":
            self.go(at)
            self.type_arguments()
            at = skip(self.last_end)
        while True:
            c = self.text[at : at + 1]
            if c == ">":
                return name, at + 1, False
            if c == "/":
                at = skip(at + 1)
                if self.text[at : at + 1] != ">":
                    raise Fault(at, "expected '>'")
                return name, at + 1, True
            if c == "{":
                self.go(at + 1)
                self.need("...")
                self.assignment()
                if self.value != "}":
                    self.fail("expected '}'")
                at = skip(self.token[3])
                continue
            m = _JSX_NAME.match(self.text, at)
            if not m:
                raise Fault(at, "expected an attribute")
            at = skip(m.end())
            if self.text[at : at + 1] == "=":
                at = skip(at + 1)
                if self.text[at : at + 1] == "{":
                    self.go(at + 1)
                    self.assignment()
                    if self.value != "}":
                        self.fail("expected '}'")
                    at = skip(self.token[3])
                elif self.text[at : at + 1] == "<":
                    self.go(at)
                    self.jsx_element()
                    at = skip(self.last_end)
                else:
                    m = _JSX_STRING.match(self.text, at)
                    if not m:
                        raise Fault(at, "expected an attribute value")
                    at = skip(m.end())

    # -- types
    def close_angle(self) -> None:
        if self.kind == "op" and self.value.startswith(">"):
            end = self.token[2] + 1
            self.last_end = end
            self.cache.pop(end, None)
            self.go(end)
            return
        self.fail("expected '>'")

    def type_parameters(self) -> None:
        if self.value != "<":
            return
        self.next()
        while True:
            while self.word("const") or self.kind == "name" and self.value in ("in", "out") and self.ahead()[0] == "name":
                self.next()
            self.name()
            if self.take("extends"):
                self.type()
            if self.take("="):
                self.type()
            if not self.take(",") or self.value == ">":
                break
        self.close_angle()

    def type_arguments(self) -> None:
        if self.value == "<<":
            self.go(self.token[2] + 1)
            self.cache.pop(self.at, None)
            self.go(self.at)
        else:
            self.need("<")
        while True:
            self.type()
            if not self.take(","):
                break
        self.close_angle()

    def return_type(self) -> None:
        if self.word("asserts") and self.ahead()[0] == "name" and not self.ahead()[4] and self.ahead()[1] not in ("is",):
            self.next()
            self.next()
            if self.take("is"):
                self.type()
            return
        if (self.is_name() or self.word("this")) and self.ahead()[1] == "is" and not self.ahead()[4]:
            self.next()
            self.next()
        self.type()

    def type(self) -> None:
        self.deeper()
        if self.value == "<" or self.word("new") or self.word("abstract") and self.ahead()[1] == "new" or self.value == "(" and self.attempt(self.function_type_head):
            if self.value == "=>":
                self.next()
                self.return_type()
            else:
                self.take("abstract")
                self.take("new")
                self.function_type_head()
                self.need("=>")
                self.return_type()
        else:
            self.union()
            if self.word("extends") and not self.token[4] and not self.no_arrow_type:
                self.next()
                saved, self.no_arrow_type = self.no_arrow_type, True
                self.type()
                self.no_arrow_type = saved
                self.need("?")
                saved, self.no_arrow_type = self.no_arrow_type, False
                self.type()
                self.no_arrow_type = saved
                self.need(":")
                self.type()
        self.depth -= 1

    def function_type_head(self) -> None:
        self.type_parameters()
        self.parameters()
        if self.value != "=>":
            self.fail("expected '=>'")

    def union(self) -> None:
        if self.value in ("|", "&"):
            self.next()
        while True:
            self.type_operator()
            if self.value in ("|", "&") and self.kind == "op":
                self.next()
                if self.value == "(" and self.attempt(self.function_type_head):
                    self.next()
                    self.return_type()
                    return
                continue
            return

    def type_operator(self) -> None:
        if self.kind == "name" and self.value in ("keyof", "unique", "readonly", "infer") and (self.ahead()[0] in ("name", "string") or self.ahead()[1] in ("(", "[", "{")) and not self.ahead()[4]:
            infer = self.value == "infer"
            self.next()
            if infer:
                self.name()
                if self.word("extends"):
                    self.attempt(self.infer_bound)
                return
            return self.type_operator()
        self.simple_type()
        while True:
            if self.value == "[" and not self.token[4]:
                self.next()
                if not self.take("]"):
                    self.type()
                    self.need("]")
            else:
                return

    def infer_bound(self) -> None:
        self.need("extends")
        saved, self.no_arrow_type = self.no_arrow_type, True
        self.type()
        self.no_arrow_type = saved
        if self.value == "?":
            self.fail("a conditional type")

    def simple_type(self) -> None:
        kind, v = self.kind, self.token[1]
        if kind == "string" or kind == "number":
            self.next()
        elif kind == "template":
            self.template(of_type=True)
        elif v == "-" and self.ahead()[0] == "number":
            self.next()
            self.next()
        elif v == "(":
            self.next()
            saved, self.no_arrow_type = self.no_arrow_type, False
            self.type()
            self.no_arrow_type = saved
            self.need(")")
        elif v == "[":
            self.next()
            saved, self.no_arrow_type = self.no_arrow_type, False
            while not self.take("]"):
                self.take("...")
                if self.kind == "name" and (self.ahead()[1] == ":" or self.ahead()[1] == "?" and self.ahead(2)[1] == ":"):
                    self.next()
                    self.take("?")
                    self.need(":")
                self.type()
                self.take("?")
                if not self.take(","):
                    self.need("]")
                    break
            self.no_arrow_type = saved
        elif v == "{":
            self.type_members()
        elif kind == "name":
            if v == "typeof":
                self.next()
                if self.word("import"):
                    return self.import_type()
                self.next_word()
                while self.take("."):
                    self.member_name()
            elif v == "import":
                return self.import_type()
            elif v in ("void", "null", "this", "true", "false", "undefined"):
                self.next()
                return
            elif self.is_name() or v in ("await", "yield"):
                self.next()
                while self.value == "." and self.kind == "op":
                    self.next()
                    self.next_word()
            else:
                self.fail("expected a type")
            if self.value in ("<", "<<") and not self.token[4]:
                self.type_arguments()
        else:
            self.fail("expected a type")

    def next_word(self) -> None:
        if self.kind != "name":
            self.fail("expected a name")
        self.next()

    def import_type(self) -> None:
        self.need("import")
        self.need("(")
        self.type()
        if self.take(","):
            self.object_literal()
        self.need(")")
        while self.take("."):
            self.next_word()
        if self.value == "<":
            self.type_arguments()

    def type_members(self) -> None:
        self.need("{")
        self.deeper()
        saved, self.no_arrow_type = self.no_arrow_type, False
        if not self.attempt(self.mapped_type):
            while not self.take("}"):
                self.type_member()
                if not self.take(";") and not self.take(",") and self.value != "}" and not self.token[4]:
                    self.fail("expected ';'")
        self.no_arrow_type = saved
        self.depth -= 1

    def mapped_type(self) -> None:
        if self.value in ("+", "-"):
            self.next()
            if not self.word("readonly"):
                self.fail("expected 'readonly'")
        if self.word("readonly"):
            self.next()
        self.need("[")
        self.name()
        self.need("in")
        self.type()
        if self.take("as"):
            self.type()
        self.need("]")
        if self.value in ("+", "-"):
            self.next()
            self.need("?")
        else:
            self.take("?")
        if self.take(":"):
            self.type()
        self.take(";")
        self.need("}")

    def type_member(self) -> None:
        if self.value in ("(", "<"):
            self.type_parameters()
            self.parameters()
            if self.take(":"):
                self.return_type()
            return
        ends = ("(", ":", "?", ";", ",", "}", "<")
        if self.word("new") and self.ahead()[1] in ("(", "<"):
            self.next()
            self.type_parameters()
            self.parameters()
            if self.take(":"):
                self.type()
            return
        if self.word("readonly") and self.ahead()[1] not in ends:
            self.next()
        if self.kind == "name" and self.value in ("get", "set") and self.ahead()[1] not in ends:
            self.next()
        if self.value == "[" and self.attempt(self.index_signature):
            return
        self.property_name()
        self.take("?")
        if self.value in ("(", "<"):
            self.type_parameters()
            self.parameters()
            if self.take(":"):
                self.return_type()
        elif self.take(":"):
            self.type()


_STATEMENTS = {
    "if": _Parser.if_,
    "for": _Parser.for_,
    "while": _Parser.while_,
    "do": _Parser.do_,
    "break": _Parser.jump,
    "continue": _Parser.jump,
    "return": _Parser.return_,
    "throw": _Parser.throw_,
    "try": _Parser.try_,
    "switch": _Parser.switch_,
    "debugger": _Parser.debugger_,
    "function": _Parser.function_statement,
    "class": _Parser.class_statement,
    "var": _Parser.variable_statement,
    "const": _Parser.variable_statement,
    "enum": _Parser.enum,
}


def parse_script(text: str, types: bool, jsx: bool) -> list[tuple[int, str]]:
    """All errors of a JavaScript module or, with ``types``, of a TypeScript text (offset, message)."""
    p = _Parser(text, types, jsx)
    p.module()
    return list(p.errors)
