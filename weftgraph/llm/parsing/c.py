"""A parser of C. Names of types that no declaration shows are accepted where a type can stand."""

from __future__ import annotations

import re

from weftgraph.llm.parsing.base import Errors, Fault

_SPACE = re.compile(r"(?:[ \t\r\n\f\v﻿]|\\\r?\n|//(?:[^\n\\]|\\\r?\n|\\.)*|/\*.*?\*/)+", re.S)
_TOKEN = re.compile(
    r"""(?P<number>\.?[0-9](?:[eEpP][+-]|[\w.']|\\\n)*)
    |(?P<string>(?:u8|[uUL])?"(?:[^"\\\n]|\\.|\\\r\n)*")
    |(?P<char>[uUL]?'(?:[^'\\\n]|\\.)+')
    |(?P<name>[^\W\d][\w$]*|\$[\w$]*)
    |(?P<op>\.\.\.|<<=|>>=|->|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||[-+*/%&|^]=|\#\#|<:|:>|<%|%>|[-+*/%&|^~!<>=?:;,.(){}\[\]\#])""",
    re.X | re.S,
)
_NUMBER = re.compile(r"(?:0[xX][0-9a-fA-F']+(?:[uU]?(?:ll|LL|[lL])?|(?:ll|LL|[lL])[uU]?|[wW][bB])?|0[bB][01']+[uUlL]*|(?:0[0-7']*|[1-9][0-9']*)(?:[uU]?(?:ll|LL|[lL])?|(?:ll|LL|[lL])[uU])?[ij]?|(?:[0-9']+\.?[0-9']*|\.[0-9']+)(?:[eE][+-]?[0-9]+)?(?:[fFlLij]|[dD][fFdDlL]|[fF](?:16|32|64|128)x?)?|0[xX](?:[0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)[pP][+-]?[0-9]+[fFlL]?)\Z")
_FLOAT_PART = re.compile(r"[.eEfF]")
_DIRECTIVE = re.compile(r"[ \t]*#[ \t]*([A-Za-z_]\w*|[0-9]+)?")
_DIRECTIVES = {"include", "define", "undef", "if", "ifdef", "ifndef", "elif", "elifdef", "elifndef", "else", "endif", "line", "error", "warning", "pragma", "ident", "include_next", "import", "assert", "unassert", "embed"}

STORAGE = {"typedef", "extern", "static", "auto", "register", "_Thread_local", "thread_local", "__thread", "inline", "__inline", "__inline__", "_Noreturn", "__extension__", "constexpr"}
QUALIFIER = {"const", "volatile", "restrict", "_Atomic", "__const", "__volatile__", "__restrict", "__restrict__", "__volatile"}
BASIC = {"void", "char", "short", "int", "long", "float", "double", "signed", "unsigned", "_Bool", "bool", "_Complex", "_Imaginary", "__int128", "_Float128", "_Decimal64", "__signed__", "__builtin_va_list"}
TAGGED = {"struct", "union", "enum"}
TYPEOF = {"typeof", "__typeof__", "__typeof", "typeof_unqual"}
ATTRIBUTE = {"__attribute__", "__attribute", "__declspec", "_Alignas", "alignas"}
STATEMENT = {"if", "else", "for", "while", "do", "switch", "case", "default", "break", "continue", "return", "goto"}
OTHER = {"sizeof", "_Alignof", "alignof", "_Generic", "_Static_assert", "static_assert", "asm", "__asm__", "__asm"}
TYPE_START = STORAGE | QUALIFIER | BASIC | TAGGED | TYPEOF | ATTRIBUTE
RESERVED = TYPE_START | STATEMENT | OTHER
BINARY = {"||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "<<": 8, ">>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10}
ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>="}
DIGRAPH = {"<:": "[", ":>": "]", "<%": "{", "%>": "}"}


class _Lexer:
    """Tokens (kind, text, offset) of the branches that a preprocessor would most plainly take."""

    def __init__(self, text: str, errors: Errors):
        self.text, self.errors = text, errors
        self.tokens: list[tuple[str, str, int]] = []
        self._run()
        self.tokens.append(("end", "", len(text)))

    def _run(self) -> None:
        text, at, n = self.text, 0, len(self.text)
        branches: list[list] = []  # [taken now, taken before, else seen]
        fresh = True
        while at < n:
            m = _SPACE.match(text, at)
            if m:
                fresh = fresh or "\n" in m[0]
                at = m.end()
                continue
            if text.startswith("/*", at):
                self.errors.note(Fault(at, "comment without end"))
                return
            if text[at] == "#" and fresh:
                at = self._directive(at, branches)
                continue
            fresh = False
            m = _TOKEN.match(text, at)
            off = any(not b[0] for b in branches)
            if not m:
                if not off:
                    self.errors.note(Fault(at, "string without end" if text[at] in "\"'" else f"stray character {text[at]!r}"))
                if text[at] in "\"'":
                    end = text.find("\n", at)
                    at = n if end < 0 else end
                else:
                    at += 1
                continue
            if not off:
                kind, value = m.lastgroup, m[0]
                if kind == "number":
                    bare = value.replace("\\\n", "")
                    octal = re.match(r"0[0-9']*[89]", bare)
                    if not _NUMBER.match(bare) or octal and not _FLOAT_PART.search(bare):
                        self.errors.note(Fault(at, f"no number: {value[:20]}"))
                self.tokens.append((kind, DIGRAPH.get(value, value), at))
            at = m.end()
        if branches:
            self.errors.note(Fault(n, "#if without #endif"))

    def _directive(self, at: int, branches: list[list]) -> int:
        m = _DIRECTIVE.match(self.text, at)
        name, end = m[1], m.end()
        while end < len(self.text) and self.text[end] != "\n":
            c = _SPACE.match(self.text, end)
            if self.text[end] == "\\" and c:
                end += 2 if self.text[end + 1 : end + 2] == "\n" else 3
            elif self.text.startswith("/*", end) and c:
                end = self.text.index("*/", end + 2) + 2
            else:
                end += 1
        off = any(not b[0] for b in branches)
        rest = self.text[m.end() : end].strip()
        if name and not name.isdigit() and name not in _DIRECTIVES and not off:
            self.errors.note(Fault(at, f"no directive: #{name}"))
        elif name in ("if", "ifdef", "ifndef"):
            if not rest:
                self.errors.note(Fault(at, f"#{name} without condition"))
            taken = not (name == "if" and rest == "0")
            branches.append([taken, taken, False])
        elif name in ("elif", "elifdef", "elifndef", "else"):
            if not branches or branches[-1][2]:
                self.errors.note(Fault(at, f"#{name} without #if"))
            else:
                b = branches[-1]
                b[0] = not b[1]
                b[1], b[2] = True, name == "else"
        elif name == "endif":
            if branches:
                branches.pop()
            else:
                self.errors.note(Fault(at, "#endif without #if"))
        elif name in ("include", "include_next", "import") and not off and not re.match(r"<[^>\n]+>|\"[^\"\n]+\"|[A-Za-z_]", rest):
            self.errors.note(Fault(at, "#include without a name"))
        elif name in ("define", "undef") and not off and not re.match(r"[^\W\d]\w*", rest):
            self.errors.note(Fault(at, f"#{name} without a name"))
        return end


class _Parser:
    def __init__(self, text: str):
        self.errors = Errors()
        self.tokens = _Lexer(text, self.errors).tokens
        self.i = self.depth = 0
        self.types: set[str] = set()

    # -- tokens
    @property
    def value(self) -> str:
        kind, value, _ = self.tokens[self.i]
        return value if kind in ("name", "op", "end") else ""

    @property
    def kind(self) -> str:
        return self.tokens[self.i][0]

    def peek(self, k: int = 1) -> tuple[str, str]:
        kind, value, _ = self.tokens[min(self.i + k, len(self.tokens) - 1)]
        return kind, value if kind in ("name", "op", "end") else ""

    def fail(self, message: str):
        kind, value, at = self.tokens[self.i]
        raise Fault(at, f"{message}, found {value[:20]!r}" if kind != "end" else f"{message}, found the end")

    def take(self, value: str) -> bool:
        if self.value == value and self.kind != "end":
            self.i += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            self.fail(f"expected {value!r}")

    def plain_name(self) -> bool:
        return self.kind == "name" and self.value not in RESERVED

    def need_name(self) -> str:
        if not self.plain_name():
            self.fail("expected a name")
        self.i += 1
        return self.tokens[self.i - 1][1]

    def deeper(self) -> None:
        self.depth += 1

    # -- panic mode
    def recover(self, start: int) -> None:
        """Skip to behind the next ';' or before a '}' of this level, at least one token."""
        level = 0
        self.i = max(self.i, start)
        if self.i == start and self.value != "}":
            self.i += 1
        while self.kind != "end":
            v = self.value
            if v == "{":
                level += 1
            elif v == "}":
                if level == 0:
                    return
                level -= 1
                if level == 0:
                    self.i += 1
                    return
            elif v == ";" and level == 0:
                self.i += 1
                return
            self.i += 1

    # -- declarations
    def unit(self) -> None:
        while self.kind != "end":
            start = self.i
            self.depth = 0
            try:
                self.external()
            except Fault as f:
                self.errors.note(f)
                self.recover(start)
                if self.value == "}":
                    self.i += 1

    def external(self) -> None:
        if self.take(";"):
            return
        if self.value in ("asm", "__asm__", "__asm"):
            return self.asm()
        self.declaration(outer=True)

    def asm(self) -> None:
        self.i += 1
        while self.value in QUALIFIER or self.value in ("goto", "inline"):
            self.i += 1
        self.balanced()
        self.need(";")

    def balanced(self) -> None:
        """A bracketed run of tokens of any kind."""
        if self.value not in ("(", "["):
            self.fail("expected '('")
        stack = []
        while True:
            v = self.value
            if self.kind == "end":
                self.fail("expected a closing bracket")
            if v in ("(", "[", "{"):
                stack.append({"(": ")", "[": "]", "{": "}"}[v])
            elif v in (")", "]", "}"):
                if v != stack.pop():
                    self.fail("brackets do not match")
            self.i += 1
            if not stack:
                return

    def attributes(self) -> None:
        while True:
            if self.value in ATTRIBUTE or self.value in ("__asm__", "asm", "__asm"):
                self.i += 1
                self.balanced()
            elif self.value == "[" and self.peek()[1] == "[":
                self.balanced()
            else:
                return

    def specifiers(self) -> bool:
        """Declaration specifiers; whether a type was among them."""
        typed = False
        while True:
            self.attributes()
            v = self.value
            if v in STORAGE or v in QUALIFIER:
                self.i += 1
                if v == "_Atomic" and self.value == "(":
                    self.balanced()
                    typed = True
            elif v in BASIC:
                self.i += 1
                typed = True
            elif v in TAGGED:
                self.tagged()
                typed = True
            elif v in TYPEOF:
                self.i += 1
                self.balanced()
                typed = True
            elif self.plain_name() and not typed:
                # a name is the type if a declarator can follow it
                kind, nxt = self.peek()
                if kind == "name" and nxt not in STATEMENT or nxt == "*" or (nxt == "(" and self.value in self.types) or (nxt in (")", ",", ";", ":") and self.value in self.types):
                    self.i += 1
                    typed = True
                elif nxt == "(" and self.peek(2)[1] == "*":
                    self.i += 1
                    typed = True
                else:
                    return typed
            elif self.plain_name() and typed and self.peek()[0] == "name" and self.peek()[1] not in RESERVED and self.value.isupper():
                self.i += 1  # a macro between the type and the declarator
            else:
                return typed

    def tagged(self) -> None:
        kind = self.value
        self.i += 1
        self.attributes()
        named = self.plain_name()
        if named:
            self.i += 1
        self.attributes()
        if kind == "enum" and self.take(":"):
            self.specifiers()
        if self.take("{"):
            if kind == "enum":
                while not self.take("}"):
                    self.need_name()
                    self.attributes()
                    if self.take("="):
                        self.conditional()
                    if not self.take(","):
                        self.need("}")
                        break
            else:
                while not self.take("}"):
                    if self.kind == "end":
                        self.fail("expected '}'")
                    self.member()
        elif not named:
            self.fail(f"expected a name or a body of {kind}")

    def member(self) -> None:
        if self.take(";"):
            return
        if self.value in ("_Static_assert", "static_assert"):
            self.i += 1
            self.balanced()
            self.need(";")
            return
        if self.plain_name() and self.peek()[1] == "(" and self.value.isupper():
            self.i += 1  # a macro that makes members
            self.balanced()
            self.take(";")
            return
        if not self.specifiers():
            if not self.plain_name():
                self.fail("expected a type")
            self.i += 1
        if self.take(";"):
            return
        while True:
            if self.value != ":":
                self.declarator()
            if self.take(":"):
                self.conditional()
            self.attributes()
            if not self.take(","):
                break
        self.need(";")

    def declaration(self, outer: bool = False) -> None:
        self.attributes()
        if self.value in ("_Static_assert", "static_assert"):
            self.i += 1
            self.balanced()
            self.need(";")
            return
        is_type = self.value == "typedef"
        start = self.i
        typed = self.specifiers()
        if typed and self.take(";"):
            return
        if not typed and not outer and self.i == start:
            self.fail("expected a declaration")
        if not typed and not (self.plain_name() and self.peek()[1] in ("(", ";", "=", "[", ",")):
            self.fail("expected a declaration")
        if not typed and self.i == start and self.peek()[1] != "(":
            self.fail("expected a type")
        first = True
        while True:
            if not typed:
                # a function without a type, or a macro used as a declaration
                self.i += 1
                self.balanced()
                function = True
                if self.take(";"):
                    return
                if outer and self.value != "{":
                    if self.plain_name() or self.value in TYPE_START or self.kind == "end":
                        return
                    self.fail("expected ';'")
            else:
                name, function = self.declarator()
                if is_type and name:
                    self.types.add(name)
            self.attributes()
            if first and function and outer:
                if self.value in TYPE_START and self.value not in ATTRIBUTE or self.plain_name() and self.peek()[0] == "name":
                    while self.value != "{":  # parameters declared behind the list
                        self.declaration()
                if self.value == "{":
                    self.block()
                    return
            if self.take("="):
                self.initializer()
            first = False
            if not self.take(","):
                break
            typed = True
        self.need(";")

    def declarator(self, abstract: bool = False) -> tuple[str, bool]:
        """The declared name ('' if abstract) and whether the outermost suffix is a parameter list."""
        self.deeper()
        self.attributes()
        while self.value == "*" or self.value in QUALIFIER or self.value == "^":
            self.i += 1
            self.attributes()
        name, function = "", False
        if self.value == "(" and (not abstract or self.peek()[1] in ("*", "(", "[", "^") or self.peek()[1] in ATTRIBUTE or (self.peek()[0] == "name" and self.peek()[1] not in TYPE_START and self.peek()[1] not in self.types and self.peek(2)[1] == ")" and self.peek(3)[1] in ("(", "["))):
            self.i += 1
            name, _ = self.declarator(abstract)
            self.need(")")
        elif self.plain_name():
            name = self.need_name()
        elif not abstract:
            self.fail("expected a name")
        while True:
            self.attributes()
            if self.value == "[":
                self.i += 1
                while self.value in QUALIFIER or self.value == "static":
                    self.i += 1
                if self.value == "*" and self.peek()[1] == "]":
                    self.i += 1
                elif self.value != "]":
                    self.assignment()
                self.need("]")
            elif self.value == "(":
                self.parameters()
                function = True
            else:
                break
        self.depth -= 1
        return name, function

    def parameters(self) -> None:
        self.need("(")
        if self.take(")"):
            return
        while True:
            if self.take("..."):
                break
            self.attributes()
            if not self.specifiers():
                if self.kind != "name" or self.value in RESERVED:
                    self.fail("expected a parameter")
                self.i += 1  # a type name alone, or a name whose type comes behind the list
                while self.value == "*":
                    self.i += 1
                if self.value not in (",", ")", "["):
                    self.fail("expected ',' or ')'")
            self.declarator(abstract=True)
            if not self.take(","):
                break
        self.need(")")

    def type_name(self) -> None:
        if not self.specifiers():
            self.need_name()
        self.declarator(abstract=True)

    def initializer(self) -> None:
        if not self.take("{"):
            return self.assignment()
        self.deeper()
        while not self.take("}"):
            designated = False
            while self.value in (".", "["):
                designated = True
                if self.take("."):
                    self.need_name()
                else:
                    self.i += 1
                    self.conditional()
                    if self.take("..."):
                        self.conditional()
                    self.need("]")
            if designated:
                self.take("=")
            elif self.plain_name() and self.peek()[1] == ":":
                self.i += 2
            self.initializer()
            if not self.take(","):
                self.need("}")
                break
        self.depth -= 1

    # -- statements
    def block(self) -> None:
        self.need("{")
        self.deeper()
        opened = self.tokens[self.i - 1][2]
        while not self.take("}"):
            if self.kind == "end":
                raise Fault(opened, "block without end")
            start, depth = self.i, self.depth
            try:
                self.item()
            except Fault as f:
                self.errors.note(f)
                self.depth = depth
                self.recover(start)
        self.depth -= 1

    def starts_declaration(self) -> bool:
        v = self.value
        if v in TYPE_START or v in ("_Static_assert", "static_assert"):
            return True
        if not self.plain_name():
            return False
        kind, nxt = self.peek()
        if kind == "name" and nxt not in RESERVED or nxt in QUALIFIER:
            return True
        if nxt == "*":
            k = 2
            while self.peek(k)[1] == "*" or self.peek(k)[1] in QUALIFIER:
                k += 1
            kind, name = self.peek(k)
            return kind == "name" and name not in RESERVED and self.peek(k + 1)[1] in (";", "=", ",", "[")
        return False

    def item(self) -> None:
        if self.plain_name() and self.peek()[1] == ":" :
            self.i += 2
            return
        if self.starts_declaration():
            return self.declaration()
        self.statement()

    def statement(self) -> None:
        self.deeper()
        self.attributes()
        v = self.value
        if v == "{":
            self.block()
        elif v == ";":
            self.i += 1
        elif self.plain_name() and self.peek()[1] == ":":
            self.i += 2
            if self.value != "}":
                self.item()
        elif v == "if":
            self.i += 1
            self.condition()
            self.statement()
            if self.take("else"):
                self.statement()
        elif v == "while" or v == "switch":
            self.i += 1
            self.condition()
            self.statement()
        elif v == "do":
            self.i += 1
            self.statement()
            self.need("while")
            self.condition()
            self.need(";")
        elif v == "for":
            self.i += 1
            self.need("(")
            if self.starts_declaration():
                self.declaration()
            else:
                if self.value != ";":
                    self.expression()
                self.need(";")
            if self.value != ";":
                self.expression()
            self.need(";")
            if self.value != ")":
                self.expression()
            self.need(")")
            self.statement()
        elif v == "case":
            self.i += 1
            self.conditional()
            if self.take("..."):
                self.conditional()
            self.need(":")
            if self.value != "}":
                self.item()
        elif v == "default":
            self.i += 1
            self.need(":")
            if self.value != "}":
                self.item()
        elif v in ("break", "continue"):
            self.i += 1
            self.need(";")
        elif v == "return":
            self.i += 1
            if self.value == "{":
                self.initializer()
            elif self.value != ";":
                self.expression()
            self.need(";")
        elif v == "goto":
            self.i += 1
            if self.take("*"):
                self.expression()
            else:
                self.need_name()
            self.need(";")
        elif v in ("asm", "__asm__", "__asm"):
            self.asm()
        else:
            self.expression()
            if self.value == "{" and self.tokens[self.i - 1][1] == ")" :
                self.block()  # a macro that makes a loop
            else:
                self.need(";")
        self.depth -= 1

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    # -- expressions
    def expression(self) -> None:
        self.assignment()
        while self.take(","):
            self.assignment()

    def assignment(self) -> None:
        self.conditional()
        if self.value in ASSIGN and self.kind == "op":
            self.i += 1
            if self.value == "{":
                self.initializer()
            else:
                self.assignment()

    def conditional(self) -> None:
        self.binary(1)
        if self.take("?"):
            if self.value != ":":
                self.expression()
            self.need(":")
            self.conditional()

    def binary(self, least: int) -> None:
        self.unary()
        while self.kind == "op":
            level = BINARY.get(self.value, 0)
            if level < least or not level:
                return
            self.i += 1
            self.binary(level + 1)

    def is_type(self, k: int = 0) -> bool:
        kind, v = self.peek(k)
        if kind != "name":
            return False
        if v in TYPE_START or v in self.types:
            return True
        if v in RESERVED:
            return False
        k += 1
        stars = 0
        while self.peek(k)[1] == "*" or self.peek(k)[1] in QUALIFIER:
            stars += 1
            k += 1
        return stars > 0 and self.peek(k)[1] == ")"

    def unary(self) -> None:
        self.deeper()
        v = self.value if self.kind in ("op", "name") else ""
        if v in ("++", "--", "+", "-", "!", "~", "*", "&", "__extension__", "__real__", "__imag__"):
            self.i += 1
            self.unary()
        elif v == "&&":
            self.i += 1
            self.need_name()
        elif v in ("sizeof", "_Alignof", "alignof", "__alignof__"):
            self.i += 1
            if self.value == "(" and self.is_type(1):
                self.i += 1
                self.type_name()
                self.need(")")
                if self.value == "{":
                    self.initializer()
            else:
                self.unary()
        elif v == "(" and self.is_type(1):
            self.i += 1
            self.type_name()
            self.need(")")
            if self.value == "{":
                self.initializer()
                self.postfix()
            else:
                self.unary()
        else:
            simple = v == "(" and self.peek()[0] == "name" and self.peek()[1] not in RESERVED and self.peek(2)[1] == ")"
            self.primary()
            if simple and (self.kind in ("number", "string", "char") or self.plain_name() or self.value in ("~", "!", "{", "sizeof")):
                if self.value == "{":
                    self.initializer()
                else:
                    self.unary()
            else:
                self.postfix()
        self.depth -= 1

    def primary(self) -> None:
        kind, v = self.kind, self.value
        if kind == "number" or kind == "char":
            self.i += 1
        elif kind == "string":
            while self.kind == "string" or self.plain_name() and self.peek()[0] == "string":
                self.i += 1
            if self.plain_name() and self.value.isupper():
                self.i += 1  # a macro that stands for a string
        elif v == "(":
            self.i += 1
            if self.value == "{":
                self.block()
            else:
                self.expression()
            self.need(")")
        elif v == "_Generic":
            self.i += 1
            self.balanced()
        elif self.plain_name():
            self.i += 1
            while self.kind == "string":
                self.i += 1
        else:
            self.fail("expected an expression")

    def postfix(self) -> None:
        while True:
            v = self.value if self.kind == "op" else ""
            if v == "[":
                self.i += 1
                self.expression()
                self.need("]")
            elif v == "(":
                self.i += 1
                if not self.take(")"):
                    while True:
                        if self.value in TYPE_START or self.is_type_argument():
                            self.type_name()
                        elif self.value == "{":
                            self.initializer()
                        else:
                            self.assignment()
                        if not self.take(","):
                            break
                    self.need(")")
            elif v in (".", "->"):
                self.i += 1
                self.need_name()
            elif v in ("++", "--"):
                self.i += 1
            else:
                return

    def is_type_argument(self) -> bool:
        if not self.plain_name():
            return False
        k = 1
        while self.peek(k)[1] == "*":
            k += 1
        return k > 1 and self.peek(k)[1] in (")", ",")


def parse_c(text: str) -> list[tuple[int, str]]:
    """All errors of a C text (offset, message)."""
    p = _Parser(text)
    p.unit()
    return list(p.errors)
