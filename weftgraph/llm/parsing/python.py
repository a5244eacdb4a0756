"""A parser of Python 3."""

from __future__ import annotations

import re
import unicodedata

from weftgraph.llm.parsing.base import Errors, Fault

_BLANK = re.compile(r"[ \t\f]*")
_NUMBER = re.compile(r"0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:[0-9](?:_?[0-9])*\.(?:[0-9](?:_?[0-9])*)?|\.[0-9](?:_?[0-9])*)(?:[eE][-+]?[0-9](?:_?[0-9])*)?[jJ]?|[0-9](?:_?[0-9])*[eE][-+]?[0-9](?:_?[0-9])*[jJ]?|[0-9](?:_?[0-9])*[jJ]|[1-9](?:_?[0-9])*|0(?:_?0)*")
_PREFIX = re.compile(r"(?:[bB][rR]?|[rR][bBfFtT]?|[uU]|[fF][rR]?|[tT][rR]?)?(?='|\")")
_NAME = re.compile(r"[^\W\d]\w*")
_OP = re.compile(r"\*\*=|//=|>>=|<<=|\.\.\.|->|:=|\*\*|//|>>|<<|<=|>=|==|!=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|[-+*/%@&|^~<>()\[\]{},:.;=]")

KEYWORDS = set("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
AUGMENTED = {"+=", "-=", "*=", "/=", "//=", "%=", "@=", "&=", "|=", "^=", ">>=", "<<=", "**="}
COMPARE = {"<", ">", "==", ">=", "<=", "!=", "in", "is", "not"}
BINARY = {"|": 1, "^": 2, "&": 3, "<<": 4, ">>": 4, "+": 5, "-": 5, "*": 6, "/": 6, "//": 6, "%": 6, "@": 6}
CLOSING = {"(": ")", "[": "]", "{": "}"}
#: What an expression is, as far as targets are concerned.
NAME, ATTRIBUTE, SEQUENCE, STAR, OTHER = "name", "attribute", "sequence", "star", "other"


class _Lexer:
    def __init__(self, text: str, errors: Errors):
        self.text, self.errors = text, errors
        self.tokens: list[tuple[str, str, int]] = []
        self.run()

    def add(self, kind: str, value: str, at: int) -> None:
        self.tokens.append((kind, value, at))

    def note(self, at: int, message: str) -> None:
        self.errors.note(Fault(at, message))

    def run(self) -> None:
        text, n = self.text, len(self.text)
        at = 1 if text.startswith("﻿") else 0
        indents, alternate = [0], [0]
        brackets: list[tuple[str, int]] = []
        fresh = True
        while at < n:
            if fresh and not brackets:
                begin = at
                column = other = 0
                while at < n and text[at] in " \t\f":
                    if text[at] == "\t":
                        column, other = (column // 8 + 1) * 8, other + 1
                    elif text[at] == "\f":
                        column = other = 0
                    else:
                        column, other = column + 1, other + 1
                    at += 1
                if at >= n:
                    break
                if text[at] in "#\n\r":
                    at = self.line_end(at)
                    continue
                if text[at] == "\\" and text[at + 1 : at + 2] in ("\n", "\r"):
                    at = self.line_end(at)
                    fresh = False
                    continue
                if column > indents[-1]:
                    if other <= alternate[-1]:
                        self.note(begin, "tabs and blanks do not agree")
                    indents.append(column)
                    alternate.append(other)
                    self.add("indent", "", at)
                else:
                    while column < indents[-1]:
                        indents.pop()
                        alternate.pop()
                        self.add("dedent", "", at)
                    if column != indents[-1]:
                        self.note(at, "indentation matches no outer level")
                        indents.append(column)
                        alternate.append(other)
                        self.add("indent", "", at)
                    elif other != alternate[-1]:
                        self.note(begin, "tabs and blanks do not agree")
                fresh = False
                continue
            fresh = False
            c = text[at]
            if c in " \t\f":
                at = _BLANK.match(text, at).end()
            elif c == "#":
                end = self.line_end(at)
                at = end - 1 if end > at and text[end - 1] in "\n\r" else end
                if at > 0 and text[at - 1 : at + 1] == "\r\n":
                    at -= 1
            elif c in "\n\r":
                if not brackets:
                    self.add("newline", "", at)
                    fresh = True
                at = self.line_end(at)
            elif c == "\\":
                if text[at + 1 : at + 2] in ("\n", "\r"):
                    at = self.line_end(at)
                    if at >= n:
                        self.note(n, "nothing behind the line's continuation")
                else:
                    self.note(at, "stray backslash")
                    at += 1
            elif (m := _PREFIX.match(text, at)) is not None:
                at = self.string(at, m.end())
            elif c.isdigit() and c.isascii() or c == "." and text[at + 1 : at + 2].isdigit() and text[at + 1].isascii():
                m = _NUMBER.match(text, at)
                end = m.end() if m else at + 1
                rest = _NAME.match(text, end)
                if not m or text[end : end + 1].isdigit() or text[end : end + 1] == "_" or rest and rest[0] not in KEYWORDS and not self.keyword_after(rest[0]):
                    self.note(at, f"no number: {text[at : at + 20]!r}")
                    while end < n and (text[end].isalnum() or text[end] == "_"):
                        end += 1
                self.add("number", text[at:end], at)
                at = end
            elif (m := _NAME.match(text, at)) is not None:
                word = m[0]
                if not word.isascii() and not unicodedata.normalize("NFKC", word).isidentifier():
                    self.note(at, f"no name: {word[:20]!r}")
                self.add("name", word, at)
                at = m.end()
            elif (m := _OP.match(text, at)) is not None:
                v = m[0]
                if v in CLOSING:
                    brackets.append((v, at))
                elif v in ")]}":
                    if brackets and CLOSING[brackets[-1][0]] == v:
                        brackets.pop()
                    else:
                        self.note(at, f"{v!r} does not match")
                        if brackets:
                            brackets.pop()
                self.add("op", v, at)
                at = m.end()
            else:
                self.note(at, f"stray character {c!r}")
                at += 1
        if brackets:
            self.note(brackets[-1][1], f"{brackets[-1][0]!r} was never closed")
        if self.tokens and self.tokens[-1][0] not in ("newline",):
            self.add("newline", "", n)
        for _ in indents[1:]:
            self.add("dedent", "", n)
        self.add("end", "", n)

    def keyword_after(self, word: str) -> bool:
        return any(word.startswith(k) and len(word) > len(k) and False for k in ("and", "or"))

    def line_end(self, at: int) -> int:
        n = len(self.text)
        while at < n and self.text[at] not in "\n\r":
            at += 1
        if self.text[at : at + 2] == "\r\n":
            return at + 2
        return min(n, at + 1)

    def string(self, start: int, at: int) -> int:
        """Read a string whose quote is at ``at``; of formatted strings the fields are parsed as well."""
        text, n = self.text, len(self.text)
        prefix = text[start:at].lower()
        quote = text[at]
        mark = quote * 3 if text.startswith(quote * 3, at) else quote
        at += len(mark)
        formatted = "f" in prefix or "t" in prefix
        while True:
            if at >= n or text[at] in "\n\r" and len(mark) == 1:
                self.note(start, "string without end")
                self.add("string", prefix, start)
                return at
            if text.startswith(mark, at):
                break
            c = text[at]
            if c == "\\":
                at += 3 if text[at + 1 : at + 3] == "\r\n" else 2
                if formatted and "r" in prefix and text[at - 1 : at] == "{":
                    at -= 1
                continue
            if formatted and c == "{":
                if text.startswith("{{", at):
                    at += 2
                else:
                    at = self.field(at, mark, prefix)
                continue
            if formatted and c == "}":
                if text.startswith("}}", at):
                    at += 2
                    continue
                self.note(at, "single '}' in a formatted string")
            if "b" in prefix and not c.isascii():
                self.note(at, "bytes hold ASCII characters only")
            at += 1
        self.add("string", "b" if "b" in prefix else "", start)
        return at + len(mark)

    def field(self, at: int, mark: str, prefix: str) -> int:
        """Read a replacement field whose '{' is at ``at``; where the string goes on behind it."""
        text, n = self.text, len(self.text)
        begin = at + 1
        at, depth = begin, []
        while at < n:
            c = text[at]
            if c in "\n\r" and len(mark) == 1 and False:
                break
            if c in "([{":
                depth.append(c)
            elif c in ")]}" and depth:
                depth.pop()
            elif not depth and c == "!" and text[at + 1 : at + 2] != "=":
                break
            elif not depth and c in "}:":
                break
            elif c == "#":
                at = max(at, self.line_end(at) - 1)
                if at >= n - 1:
                    break
            elif c in "'\"":
                if text.startswith(mark, at):
                    # since 3.12 a quote of the same kind may stand inside a field
                    pass
                m = c * 3 if text.startswith(c * 3, at) else c
                k = at + len(m)
                while k < n and not text.startswith(m, k) and not (len(m) == 1 and text[k] in "\n\r"):
                    k += 2 if text[k] == "\\" else 1
                if k >= n or text[k] in "\n\r" and len(m) == 1:
                    self.note(begin, "string without end")
                    return n if k >= n else k
                at = k + len(m) - 1
            at += 1
        inner = text[begin:at]
        bare = inner.rstrip()
        if bare.endswith("=") and not bare.endswith(("==", "!=", "<=", ">=")):
            bare = bare[:-1]
        if not bare.strip():
            self.note(begin, "empty field of a formatted string")
        else:
            for offset, message in _expression_errors(bare):
                self.note(begin + min(offset, len(inner)), message)
        if at < n and text[at] == "!":
            m = re.compile(r"\s*[rsa]\s*").match(text, at + 1)
            if not m:
                self.note(at, "no conversion of a field")
                return at + 1
            at = m.end()
        if at < n and text[at] == ":":
            at += 1
            while at < n and text[at] != "}":
                if text.startswith(mark, at) or text[at] in "\n\r" and len(mark) == 1:
                    self.note(begin, "field of a formatted string without end")
                    return at
                at = self.field(at, mark, prefix) if text[at] == "{" else at + 1
        if at >= n or text[at] != "}":
            self.note(begin, "field of a formatted string without end")
            return min(at, n)
        return at + 1


def _expression_errors(text: str) -> list[tuple[int, str]]:
    p = _Parser("(" + text + "\n)", depth=1)
    if p.lexed:
        return [(max(0, a - 1), m) for a, m in p.lexed]
    try:
        p.i = 1
        if p.value == "yield":
            p.yield_()
        else:
            p.star_expressions()
        p.need(")")
        if p.kind not in ("newline", "end"):
            p.fail("unexpected token")
    except Fault as f:
        return [(max(0, f.at - 1), f.message)]
    return []


class _Parser:
    def __init__(self, text: str, depth: int = 0):
        self.errors = Errors()
        self.tokens = _Lexer(text, self.errors).tokens
        self.lexed = list(self.errors)
        self.i, self.depth = 0, depth
        self.nested = 0

    @property
    def value(self) -> str:
        kind, value, _ = self.tokens[self.i]
        return value if kind in ("name", "op") else ""

    @property
    def kind(self) -> str:
        return self.tokens[self.i][0]

    def peek(self, k: int = 1) -> tuple[str, str]:
        kind, value, _ = self.tokens[min(self.i + k, len(self.tokens) - 1)]
        return kind, value if kind in ("name", "op") else ""

    @property
    def here(self) -> int:
        return self.tokens[self.i][2]

    def fail(self, message: str, at: int | None = None):
        kind, value, start = self.tokens[self.i]
        raise Fault(start if at is None else at, f"{message}, found {value[:20]!r}" if kind in ("name", "op", "number") else f"{message}, found {kind}")

    def take(self, value: str) -> bool:
        kind, v, _ = self.tokens[self.i]
        if v == value and kind in ("name", "op"):
            self.i += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            self.fail(f"expected {value!r}")

    def is_name(self) -> bool:
        kind, v, _ = self.tokens[self.i]
        return kind == "name" and v not in KEYWORDS

    def name(self) -> None:
        if not self.is_name():
            self.fail("expected a name")
        self.i += 1

    def deeper(self) -> None:
        self.nested += 1

    # -- panic mode
    def recover(self, start: int) -> None:
        """Skip to behind the next line end of this level, with the block that may hang on it."""
        self.i = max(self.i, start)
        if self.i > start and self.tokens[self.i - 1][0] == "newline":
            return
        level = 0
        while self.kind != "end":
            kind = self.kind
            if kind == "dedent" and level == 0:
                return
            self.i += 1
            level += (kind == "indent") - (kind == "dedent")
            if kind == "newline" and level == 0 and self.kind != "indent" or kind == "dedent" and level == 0:
                return

    # -- statements
    def file(self) -> None:
        while self.kind != "end":
            self.statement_or_note()

    def statement_or_note(self) -> None:
        start, nested = self.i, self.nested
        try:
            self.statement()
        except Fault as f:
            self.errors.note(f)
            self.nested = nested
            self.recover(start)
            if self.i == start:
                self.i += 1

    def statement(self) -> None:
        if self.kind == "newline":
            self.i += 1
            return
        if self.kind == "indent":
            self.fail("unexpected indent")
        if self.kind == "dedent":
            self.i += 1
            return
        self.deeper()
        v = self.value
        if v == "if":
            self.i += 1
            self.named()
            self.block()
            while self.take("elif"):
                self.named()
                self.block()
            if self.take("else"):
                self.block()
        elif v == "while":
            self.i += 1
            self.named()
            self.block()
            if self.take("else"):
                self.block()
        elif v == "for":
            self.for_()
        elif v == "try":
            self.try_()
        elif v == "with":
            self.with_()
        elif v in ("def", "class", "@"):
            self.decorated()
        elif v == "async":
            self.i += 1
            if self.value == "def":
                self.function()
            elif self.value == "for":
                self.for_()
            elif self.value == "with":
                self.with_()
            else:
                self.fail("expected 'def', 'for' or 'with'")
        elif v == "match" and self.match_():
            pass
        else:
            self.simple_line()
        self.nested -= 1

    def block(self) -> None:
        self.need(":")
        if self.kind != "newline":
            return self.simple_line()
        self.i += 1
        if self.kind != "indent":
            self.fail("expected an indented block")
        self.i += 1
        while self.kind not in ("dedent", "end"):
            self.statement_or_note()
        if self.kind == "dedent":
            self.i += 1

    def simple_line(self) -> None:
        while True:
            self.simple()
            if not self.take(";") or self.kind == "newline":
                break
        if self.kind != "newline":
            self.fail("expected the line's end")
        self.i += 1

    def simple(self) -> None:
        v = self.value
        if v in ("pass", "break", "continue"):
            self.i += 1
        elif v == "return":
            self.i += 1
            if self.kind != "newline" and self.value != ";":
                self.star_expressions()
        elif v == "raise":
            self.i += 1
            if self.kind != "newline" and self.value != ";":
                self.expression()
                if self.take("from"):
                    self.expression()
        elif v in ("global", "nonlocal"):
            self.i += 1
            self.name()
            while self.take(","):
                self.name()
        elif v == "del":
            self.i += 1
            at = self.here
            kind = self.star_expressions()
            self.check_target(kind, at, delete=True)
        elif v == "assert":
            self.i += 1
            self.expression()
            if self.take(","):
                self.expression()
        elif v == "import":
            self.i += 1
            while True:
                self.dotted()
                if self.take("as"):
                    self.name()
                if not self.take(","):
                    break
        elif v == "from":
            self.from_import()
        elif v == "type" and self.peek()[0] == "name" and self.peek()[1] not in KEYWORDS and self.peek(2)[1] in ("=", "["):
            self.i += 2
            self.type_parameters()
            self.need("=")
            self.expression()
        else:
            self.assignment()

    def dotted(self) -> None:
        self.name()
        while self.take("."):
            self.name()

    def from_import(self) -> None:
        self.need("from")
        dots = False
        while self.value in (".", "..."):
            self.i += 1
            dots = True
        if not dots or self.value != "import":
            self.dotted()
        self.need("import")
        if self.take("*"):
            return
        bracket = self.take("(")
        while True:
            self.name()
            if self.take("as"):
                self.name()
            if not self.take(","):
                break
            if bracket and self.value == ")":
                break
            if not bracket and self.kind == "newline":
                self.fail("trailing comma")
        if bracket:
            self.need(")")

    def check_target(self, kind, at: int, delete: bool = False, single: bool = False) -> None:
        what = kind[0]
        if what in (NAME, ATTRIBUTE):
            return
        if what == SEQUENCE and not single:
            for k in kind[1]:
                self.check_target(k, at, delete)
            return
        if what == STAR and not delete and not single:
            return self.check_target(kind[1], at)
        self.fail("cannot be assigned to", at)

    def assignment(self) -> None:
        at = self.here
        kind = self.yield_() if self.value == "yield" else self.star_expressions()
        if self.value == ":" and self.kind == "op":
            if kind[0] not in (NAME, ATTRIBUTE):
                self.fail("cannot be annotated", at)
            self.i += 1
            self.expression()
            if self.take("="):
                self.yield_() if self.value == "yield" else self.star_expressions()
        elif self.value in AUGMENTED:
            if kind[0] not in (NAME, ATTRIBUTE):
                self.fail("cannot be assigned to", at)
            self.i += 1
            self.yield_() if self.value == "yield" else self.star_expressions()
        else:
            while self.take("="):
                self.check_target(kind, at)
                at = self.here
                kind = self.yield_() if self.value == "yield" else self.star_expressions()

    def for_(self) -> None:
        self.need("for")
        self.targets()
        self.need("in")
        self.star_expressions()
        self.block()
        if self.take("else"):
            self.block()

    def targets(self) -> None:
        at = self.here
        kinds = [self.star_target()]
        more = False
        while self.take(","):
            more = True
            if self.value == "in":
                break
            kinds.append(self.star_target())
        kind = (SEQUENCE, kinds) if more else kinds[0]
        if kind[0] == STAR:
            self.fail("cannot be a target", at)
        self.check_target(kind, at)

    def star_target(self):
        if self.take("*"):
            return (STAR, self.binary(1))
        return self.binary(1)

    def try_(self) -> None:
        self.need("try")
        self.block()
        found, star = False, None
        while self.take("except"):
            found = True
            starred = self.take("*")
            if star is not None and starred != star:
                self.fail("'except' and 'except*' do not mix")
            star = starred
            if self.value != ":":
                self.expression()
                if self.take("as"):
                    self.name()
                elif self.value == ",":
                    while self.take(","):  # since 3.14 several may stand without brackets
                        self.fail("several exceptions need brackets")
            elif starred:
                self.fail("expected an exception")
            self.block()
        if found and self.take("else"):
            self.block()
        if self.take("finally"):
            found = True
            self.block()
        if not found:
            self.fail("expected 'except' or 'finally'")

    def with_(self) -> None:
        self.need("with")
        if self.value == "(":
            start, nested = self.i, self.nested
            try:
                self.i += 1
                while self.value != ")":
                    self.with_item()
                    if not self.take(","):
                        break
                self.need(")")
                if self.value != ":":
                    self.fail("expected ':'")
                return self.block()
            except Fault:
                if self.i > start and self.value == "" and False:
                    raise
                if self.tokens[self.i - 1][0] == "newline" or self.value == ":" and self.tokens[self.i - 1][1] == ")":
                    raise
                self.i, self.nested = start, nested
        while True:
            self.with_item()
            if not self.take(","):
                break
        self.block()

    def with_item(self) -> None:
        self.expression()
        if self.take("as"):
            at = self.here
            self.check_target(self.star_target(), at)

    def decorated(self) -> None:
        decorated = False
        while self.take("@"):
            decorated = True
            self.named()
            if self.kind != "newline":
                self.fail("expected the line's end")
            self.i += 1
        if decorated and self.take("async"):
            if self.value != "def":
                self.fail("expected 'def'")
        if self.value == "def":
            self.function()
        elif self.take("class"):
            self.name()
            self.type_parameters()
            if self.take("("):
                self.arguments()
            self.block()
        else:
            self.fail("expected 'def' or 'class'")

    def type_parameters(self) -> None:
        if not self.take("["):
            return
        while True:
            if not self.take("*"):
                self.take("**")
            self.name()
            if self.take(":"):
                self.expression()
            if self.take("="):
                self.star_expressions()
            if not self.take(",") or self.value == "]":
                break
        self.need("]")

    def function(self) -> None:
        self.need("def")
        self.name()
        self.type_parameters()
        self.need("(")
        self.parameters(")", True)
        self.need(")")
        if self.take("->"):
            self.expression()
        self.block()

    def parameters(self, end: str, annotated: bool) -> None:
        defaults = star = slash = bare = False
        count = 0
        while self.value != end:
            if self.take("**"):
                if bare:
                    self.fail("expected a named parameter")
                self.name()
                if annotated and self.take(":"):
                    self.expression()
                self.take(",")
                if self.value != end:
                    self.fail("nothing may follow '**'")
                return
            if self.take("*"):
                if star:
                    self.fail("a second '*'")
                star = True
                if self.value == ",":
                    bare = True
                else:
                    self.name()
                    if annotated and self.take(":"):
                        self.star_named() if self.value == "*" else self.expression()
            elif self.take("/"):
                if slash or star or not count:
                    self.fail("misplaced '/'")
                slash = True
            else:
                bare = False
                self.name()
                count += 1
                if annotated and self.take(":"):
                    self.expression()
                if self.take("="):
                    self.expression()
                    defaults = True
                elif defaults and not star:
                    self.fail("expected a default")
            if not self.take(","):
                break
        if bare:
            self.fail("expected a named parameter")

    # -- match
    def match_(self) -> bool:
        """A match statement, if this is one and not the name ``match``."""
        start, nested = self.i, self.nested
        try:
            self.i += 1
            self.star_expressions()
            if not self.take(":") or self.kind != "newline" or self.peek()[0] != "indent" or self.peek(2)[1] != "case":
                raise Fault(0, "")
        except Fault:
            self.i, self.nested = start, nested
            return False
        self.i += 2
        while self.take("case"):
            self.pattern_list()
            if self.take("if"):
                self.named()
            self.block()
        if self.kind != "dedent":
            self.fail("expected 'case'")
        self.i += 1
        return True

    def pattern_list(self) -> None:
        self.pattern()
        while self.take(","):
            if self.value in (":", "if"):
                break
            self.pattern()

    def pattern(self) -> None:
        if self.take("*"):
            return self.name()
        self.closed_pattern()
        while self.take("|"):
            self.closed_pattern()
        if self.take("as"):
            self.name()

    def closed_pattern(self) -> None:
        self.deeper()
        v = self.value
        if v in ("(", "["):
            self.i += 1
            while self.value != CLOSING[v]:
                self.pattern()
                if not self.take(","):
                    break
            self.need(CLOSING[v])
        elif v == "{":
            self.i += 1
            while self.value != "}":
                if self.take("**"):
                    self.name()
                else:
                    self.closed_pattern()
                    self.need(":")
                    self.pattern()
                if not self.take(","):
                    break
            self.need("}")
        elif self.kind == "string":
            while self.kind == "string":
                self.i += 1
        elif v == "-" or self.kind == "number":
            self.take("-")
            if self.kind != "number":
                self.fail("expected a number")
            self.i += 1
            if self.value in ("+", "-"):
                self.i += 1
                if self.kind != "number":
                    self.fail("expected a number")
                self.i += 1
        elif v in ("None", "True", "False"):
            self.i += 1
        else:
            self.dotted()
            if self.take("("):
                while self.value != ")":
                    if self.is_name() and self.peek()[1] == "=":
                        self.i += 2
                    self.pattern()
                    if not self.take(","):
                        break
                self.need(")")
        self.nested -= 1

    # -- expressions; each returns what it is as a target
    def star_expressions(self):
        first = self.star_named()
        if self.value != ",":
            return first
        kinds = [first]
        while self.take(","):
            if not self.starts_expression():
                break
            kinds.append(self.star_named())
        return (SEQUENCE, kinds)

    def starts_expression(self) -> bool:
        kind, v, _ = self.tokens[self.i]
        if kind in ("number", "string"):
            return True
        if kind == "name":
            return v not in KEYWORDS or v in ("None", "True", "False", "not", "lambda", "await", "yield")
        return kind == "op" and v in ("(", "[", "{", "-", "+", "~", "*", "...", "**")

    def star_named(self):
        if self.take("*"):
            return (STAR, self.binary(1))
        return self.named()

    def named(self):
        if self.is_name() and self.peek()[1] == ":=" :
            self.i += 2
            self.expression()
            return (OTHER,)
        kind = self.expression()
        if self.value == ":=":
            self.fail("only a name can be assigned here")
        return kind

    def yield_(self):
        self.need("yield")
        if self.take("from"):
            self.expression()
        elif self.starts_expression():
            self.star_expressions()
        return (OTHER,)

    def expression(self):
        self.deeper()
        if self.value == "lambda":
            self.i += 1
            self.parameters(":", False)
            self.need(":")
            self.expression()
            kind = (OTHER,)
        else:
            kind = self.disjunction()
            if self.value == "if":
                self.i += 1
                self.disjunction()
                self.need("else")
                self.expression()
                kind = (OTHER,)
        self.nested -= 1
        return kind

    def disjunction(self):
        kind = self.conjunction()
        while self.take("or"):
            self.conjunction()
            kind = (OTHER,)
        return kind

    def conjunction(self):
        kind = self.inversion()
        while self.take("and"):
            self.inversion()
            kind = (OTHER,)
        return kind

    def inversion(self):
        if self.take("not"):
            self.deeper()
            self.inversion()
            self.nested -= 1
            return (OTHER,)
        kind = self.binary(1)
        while self.value in COMPARE:
            if self.take("not"):
                self.need("in")
            elif self.take("is"):
                self.take("not")
            else:
                self.i += 1
            self.binary(1)
            kind = (OTHER,)
        return kind

    def binary(self, least: int):
        kind = self.unary()
        while self.kind == "op":
            level = BINARY.get(self.value, 0)
            if not level or level < least:
                break
            self.i += 1
            self.binary(level + 1)
            kind = (OTHER,)
        return kind

    def unary(self):
        if self.kind == "op" and self.value in ("+", "-", "~"):
            self.deeper()
            self.i += 1
            self.unary()
            self.nested -= 1
            return (OTHER,)
        awaited = self.take("await")
        kind = self.primary()
        if self.take("**"):
            self.unary()
            return (OTHER,)
        return (OTHER,) if awaited else kind

    def primary(self):
        self.deeper()
        kind = self.atom()
        while True:
            if self.take("."):
                self.name()
                kind = (ATTRIBUTE,)
            elif self.take("("):
                self.arguments()
                kind = (OTHER,)
            elif self.take("["):
                self.slices()
                kind = (ATTRIBUTE,)
            else:
                self.nested -= 1
                return kind

    def slices(self) -> None:
        if self.value == "]":
            self.fail("expected an index")
        while True:
            if self.value == "*":
                self.star_named()
            else:
                if self.value != ":":
                    self.named()
                if self.take(":"):
                    if self.value not in (":", "]", ","):
                        self.expression()
                    if self.take(":") and self.value not in ("]", ","):
                        self.expression()
            if not self.take(",") or self.value == "]":
                break
        self.need("]")

    def arguments(self) -> None:
        """Behind the '(' of a call."""
        keyword = unpacked = False
        count = 0
        while self.value != ")":
            at = self.here
            count += 1
            if self.take("**"):
                self.expression()
                unpacked = True
            elif self.take("*"):
                self.expression()
                if unpacked:
                    self.fail("positional behind '**'", at)
            elif self.is_name() and self.peek()[1] == "=":
                self.i += 2
                self.expression()
                keyword = True
            else:
                self.named()
                if self.value in ("for", "async"):
                    self.comprehension()
                    if count > 1 or self.value == "," and self.peek()[1] != ")":
                        self.fail("a generator needs brackets", at)
                elif self.value == "=":
                    self.fail("expected a keyword's name", at)
                elif keyword or unpacked:
                    self.fail("positional behind keyword", at)
            if not self.take(","):
                break
        self.need(")")

    def comprehension(self) -> None:
        while self.value in ("for", "async"):
            self.take("async")
            self.need("for")
            self.targets()
            self.need("in")
            self.disjunction()
            while self.take("if"):
                if self.is_name() and self.peek()[1] == ":=":
                    self.named()
                else:
                    self.disjunction()

    def atom(self):
        kind, v, at = self.tokens[self.i]
        if kind == "name":
            if v in ("None", "True", "False"):
                self.i += 1
                return (OTHER,)
            if v in KEYWORDS:
                self.fail("expected an expression")
            self.i += 1
            return (NAME,)
        if kind == "number":
            self.i += 1
            return (OTHER,)
        if kind == "string":
            while self.kind == "string":
                if self.tokens[self.i][1] != v and "b" in (self.tokens[self.i][1], v):
                    self.fail("bytes and text do not mix")
                self.i += 1
            return (OTHER,)
        if v == "...":
            self.i += 1
            return (OTHER,)
        if v == "(":
            self.i += 1
            if self.take(")"):
                return (SEQUENCE, [])
            if self.value == "yield":
                self.yield_()
                self.need(")")
                return (OTHER,)
            first = self.star_named()
            if self.value in ("for", "async"):
                self.comprehension()
                self.need(")")
                return (OTHER,)
            if self.value != ",":
                if first[0] == STAR:
                    self.fail("starred expression in brackets", at)
                self.need(")")
                return first
            kinds = [first]
            while self.take(","):
                if self.value == ")":
                    break
                kinds.append(self.star_named())
            self.need(")")
            return (SEQUENCE, kinds)
        if v == "[":
            self.i += 1
            kinds = []
            while self.value != "]":
                kinds.append(self.star_named())
                if len(kinds) == 1 and self.value in ("for", "async"):
                    self.comprehension()
                    self.need("]")
                    return (OTHER,)
                if not self.take(","):
                    break
            self.need("]")
            return (SEQUENCE, kinds)
        if v == "{":
            return self.braces()
        self.fail("expected an expression")

    def braces(self):
        self.need("{")
        mapping = None
        count = 0
        while self.value != "}":
            count += 1
            if self.take("**"):
                self.binary(1)
                pair = True
            elif self.value == "*":
                self.star_named()
                pair = False
            else:
                self.named()
                pair = self.take(":")
                if pair:
                    self.expression()
            if mapping is not None and mapping != pair:
                self.fail("a set or a mapping")
            mapping = pair
            if count == 1 and self.value in ("for", "async"):
                self.comprehension()
                break
            if not self.take(","):
                break
        self.need("}")
        return (OTHER,)


def parse_python(text: str) -> list[tuple[int, str]]:
    """All errors of a Python 3 text (offset, message), by place."""
    if "\x00" in text:
        return [(text.index("\x00"), "null character")]
    p = _Parser(text)
    p.file()
    return sorted(p.errors)
