"""Parsers by recursive descent with precedence climbing and panic-mode recovery.

Each ``parse_*`` function takes a whole text and returns all errors as (offset, message), in the
order found. A parser that finds an error skips to a place where a statement can begin or end and
goes on, so one fault does not hide the next.
"""

from __future__ import annotations

from weftgraph.llm.parsing.base import allow_nesting
from weftgraph.llm.parsing.c import parse_c
from weftgraph.llm.parsing.python import parse_python
from weftgraph.llm.parsing.script import parse_script

#: Language of a path's extension (fixed values).
LANGUAGE_OF = {".c": "c", ".h": "c", ".py": "python", ".pyi": "python", ".ts": "typescript", ".tsx": "tsx", ".js": "javascript"}


def language_of(path: str | None) -> str | None:
    name = (path or "").rsplit("/", 1)[-1]
    return LANGUAGE_OF.get(name[name.rfind(".") :].lower()) if "." in name else None


def parse(text: str, language: str) -> list[tuple[int, str]]:
    """All errors of ``text`` read as ``language``; none for an empty text."""
    allow_nesting(text)
    if language == "c":
        return parse_c(text)
    if language == "python":
        return parse_python(text)
    return parse_script(text, types=language != "javascript", jsx=language == "tsx")
