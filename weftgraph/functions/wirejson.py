"""Decoding of record properties stored as JSON in three codings.

1 is a plain object. 2 is a list of fields ``{"key": k, "value": V}`` with V one of text, integer,
real, boolean, list, object, null_value. 3 is as 2, but lists and objects are wrapped in
``{"values": [..]}`` and ``{"fields": [..]}`` and integers are strings. Of a field given twice the
last one counts. In 1 a number with a point is a real, one without is an integer.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any


class Real(float):
    """A real, kept apart from integers."""


class Malformed(ValueError):
    """Not well-formed: cut off, no JSON, or not of the coding's form."""


def _number(text: str) -> Any:
    return Real(text) if "." in text else int(float(text))


def _no_constant(text: str) -> Any:
    raise Malformed(text)


_decoder = json.JSONDecoder(parse_float=_number, parse_constant=_no_constant)


def _value(v: Any) -> Any:
    if type(v) is not dict or len(v) != 1:
        raise Malformed("a value has one kind")
    for kind, x in v.items():
        read = _READ.get(kind)
        if read is None:
            raise Malformed(kind)
        return read(x)


def _only(*types: type):
    def check(x: Any) -> Any:
        if type(x) not in types:
            raise Malformed("a value is of its kind")
        return x

    return check


def _items(x: Any) -> list[Any]:
    items = x.get("values", []) if type(x) is dict else x
    if type(items) is not list:
        raise Malformed("a list has values")
    return [_value(i) for i in items]


_integer, _real = _only(int, str), _only(int, float, Real, str)
_READ = {
    "text": _only(str),
    "integer": lambda x: int(_integer(x)),
    "real": lambda x: Real(_real(x)),
    "boolean": _only(bool),
    "null_value": lambda x: None,
    "list": _items,
    "object": lambda x: _fields(x.get("fields", []) if type(x) is dict else x),
}


def _fields(fields: Any) -> dict[str, Any]:
    if not isinstance(fields, list):
        raise Malformed("fields are a list")
    out: dict[str, Any] = {}
    for f in fields:
        if not isinstance(f, dict) or not isinstance(f.get("key"), str):
            raise Malformed("a field has a key")
        out[f["key"]] = _value(f.get("value"))
    return out


def decode(text: str | None, version: int | None) -> dict[str, Any] | None:
    """The properties as plain values, or None if they are null or not well-formed.

    Without a known version an object is read as coding 1 and a list as 2 or 3.
    """
    if text is None:
        return None
    try:
        raw = _decoder.decode(text)
        if isinstance(raw, dict) and version not in (2, 3):
            return raw
        return _fields(raw) if isinstance(raw, list) and version != 1 else None
    except (ValueError, AttributeError, RecursionError):
        return None


_NAMES = {str: "text", int: "integer", Real: "real", float: "real", bool: "boolean", list: "list", dict: "object", type(None): None}


def type_name(v: Any) -> str | None:
    """text, integer, real, boolean, list, object; None for null."""
    return _NAMES[type(v)]


def canonical(v: Any) -> Any:
    """A form whose JSON text is equal exactly for values of equal type and content."""
    if isinstance(v, dict):
        return {"o": {k: canonical(x) for k, x in v.items()}}
    if isinstance(v, list):
        return {"l": [canonical(x) for x in v]}
    return {type_name(v) or "n": repr(float(v)) if isinstance(v, float) else v}


def scalar_text(v: Any) -> str:
    return v if isinstance(v, str) else json.dumps(v)


def walk(v: Any, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], str, str | None]]:
    """(path, type, text) of every element that is not null, containers included, from the outside in.

    List items are the segments ``[0]``, ``[1]``, ...; a loop of its own, for depth without limit.
    """
    stack = [(path, v)]
    while stack:
        at, x = stack.pop()
        if x is None:
            continue
        kind = type_name(x)
        if kind == "object":
            yield at, kind, None
            stack += [((*at, k), y) for k, y in reversed(x.items())]
        elif kind == "list":
            yield at, kind, None
            stack += [((*at, f"[{i}]"), y) for i, y in reversed(list(enumerate(x)))]
        else:
            yield at, kind, scalar_text(x)
