"""Access paths as columns: normal form, inverse, and how a used path meets a defined one.

A path is text, one step after another, each behind a slash: a field's name, ``*`` (what it points
to), ``&`` (its address), ``<n>`` (moved by n), ``?`` (any field), ``<?>`` (moved by anything). The
normal form is what a set of rewriting rules leaves when none fits any more: an address and a look
through it cancel, moves add up, a move by nothing goes, a move by anything takes in its neighbours.

Two normal paths are compared as two rows of a matrix, all rows of a batch at once. The part of a
path up to its last step that cannot be taken back (a field or a look through a pointer) is its
core. The cores must agree as far as the shorter one goes; which of them is longer names the result,
and what is left is the way back over the rest of the shorter path and on over the rest of the other.

Defined cases: the empty path is the thing itself; null paths give a null result; a rest that cannot
be walked back cannot occur, since it lies behind the core; repeated rows give equal rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Results of a match, and what they are called when a step that may be anything took part.
NO_MATCH, EXACT, PREFIX, EXTENDED = "NO_MATCH", "EXACT_MATCH", "PREFIX_MATCH", "EXTENDED_MATCH"
UNSURE = {EXACT: "VARIABLE_EXACT_MATCH", PREFIX: "VARIABLE_PREFIX_MATCH", EXTENDED: "VARIABLE_EXTENDED_MATCH"}

_END = r"(?=/|\Z)"
_RULES = (
    (re.compile(rf"/&/\*{_END}|/\*/&{_END}|/<-?0+>{_END}"), ""),
    (re.compile(rf"/<(-?\d+)>/<(-?\d+)>{_END}"), lambda m: f"/<{int(m[1]) + int(m[2])}>"),
    (re.compile(rf"/<\?>/<(?:\?|-?\d+)>{_END}|/<-?\d+>/<\?>{_END}"), "/<?>"),
)


def text_of(steps: Sequence[str]) -> str:
    return "".join(f"/{s}" for s in steps)


def steps_of(path: str) -> list[str]:
    return path.split("/")[1:]


def normal(path: str) -> str:
    """The path when no rewriting rule fits any more; the rules shorten it, so that comes."""
    before = None
    while before != path:
        before = path
        for pattern, to in _RULES:
            path = pattern.sub(to, path)
    return path


def inverse(path: str) -> str:
    """The way back over a path of addresses, looks and moves."""
    turned = {"&": "*", "*": "&", "<?>": "<?>"}
    return text_of([turned[s] if s in turned else f"<{-int(s[1:-1])}>" for s in reversed(steps_of(path))])


# Codes of steps; fields get codes from FIELD on, moves carry their amount beside the code.
_PAD, _LOOK, _ADDRESS, _ANY_MOVE, _MOVE, _ANY, _FIELD = range(7)
_CODES = {"*": _LOOK, "&": _ADDRESS, "<?>": _ANY_MOVE, "?": _ANY}


def _matrix(paths: list[list[str]], names: dict[str, int], width: int) -> tuple[np.ndarray, np.ndarray]:
    codes, amounts = np.zeros((len(paths), width), np.int64), np.zeros((len(paths), width), np.int64)
    for i, steps in enumerate(paths):
        for k, s in enumerate(steps):
            if s in _CODES:
                codes[i, k] = _CODES[s]
            elif s.startswith("<"):
                codes[i, k], amounts[i, k] = _MOVE, int(s[1:-1])
            else:
                codes[i, k] = names.setdefault(s, _FIELD + len(names))
    return codes, amounts


def _core(codes: np.ndarray) -> np.ndarray:
    """Steps up to the last one that cannot be taken back."""
    firm = ~np.isin(codes, (_PAD, _ADDRESS, _MOVE, _ANY_MOVE))
    return np.where(firm.any(1), codes.shape[1] - firm[:, ::-1].argmax(1), 0)


def match_columns(uses: list[str], definitions: list[str], exclusions: list[list[str] | None] | None = None) -> tuple[list[str], list[str]]:
    """Result and rest for every pair of normal paths; an extension that starts with an excluded path is no match."""
    u, d = [steps_of(p) for p in uses], [steps_of(p) for p in definitions]
    width = max([1, *map(len, u), *map(len, d)])
    names: dict[str, int] = {}
    (uc, ua), (dc, da) = _matrix(u, names, width), _matrix(d, names, width)
    at = np.arange(width)
    core_u, core_d = _core(uc), _core(dc)
    short = np.minimum(core_u, core_d)[:, None]
    field = lambda c: (c == _ANY) | (c >= _FIELD)
    moves = lambda c: (c == _MOVE) | (c == _ANY_MOVE)
    either = lambda code: (uc == code) | (dc == code)
    inside = (uc != _PAD) & (dc != _PAD)
    loose = inside & ((moves(uc) & moves(dc) & either(_ANY_MOVE)) | (field(uc) & field(dc) & either(_ANY) & (at < short)))
    same = loose | (inside & (uc == dc) & (ua == da))
    reach = np.where(same.all(1), width, same.argmin(1))  # steps that agree from the front
    reach = np.minimum(reach, np.minimum((uc != _PAD).sum(1), (dc != _PAD).sum(1)))
    agrees = reach >= short[:, 0]
    unsure = (loose & (at < reach[:, None])).any(1)
    vague = lambda c, since: (((c == _ANY) | (c == _ANY_MOVE)) & (at >= since[:, None])).any(1)
    unsure |= vague(dc, core_d) | ((core_u < core_d) & vague(uc, core_u))
    results, rests = [], []
    for i in range(len(u)):
        if not agrees[i]:
            results.append(NO_MATCH)
            rests.append("")
            continue
        n = int(reach[i])
        extends = core_u[i] < core_d[i]
        back, on = (u[i], d[i]) if extends else (d[i], u[i])
        rest = normal(inverse(text_of(back[n:])) + text_of(on[n:]))
        result = EXTENDED if extends else EXACT if core_u[i] == core_d[i] else PREFIX
        if extends and not unsure[i] and any(f"{rest}/".startswith(f"{x}/") for x in (exclusions[i] if exclusions and exclusions[i] else [])):
            result, rest = NO_MATCH, ""
        elif unsure[i]:
            result = UNSURE[result]
        results.append(result)
        rests.append(rest)
    return results, rests


def match_paths(pairs: DataFrame, use: str = "use_path", definition: str = "def_path") -> DataFrame:
    """``pairs`` with ``result`` and ``rest``; the paths need not be in normal form."""
    at_use, at_def = pairs.columns.index(use), pairs.columns.index(definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            us, ds = b.column(at_use).to_pylist(), b.column(at_def).to_pylist()
            known = [i for i, (x, y) in enumerate(zip(us, ds)) if x is not None and y is not None]
            got, left = match_columns([normal(us[i]) for i in known], [normal(ds[i]) for i in known])
            result, rest = [None] * len(us), [None] * len(us)
            for i, r, s in zip(known, got, left):
                result[i], rest[i] = r, s
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(result, pa.string()), pa.array(rest, pa.string())], names=[*b.schema.names, "result", "rest"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)
    return pairs.mapInArrow(run, f"{kinds}, result string, rest string")


# -- paths in source text -------------------------------------------------------------------------
_MEMBER = r"(?<![\w.>\])])[A-Za-z_]\w*(?:(?:->|\.)[A-Za-z_]\w*|\[\w+\])+\s*(?:[-+*/|&^%]?=(?!=))?"
_HOP = re.compile(r"->(\w+)|\.(\w+)|\[(\w+)\]")


def path_of(expression: str) -> tuple[str, str]:
    """Base and normal path of a member expression: ``p->f`` looks through p and takes f, ``a[2]`` moves and looks."""
    base = re.match(r"\w+", expression)[0]
    steps: list[str] = []
    for arrow, dot, index in _HOP.findall(expression):
        if arrow:
            steps += ["*", arrow]
        elif dot:
            steps.append(dot)
        else:
            steps += [f"<{int(index)}>" if index.isdigit() else "<?>", "*"]
    return base, normal(text_of(steps))


def member_paths(files: DataFrame) -> DataFrame:
    """(file_id, line, place, base, path, is_write): member expressions in the kept texts, in order of their place in the text."""
    once = files.filter("text is not null").select("file_id", "text").dropDuplicates(["file_id"])
    lines = once.select("file_id", F.posexplode(F.split("text", "\n")).alias("at", "content")).filter(F.col("content").rlike(r"\w(?:->|\.|\[)\w"))
    found = lines.select("file_id", (F.col("at") + 1).cast("long").alias("line"), F.posexplode(F.regexp_extract_all("content", F.lit(_MEMBER), F.lit(0))).alias("nth", "expression"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [path_of(x) for x in b.column(3).to_pylist()]
            writes = [x.rstrip().endswith("=") for x in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([x for x, _ in both], pa.string()), pa.array([x for _, x in both], pa.string()), pa.array(writes, pa.bool_())], names=["file_id", "line", "nth", "base", "path", "is_write"])

    made = found.select("file_id", "line", F.col("nth").cast("long").alias("nth"), "expression").mapInArrow(run, "file_id string, line long, nth long, base string, path string, is_write boolean")
    return made.select("file_id", "line", F.col("nth").alias("place"), "base", "path", "is_write")


def path_uses(members: DataFrame) -> DataFrame:
    """(file_id, base, path, n_writes, n_reads): how often each field of each base is written and read."""
    return members.groupBy("file_id", "base", "path").agg(F.count_if("is_write").alias("n_writes"), F.count_if(~F.col("is_write")).alias("n_reads"))


def reads_of_writes(members: DataFrame) -> DataFrame:
    """(file_id, line, place, base, use_path, def_path, result, rest): each read and the last write before it to anything of its base, and how they meet."""
    from pyspark.sql import Window

    w = Window.partitionBy("file_id", "base").orderBy("line", "place").rowsBetween(Window.unboundedPreceding, -1)
    last = members.withColumn("def_path", F.last(F.when(F.col("is_write"), F.col("path")), ignorenulls=True).over(w))
    return match_paths(last.filter("not is_write and def_path is not null").select("file_id", "line", "place", "base", F.col("path").alias("use_path"), "def_path"))
