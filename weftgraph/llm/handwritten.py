"""Files that are generated, minified, third-party copies or data saved as code.

Third-party copies: Merkle hashes are computed bottom-up over the directory trees of all units; a
subtree that unrelated units share is a copy. A copy in which some files were edited has another
hash, so the same pass adds up how many bytes of each subtree lie in entries that other units hold
too: from ``COPY_SHARE`` on it is a copy as well, its edited files included. So is what stands in a
directory laid out for copies, or says in its comments that it comes from a foreign project.
Generated files: the comments at the top or bottom, or the form of the name, say so. Minified files and data:
the layout of the text, or sizes where the text is not kept.

Defined cases: a null text is judged by path, lines and bytes; null lines or bytes are taken from
the text if there is one, else that rule does not apply; empty files are never a shared subtree;
repeated rows of a file count once; rows without a file_id are one file; a null path has no name
and no directory; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.notices import speaks_of_foreign_project, speaks_of_generator
from weftgraph.plans.durable import durable
from weftgraph.plans.spread import spread

#: Directories laid out for third-party copies, and those that are if a package with a version is inside (fixed values).
COPY_DIRECTORIES = ("vendor", "vendors", "third_party", "third-party", "thirdparty", "node_modules", "bower_components")
VERSIONED_DIRECTORIES = ("external", "externals", "extern", "deps", "contrib", "lib", "libs")
COPY_LAYOUT = re.compile(rf"(?:^|/)(?:{'|'.join(COPY_DIRECTORIES)})/|(?:^|/)(?:{'|'.join(VERSIONED_DIRECTORIES)})/[^/]*[-_@]v?\d+(?:\.\d+)+[^/]*/")
#: Names that generators and minifiers give their files.
GENERATED_NAME = re.compile(r"(?:_pb2(?:_grpc)?\.pyi?|_pb\.(?:js|ts|d\.ts)|\.pb\.[ch]|\.pb-c\.[ch]|[._](?:generated|gen|g|designer)\.[a-z]+|_parsetab\.py|(?:^|_)parsetab\.py|\.tab\.[ch]|\.yy\.[ch])$|^(?:moc|qrc)_[^/]*\.[a-z]+$")
MINIFIED_NAME = re.compile(r"[.-]min\.[a-z]+$")
#: What the comments at the top or bottom say of a generated file.
GENERATED_HEADER = re.compile(
    r"@generated\b|<auto-?generated\b|\bauto-?generated (?:file|by|from|code|on|with|using)\b|\bgenerated (?:code|file|automatically|source)\b.{0,80}\b(?:do not|don't|never|not) (?:edit|modify|change|patch|touch)"
    r"|\b(?:code|file|source|module) (?:was |is |has been )?(?:auto-?matically |auto-?)?generated (?:by|from|with|using)\b|\bgenerated by\b.{0,120}\b(?:do not|don't|never) (?:edit|modify|change|patch)"
    r"|\b(?:machine|tool|computer)-(?:made|generated|written) (?:by|from|with)\b|\b(?:output|product|result) of the \S+ (?:compiler|generator|tool|translator)\b|\bregenerate, never\b|\bthis file (?:was|is|has been) (?:automatically |auto-?)(?:generated|created|made|produced)\b",
    re.I | re.S,
)
#: Characters a line holds on average in a minified text, and bytes where the text is not kept.
MINIFIED_AVERAGE, MINIFIED_BYTES = 180, 300
#: Share of a text's characters on lines of nothing but literals from which it is data, and the least such characters.
DATA_SHARE, DATA_CHARS = 0.7, 150
#: Lines, and bytes a line, from which a file whose text is not kept is data.
DATA_LINES, DATA_BYTES = 5_000, 50
#: Bytes of a subtree from which its copies are told.
SUBTREE_BYTES = 128
#: Share of a subtree's bytes in entries of other units from which it is an edited copy, and the fewest such files.
COPY_SHARE, COPY_FILES = 0.8, 3
#: Shared entries up to which they are broadcast.
BROADCAST_ROWS = 50_000

_LITERALS = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[-+]?(?:0[xX][0-9a-fA-F]+|\d[\d_]*(?:\.\d*)?(?:[eE][-+]?\d+)?)[uUlLfFn]*|\b(?:true|false|null|None|True|False)\b")
_ONLY_SIGNS = re.compile(r"[\s,;:\[\](){}]*\Z")
_COMMENT_LINE = re.compile(r"\s*(?://|#(?!\s*(?:include|define|pragma|if|ifdef|ifndef|endif|import|undef)\b)|/\*|\*|<!--)|\s*\Z")


def header_comment(text: str) -> str:
    """The comments at the top of a text, before its first line of code."""
    lines, inside = [], False
    at = 0
    while at <= len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line = text[at:end]
        if inside:
            lines.append(line)
            inside = "*/" not in line
        elif _COMMENT_LINE.match(line):
            lines.append(line)
            opened = line.rfind("/*")
            inside = opened >= 0 and "*/" not in line[opened:]
        else:
            break
        at = end + 1
    return "\n".join(lines)


def closing_comment(text: str) -> str:
    """The comments at the bottom of a text, behind its last line of code."""
    lines = []
    end = len(text)
    while end >= 0:
        at = text.rfind("\n", 0, end) + 1 if end else 0
        line = text[at:end]
        if not _COMMENT_LINE.match(line) and not line.rstrip().endswith("*/"):
            break
        lines.append(line)
        end = at - 1
    return "\n".join(reversed(lines))


def is_minified(text: str) -> bool:
    lines = text.split("\n")
    full = [x for x in lines if x.strip()]
    if not full or sum(map(len, full)) < MINIFIED_AVERAGE * len(full):
        return False
    code = "".join(full)
    return sum(c.isspace() for c in code) < 0.12 * len(code) and not is_data(text)


def is_data(text: str) -> bool:
    data = total = 0
    for line in text.split("\n"):
        n = len(line.strip())
        if not n or _COMMENT_LINE.match(line):
            continue
        total += n
        rest = _LITERALS.sub("", line)
        if len(rest) < len(line) and _ONLY_SIGNS.match(rest):
            data += n
    return data >= DATA_CHARS and data >= DATA_SHARE * total


def judge(path: str | None, lines: float | None, size: float | None, text: str | None) -> list[str]:
    """The reasons why a file is not hand-written, by its own path, sizes and text."""
    reasons = []
    path = path or ""
    name = path.rsplit("/", 1)[-1]
    if COPY_LAYOUT.search(path):
        reasons.append("copy-layout")
    if GENERATED_NAME.search(name):
        reasons.append("generated-name")
    if MINIFIED_NAME.search(name):
        reasons.append("minified-name")
    if text is not None:
        comments = [c for c in (header_comment(text), closing_comment(text)) if c.strip()]
        if any(GENERATED_HEADER.search(c) or speaks_of_generator(c) for c in comments):
            reasons.append("generated-header")
        if any(map(speaks_of_foreign_project, comments)):
            reasons.append("copy-notice")
        if is_minified(text):
            reasons.append("minified-layout")
        if is_data(text):
            reasons.append("data-layout")
    elif lines is not None and size is not None and lines > 0:
        if size >= MINIFIED_BYTES * lines:
            reasons.append("minified-layout")
        elif lines >= DATA_LINES and size >= DATA_BYTES * lines:
            reasons.append("data-layout")
    return reasons


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        known = lambda v: None if pd.isna(v) else float(v)
        rows = [(i, r) for i, p, n, s, t in zip(b["file_id"], b["path"], b["lines"], b["bytes"], b["text"]) for r in judge(p, known(n), known(s), t)]
        yield pd.DataFrame(rows, columns=["file_id", "reason"])


def subtree_hashes(files: DataFrame) -> DataFrame:
    """(unit, directory, depth, hash, n_bytes, n_covered, covered_bytes) of every directory below a unit's root.

    Bottom-up: a directory's hash is made of the names and hashes of its entries. They are added
    up as two 64-bit hashes, so a directory of any number of entries is aggregated in parts. Covered
    are the files below it that another unit holds under the same name.
    """
    f = files.filter(F.col("path").isNotNull() & F.col("content_hash").isNotNull()).select("unit", "path", "content_hash", F.coalesce("bytes", F.lit(0)).alias("n_bytes")).dropDuplicates(["unit", "path"])
    f = f.withColumn("parts", F.split("path", "/"))
    entries = durable(
        f.select(
            "unit",
            F.array_join(F.slice("parts", F.lit(1), F.size("parts") - 1), "/").alias("directory"),
            (F.size("parts") - 1).alias("depth"),
            F.element_at("parts", -1).alias("name"),
            F.col("content_hash").alias("hash"),
            "n_bytes",
        ),
        "entries",
    )
    held = entries.filter("n_bytes > 0").groupBy("name", "hash").agg(F.min("unit").alias("u"), F.max("unit").alias("v")).filter("u <> v")
    twice = durable(held.select("name", "hash", F.lit(1).alias("held")), "held")
    near = F.broadcast(twice) if twice.count() <= BROADCAST_ROWS else twice
    entries = entries.join(near, ["name", "hash"], "left").withColumn("n_covered", F.coalesce(F.col("held").cast("long"), F.lit(0).cast("long"))).drop("held")
    entries = durable(entries.withColumn("covered_bytes", F.col("n_covered") * F.col("n_bytes")), "marked")
    deepest = entries.agg(F.max("depth")).first()[0] or 0
    kept = ["unit", "directory", "name", "hash", "n_bytes", "n_covered", "covered_bytes"]
    levels = []
    above = None
    for depth in range(deepest, 1, -1):  # depth 1 is the unit's root
        here = entries.filter(F.col("depth") == depth).select(kept)
        if above is not None:
            below = above.withColumn("name", F.element_at(F.split("directory", "/"), -1)).withColumn("directory", F.regexp_replace("directory", "/[^/]*$", ""))
            here = here.unionByName(below.select(kept))
        sums = here.groupBy("unit", "directory").agg(
            F.sum(F.xxhash64("name", "hash").cast("decimal(38,0)")).alias("a"),
            F.sum(F.xxhash64(F.lit("second"), "hash", "name").cast("decimal(38,0)")).alias("b"),
            F.count(F.lit(1)).alias("n"),
            *[F.sum(c).alias(c) for c in ("n_bytes", "n_covered", "covered_bytes")],
        )
        digest = F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")), 256)
        above = durable(sums.select("unit", "directory", F.lit(depth).alias("depth"), digest.alias("hash"), "n_bytes", "n_covered", "covered_bytes"), "level")
        levels.append(above)
    out = levels[0] if levels else entries.limit(0).select("unit", "directory", "depth", "hash", "n_bytes", "n_covered", "covered_bytes")
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def shared_subtrees(hashes: DataFrame) -> DataFrame:
    """(unit, directory): subtrees that at least two units hold, whole or but for edited files."""
    told = hashes.filter(F.col("n_bytes") >= SUBTREE_BYTES)
    twice = told.groupBy("hash").agg(F.min("unit").alias("u"), F.max("unit").alias("v")).filter("u <> v").select("hash")
    whole = told.join(twice, "hash", "left_semi").select("unit", "directory")
    edited = told.filter((F.col("n_covered") >= COPY_FILES) & (F.col("covered_bytes") >= COPY_SHARE * F.col("n_bytes"))).select("unit", "directory")
    return whole.unionByName(edited)


def not_handwritten(files: DataFrame) -> DataFrame:
    """(file_id, reason) with a row for each reason that a file has."""
    own = spread(files.select("file_id", "path", "lines", "bytes", "text"), "file_id").mapInPandas(_judge, "file_id string, reason string")
    shared = shared_subtrees(subtree_hashes(files)).distinct()
    parts = F.split("path", "/")
    above = files.filter(F.col("path").isNotNull()).select("file_id", "unit", parts.alias("parts")).select(
        "file_id", "unit", F.explode(F.filter(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda k: F.when(k < F.size("parts"), F.array_join(F.slice("parts", 1, k), "/"))), lambda x: x.isNotNull())).alias("directory")
    )
    copies = above.join(shared, ["unit", "directory"], "left_semi").select("file_id", F.lit("shared-subtree").alias("reason"))
    return own.unionByName(copies).distinct()
