"""Source files that do not parse, with all errors, first cause and rates per unit and language.

Defined cases: a null text or a path of no known extension is no case; an empty text parses;
repeated rows of a file count once (a file is faulty if one of its texts is); nesting of any depth is
followed; rows without a file_id are one file; a null unit is a unit of its own; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import parsing
from weftgraph.plans.spread import spread

PARSED = "file_id string, unit string, language string, n_errors int, first_line int, first_cause string, errors array<struct<at:int,cause:string>>"


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for file_id, unit, path, text in zip(b["file_id"], b["unit"], b["path"], b["text"]):
            language = parsing.language_of(path)
            if language is None or text is None:
                continue
            try:
                errors = parsing.parse(text, language)
            except RecursionError:
                errors = [(0, "nested too deeply")]
            line = text.count("\n", 0, errors[0][0]) + 1 if errors else None
            out.append((file_id, unit, language, len(errors), line, errors[0][1] if errors else None, [{"at": a, "cause": c} for a, c in errors]))
        frame = pd.DataFrame(out, columns=["file_id", "unit", "language", "n_errors", "first_line", "first_cause", "errors"])
        yield frame.astype({"first_line": "Int32"})


def parse_files(files: DataFrame) -> DataFrame:
    """One row per file with a kept text and a known extension."""
    rows = spread(files.filter(F.col("text").isNotNull()).select("file_id", "unit", "path", "text"), "file_id").mapInPandas(_parse, PARSED)
    # texts stay where they are read; only the small results meet by file
    worst = F.max_by(F.struct("unit", "language", "n_errors", "first_line", "first_cause", "errors"), "n_errors")
    return rows.groupBy("file_id").agg(worst.alias("r")).select("file_id", "r.*")


def faulty_files(files: DataFrame) -> DataFrame:
    return parse_files(files).filter("n_errors > 0")


def error_rates(files: DataFrame) -> DataFrame:
    """(unit, language, n_files, n_faulty, rate) per unit and language."""
    parsed = parse_files(files)
    return parsed.groupBy("unit", "language").agg(F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("n_errors") > 0).alias("n_faulty")).withColumn("rate", F.round(F.col("n_faulty") / F.col("n_files"), 6))
