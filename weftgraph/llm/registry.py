"""Queries of the text and source-file problems and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import handwritten, mixing, pii, syntax, tokenizer


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Files that are generated, minified, third-party copies or data."""
    return handwritten.not_handwritten(_table(spark, d, "files")).select("file_id").distinct()


def p2_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The reasons for each of those files."""
    return handwritten.not_handwritten(_table(spark, d, "files"))


def p2_remaining(spark: SparkSession, d: str) -> DataFrame:
    """The hand-written files that remain."""
    files = _table(spark, d, "files")
    return files.select("file_id", "path").distinct().join(p2_found(spark, d), "file_id", "left_anti")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Files whose text is not of the language of their extension."""
    return syntax.faulty_files(_table(spark, d, "files")).select("file_id")


def p5_errors(spark: SparkSession, d: str) -> DataFrame:
    """First cause and number of errors of the files that do not parse."""
    return syntax.faulty_files(_table(spark, d, "files")).select("file_id", "unit", "language", "n_errors", "first_line", "first_cause")


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    """Files that do not parse per unit and language."""
    return syntax.error_rates(_table(spark, d, "files"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return tokenizer.encode_corpus(_table(spark, d, "documents"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mixture: one row per use of a text."""
    chosen, _ = mixing.mix(_table(spark, d, "documents"), _table(spark, d, "mix_targets"))
    return mixing.epochs_of(chosen).select("doc_id", "source", "epoch", "n_tokens")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of the tokens per source."""
    return mixing.shares(*mixing.mix(_table(spark, d, "documents"), _table(spark, d, "mix_targets")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Personal items in the documents."""
    return pii.personal_items(_table(spark, d, "documents"), _table(spark, d, "given_names"))


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    """All documents with typed placeholders in place of personal items."""
    return pii.redacted(_table(spark, d, "documents"), _table(spark, d, "given_names"))


QUERIES = {f.__name__: f for f in (p2_found, p2_reasons, p2_remaining, p5_found, p5_errors, p5_rates, p8_ids, p9_mix, p9_shares, p10_found, p10_redacted)}

ORACLE: dict[str, str] = {}
