"""Encoding of a corpus with a public byte-level BPE by overlapping chunks.

Every text is a sequence of chunks that overlap. Chunks are pre-tokenised each from its own start;
two neighbours are stitched at the first pre-token boundary of the overlap that both have and that
is certain, which means that it is one wherever the reading began. The pieces between the stitches
are encoded and their ids put together in order. An overlap without such a boundary (one run of
letters or blanks fills it) joins its two chunks to one piece, so the ids are always those of the
whole text.

The chunks of a text are worked on where the text is read. Only those of a text of more than
``SCATTERED`` characters are dealt out to all tasks, by the same steps as a shuffle of its chunks, so
one long text is no task's burden; the ids do not depend on where a chunk is worked on.

Defined cases: null and empty texts give an empty list; special tokens' strings are ordinary text;
lone surrogates cannot occur in a string column; repeated documents give a row each; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.plans.spread import spread

#: Default place of the vocabulary; every function takes another as ``vocabulary``.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-token pattern of the vocabulary (a fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a chunk, and of the part it shares with the next one.
CHUNK, OVERLAP = 2048, 128
#: Characters of a text from which its chunks are dealt out to all tasks.
SCATTERED = 1 << 18


@lru_cache(maxsize=4)
def encoding(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def _token_bytes(vocabulary: str) -> dict[int, bytes]:
    with open(vocabulary, "rb") as f:
        return {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}


def decode(ids: list[int], vocabulary: str = VOCABULARY) -> str:
    """The text of the ids: their raw bytes put together."""
    table = _token_bytes(vocabulary)
    return b"".join(table[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def _pattern():
    import regex

    return regex.compile(PATTERN)


def boundaries(text: str) -> list[int]:
    """Starts of the pre-tokens of ``text``, read from its beginning."""
    return [m.start() for m in _pattern().finditer(text)]


def _sort_of(c: str) -> str:
    if c.isspace():
        return "mark" if "\x1c" <= c <= "\x1f" else "blank"  # blanks for the language, none for the pattern
    return {"L": "letter", "N": "number"}.get(unicodedata.category(c)[0], "mark")


def certain(text: str, at: int) -> bool:
    """Whether a pre-token starts at ``at`` wherever the reading of the text began.

    It does where the sort of character changes behind one that is no blank: no pre-token of the
    pattern holds two sorts, but for a leading blank and the letters behind an apostrophe.
    """
    before = text[at - 1]
    return not before.isspace() and before != "'" and _sort_of(before) != _sort_of(text[at])


def _ends_of(text: str, chunk: int, overlap: int, last: bool) -> tuple[list[int], list[int]]:
    """Boundaries of a chunk in the part it shares with the one before, and the certain ones in the part it shares with the next."""
    every = boundaries(text)
    # the last pre-token of a chunk may go on behind its end, and the one before may look ahead to it
    sure = every if last else every[:-2]
    return [p for p in every if p < overlap], [p for p in sure if p >= chunk and certain(text, p)]


def pieces(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """The text cut where neighbouring chunks resynchronise."""
    cuts, shared = [0], []
    if len(text) > chunk:
        for at in range(0, len(text), chunk):
            heads, tails = _ends_of(text[at : at + chunk + overlap], chunk, overlap, at + chunk + overlap >= len(text))
            heads = {at + p for p in heads}
            cuts += [p for p in shared if p in heads][:1]
            shared = [at + p for p in tails]
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]


def encode(text: str | None, vocabulary: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """The ids of a text, by its pieces."""
    if not text:
        return []
    each = encoding(vocabulary).encode_ordinary
    parts = pieces(text, chunk, overlap)
    return each(parts[0]) if len(parts) == 1 else [i for part in parts for i in each(part)]


def _encoded(vocabulary: str, chunk: int, overlap: int, sizes: bool):
    """Ids (or their number) in place of the last column, a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [encode(t, vocabulary, chunk, overlap) for t in b.column(b.num_columns - 1).to_pylist()]
            out = pa.array([len(x) for x in ids], pa.int64()) if sizes else pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], out], names=[*b.schema.names[:-1], "n_tokens" if sizes else "ids"])

    return run


def _edges(chunk: int, overlap: int):
    """Pre-tokenise each chunk; its boundaries in the first and the last overlap, as positions in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads, tails = [], []
            names = b.schema.names
            for no, text, last in zip(*(b.column(names.index(c)).to_pylist() for c in ("chunk_no", "part", "last"))):
                h, t = _ends_of(text, chunk, overlap, last)
                heads.append([no * chunk + p for p in h])
                tails.append([no * chunk + p for p in t])
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(heads, kind), pa.array(tails, kind)], names=[*names, "heads", "tails"])

    return run


def _scattered(long: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(row_no, row, piece_no, part): the pieces of texts whose chunks are dealt out; rows are (row_no, row, text)."""
    last = F.ceil(F.length("text") / F.lit(chunk)).cast("int") - 1
    # the parts are cut beside the one copy of the text, and only they leave the row
    cut = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(k.alias("chunk_no"), F.substring("text", k * chunk + 1, F.lit(chunk + overlap)).alias("part"), (k * chunk + chunk + overlap >= F.length("text")).alias("last")))
    kind = long.schema["row"].dataType.simpleString()
    chunks = long.select("row_no", "row", F.explode(cut).alias("c")).select("row_no", "row", "c.chunk_no", "c.part", "c.last").repartition("row_no", "chunk_no")
    marked = chunks.mapInArrow(_edges(chunk, overlap), f"row_no long, row {kind}, chunk_no int, part string, last boolean, heads array<long>, tails array<long>")
    w = Window.partitionBy("row_no").orderBy("chunk_no")
    start = F.when(F.col("chunk_no") == 0, F.lit(0).cast("long")).otherwise(F.array_min(F.array_intersect("heads", F.lag("tails").over(w))))
    placed = marked.withColumn("start", start).withColumn("next_start", F.lead("start").over(w)).drop("heads", "tails")
    piece_no = F.max(F.when(F.col("start").isNotNull(), F.col("chunk_no"))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at = F.col("chunk_no").cast("long") * chunk
    begin = F.coalesce(F.col("start") - at, F.lit(0).cast("long"))
    # up to the next stitch; where there is none the next chunk goes on from its own beginning
    end = F.coalesce(F.col("next_start") - at, F.when(F.lead("chunk_no").over(w).isNotNull(), F.lit(chunk)), F.lit(chunk + overlap)).cast("long")
    parts = placed.withColumn("piece_no", piece_no).withColumn("begin", begin).withColumn("end", end)
    parts = parts.withColumn("part", F.substring("part", (F.col("begin") + 1).cast("int"), F.greatest(F.col("end") - F.col("begin"), F.lit(0)).cast("int")))
    return parts.groupBy("row_no", "piece_no").agg(F.first("row").alias("row"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "part"))), lambda x: x["part"]), "").alias("part"))


def _run(rows: DataFrame, others: list[str], text: str, vocabulary: str, chunk: int, overlap: int, scattered: int, sizes: bool) -> DataFrame:
    schema = lambda df, names, more: ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names), more])
    made = "n_tokens long" if sizes else "ids array<int>"
    rows = rows.select(*others, F.col(text).alias("text"))
    work = _encoded(vocabulary, chunk, overlap, sizes)
    is_long = F.coalesce(F.length("text") > scattered, F.lit(False))
    near = rows.filter(~is_long).mapInArrow(work, schema(rows, others, made))
    # a number that a repeated task gives again, the input being the same
    long = rows.filter(is_long).select(F.xxhash64(F.monotonically_increasing_id(), *others).alias("row_no"), F.struct(*others).alias("row"), "text")
    cut = _scattered(long, chunk, overlap).select("row_no", "row", "piece_no", "part")
    found = cut.mapInArrow(work, schema(cut, ["row_no", "row", "piece_no"], made))
    whole = F.sum("n_tokens").alias("n_tokens") if sizes else F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "ids"))), lambda x: x["ids"])).alias("ids")
    far = found.groupBy("row_no").agg(F.first("row").alias("row"), whole)
    far = far.select(*[F.col(f"row.`{c}`").alias(c) for c in others], "n_tokens" if sizes else "ids")
    return near.unionByName(far)


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP, scattered: int = SCATTERED) -> DataFrame:
    """(key, ids) for every row of ``documents``."""
    return _run(spread(documents.select(key, text), key), [key], text, vocabulary, chunk, overlap, scattered, False)


def count_tokens(rows: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP, scattered: int = SCATTERED) -> DataFrame:
    """``rows`` with ``n_tokens`` in place of ``text``."""
    return _run(rows, [c for c in rows.columns if c != text], text, vocabulary, chunk, overlap, scattered, True)
