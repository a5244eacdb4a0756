from __future__ import annotations

import os
import random

import pytest

tokenizer = pytest.importorskip("weftgraph.llm.tokenizer")
from weftgraph.llm import mixing  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.exists(tokenizer.VOCABULARY), reason="no vocabulary")
PARTS = [" ", "  ", "\n", "\r\n", "a", "bc", "'s", "'ll", "9", "é", "中", "!", "\t", "x" * 60, " " * 30, "don't ", "<|endoftext|>"]


@pytest.mark.parametrize("chunk,overlap,scattered", [(64, 16, 1 << 18), (64, 16, 200), (30, 30, 40), (16, 4, 0), (2048, 128, 1 << 18)])
def test_ids_are_those_of_whole_texts(spark, chunk, overlap, scattered):
    rng = random.Random(chunk)
    docs = [(i, "".join(rng.choice(PARTS) for _ in range(rng.choice([0, 3, 50, 200]))), "ids") for i in range(60)]
    docs += [(100, None, ""), (101, "", ""), (102, "a" * 900, ""), (103, " " * 900, ""), (3, docs[3][1], "")]
    df = spark.createDataFrame(docs, "doc_id long, text string, ids string")
    enc = tokenizer.encoding(tokenizer.VOCABULARY)
    got = sorted((r.doc_id, list(r.ids)) for r in tokenizer.encode_corpus(df, chunk=chunk, overlap=overlap, scattered=scattered).collect())
    assert got == sorted((i, enc.encode_ordinary(t) if t else []) for i, t, _ in docs)
    sized = tokenizer.count_tokens(df, chunk=chunk, overlap=overlap, scattered=scattered)
    assert sized.columns == ["doc_id", "ids", "n_tokens"] and sorted((r.doc_id, r.n_tokens) for r in sized.collect()) == sorted((i, len(x)) for i, x in got)
    texts = {i: t or "" for i, t, _ in docs}
    assert all(tokenizer.decode(ids) == texts[i] for i, ids in got if i != 3)


def test_certain_boundaries():
    rng = random.Random(5)
    for _ in range(400):
        text = "".join(rng.choice(PARTS) for _ in range(40))
        start = rng.randrange(len(text) - 1)
        late = {start + p for p in tokenizer.boundaries(text[start:])} - {start}
        sure = {p for p in range(start + 1, len(text)) if tokenizer.certain(text, p)}
        assert sure <= late and sure <= set(tokenizer.boundaries(text))
        assert "".join(tokenizer.pieces(text, 24, 8)) == text


def test_long_texts_are_cut():
    text = "word " * 2000 + "a" * 5000 + " word" * 2000
    parts = tokenizer.pieces(text)
    assert "".join(parts) == text and len(parts) > 8 and max(map(len, parts)) < 5000 + 3 * tokenizer.CHUNK
    assert tokenizer.encode(text) == tokenizer.encoding(tokenizer.VOCABULARY).encode_ordinary(text)


DOC = "doc_id long, text string, source string, max_repeats string, size long"
TARGET = "source string, target_share double, max_repeats long, budget long"


def test_mix(spark):
    docs = [(i, f"word number {i} of many " * (i % 5 + 1), "big", "x", 1) for i in range(300)]
    docs += [(1000 + i, f"small text {i} here", "small", "x", 1) for i in range(20)]
    docs += [(2000, docs[0][1], "small", "x", 1), (2001, None, "big", None, None), (2002, "", "big", None, None), (2003, "unused", None, None, None), (2004, "unused", "other", None, None)]
    targets = [("big", 0.6, 1, 0), ("small", 0.2, 5, 0), ("absent", 0.2, 9, 0), (None, 0.1, 1, 0)]
    chosen, per = mixing.mix(spark.createDataFrame(docs, DOC), spark.createDataFrame(targets, TARGET))
    rows = chosen.collect()
    texts = {d[0]: d[1] for d in docs}
    assert all(r.uses <= {"big": 1, "small": 5}[r.source] for r in rows)
    assert len({texts[r.doc_id] for r in rows}) == len(rows) and 2000 not in {r.doc_id for r in rows}
    shares = {r.source: r for r in mixing.shares(chosen, per).collect()}
    assert abs(shares["big"].actual_share - 0.75) < 0.02 and shares["absent"].actual_share == 0
    assert sum(r.uses for r in rows) == mixing.epochs_of(chosen).count()


def test_mix_over_ranges_is_the_same(spark, monkeypatch):
    docs = [(i, f"text {i} " * (i % 7 + 1), "ab"[i % 3 == 0], "x", 1) for i in range(200)]
    args = spark.createDataFrame(docs, DOC), spark.createDataFrame([("a", 0.5, 1, 0), ("b", 0.5, 3, 0)], TARGET)
    one = sorted(map(tuple, mixing.mix(*args)[0].collect()))
    monkeypatch.setattr(mixing, "RANGE_ROWS", 30)
    assert sorted(map(tuple, mixing.mix(*args)[0].collect())) == one


def test_mix_of_nothing(spark):
    chosen, per = mixing.mix(spark.createDataFrame([], DOC), spark.createDataFrame([("a", 1.0, 1, 0)], TARGET))
    assert chosen.collect() == [] and mixing.shares(chosen, per).count() == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_shares_by_an_independent_count(spark, seed):
    rng = random.Random(seed)
    docs = [(i, " ".join(rng.choice(["one", "two", "three", "é", "9"]) for _ in range(rng.randrange(1, 60))) + f" {i}", rng.choice("aaaabbc"), "x", 1) for i in range(400)]
    targets = {"a": (0.3, 2), "b": (0.5, 3), "c": (0.2, 4)}
    chosen, per = mixing.mix(spark.createDataFrame(docs, DOC), spark.createDataFrame([(s, t, m, 0) for s, (t, m) in targets.items()], TARGET))
    enc = tokenizer.encoding(tokenizer.VOCABULARY)
    n = {i: len(enc.encode_ordinary(t)) for i, t, *_ in docs}
    of = {i: s for i, _, s, *_ in docs}
    size = {s: sum(n[i] for i in n if of[i] == s) for s in targets}
    total = min(m * size[s] / t for s, (t, m) in targets.items())  # the largest mixture within every cap
    uses = {r.doc_id: r.uses for r in chosen.collect()}
    for s, (t, m) in targets.items():
        mine = {i: uses.get(i, 0) for i in n if of[i] == s}
        used = sum(n[i] * k for i, k in mine.items())
        assert abs(used - min(int(total * t), m * size[s])) <= max(n[i] for i in mine) / 2 + 1
        assert max(mine.values()) <= m and max(mine.values()) - min(mine.values()) <= 1
    assert {r.source: r.used_tokens for r in mixing.shares(chosen, per).collect()} == {s: sum(n[i] * k for i, k in uses.items() if of[i] == s) for s in targets}
