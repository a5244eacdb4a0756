from __future__ import annotations

import pytest

notices = pytest.importorskip("weftgraph.llm.notices")
from weftgraph.llm import handwritten  # noqa: E402

GENERATED = [
    "// Diese Datei wurde automatisch generiert von protogen 3.1 - nicht bearbeiten!",
    "# Maschinell erstellt mit yacc-kit 2.0.1",
    "/* Généré par thrift-gen 0.9.\n * Ne pas éditer. */",
    "# Archivo generado por swagger-codegen 2.4, no modificar",
    "# Creato da schemac 1.2; non modificare.",
    "# Gegenereerd door modelkit, niet wijzigen.",
    "/* Built from grammar.y with bison 3.8, never edit it. */",
    "# Produced by the table compiler 4.1",
]
FOREIGN = [
    "# Vendored from requests 2.31; report issues upstream.",
    "/* This is a copy of zlib 1.2.13, third-party code. */\n/* maintained elsewhere */",
    "// Forked from leftpad v1.3.0 - sync with upstream",
    "# Kopiert aus jsonkit 2.1, nicht gepflegt in diesem Baum",
    "# Mirror of the tzdata project, release 2.24: fixes there",
]
NEITHER = [
    "", "   ", "# The generated tables are read by main.", "# Do not edit the list without asking.", "# Vendored code was removed in 2.0, see upstream for fixes.", "# Written by hand, do not edit.",
    "# Not generated by protogen 3.1 any more, do not edit the order.", "# Works with python 3.11 and later.", "# Part of the x toolkit 2.0.", "# Used by upstream callers.", "# Imported by main, tested with numpy 1.2.",
    "# The copy of zlib 1.2 was replaced by our own implementation; upstream fixes are not needed.",
]


@pytest.mark.parametrize("comment", GENERATED)
def test_generator(comment):
    assert notices.speaks_of_generator(comment)


@pytest.mark.parametrize("comment", FOREIGN)
def test_foreign_project(comment):
    assert notices.speaks_of_foreign_project(comment)


@pytest.mark.parametrize("comment", [None, *NEITHER])
def test_neither(comment):
    assert not notices.speaks_of_generator(comment) and not notices.speaks_of_foreign_project(comment)


def test_edited_copies(spark):
    kind = "file_id string, path string, lines long, bytes long, text string, unit string, content_hash string"
    kit = [(f"k{i}", f"kit/f{i}.c", 9, 900, f"h{i}") for i in range(6)] + [(f"s{i}", f"kit/sub/g{i}.c", 9, 900, f"g{i}") for i in range(4)]
    rows = []
    for unit, root in (("u", "u/src"), ("v", "v/other/place")):
        for i, path, lines, size, h in kit:
            edited = unit == "v" and i == "k0"
            rows.append((unit + i, f"{root}/{path}", lines, size, None, unit, "edited" if edited else h))
        rows.append((unit + "own", f"{root}/own.c", 2_000, 90_000, None, unit, unit))
    # a directory that shares two files only, and one most of whose bytes are its own
    rows += [("w1", "w/a/f1.c", 9, 900, None, "w", "h1"), ("w2", "w/a/f2.c", 9, 900, None, "w", "h2"), ("w3", "w/b/f1.c", 9, 900, None, "w", "h1"), ("w4", "w/b/f2.c", 9, 900, None, "w", "h2"), ("w5", "w/b/f3.c", 9, 900, None, "w", "h3"), ("w6", "w/b/own.c", 300, 9_000, None, "w", "x")]
    got = {r.file_id for r in handwritten.not_handwritten(spark.createDataFrame(rows, kind)).collect()}
    assert got == {u + i[0] for u in "uv" for i in kit}
    hashes = {(r.unit, r.directory): r for r in handwritten.subtree_hashes(spark.createDataFrame(rows, kind)).collect()}
    assert hashes["u", "u/src/kit/sub"].hash == hashes["v", "v/other/place/kit/sub"].hash
    assert hashes["u", "u/src/kit"].hash != hashes["v", "v/other/place/kit"].hash
    assert hashes["v", "v/other/place/kit"].n_covered == 9
