from __future__ import annotations

import random

import pytest

pii = pytest.importorskip("weftgraph.llm.pii")
GIVEN = frozenset(pii.fold(n) for n in ("Mirelle", "Tavik", "Dario"))


def found(text):
    return {(k, text[a:b]) for a, b, k in pii.find_items(text, GIVEN)}


@pytest.mark.parametrize("text,want", [
    ("Write to a.b+c@x-y.example.", {("email", "a.b+c@x-y.example")}),
    ("Send it to me at here dot test, please", {("email", "me at here dot test")}),
    ("to me [at] here [dot] test or me @ here.test", {("email", "me [at] here [dot] test"), ("email", "me @ here.test")}),
    ("Best captions at here (dot) example, follow @there9", set()),
    ("Call (212) 555-0101 or 1-212-555-0101, +1 212 555 0101, 212.555.0101", {("phone", p) for p in ("(212) 555-0101", "1-212-555-0101", "+1 212 555 0101", "212.555.0101")}),
    ("It's 555-O1l9. Or +44 7700 900123, 07700 900 123, (030) 23125 118, +49 30 23125-118, 01 99 00 12 34", {("phone", p) for p in ("555-O1l9", "+44 7700 900123", "07700 900 123", "(030) 23125 118", "+49 30 23125-118", "01 99 00 12 34")}),
    ("five-five-five, oh one one eight", {("phone", "five-five-five, oh one one eight")}),
    ("one two three", set()),
    ("00:00:27,710 --> 00:00:30,924\nDocket 6/22/2015, part 27-524-10, locker 2217-4, 19:30, 29.50", set()),
    ("X1234567, 912-34-5678; 912 34 5678, QK 12 34 56 A 912345678 12345678-O LFR85T2827", {("id_number", p) for p in ("X1234567", "912-34-5678", "912 34 5678", "QK 12 34 56 A", "912345678", "12345678-O", "LFR85T2827")}),
    ("at 36 Lantern\nStreet, quickly; 7b St. Ebbin's Square.", {("address", "36 Lantern\nStreet"), ("address", "7b St. Ebbin's Square")}),
    ("5\nOld Mill Lane is wet. The Ledger Street bridge.", set()),
    ("in der M\u00fcllerweg 9, Am Alten Kran 14b. Vive en Calle del Faro, 3. Elle habite 12, rue des Lampes.", {("address", p) for p in ("M\u00fcllerweg 9", "Am Alten Kran 14b", "Calle del Faro, 3", "12, rue des Lampes")}),
    ("My name is Odela Norquist.", {("name", "Odela Norquist")}),
    ("Dr. Mirelle\r\nvan Kel will see you now.", {("name", "Mirelle\r\nvan Kel")}),
    ("The witness, Norquist, Tavik, stood up.", {("name", "Norquist, Tavik")}),
    ("Is there a Mr. tavik norquist-fen here?", {("name", "tavik norquist-fen")}),
    ("Directed by MireIIe NorqulsT", {("name", "MireIIe NorqulsT")}),
    ("I saw Dario Norquist there", {("name", "Dario Norquist")}),
    ("I met Dario\nNorquist there, DARIO NORQUIST and Mirelle O'Keel, Tavik McHolm, TAVIK O’KEEL, TAVIK McHOLM.", {("name", n) for n in ("Dario\nNorquist", "DARIO NORQUIST", "Mirelle O'Keel", "Tavik McHolm", "TAVIK O’KEEL", "TAVIK McHOLM")}),
    ("TAVIK Sergeant went. Dario\n\nNorquist. DARIO: No. TAVIK REAILY SAID, ask Tavik\nThen go. Dario NO", set()),
    ("Translated by Tavik\n\n2\nTAVIK: Sergeant Holwick, ask Mirelle. Synced by teamwillow, v11", set()),
    ("", set()), ("   \n", set()),
])
def test_items(text, want):
    assert found(text) == want


def test_feistel_is_a_keyed_permutation():
    for n in (1, 2, 3, 7, 10):
        values = {str(random.Random(i).randrange(10**n)).zfill(n) for i in range(200)}
        images = {pii.feistel(v, b"k", "t") for v in values}
        assert len(images) == len(values) and all(len(v) == n for v in images)
        assert all(pii.feistel(pii.feistel(v, b"k", "t"), b"k", "t", back=True) == v for v in values)
    assert pii.feistel("5550101", b"k") != pii.feistel("5550101", b"other")


def test_placeholders_link_equal_values():
    a = pii.redact("Call 555-0119 now, says Dario Norquist.", GIVEN)
    b = pii.redact("It's 555-O1l9. My name is Norquist, Dario.", GIVEN)
    assert a.split("]")[0].split("[")[1] == b.split("]")[0].split("[")[1] and "555-01" not in a
    assert a.split("[NAME ")[1][:26] == b.split("[NAME ")[1][:26] and a.endswith("].")


# Names in sentences of other wording than the data's: (text, names).
OTHER_WORDING = [
    ("They say her name was Ysolde Tarrant, once.", ["Ysolde Tarrant"]),
    ("They say her name was Ysolde Tarrant.", ["Ysolde Tarrant"]),
    ("A boy called Ruben Ashgrove!", ["Ruben Ashgrove"]),
    ("Professor Ysolde Tarrant is late.", ["Ysolde Tarrant"]),
    ("Sra. Nieves Robledo llega.", ["Nieves Robledo"]),
    ("Frau Ilse von Brandt, bitte.", ["Ilse von Brandt"]),
    ("Edited by Ruben T. Ashgrove", ["Ruben T. Ashgrove"]),
    ("Untertitel: Ilse Brandt", ["Ilse Brandt"]),
    ("Sottotitoli: Carla Ferrante\nfine", ["Carla Ferrante"]),
    ("Mi chiamo Carla Ferrante.", ["Carla Ferrante"]),
    ("mr. ruben ashgrove was here", ["ruben ashgrove"]),
    ("THE DEFENDANT, RUBEN ASHGROVE, HAS LEFT", ["RUBEN ASHGROVE"]),
    ("My name is not important. MY NAME IS NOT KNOWN. Dr. Ashgrove said", []),
    ("Yes, se\u00f1or.\nHasta Luego, friend", []),
    ("Produced by hand. Directed by\n\nRuben Ashgrove", []),
    ("Inspector Ashgrove Will not", []),
]


@pytest.mark.parametrize("text,want", OTHER_WORDING)
def test_names_in_other_wording(text, want):
    assert [text[a:b] for a, b in pii.find_names(text, frozenset())] == want


def test_gates_lose_nothing():
    texts = [p for t in test_items.pytestmark[0].args[1] for p in (t[0], f"Before it.\r\n{t[0]}\r\nAfter it", t[0].upper(), t[0].replace(" ", "\n", 1))] + [t for t, _ in OTHER_WORDING]
    may = pii.gates(pii.pa.array(texts))
    for i, t in enumerate(texts):
        assert pii.find_items(t, GIVEN, {k: v[i] for k, v in may.items()}) == pii.find_items(t, GIVEN), t


def test_numbers_keep_their_format():
    a, b = pii.permuted_number("phone", "+49 30 23125-118", b"k"), pii.permuted_number("phone", "+49 30 23125 118", b"k")
    assert a.startswith("+49 ") and a[-4] == "-" and a != "+49 30 23125-118" and pii.number_of(a) == pii.number_of(b)
    for n in (12345678, 1, 99999999):
        letter = pii._CHECK_LETTERS[n % 23]
        new = pii.permuted_number("id_number", f"{n:08d}-{letter}", b"k")
        assert pii._CHECK_LETTERS[int(new[:8]) % 23] == new[-1] and new[8] == "-"


def test_birth_dates_stay_dates():
    assert {pii.permuted_day(d, b"k") for d in range(pii._DAYS[0], pii._DAYS[0] + 3000)}.__len__() == 3000
    same = [pii.redact(t, GIVEN, b"k") for t in ("Born on 1984-03-09.", "DOB: 09/03/1984")]
    year, month, day = same[0].split("[DATE ")[1].split("]")[0].split("-")
    assert same[1] == f"DOB: [DATE {day}/{month}/{year}]" and same[0] != "Born on [DATE 1984-03-09]."
    assert pii.redact("born 31.02.1990, on 1984-03-09", GIVEN) == "born 31.02.1990, on 1984-03-09"


def test_many_given_names_are_joined(spark):
    docs = spark.createDataFrame([(1, "I saw Tavik Norquist there"), (2, "I saw Oderin Norquist there"), (3, None), (4, "TAVIK NORQUIST went")], "doc_id long, text string")
    given = spark.createDataFrame([("Tavik",), ("Mirelle",), (None,)], "given_name string")
    rows, names = pii.with_given(docs, given, most=1)
    assert names is None and {r.doc_id: r.given for r in rows.collect()} == {1: [pii.fold("Tavik")], 2: [], 3: [], 4: [pii.fold("Tavik")]}
    near, names = pii.with_given(docs, given)
    assert names == {pii.fold("Tavik"), pii.fold("Mirelle")}


def test_tables(spark):
    docs = spark.createDataFrame([(1, "a@b.test a@b.test", "x"), (1, "a@b.test", "x"), (2, None, "x"), (3, "", "x"), (4, "long " * 50_000 + "c@d.test", "x")], "doc_id long, text string, pii_type string")
    given = spark.createDataFrame([("Tavik",), (None,), ("Tavik",)], "given_name string")
    assert {tuple(r) for r in pii.personal_items(docs, given).collect()} == {(1, "email", "a@b.test"), (4, "email", "c@d.test")}
    out = {r.doc_id: r.text for r in pii.redacted(docs, given).collect()}
    assert out[2] is None and out[3] == "" and "@" not in out[4] and len(out) == 4
    assert pii.personal_items(docs.limit(0), given.limit(0)).collect() == []
