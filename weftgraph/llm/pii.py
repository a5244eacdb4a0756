"""Personal information in free text: email addresses, phone and identity numbers, street addresses, names.

Items are found by their form in the raw text, so line breaks and errors of character recognition
stay in the item. Names are found by a listed given name before a family name, or by a cue and the
capitals: a naming verb, a title or role before the name, a credit on its line; the cues are word
lists for several languages. A cheap scan of each batch in Arrow tells which texts can hold an item
of a type at all; only those are searched, with the same result.

Each item gives way to a typed placeholder. Numbers that are valid for their format, and dates of
birth, are permuted by a keyed Feistel network within the format (country code, length, check letter
and calendar kept); other items get a keyed tag of 128 bits. Equal values get equal placeholders in
all documents, and without the key the values do not come back.

Defined cases: null, empty and blank texts hold nothing; an item that stands several times in a
document is one item; overlapping finds are settled by place, then length, then type; a lone given
name, a speaker label or a title with a family name is no name; a date that is no birth date or not
in the calendar is no item; repeated documents give equal rows once; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import hmac
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.plans.spread import spread

#: Setting that holds the key of the pseudonyms, and the key where it is unset (for tests only).
KEY_SETTING, KEY = "spark.weftgraph.pseudonym.key", b"weft"
#: Given names up to which the table is sent to the tasks; a larger one is joined with the texts' words.
GIVEN_NAMES = 200_000
TYPES = ("email", "phone", "id_number", "address", "name")

# -- forms ------------------------------------------------------------------------------------
_D = "[0-9OolI]"  # a digit, as character recognition may leave it
_GAP = r"(?:[ \t]|\r?\n)"  # a blank or one line break
_EMAIL = re.compile(
    r"(?<![\w.+-])[\w.+-]*\w(?:@|[ \t]@[ \t])\w[\w-]*(?:\.[\w-]*\w)+"
    rf"|(?<![\w.+-])[\w.+-]*\w{_GAP}at{_GAP}\w[\w-]*(?:{_GAP}dot{_GAP}\w[\w-]*)+(?![\w-])"
    rf"|(?<![\w.+-])[\w.+-]*\w{_GAP}?[(\[]at[)\]]{_GAP}?\w[\w-]*(?:{_GAP}?[(\[]dot[)\]]{_GAP}?\w[\w-]*)+(?![\w-])",
    re.I,
)
_WORD_DIGIT = "(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
_SEP = r"(?:[ .\-]|\r?\n)"
_PHONE = re.compile(
    rf"(?<![\w+./@:-])(?:"
    rf"(?:\+?1{_SEP})?(?:\({_D}{{3}}\){_SEP}?|{_D}{{3}}{_SEP}){_D}{{3}}{_SEP}{_D}{{4}}"
    rf"|{_D}{{3}}-{_D}{{4}}"
    rf"|\+{_D}{{2,3}}(?:{_SEP}\(?{_D}{{1,6}}\)?){{2,5}}"
    rf"|0{_D}{{4}}{_SEP}{_D}{{3}}{_SEP}{_D}{{3}}"
    rf"|\(0{_D}{{1,4}}\){_SEP}{_D}{{3,8}}(?:{_SEP}{_D}{{2,5}})?"
    rf"|0{_D}(?:{_SEP}{_D}{{2}}){{4}}"
    rf")(?![\w/@-]|[.,:]\d)"
    rf"|(?<!\w){_WORD_DIGIT}(?:[ ,-]+(?:\r?\n)?{_WORD_DIGIT}){{6,14}}(?!\w)",
    re.I,
)
_ID = re.compile(
    rf"(?<![\w+./@:-])(?:"
    rf"{_D}{{3}}-{_D}{{2}}-{_D}{{4}}|{_D}{{3}} {_D}{{2}} {_D}{{4}}"
    rf"|[A-Z]{{2}} ?{_D}{{2}} ?{_D}{{2}} ?{_D}{{2}} ?[A-Z]"
    rf"|[A-Z]{_D}{{7}}|[A-Z]{{3}}{_D}{{2}}[A-Z]{_D}{{4}}|{_D}{{8}}-?[A-Z]|{_D}{{9}}"
    rf")(?![\w/@-]|[.,:]\d)"
)
_STREET = r"(?:Street|Road|Lane|Drive|Way|Avenue|Row|Square|Court|Terrace|Close|Hill|Walk|Place|Crescent|Boulevard|Parade|Gardens|St\.|Rd\.|Ave\.|Ln\.|Dr\.(?![ \t]+[A-Z])|Sq\.|Blvd\.)"
_STREET_WORD = _STREET.replace(r"(?![ \t]+[A-Z])", "")
_NO = r"\d{1,5}[a-zA-Z]?"
_ADDRESS = re.compile(
    # 12 Some Street
    rf"(?<![\w:,.+/-]){_NO},?(?:[ \t]|(?<=[a-z] \d)\r?\n|(?<=[a-z] \d\d)\r?\n|(?<=[a-z] \d\d\d)\r?\n)(?:[^\W\d_a-z][^\s,;:.!?<]*\.?{_GAP}){{1,4}}?{_STREET}(?![\w])"
    # 12, rue de la Chose
    rf"|(?<![\w:,.+/-]){_NO},?{_GAP}(?:rue|avenue|chemin|place|boulevard|quai|impasse|all\S{{1,6}}e|route|cours|passage|square|villa){_GAP}(?:(?:de la|des|du|de|d|la|le|les){_GAP})?(?:de )?(?:[ld]['’])?[^\W\d_a-z\s][^\s,;.!?<]*(?:{_GAP}[A-ZÀ-Þ][^\s,;.!?<]*)*"
    # Irgendstraße 12, Am Alten Dings 12
    rf"|(?<![\w])[A-ZÀ-Þ][^\s,;:!?<]*?(?:stra[^\s\w]{{0,3}}\w{{0,4}}[^\s\w]{{0,3}}e|stra\S{{1,8}}e|str\.|weg|gasse|platz|allee|ring|damm|ufer|steig|markt){_GAP}{_NO}(?!\w)"
    rf"|(?<![\w])(?:Am|An der|An den|Im|In der|Zum|Zur|Auf der|Auf dem|Unter den|Hinter der)(?:{_GAP}[A-ZÀ-Þ][^\s,;:.!?<\d]*)+{_GAP}{_NO}(?!\w)"
    # Calle de la Cosa, 12
    rf"|(?<![\w])(?:Calle|Avenida|Camino|Plaza|Paseo|Carretera|Ronda|Traves\S{{1,4}}a){_GAP}(?:(?:del|de los|de las|de la|de|la|el|los|las){_GAP})?(?:[A-ZÀ-Þ][^\s,;:.!?<\d]*{_GAP}?)+?,?{_GAP}{_NO}(?!\w)"
)
# -- names --------------------------------------------------------------------------------------
_SAME = {"l": "i1|lIL", "t": "ftFT", "o": "0oO"}  # what folding makes one
_FOLD = str.maketrans({c: k for k, same in _SAME.items() for c in same})


def fold(text: str) -> str:
    """Lower case with the letters that character recognition mixes up made one; of equal length."""
    low = text.lower()
    return (low if len(low) == len(text) else "".join(c if len(c) == 1 else c[0] for c in map(str.lower, text))).translate(_FOLD)


# What introduces a person. "_" is a blank, "~" a letter with an accent, however it was encoded.
_NAMING = (
    "name_is name's names_is name_was named called known_as signed mein_name_ist ich_hei~e ich_heisse er_hei~t sie_hei~t je_m'appelle je_m~appelle s'appelle mon_nom_est "
    "me_llamo se_llama mi_nombre_es mi_chiamo si_chiama il_mio_nome ~_me_chamo chamo-me meu_nome_~ ik_heet mijn_naam_is nazywam_si~ jag_heter jeg_hedder"
)
_TITLES = "mr mrs ms dr prof mme mlle sr sra"
_ROLES = "miss professor doctor madam monsieur madame herr frau se~or se~ora signor signora witness defendant patient passenger inspector detective"
_CREDITS_BY = (
    "directed translated written subtitled corrected produced edited synced adapted created transcribed revised captioned timed proofread"
)
_CREDITS = (
    "translation translator adaptation direction director subtitles editor script producer ~bersetzung ubersetzung uebersetzung untertitel regie bearbeitung drehbuch traduction sous-titres r~alisation "
    "traducci~n subt~tulos direcci~n gui~n traduzione sottotitoli regia tradu~~o legendas vertaling ondertiteling"
)
_PARTICLES = "de_la van_der van_den de van von da del di du la le af ter"


def _cue(words: str, raw: bool = False) -> str:
    """An alternation of the words, for folded text or (``raw``) for text as it stands, in the syntax that both engines share."""

    def letter(c: str) -> str:
        if c == "~":
            return r"[^\s:]{1,8}"
        if c == "_":
            return r"\s{1,2}"
        c = c.translate(_FOLD)
        return ("[" + _SAME[c] + "]") if raw and c in _SAME else "(?:m|rn)" if c == "m" else re.escape(c)

    return "(?:" + "|".join("".join(map(letter, w)) for w in words.split()) + ")"


_WORD = r"[^\W\d_]+"
_FAMILY = rf"{_WORD}(?:['’]{_WORD})?(?:-{_WORD})?"
_NB = r"(?:[ \t]{1,3}|\r?\n)"
_FULL = rf"(?P<n>(?P<g>{_WORD}){_NB}(?:{_WORD}\.{_NB}){{0,2}}(?:{_cue(_PARTICLES)}{_NB})?(?P<f>{_FAMILY})|(?P<f2>{_FAMILY}),{_NB}(?P<g2>{_WORD}))"
#: What may stand behind a name: the end of a sentence or line, or a verb that goes with a person.
_STOP = re.compile(r"[ \t]*(?:[.!?<]|\r?\n|$)")
_CLOSED = re.compile(rf"[ \t]*(?:[.,!?<]|\r?\n(?!{_WORD})|$)|{_NB}{_cue('will would has had is was here there stood sat said says came went and or')}(?!\w)")
_INTRODUCED = (
    (re.compile(rf"(?<!\w){_cue(_NAMING)}{_GAP}{_FULL}"), _STOP),
    (re.compile(rf"(?<!\w)(?:{_cue(_TITLES)}[.,]?{_GAP}|{_cue(_ROLES)}(?:,?{_GAP}|\.[ \t])){_FULL}"), _CLOSED),
    (re.compile(rf"(?<!\w)(?:{_cue(_CREDITS_BY)}{_GAP}by{_GAP}|{_cue(_CREDITS)}[ \t]?:[ \t]?){_FULL}"), _STOP),
)
_CAPITAL = r"(?:(?:Mc|Mac|[OD]['’])?[A-ZÀ-Þ][a-zß-ÿ]{2,}|(?:Mc|MC|MAC|[OD]['’])?[A-ZÀ-Þ]{3,})"
_FULL_TITLE = re.compile(rf"(?<![\w'’-])(?P<g>[A-ZÀ-Þ][^\W\d_]*)(?=(?P<rest>(?:[ \t]{{1,2}}|[ \t]?\r?\n)(?:[A-Z]\.[ \t])?(?:(?:de|van|von|da|del|di|du)[ \t])?(?P<f>{_CAPITAL}(?:-{_CAPITAL})?))(?![\w'’:]))")

# Common words that are no family name where one may stand in capitals or on the next line; folded.
_COMMON = frozenset(
    """about after again against all also always and any are because been before being both but can could did does even ever for from
    had has have her here him his how into its just knew know last later like looks made may maybe might more must never not now off
    once only our out over really said same says shall she should since some soon still such take than that the their them then there
    they this though through told too under until upon very want wants was well went were what when where which while who why will
    with would yes yet you your""".translate(_FOLD).split()
)


def _letters(word: str) -> int:
    return sum(c.isalpha() for c in word)


def _person(first: str, family: str, given: frozenset[str]) -> bool:
    """Whether two words behind a cue are a person's: by the list, else by how both are written."""
    if min(_letters(first), _letters(family)) < 3:
        return False
    if fold(family) in _COMMON or fold(first) in _COMMON:
        return False
    if fold(first) in given:
        return True
    return first[0].isupper() == family[0].isupper()


def find_names(text: str, given: frozenset[str]) -> list[tuple[int, int]]:
    folded = fold(text)
    found = []
    for pattern, end in _INTRODUCED:
        for m in pattern.finditer(folded):
            g, f = ("g", "f") if m["g"] else ("g2", "f2")
            first, family = text[m.start(g) : m.end(g)], text[m.start(f) : m.end(f)]
            # capitals show where a name ends; without them something must close it
            shown = m["g"] and first.istitle() and family[0].isupper() and family[-1].islower() and not text[m.end() :].lstrip(" \t")[:1].isupper()
            if (shown or end.match(folded, m.end())) and _person(first, family, given):
                found.append(m.span("n"))
    return found + listed_names(text, given)


def listed_names(text: str, given: frozenset[str]) -> list[tuple[int, int]]:
    """Listed given names with the family name behind them."""
    found = []
    for m in _FULL_TITLE.finditer(text):
        # A family name in capitals goes with a given name in capitals.
        plain = m["f"][-1].islower() and "\n" not in m["rest"]
        if fold(m["g"]) in given and m["f"][-1].isupper() == m["g"][-1].isupper() and (plain or fold(m["f"]) not in _COMMON):
            found.append((m.start(), m.end("rest")))
    return found


# -- which texts can hold an item of a type -----------------------------------------------------
# Each gate is what its pattern cannot do without, in the syntax of Arrow's linear-time engine; \\s
# and \\w are narrower there, so the gates spell out what may stand between.
_ANY_DIGIT = r"[\p{Nd}OolI]"
_BETWEEN = r"[ .\-\r\n]{1,2}"
_GATES = {
    "email": r"@|(?i:\bat\b[)\]]?\s{0,2}[^\s]+?\s{0,2}[(\[]?dot\b)",
    "phone": (
        rf"{_ANY_DIGIT}{{3}}\)?{_BETWEEN}{_ANY_DIGIT}{{3}}{_BETWEEN}{_ANY_DIGIT}{{4}}|\({_ANY_DIGIT}{{3}}\){_ANY_DIGIT}{{3}}|{_ANY_DIGIT}{{3}}-{_ANY_DIGIT}{{4}}|\+{_ANY_DIGIT}{{2,3}}{_BETWEEN}\(?{_ANY_DIGIT}"
        rf"|0{_ANY_DIGIT}{{4}}{_BETWEEN}{_ANY_DIGIT}{{3}}{_BETWEEN}|\(0{_ANY_DIGIT}{{1,4}}\)|0{_ANY_DIGIT}(?:{_BETWEEN}{_ANY_DIGIT}{{2}}){{4}}"
        r"|(?i:(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)[ ,\-]+(?:\r?\n)?(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)[ ,\-]+(?:\r?\n)?(?:zero|oh|one|two|three|four|five|six|seven|eight|nine))"
    ),
    "id_number": (
        rf"{_ANY_DIGIT}{{3}}[ -]{_ANY_DIGIT}{{2}}[ -]{_ANY_DIGIT}{{4}}|[A-Z]{{2}} ?{_ANY_DIGIT}{{2}} ?{_ANY_DIGIT}{{2}} ?{_ANY_DIGIT}{{2}} ?[A-Z]|[A-Z]{_ANY_DIGIT}{{7}}|[A-Z]{{3}}{_ANY_DIGIT}{{2}}[A-Z]{_ANY_DIGIT}{{4}}"
        rf"|{_ANY_DIGIT}{{8}}-?[A-Z]|{_ANY_DIGIT}{{9}}"
    ),
    "address": (
        rf"\p{{Nd}}[a-zA-Z]?,?\s{{1,2}}(?:[^\s,;:!?<]+\s{{1,2}}){{1,4}}{_STREET_WORD}"
        r"|\p{Nd}[a-zA-Z]?,?\s{1,2}(?:rue|avenue|chemin|place|boulevard|quai|impasse|all[^\s]{1,6}e|route|cours|passage|square|villa)\s"
        r"|(?:stra[^\s]{1,12}e|str\.|weg|gasse|platz|allee|ring|damm|ufer|steig|markt)\s{1,2}\p{Nd}"
        r"|(?:Am|An der|An den|Im|In der|Zum|Zur|Auf der|Auf dem|Unter den|Hinter der)\s{1,2}[^\d,;:.!?<]+\s\p{Nd}"
        r"|(?:Calle|Avenida|Camino|Plaza|Paseo|Carretera|Ronda|Traves[^\s]{1,4}a)\s{1,2}[^\d;:.!?<]+\s\p{Nd}"
    ),
    "cue": rf"(?i:{_cue(_NAMING, True)}\s|{_cue(_TITLES, True)}[.,]?\s{{1,2}}[^\s]|{_cue(_ROLES, True)}[.,]?\s{{1,2}}[^\s]|{_cue(_CREDITS_BY, True)}\s{{1,2}}[b8]y\s|{_cue(_CREDITS, True)}[ \t]?:)",
    "listed": r"\p{L}\s{1,3}(?:\p{L}\.\s)?(?:(?:de|van|von|da|del|di|du)\s)?(?:Mc|MC|MAC|[OD]['’])?\p{Lu}",
}
GATED = (*TYPES[:4], "cue", "listed")


def gates(texts: pa.Array) -> dict[str, list[bool]]:
    """For each gate, which texts of a column may hold what it stands for."""
    return {k: pc.fill_null(pc.match_substring_regex(texts, _GATES[k]), False).to_pylist() for k in GATED}


def find_items(text: str, given: frozenset[str], may: dict[str, bool] | None = None) -> list[tuple[int, int, str]]:
    """(start, end, type) of the items of a text, in order and without overlaps; ``may`` as the gates say, all open without."""
    open_ = may.__getitem__ if may is not None else lambda _: True
    spans = []
    if open_("email"):
        spans += [(m.start(), m.end(), "email") for m in _EMAIL.finditer(text)]
    if open_("phone"):
        spans += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if _is_number(m[0], 7, 15)]
    if open_("id_number"):
        spans += [(m.start(), m.end(), "id_number") for m in _ID.finditer(text) if _is_number(m[0], 6, 9)]
    if open_("address"):
        spans += [(m.start(), m.end(), "address") for m in _ADDRESS.finditer(text)]
    if open_("cue"):
        spans += [(a, b, "name") for a, b in find_names(text, given)]
    elif open_("listed"):
        spans += [(a, b, "name") for a, b in listed_names(text, given)]
    out: list[tuple[int, int, str]] = []
    for a, b, kind in sorted(spans, key=lambda s: (s[0], -s[1], TYPES.index(s[2]))):
        if not out or a >= out[-1][1]:
            out.append((a, b, kind))
    return out


def _is_number(value: str, least: int, most: int) -> bool:
    digits = sum(c.isdigit() for c in value)
    if digits == 0:
        return bool(re.match(_WORD_DIGIT, value, re.I)) and least == 7
    return least - 3 <= digits <= most


# -- pseudonyms ---------------------------------------------------------------------------------
def _round(key: bytes, tweak: str, step: int, half: str, size: int) -> int:
    digest = hmac.new(key, f"{tweak}|{step}|{half}".encode(), hashlib.sha256).digest()
    return int.from_bytes(digest[:16], "big") % 10**size


def feistel(digits: str, key: bytes = KEY, tweak: str = "", back: bool = False) -> str:
    """A keyed permutation of the digit strings of one length (ten rounds, halves of unlike size allowed)."""
    if len(digits) < 2:
        shift = _round(key, tweak, 0, "", 1)
        return "".join(str((int(d) + (-shift if back else shift)) % 10) for d in digits)
    cut = len(digits) // 2
    a, b = digits[:cut], digits[cut:]
    # each round replaces one half; even rounds the left one, odd rounds the right one
    for step in reversed(range(10)) if back else range(10):
        sign = -1 if back else 1
        if step % 2 == 0:
            a = str((int(a) + sign * _round(key, tweak, step, b, len(a))) % 10 ** len(a)).zfill(len(a))
        else:
            b = str((int(b) + sign * _round(key, tweak, step, a, len(b))) % 10 ** len(b)).zfill(len(b))
    return a + b


_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_MIXED = str.maketrans("OolI", "0011")
#: Check letters of eight-digit numbers (a fixed value): the letter at the number modulo 23.
_CHECK_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
#: First and last birth date that is permuted, as days of the calendar.
_DAYS = (datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal())
_BIRTH = re.compile(
    r"(?P<cue>\b(?:born(?: on)?|date of birth|birth ?date|d\.?o\.?b\.?|geboren(?: am)?|geburtsdatum|n[ée]e? le|date de naissance|nacid[oa] el|fecha de nacimiento)[ \t]*:?[ \t]*)"
    r"(?P<date>(?P<a>\d{1,4})(?P<sep>[-/.])(?P<b>\d{1,2})(?P=sep)(?P<c>\d{2,4}))(?!\d)",
    re.I,
)


def number_of(value: str) -> str:
    """The digits of a phone or identity number, spelled or misread ones included."""
    if not any(c.isdigit() for c in value):
        return "".join(_WORDS.get(w, "") for w in re.findall(r"[a-z]+", value.lower()))
    return "".join(c for c in value.translate(_MIXED) if c.isdigit())


def permuted_number(kind: str, value: str, key: bytes) -> str:
    """The number within its format: signs, length and country code stay, a valid check letter stays valid."""
    digits = number_of(value)
    kept = 0
    if kind == "phone" and value.startswith("+"):
        kept = len(re.match(r"\+(\d{1,3})", value.translate(_MIXED))[1])
    out = digits[:kept] + feistel(digits[kept:], key, f"{kind}:{digits[:kept]}:{len(digits)}") if digits[kept:] else digits
    if not any(c.isdigit() for c in value):
        return out
    left = iter(out)
    form = "".join(next(left) if c.isdigit() else " " if c.isspace() else c for c in value.translate(_MIXED).replace("\r\n", "\n"))
    if kind == "id_number" and len(digits) == 8 and form[-1:].isalpha() and _CHECK_LETTERS[int(digits) % 23] == form[-1]:
        form = form[:-1] + _CHECK_LETTERS[int(out) % 23]
    return form


def permuted_day(day: int, key: bytes) -> int:
    """A keyed permutation of the days from the first to the last: Feistel over their numbers, walked until in range."""
    n = _DAYS[1] - _DAYS[0] + 1
    at = day - _DAYS[0]
    while True:
        at = int(feistel(str(at).zfill(len(str(n - 1))), key, "date"))
        if at < n:
            return at + _DAYS[0]


def birth_dates(text: str) -> list[tuple[int, int, str, datetime.date]]:
    """(start, end, form, date) of the dates behind a word of birth that are in the calendar: year first, else day first, else month first."""
    found = []
    for m in _BIRTH.finditer(text):
        a, b, c = m["a"], m["b"], m["c"]
        if len(a) == 4 and len(c) <= 2:
            tries = (("ymd", a, b, c),)
        elif len(c) == 4 and len(a) <= 2:
            tries = (("dmy", c, b, a), ("mdy", c, a, b))
        else:
            continue
        for form, year, month, day in tries:
            try:
                date = datetime.date(int(year), int(month), int(day))
            except ValueError:
                continue
            if _DAYS[0] <= date.toordinal() <= _DAYS[1]:
                found.append((m.start("date"), m.end("date"), form, date))
                break
    return found


def pseudonym(kind: str, value: str, key: bytes = KEY) -> str:
    """The placeholder of an item: equal for equal items, however they are broken or misread."""
    if kind in ("phone", "id_number"):
        return f"[{kind.upper()} {permuted_number(kind, value, key)}]"
    plain = " ".join(value.lower().split())
    if kind == "name" and "," in plain:
        family, given = (p.strip() for p in plain.split(",", 1))
        plain = f"{given} {family}"
    tag = base64.b32encode(hmac.new(key, f"{kind}|{plain}".encode(), hashlib.sha256).digest()[:16]).decode().rstrip("=").lower()
    return f"[{kind.upper()} {tag}]"


def dated(text: str, at: int, end: int, form: str, date: datetime.date, key: bytes = KEY) -> str:
    """A birth date permuted in the form it stands in, its signs and widths kept."""
    new = datetime.date.fromordinal(permuted_day(date.toordinal(), key))
    parts = {"y": new.year, "m": new.month, "d": new.day}
    stood = re.split(r"([-/.])", text[at:end])
    stood[::2] = [str(parts[f]).zfill(2 if len(s) == 2 else 1) for f, s in zip(form, stood[::2])]
    return f"[DATE {''.join(stood)}]"


def redact(text: str, given: frozenset[str], key: bytes = KEY, may: dict[str, bool] | None = None) -> str:
    items = [(a, b, pseudonym(kind, text[a:b], key)) for a, b, kind in find_items(text, given, may)]
    for a, b, form, date in birth_dates(text):
        if all(b <= x or a >= y for x, y, _ in items):
            items.append((a, b, dated(text, a, b, form, date, key)))
    out, at = [], 0
    for a, b, new in sorted(items):
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]])


# -- tables -------------------------------------------------------------------------------------
def pseudonym_key(spark: SparkSession) -> bytes:
    """The deployment's key from the session's settings."""
    return spark.conf.get(KEY_SETTING, KEY.decode()).encode()


def with_given(documents: DataFrame, given_names: DataFrame, most: int = GIVEN_NAMES) -> tuple[DataFrame, frozenset[str] | None]:
    """(doc_id, text, given) and the given names if they are few enough to go to every task.

    Else ``given`` holds, for each document, the listed names among its words, found by a join.
    """
    names = given_names.filter(F.col("given_name").isNotNull()).select("given_name").distinct()
    rows = documents.select("doc_id", "text")
    if names.count() <= most:
        return rows.withColumn("given", F.lit(None).cast("array<string>")), frozenset(fold(r[0]) for r in names.collect())
    folds = ("".join(_SAME[k] for k in _SAME), "".join(k * len(_SAME[k]) for k in _SAME))
    same = lambda c: F.translate(F.lower(c), *folds)
    words = rows.select("doc_id", F.explode(F.array_distinct(F.expr(r"regexp_extract_all(text, '[\\p{L}|0-9]+', 0)"))).alias("word")).select("doc_id", same(F.col("word")).alias("word"))
    listed = words.join(names.select(same(F.col("given_name")).alias("word")).distinct(), "word", "left_semi").groupBy("doc_id").agg(F.collect_set("word").alias("given"))
    return rows.join(listed, "doc_id", "left").withColumn("given", F.coalesce("given", F.array().cast("array<string>"))), None


def _each(given: frozenset[str] | None, result, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            may = gates(b.column(1))
            out = []
            for i, (doc, text, here) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())):
                out += result(doc, text, given if given is not None else frozenset(here), {k: v[i] for k, v in may.items()})
            kinds = [pa.int64()] + [pa.string()] * (len(columns) - 1)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=columns)

    return run


def personal_items(documents: DataFrame, given_names: DataFrame) -> DataFrame:
    """(doc_id, pii_type, pii_value): the distinct items of each document."""
    rows, given = with_given(documents.filter(F.length("text") > 0), given_names)

    def items(doc, text, names, may):
        return sorted({(doc, kind, text[a:e]) for a, e, kind in find_items(text, names, may)})

    found = spread(rows, "doc_id").mapInArrow(_each(given, items, ["doc_id", "pii_type", "pii_value"]), "doc_id long, pii_type string, pii_value string")
    return found.distinct()


def redacted(documents: DataFrame, given_names: DataFrame, key: bytes | None = None) -> DataFrame:
    """(doc_id, text) of every document with placeholders for its items; the key from the session's settings if none is given."""
    rows, given = with_given(documents, given_names)
    key = pseudonym_key(documents.sparkSession) if key is None else key

    def texts(doc, text, names, may):
        return [(doc, None if text is None else redact(text, names, key, may))]

    return spread(rows, "doc_id").mapInArrow(_each(given, texts, ["doc_id", "text"]), "doc_id long, text string")
