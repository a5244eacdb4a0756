"""What the comments of a file say of its making: by a generator, or in a foreign project.

A notice is judged by its parts and not by its wording. Of a generator speak a participle of making
with its agent, and beside it the agent's version, a tool noun or an order to leave the file alone.
Of a foreign project speak a word of origin in a sentence that does not take it back, a component
with a version, and beside them a word of maintenance elsewhere or a second word of origin. The words
are given for several languages; accents, case, comment signs and line breaks are folded away first.

Defined cases: null and empty comments say nothing; a participle before a noun ("the generated
headers are read") or behind a negation names no maker; copies that were dropped, replaced or
written anew are none.
"""

from __future__ import annotations

import re
import unicodedata

_EDGE = re.compile(r"^[ \t]*(?:/\*+|\*+/|\*+|//+|#+|<!--|--+>?|;+|\"\"\"|''')?[ \t]*|[ \t]*(?:\*/|-->)?[ \t]*$", re.M)
_SENTENCE = re.compile(r"[.!?;](?:\s+|\Z)|\n\s*\n")

# Words of making, of the agent, of leaving alone, of origin and of maintenance, by language (en, de, fr, es, it, pt, nl).
_MADE = (
    "generated produced created emitted made compiled built written output "
    "erzeugt generiert erstellt ausgegeben genere generee produit produite cree creee "
    "generado generada producido creado generato generata prodotto creato gerado gerada produzido criado gegenereerd aangemaakt gemaakt"
)
_AGENT = "by from with using via durch von vom aus mit par depuis avec por con desde da dal dalla pelo pela door uit met"
_TOOL = "compiler generator tool translator transpiler preprocessor script schema grammar template definition werkzeug uebersetzer compilateur generateur outil generador compilador herramienta generatore compilatore strumento gerador"
_NOT = "not n't never no nicht nie kein keine keinesfalls ne pas jamais nunca non mai nao niet nooit without ohne sans sin"
_EDIT = (
    "edit modify change alter touch patch hand-edit andern aendern bearbeiten verandern veraendern editieren modifier editer changer toucher "
    "modificar editar cambiar tocar modificare cambiare alterar mexer wijzigen bewerken aanpassen"
)
_ORIGIN = (
    "upstream third-party 3rd-party thirdparty vendored bundled embedded imported copied mirrored forked snapshot mirror distribution verbatim borrowed "
    "drittanbieter fremdbibliothek fremdkomponente uebernommen ubernommen kopiert tiers tierce importe copie terceros importado copiado terzi importato copiato overgenomen gekopieerd"
)
_ELSEWHERE = (
    r"\b(?:fixes|changes|bugs|patches|issues|reports|corrections)\b.{0,30}\b(?:upstream|there|project|authors|maintainers)\b|\bupstream\b.{0,40}\b(?:fix|fixes|changes|bugs|patches|issues)\b"
    r"|\b(?:not|nicht|pas|no|non|niet) (?:being )?(?:maintained|supported|developed|gepflegt|maintenu|mantenido|mantenuto|onderhouden)\b|\b(?:maintained|developed|gepflegt|maintenu) (?:elsewhere|upstream|separately|outside|woanders|ailleurs)\b"
    r"|\b(?:its|their|the) own (?:project|repository|tree|site)\b|\b(?:kept in|in) sync\b|\b(?:re)?sync(?:ed|hroni[sz]ed)? (?:from|with)\b|\blocal(?:ly)? (?:copy|mirror|changes|modified)\b|\b(?:lokale kopie|copie locale|copia local|copia locale)\b"
)


def _any(words: str) -> str:
    return "(?:" + "|".join(re.escape(w) for w in words.split()) + ")"


_VERSION = r"\(?v?\d+(?:[.\-_]\d+)+[a-z]?\d*\)?"
_MADE_BY = re.compile(rf"(?<![\w-])(?P<made>{_any(_MADE)}) (?:\w+ly )?(?P<agent>{_any(_AGENT)}) (?P<maker>(?:\S+ ){{0,5}}?)(?P<sign>{_VERSION}(?!\w)|{_any(_TOOL)}(?!\w)|\S+\.[a-z]\w{{0,8}}(?!\w))")
_MADE_ONLY = re.compile(rf"(?<![\w-]){_any(_MADE)} (?:\w+ly )?{_any(_AGENT)} \S")
_TAKEN_BACK = re.compile(rf"(?<![\w'])(?:{_any(_NOT)}|instead of|rather than|statt)(?!\w)[^,:;]{{0,24}}$")
_HANDS_OFF = re.compile(rf"(?:(?<![\w])(?:{_any(_NOT)}|do n't)(?!\w)(?: \S+){{0,4}}? {_any(_EDIT)}|\bhands off)(?!\w)(?! (?:the|die|das|den|les?|la|el|los|las|il|de|het) )")
_COMPONENT = re.compile(rf"(?<![\w.])[a-z][\w+-]*[,:]?(?: (?:at|in|of|the|version|release|tag|rev|revision|stand|fassung))*[,:]? {_VERSION}(?![\w])")
_ORIGIN_WORD = re.compile(rf"(?<![\w-]){_any(_ORIGIN)}(?![\w-])")
_AWAY = re.compile(_ELSEWHERE)
_DROPPED = re.compile(
    r"\b(?:dropped|removed|deleted|replaced|rewritten|anew|gone|no longer|used to|once|own implementation|instead|entfernt|ersetzt|neu geschrieben|supprim\w*|remplac\w*|eliminad\w*|sustituid\w*)\b"
    rf"|(?<![\w]){_any(_NOT)} (?:an? |the )?(?:\S+ )?{_any(_ORIGIN)}"
)


def folded(comment: str | None) -> str:
    """The comment in lower case, without accents, comment signs and line breaks within a paragraph."""
    if not comment:
        return ""
    plain = unicodedata.normalize("NFKD", _EDGE.sub("", comment).lower().replace("ß", "ss"))
    plain = "".join(c for c in plain if not unicodedata.combining(c)).replace("don't", "do not").replace("’", "'")
    return re.sub(r"\n\s*\n", "\n\n", re.sub(r"[ \t]+", " ", re.sub(r"(?<!\n)\n(?!\n)", " ", plain)))


def sentences(text: str) -> list[str]:
    return [s.strip() for s in _SENTENCE.split(text) if s and s.strip()]


def speaks_of_generator(comment: str | None) -> bool:
    text = folded(comment)
    parts = sentences(text)
    for i, s in enumerate(parts):
        for m in _MADE_ONLY.finditer(s):
            if _TAKEN_BACK.search(s[: m.start()]):
                continue
            if _MADE_BY.match(s, m.start()) and re.search(_VERSION, s[m.start() :]):
                return True
            if any(_HANDS_OFF.search(x) for x in parts[i : i + 2]) and not re.search(rf"\b{_any('hand hands me us ourselves human humans people')}\b", s[m.start() : m.end() + 20]):
                return True
    return False


def speaks_of_foreign_project(comment: str | None) -> bool:
    text = folded(comment)
    kept = [s for s in sentences(text) if not _DROPPED.search(s)]
    origins = {w for s in kept for w in _ORIGIN_WORD.findall(s)}
    if not origins:
        return False
    said = ". ".join(kept)
    return bool(_COMPONENT.search(said)) and (bool(_AWAY.search(said)) or len(origins) > 1)
