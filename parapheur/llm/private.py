"""Problem 4: private data in free text, found by form and context and replaced by keyed, type-consistent surrogates.

Detection works on a folded copy of the text (see ``folded``), so that full-width, invisible or look-alike characters hide
nothing; positions are those of the stored text. Every kind is a form (what it is made of) with a context that tells it from
orders, articles, amounts and services.

Replacement gives each piece a placeholder ``[KIND surrogate]``. Surrogates (see ``surrogates``) are derived from a secret key and the
entity's normal form, so all mentions of an entity, whatever their spelling, order, prefix or accents, get the same one; an initial
gets that of the full name it stands for in its text. They keep gender (listed given names), script, letter case and digit
grouping. Two entities never share one, by construction, so nothing about them is stored, joined or checked.

Defined results for odd input:
* null and empty texts hold nothing and come out as they are; texts of any length are read whole;
* overlapping finds are resolved in favour of the earlier, then the longer; repeated rows are replaced alike;
* a null row key is kept; an empty table gives an empty result; an empty secret is refused.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parapheur.llm.canonical import ODD, TO_LATIN
from parapheur.llm.scan import tolerant
from parapheur.llm.surrogates import Surrogates, bare

KINDS = ("email", "phone", "id_number", "address", "person")

_SPECIAL_RUN = re.compile(ODD.pattern + "+")


_LINE_CUT = re.compile(r"[-¬][ \t]*\n")
_CUT_WORD = re.compile(r"(?<=[^\W\d_])[-¬][ \t]*\n[ \t]*(?=[a-zà-öø-ÿ])|(?<=[A-ZÀ-Ý]{2})[-¬][ \t]*\n[ \t]*(?=[A-ZÀ-Ý]{2})")


class Cuts:
    """Positions in a text from which some pieces were cut out: index i of what is left stood at ``self[i]``."""

    def __init__(self, ends: list[int], shifts: list[int]):
        self.ends, self.shifts = ends, shifts

    def __getitem__(self, i: int) -> int:
        k = bisect.bisect_right(self.ends, i)
        return i + (self.shifts[k - 1] if k else 0)


def folded(text: str) -> tuple[str, list[int] | Cuts | None]:
    """The text with ordinary characters and whole words, and each character's position as stored (None: unchanged)."""
    place: list[int] | Cuts | None = None
    if not text.isascii() and ODD.search(text):
        text, place = _ordinary(text)
    cuts = [m.span() for m in _CUT_WORD.finditer(text)] if _LINE_CUT.search(text) else []
    if cuts:
        parts: list[str] = []
        ends: list[int] = []
        shifts: list[int] = []
        last = gone = 0
        for lo, hi in cuts:
            parts.append(text[last:lo])
            ends.append(lo - gone)
            gone += hi - lo
            shifts.append(gone)
            last = hi
        parts.append(text[last:])
        whole = Cuts(ends, shifts)
        new = "".join(parts)
        place = whole if place is None else [place[whole[i]] for i in range(len(new) + 1)]
        text = new
    return text, place




def _ordinary(text: str) -> tuple[str, list[int]]:
    parts: list[str] = []
    place: list[int] = []
    last = 0
    for m in _SPECIAL_RUN.finditer(text):
        parts.append(text[last : m.start()])
        place += range(last, m.start())
        for i in range(m.start(), m.end()):
            plain = _plain_character(text, i, parts)
            parts += plain
            place += [i] * len(plain)
        last = m.end()
    parts.append(text[last:])
    place += range(last, len(text) + 1)
    return "".join(parts), place


def _plain_character(text: str, i: int, before: list[str]) -> str:
    c = text[i]
    if c in TO_LATIN:
        return TO_LATIN[c]
    if c == "\r":
        return ""
    if c < "\u00a0":
        return c
    category = unicodedata.category(c)
    if category == "Cf":
        return "-" if c == "\u00ad" and text[i + 1 : i + 2] in ("", "\n") else ""
    if category == "Mn" and before and before[-1]:
        joined = unicodedata.normalize("NFC", before[-1][-1] + c)
        if len(joined) == 1:
            before[-1] = before[-1][:-1] + joined
            return ""
    if category == "Zs":
        return " "
    if c in "\u2010\u2011":
        return "-"
    if "\uff01" <= c <= "\uffee" or "\ufb00" <= c <= "\ufb06":
        return unicodedata.normalize("NFKC", c)
    return c


# Blanks between the parts of one piece; a line may break there, also after a hyphen that cuts a word.
_S = r"[ \t]*\n?[ \t]*"
_S1 = r"(?:[ \t]+\n?[ \t]*|\n[ \t]*)"

_AT = r"(?:" + _S + r"[\[(]" + _S + r"(?:at|arobase)" + _S + r"[\])]" + _S + r"|\n?@\n?)"
_DOT = r"(?:\n?\.\n?|" + _S + r"[\[(]" + _S + r"(?:dot|point)" + _S + r"[\])]" + _S + r"|" + _S1 + r"(?:point|dot)" + _S1 + r")"
# What follows the local part of an address, which is read backwards from the sign: no part has a length limit.
_DOMAIN = re.compile(_AT + r"[\w-]+(?:" + _DOT + r"[\w-]+)+(?<=[^\W\d_]{2})(?![\w@])", re.IGNORECASE)
_LOCAL = re.compile(r"[\w.+%-]")
_AT_SIGN = re.compile(r"@\n?\w[\w-]*\n?\.|[\[(]\s*(?:[aA][tT]|arobase|AROBASE)\s*[\])]")
_PHONE = re.compile(
    r"(?<![\w/+.,-])(?:"
    r"(?:\+|00)33[ .\n-]?(?:\(0\))?[ .\n-]?[1-9](?:[ .\n-]?\d){8}"
    r"|(?:\+|00)213[ .\n-]?(?:\(0\))?[ .\n-]?[1-9](?:[ .\n-]?\d){7,8}"
    r"|\+[1-9]\d{0,2}[ .\n-]?(?:\(\d{1,4}\)[ .\n-]?)?\d(?:[ .\n-]?\d){5,12}"
    r"|0[1-9](?:[ .\n-]?\d\d){4}"
    r"|\(0\d{2,3}\)[ .\n-]?\d\d(?:[ .\n-]?\d\d){2,3}"
    r")(?![\d/]|[.,-]\d)"
)
# A number in no form of its own, and the labels that say it is a phone number.
_LONG_NUMBER = re.compile(r"(?<![\w/+.,-])\d(?:[ .\n-]?\d){7,13}(?![\d/]|[.,-]\d)")
_PHONE_LABELS = frozenset("tél tel téléphone telephone mobile portable fax gsm".split())
_DIGITS = re.compile(r"[+(]?\d+")
_ID_LABEL = (
    r"(?:identifiant" + _S1 + r"national|num[ée]ro" + _S1 + r"d['’]" + _S + r"identification" + _S1 + r"nationale|identification" + _S1 + r"nationale|NIN|NIR|passeport|CNI|NSS|"
    r"(?:carte|pi[èe]ce)" + _S1 + r"(?:nationale" + _S1 + r")?d['’]" + _S + r"identit[ée]|s[ée]curit[ée]" + _S1 + r"sociale|assurance" + _S1 + r"sociale|SSN|social" + _S1 + r"security)"
)
_ID = re.compile(
    r"\b" + _ID_LABEL + r"(?:[\s:,]|sous|le|la|num[ée]ro|n[°ºo]\.?)*?\s*(?P<v>[A-Z]{2}[ \n]?\d{7}|\d(?:[ .\n-]?\d){7,})(?!\d)", re.IGNORECASE
)
_ID_CUES = ("identifi", "identit", "passeport", "sécurit", "securit", "assurance")
_ID_SHORT = ("nin", "nir", "cni", "nss", "ssn")
# A number in one of the forms of such numbers, whose label before it was misread.
_ID_FORM = re.compile(r"(?<![\w/+.,-])(?:\d{18}|\d{3}[ \n]\d{4}[ \n]\d{5}[ \n]\d{6}|\d{12}|\d\d[ \n]\d{4}[ \n]\d{4}[ \n]\d\d|\d{9}|\d{3}[ \n]\d{3}[ \n]\d{3}|\d{3}-\d\d-\d{4}|[A-Z]{2}[ \n]?\d{7})(?![\d/]|[.,-]\d)")
# A form that only identity numbers have.
_ID_ALONE = re.compile(r"\d{3}-\d\d-\d{4}")
_ID_FILLER = regex.compile(r"(?:[\s:,]|" + tolerant("sous") + r"|(?<!\S)(?:le|la)\b|" + tolerant("numéro") + r"|n[°ºo]\.?)+$", regex.IGNORECASE)
_ID_BEFORE = regex.compile(
    r"(?:identifiant national|identification nationale|passeport|carte d'identité|pièce d'identité|sécurité sociale|assurance sociale){e<=2}$", regex.IGNORECASE | regex.BESTMATCH
)
#: Words of the longest label before an identity number.
_LABEL_WORDS = 3
_STREET = (
    r"(?:rue|avenue|av\.|boulevard|bd\.?|boul\.|chemin|ch\.|impasse|imp\.|place|pl\.|all[ée]e|all\.|quai|route|rte\.?|cours|square|"
    r"passage|ruelle|sentier|esplanade|cit[ée]|r[ée]sidence|r[ée]s\.|lotissement|lot\.|villa|faubourg|fbg|traverse|mont[ée]e|voie|hameau|quartier)"
)
# The words of a street's name: five of any kind, as street names are also written in lower case, then as many as go on with a capital
# or a digit, with small words between.
_NAME_WORD = r"[^\s,;().]+"
_MORE_NAME = r"(?:(?:" + _S1 + r"(?:de|du|des|la|le|les|l['’]|d['’]|et|sur|en|aux))*" + _S1 + r"(?=(?-i:[A-ZÀ-Ý0-9]|[ld]['’][A-ZÀ-Ý]))" + _NAME_WORD + r")*"
_NUMBERED = re.compile(
    r"(?<![\w°/,.-])\d{1,4}(?:" + _S1 + r"(?:bis|ter|quater))?[ \t]*,?" + _S + _STREET + r"(?=[ \n])(?:" + _S1 + r"(?!au\b|puis\b|a\b|est\b)" + _NAME_WORD + r"){1,5}" + _MORE_NAME,
    re.IGNORECASE,
)
_UNNUMBERED = re.compile(
    r"(?<![\w°/,.-])(?=(?-i:[A-ZÀ-Ý]))" + _STREET + r"(?=[ \n])(?:" + _S1 + r"(?!n[°º])" + _NAME_WORD + r")+?" + _S + r",?" + _S + r"(?:n[°º]" + _S + r"\d{1,4}|B[âa]t(?:\.|iment)" + _S + r"\w+)", re.IGNORECASE
)
_ADDRESS_TAIL = re.compile(
    r"(?:" + _S + r",?" + _S + r"(?:B[âa]t(?:\.|iment)" + _S + r"\w+|n[°º]" + _S + r"\d{1,4}|[Aa]pp?t\.?" + _S + r"\d+|porte" + _S + r"\d+))*"
    r"(?:" + _S + r"(?:,|-|–)?" + _S + r"(?:\d{5}" + _S1 + r")?(?=[A-ZÀ-Ý])[\w'’]+(?:-" + _S + r"[\w'’]+)*)?"
)

_WORD = r"(?:[^\W\d_](?:[^\W\d_]|['’](?=\w)|[-¬][ \t]*\n?(?=[^\W\d_]))*)"
_UP = "[A-ZÀ-ÝΆ-ΏΑ-ΩЀ-Я]"
_GIVEN = r"(?:[A-ZÀ-Ý]" + _S + r"\.(?:-?[A-ZÀ-Ý]\.)?|(?=" + _UP + ")" + _WORD + r")"
_FULL = r"(?P<n>" + _GIVEN + _S1 + r"(?=" + _UP + ")" + _WORD + r"(?:[ ](?=" + _UP + ")" + _WORD + r")?)"
_TITLED = re.compile(
    r"(?<![\w'’])(?P<t>" + "|".join(map(tolerant, ("Monsieur", "Madame", "Mademoiselle", "Docteur", "Professeur"))) + r"|M\.|Mr\.?|" + tolerant("Mme") + r"\.?|" + tolerant("Mlle") + r"\.?|Dr\.?|Ma[îi]tre|Me|Pr\.?)" + _S1 + _FULL, re.MULTILINE
)
_CUED = re.compile(r"(?<![\w'’])(?:" + "|".join(map(tolerant, ("soussigné", "soussignée", "Joindre", "contacter", "nommé", "nommée"))) + r")" + _S1 + _FULL)
# What is done by a person or said of one, without a title.
_PAR = re.compile("par" + _S1 + _FULL)
_DONE = re.compile(
    r"(?:sign|repr[ée]sent|r[ée]dig|assist|accompagn|[ée]tabl|remplac|mandat|d[ée]sign|contresign|approuv|re[çc]u|visit|t[ée]l[ée]phon)(?:[ée]|i)?e?s?$", re.IGNORECASE
)
_NOUNS = ("interlocuteur", "interlocutrice", "bénéficiaire", "titulaire", "locataire", "employé", "salarié", "candidat", "patient", "témoin", "plaignant")
_CONTEXT = re.compile(r"(?<![\w'’])(?:interlocut(?:eur|rice)|b[ée]n[ée]ficiaire|titulaire|locataire|employ[ée]e?|salari[ée]e?|candidate?|patiente?|t[ée]moin|plaignante?)" + _S1 + _FULL)
_AND = re.compile(_S1 + "et" + _S1 + _FULL)
_ARABIC = re.compile(r"(?:السيدة|السيد|الآنسة|الدكتورة|الدكتور|الأستاذة|الأستاذ)[ \t]+(?P<n>[ء-ي]+(?:[ \t]+[ء-ي]+){1,2})")
# Common French and Maghrebi given names, women's then men's.
WOMEN = (
    "Aïcha Alice Amel Amina Amira Anne Asma Assia Aurélie Camille Caroline Catherine Céline Chantal Charlotte Chloé Christine Claire Claude Dalila Djamila Élise "
    "Émilie Emma Fadila Farida Fatiha Fatima Florence Françoise Hélène Houria Inès Isabelle Jeanne Julie Karima Khadija Lamia Laura Laure Leïla Léa Lila Louisa Louise "
    "Lucie Lydia Malika Manon Marie Marion Martine Maryam Mathilde Maud Meriem Monique Mounia Nabila Nadia Naïma Nathalie Nawel Nicole Noémie Nora Odile Ouarda Pauline "
    "Rachida Rania Sabrina Safia Salima Samia Samira Sandrine Sara Sarah Selma Sihem Sonia Sophie Souad Suzanne Sylvie Valérie Véronique Virginie Warda Yamina Yasmine "
    "Zahia Zahra Zineb Zohra"
).split()
MEN = (
    "Abdelkader Adel Adrien Ahmed Alain Alexandre Ali Amar Amine André Antoine Arnaud Arthur Aziz Benoît Bilal Brahim Bruno Charles Christophe Daniel David Denis Didier "
    "Djamel Éric Étienne Fabien Fabrice Farid Farouk Fouad François Frédéric Gabriel Georges Gérard Gilles Guillaume Guy Habib Hakim Hamid Hassan Henri Hicham Hocine "
    "Hugo Idir Ismaël Jacques Jean Jérôme Julien Kamel Karim Khaled Laurent Louis Lounès Luc Lucas Malek Marc Mathieu Maurice Maxime Mehdi Michel Mohamed Mourad Mustapha "
    "Nabil Nadir Nassim Nicolas Olivier Omar Pascal Patrick Paul Philippe Pierre Rachid Rafik Ramzi Réda Reda René Rémy Robert Salah Salim Samir Sébastien Serge Sid "
    "Sofiane Stéphane Tahar Tarek Thierry Thomas Vincent Walid Xavier Yacine Yanis Yves Younès Youcef Zakaria Ziad"
).split()
GIVEN_NAMES = frozenset(n.casefold() for n in WOMEN + MEN)
_ROLE = (
    r"(?:L[ea][ \t]+(?:Directeur|Directrice|Responsable|Secr[ée]taire|Chef|Cheffe|Pr[ée]sidente?|G[ée]rante?|D[ée]l[ée]gu[ée]e?|Adjointe?|Sous-Directeur|Sous-Directrice|"
    r"Ing[ée]nieure?|Comptable|Tr[ée]sorier|Tr[ée]sori[èe]re|Coordonnateur|Coordinatrice|Greffi[èe]r?e?|Inspecteur|Inspectrice)|P\.?/?O\.?)[^\n]*"
)
_OWN_LINE = _GIVEN + r"[ \t]+(?=[A-ZÀ-Ý])" + _WORD + r"(?:[ \t]+(?=[A-ZÀ-Ý])" + _WORD + r")?"
_SIGNED = re.compile(r"^[ \t]*" + _ROLE + r"\n+[ \t]*(?P<n>" + _OWN_LINE + r")[ \t]*(?=\n|$)", re.MULTILINE)
_ALONE = re.compile(r"^[ \t]*(?P<n>" + _OWN_LINE + r")[ \t]*$", re.MULTILINE)


def _known_name(name: str) -> bool:
    """Whether a line of two or three words is an initial with a surname, or holds a common given name."""
    words = name.split()
    if re.fullmatch(r"[A-ZÀ-Ý]\.(?:-?[A-ZÀ-Ý]\.)?", words[0]):
        return len(words) == 2
    return any(part.casefold() in GIVEN_NAMES for word in words for part in word.split("-"))


_NO_NAME = re.compile(
    r"^(?:Service|D[ée]partement|Direction|Bureau|Agence|Soci[ée]t[ée]|Office|Union|Groupe|Compagnie|Copie|Objet|R[ée]f|Alger|Page|Courriel|T[ée]l|Le|La|Les|Un|Une|Nous|Votre|Notre|Suite|Monsieur|Madame)\b",
    re.IGNORECASE,
)


class Piece(NamedTuple):
    kind: str
    start: int
    end: int
    text: str
    title: str


def _email(text: str, sign: int) -> tuple[int, int] | None:
    """Where the address around a sign begins and ends."""
    m = _DOMAIN.match(text, sign)
    if not m and text[sign : sign + 1] != "@":  # blanks may stand before a sign in brackets
        while sign and text[sign - 1] in " \t\n":
            sign -= 1
        m = _DOMAIN.match(text, sign)
    elif not m and sign and text[sign - 1] == "\n":
        sign -= 1
        m = _DOMAIN.match(text, sign)
    if not m:
        return None
    start = sign
    while start and text[start - 1] in " \t\n" and text[sign : sign + 1] not in "@":
        start -= 1
    end = start - 1 if start and text[start - 1] == "\n" else start
    start = end
    while start and (_LOCAL.match(text[start - 1]) or text[start - 1] == "\n" and start > 1 and text[start - 2] in "-.+_" and start < end):
        start -= 1
    while start < end and not text[start].isalnum():
        start += 1
    return (start, m.end()) if start < end else None


def _phone_label(text: str, at: int) -> bool:
    """Whether the word before a number says that it is a phone number."""
    end = at
    while end and text[end - 1] in " \t\n:.n°º":
        end -= 1
    start = end
    while start and text[start - 1].isalpha():
        start -= 1
    return text[start:end].lower() in _PHONE_LABELS


def _done_by(text: str, at: int) -> bool:
    """Whether the word before ``par`` says what a person does."""
    before = text[max(0, text.rfind("\n", 0, max(0, at - 1))) : at]
    return at > 0 and before[-1:].isspace() and bool(_DONE.search(before.rstrip()))


def _stands(low: str, cue: str) -> bool:
    """Whether a short cue stands as a word of its own."""
    i = low.find(cue)
    while i >= 0:
        if not (i and low[i - 1].isalnum()) and not low[i + len(cue) : i + len(cue) + 1].isalpha():
            return True
        i = low.find(cue, i + 1)
    return False


def _labelled(text: str, at: int) -> bool:
    """Whether the words before a number are the label of an identity number, with small words between."""
    words = 8
    while True:
        before = text[:at].rsplit(None, words)
        tail = " ".join(before[1:] if len(before) > words else before)
        filler = _ID_FILLER.search(tail)
        label = tail[: filler.start()] if filler else tail
        if len(label.split()) >= _LABEL_WORDS or len(before) <= words:
            return bool(_ID_BEFORE.search(" ".join(label.split()[-_LABEL_WORDS:]).replace("’", "'")))
        words *= 2  # nothing but small words so far


def _address_end(text: str, end: int) -> int:
    tail = _ADDRESS_TAIL.match(text, end)
    return tail.end() if tail else end


def find(text: str | None) -> list[Piece]:
    """The pieces of private data in a text, in order; start and end are positions in the text as stored."""
    if not text:
        return []
    plain, place = folded(text)
    low = plain.lower()
    found: list[tuple[int, int, str, str]] = []
    for sign in _AT_SIGN.finditer(plain):
        span = _email(plain, sign.start())
        if span:
            found.append((*span, "email", ""))
    if any(cue in low for cue in _ID_CUES) or any(_stands(low, cue) for cue in _ID_SHORT):
        found += [(m.start("v"), m.end("v"), "id_number", "") for m in _ID.finditer(plain)]
    strict = {f[0] for f in found}
    phones = ids = streets = 0  # up to where each kind was found
    for run in _DIGITS.finditer(plain):  # every number is a place where one of these may begin
        at = run.start() + (not run[0][0].isdigit())
        if run.start() >= phones:
            m = _PHONE.match(plain, run.start()) or _PHONE.match(plain, at) or (_LONG_NUMBER.match(plain, at) if _phone_label(plain, at) else None)
            if m:
                found.append((m.start(), m.end(), "phone", ""))
                phones = m.end()
        if at >= ids:
            m = _ID_FORM.match(plain, at) or _ID_FORM.match(plain, max(0, at - 2)) or _ID_FORM.match(plain, max(0, at - 3))
            if m:
                ids = m.end()
                if m.start() not in strict and (_ID_ALONE.fullmatch(m[0]) or _labelled(plain, m.start())):
                    found.append((m.start(), m.end(), "id_number", ""))
        if at >= streets:
            m = _NUMBERED.match(plain, at)
            if m:
                found.append((at, _address_end(plain, m.end()), "address", ""))
                streets = m.end()
    if "n°" in low or "nº" in low or "bât" in low or "bat" in low:
        found += [(m.start(), _address_end(plain, m.end()), "address", "") for m in _UNNUMBERED.finditer(plain)]
    people = [(m.start("n"), m.end("n"), "person", m["t"]) for m in _TITLED.finditer(plain) if not _NO_NAME.match(m["n"])]
    people += [(m.start("n"), m.end("n"), "person", "") for m in _CUED.finditer(plain) if not _NO_NAME.match(m["n"])]
    people += [(m.start("n"), m.end("n"), "person", "") for m in _PAR.finditer(plain) if not _NO_NAME.match(m["n"]) and _done_by(plain, m.start())]
    if any(noun in low for noun in _NOUNS):
        people += [(m.start("n"), m.end("n"), "person", "") for m in _CONTEXT.finditer(plain) if not _NO_NAME.match(m["n"])]
    for m in _SIGNED.finditer(plain):
        if not _NO_NAME.match(m["n"]) and (len(m["n"].split()) == 2 or _known_name(m["n"])):  # "M." before two names is a title
            people.append((m.start("n"), m.end("n"), "person", ""))
    people += [(m.start("n"), m.end("n"), "person", "") for m in _ALONE.finditer(plain) if _known_name(m["n"]) and not _NO_NAME.match(m["n"])]
    if "ال" in plain:
        people += [(m.start("n"), m.end("n"), "person", "") for m in _ARABIC.finditer(plain)]
    for person in people:  # grows: a name joined to one found is one too
        m = _AND.match(plain, person[1])
        if m and not _NO_NAME.match(m["n"]):
            people.append((m.start("n"), m.end("n"), "person", ""))
    found += people
    found.sort(key=lambda f: (f[0], -f[1]))
    out: list[Piece] = []
    last = 0
    for start, end, kind, title in found:
        if start < last:
            continue
        last = end
        a, b = (start, end) if place is None else (place[start], place[end - 1] + 1)
        out.append(Piece(kind, a, b, plain[start:end], title))
    return out


def pieces(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, start_pos, end_pos, found, title) of every piece; one scan, no shuffle."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            rows: list[Piece] = []
            for i, value in enumerate(batch.column(1).to_pylist()):
                got = find(value)
                rows += got
                at += [i] * len(got)
            if rows:
                kinds, starts, ends, found, titles = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())), pa.array(kinds), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(found), pa.array(titles)],
                    names=["_key", "kind", "start_pos", "end_pos", "found", "title"],
                )

    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where("_text <> ''")
    return rows.mapInArrow(run, f"_key {kind}, kind STRING, start_pos INT, end_pos INT, found STRING, title STRING").withColumnRenamed("_key", key)


def normal_form(kind: str, found: str) -> str:
    """What all mentions of one entity have in common."""
    plain = bare(found)
    if kind == "email":
        plain = re.sub(r"\s*[\[(]\s*(?:at|arobase)\s*[\])]\s*", "@", plain)
        plain = re.sub(r"\s*[\[(]\s*(?:dot|point)\s*[\])]\s*|\s+(?:point|dot)\s+", ".", plain)
        return re.sub(r"\s", "", plain)
    if kind == "phone":
        digits = re.sub(r"\D", "", re.sub(r"\(0\)", "", plain))
        return "0" + digits[-9:] if len(digits) > 10 else digits
    if kind == "id_number":
        return re.sub(r"[^a-z0-9]", "", plain)
    words = re.findall(r"[^\W_]+", plain)
    return " ".join(sorted(words) if kind == "person" else words)


_WOMEN_SET = frozenset(n.casefold() for n in WOMEN)
_MEN_SET = frozenset(n.casefold() for n in MEN)


def _in_script(stored: str, plain: str) -> str:
    """A piece as stored if it is wholly in another script, else with ordinary letters."""
    letters = [c for c in stored if c.isalpha()]
    return stored if letters and all(unicodedata.name(c, "").split(" ")[0] in ("GREEK", "CYRILLIC", "ARABIC") for c in letters) and len({unicodedata.name(c).split(" ")[0] for c in letters}) == 1 and plain != stored and any(c not in TO_LATIN for c in letters) else plain


def replaced(text: str | None, maker: Surrogates) -> tuple[str | None, int]:
    """A text with ``[KIND surrogate]`` in place of each piece, and how many there were."""
    found = find(text)
    people = [p.text for p in found if p.kind == "person"]
    out, last = [], 0
    for p in found:
        plain = _in_script(text[p.start : p.end], p.text)
        out += [text[last : p.start], f"[{p.kind.upper()} {maker.of(p.kind, plain, normal_form(p.kind, plain), people)}]"]
        last = p.end
    return ("".join(out) + text[last:] if found else text), len(found)


def pseudonymised(df: DataFrame, key: str, text: str, secret: str) -> DataFrame:
    """(key, safe_text, n_replaced): every text with its pieces replaced and all else unchanged; one scan, no shuffle.

    The same secret gives the same surrogates in every table.
    """
    Surrogates(secret, (WOMEN, MEN))  # an empty secret is refused here, not in a task
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Surrogates(secret, (WOMEN, MEN))
        for batch in batches:
            done = [replaced(t, maker) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int32())], names=["_id", "safe_text", "n_replaced"])

    return df.select(F.col(key).alias("_id"), F.col(text).alias("_text")).mapInArrow(run, f"_id {kind}, safe_text STRING, n_replaced INT").withColumnRenamed("_id", key)
