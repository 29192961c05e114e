"""Text clean-up, line arrays and line predicates as Column expressions; nothing here leaves the JVM.

Patterns carry (?iuU) so that case, word characters, blanks and word ends are Unicode-aware. A null text stays null, an empty one
gives one empty line; line order is that of the page and is never lost, so no sort is needed anywhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that decide which texts the field rules match. They must equal what users of the extractor rely on.
REF_CODE = r"[A-Z]{2,}(?:[/-][A-Z0-9]{2,})*(?:[/-]N[°º]\s*\d*[/-]\d{4}|[/-]N[°º]\s*\d+|[/-]\d{4}[/-]\d+|[/-]\d{4})"
DATE = r"\d{2}[/\-]\d{2}[/\-]\d{4}"
BODY_START = (
    r"(?:^|\n)(?:Monsieur\s*[;:,]|Faisant\s+suite|Dans\s+le\s+cadre|Suite\s+à|J['’]ai\s+l['’]honneur|Je\s+vous\s+prie|"
    r"Nous\s+avons\s+l['’]honneur|Conform[eé]ment|Suite\s+aux|Nous\s+avons\s+constat[eé]|Nous\s+vous\s+sollicitons|"
    r"Nous\s+vous\s+informons|Nous\s+vous\s+transmettons|Le\s+D[eé]partement|Nous\s+avons\s+proc[eé]d[eé]|Nous\s+vous\s+adressons)\s*\n?"
)
BODY_END = (
    r"(?:Veuillez\s+agréer|Veuillez\s+recevoir|Veuillez\s+trouver|Recevez|Je\s+vous\s+prie\s+d['’]agréer|Dans\s+l.attente|Comptant\s+sur|"
    r"En\s+vous\s+remerciant|Copie\s+[aà]\s*:|Direction\s+G[eé]n[eé]rale\s*,\s*Service|Direction\s+des\s+Op[eé]rations\s*$|D[eé]partement\s+Risques\s*,)"
)
ARTEFACT = r"(?:\++|%+|N8X|oloX|米)"
ARABIC = r"[؀-ۿ]"
URL = r"(?:www\.|http|\.dz|\.com|\.org)"
SYMBOLS_FIRST = r"^[^A-Za-zÀ-ÿ]{0,3}[^A-Za-zÀ-ÿ\s]{3,}"
FOOTER = r"(?:Quartier|Tél\s*:|Bab\s+Ezzouar|BP\s*\d)"
KEYWORD = r"(?:Alger|REF|Réf|Objet|P\.J|Copie|www\.|http)"
SUBTYPES = (
    ("demande", r"\bdemande\b|\bdemander\b|\bsollicite\b|\bprie\b|\bveuille[zs]\b|\bprière\b"),
    ("transmission", r"\btransmet[s]?\b|\bci[- ]joint\b|\bci[- ]après\b|\bvous\s+adresse\b|\bfaire\s+parvenir\b"),
    ("information", r"\bporte[r]?\s+à\s+(votre\s+)?connaissance\b|\binform\w+\b|\bnotif\w+\b|\bsignale[r]?\b"),
)
# Labels that recognition gets wrong at the start of a line, in the order the repairs are applied.
LABEL_REPAIRS = {
    "compat": (
        (r"^\s*R[EF]{1,2}\s*[:\-]?\s*", "REF: "),
        (r"^\s*R[ée]f\s*[:\-]?\s*", "Réf : "),
        (r"^\s*Obje[tl1]\s*[:\-]?\s*", "Objet : "),
        (r"^\s*P[\.\s]*[Jj1][\.\s]*[:\-]?\s*", "P.J : "),
    ),
    "strict": (
        (r"^\s*R[EF]{1,2}(?!\w)\s*[:\-]?\s*", "REF: "),
        (r"^\s*R[ée]f(?!\w)\s*[:\-]?\s*", "Réf : "),
        (r"^\s*Obje[tl1](?!\w)\s*[:\-]?\s*", "Objet : "),
        (r"^\s*P[\.\s]*[Jj1](?!\w)[\.\s]*[:\-]?\s*", "P.J : "),
    ),
}

I = "(?iuU)"
U = "(?uU)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it.

    Columns are trees: without this, rules built on rules double in size at every level.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def matches(column: Column, pattern: str, flags: str = I) -> Column:
    return column.rlike(flags + pattern)


def starts(column: Column, pattern: str, flags: str = I) -> Column:
    """Whether the pattern matches at the very start, whatever lines follow."""
    return column.rlike(flags + r"\A(?:" + pattern + ")")


def first_group(column: Column, pattern: str, group: int = 1, flags: str = I) -> Column:
    """A group of the first match; null where nothing matches or the group is empty."""
    return let(F.regexp_extract(column, flags + pattern, group), non_empty)


def strip(column: Column) -> Column:
    """Trim of all white space, not only blanks."""
    return F.regexp_replace(column, U + r"\A\s+|\s+\z", "")


def squeeze(column: Column) -> Column:
    return F.regexp_replace(strip(column), U + r"\s+", " ")


def non_empty(column: Column) -> Column:
    """The column, null where it is empty; to be used on plain columns or within ``let``."""
    return F.when(column != "", column)


def words(column: Column) -> Column:
    """Words between white space; an empty text has none."""
    return F.filter(F.split(column, U + r"\s+"), lambda w: w != "")


def word_count(column: Column) -> Column:
    return F.size(words(column))


def to_int(column: Column) -> Column:
    """A number in ASCII or full-width digits; null for anything else."""
    return F.translate(column, "０１２３４５６７８９", "0123456789").try_cast("int")


def strip_html(column: Column) -> Column:
    return F.regexp_replace(column, "<[^>]+>", "")


def norm(column: Column) -> Column:
    """Lower case, single blanks: the form in which values are compared."""
    return squeeze(F.lower(column))


def ref_norm(column: Column) -> Column:
    """A normalised reference with every run of dashes and blanks as a slash."""
    return F.regexp_replace(F.regexp_replace(norm(column), U + r"[-\s]+", "/"), r"\A/+|/+\z", "")


def repair_label(line: Column, mode: str = "compat") -> Column:
    out = F.regexp_replace(strip(F.translate(line, "’", "'")), "[|¦]+", ":")
    for pattern, label in LABEL_REPAIRS[mode]:
        out = F.regexp_replace(out, I + pattern, label)
    return F.regexp_replace(out, U + r"\s{2,}", " ")


def normalised_lines(text: Column, mode: str = "compat") -> Column:
    """The lines of a page with their labels repaired; split at line feeds only, blank lines kept."""
    return F.transform(F.split(text, "\n", -1), lambda line: repair_label(line, mode))


# Sequences of lines ------------------------------------------------------------------------------------------------


def head(lines: Column, n: int) -> Column:
    return F.slice(lines, 1, n)


def filled(lines: Column) -> Column:
    """Stripped lines without the blank ones."""
    return F.filter(F.transform(lines, strip), lambda line: line != "")


def first_where(lines: Column, predicate: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(lines, predicate), F.lit(0))


def index_where(lines: Column, predicate: Callable[[Column], Column]) -> Column:
    """0-based place of the first line that fulfils the predicate, else null."""
    place = F.array_position(F.transform(lines, lambda line: F.coalesce(predicate(line), F.lit(False))), F.lit(True))
    return let(place, lambda at: F.when(at > 0, (at - 1).cast("int")))


def until(lines: Column, stop: Callable[[Column], Column]) -> Column:
    """The lines before the first that fulfils ``stop``."""
    return let(lines, lambda all_: let(index_where(all_, stop), lambda at: F.when(at.isNull(), all_).otherwise(F.slice(all_, F.lit(1), F.coalesce(at, F.lit(0))))))


def after(lines: Column, place: Column, n: int) -> Column:
    """Up to ``n`` lines after a 0-based place; empty where the place is null."""
    return F.when(place.isNotNull(), F.slice(lines, F.coalesce(place, F.lit(0)) + 2, F.lit(n))).otherwise(F.array().cast("array<string>"))


def join_lines(lines: Column, separator: str = "\n") -> Column:
    return F.array_join(lines, separator)


# Predicates of lines -----------------------------------------------------------------------------------------------


def alpha_ratio(line: Column) -> Column:
    return F.length(F.regexp_replace(line, r"[^\p{L}]", "")) / F.greatest(F.length(line), F.lit(1))


def is_noise(line: Column) -> Column:
    """Decoration, foreign script, addresses of sites, footers and lines with few letters; an empty line is noise too."""
    return (
        line.rlike(ARTEFACT)
        | line.rlike(ARABIC)
        | matches(line, URL)
        | line.rlike(U + SYMBOLS_FIRST)
        | matches(line, FOOTER)
        | (alpha_ratio(line) < 0.4)
        | (F.length(line) < 3)
    )


def is_reference(line: Column) -> Column:
    return line.rlike(U + REF_CODE) | matches(line, r"\A/?REF\s*:?$")


def is_keyword(line: Column) -> Column:
    return starts(line, KEYWORD)


def document_subtype(text: Column) -> Column:
    """What kind of letter a text is; the first kind with a cue wins."""
    out = F.when(F.lit(False), F.lit(""))
    for name, cues in SUBTYPES:
        out = out.when(F.lower(text).rlike(U + cues), F.lit(name))
    return out.otherwise(F.when(text.isNotNull(), F.lit("autre")))
