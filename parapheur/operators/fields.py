"""Key fields of a letter by competing strategies, scored and ranked declaratively.

A page's lines are normalised once into array columns; every rule is a Column expression on them, so nothing is shuffled and
nothing but the fuzzy score leaves the JVM. Candidates come out in long form: one row a page, field and strategy.

Defined results: a null text gives no candidates, an empty one neither; ties of score go to the higher strategy score, then the
longer value, then the earlier strategy; repeated pages give repeated rows; extra columns are carried along untouched.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parapheur.functions import text as t
from parapheur.functions.fuzzy import Label, best_label_lines
from parapheur.functions.metrics import normalised_confidence
from parapheur.session import spread


class Page(NamedTuple):
    """The columns the rules read: the normalised text, its stripped lines, and those of them that are not blank."""

    text: Column
    lines: Column
    filled: Column


def page_columns() -> Page:
    return Page(F.col("_text"), F.col("_lines"), F.col("_filled"))


def with_page_columns(df: DataFrame, text: str, mode: str = "compat") -> DataFrame:
    """Adds the columns of ``Page``; the text is freed of tags first."""
    df = df.withColumn("_norm", t.normalised_lines(t.strip_html(F.col(text)), mode))
    return df.withColumn("_text", F.array_join("_norm", "\n")).withColumn("_lines", F.transform("_norm", t.strip)).withColumn("_filled", F.filter("_lines", lambda x: x != "")).drop("_norm")


# What starts a new part of a letter, as the block rules see it.
_BLOCK = r"(?:Objet|Réf|P\.J|Alger|REF)"
_OBJECT_STOP = (
    r"(?:P\.J|Réf|REF|Alger|Monsieur|Messieurs?|Mesdames?|Dans\s+le\s+cadre|Faisant\s+suite|Suite\s+[aà]|J['’]ai\s+l['’]honneur|Nous\s+vous|"
    r"Le\s+D[eé]partement|Nous\s+avons|Conform[eé]ment|Suite\s+aux)"
)
_BODY_CUE = r"(?:Dans\s+le\s+cadre|Faisant\s+suite|Suite\s+[aà])"
_HEAD_CUE = r"(?:REF|Réf|Alger|De\s*:|[AÀ]\s*(?:l['’]attention|:)|P\.J|Copie\s+[aà]\s*:)"
_ADDRESSEE = r"(?:A|À)\s*(?:l['’]attention\s+(?:de|du|des)|:)"
_COUNTED = r"(?:pi[eè]ces?|dossiers?|documents?|fichiers?)"
_NUMBER = r"(\d{1,2}|un|une|deux|trois|quatre)"
_NUMBERS = {"un": 1, "une": 1, "deux": 2, "trois": 3, "quatre": 4}


def _labelled(lines: Column, label: str, good: Callable[[Column], Column]) -> Column:
    """Value behind a label at the start of a line, from the first line whose value is good."""
    values = F.transform(lines, lambda line: t.strip(t.first_group(line, rf"\A{label}([^\n]+)")))
    return t.first_where(values, lambda v: v.isNotNull() & (v != "") & good(v))


def _next_line(lines: Column, place: Column) -> Column:
    return F.get(lines, place + 1)


def _fuzzy_value(lines: Column, best: Column, at_least: float, label: str) -> Column:
    """Behind the colon or the label of the most similar line; the next line where nothing stands there."""

    def own(line: Column) -> Column:
        colon = F.instr(line, ":")
        bare = F.when(colon > 0, F.substring(line, colon + 1, F.length(line))).when(t.starts(line, label), F.regexp_replace(line, t.I + r"\A(?:" + label + ")", ""))
        return t.let(t.strip(bare), t.non_empty)

    value = F.coalesce(t.let(F.get(lines, best["idx"]), own), t.let(_next_line(lines, best["idx"]), t.non_empty))
    return F.when(best["idx"].isNotNull() & (best["score"] >= at_least), value)


# Sender --------------------------------------------------------------------------------------------------------------


def sender_regex(p: Page) -> Column:
    return _labelled(t.head(p.filled, 12), r"(?:De|Source|Exp[eé]diteur)\s*:\s*", lambda v: ~t.is_noise(v))


def sender_heuristic(p: Page) -> Column:
    office = r"\b(?:Service|Département|Direction)\b"
    labelled = _labelled(t.head(p.filled, 12), r"De\s*:\s*", lambda v: ~t.is_noise(v) & ~t.is_reference(v))
    top = t.first_where(t.until(t.head(p.filled, 8), lambda x: t.is_reference(x) | t.is_keyword(x)), lambda x: ~t.is_noise(x))
    anywhere = t.first_where(t.head(p.filled, 14), lambda x: ~t.is_noise(x) & ~t.is_reference(x) & t.matches(x, office))
    return F.coalesce(labelled, top, anywhere)


# Receiver ------------------------------------------------------------------------------------------------------------


def _tidy_receiver(value: Column) -> Column:
    bare = F.regexp_replace(t.strip(value), t.U + r"\A[\W_]+", "")
    return t.strip(F.regexp_replace(bare, t.I + r"\AA\s*:\s*", "À: "))


def _can_receive(value: Column) -> Column:
    blocked = t.is_noise(value) | t.is_reference(value) | t.is_keyword(value) | t.matches(value, t.URL) | t.matches(value, t.FOOTER)
    return value.isNotNull() & (F.length(value) > 5) & ~blocked


def receiver_regex(p: Page) -> Column:
    return _labelled(t.head(p.filled, 15), _ADDRESSEE + r"\s*", lambda v: ~t.is_noise(v))


def _receiver_below_sender(p: Page) -> Column:
    sender_at = t.index_where(t.head(p.lines, 15), lambda x: t.starts(x, r"De\s*:"))
    below = t.let(sender_at, lambda at: t.first_where(t.after(p.lines, at, 5), lambda x: _can_receive(x) & (t.alpha_ratio(x) > 0.5)))
    return _tidy_receiver(below)


def _titled_receiver(lines: Column, at: Column) -> Column:
    follow = t.until(t.after(lines, at, 3), lambda x: (x == "") | t.starts(x, _BLOCK) | ~_can_receive(x))
    merged = t.join_lines(F.concat(F.array(F.get(lines, at)), follow))
    return t.let(merged, lambda m: F.when(_can_receive(m), _tidy_receiver(m)))


def receiver_heuristic(p: Page) -> Column:
    """Below the sender; else by an address line, else by a title, else the second clean line. A kind that is present decides alone."""
    named = r"(?m)^\s*[AÀ]\s*(?:l['’]attention\s+(?:de|du|des)|:)\s*([^\n]+?)\s*$"
    addressed = lambda whole: t.let(_tidy_receiver(F.regexp_extract(whole, t.I + named, 1)), lambda x: F.when(_can_receive(x), x))
    title = t.index_where(p.lines, lambda x: t.starts(x, r"(?:Messieurs?|Mesdames?|Monsieur)\s+(?:le|les|la|l['’])\s+"))
    clean = F.filter(t.until(t.head(p.lines, 12), lambda x: t.is_reference(x) | t.is_keyword(x)), lambda x: ~t.is_noise(x))
    second = t.let(_tidy_receiver(F.get(clean, F.lit(1))), lambda x: F.when(_can_receive(x), x))
    by_title = t.let(title, lambda at: F.when(at.isNotNull(), _titled_receiver(p.lines, at)).otherwise(second))
    by_address = t.let(F.array_join(p.lines, "\n"), lambda whole: F.when(t.matches(whole, named), addressed(whole)).otherwise(by_title))
    return F.coalesce(_receiver_below_sender(p), by_address)


# Reference -----------------------------------------------------------------------------------------------------------


def _code_in(line: Column) -> Column:
    return t.squeeze(F.regexp_substr(line, F.lit(t.U + t.REF_CODE)))


def reference_in_body(p: Page) -> Column:
    return t.strip(t.first_group(p.text, r"(?:Réf|REF)\s*:\s*(" + t.REF_CODE + r"(?:\s+du\s+[\d/]+)?)"))


def reference_regex(p: Page) -> Column:
    labelled = t.head(F.split(p.text, "\n", -1), 25)
    values = F.transform(labelled, lambda x: F.when(t.starts(x, r"(?:Réf|REF)\s*:"), t.strip(F.regexp_replace(x, t.I + r"\A(?:Réf|REF)\s*:\s*", ""))))
    return F.coalesce(reference_in_body(p), t.first_where(values, lambda v: v.isNotNull() & (v != "")))


def reference_heuristic(p: Page) -> Column:
    top = t.head(p.lines, 25)
    this, following = F.slice(top, F.lit(1), F.greatest(F.size(top) - 1, F.lit(0))), F.slice(top, 2, 25)
    not_labelled = lambda x: ~t.starts(x, r"Réf\s*:")
    found = lambda codes: t.first_where(codes, lambda c: c.isNotNull())
    below = found(F.zip_with(this, following, lambda a, b: F.when(t.matches(a, r"\AREF\s*:?\s*$"), _code_in(b))))
    same = found(F.transform(top, lambda x: t.squeeze(t.first_group(x, r"REF\s*:\s*(" + t.REF_CODE + ")"))))
    alone = found(F.transform(F.filter(top, not_labelled), _code_in))
    both = F.flatten(F.zip_with(this, following, lambda a, b: F.array(F.concat(a, b), F.concat(b, a))))
    return F.coalesce(below, same, alone, found(F.transform(F.filter(both, not_labelled), _code_in)))


# Date ----------------------------------------------------------------------------------------------------------------

_DATED = r"\b(" + t.DATE + r")\b"


def date_regex(p: Page) -> Column:
    return F.coalesce(t.first_group(p.text, _DATED), t.first_group(p.text, r"Alger\s*:?,?\s*(?:le\s*)?\n\s*(" + t.DATE + ")"))


def date_heuristic(p: Page) -> Column:
    below = t.first_group(p.text, r"Alger\s*:?\s*,?\s*(?:le\s*)?\n\s*(" + t.DATE + ")")
    top = t.first_where(F.transform(t.head(F.split(p.text, "\n", -1), 25), lambda x: t.first_group(x, _DATED)), lambda v: v.isNotNull())
    spelled = t.first_group(p.text, r"Alger\s*,?\s*le\s*([.\-_\s]{0,20})\n?\s*([A-Za-z0-9][^\n]{3,}?)(?:\n|$)", 2)
    spelled = t.strip(F.regexp_replace(spelled, t.U + r"\A[.\-_\s]+", ""))
    good = lambda x: (F.length(F.replace(x, F.lit(" "), F.lit(""))) >= 4) & ~t.matches(x, r"\A[\W\s]+$") & ~t.starts(x, r"(?:Messieurs?|Mesdames?|Monsieur)\s+")
    return F.coalesce(below, top, t.let(spelled, lambda x: F.when(good(x), x)))


def date_fuzzy(p: Page, best: Column) -> Column:
    line = F.get(p.filled, best["idx"])
    found = F.coalesce(t.first_group(line, _DATED), t.first_group(_next_line(p.filled, best["idx"]), _DATED))
    return F.when(best["idx"].isNotNull() & (best["score"] >= 0.60), found)


# Subject -------------------------------------------------------------------------------------------------------------


def subject_regex(p: Page) -> Column:
    return t.let(t.strip(t.first_group(p.text, r"Objet\s*:\s*([^\n]+?)(?:\n|$)")), t.non_empty)


def _labelled_block(lines: Column, at: Column, rest: Column, first: Column) -> Column:
    """The label's line and what follows it up to the next part; a tiny block is read again, over blank lines."""
    more = t.until(t.after(lines, at, 4), lambda x: (x == "") | t.starts(x, _OBJECT_STOP))
    block = t.strip(F.regexp_replace(t.squeeze(t.join_lines(F.concat(F.array(first), more), " ")), t.I + r"\A\s*Réf\s*:\s*", ""))
    again = F.when(t.matches(F.get(lines, at), r"\A\s*Objet\s*:"), F.concat(F.array(rest), t.after(lines, at, 5)))
    part = t.until(again, lambda x: t.starts(x, r"(?:P\.J|Réf|REF|Alger|Monsieur|Messieurs?|Mesdames?)") | t.matches(x, _BODY_CUE))
    tail = t.let(part, lambda x: F.concat(F.slice(x, 1, 1), t.until(F.slice(x, 2, 6), lambda y: y == "")))
    tail = t.strip(t.join_lines(F.filter(tail, lambda x: x != ""), " "))
    return t.let(block, lambda b: F.when(t.word_count(b) <= 3, F.coalesce(t.let(tail, t.non_empty), b)).otherwise(b))


def _first_sentence(lines: Column, at: Column) -> Column:
    skipped = t.let(t.after(lines, at, 5), lambda x: F.slice(x, F.coalesce(t.index_where(x, lambda y: y != ""), F.lit(0)) + 1, F.lit(5)))
    stop = lambda x: (x == "") | t.starts(x, r"(?:P\.J|Réf|REF|Alger|Copie\s+[aà]\s*:|Dans\s+le\s+cadre|Faisant\s+suite|Suite\s+[aà]|J['’]ai\s+l['’]honneur)")
    to_period = lambda x: t.let(t.index_where(x, lambda y: y.endswith(".")), lambda k: F.when(k.isNotNull(), F.slice(x, F.lit(1), F.coalesce(k, F.lit(0)) + 1)).otherwise(x))
    return t.squeeze(t.join_lines(t.let(t.until(skipped, stop), to_period), " "))


def _above_label(lines: Column, at: Column, first: Column) -> Column:
    above = F.when(at > 0, F.reverse(F.slice(lines, F.greatest(at - 1, F.lit(1)), F.least(at, F.lit(2)))))
    kept = t.until(above, lambda x: (x == "") | t.starts(x, _HEAD_CUE) | t.is_noise(x) | t.is_reference(x) | t.is_keyword(x))
    body = t.starts(first, _BODY_CUE)
    return t.let(
        t.join_lines(F.reverse(kept), " "),
        lambda x: F.when((x != "") & (first != "") & body, x).when((x != "") & (first != "") & (t.word_count(first) <= 3), F.concat(x, F.lit(" "), first)),
    )


def subject_heuristic(p: Page) -> Column:
    """The most title-like of three readings: the labelled block, the first sentence below, the lines above the label."""

    def scored(value: Column, rank: int) -> Column:
        penalty = lambda n: F.abs(n - 10) + F.when(n > 22, 6).otherwise(0)
        as_struct = lambda v: F.when(v != "", t.let(t.word_count(v), lambda n: F.struct(penalty(n).alias("penalty"), n.alias("n"), F.lit(rank).alias("rank"), v.alias("value"))))
        return t.let(value, as_struct)

    def readings(at: Column) -> Column:
        rest = t.strip(F.regexp_replace(F.get(p.lines, at), t.I + r"\A\s*Objet\s*:?\s*", ""))

        def with_rest(r: Column) -> Column:
            first = F.when(r != "", r).otherwise(F.coalesce(t.first_where(t.after(p.lines, at, 3), lambda x: x != ""), F.lit("")))
            return t.let(
                first, lambda f: F.array_min(F.array_compact(F.array(scored(_labelled_block(p.lines, at, r, f), 0), scored(_first_sentence(p.lines, at), 1), scored(_above_label(p.lines, at, f), 2))))["value"]
            )

        return F.when(at.isNotNull(), t.let(rest, with_rest))

    return t.let(t.index_where(p.lines, lambda x: t.starts(x, r"\s*Objet\s*:?")), readings)


# Attachments ---------------------------------------------------------------------------------------------------------


def _pieces(count: Column) -> Column:
    named = lambda n: F.concat(F.lpad(n.cast("string"), 2, "0"), F.when(n == 1, F.lit(" pièce jointe")).otherwise(F.lit(" pièces jointes")))
    return t.let(count, named)


def _spelled(token: Column) -> Column:
    names = F.create_map(*[x for k, v in _NUMBERS.items() for x in (F.lit(k), F.lit(v))])
    return t.let(token, lambda x: F.when(x.rlike(t.U + r"\A\d+\z"), t.to_int(x)).otherwise(F.try_element_at(names, F.lower(x))))


def attachments_regex(p: Page) -> Column:
    return t.let(t.strip(t.first_group(p.text, r"(?:P\.?\s*J\.?\s*:?\s*|Pi[eè]ces?\s+jointes?\s*:?\s*)([^\n]+?)(?:\n|$)")), t.non_empty)


def attachments_heuristic(p: Page) -> Column:
    label = r"(?:P\.?\s*J\.?|Pi[eè]ces?\s+jointes?)\s*:?\s*"
    following = F.concat(F.slice(p.lines, F.lit(2), F.greatest(F.size(p.lines) - 1, F.lit(0))), F.array(F.lit("")))

    def labelled(line: Column, below: Column) -> Column:
        own = t.strip(F.regexp_replace(line, t.I + r"\A" + label, ""))
        count = lambda v: _pieces(t.to_int(t.first_group(v, r"\b(\d{1,2})\b")))
        short = lambda v: F.when(v != "", F.coalesce(count(v), F.when(t.word_count(v) <= 4, v)))
        return F.when(t.starts(line, label), t.let(t.let(own, lambda o: F.when(o != "", o).otherwise(below)), short))

    low = F.lower(p.text)
    anywhere = t.to_int(t.first_group(p.text, r"\b(\d{1,2})\s*pi[eè]ce?s?\s+jointe?s?\b"))
    spelled = _spelled(t.first_group(p.text, r"\b(deux|trois|quatre)\s+pi[eè]ce?s?\s+jointe?s?\b"))
    enclosed = _spelled(t.first_group(low, r"ci[\-\s]?joint(?:e|es)?(?:\s+\w+){0,4}\s+" + _NUMBER + r"\s+" + _COUNTED))
    reverse = _spelled(t.first_group(low, _NUMBER + r"\s+" + _COUNTED + r"(?:\s+\w+){0,6}\s+ci[\-\s]?joint(?:e|es)?"))
    implied = t.matches(p.text, r"\bCopie\s+[aà]\s*:") | t.matches(p.text, r"\bannexes?\b|\bpi[eè]ces?\b")
    return F.coalesce(
        t.first_where(F.zip_with(p.lines, following, labelled), lambda v: v.isNotNull()),
        _pieces(anywhere),
        _pieces(spelled),
        _pieces(enclosed),
        _pieces(reverse),
        F.when(implied, F.lit("01 pièce jointe")),
    )


# Body ----------------------------------------------------------------------------------------------------------------

_SALUTATION = r"(?m)(?:^|\n)Monsieur\s*,\s*\n"


def _to_closing(text: Column) -> Column:
    """Text up to the first closing phrase."""
    return t.let(t.strip(F.get(F.split(F.regexp_replace(text, r"\A\n+", ""), t.I + t.BODY_END, 2), F.lit(0))), t.non_empty)


def _from_match(text: Column, pattern: str) -> Column:
    """Text from the first match of a pattern on; null without one."""
    return t.let(F.regexp_instr(text, F.lit(t.I + pattern)), lambda at: F.when(at > 0, F.substring(text, at, F.length(text))))


def body_regex(p: Page) -> Column:
    return _to_closing(F.coalesce(_from_match(p.text, "(?m)" + t.BODY_START), _from_match(p.text, _SALUTATION)))


def body_heuristic(p: Page) -> Column:
    """As ``body_regex``, but from the first opening whose next line is not a label; from the last one if all are."""
    opening = t.I + "(?m)" + t.BODY_START

    def chosen(found: Column) -> Column:
        # pieces between openings: piece i + 1 follows opening i; where nothing stands between, the next opening follows
        def rest(pieces: Column) -> Column:
            follow = F.transform(found, lambda _, i: t.let(t.strip(F.coalesce(F.get(pieces, i + 1), F.lit(""))), lambda x: F.when(x == "", F.coalesce(F.get(found, i + 1), F.lit(""))).otherwise(x)))
            good = t.index_where(follow, lambda x: ~t.starts(t.strip(x), r"(?:Objet|Réf|P\.J|Messieurs?|Mesdames?)"))
            both = F.transform(found, lambda o, i: F.concat(o, F.coalesce(F.get(pieces, i + 1), F.lit(""))))
            return t.let(F.coalesce(good, F.size(found) - 1), lambda k: F.array_join(F.slice(both, k + 1, F.size(found)), ""))

        return F.when(F.size(found) > 0, t.let(F.split(p.text, opening, -1), rest))

    return _to_closing(F.coalesce(t.let(F.regexp_extract_all(p.text, F.lit(opening), F.lit(0)), chosen), _from_match(p.text, _SALUTATION)))


def body_fuzzy(p: Page, best: Column) -> Column:
    rest = F.slice(p.filled, F.coalesce(best["idx"], F.lit(0)) + 1, F.greatest(F.size(p.filled), F.lit(1)))
    return F.when(best["idx"].isNotNull() & (best["score"] >= 0.58), _to_closing(t.strip(F.array_join(rest, "\n"))))


# Decoder of the head -------------------------------------------------------------------------------------------------


def decoded_head(p: Page) -> tuple[Column, Column]:
    """(sender, receiver) by scoring each of the first lines; the receiver is looked for knowing the sender's place."""
    top = t.head(p.filled, 18)
    score = lambda condition, points: F.when(condition, points).otherwise(0)
    poor = lambda x: t.is_noise(x) | t.is_reference(x) | t.is_keyword(x)

    def best(points: Callable[[Column, Column], Column]) -> Column:
        return F.array_max(F.transform(top, lambda x, i: F.struct(points(x, i).alias("score"), (-i).alias("before"), x.alias("line"))))

    sender = best(lambda x, i: score(poor(x), -4) + score(t.matches(x, r"\b(?:Service|Département|Direction)\b"), 3) + score(t.starts(x, r"De\s*:"), 6) + score(i <= 5, 1))
    receiver = lambda at: best(
        lambda x, i: score(poor(x), -4) + score(t.matches(x, r"\b(?:Service|Département|Direction|Monsieur|Mesdames?)\b"), 2) + score(i > at, 2) + score(t.starts(x, r"[AÀ]\s*(?:l['’]attention|:)"), 5)
    )
    line = lambda s: F.when(s["score"] > 0, s["line"])

    def other(s: Column) -> Column:
        return t.let(receiver(-s["before"]), lambda r: F.when(line(s).isNull() | (line(s) != line(r)), line(r)))

    return t.let(sender, line), t.let(sender, other)


# Strategies ----------------------------------------------------------------------------------------------------------


class Field(NamedTuple):
    """A field with its strategies' rules, prior scores and reasons, and what the fuzzy strategy compares."""

    name: str
    regex: Callable[[Page], Column]
    heuristic: Callable[[Page], Column]
    scores: tuple[float, float, float]
    reasons: tuple[str, str, str]
    aliases: tuple[str, ...]
    window: int
    at_least: float
    label: str


# Prior scores, thresholds, windows, aliases and reasons of the strategies.
FIELDS = (
    Field("sender", sender_regex, sender_heuristic, (0.85, 0.78, 0.72), ("explicit sender label", "header window and cleanup rules", "fuzzy label match"), ("de", "source", "expediteur"), 12, 0.68, r"(?:De|Source|Exp[eé]diteur)\s*:\s*"),
    Field("receiver", receiver_regex, receiver_heuristic, (0.84, 0.77, 0.70), ("explicit receiver label", "contextual header scan", "fuzzy label match"), ("a l'attention", "destinataire", "destination", "a"), 16, 0.66, _ADDRESSEE),
    Field("ref_header", reference_regex, reference_heuristic, (0.86, 0.80, 0.68), ("explicit reference pattern", "reference window scan", "fuzzy label match"), ("ref", "réf", "reference"), 20, 0.70, r"(?:Réf|REF|Reference)\s*:\s*"),
    Field("date", date_regex, date_heuristic, (0.82, 0.74, 0.62), ("explicit date pattern", "alger/date window heuristics", "fuzzy date label match"), ("date", "alger", "le"), 18, 0.60, ""),
    Field("objet", subject_regex, subject_heuristic, (0.84, 0.79, 0.73), ("explicit objet label", "multi-candidate subject heuristics", "fuzzy label match"), ("objet", "subject"), 24, 0.72, r"(?:Objet|Subject)\s*:\s*"),
    Field("pj", attachments_regex, attachments_heuristic, (0.83, 0.78, 0.65), ("explicit PJ label", "attachment count and spillover heuristics", "fuzzy label match"), ("pj", "pieces jointes", "annexes", "copie"), 24, 0.64, r"(?:P\.?\s*J\.?|Pi[eè]ces?\s+jointes?|Annexes?|Copie\s+[aà])\s*:?"),
    Field("body", body_regex, body_heuristic, (0.81, 0.76, 0.60), ("body start/end regex", "body window heuristics", "fuzzy greeting/body cue"), ("monsieur", "madame", "j'ai l'honneur", "veuillez", "nous vous"), 40, 0.58, ""),
)
STRATEGIES = ("regex", "heuristic", "rapid_fuzzy")
BY_NAME = {f.name: f for f in FIELDS}


def candidate_score(field: str, value: Column, strategy_score: Column, confidence: Column) -> Column:
    """Four parts strategy, one part page, and what the value's length says for its field; rounded to 4 places."""
    combined = 0.8 * F.least(F.greatest(strategy_score, F.lit(0.0)), F.lit(1.0)) + 0.2 * confidence
    n = t.word_count(value)
    if field == "objet":
        combined = combined + F.when(n.between(3, 16), 0.04).when(n > 24, -0.08).otherwise(0.0)
    elif field in ("sender", "receiver"):
        combined = combined + F.when(F.length(value) > 5, 0.02).otherwise(0.0) - F.when(t.is_noise(value), 0.12).otherwise(0.0)
    elif field == "body":
        combined = combined + F.when(n > 20, 0.03).otherwise(0.0)
    return F.round(F.least(F.greatest(combined, F.lit(0.0)), F.lit(1.0)), 4)


def _candidate(field: Field, rank: int, value: Column, confidence: Column) -> Column:
    prior = F.lit(field.scores[rank])
    as_struct = lambda v: F.when(
        v != "",
        F.struct(
            F.lit(field.name).alias("field"),
            F.lit(STRATEGIES[rank]).alias("strategy"),
            v.alias("value"),
            prior.alias("strategy_score"),
            F.round(confidence, 4).alias("page_confidence"),
            candidate_score(field.name, v, prior, confidence).alias("score"),
            F.lit(field.reasons[rank]).alias("reason"),
            F.lit(rank).alias("strategy_rank"),
        ),
    )
    return t.let(t.squeeze(value), as_struct)


def candidates(df: DataFrame, text: str, confidence: str, keys: list[str], fields: tuple[str, ...] | None = None, fuzzy: bool = True, mode: str = "compat") -> DataFrame:
    """One row a page, field and strategy that found a value: keys, field, strategy, value, scores, reason, strategy_rank."""
    chosen = [f for f in FIELDS if fields is None or f.name in fields]
    pages = with_page_columns(spread(df.select(*dict.fromkeys([*keys, text, confidence]))), text, mode).select(*keys, normalised_confidence(F.col(confidence)).alias("_conf"), "_text", "_lines", "_filled")
    found = []
    if fuzzy:
        pages = pages.withColumn("_best", best_label_lines(F.col("_filled"), [Label(f.name, f.aliases, f.window, f.at_least) for f in chosen]))
    conf, page = F.col("_conf"), page_columns()
    for f in chosen:
        rules = [f.regex(page), f.heuristic(page)]
        if fuzzy:
            best = F.col("_best")[f.name]
            special = {"date": date_fuzzy, "body": body_fuzzy}.get(f.name)
            rules.append(special(page, best) if special else _fuzzy_value(page.filled, best, f.at_least, f.label))
        found += [_candidate(f, rank, rule, conf) for rank, rule in enumerate(rules)]
    out = pages.select(*keys, F.explode(F.array_compact(F.array(*found))).alias("_c"))
    return out.select(*keys, "_c.*")


def ranked(found: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates with their ``place`` within page and field; place 1 is the selected one."""
    order = [F.col("score").desc(), F.col("strategy_score").desc(), F.length("value").desc(), F.col("strategy_rank")]
    return found.withColumn("place", F.row_number().over(Window.partitionBy(*keys, "field").orderBy(*order)))


def selected(found: DataFrame, keys: list[str]) -> DataFrame:
    """The winner of every page and field: an argmax, combined on the map side, so no group is ever sorted."""
    best = F.max(F.struct("score", "strategy_score", F.length("value").alias("n"), (-F.col("strategy_rank")).alias("first"), "strategy", "value", "reason", "page_confidence"))
    return found.groupBy(*keys, "field").agg(best.alias("_b")).select(
        *keys, "field", F.col("_b.value").alias("value"), F.col("_b.strategy").alias("strategy"), F.col("_b.score").alias("score"), F.col("_b.strategy_score").alias("strategy_score"), F.col("_b.reason").alias("reason")
    )


def extract(df: DataFrame, text: str, confidence: str, keys: list[str], mode: str = "compat") -> DataFrame:
    """One wide row a page: the eight fields, the details of the seven, subtype; sender and receiver fall back to the decoder."""
    found = candidates(df, text, confidence, keys, mode=mode)
    by_field = found.groupBy(*keys, "field").agg(F.array_sort(F.collect_list(F.struct("strategy_rank", "strategy", "value", "strategy_score", "page_confidence", "score", "reason"))).alias("list"))
    best = by_field.withColumn(
        "selected", F.array_max(F.transform("list", lambda c: F.struct(c["score"], c["strategy_score"], F.length(c["value"]), -c["strategy_rank"], c["value"].alias("value"))))["value"]
    )
    wide = best.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("selected", F.col("list").alias("candidates"))))).alias("field_details"))
    sent, received = decoded_head(page_columns())
    heads = with_page_columns(df, text, mode).select(
        *keys, t.strip_html(F.col(text)).alias("_plain"), sent.alias("_sent"), received.alias("_received"), reference_in_body(page_columns()).alias("_ref_body"), normalised_confidence(F.col(confidence)).alias("page_confidence")
    )
    out = heads.join(wide, keys, "left")
    value = lambda name: F.try_element_at("field_details", F.lit(name))["selected"]
    fields = F.struct(
        F.coalesce(value("sender"), F.col("_sent")).alias("sender"),
        F.coalesce(value("receiver"), F.col("_received")).alias("receiver"),
        *[value(n).alias(n) for n in ("date", "ref_header")],
        F.col("_ref_body").alias("ref_body"),
        *[value(n).alias(n) for n in ("objet", "pj", "body")],
    )
    return out.select(*keys, "page_confidence", fields.alias("fields"), "field_details", t.document_subtype(F.col("_plain")).alias("doc_subtype"))
