"""Evaluation metrics as Column expressions, but for word edits, which need Python. "Not applicable" is null, never NaN, so averages skip it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parapheur.functions.edits import word_rate
from parapheur.functions.text import let, norm, ref_norm, words

#: From this token F1 on a field counts as right.
FIELD_ACCURACY_F1 = 0.65


def _applicable(gold: Column, value: Column) -> Column:
    return F.when(norm(F.coalesce(gold, F.lit(""))) != "", value)


def _numbered(array: Column) -> Column:
    """Each word with which occurrence of it this is, so that a set of them stands for the multiset of words."""
    name = lambda all_: F.transform(all_, lambda w, i: F.concat(w, F.lit("\u0001"), (i + 1 - F.array_position(all_, w)).cast("string")))
    return let(F.array_sort(array), name)


def common_tokens(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two word arrays."""
    return F.size(F.array_intersect(_numbered(a), _numbered(b)))


def _compared(predicted: Column, gold: Column, body) -> Column:
    """``body`` of the words of both sides, each split once; null without gold."""
    side = lambda c: words(norm(F.coalesce(c, F.lit(""))))
    return let(side(gold), lambda g: F.when(F.size(g) > 0, let(side(predicted), lambda p: body(p, g))))


def _scores(p: Column, g: Column) -> Column:
    def of(common: Column) -> Column:
        share = lambda n: F.when(n > 0, common / n).otherwise(0.0)
        return F.struct(share(F.size(p)).alias("prec"), share(F.size(g)).alias("recall"), F.when(common > 0, 2 * common / (F.size(p) + F.size(g))).otherwise(0.0).alias("f1"))

    return let(common_tokens(p, g).cast("double"), of)


def _iou(p: Column, g: Column) -> Column:
    return F.size(F.array_intersect(p, g)) / F.size(F.array_union(p, g))


def token_scores(predicted: Column, gold: Column) -> Column:
    """STRUCT<prec, recall, f1> by multiset overlap of words; null without gold, zeros without a prediction."""
    return _compared(predicted, gold, _scores)


def exact_match(predicted: Column, gold: Column, field: Column) -> Column:
    """1 where both are equal in normal form; references are compared whatever their separators."""
    predicted, gold_text = F.coalesce(predicted, F.lit("")), F.coalesce(gold, F.lit(""))
    same = F.when(F.lower(field).contains("ref"), ref_norm(predicted) == ref_norm(gold_text)).otherwise(norm(predicted) == norm(gold_text))
    return _applicable(gold, same.cast("double"))


def field_accuracy(f1: Column, threshold: float = FIELD_ACCURACY_F1) -> Column:
    return F.when(f1.isNotNull(), (f1 >= threshold).cast("double"))


def token_iou(predicted: Column, gold: Column) -> Column:
    """Jaccard similarity of the word sets."""
    return _compared(predicted, gold, _iou)


def character_error_rate(hypothesis: Column, reference: Column, edits: Column | None = None) -> Column:
    """Edit distance by reference length, at most 1; against an empty reference 0 or 1. ``edits``: the distance where it is known."""
    h, r = F.coalesce(hypothesis, F.lit("")), F.coalesce(reference, F.lit(""))
    distance = F.levenshtein(h, r) if edits is None else F.coalesce(edits, F.length(r))
    return F.when(r == "", F.when(h == "", 0.0).otherwise(1.0)).otherwise(F.least(distance / F.length(r), F.lit(1.0)))


def word_error_rate(hypothesis: Column, reference: Column) -> Column:
    """Word edit distance by number of reference words, at most 1."""
    return word_rate(hypothesis, reference)


def text_accuracy(cer: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - cer)


def metric_pack(predicted: Column, gold: Column, field: Column) -> Column:
    """The six metrics of a value against its gold, as one struct; ``F.inline(F.array(...))`` makes columns of it."""
    both = _compared(predicted, gold, lambda p, g: F.struct(_scores(p, g).alias("scores"), _iou(p, g).alias("iou")))
    return let(
        both,
        lambda x: F.struct(
            x["scores"]["prec"].alias("prec"),
            x["scores"]["recall"].alias("recall"),
            x["scores"]["f1"].alias("f1"),
            exact_match(predicted, gold, field).alias("exact_match"),
            field_accuracy(x["scores"]["f1"]).alias("field_accuracy"),
            x["iou"].alias("iou"),
        ),
    )


def normalised_confidence(value: Column) -> Column:
    """A confidence as a share of 1: percentages divided, garbage and nulls 0, clamped."""
    number = value.try_cast("double")
    number = F.when(number.isNull() | F.isnan(number), 0.0).otherwise(number)
    return F.least(F.greatest(F.when(number > 1, number / 100).otherwise(number), F.lit(0.0)), F.lit(1.0))
