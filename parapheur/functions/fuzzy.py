"""Partial string similarity, the one score that no Spark expression gives; Arrow batches, and only for lines that need it.

``partial_ratio`` is the best normalised Indel similarity of the shorter text with any window of the longer one of that length,
windows cut off at either end included. Texts of equal length are tried both ways.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from difflib import SequenceMatcher
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel dynamic programming."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, row = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def partial_ratio(a: str, b: str, floor: float = 0.0) -> float:
    """Similarity from 0 to 1 of the shorter text with its best place in the longer one; 0 may stand for one below ``floor``."""
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    if a in b:
        return 1.0
    best = _windows(a, b, floor)
    return max(best, _windows(b, a, max(best, floor))) if len(a) == len(b) else best


def _windows(a: str, b: str, floor: float) -> float:
    """Windows are first bounded by the letters they share with ``a``, all at once; the most promising are measured first."""
    n, m = len(a), len(b)
    need = Counter(a)
    letters = np.array([ord(c) for c in need], np.uint32)
    seen = np.zeros((len(letters), m + 1), np.int32)
    np.cumsum(np.frombuffer(b.encode("utf-32-le", "surrogatepass"), np.uint32) == letters[:, None], axis=1, out=seen[:, 1:])
    lo = np.concatenate([np.zeros(n - 1, np.int64), np.arange(m)])
    hi = np.concatenate([np.arange(1, n), np.minimum(np.arange(m) + n, m)])
    shared = np.minimum(seen[:, hi] - seen[:, lo], np.array(list(need.values()))[:, None]).sum(axis=0)
    bound = 2 * shared / (n + hi - lo)
    best = 0.0
    for k in np.argsort(-bound, kind="stable") if bound.max() >= floor else ():
        if bound[k] <= best or bound[k] < floor:
            break
        best = max(best, 2 * _common_subsequence(a, b[lo[k] : hi[k]]) / (n + int(hi[k] - lo[k])))
    return best


def similarity(left: str | None, right: str | None) -> float:
    left, right = (left or "").strip().lower(), (right or "").strip().lower()
    return partial_ratio(left, right) if left and right else 0.0


def plain_ratio(left: str | None, right: str | None, matcher: SequenceMatcher | None = None) -> float:
    """Twice the letters in matching blocks over all letters of both, 0 if either is empty; letters that fill a long right text are not matched first.

    A ``matcher`` kept from the last call saves the index of a right text that comes again.
    """
    left, right = (left or "").strip().lower(), (right or "").strip().lower()
    if not left or not right:
        return 0.0
    if left == right and len(right) < 200:  # a longer one may have no letter to start a block from
        return 1.0
    matcher = matcher or SequenceMatcher(None)
    if matcher.b != right:
        matcher.set_seq2(right)
    matcher.set_seq1(left)
    return matcher.ratio()


def text_ratio(left: Column, right: Column) -> Column:
    """``plain_ratio`` of two columns, in Arrow batches; never null. Equal pairs of a batch are measured once."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = list(zip(a, b))
        matcher = SequenceMatcher(None)
        # by right text, so that each is indexed once
        known = {p: plain_ratio(*p, matcher) for p in sorted(set(pairs), key=lambda p: p[1] or "")}
        return pd.Series([known[p] for p in pairs], dtype=float)

    return ratio(left, right)


@lru_cache(maxsize=200_000)
def _best_alias(low: str, names: tuple[str, ...], floor: float) -> float:
    return 1.0 if any(a in low for a in names) else max(partial_ratio(low, a, floor) for a in names)


class Label(NamedTuple):
    """What a field's lines are compared with: the first ``window`` lines, scores from ``floor`` on."""

    name: str
    aliases: tuple[str, ...]
    window: int
    floor: float


def best_label_lines(lines: Column, labels: Sequence[Label]) -> Column:
    """STRUCT of one STRUCT<idx INT, score DOUBLE> a label: the line most like one of its aliases, the first of equals.

    Scores below a label's floor need not be exact: the caller does not use them. The lines cross to Python once for all labels, and
    a line that comes again is not measured again. A line that contains an alias scores 1, and no later one can be better.
    """
    wanted = [(k, tuple(dict.fromkeys(a.strip().lower() for a in label.aliases)), label.window, label.floor) for k, label in enumerate(labels)]
    most = max((label.window for label in labels), default=0)
    schema = ", ".join(f"`{label.name}` struct<idx:int,score:double>" for label in labels)

    def best(page: list[str], names: tuple[str, ...], window: int, floor: float) -> dict:
        place, top = None, 0.0
        for i, low in enumerate(page[:window]):
            mine = _best_alias(low, names, floor) if low else 0.0
            if mine > top:
                place, top = i, mine
                if top == 1.0:
                    break
        return {"idx": place, "score": top}

    @F.pandas_udf(schema)
    def score(batch: pd.Series) -> pd.DataFrame:
        pages = [[(line or "").strip().lower() for line in page] if page is not None else [] for page in batch]
        return pd.DataFrame({labels[k].name: [best(page, names, window, floor) for page in pages] for k, names, window, floor in wanted})

    return score(F.slice(lines, 1, most))


def best_label_line(lines: Column, aliases: Sequence[str], window: int, floor: float = 0.0) -> Column:
    """STRUCT<idx INT, score DOUBLE> of one label; see ``best_label_lines``."""
    return best_label_lines(lines, [Label("best", tuple(aliases), window, floor)])["best"]
