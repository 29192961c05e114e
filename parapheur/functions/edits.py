"""Edit distances of whole texts, exact, many pairs at a time in Arrow batches.

Spark's ``levenshtein`` fills the table of two texts cell by cell, some ten nanoseconds each. Here 64 cells of a column are one machine
word (Myers' bit vectors, in Hyyrö's form), and the words of many pairs, side by side, are worked on by one array operation. A word runs
one step behind the word below it in the same column, so that what it takes over from there is known and no word waits for another.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Machine words worked on at once, columns that follow one another in a place, and most entries of a group's tables; a pair whose own
#: table has more is worked on by itself. Only speed and memory depend on these.
LANES, COLUMNS, ENTRIES = 8192, 16_384, 1 << 23
#: What is between words, as for ``text.words``.
_WORD = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


class _Pair:
    """The shorter text as the bits of its elements in machine words, the longer one as places of these."""

    def __init__(self, number: int, short: Sequence, long: Sequence):
        self.number, self.short, self.long, self.size, self.columns = number, short, long, len(short), len(long)
        self.words = -(-self.size // 64)
        self.entries = self.words * (len(set(short)) + 1)

    def table(self, words: int, numbers: Callable) -> tuple[np.ndarray, np.ndarray]:
        """Of every element the bits where the shorter text has it, at the upper end of ``words`` words (row 0: nowhere), and a row a column."""
        long = numbers(self.long)
        known, row = np.unique(numbers(self.short), return_inverse=True)
        at = np.arange(64 * words - self.size, 64 * words)
        bits = np.zeros((len(known) + 1) * words, np.uint64)
        np.add.at(bits, (row + 1) * words + (at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
        found = np.minimum(np.searchsorted(known, long), len(known) - 1)
        return bits, np.where(known[found] == long, found + 1, 0)

    def begin(self, words: int) -> np.ndarray:
        """Words of a first column, where every cell is one more than the one below; bits below the text stay level."""
        at = np.zeros(64 * words, np.uint8)
        at[64 * words - self.size :] = 1
        return np.packbits(at, bitorder="little").view(np.uint64)


def _places(pairs: Sequence[_Pair], columns: int) -> list[list[_Pair]]:
    """Pairs one after another in a place of as many words as the largest of them has, up to ``columns`` columns a place."""
    out: list[list[_Pair]] = []
    used, entries = columns, 0
    for pair in sorted(pairs, key=lambda x: (x.words, x.columns)):
        if used + pair.columns > columns or entries + pair.entries > ENTRIES:
            out.append([])
            used = entries = 0
        out[-1].append(pair)
        used, entries = used + pair.columns, entries + pair.entries
    return out


def _measure(places: Sequence[Sequence[_Pair]], numbers: Callable, out: np.ndarray) -> None:
    """Distances of the pairs of some places into ``out``."""
    widths = np.array([place[-1].words for place in places])
    last = np.cumsum(widths) - 1
    first, lanes = last - widths + 1, int(widths.sum())
    steps = max(sum(x.columns for x in place) for place in places)
    rows = np.zeros((steps, len(places)), np.int32)
    tables, base = [], 0
    begins: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    ends: dict[int, list[tuple[int, _Pair | None]]] = {}
    for k, place in enumerate(places):
        step, width = 0, int(widths[k])
        ends.setdefault(width - 2, []).append((k, None))  # the last word has not begun
        for pair in place:
            bits, row = pair.table(width, numbers)
            rows[step : step + pair.columns, k] = base + row * width
            tables.append(bits)
            base += len(bits)
            begins.append((step + np.arange(width), first[k] + np.arange(width), pair.begin(width)))
            step += pair.columns
            ends.setdefault(step + width - 2, []).append((k, pair))
    table = np.concatenate([*tables, np.zeros(int(widths.max()), np.uint64)])
    when, lane, begin = (np.concatenate(x) for x in zip(*begins))
    order = np.argsort(when, kind="stable")
    when, lane, begin = when[order], lane[order], begin[order]
    total = steps + int(widths.max()) - 1
    cut = np.searchsorted(when, np.arange(total + 1))
    up, fall = np.zeros(lanes, np.uint64), np.zeros(lanes, np.uint64)
    same, s, t = (np.empty(lanes, np.uint64) for _ in range(3))
    spot, spot_next = (np.zeros(lanes + 1, np.int64) for _ in range(2))
    # what a word hands on to the next one of its column: 1 where it does not rise, 1 where it falls
    flat, flat_next, drop, drop_next = (np.zeros(lanes + 1, np.uint64) for _ in range(4))
    held, before = np.zeros(len(places), np.uint64), np.zeros(len(places), np.int64)
    one, top, beyond = np.uint64(1), np.uint64(63), last + 1
    for step in range(total):
        flat[first] = drop[first] = 0  # the lower edge rises by one a column
        if step < steps:
            spot[first] = rows[step]
        if cut[step] < cut[step + 1]:
            begun = lane[cut[step] : cut[step + 1]]
            up[begun], fall[begun] = begin[cut[step] : cut[step + 1]], 0
        np.take(table, spot[:lanes], out=same, mode="clip")
        np.add(spot[:lanes], 1, out=spot_next[1:])
        np.bitwise_or(same, drop[:lanes], out=same)
        np.bitwise_and(same, up, out=s)
        np.add(s, up, out=s)
        np.bitwise_xor(s, up, out=s)
        np.bitwise_or(s, same, out=s)
        np.bitwise_or(s, fall, out=s)  # where the diagonal does not rise
        np.bitwise_or(s, up, out=t)
        np.bitwise_xor(t, fall, out=t)  # where the row does not rise
        np.bitwise_and(s, up, out=up)  # where it falls
        np.right_shift(t, top, out=flat_next[1:])
        np.right_shift(up, top, out=drop_next[1:])
        np.add(t, t, out=t)
        np.bitwise_or(t, flat[:lanes], out=t)
        np.add(up, up, out=up)
        np.bitwise_or(up, drop[:lanes], out=up)
        np.bitwise_and(s, t, out=same)
        np.bitwise_xor(s, same, out=fall)
        np.bitwise_xor(t, same, out=t)
        np.bitwise_or(up, t, out=up)
        flat, flat_next, drop, drop_next, spot, spot_next = flat_next, flat, drop_next, drop, spot_next, spot
        held += flat[beyond]
        held += drop[beyond]
        for k, pair in ends.get(step, ()):
            if pair:
                out[pair.number] = pair.size + pair.columns - int(held[k]) + before[k]
            before[k] = int(held[k])


def _alone(short: np.ndarray, long: np.ndarray) -> int:
    """The distance of two texts of very many elements: one number has all bits of a column, those of 1,024 columns' elements are there at a time."""
    where: dict[int, list[int]] = {}
    for i, c in enumerate(short.tolist()):
        where.setdefault(c, []).append(i)
    full = (1 << len(short)) - 1
    up, fall, columns = full, 0, long.tolist()
    for start in range(0, len(columns), 1024):
        bits: dict[int, int] = {}
        for c in columns[start : start + 1024]:
            if c not in bits:
                at = bytearray(len(short) // 8 + 1)
                for i in where.get(c, ()):
                    at[i >> 3] |= 1 << (i & 7)
                bits[c] = int.from_bytes(at, "little")
            same = bits[c]
            s = ((((same & up) + up) ^ up) | same | fall) & full
            rise = ((fall | full ^ (s | up)) << 1 | 1) & full
            up = (s & up) << 1 & full | full ^ (s | rise)
            fall = rise & s
    return len(columns) + up.bit_count() - fall.bit_count()


def distances(pairs: Sequence[tuple[Sequence, Sequence]], numbers: Callable[[Sequence], np.ndarray] = np.asarray) -> np.ndarray:
    """Edit distance of the two sequences of each pair; ``numbers`` makes an array of numbers of one."""
    out = np.zeros(len(pairs), np.int64)
    left: list[_Pair] = []
    for k, (a, b) in enumerate(pairs):
        pair = _Pair(k, *((a, b) if len(a) <= len(b) else (b, a)))
        if not pair.size:
            out[k] = pair.columns
        elif pair.entries > ENTRIES:
            out[k] = _alone(numbers(pair.short), numbers(pair.long))
        else:
            left.append(pair)
    if left:
        work = sum(x.words * x.columns for x in left)
        longest = max(x.columns for x in left)
        group: list[list[_Pair]] = []
        lanes = entries = most = 0
        for place in _places(left, max(longest, min(COLUMNS, work // LANES))):
            columns, own = sum(x.columns for x in place), place[-1].words * max(x.entries // x.words for x in place) * len(place)
            if group and (lanes + place[-1].words > LANES or entries + own > ENTRIES or max(most, columns) * (len(group) + 1) > 2 * ENTRIES):
                _measure(group, numbers, out)
                group, lanes, entries, most = [], 0, 0, 0
            group.append(place)
            lanes, entries, most = lanes + place[-1].words, entries + own, max(most, columns)
        _measure(group, numbers, out)
    return out


def _characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _words(a: str, b: str) -> tuple[np.ndarray, np.ndarray]:
    """Words between white space as numbers, the same in both texts for the same word."""
    known: dict[str, int] = {}
    return tuple(np.array([known.setdefault(w, len(known)) for w in _WORD.findall(text)], np.int32) for text in (a, b))


def character_edits(left: Column, right: Column) -> Column:
    """What ``levenshtein`` of two columns gives, for long texts; null if either is null."""

    @F.pandas_udf("int")
    def edits(a: pd.Series, b: pd.Series) -> pd.Series:
        there = (a.notna() & b.notna()).to_numpy()
        out = pd.Series(pd.NA, index=a.index, dtype="Int32")
        out[there] = distances(list(zip(a[there], b[there])), _characters)
        return out

    return edits(left, right)


def word_rate(hypothesis: Column, reference: Column) -> Column:
    """Edits of words by number of reference words, at most 1; without reference words 0 or 1. A null text has no words."""

    @F.pandas_udf("double")
    def rate(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = [_words(x or "", y or "") for x, y in zip(a, b)]
        return pd.Series([min(int(n) / len(y), 1.0) if len(y) else float(len(x) > 0) for n, (x, y) in zip(distances(pairs), pairs)], index=a.index, dtype=float)

    return rate(hypothesis, reference)
