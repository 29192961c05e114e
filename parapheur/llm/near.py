"""Which strings of a group have another one within a share of edits: exact, though few pairs are measured.

All pairs of a group whose lengths allow it are looked at by their letters: one edit changes the counts of at most two
letters, and takes and adds at most three triples of characters in a row, so strings that differ by more need no measuring. Both are
compared as bits of machine words. What is left is compared by the places of its triples: those no edit touches stay near theirs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pairs looked at in one go, and partners from which a string is held against all of them at once. Only speed depends on these.
PAIRS, MANY = 500_000, 512
_CLASS = np.array([c - 97 if 97 <= c < 123 else 26 if c == 32 else 27 if c == 35 else 28 + c % 4 for c in range(128)], np.int64)
_LEVELS = np.arange(8)


def within(a: str, b: str, most: int) -> bool:
    """Whether at most ``most`` edits make one string the other (bit vectors of all rows at once)."""
    if abs(len(a) - len(b)) > most:
        return False
    spare = 3 * most
    for i in range(len(a) - 2):
        if b.find(a[i : i + 3], i - most if i > most else 0, i + most + 3) < 0:
            spare -= 1
            if spare < 0:
                return False
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << len(a) >> 1
    up, down, edits, left = full, 0, len(a), len(b)
    for c in b:
        same = places.get(c, 0)
        v = same | down
        h = (((same & up) + up) ^ up) | same
        more, less = down | ~(h | up) & full, up & h
        if more & last:
            edits += 1
        elif less & last:
            edits -= 1
        left -= 1
        if edits - left > most:
            return False
        more, less = more << 1 | 1, less << 1
        up, down = (less | ~(v | more)) & full, more & v & full
    return edits <= most


def _signs(forms: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words a string: bits for every class of characters that it has more than 0, 1, ... 7 times, and for every class of triples."""
    n = len(forms)
    codes = np.frombuffer("".join(forms).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    kind = np.where(codes < 128, _CLASS[np.minimum(codes, 127)], 28 + codes % 4)
    row = np.repeat(np.arange(n), [len(f) for f in forms])
    counts = np.bincount(row * 32 + kind, minlength=n * 32).reshape(-1, 1, 32)
    triples = np.zeros(n * 512, bool)
    whole = row[2:] == row[:-2]
    triples[row[2:][whole] * 512 + ((codes[:-2] * 7919 + codes[1:-1] * 613 + codes[2:] * 37) % 65521 % 512)[whole]] = True
    bits = (counts > _LEVELS[None, :, None]).reshape(n, 256), triples.reshape(n, 512)
    return tuple(np.ascontiguousarray(np.packbits(x, axis=1).view(np.uint64).T) for x in bits)


def near(group: np.ndarray, forms: Sequence[str], lo: np.ndarray, hi: np.ndarray, share: float) -> np.ndarray:
    """Which strings that stand on one page only (``lo`` = ``hi``) have another of their group, on another page, within ``share`` of
    the longer one's length in edits. ``group`` doesn't fall."""
    n = len(forms)
    size = np.array([len(f) for f in forms], np.int64)
    order = np.lexsort((size, group))
    group, size, lo, hi = group[order], size[order], lo[order], hi[order]
    texts = [forms[i] for i in order]
    letters, triples = _signs(texts)
    longest = int(size.max(initial=0))
    least = np.array([m - int(m * share) for m in range(longest + 1)])  # the shortest partner of each length; never falls
    most = np.array([int(m * share) for m in range(longest + 1)])[size]
    width = longest + 1
    end = np.searchsorted(group * width + size, group * width + np.searchsorted(least, size, "right") - 1, "right")
    room, room_triples = 2 * most - size, 6 * most - size  # with the shorter one's length: in how many bits the longer one may differ
    open_ = lo == hi
    found = np.zeros(n, bool)

    def helps(a, b):
        """Whether b may settle a."""
        return open_[a] & ((lo[b] != lo[a]) | (hi[b] != lo[a]))

    def measure(a: np.ndarray, b: np.ndarray) -> None:
        kept = helps(a, b) | helps(b, a)
        a, b = a[kept], b[kept]
        for words, most_bits in ((letters, room), (triples, room_triples)):
            kept = sum(np.bitwise_count(w[a] ^ w[b]).astype(np.int64) for w in words) <= most_bits[b] + size[a]
            a, b = a[kept], b[kept]
        for x, y in zip(a.tolist(), b.tolist()):
            if ((forward := helps(x, y)) | (back := helps(y, x))) and within(texts[x], texts[y], int(most[y])):
                for z, settled in ((x, forward), (y, back)):
                    if settled:
                        found[z], open_[z] = True, False

    first = letters[0]
    partners = end - np.arange(n) - 1
    for x in np.flatnonzero(partners >= MANY):
        y = x + 1 + np.flatnonzero(np.bitwise_count(first[x + 1 : end[x]] ^ first[x]) <= room[x + 1 : end[x]] + size[x])
        measure(np.full(len(y), x), y)
    few = np.flatnonzero((partners > 0) & (partners < MANY))
    upto = np.cumsum(partners[few])
    done = 0
    while done < len(few):
        before = upto[done - 1] if done else 0
        stop = int(np.searchsorted(upto, before + PAIRS, "right"))
        rows = few[done : max(stop, done + 1)]
        count = partners[rows]
        a = np.repeat(rows, count)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)
        kept = np.bitwise_count(first[a] ^ first[b]) <= room[b] + size[a]
        measure(a[kept], b[kept])
        done += len(rows)
    out = np.zeros(n, bool)
    out[order] = found
    return out


def near_rows(batches: Iterator[pa.RecordBatch], groups: Sequence[str], share: float) -> Iterator[pa.RecordBatch]:
    """The rows of (groups..., form, lo, hi), sorted by group, whose form is ``near`` another; a group is held as a whole."""

    def starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        for g in groups:
            c = table.column(g).combine_chunks()
            new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        return new

    def chosen(table: pa.Table, new: np.ndarray) -> Iterator[pa.RecordBatch]:
        lo, hi = (table.column(c).to_numpy() for c in ("lo", "hi"))
        hit = near(np.cumsum(new), table.column("form").to_pylist(), lo, hi, share)
        yield from table.take(pa.array(np.flatnonzero(hit))).to_batches()

    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        new = starts(rest)
        at = np.flatnonzero(new)
        if len(at):
            yield from chosen(rest.slice(0, at[-1]), new[: at[-1]])
            rest = rest.slice(at[-1])
    if rest is not None and rest.num_rows:
        yield from chosen(rest, starts(rest))
