"""Texts as arrays of code points, and hashes of all their windows, for whole batches at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Code points handled in one go; a longer text makes a chunk of its own. Only memory depends on this.
CHUNK = 400_000
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers_for(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK + 1)
        with np.errstate(over="ignore"):
            up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, _BASE, np.uint64))), dtype=np.uint64)
            down = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, _INVERSE, np.uint64))), dtype=np.uint64)
        have = _powers[0] = (up, down)
    return have[0][:n], have[1][:n]


def chunks(texts: Sequence[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, code points of some texts one after the other, their starts and the end)."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= CHUNK):
            size += len(texts[hi])
            hi += 1
        codes = np.frombuffer("".join(texts[lo:hi]).encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.concatenate(([0], np.cumsum([len(t) for t in texts[lo:hi]]))).astype(np.int64)
        yield lo, codes, starts
        lo = hi


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: spreads every bit of the input over the output."""
    with np.errstate(over="ignore"):
        x = x ^ np.uint64(seed)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Prefix:
    """Prefix sums of a polynomial hash; ``windows(width)`` hashes every window of that width."""

    def __init__(self, codes: np.ndarray, seed: int = 0):
        n = len(codes)
        up, self.down = _powers_for(n + 1)
        with np.errstate(over="ignore"):
            values = codes.astype(np.uint64) + np.uint64(1)
            if seed:
                values = mix(values, seed)
            self.sums = np.zeros(n + 1, np.uint64)
            np.cumsum(values * up[:n], out=self.sums[1:])

    def windows(self, width: int) -> np.ndarray:
        n = len(self.sums) - 1
        if n < width:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            return mix((self.sums[width:] - self.sums[: n - width + 1]) * self.down[: n - width + 1])

    def at(self, places: np.ndarray, width: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[places + width] - self.sums[places]) * self.down[places])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, in a number of passes that doesn't depend on ``width``."""
    n = len(x)
    if n < width or width < 1:
        return x[:0]
    top = np.iinfo(x.dtype).max
    blocks = -(-n // width)
    padded = np.full(blocks * width, top, x.dtype)
    padded[:n] = x
    shaped = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(shaped, axis=1).ravel()
    backward = np.minimum.accumulate(shaped[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def inside(starts: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which windows of ``width`` lie within one text."""
    ok = np.ones(max(n - width + 1, 0), bool)
    for edge in starts[1:-1]:
        ok[max(0, edge - width + 1) : edge] = False
    return ok
