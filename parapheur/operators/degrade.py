"""Reproducible recognition noise, to measure how robust extraction is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters and what noise puts in their place.
CONFUSIONS = {"e": "c", "o": "0", "l": "1", "i": "1", "a": "@", "s": "5", "n": "m", "m": "rn", "é": "e"}


def degraded(text: Column, key: Column, rate: float = 0.05) -> Column:
    """The text with about ``rate`` of its confusable characters replaced; a hash of key and place decides, so a rerun gives the same."""
    table = F.create_map(*[F.lit(x) for kv in CONFUSIONS.items() for x in kv])
    hit = lambda i: F.pmod(F.xxhash64(key, i), F.lit(10_000)) < int(rate * 10_000)
    noisy = F.transform(F.split(text, ""), lambda c, i: F.when(hit(i), F.coalesce(F.try_element_at(table, c), c)).otherwise(c))
    return F.array_join(noisy, "")
