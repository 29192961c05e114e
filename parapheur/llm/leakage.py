"""Problem 6: evaluation passages inside a corpus, by q-gram lemma filtering and banded verification.

A passage is ``min_words`` consecutive words of an item. If it stands in a document with at most ``budget`` edits, the two
share at least L + 1 - q (budget + 1) character q-grams on neighbouring diagonals, L being the passage's length. So the
shared q-grams of a document and an item are counted in bands of diagonals, each band overlapping the next by half; only bands that reach
the bound are kept, and verified by alignment along the band. A budget of 0, equal words, is the narrowest band.

The corpus is scanned once, without a shuffle. The items are the query side: their index is shipped to the executors in
blocks of at most ``BLOCK_CHARS`` characters of item text, one scan of the corpus a block, whatever their number. Blocks follow one
another: the driver and the executors hold one at a time.

Defined results for odd input:
* a budget that the shortest passage of an item cannot bear is refused;
* null, empty and tiny texts and items of fewer than ``min_words`` words match nothing; null items are left out, a null
  document key is returned as it is; texts of any length are read whole;
* repeated rows of documents or items give repeated keys only once; an empty table on either side gives an empty result;
* words are runs of letters and digits; case, accents, width, ligatures, punctuation, spacing and invisible characters do
  not matter, characters that merely look alike do.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parapheur.llm import codes
from parapheur.session import written

#: Characters of item text whose index is shipped at once: about 12 bytes of index each.
BLOCK_CHARS = 2_000_000
#: Shared grams expanded at once.
HITS = 2_000_000
#: Gram lengths tried, the longest first that the lemma allows for an item.
GRAMS = (48, 24, 12, 6, 3, 1)
_HIDDEN = regex.compile(r"[\p{M}\p{Cf}]+")
_GAP = re.compile(r"[\W_]+")


def plain_words(text: str) -> str:
    """The words of a text in one form, each between single blanks, with a blank at either end."""
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKD", text)).casefold()
        if not text.isascii():
            text = _HIDDEN.sub("", unicodedata.normalize("NFKD", text))
    else:
        text = text.lower()
    return f" {_GAP.sub(' ', text).strip()} "


class ItemIndex:
    """The q-grams of a block of items, by gram length."""

    def __init__(self, items: list[tuple[object, str]], min_words: int, budget: int):
        self.min_words, self.budget = min_words, budget
        self.keys, self.codes, self.blanks, bounds, by_gram = [], [], [], [], {}
        for key, text in items:
            text = plain_words(text)
            blanks = [i for i, c in enumerate(text) if c == " "]
            if len(blanks) <= min_words:
                continue
            least = min(b - a + 1 for a, b in zip(blanks, blanks[min_words:]))
            gram = next((q for q in GRAMS if least + 1 - q * (budget + 1) >= 1), None)
            if gram is None:
                raise ValueError(f"a passage of {least} characters is too short for {budget} edits")
            bounds.append(least + 1 - gram * (budget + 1))
            by_gram.setdefault(gram, []).append(len(self.keys))
            self.keys.append(key)
            self.codes.append(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64))
            self.blanks.append(np.array(blanks))
        self.bounds = np.array(bounds, np.int64)
        self.grams: dict[int, tuple] = {}
        for gram, members in by_gram.items():
            hashes, owner, place = [], [], []
            for m in members:
                h = codes.Prefix(self.codes[m]).windows(gram)
                hashes.append(h)
                owner.append(np.full(len(h), m))
                place.append(np.arange(len(h)))
            h, owner, place = map(np.concatenate, (hashes, owner, place))
            order = np.argsort(h, kind="stable")
            distinct, first, count = np.unique(h[order], return_index=True, return_counts=True)
            seen = np.zeros(1 << 20, bool)
            seen[(distinct >> np.uint64(44)).astype(np.int64)] = True
            self.grams[gram] = (distinct, first, count, owner[order], place[order], seen)


def _hits(index: ItemIndex, text_codes: np.ndarray, starts: np.ndarray):
    """(document, item, diagonal) of every gram that a document shares with an item."""
    prefix = codes.Prefix(text_codes)
    for gram, (distinct, first, count, owner, place, seen) in index.grams.items():
        w = prefix.windows(gram)
        at = np.flatnonzero(seen[(w >> np.uint64(44)).astype(np.int64)])
        if not len(at):
            continue
        spot = np.minimum(np.searchsorted(distinct, w[at]), len(distinct) - 1)
        good = distinct[spot] == w[at]
        at, spot = at[good], spot[good]
        doc = np.searchsorted(starts, at, "right") - 1
        whole = at + gram <= starts[doc + 1]
        at, spot, doc = at[whole], spot[whole], doc[whole]
        if not len(at):
            continue
        many = count[spot]
        reached = np.cumsum(many)
        for lo, hi in _slices(doc, reached):  # a gram of many items is expanded for some documents at a time
            n, before = many[lo:hi], reached[lo] - many[lo]
            row = np.repeat(first[spot[lo:hi]], n) + np.arange(n.sum()) - np.repeat(reached[lo:hi] - n - before, n)
            yield np.repeat(doc[lo:hi], n), owner[row], np.repeat(at[lo:hi] - starts[doc[lo:hi]], n) - place[row]


def _slices(doc: np.ndarray, reached: np.ndarray) -> Iterator[tuple[int, int]]:
    """Parts of the hits that hold whole documents and about ``HITS`` expanded hits, or one document."""
    ends = np.append(np.flatnonzero(doc[1:] != doc[:-1]) + 1, len(doc))
    lo = 0
    while lo < len(doc):
        done = reached[lo - 1] if lo else 0
        fits = ends[(ends > lo) & (reached[ends - 1] - done <= HITS)]
        hi = int(fits[-1]) if len(fits) else int(ends[ends > lo][0])
        yield lo, hi
        lo = hi


def _within_budget(document: np.ndarray, item: np.ndarray, blanks: np.ndarray, low: int, high: int, min_words: int, budget: int) -> bool:
    """Banded alignment: whether some passage of the item stands in the document on diagonals low..high with few edits.

    All passages are aligned at once, a character a step; each has a row with the fewest edits of what was read of it, ending on
    every diagonal of the band. A passage may begin anywhere in the band.
    """
    first, last = blanks[:-min_words], blanks[min_words:] + 1
    low, width = low - budget, high - low + 2 * budget + 1
    padded = np.full(len(item) + width + abs(low) + len(document) + 1, -1, np.int64)  # document[j] stands at j + shift; -1 is no character
    shift = max(0, -low)
    padded[shift : shift + len(document)] = document
    best = np.zeros((len(first), width), np.int32)
    steps, alive = np.arange(width), np.arange(len(first))
    for n in range(int((last - first).max())):
        ended = first[alive] + n >= last[alive]
        if ended.any():
            if (best[ended].min(axis=1) <= budget).any():
                return True
            best, alive = best[~ended], alive[~ended]
        at = first[alive] + n
        now = best + (padded[np.clip(at[:, None] + low + steps + shift, 0, len(padded) - 1)] != item[at][:, None])
        now[:, :-1] = np.minimum(now[:, :-1], best[:, 1:] + 1)  # the character is missing in the document
        now = np.minimum.accumulate(now - steps, axis=1) + steps  # the document has some more
        near = now.min(axis=1) <= budget
        best, alive = now[near], alive[near]
        if not len(alive):
            return False
    return bool((best.min(axis=1) <= budget).any())


def leaked(batch_texts: list[str], index: ItemIndex) -> list[tuple[int, int]]:
    """(place of the text, place of the item) of every text that holds a passage of an item."""
    step, found = index.budget + 1, []
    plain = [plain_words(t) for t in batch_texts]
    for base, text_codes, starts in codes.chunks(plain):
        seen: set[tuple[int, int]] = set()
        for doc, item, diagonal in _hits(index, text_codes, starts):
            low = diagonal // step
            trio = np.concatenate([np.stack([doc, item, low]), np.stack([doc, item, low - 1])], axis=1)  # every diagonal lies in two bands
            kept, shared = np.unique(trio, axis=1, return_counts=True)
            kept = kept[:, shared >= index.bounds[kept[1]]]
            for d, i, band in kept.T.tolist():
                if (d, i) not in seen and _within_budget(
                    text_codes[starts[d] : starts[d + 1]], index.codes[i], index.blanks[i], band * step, (band + 2) * step - 1, index.min_words, index.budget
                ):
                    seen.add((d, i))
                    found.append((base + d, i))
    return found


def item_blocks(items: DataFrame, item_key: str, item_text: str, block_chars: int) -> list[DataFrame]:
    """The items cut into blocks whose text, and so whose index, has a bounded size."""
    items = items.select(F.col(item_key).alias("_item"), F.col(item_text).alias("_text")).where("_text IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.length("_text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_chars))
    if blocks == 1:
        return [items]
    block = F.pmod(F.xxhash64("_item", "_text"), F.lit(blocks))
    return [items.where(block == b) for b in range(blocks)]


def contaminated(
    documents: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    min_words: int = 12,
    budget: int = 0,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(key, item key) of every document that contains ``min_words`` consecutive words of an item, up to ``budget`` edits."""
    spark = documents.sparkSession
    key_type, item_type = documents.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    corpus = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where("length(_text) >= 2")
    parts, blocks = [], item_blocks(items, item_key, item_text, block_chars)
    for block in blocks:
        index = ItemIndex([(r["_item"], r["_text"]) for r in block.collect()], min_words, budget)
        shipped = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            index = shipped.value
            ids = pa.array(index.keys) if index.keys else None
            for batch in batches:
                if ids is None:
                    continue
                found = leaked(batch.column(1).to_pylist(), index)
                if found:
                    at, of = zip(*found)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), ids.take(pa.array(of))], names=["_key", "_item"])

        part = corpus.mapInArrow(run, f"_key {key_type}, _item {item_type}")
        if len(blocks) > 1:
            part = written(part.distinct(), "leaks")
            shipped.destroy()
        parts.append(part)
    return reduce(DataFrame.unionByName, parts).distinct().select(F.col("_key").alias(key), F.col("_item").alias(item_key))


def leak_report(found: DataFrame, items: DataFrame, item_key: str = "item_id") -> DataFrame:
    """For every test item, in how many documents it leaked; 0 for clean ones."""
    counted = found.groupBy(item_key).agg(F.count(F.lit(1)).alias("n_documents"))
    return items.select(item_key).distinct().join(counted, item_key, "left").select(item_key, F.coalesce("n_documents", F.lit(0)).alias("n_documents"))
