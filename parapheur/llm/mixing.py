"""Problem 7: mixing sources to target weights by cube-method balanced sampling.

Sizes are tokens of a public tokenizer. The mixture is as large as the targets, the repeat limits and the sources allow: the
source that runs out first at its limit sets the total. Every document of a source is then wanted r times on average, r being
the same within the source: it is taken floor(r) times for sure and once more with probability r - floor(r). Which documents
are taken once more is decided by the cube method: inclusion probabilities move through the null space of the balancing
constraints (number of documents, number of tokens), a few documents at a time, until all but a few are 0 or 1.

The flight runs in blocks of at most about ``BLOCK`` documents, hot sources being cut into as many as they need; what is left
undecided in the blocks (two documents each at most) flies again in blocks, until the last two of a source remain. These land by
dropping the constraints, so that every document keeps exactly its inclusion probability; the smallest ones fly last, and what the
tokens of a source miss their goal by is less than one of those.

Defined results for odd input:
* null, empty and token-less texts have no size and are never chosen; null sources and sources without a target are left out;
* a target source without documents gets nothing, and the other targets are scaled to add up to 1 (see ``shares``);
* targets of 0 or less and limits below 1 mean none of the source; several targets of one source count as one (the shares
  added, the least limit); repeated documents are chosen independently; empty tables give empty results.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parapheur.session import written

#: Where the vocabulary files of public tokenizers lie.
TOKENIZERS = os.environ.get("PARAPHEUR_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: how text is split before the merges of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents whose flight one task holds at a time.
BLOCK = 20_000
#: The smallest documents of a block come last in its flight.
SMALL = 50
#: A text is encoded in pieces of about so many characters, cut where no token crosses: before a blank between two letters.
PIECE = 100_000
_CUT = re.compile(r"[^\W\d_] (?=[^\W\d_])")


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def n_tokens(text: str, path: str) -> int:
    coder, total, lo = encoding(path), 0, 0
    text = text.encode("utf-8", "replace").decode("utf-8")  # lone surrogates have no bytes
    while len(text) - lo > PIECE:
        m = _CUT.search(text, lo + PIECE - 1)  # the first such place from there on; a text without one is encoded as a whole
        if not m:
            break
        total += len(coder.encode_ordinary(text[lo : m.start() + 1]))
        lo = m.start() + 1
    return total + len(coder.encode_ordinary(text[lo:]))


def token_counts(df: DataFrame, text: str, keep: list[str], path: str) -> DataFrame:
    """``keep`` and n_tokens of every row with a text."""
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [n_tokens(t, path) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(sizes, pa.int64())], names=[*keep, "n_tokens"])

    return df.where(F.col(text) != "").select(*keep, text).mapInArrow(run, f"{fields}, n_tokens BIGINT")


def flight(p: np.ndarray, sizes: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Fast flight phase: p with all but two entries at most moved to 0 or 1, keeping the sums of p and of p * size.

    Entries come in random order but for the last, which are the smallest: what stays open is small.
    """
    p = p.copy()
    open_ = random.permutation(np.flatnonzero((p > 1e-9) & (p < 1 - 1e-9)))
    small = np.argsort(sizes[open_], kind="stable")[:SMALL]
    open_ = np.concatenate([np.delete(open_, small), open_[small[::-1]]]).tolist()
    p, sizes = p.tolist(), sizes.tolist()
    chance = iter(random.random(len(open_) + 1).tolist())
    hand, rest = open_[:3], iter(open_[3:])
    while len(hand) == 3:
        i, j, k = hand
        u = (sizes[j] - sizes[k], sizes[k] - sizes[i], sizes[i] - sizes[j])  # sums to 0, and so does u * size
        if not any(u):
            u = (1.0, -1.0, 0.0)
        q = (p[i], p[j], p[k])
        up = min((1 - x) / d if d > 0 else -x / d for x, d in zip(q, u) if d)
        down = min(x / d if d > 0 else (x - 1) / d for x, d in zip(q, u) if d)
        step = up if next(chance) * (up + down) < down else -down
        hand = []
        for at, x, d in zip((i, j, k), q, u):
            x += step * d
            p[at] = 0.0 if x < 1e-9 else 1.0 if x > 1 - 1e-9 else x
            if 0 < p[at] < 1:
                hand.append(at)
        while len(hand) < 3 and (i := next(rest, None)) is not None:
            hand.append(i)
    return np.array(p)


def landing(p: np.ndarray, sizes: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """The open entries set to 0 or 1 by dropping constraints one after the other, so that every entry keeps its chance.

    First the number of documents is given up and two entries at a time move along equal tokens; the last one is drawn.
    """
    p = p.copy()
    open_ = [i for i in range(len(p)) if 0 < p[i] < 1]
    while len(open_) > 1:
        i, j = open_[:2]
        u = np.array([sizes[j], -sizes[i]], float)
        q = p[[i, j]]
        up = min((1 - q[0]) / u[0], q[1] / -u[1])
        down = min(q[0] / u[0], (1 - q[1]) / -u[1])
        q = q + up * u if random.random() * (up + down) < down else q - down * u
        q[q < 1e-9], q[q > 1 - 1e-9] = 0.0, 1.0
        p[[i, j]] = q
        open_ = [i for i in open_ if 0 < p[i] < 1]
    if open_:
        p[open_[0]] = float(random.random() < p[open_[0]])
    return p


def _seed(*parts) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "big")


class Mixture:
    """Documents chosen so that each source makes up its target share of all tokens."""

    def __init__(self, documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", tokenizers: str = TOKENIZERS, seed: int = 0, block: int = BLOCK):
        self.key = key
        path = os.path.join(tokenizers, VOCABULARY)
        wanted = targets.where("source IS NOT NULL").groupBy("source").agg(F.sum(F.greatest("target_share", F.lit(0.0))).alias("target_share"), F.min("max_repeats").alias("max_repeats"))
        docs = documents.select(F.col(key).alias("_id"), "source", F.col(text).alias("_text")).join(wanted.select("source"), "source", "left_semi")
        self.sizes = written(token_counts(docs, "_text", ["_id", "source"], path).where("n_tokens > 0"), "tokens")
        have = self.sizes.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"), F.count(F.lit(1)).alias("available_docs"))
        plan = wanted.join(have, "source", "left").fillna(0, ["available_tokens", "available_docs"])
        usable = (F.col("available_tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") >= 1)
        plan = plan.withColumn("_share", F.when(usable, F.col("target_share")).otherwise(0.0))
        totals = plan.agg(F.sum("_share").alias("sum"), F.min(F.when(usable, F.col("max_repeats") * F.col("available_tokens") / F.col("_share"))).alias("room")).first()
        whole, room = totals["sum"] or 0.0, totals["room"] or 0.0
        plan = plan.withColumn("goal_share", F.col("_share") / whole if whole > 0 else F.lit(0.0)).withColumn("goal_tokens", F.col("goal_share") * F.lit(room * whole))
        rate = F.when(usable, F.least(F.col("goal_tokens") / F.col("available_tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0)
        self.plan = written(plan.withColumn("rate", rate).drop("_share"), "plan")
        self._choose(seed, block)

    def _choose(self, seed: int, block: int) -> None:
        # the plan has a row a target source; counts are exact, rates within 1e-9 of a whole number are that number
        rate = self.plan.select("source", F.when(F.abs(F.col("rate") - F.round("rate")) < 1e-9, F.round("rate")).otherwise(F.col("rate")).alias("rate"), F.greatest(F.lit(1), F.ceil(F.col("available_docs") / block)).alias("_blocks"))
        units = self.sizes.join(rate, "source").select(
            "_id", "source", "n_tokens", F.floor("rate").cast("int").alias("sure"), (F.col("rate") - F.floor("rate")).alias("p"), F.pmod(F.xxhash64("_id", "n_tokens", F.lit(seed)), F.col("_blocks")).alias("_block")
        )
        whole = units.where("p <= 0").select("_id", "source", "n_tokens", "sure", F.col("p"))
        open_ = units.where("p > 0")
        done = [whole]
        turn, last = 0, False
        while not last:  # a block leaves two documents at most, so the number of turns is the logarithm of the documents
            last = open_.groupBy("source").agg(F.max("_block").alias("n")).where("n > 0").isEmpty()
            flown = written(self._fly(open_, seed + turn, last), "flight")
            done.append(flown.where("p <= 0 OR p >= 1").select("_id", "source", "n_tokens", "sure", "p"))
            turn += 1
            left = flown.where("p > 0 AND p < 1")
            blocks = left.groupBy("source").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / block)).alias("_blocks"))
            open_ = left.join(blocks, "source").withColumn("_block", F.pmod(F.xxhash64("_id", "n_tokens", F.lit(seed + turn)), F.col("_blocks"))).drop("_blocks")
        chosen = done[0]
        for more in done[1:]:
            chosen = chosen.unionByName(more)
        self.chosen = chosen.withColumn("copies", F.col("sure") + F.col("p").cast("int")).where("copies > 0")

    def _fly(self, units: DataFrame, seed: int, last: bool) -> DataFrame:
        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["n_tokens", "_id"], kind="stable", ignore_index=True)
            random = np.random.default_rng(_seed(seed, *map(str, key)))
            p, sizes = rows["p"].to_numpy(float), rows["n_tokens"].to_numpy(float)
            p = flight(p, sizes, random)
            return rows.assign(p=landing(p, sizes, random) if last else p)

        schema = units.select("_id", "source", "n_tokens", "sure", "p", "_block").schema
        return units.select("_id", "source", "n_tokens", "sure", "p", "_block").groupBy("source", "_block").applyInPandas(run, schema)

    def selection(self) -> DataFrame:
        """(key, source, n_tokens, copies) of every document used, copies being how often."""
        return self.chosen.select(F.col("_id").alias(self.key), "source", "n_tokens", "copies")

    def shares(self) -> DataFrame:
        """One row a target source: target and actual share, tokens, documents and how often the most used one is taken."""
        used = self.chosen.groupBy("source").agg(
            F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"), F.count(F.lit(1)).alias("used_docs"), F.sum("copies").alias("used_copies"), F.max("copies").alias("most_copies")
        )
        out = self.plan.join(used, "source", "left").fillna(0, ["used_tokens", "used_docs", "used_copies", "most_copies"])
        total = self.chosen.agg(F.sum(F.col("n_tokens") * F.col("copies"))).first()[0] or 0
        share = F.col("used_tokens") / total if total else F.lit(0.0)
        return out.select(
            "source", "target_share", "goal_share", share.alias("actual_share"), "max_repeats", "available_tokens", "available_docs", "used_tokens", "used_docs", "used_copies", "most_copies"
        )
