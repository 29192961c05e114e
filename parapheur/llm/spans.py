"""Problem 8: long exact spans shared between records, by paragraph MinHash banding.

Spans keep to no line break, so paragraphs are cut by content: a cut is a place whose ``gram`` characters have the least hash among
its neighbours. Two texts that share a span cut it at the same places, and every span of ``length`` characters holds at least one
whole paragraph. A paragraph's signature is its MinHash over character shingles, ``rows`` minima a band, ``bands`` bands. The
paragraphs of a common span are equal, their Jaccard similarity is 1, so with any number of rows and a single band they collide:
recall is 1 by construction. More rows and longer shingles only keep paragraphs that are merely alike from being compared: letters
written from one template differ in a few characters a paragraph.

Texts whose paragraphs collide are verified exactly: every window of ``length`` characters that holds nothing but such paragraphs is
hashed (96 bits), and equal windows are grouped. No text is compared with another, so the work grows with the text that is shared and not with
the pairs of texts that share it. Links are clustered by connected components; removals by components of texts whose windows
have a Jaccard similarity of at least ``similarity``.

Texts that are equal as a whole are one class and are read once.

Defined results for odd input:
* null texts and texts shorter than ``length`` share nothing; equal texts of at least ``length`` share all of it;
* repeated rows under one key are one document and make no pair; a null key is left out of pairs;
* lone surrogates and any other characters are compared as they are, without normalisation;
* an empty table gives empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parapheur.llm import codes
from parapheur.llm.components import connected_components
from parapheur.session import written

LENGTH, GRAM, SHINGLE = 300, 128, 64
BANDS, ROWS = 1, 4
SIMILARITY = 0.8
_CLASS = ["c1", "c2"]


class Cutter:
    """Paragraphs of many texts at once and their band signatures."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS):
        if not 0 < gram < length or gram + 2 > length:
            raise ValueError("gram must be at least two shorter than length")
        self.length, self.gram, self.shingle, self.bands, self.rows = length, gram, min(shingle, gram), bands, rows
        self.reach = (length - gram + 1) // 2  # two cuts lie within every length characters

    def cuts(self, prefix: codes.Prefix, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places of the cuts, hashes of all places, least hash of every ``reach`` neighbours or 0 across two texts)."""
        n, least = int(starts[-1]), self.reach + self.gram - 1
        h = prefix.windows(self.gram)
        if n < least:
            return np.zeros(0, np.int64), h, h[:0]
        low = np.where(codes.inside(starts, n, least), codes.sliding_min(h, self.reach), np.uint64(0))
        edge = np.zeros(self.reach - 1, np.uint64)
        best = ~codes.sliding_min(~np.concatenate([edge, low, edge]), self.reach)
        return np.flatnonzero((best == h) & (h > 0)), h, low

    def signed(self, prefix: codes.Prefix, first: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        """A signature array a band of the paragraphs at ``first``."""
        ends = np.stack([first, first + size - self.shingle + 1], axis=1).ravel()
        shingles = np.append(prefix.windows(self.shingle), np.uint64(0))
        found = []
        for band in range(self.bands):
            signature = np.full(len(first), np.uint64(band + 1))
            for row in range(self.rows):
                value = codes.mix(shingles, seed=0x9E3779B9 * (band * self.rows + row + 1))
                signature = codes.mix(signature * np.uint64(0x9E3779B97F4A7C15) ^ np.minimum.reduceat(value, ends)[::2])
            found.append(signature)
        return found

    def paragraphs(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """(place of the text, start, size, a signature array a band) of the paragraphs of some texts at a time."""
        for base, text_codes, starts in codes.chunks(texts):
            prefix = codes.Prefix(text_codes)
            at, _, _ = self.cuts(prefix, starts)
            owner = np.searchsorted(starts, at, "right") - 1
            one = owner[1:] == owner[:-1]
            first, owner = at[:-1][one], owner[:-1][one]
            if len(first):
                size = at[1:][one] + self.gram - first
                yield base + owner, first - starts[owner], size, self.signed(prefix, first, size)

    def candidate_windows(self, text_codes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Starts of the windows of ``length`` all of whose certain paragraphs have a signature in ``wanted``.

        Certain are those between the first and the last cut that the window itself decides; texts that share it have the same ones.
        """
        prefix = codes.Prefix(text_codes)
        at, h, low = self.cuts(prefix, np.array([0, len(text_codes)]))
        if len(at) < 2 or len(text_codes) < self.length:
            return np.zeros(0, np.int64)
        good = np.logical_or.reduce([np.isin(signature, wanted) for signature in self.signed(prefix, at[:-1], at[1:] + self.gram - at[:-1])])
        unmet = np.concatenate([[0], np.cumsum(~good)])
        s = np.arange(len(text_codes) - self.length + 1)
        last = s + (self.length - self.gram + 1) - self.reach
        i, j = np.searchsorted(at, s), np.searchsorted(at, last + self.reach) - 1
        while (off := h[at[i]] != low[s]).any():
            i[off] += 1
        while (off := h[at[j]] != low[last]).any():
            j[off] -= 1
        return s[unmet[j] == unmet[i]]


def signatures(classes: DataFrame, cutter: Cutter) -> DataFrame:
    """(sig, c1, c2) of texts given as (text, c1, c2), each once a text; the number of the band is part of ``sig``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for owner, _, _, found in cutter.paragraphs(batch.column(0).to_pylist()):
                for signature in found:
                    once = np.unique(np.stack([owner.astype(np.uint64), signature]), axis=1)
                    take = pa.array(once[0].astype(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(once[1].view(np.int64)), batch.column(1).take(take), batch.column(2).take(take)], names=["sig", *_CLASS])

    return classes.select("text", *_CLASS).mapInArrow(run, "sig BIGINT, c1 BIGINT, c2 BIGINT")


def windows_around(texts: DataFrame, cutter: Cutter) -> DataFrame:
    """(w1, w2, rep, start, again) of the candidate windows of texts given as (text, rep, sigs).

    ``w1``, ``w2`` hash the window (96 bits), ``again`` says that it stands earlier in the same text.
    """
    length, kind = cutter.length, texts.schema["rep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (text, sigs) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                text_codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                s = cutter.candidate_windows(text_codes, np.array(sigs, np.int64).view(np.uint64))
                if not len(s):
                    continue
                one, two = (codes.Prefix(text_codes, seed=seed).at(s, length) for seed in (0, 0x5BD1E995))
                again = np.ones(len(s), bool)
                again[np.unique(one, return_index=True)[1]] = False
                for lo in range(0, len(s), 50_000):
                    part = slice(lo, lo + 50_000)
                    take = pa.array(np.full(len(s[part]), i))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(one[part].view(np.int64)), pa.array((two[part] >> np.uint64(32)).astype(np.uint32).view(np.int32)), batch.column(1).take(take), pa.array(s[part].astype(np.int32)), pa.array(again[part])],
                        names=["w1", "w2", "rep", "start", "again"],
                    )

    return texts.select("text", "rep", "sigs").mapInArrow(run, f"w1 BIGINT, w2 INT, rep {kind}, start INT, again BOOLEAN")


class SharedSpans:
    """The links between the texts of a table; the results below are all drawn from them, and nothing is read before one is asked for.

    Tables that decide what else is read (shared signatures, passages) are written first: Spark then knows their size and joins
    them by broadcast only where that is below its threshold.
    """

    def __init__(self, documents: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, bands: int = BANDS, rows: int = ROWS):
        self.length, self.cutter = length, Cutter(length, gram, bands=bands, rows=rows)
        self.all_documents = documents.select(F.col(key).alias("id"), F.col(text).alias("text"))
        self.hashed = self.all_documents.where(F.length("text") >= length).where("id IS NOT NULL").select("id", "text", F.xxhash64("text").alias("c1"), F.xxhash64(F.lit(7), "text").alias("c2"))
        self.members = self.hashed.select("id", *_CLASS).distinct()
        self.classes = self.members.groupBy(*_CLASS).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))

    @cached_property
    def candidates(self) -> DataFrame:
        """(w1, w2, rep, start, again): windows around paragraphs that collide with those of another class."""
        occurrences = written(signatures(self.hashed, self.cutter), "signatures")
        # a signature in texts of one class only has equal smallest and largest c1; both are kept on the map side
        shared = written(occurrences.groupBy("sig").agg(F.min("c1").alias("lo"), F.max("c1").alias("hi")).where("lo <> hi").select("sig"), "shared")
        met = occurrences.join(shared, "sig").groupBy("c1").agg(F.collect_set("sig").alias("sigs"))  # bounded by the text
        wanted = written(met.join(self.classes, "c1").select(F.col("rep").alias("id"), *_CLASS, "sigs"), "wanted")
        texts = self.hashed.join(wanted, ["id", *_CLASS]).dropDuplicates(["id", *_CLASS])
        return written(windows_around(texts.withColumnRenamed("id", "rep"), self.cutter), "windows")

    @cached_property
    def sets(self) -> DataFrame:
        """(w1, w2, n, mark): windows that stand in texts of several classes, how many, and a fingerprint of these classes."""
        first = self.candidates.where("NOT again")
        return first.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("rep")).alias("mark")).where("n > 1")

    @cached_property
    def links(self) -> DataFrame:
        """(rep_a, rep_b, common): pairs of classes and how many windows they have in common.

        Windows that stand in the same classes are expanded once, with their number: a passage of any length counts as one.
        """
        once = written(self.sets.groupBy("n", "mark").agg(F.min(F.struct("w1", "w2")).alias("w"), F.count(F.lit(1)).alias("common")).select("w.w1", "w.w2", "common"), "passages")
        held = self.candidates.where("NOT again").select("w1", "w2", "rep").join(once, ["w1", "w2"])
        both = held.withColumnRenamed("rep", "rep_a").join(held.select("w1", "w2", F.col("rep").alias("rep_b")), ["w1", "w2"])
        return both.where("rep_a < rep_b").groupBy("rep_a", "rep_b").agg(F.sum("common").alias("common"))

    def pairs(self) -> DataFrame:
        """(doc_id_a, doc_id_b) of every two documents with a span in common, the smaller key first."""
        member = self.membership()
        a, b = member.select(F.col("doc_id").alias("a"), F.col("rep").alias("rep_a")), member.select(F.col("doc_id").alias("b"), F.col("rep").alias("rep_b"))
        across = self.links.join(a, "rep_a").join(b, "rep_b").select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b"))
        copies = self.members.join(self.classes.where("n > 1"), _CLASS).select(*_CLASS, F.col("id").alias("a"))
        within = copies.join(copies.withColumnRenamed("a", "b"), _CLASS).where("a < b").select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))
        return across.unionByName(within)

    def class_pairs(self) -> DataFrame:
        """(rep_a, rep_b) between class representatives; with ``membership`` this says all that ``pairs`` does."""
        return self.links.select("rep_a", "rep_b")

    def membership(self) -> DataFrame:
        """(doc_id, rep): the class of every document of at least ``length`` characters."""
        return self.members.join(self.classes, _CLASS).select(F.col("id").alias("doc_id"), "rep")

    def _class_stretches(self) -> DataFrame:
        """(rep, start, stop): maximal stretches of a class's text that stand in texts of other classes too."""
        starts = self.candidates.join(self.sets.select("w1", "w2"), ["w1", "w2"]).select("rep", "start").distinct()
        order = Window.partitionBy("rep").orderBy("start")  # bounded by the text
        fresh = F.when(F.col("start") <= F.lag("start").over(order) + self.length, 0).otherwise(1)
        island = starts.withColumn("_new", fresh).withColumn("_island", F.sum("_new").over(order))
        return island.groupBy("rep", "_island").agg(F.min("start").alias("start"), (F.max("start") + self.length).alias("stop")).drop("_island")

    def stretches(self) -> DataFrame:
        """(doc_id, start, size): stretches of a document that also stand in other documents; a copy is one stretch."""
        alone = self.classes.where("n = 1").select("rep")
        own = self._class_stretches().join(alone, "rep").select(F.col("rep").alias("doc_id"), "start", (F.col("stop") - F.col("start")).alias("size"))
        ids = self.members.join(self.classes.where("n > 1"), _CLASS).select("id")
        lengths = self.all_documents.select("id", F.length("text").alias("size")).where("id IS NOT NULL")
        whole = lengths.join(ids, "id").groupBy("id").agg(F.max("size").alias("size"))
        return own.unionByName(whole.select(F.col("id").alias("doc_id"), F.lit(0).alias("start"), "size"))

    def shares(self) -> DataFrame:
        """One row a document: characters, characters shared elsewhere, and their share (null for null texts)."""
        shared = self.stretches().groupBy("doc_id").agg(F.sum("size").alias("shared_chars"))
        docs = self.all_documents.select(F.col("id").alias("doc_id"), F.length("text").alias("n_chars"))
        out = docs.join(shared, "doc_id", "left").withColumn("shared_chars", F.when(F.col("n_chars").isNotNull(), F.coalesce("shared_chars", F.lit(0))))
        return out.withColumn("shared_part", F.when(F.col("n_chars") > 0, F.round(F.col("shared_chars") / F.col("n_chars"), 6)).otherwise(F.col("shared_chars").cast("double")))

    def class_rows(self) -> DataFrame:
        """One row a document of at least ``length`` characters: its class (the least of its copies), how many copies that has, and with how many other classes it shares a span."""
        ends = self.links.select(F.explode(F.array("rep_a", "rep_b")).alias("rep"))
        linked = ends.groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
        out = self.members.join(self.classes, _CLASS).join(linked, "rep", "left")
        return out.select(F.col("id").alias("doc_id"), "rep", F.col("n").alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"))

    def _grouped(self, edges: DataFrame) -> DataFrame:
        """(doc_id, rep, n, component): every document with the component of its class in ``edges`` (a, b)."""
        component = connected_components(edges)
        members = self.members.join(self.classes, _CLASS).select(F.col("id").alias("doc_id"), "rep", "n")
        return members.join(component.withColumnRenamed("node", "rep"), "rep", "left").withColumn("cluster", F.coalesce("component", "rep"))

    def clusters(self) -> DataFrame:
        """(doc_id, rep, cluster): class and component of every document that shares a span with another.

        Each class is linked to the least class of every passage it holds, so no pairs are formed.
        """
        windows = self.candidates.where("NOT again")
        least = windows.groupBy("w1", "w2").agg(F.min("rep").alias("b"), F.max("rep").alias("hi")).where("b <> hi").select("w1", "w2", "b")
        star = windows.join(least, ["w1", "w2"]).select(F.col("rep").alias("a"), "b").where("a <> b").distinct()
        return self._grouped(star).where("n > 1 OR component IS NOT NULL").select("doc_id", "rep", "cluster")

    def removals(self, similarity: float = SIMILARITY) -> DataFrame:
        """(doc_id, rep, cluster, keep) of every document of at least ``length`` characters.

        Two texts are alike if the Jaccard similarity of their windows is at least ``similarity``; of every component of such texts
        and their copies the least document is kept.
        """
        sizes = self.hashed.groupBy(*_CLASS).agg(F.min("id").alias("rep_a"), F.max(F.length("text") - self.length + 1).alias("n_a")).select("rep_a", "n_a")
        pairs = self.links.join(sizes, "rep_a").join(sizes.toDF("rep_b", "n_b"), "rep_b")
        alike = pairs.where(F.col("common") >= F.lit(similarity) * (F.col("n_a") + F.col("n_b") - F.col("common")))
        out = self._grouped(alike.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")))
        return out.select("doc_id", "rep", "cluster", (F.col("doc_id") == F.col("cluster")).alias("keep"))
