"""Problem 5: noise in text from scanned pages, found a line and repaired into continuous paragraphs.

Headers and footers are lines at page edges that come back on another page of the document: in loose form (no case, spacing, numbers
or misreadings), or within a few edits of it. Lines that might as well be text (a sentence's end, very few letters) must come back at
the same place of most pages. Where all lines of an edge come back, the edge goes on as far as they do. Page numbers are lines at the
edges that hold nothing else and give the page, or that form a sequence over the pages of the document, in figures, Roman or words. Words cut at line ends and words with
misread characters are decided by the corpus vocabulary: the counts of all words, and of all words written with a hyphen,
within lines.

The vocabulary stays distributed. A fixed number of its most frequent sound words (``FREQUENT``) is shipped to the executors
only to keep them from asking about these; every other word of every line is looked up by a join.

Defined results for odd input:
* null and empty columns have no lines with noise and come out as they are; texts of any length are read whole;
* a row whose page number is null takes no part in header detection and has only page numbers that name a page;
* lines that are rows of ``tables`` are no case and are kept apart; where ``tables`` is null or empty no line is a table's;
* repeated scans of one page count as that page; repeated rows give repeated keys only once; no rows, no result.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain, combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from parapheur.llm.canonical import ODD, TO_LATIN, fold
from parapheur.llm.near import near_rows
from parapheur.llm.scan import MISREAD, SIGNS, tolerant
from parapheur.session import written

COLUMNS = ("raw_text", "body_text_no_tables")
#: Sound words shipped to the executors: at most this many, so some hundred kB whatever the corpus.
FREQUENT = 20_000
#: Lines that an edge of a page has at least; where all of them come back, it goes on (see ``ScannedPages.deep_headers``).
EDGE = 4
#: Edits, as a share of a form's length, within which two lines of one document are the same header.
FUZZY = 0.15
#: Forms of a document that are compared in one place; more are dealt into blocks, all pairs of which are compared.
BLOCK = 20_000
#: A word is a misreading of another that is at least so many times as frequent.
TIMES = 10

_LATIN = str.maketrans(TO_LATIN)
_MAIL = re.compile(r"\S*@[\w-]*\.\S+|\S+\s*[\[(]\s*(?:at|arobase)\s*[\])]\s*\S+(?:\s+(?:point|dot)\s+\S+)*", re.IGNORECASE)
_WORD = re.compile(r"[@!+|]?[^\W_]+(?:[@!+|]+[^\W_]+)*[@!+|]?")
_SIGNED, _SIMPLE = re.compile(r"[@!+|_]"), re.compile(r"\w+")  # where a line has none of the former, its words are the latter
_COMPOUND = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)+")
_CUT = re.compile(r"(?P<chain>(?:[^\W_]+-)*)(?P<left>[@!+|]?[^\W_]+(?:[@!+|]+[^\W_]+)*[@!+|]*)(?P<sign>[-¬])[ \t]*$")
_GOES_ON = re.compile(r"[ \t]*(?P<right>[@!+|]?[^\W_]+(?:[@!+|]+[^\W_]+)*)(?P<rest>\S*)")
_PAGE_WORD = "|".join(map(tolerant, ("page", "Page", "PAGE", "feuillet", "Feuillet")))
# A page is an INT, so its number has ten digits at most.
_PAGE = re.compile(
    rf"^[\s\[(–—-]*(?P<word>(?:{_PAGE_WORD}|[pP]\.?)\s*[:n°.]*\s*)?0*(?P<n>\d{{1,10}})(?:\s*(?:/|{tolerant('sur')}|{tolerant('SUR')}|de|of)\s*\d{{1,10}})?[\s\])–—-]*$"
)
_MARKED = re.compile(r"[\[(/–—-]")


def ordinary(line: str) -> str:
    """A line without hidden or look-alike characters; the number of lines never changes."""
    return fold(line).replace("\n", " ").translate(_LATIN) if ODD.search(line) else line


# A loose form folds a misreading and what was read into one, so both spellings of a header agree.
_PAIRS = [(seen, true) for true, seen in MISREAD if len(seen) == 2]
_ONE = str.maketrans("l1!|t+cé6f@0592", "iiiiiieeeraosgz")
_BARE = {i: unicodedata.normalize("NFKD", chr(i))[0] for i in range(0xC0, 0x250) if unicodedata.decomposition(chr(i))}
_NUMBER = re.compile(r"(?<![^\W_@!+|])\d+(?![^\W_@!+|])")
_SIGN = re.compile(r"[^\w@!+|# ]+")
_DIGIT = re.compile(r"\d")
_SIX = re.compile(r"(?:[^a-z]*[a-z]){6}")
_USUAL = [(c, _BARE[ord(c)]) for c in "éèàêç"]


@lru_cache(maxsize=50_000)
def loose(line: str) -> str:
    """What repeated headers have in common, of an ordinary line; empty if too little is left to tell them from chance."""
    bare = any_form(line)
    return bare if _SIX.match(bare) or sum(map(str.isalpha, bare)) >= 6 else ""


def any_form(line: str, page: int | None = None) -> str:
    """A loose form of any ordinary line; with ``page`` given, other numbers than the page's stay."""
    number = "#" if page is None else lambda m: "#" if m[0].lstrip("0") == str(page) else m[0]
    bare = line.casefold()
    if not bare.isascii():
        for accented, letter in _USUAL:
            bare = bare.replace(accented, letter)
        if not bare.isascii():
            bare = bare.translate(_BARE)
    if _DIGIT.search(bare):
        bare = _NUMBER.sub(number, bare)
    bare = _SIGN.sub(" ", bare)
    for seen, true in _PAIRS:
        bare = bare.replace(seen, true)
    return " ".join(bare.translate(_ONE).split())


# Page numbers in words.
_SPELLED = {w: i + 1 for i, w in enumerate("un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize dix-sept dix-huit dix-neuf vingt".split())}
_ROMAN = re.compile(r"(?=[mdclxvi])m*(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})", re.IGNORECASE)
_ROMAN_DIGITS = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
_NUMBER_LINE = re.compile(rf"^[\s\[(–—-]*(?:(?:{_PAGE_WORD}|[pP]\.?)\s*[:n°.]*\s*)?(?P<n>[^\W_]+(?:-[^\W\d_]+)?)[\s\])–—-]*$")


def number_of(line: str) -> int | None:
    """What a line that holds only a number says, in figures, Roman numerals or words."""
    m = _PAGE.match(line)
    if m:
        return int(m["n"])
    m = _NUMBER_LINE.match(line)
    word = m["n"].lower() if m else ""
    if word in _SPELLED:
        return _SPELLED[word]
    if word and _ROMAN.fullmatch(word):
        digits = [_ROMAN_DIGITS[c] for c in word]
        return sum(-a if a < b else a for a, b in zip(digits, [*digits[1:], 0]))
    return None


_SENTENCE_END = re.compile(r"[^\W_][.,;]$")


class Page:
    """The lines of one column, with what is a table and what is cut; ``rows``: the page's table rows as lines."""

    def __init__(self, text: str, rows: list[str] | None):
        self.stored = text.split("\n")
        odd = set(ODD.findall(text))
        strange = {i for c in odd for i, line in enumerate(self.stored) if c in line}
        self.lines = [ordinary(line) if i in strange else line for i, line in enumerate(self.stored)] if odd else self.stored
        wanted = {" ".join(r.split()) for r in rows} if rows else ()
        self.tabular: set[int] = set()
        if wanted:
            for lines in (self.stored,) if self.lines is self.stored else (self.stored, self.lines):
                self.tabular.update(i for i, line in enumerate(lines) if " ".join(line.split()) in wanted)

    @cached_property
    def cuts(self) -> dict[int, tuple[str, str, str, str]]:
        """``cut`` of the lines that have one."""
        found = ((i, self.cut(i)) for i, line in enumerate(self.lines) if line and line[-1] in "-¬ \t")
        return {i: cut for i, cut in found if cut}

    def cut(self, i: int):
        """(chain, left, sign, right, whole line's rest) where line i ends inside a word that goes on in the next."""
        line = self.lines[i]
        if i + 1 >= len(self.lines) or i in self.tabular or i + 1 in self.tabular or not line or line.rstrip()[-1:] not in ("-", "¬"):
            return None
        head = line.rstrip()
        m, n = _CUT.search(line, len(head) - len(head.split()[-1])), _GOES_ON.match(self.lines[i + 1])  # no blank lies in a word
        if not m or not n or not n["right"][0].isalpha() and n["right"][0] not in SIGNS or not any(c.isalpha() for c in m["left"]):
            return None
        ahead = self.lines[i + 1][n.start("right") :]
        if "@" in n["rest"] or re.match(r"\S*\s*[\[(](?:at|arobase)", ahead) or "@" in line[m.start() :].strip("@")[1:] and "." in n["rest"]:
            return None
        return m["chain"], m["left"], m["sign"], n["right"]

    def apart(self) -> tuple[list[int], list[int]]:
        """(lines whose words are theirs alone, those cut at their end and the ones these go on in), tables left out."""
        cut = self.cuts.keys() | {i + 1 for i in self.cuts}
        return [i for i in range(len(self.lines)) if i not in cut and i not in self.tabular], sorted(cut)

    def words_of(self, lines: list[int]) -> list[str]:
        """All words of whole lines; none goes from one into the next."""
        texts = [self.lines[i] for i in lines]
        text = "\n".join(texts)
        if "[" in text or "(a" in text or _SIGNED.search(text):
            signed = [i for i, x in enumerate(texts) if "[" in x or "(a" in x or _SIGNED.search(x)]
            found = []
            for i in signed:
                line, texts[i] = texts[i], ""
                found += _WORD.findall(_MAIL.sub(" ", line) if "@" in line or "[" in line or "(a" in line else line)
            return found + _SIMPLE.findall("\n".join(texts))
        return _SIMPLE.findall(text)

    def words(self, lines: list[int] | None = None) -> Iterator[tuple[int, list[str], str | None, int]]:
        """(line, its whole words, the word cut at its end or None, letters of that which stand in the line), tables left out.

        ``lines``: only of these; they hold the next line of each that is cut."""
        skip = False
        parts: list[str] = []
        for i in range(len(self.lines)) if lines is None else lines:
            line = self.lines[i]
            if not line or i in self.tabular:
                skip, parts = False, []
                continue
            found = _WORD.findall(_MAIL.sub(" ", line) if "@" in line or "[" in line or "(a" in line else line)
            if skip and found:
                del found[0]
            found += parts
            skip, parts = False, []
            cut = self.cuts.get(i)
            if cut and found and not (cut[3][0].isupper() and not cut[1].isupper()):
                skip = True
                del found[-1]
                # the word may be written with a hyphen there, so its odd parts are words of their own too
                parts = [cut[3]] if is_odd(cut[3]) else []
                if is_odd(cut[1]):
                    found.append(cut[1])
                yield i, found, cut[1] + cut[3], len(cut[1])
            else:
                yield i, found, None, 0


    def all_words(self) -> set[str]:
        plain, cut = self.apart()
        return {*self.words_of(plain), *(w for _, found, joined, _ in self.words(cut) for w in (*found, joined) if w)}


def is_odd(word: str) -> bool:
    """A sign or digit that touches a letter."""
    return not word.isalpha() and any(c.isalpha() for c in word)


_INVERSE: dict[str, list[str]] = {}
for _true, _seen in MISREAD:
    _INVERSE.setdefault(_seen, []).append(_true)


def readings(word: str) -> list[tuple[str, int]]:
    """(word, place of the first change) with one or two misreadings undone."""
    sites = [(i, seen, true) for seen, trues in _INVERSE.items() for i in range(len(word)) if word.startswith(seen, i) for true in trues]
    out: dict[str, int] = {}
    for i, seen, true in sites:
        out.setdefault(word[:i] + true + word[i + len(seen) :], i)
    for (i, a, x), (j, b, y) in combinations(sorted(sites), 2):
        if i + len(a) <= j:
            out.setdefault(word[:i] + x + word[i + len(a) : j] + y + word[j + len(b) :], i)
    return [(w, i) for w, i in out.items() if w.isalpha()]


def _batches(rows: DataFrame, work, schema: str, names: list[str], types: list) -> DataFrame:
    """mapInArrow over (id, page, raw_text, body, table rows): ``work`` gets one row and adds tuples to a list."""
    id_type = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            out: list[tuple] = []
            columns = [batch.column(k).to_pylist() for k in range(1, batch.num_columns)]
            for i, row in enumerate(zip(*columns)):
                work(row, out)
                at += [i] * (len(out) - len(at))
            cells = list(zip(*out)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cells, types))], names=["_id", *names])

    return rows.mapInArrow(run, f"_id {id_type}, {schema}")


def _pages(page: int | None, raw: str | None, body: str | None, rows: list[str] | None):
    """(columns it stands for, Page) of the different texts of a row."""
    if raw and raw == body:
        yield COLUMNS, Page(raw, rows)
        return
    if raw:
        yield COLUMNS[:1], Page(raw, rows)
    if body:
        yield COLUMNS[1:], Page(body, rows)


def _count(p: Page, count: Counter[str]) -> None:
    """Adds a page's words; a word put together over a line end is entered without being counted."""
    plain, cut = p.apart()
    count.update(p.words_of(plain))
    for _, found, joined, _ in p.words(cut):
        count.update(found)
        if joined:
            count[joined] += 0
    runs = [run for line in p.lines if "-" in line for run in line.split() if "-" in run]
    if runs:
        count.update(_COMPOUND.findall(" ".join(runs)))


def _edges(page: int | None, pages: list[tuple[tuple[str, ...], Page]], out: list[tuple]) -> None:
    """Marks of one row: (column, kind, line, form, page)."""
    for columns, p in pages:
        filled = [i for i, line in enumerate(p.lines) if line and not line.isspace()]
        places: dict[int, list[str]] = {}
        for k, i in enumerate(filled[:EDGE]):
            places.setdefault(i, []).append(f"+{k}")
        for k, i in enumerate(reversed(filled[-EDGE - 1 :])):
            places.setdefault(i, []).append(f"-{k}")
        for i in sorted(places.keys() - p.tabular):
            line = " ".join(p.lines[i].split())
            m = _PAGE.match(line)
            if m and (int(m["n"]) == page if page is not None else m["word"] or _MARKED.search(line)):
                out += [(c, "pageno", i, None, None) for c in columns]
            elif page is not None:
                value = None if line.count(" ") >= 8 else int(m["n"]) if m else number_of(line)
                form = "" if value is not None else loose(line)
                if value is not None:
                    out += [(c, "number", i, str(value - page), page) for c in columns]
                elif form and not _SENTENCE_END.match(line[-2:]):
                    out += [(c, "edge", i, form, page) for c in columns]
                elif any(x.isalpha() for x in line):
                    form = any_form(line, page)
                    out += [(c, "weak", i, f"{place} {form}", page) for c in columns for place in places[i]]
        for i, (chain, left, sign, right) in p.cuts.items():
            sure = sign == "¬" or "­" in p.stored[i][-3:]
            upper = right[0].isupper()
            if sure:
                out += [(c, "hyphen", i, None, None) for c in columns]
            elif not upper or left.isupper() and right.isupper():
                out += [(c, "ask_upper" if upper else "ask", i, f"{chain}\t{left}\t{right}", None) for c in columns]


_MARK = ["col_name", "kind", "line_no", "form", "page"]
_MARK_TYPES = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32()]


def _scan(rows: DataFrame) -> DataFrame:
    """One scan of (_id, page, raw_text, body, table rows, doc_id) that gives marks and, without an id, the vocabulary: (word, n).

    n is how often a word, or a word written with a hyphen, stands within the lines; 0 for one only put together over a line
    end. Words are counted a partition before anything is shuffled.
    """
    id_type, doc_type = (rows.schema[c].dataType.simpleString() for c in ("_id", "doc_id"))
    names = ["_id", "doc_id", *_MARK, "word", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[str] = Counter()
        kind = None

        def words() -> pa.RecordBatch:
            kept = [(w, n) for w, n in count.items() if len(w) > 1]
            blank = [*(pa.nulls(len(kept), t) for t in kind), *(pa.nulls(len(kept), t) for t in _MARK_TYPES)]
            return pa.RecordBatch.from_arrays([*blank, pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=names)

        for batch in batches:
            kind = batch.column(0).type, batch.column(5).type
            at: list[int] = []
            out: list[tuple] = []
            for i, row in enumerate(zip(*(batch.column(k).to_pylist() for k in range(1, 5)))):
                pages = list(_pages(*row))
                _edges(row[0], pages, out)
                at += [i] * (len(out) - len(at))
                if pages:
                    _count(pages[0][1], count)  # the body's lines are the page's own
                    for _, body in pages[1:]:  # but words it alone has are tried too
                        for word in body.all_words():
                            count.setdefault(word, 0)
            cells = list(zip(*out)) if out else [()] * len(_MARK)
            marks = [pa.array(c, t) for c, t in zip(cells, _MARK_TYPES)]
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(5).take(take), *marks, pa.nulls(len(at), pa.string()), pa.nulls(len(at), pa.int64())], names=names)
            if len(count) > 500_000:
                yield words()
                count = Counter()
        if kind is not None:
            yield words()

    return rows.mapInArrow(run, f"_id {id_type}, doc_id {doc_type}, col_name STRING, kind STRING, line_no INT, form STRING, page INT, word STRING, n BIGINT")


def _plain_words(texts: DataFrame) -> DataFrame:
    """(word, n) of running text in one column: a word, or a word written with a hyphen, and how often it stands there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    _count(Page(text, None), count)
            if len(count) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])
                count = Counter()
        kept = {w: n for w, n in count.items() if len(w) > 1}
        yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], names=["word", "n"])

    return texts.mapInArrow(run, "word STRING, n BIGINT")


# A word and all its misreadings have one key: true characters are written as what they may be read as, then signs of one
# group as one. Longer readings come first, as their letters are in groups too.
_WIDE = [(true, seen) for true, seen in MISREAD if len(seen) == 2]
_WIDE.sort(key=lambda x: any(x[0] in seen for _, seen in _WIDE))
_SINGLE = {"@": "a", "é": "b", "6": "b", "8": "B", "c": "e", "9": "g", "!": "i", "1": "i", "I": "i", "l": "i", "|": "i", "0": "o", "O": "o", "f": "r", "5": "s", "S": "s", "+": "t", "2": "z", "Z": "z"}
_SEEN: dict[str, list[str]] = {}
for _true, _seen in MISREAD:
    _SEEN.setdefault(_true, []).append(_seen)


def _folded_key(word: Column) -> Column:
    for true, seen in _WIDE:
        word = F.replace(word, F.lit(true), F.lit(seen))
    return F.translate(word, "".join(_SINGLE), "".join(_SINGLE.values()))


def reading_place(word: str, true: str) -> int | None:
    """Where the first misreading stands if ``word`` is ``true`` with any number of characters misread, else None."""
    ends = {0}  # places in ``word`` that the characters so far may reach
    for c in true:
        ends = {i + len(o) for i in ends for o in (c, *_SEEN.get(c, ())) if word.startswith(o, i)}
        if not ends:
            return None
    if len(word) not in ends or word == true:
        return None
    return next((i for i, (x, y) in enumerate(zip(word, true)) if x != y), min(len(word), len(true)))


def misreadings(words: DataFrame) -> DataFrame:
    """(word, fix, place) of every word of a vocabulary that recognition got wrong.

    All words are tried, each with one or two misreadings undone, then those left (and long ones) with any number, by a key that a
    word shares with its misreadings. An odd word (a sign or digit within letters) is wrong if a reading of it is a word; a plain
    one if a reading is at least ``TIMES`` as frequent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, fixes, places, odd = [], [], [], []
            for i, word in enumerate(batch.column(0).to_pylist()):
                if len(word) > 40 or "-" in word or not any(c.isalpha() for c in word):
                    continue
                for fix, place in readings(word):
                    at.append(i)
                    fixes.append(fix)
                    places.append(place)
                    odd.append(is_odd(word))
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(fixes, pa.string()), pa.array(places, pa.int32()), pa.array(odd, pa.bool_())],
                names=["word", "n", "fix", "place", "odd"],
            )

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = pa.array([reading_place(w, f) for w, f in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, places], names=["word", "m", "fix", "place"]).filter(places.is_valid())

    tried = words.select("word", "n").mapInArrow(run, "word STRING, n BIGINT, fix STRING, place INT, odd BOOLEAN")
    sound = words.where("n > 0").select(F.col("word").alias("fix"), F.col("n").alias("m"))
    better = tried.join(sound, "fix").where(F.col("odd") | (F.col("m") >= TIMES * F.greatest("n", F.lit(1))))
    best = lambda df: df.groupBy("word").agg(F.max(F.struct("m", "fix", "place")).alias("best")).select("word", "best.fix", "best.place")
    near = written(best(better), "near")
    letters = r"\p{L}"
    left = words.where(F.col("word").rlike(letters) & ~F.col("word").contains("-")).join(near, "word", "left_anti")
    left = left.select("word", "n", (~F.col("word").rlike(r"^\p{L}+$")).alias("odd"), _folded_key(F.col("word")).alias("key"))
    keyed = sound.where(F.col("fix").rlike(r"^\p{L}+$")).withColumn("key", _folded_key(F.col("fix")))
    far = left.join(keyed, "key").where((F.col("word") != F.col("fix")) & (F.col("odd") | (F.col("m") >= TIMES * F.greatest("n", F.lit(1)))))
    return near.unionByName(best(far.select("word", "m", "fix").mapInArrow(verified, "word STRING, m BIGINT, fix STRING, place INT")))


class ScannedPages:
    """Noise of a table of pages: key, doc_id, page, the two text columns and their tables."""

    def __init__(self, pages: DataFrame, other_texts: DataFrame | None = None, key: str = "page_row_id"):
        """``other_texts``: one column of further text in the same language that counts towards the vocabulary."""
        self.key = key
        cells = lambda r: F.concat_ws(" ", F.filter(r, lambda c: c.isNotNull() & (F.trim(c) != "")))
        rows = F.flatten(F.transform("tables", lambda x: F.transform(F.coalesce(x["data"], F.array().cast("array<array<string>>")), cells)))
        self.rows = pages.select(F.col(key).alias("_id"), "page", *COLUMNS, F.filter(rows, lambda r: r != "").alias("_rows"), "doc_id")
        self.other_texts = other_texts

    @cached_property
    def scan(self) -> DataFrame:
        return written(_scan(self.rows), "scan")

    @cached_property
    def marks(self) -> DataFrame:
        return self.scan.where("word IS NULL").select("_id", "doc_id", *_MARK)

    @cached_property
    def words(self) -> DataFrame:
        counted = self.scan.where("word IS NOT NULL").select("word", "n")
        if self.other_texts is not None:
            counted = counted.unionByName(_plain_words(self.other_texts))
        return written(counted.groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")

    @cached_property
    def wrong(self) -> DataFrame:
        return written(misreadings(self.words), "misreadings")

    @cached_property
    def _edges(self) -> DataFrame:
        """Marks that repetition decides, with their document."""
        return self.marks.where("kind IN ('edge', 'weak', 'number') AND doc_id IS NOT NULL")

    @cached_property
    def _forms(self) -> DataFrame:
        """Forms of these marks with the first and the last page of their document that have them."""
        return written(self._edges.groupBy("doc_id", "col_name", "kind", "form").agg(F.min("page").alias("lo"), F.max("page").alias("hi")), "forms")

    def _again(self) -> DataFrame:
        """(doc_id, col_name, kind, form) of lines that come back.

        Forms are counted once a document, on the map side. A form that stands on one page only is held against every other form of the
        document (see ``_near``).
        """
        group, forms = ["doc_id", "col_name", "kind", "form"], self._forms
        exact = forms.where("kind <> 'weak' AND lo <> hi").select(*group)
        weak = written(forms.where("kind = 'weak' AND lo <> hi").select(*group), "weak")
        seen = self._edges.where("kind = 'weak'").join(weak, group).groupBy(*group).agg(F.countDistinct("page").alias("n"))
        pages = self._edges.join(weak.select("doc_id").distinct(), "doc_id").groupBy("doc_id", "col_name").agg(F.countDistinct("page").alias("pages"))
        most = seen.join(pages, ["doc_id", "col_name"]).where("2 * n > pages").select(*group)
        near = self._near(forms.where("kind = 'edge'")).select("doc_id", "col_name", F.lit("edge").alias("kind"), "form")
        return exact.unionByName(most).unionByName(near).distinct()

    def _near(self, forms: DataFrame) -> DataFrame:
        """(doc_id, col_name, form) of forms on one page only that are within ``FUZZY`` of a form of another page of the document.

        A document's forms are compared in one place; those of a document with more than ``BLOCK`` are dealt into blocks, and every two
        blocks are compared in a place of their own.
        """
        group = ["doc_id", "col_name"]
        large = forms.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).alias("_blocks")).where("_blocks > 1")
        dealt = forms.join(F.broadcast(large), group, "left")  # at most one row for every BLOCK forms
        own = F.pmod(F.xxhash64("form"), F.col("_blocks"))
        other = F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1), lambda b: b != own)
        pairs = F.transform(other, lambda b: F.least(own, b) * F.col("_blocks") + F.greatest(own, b))
        dealt = dealt.withColumn("_pair", F.explode(F.when(F.col("_blocks").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(pairs)))
        place = [*group, "_pair"]
        dealt = dealt.select(*place, "form", "lo", "hi").repartition(*place).sortWithinPartitions(*place)
        schema = dealt.schema
        return dealt.mapInArrow(lambda batches: near_rows(batches, place, FUZZY), schema).select(*group, "form")

    def headers(self) -> DataFrame:
        """Lines at an edge of a page that come back on other pages of the document."""
        return self._repeated.where("kind <> 'number'").select("_id", "col_name", F.lit("header").alias("kind"), "line_no").unionByName(self.deep_headers())

    @cached_property
    def _repeated(self) -> DataFrame:
        return written(self._edges.join(self._again(), ["doc_id", "col_name", "kind", "form"]).select("_id", "doc_id", "col_name", "kind", "line_no", "page").distinct(), "repeated")

    def deep_headers(self) -> DataFrame:
        """Headers and page numbers beyond the first lines of an edge, on pages where all of these come back: as far as every line does.

        A line comes back if another page has its form, or one near it, there or among the first lines of an edge.
        """
        known = self._repeated.select("_id", "col_name", "line_no").unionByName(self.marks.where("kind = 'pageno'").select("_id", "col_name", "line_no")).distinct()
        enough = known.groupBy("_id", "col_name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= EDGE).select("_id", "col_name")
        few = written(enough.join(known, ["_id", "col_name"]).groupBy("_id").agg(F.collect_set(F.concat_ws(" ", "col_name", F.col("line_no").cast("string"))).alias("_known")), "edges")  # bounded by the page
        pages = self.rows.where("doc_id IS NOT NULL").join(few, "_id").select("_id", "page", *COLUMNS, "_rows", "_known", "doc_id")

        def deeper(row: tuple, out: list[tuple]) -> None:
            page, raw, body, rows, have, doc = row
            for name, text in zip(COLUMNS, (raw, body)):
                if not text or page is None:
                    continue
                p = Page(text, rows)
                filled = [i for i, line in enumerate(p.lines) if line and not line.isspace()]
                for lines, least in ((filled, EDGE), (filled[::-1], EDGE + 1)):
                    if len(lines) > least and all(f"{name} {i}" in have for i in lines[:least]):
                        for place, i in enumerate(lines[least:]):
                            line = " ".join(p.lines[i].split())
                            m = _PAGE.match(line)
                            number = m is not None and int(m["n"]) == page
                            form = None if number else "" if i in p.tabular or number_of(line) is not None else loose(line) or any_form(line, page)
                            if not number and not any(map(str.isalpha, form)):
                                break
                            out.append((name, i, "+" if least == EDGE else "-", form, place, page, doc))

        of = pages.select("doc_id").schema
        names, types = ["col_name", "line_no", "side", "form", "place", "page", "doc_id"], [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), to_arrow_schema(of)[0].type]
        schema = f"col_name STRING, line_no INT, side STRING, form STRING, place INT, page INT, doc_id {of[0].dataType.simpleString()}"
        deep = written(_batches(pages, deeper, schema, names, types), "deep")
        group = ["doc_id", "col_name", "form"]
        lines = deep.where("form IS NOT NULL")
        own = lines.select(*group, F.col("page").alias("lo"), F.col("page").alias("hi"))
        first = self._forms.where("kind = 'edge'").join(lines.select("doc_id").distinct(), "doc_id", "left_semi").select(*group, "lo", "hi")
        forms = written(own.unionByName(first).groupBy(*group).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "deep-forms")
        back = forms.where("lo <> hi").select(*group).unionByName(self._near(forms).select(*group)).distinct()
        marked = lines.join(back, group).select(*deep.columns).unionByName(deep.where("form IS NULL"))
        side = Window.partitionBy("_id", "col_name", "side").orderBy("place")  # bounded by the page
        kind = F.when(F.col("form").isNull(), "pageno").otherwise("header").alias("kind")
        return marked.withColumn("_nth", F.row_number().over(side) - 1).where("_nth = place").select("_id", "col_name", kind, "line_no")

    def hyphens(self) -> DataFrame:
        """Lines that end inside a word that is not itself written with a hyphen there."""
        sure = self.marks.where("kind = 'hyphen'").select("_id", "col_name", "kind", "line_no")
        parts = F.split("form", "\t")
        asked = self.marks.where("kind LIKE 'ask%'").select(
            "_id", "col_name", "line_no", "kind", parts[0].alias("chain"), parts[1].alias("left"), parts[2].alias("right")
        )
        asked = asked.withColumn("joined", F.concat("left", "right")).withColumn("compound", F.concat("chain", "left", F.lit("-"), "right"))
        count = self.words.where("n > 0")
        for name, what in (("n_joined", "joined"), ("n_compound", "compound"), ("n_left", "left"), ("n_right", "right")):
            asked = asked.join(count.select(F.col("word").alias(what), F.col("n").alias(name)), what, "left").fillna(0, [name])
        noise = (
            F.when(F.col("n_joined") > F.col("n_compound"), True)
            .when(F.col("n_compound") > 0, False)
            .when(F.col("kind") == "ask_upper", (F.col("n_left") == 0) | (F.col("n_right") == 0))
            .otherwise(True)
        )
        return sure.unionByName(asked.where(noise).select("_id", "col_name", F.lit("hyphen").alias("kind"), "line_no"))

    def page_numbers(self) -> DataFrame:
        """Lines that give the page's number, and those whose numbers run along with the pages of the document."""
        sequence = self._repeated.where("kind = 'number'").select("_id", "col_name", F.lit("pageno").alias("kind"), "line_no")
        return self.marks.where("kind = 'pageno'").select("_id", "col_name", "kind", "line_no").unionByName(sequence)

    def wrong_words(self) -> DataFrame:
        """(_id, col_name, line_no, word, fix) of every misread word."""
        spark = self.words.sparkSession
        sound = self.words.join(self.wrong.select("word"), "word", "left_anti").where((F.col("n") > 1) & F.col("word").rlike(r"\p{L}")).orderBy(F.col("n").desc(), "word").limit(FREQUENT)
        known = spark.sparkContext.broadcast(frozenset(r["word"] for r in sound.select("word").collect()))

        def unknown(row: tuple, out: list[tuple]) -> None:
            sure = known.value
            for columns, p in _pages(*row):
                plain, cut = p.apart()
                odd = [w for w in set(p.words_of(plain)) - sure if len(w) > 1 and not w.isdigit()]  # figures are not misread
                at = sorted({i for w in odd for i in plain if w in p.lines[i]})
                for i, found, joined, inside in chain(p.words(at), p.words(cut)):
                    for word in found:
                        if word not in sure and len(word) > 1 and not word.isdigit():
                            out += [(c, i, word, 0) for c in columns]
                    if joined and joined not in sure:
                        out += [(c, i, joined, inside) for c in columns]

        asked = _batches(self.rows.drop("doc_id"), unknown, "col_name STRING, line_no INT, word STRING, inside INT", ["col_name", "line_no", "word", "inside"], [pa.string(), pa.int32(), pa.string(), pa.int32()])
        line = F.col("line_no") + F.when((F.col("inside") > 0) & (F.col("place") >= F.col("inside")), 1).otherwise(0)
        return asked.join(self.wrong, "word").select("_id", "col_name", line.alias("line_no"), "word", "fix")

    def found(self) -> DataFrame:
        """(key, col_name, kind, line_no): one row for each line with that noise."""
        chars = self.wrong_words().select("_id", "col_name", F.lit("char").alias("kind"), "line_no")
        every = self.headers().unionByName(self.hyphens()).unionByName(self.page_numbers()).unionByName(chars)
        return every.distinct().withColumnRenamed("_id", self.key)

    def repaired(self) -> DataFrame:
        """(key, col_name, paragraphs): each column as continuous paragraphs, without running lines and with words put right.

        Table rows stay lines of their own. A null column stays null.
        """
        marks = self.headers().unionByName(self.hyphens()).unionByName(self.page_numbers()).distinct()
        marks = marks.select("_id", F.struct("col_name", "kind", "line_no", F.lit(None).cast("string").alias("word"), F.lit(None).cast("string").alias("fix")).alias("edit"))
        words = self.wrong_words().distinct().select("_id", F.struct("col_name", F.lit("char").alias("kind"), "line_no", "word", "fix").alias("edit"))
        edits = marks.unionByName(words).groupBy(F.col("_id").alias("_of")).agg(F.collect_list("edit").alias("edits"))  # bounded by the page
        rows = self.rows.join(edits, self.rows["_id"].eqNullSafe(edits["_of"]), "left").select("_id", *COLUMNS, "_rows", "edits")

        def work(row: tuple, out: list[tuple]) -> None:
            *texts, table_rows, changes = row
            for name, text in zip(COLUMNS, texts):
                out.append((name, text and paragraphs(text, table_rows, [c for c in changes or () if c["col_name"] == name])))

        return _batches(rows, work, "col_name STRING, paragraphs STRING", ["col_name", "paragraphs"], [pa.string(), pa.string()]).withColumnRenamed("_id", self.key)


def paragraphs(text: str, rows: list[str] | None, edits: list[dict]) -> str:
    """A text with its edits applied and its lines joined; a line well short of the usual width ends a paragraph."""
    page = Page(text, rows)
    gone = {e["line_no"] for e in edits if e["kind"] in ("header", "pageno")}
    cut = {e["line_no"] for e in edits if e["kind"] == "hyphen"}
    fixes: dict[int, dict[str, str]] = {}
    for e in edits:
        if e["kind"] == "char":
            fixes.setdefault(e["line_no"], {})[e["word"]] = e["fix"]
    kept = [(i, " ".join(line.split())) for i, line in enumerate(page.lines) if i not in gone]
    usual = sorted(len(line) for i, line in kept if line and i not in page.tabular)
    width = usual[len(usual) * 3 // 4] if usual else 0
    out: list[str] = []
    join = ""  # what goes between the last piece and the next; a line break starts a new paragraph
    last: dict[str, str] = {}
    for i, line in kept:
        if not line:
            join = "\n"
            continue
        alone = i in page.tabular
        known = {**last, **fixes.get(i, {})}
        last = fixes.get(i, {}) if i in cut else {}
        piece = re.sub(r"[-¬]$", "", line) if i in cut else line
        if out and join == "":
            piece = out.pop() + piece
        elif out and join == " " and not alone:
            piece = out.pop() + " " + piece
        if known:
            piece = _WORD.sub(lambda m: known.get(m[0], m[0]), piece)
        out.append(piece)
        compound = line.endswith("-") and i not in cut and line[-2:-1].isalpha()
        join = "" if i in cut or compound else "\n" if alone or len(line) < 0.6 * width else " "
    return "\n".join(out)
