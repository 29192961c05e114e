"""Problem 2: one consistent form for texts that look the same but are made of different characters.

Characters are folded first (invisible ones removed, blanks and line breaks unified, full-width and joined letters spelled
out, accents composed). Look-alike letters of other scripts are then repaired a token: the dominant script of a
mixed-script token is determined, and its foreign letters are replaced by their look-alikes where the result stands in the
corpus vocabulary, the dominant script's spelling first. A token without such evidence stays as it is. A token written wholly in
look-alikes of another script is repaired only if the vocabulary has the Latin word.

The vocabulary is all tokens of the table but those that could be a disguise themselves, and the spellings in which two or more different
mixed-script tokens agree: a rare name that stands nowhere but in disguises. It stays distributed. Only candidate spellings that occur as clean tokens are
joined back, and only to the texts that hold a foreign letter.

Defined results for odd input:
* null stays null, empty stays empty; neither is a case of ``look_alike_pairs``;
* runs of blanks, tabs, case, accents, digits, dashes of different width and superscripts look different and are kept;
* texts of genuine Greek, Cyrillic or Arabic words are kept; a soft hyphen is invisible except at a line's end, where it is
  seen as a hyphen;
* repeated rows and empty tables are no special case.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parapheur.session import written

# Letters of other scripts that are drawn like a Latin letter, in the order of the Latin letters beside them.
CYRILLIC, CYRILLIC_LATIN = "АВСЕНІЈКМОРЅТХУасԁеһіјӏорԛѕѵԝху", "ABCEHIJKMOPSTXYacdehijlopqsvwxy"
GREEK, GREEK_LATIN = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳ", "ABEZHIKMNOPTYXovcj"

ARMENIAN, ARMENIAN_LATIN = "ԼՍՏՕհոսցօ", "LUSOhnugo"
CHEROKEE, CHEROKEE_LATIN = "ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ"

TO_LATIN = dict(zip(CYRILLIC, CYRILLIC_LATIN)) | dict(zip(GREEK, GREEK_LATIN)) | dict(zip(ARMENIAN, ARMENIAN_LATIN)) | dict(zip(CHEROKEE, CHEROKEE_LATIN))
FROM_LATIN = {"Cyrillic": dict(zip(CYRILLIC_LATIN, CYRILLIC)), "Greek": dict(zip(GREEK_LATIN, GREEK))}
_LATIN_TABLE = str.maketrans(TO_LATIN)
_FOREIGN_TABLES = {k: str.maketrans(v) for k, v in FROM_LATIN.items()}

_INVISIBLE = regex.compile(r"(?![­]+[ \t]*(?:\n|$))[\p{Cf}\p{Default_Ignorable_Code_Point}]+")
_BLANK = regex.compile(r"[\p{Zs}]")
_BREAK = re.compile("\r\n?|[\u0085  ]")
_JOINED = regex.compile(r"[！-￮ﬀ-ﬆĲĳǄ-ǌⅠ-ⅿﭐ-ﷹﹰ-ﻼ\U0001d400-\U0001d7ff]+")
_HYPHEN = re.compile("[­‐‑]+")
_TOKEN = regex.compile(r"[\p{L}\p{M}]+")
_FOREIGN_TOKEN = regex.compile(r"[\p{L}\p{M}]*[\p{Script=Greek}\p{Script=Cyrillic}\p{Script=Armenian}\p{Script=Cherokee}][\p{L}\p{M}]*")
_SCRIPTS = {s: regex.compile(rf"\p{{Script={s}}}") for s in ("Latin", "Cyrillic", "Greek", "Armenian", "Cherokee")}
# Everything that fold() could change or that could be a foreign letter lies outside these characters.
ODD = re.compile("[^\\x00-\\x0c\\x0e-\\x84\\x86-\\x9f\\xa1-\\xac\\xae-\\u02ff\\u2013\\u2014\\u2018-\\u201e\\u2026\\u20ac]")
_PLAIN_TOKEN = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """Everything but look-alike letters of other scripts, which need the vocabulary."""
    if not ODD.search(text):
        return text
    text = _BREAK.sub("\n", text)
    text = _INVISIBLE.sub("", text)
    text = _BLANK.sub(" ", text)
    text = _HYPHEN.sub("-", text)
    text = _JOINED.sub(lambda m: unicodedata.normalize("NFKC", m[0]), text)
    return unicodedata.normalize("NFC", text)


def spellings(token: str) -> list[str]:
    """Spellings in one script that a token with foreign letters may stand for, that of the dominant script first."""
    token = unicodedata.normalize("NFD", token)
    count = {s: len(p.findall(token)) for s, p in _SCRIPTS.items()}
    out = []
    for script in sorted(_SCRIPTS, key=lambda s: (-count[s], s != "Latin")):
        table = _LATIN_TABLE if script == "Latin" else _FOREIGN_TABLES.get(script)
        if table is None or script != "Latin" and not 0 < count[script] < sum(count.values()):
            continue
        other = token.translate(table)
        if not any(p.search(other) for s, p in _SCRIPTS.items() if s != script):
            out.append(unicodedata.normalize("NFC", other))
    return out


def is_mixed(token: str) -> bool:
    return sum(bool(p.search(token)) for p in _SCRIPTS.values()) > 1


#: Stands before a spelling that only other disguises attest.
AGREED = "\0"


def repair(token: str, attested: frozenset[str] | set[str]) -> str:
    """The first spelling that the vocabulary has; else one that other disguises agree in, Latin first as theirs may have
    another dominant script; else the token itself."""
    options = spellings(token)
    agreed = sorted(options, key=lambda s: not _SCRIPTS["Latin"].search(s)) if is_mixed(token) else ()
    return next((s for s in options if s in attested), next((s for s in agreed if AGREED + s in attested), token))


def canonical(text: str, attested: frozenset[str] | set[str] = frozenset()) -> str:
    """The consistent form of a text; ``attested``: spellings that stand in the corpus vocabulary."""
    text = fold(text)
    if _FOREIGN_TOKEN.search(text):
        text = unicodedata.normalize("NFC", _FOREIGN_TOKEN.sub(lambda m: repair(m[0], attested), text))
    return text


def _digest(text: str) -> str:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()


def _own(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _scan(rows: DataFrame, digest: bool) -> DataFrame:
    """One scan of (_id, _text) that gives two kinds of rows.

    A text: (_id, own, canonical), or (_id, own, text) where a foreign letter waits for the vocabulary. A token (each once a
    partition, or more often where a partition has very many): (token, wanted, disguise), wanted being spellings that a foreign token
    may stand for and ``disguise`` a digest of that token if it mixes scripts. A token that may be a disguise itself is left out.
    """
    kind = rows.schema["_id"].dataType.simpleString()
    names = ["_id", "own", "canonical", "text", "token", "wanted", "disguise"]
    types = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: set[str] = set()
        want: set[tuple[str, int | None]] = set()
        tried: set[str] = set()
        id_type = None

        def tokens() -> pa.RecordBatch:
            n = len(have) + len(want)
            empty = [pa.nulls(n, id_type), *(pa.nulls(n, t) for t in types[1:4])]
            spelled, disguises = zip(*want) if want else ((), ())
            return pa.RecordBatch.from_arrays(
                [*empty, pa.array([*have, *spelled], pa.string()), pa.array([False] * len(have) + [True] * len(want), pa.bool_()), pa.array([*[None] * len(have), *disguises], pa.int64())], names=names
            )

        for batch in batches:
            id_type = batch.column(0).type
            own, form, held = [], [], []
            for text in batch.column(1).to_pylist():
                own.append(None if text is None else _own(text))
                held.append(None)
                if not text:
                    form.append(text if not digest or text is None else _digest(text))
                    continue
                if not ODD.search(text):
                    have.update(_PLAIN_TOKEN.findall(text))
                    form.append(_digest(text) if digest else text)
                    continue
                plain = fold(text)
                have.update(_TOKEN.findall(plain))
                foreign = _FOREIGN_TOKEN.findall(plain)
                if not foreign:
                    form.append(_digest(plain) if digest else plain)
                    continue
                form.append(None)
                held[-1] = text
                for token in foreign:
                    options = spellings(token)
                    if token not in tried:
                        tried.add(token)
                        disguise = _own(token) if is_mixed(token) else None
                        want.update((s, disguise) for s in options)
                    if options:
                        have.discard(token)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(own, pa.int64()), pa.array(form, pa.string()), pa.array(held, pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.int64())], names=names
            )
            if len(have) > 500_000:
                yield tokens()
                have, want, tried = set(), set(), set()
        if id_type is not None:
            yield tokens()

    return rows.mapInArrow(run, f"_id {kind}, own BIGINT, canonical STRING, text STRING, token STRING, wanted BOOLEAN, disguise BIGINT")


def _wishes(held: DataFrame) -> DataFrame:
    """(_id, token): spellings wanted by each text with a foreign letter."""
    kind = held.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, tokens = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                mine = {s for t in set(_FOREIGN_TOKEN.findall(fold(text))) for s in spellings(t)}
                at += [i] * len(mine)
                tokens += mine
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(tokens, pa.string())], names=["_id", "token"])

    return held.select("_id", "text").mapInArrow(run, f"_id {kind}, token STRING")


def _forms(df: DataFrame, key: str, text: str, digest: bool) -> DataFrame:
    """(_id, own, canonical): every row's form, or its digest; ``own`` is a digest of the text as stored."""
    scan = written(_scan(df.select(F.col(key).alias("_id"), F.col(text).alias("_text")), digest), "scan")
    seen = scan.where("token IS NOT NULL").groupBy("token").agg(
        F.bool_or("wanted").alias("wanted"), F.bool_and("wanted").alias("only"), F.min("disguise").alias("lo"), F.max("disguise").alias("hi")
    )
    mark = F.when(F.col("only"), F.concat(F.lit(AGREED), "token")).otherwise(F.col("token"))
    attested = seen.where("wanted AND (NOT only OR lo <> hi)").select("token", mark.alias("spelling"))
    held = scan.where("text IS NOT NULL").select("_id", "own", "text")
    known = _wishes(held).join(attested, "token").groupBy("_id").agg(F.collect_set("spelling").alias("attested"))  # bounded by the text

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = [canonical(t, set(a or ())) for t, a in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([_digest(f) for f in forms] if digest else forms, pa.string())], names=["_id", "own", "canonical"])

    kind = scan.schema["_id"].dataType.simpleString()
    hard = held.join(known, held["_id"].eqNullSafe(known["_id"]), "left").select(held["_id"], "own", "text", "attested")
    easy = scan.where("token IS NULL AND text IS NULL").select("_id", "own", "canonical")
    return easy.unionByName(hard.mapInArrow(repaired, f"_id {kind}, own BIGINT, canonical STRING"))


def canonical_form(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, canonical) of every row; the key must be unique where it is not null."""
    return _forms(df, key, text, digest=False).select(F.col("_id").alias(key), "canonical")


def look_alike_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id_a, id_b) of rows whose texts look the same but differ; equal texts make no pair.

    Only digests are shuffled, and only groups with two different texts are joined with themselves: what comes out is the
    pairs asked for.
    """
    rows = written(_forms(df.where(F.col(text) != ""), key, text, digest=True).select(F.col("_id").alias("id"), "own", "canonical"), "forms")
    mixed = rows.groupBy("canonical").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).where("lo <> hi").select("canonical")
    rows = rows.join(mixed, "canonical")
    other = rows.select(F.col("id").alias("id_b"), "canonical", F.col("own").alias("other"))
    return rows.withColumnRenamed("id", "id_a").join(other, "canonical").where("id_a < id_b AND own <> other").select("id_a", "id_b").distinct()
