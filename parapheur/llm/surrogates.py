"""Keyed surrogates that are distinct by construction.

Every part of an entity (a name's word, a number's digits) goes through a keyed permutation of all parts of the same form: the same
script, the same length, vowels and consonants in the same places. A permutation never gives two parts one image, so two entities
never share a surrogate, in one table or in many, and no table of surrogates is kept: the same key gives the same surrogate wherever
an entity is met. No part is its own image. Given names in the lists are permuted among those of their gender.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Collection, Sequence
from functools import lru_cache

# Letters of the scripts that names are written in, vowels first where a script has them.
ALPHABETS = (
    "aeiouy", "bcdfghjklmnpqrstvwxz", "0123456789", "αεηιουω", "βγδζθκλμνξπρστφχψ", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ",
    "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
)
_CLASS = {c: alphabet for alphabet in ALPHABETS for c in alphabet}
_LATIN = "abcdefghijklmnopqrstuvwxyz"
_ROUNDS = 6


def bare(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))


class Cipher:
    """Permutations of ranges and of texts under one secret."""

    def __init__(self, secret: str):
        if not secret:
            raise ValueError("surrogates need a secret key")
        self.key = hashlib.blake2b(secret.encode(), digest_size=32).digest()
        self.shuffled = lru_cache(100_000)(self._shuffled)

    def _number(self, *parts) -> int:
        return int.from_bytes(hashlib.blake2b(repr(parts).encode(), key=self.key, digest_size=16).digest(), "big")

    def _feistel(self, x: int, n: int, tweak: str, back: bool) -> int:
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        while True:  # walks until inside the range again, which keeps it a permutation
            a, b = x >> half, x & mask
            for turn in range(_ROUNDS):
                if back:
                    a, b = b ^ (self._number(tweak, n, _ROUNDS - 1 - turn, a) & mask), a
                else:
                    a, b = b, a ^ (self._number(tweak, n, turn, b) & mask)
            x = a << half | b
            if x < n:
                return x

    def moved(self, x: int, n: int, tweak: str) -> int:
        """A keyed permutation of range(n) that leaves nothing in place (for n > 1): a shift, seen through another permutation."""
        if n < 2:
            return x
        place = (self._feistel(x, n, tweak, False) + 1 + self._number(tweak, n) % (n - 1)) % n
        return self._feistel(place, n, tweak, True)

    def _shuffled(self, word: str, tweak: str, whole: bool = False) -> str:
        """``word`` (lower case, no accents) with its letters and digits permuted as one; ``whole``: any Latin letter for any."""
        classes = [_LATIN if whole and c in _LATIN else _CLASS.get(c) for c in word]
        shape = tweak + "\x1f" + "".join("." if k is None else k[0] for k in classes) + "\x1f" + "".join(c for c, k in zip(word, classes) if k is None)
        value, size = 0, 1
        for c, k in zip(word, classes):
            if k:
                value, size = value * len(k) + k.index(c), size * len(k)
        value, out = self.moved(value, size, shape), []
        for c, k in zip(reversed(word), reversed(classes)):
            if k:
                value, digit = divmod(value, len(k))
                c = k[digit]
            out.append(c)
        return "".join(reversed(out))

    def shuffled_within(self, word: str, tweak: str, allowed: Callable[[str], bool], whole: bool = False) -> str:
        """As ``shuffled``, among allowed words only; ``word`` must be one."""
        out = self.shuffled(word, tweak, whole)
        while not allowed(out):
            out = self.shuffled(out, tweak, whole)
        return out


def in_case_of(model: str, text: str) -> str:
    """``text`` in upper case or capitalised where ``model`` is."""
    if len(model) > 1 and model.isupper():
        return text.upper()
    return text[:1].upper() + text[1:] if model[:1].isupper() else text


_PART = re.compile(r"[^\W_]+")
_INITIAL = re.compile(r"(?<![^\W_])([^\W\d_])\.")
# Country calling codes of one and of two digits; all others have three.
_SHORT_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
# Words of an address that say what it is, not which.
ADDRESS_WORDS = frozenset(
    "rue avenue av boulevard bd boul chemin ch impasse imp place pl allee all quai route rte cours square passage ruelle sentier esplanade cite residence res "
    "lotissement lot villa faubourg fbg traverse montee voie hameau quartier bis ter quater bat batiment apt appt porte n no de du des d la le les l et sur a aux au en".split()
)


def phone_prefix(found: str) -> int:
    """Where the national number of a phone number begins."""
    m = re.match(r"(?:\+|00)[ .\n-]?", found)
    if m:
        digits = [i for i in range(m.end(), len(found)) if found[i].isdigit()]
        code = "".join(found[i] for i in digits[:3])
        n = 1 if code[:1] in _SHORT_CODES else 2 if code[:2] in _SHORT_CODES else 3
        end = digits[min(n, len(digits)) - 1] + 1
        trunk = re.match(r"[ .\n-]?\(0\)", found[end:])
        return end + (trunk.end() if trunk else 0)
    m = re.match(r"\(?0", found)
    return m.end() if m else 0


class Surrogates:
    """Surrogates of the pieces of a text, given the lists of given names by gender."""

    def __init__(self, secret: str, given: Sequence[Sequence[str]]):
        self.cipher = Cipher(secret)
        self.given = {bare(name): (names, i) for names in given for i, name in enumerate(names)}

    def name_part(self, part: str) -> str:
        """The image of one word of a name, in lower case but for a listed name's accents."""
        known = self.given.get(bare(part))
        if known:
            names, i = known
            return names[self.cipher.moved(i, len(names), f"given\x1f{names[0]}")].casefold()
        return self.cipher.shuffled_within(bare(part), "name", lambda w: w not in self.given)

    def person(self, found: str, full: Collection[str] = ()) -> str:
        """``full``: names in the same text; an initial is that of the one it can stand for."""
        initials = {m.start(1) for m in _INITIAL.finditer(found)}
        rest = {bare(w[0]) for w in _PART.finditer(found) if w.start() not in initials}

        def image(m: re.Match) -> str:
            if m.start() not in initials:
                return in_case_of(m[0], self.name_part(m[0]))
            for other in full:
                words = _PART.findall(other)
                first = [w for w in words if len(w) > 1 and bare(w)[:1] == bare(m[0]) and bare(w) not in rest]
                if first and rest <= set(map(bare, words)):
                    return self.name_part(first[0])[:1].upper()
            return in_case_of(m[0], self.cipher.shuffled(bare(m[0]), "initial", True))

        return _PART.sub(image, found)

    def digits(self, found: str, start: int, tweak: str) -> str:
        """Letters and digits of ``found`` from ``start`` on permuted as one, everything between them kept."""
        plain = bare("".join(_PART.findall(found[start:])))
        lead = plain[:1] != "0"
        image = iter(self.cipher.shuffled_within(plain, tweak, lambda w: (w[:1] != "0") == lead, True))
        return found[:start] + "".join(in_case_of(c, next(image, c)) if c.isalnum() else c for c in found[start:])

    def email(self, normal: str) -> str:
        local, _, domain = bare(normal).rpartition("@")
        return f"{self.cipher.shuffled(local, 'local')}@{self.cipher.shuffled(domain, 'domain')}.example"

    def address(self, found: str) -> str:
        def image(m: re.Match) -> str:
            word = bare(m[0])
            if word in ADDRESS_WORDS and not m[0].isupper():
                return m[0]
            lead = word[:1] != "0"
            return in_case_of(m[0], self.cipher.shuffled_within(word, "address", lambda w: w not in ADDRESS_WORDS and (w[:1] != "0") == lead, len(word) == 1))

        return _PART.sub(image, found)

    def of(self, kind: str, found: str, normal: str, full: Collection[str] = ()) -> str:
        found = found.replace("\n", " ")
        if kind == "person":
            return self.person(found, full)
        if kind == "email":
            return in_case_of(found, self.email(normal)) if found.isupper() else self.email(normal)
        if kind == "address":
            return self.address(found)
        return self.digits(found, phone_prefix(found) if kind == "phone" else 0, kind)
