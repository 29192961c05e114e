"""What scanning does to characters; shared by the operators on scanned text."""

from __future__ import annotations

# A character, and what recognition commonly puts in its place.
MISREAD = (
    ("a", "@"),
    ("b", "6"),
    ("B", "8"),
    ("d", "cl"),
    ("e", "c"),
    ("é", "6"),
    ("g", "9"),
    ("h", "li"),
    ("i", "!"),
    ("i", "1"),
    ("I", "1"),
    ("I", "l"),
    ("I", "|"),
    ("l", "1"),
    ("l", "I"),
    ("l", "|"),
    ("m", "rn"),
    ("n", "ri"),
    ("o", "0"),
    ("O", "0"),
    ("r", "f"),
    ("s", "5"),
    ("S", "5"),
    ("t", "+"),
    ("u", "ii"),
    ("z", "2"),
    ("Z", "2"),
)
#: Signs that stand for a letter when they touch one.
SIGNS = "@!+|"


def tolerant(word: str) -> str:
    """A pattern of a word that also matches what recognition may have made of it."""
    reads: dict[str, list[str]] = {}
    for true, seen in MISREAD:
        reads.setdefault(true, []).append(seen)
    out = []
    for c in word:
        options = [c, *reads.get(c, ())] + (reads.get("e", []) if c in "éèê" else [])
        if c in "éèê":
            options.append("e")
        if len(options) == 1:
            out.append("\\" + c if c in ".?*+()[]{}|\\^$" else c)
        else:
            out.append("(?:" + "|".join("\\" + o if o in "+|!@" and len(o) == 1 else o for o in dict.fromkeys(options)) + ")")
    return "".join(out)
