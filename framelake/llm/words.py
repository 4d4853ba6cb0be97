"""Words compared without case, accents, compatibility forms and invisible characters."""

from __future__ import annotations

import re
import unicodedata

_WORD = re.compile(r"[^\W_]+")


def characters(categories: tuple[str, ...], end: int = 0x110000) -> re.Pattern:
    """Runs of characters of some Unicode categories, those from ``end`` on left out; ranges make the class fast."""
    out, first = [], None
    for c in range(end + 1):
        inside = c < end and unicodedata.category(chr(c)) in categories
        if inside and first is None:
            first = c
        elif not inside and first is not None:
            out.append(f"{re.escape(chr(first))}-{re.escape(chr(c - 1))}")
            first = None
    return re.compile("[" + "".join(out) + "]+")


#: Combining marks and format characters (soft hyphen, joiners, marks of direction): in the basic plane, and in all.
_DROP = ("Mn", "Mc", "Me", "Cf")
_BASIC, _ALL, _BEYOND = characters(_DROP, 0x10000), characters(_DROP), re.compile("[\U00010000-\U0010ffff]")


def fold(text: str) -> str:
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", text)
    drop = _ALL if _BEYOND.search(text) else _BASIC
    text = drop.sub("", text).casefold()
    if unicodedata.is_normalized("NFKD", text) and not drop.search(text):
        return text
    return drop.sub("", unicodedata.normalize("NFKD", text))


def words(text: str | None) -> list[str]:
    """Runs of letters and digits of the folded text; null gives none."""
    return _WORD.findall(fold(text)) if text else []
