"""Two forms of a text: ``visual`` (what it looks like) and ``fold`` (what it says).

``visual`` keeps everything that shows: letter case, accents, marks, number of spaces. It changes
only what does not show: width, ligatures and presentation forms, composed or combining accents,
invisible characters, the kind of a space, look-alike letters. ``fold`` goes on to drop case,
accents, marks and the spelling variants of Arabic letters. Null stays null, empty stays empty.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Letters of other alphabets that look like a Latin letter, and that letter, in the same order.
_CYRILLIC = "АВЕКМНОРСТУХІЅЈаеорсухіѕјԁһԛԝ"
_CYRILLIC_AS = "ABEKMHOPCTYXISJaeopcyxisjdhqw"
_GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧον"
_GREEK_AS = "ABEZHIKMNOPTYXov"
# Letters and marks that look alike within Arabic and among hyphens.
_OTHER = "یکھہ‐‑"
_OTHER_AS = "يكهه--"

LOOKALIKES: dict[str, str] = dict(zip(_CYRILLIC + _GREEK + _OTHER, _CYRILLIC_AS + _GREEK_AS + _OTHER_AS, strict=True))

#: Kinds of compatibility decomposition that do not change how a character looks.
_SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<compat>", "<isolated>", "<initial>", "<medial>", "<final>")

# Arabic letters that are written for one another.
_ARABIC = str.maketrans("أإآٱىةؤئ", "اااايهوي", "ـ")


@lru_cache(maxsize=100_000)
def look(char: str) -> str:
    """What one character looks like, in decomposed plain characters; '' for one that does not show."""
    category = unicodedata.category(char)
    if category == "Cf" or char in "͏ᅟᅠㅤ︎️":
        return ""
    if category == "Zs":
        return " "
    if char in LOOKALIKES:
        return LOOKALIKES[char]
    how = unicodedata.decomposition(char)
    if not how:
        return unicodedata.normalize("NFD", char)  # syllables are composed by rule
    if how.startswith("<"):
        kind, _, rest = how.partition(" ")
        if kind not in _SAME_LOOK:
            return char
        parts = "".join(chr(int(x, 16)) for x in rest.split())
    else:
        parts = unicodedata.normalize("NFD", char)
    return parts if parts == char else "".join(look(c) for c in parts)


class _Looks(dict):
    """Code point -> what it looks like; filled as characters are met."""

    def __missing__(self, code: int) -> str:
        self[code] = out = look(chr(code))
        return out


class _Folds(dict):
    """Code point -> what it says: look-alikes, case, accents and Arabic variants taken out in one step."""

    def __init__(self, glue: str):
        super().__init__()
        self.marks = {ord(c): "" for c in glue} | {ord("&"): " and "}

    def __missing__(self, code: int) -> str:
        plain = unicodedata.normalize("NFKD", look(chr(code))).casefold()
        bare = "".join(c for c in plain if not unicodedata.combining(c)).translate(_ARABIC)
        self[code] = out = bare.translate(self.marks)  # of any width
        return out


LOOKS = _Looks()
_FOLDS: dict[str, _Folds] = {}


def visual(text: str | None) -> str | None:
    """The text as it looks, in composed form."""
    if text is None or text.isascii():
        return text
    return unicodedata.normalize("NFC", text.translate(LOOKS))


_GAPS = re.compile(r"[\W_]+")


def folds(glue: str = "'\u2019") -> _Folds:
    """The translation table of ``fold``: for texts whose marks and line breaks are still needed."""
    if glue not in _FOLDS:
        _FOLDS[glue] = _Folds(glue)
    return _FOLDS[glue]


def fold(text: str | None, glue: str = "'\u2019") -> str | None:
    """Words of the text in lower case without accents and marks, one space between them.

    Characters in ``glue`` vanish without parting a word. "&" reads "and".
    """
    if text is None:
        return None
    return _GAPS.sub(" ", text.translate(folds(glue))).strip()


_DIGIT_AS = str.maketrans("0135", "oles")
_MIXED = re.compile(r"[^\W\d_]*\d[^\W_]*[^\W\d_]|[^\W\d_]+[^\W_]*\d")


def read_digits(word: str) -> str:
    """A word in which digits stand for look-alike letters, as in "m0ney"; numbers stay as they are."""
    if word.isalpha() or not _MIXED.search(word):
        return word
    letters = sum(c.isalpha() for c in word)
    return word.translate(_DIGIT_AS) if letters >= len(word) - letters and letters >= 2 else word


def distance(a: str, b: str, most: int) -> int:
    """Edits between two words (change, add, drop a letter, swap two neighbours); ``most`` + 1 if more."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    before: list[int] = []
    row = list(range(m + 1))
    for i in range(1, n + 1):
        older, before = before, row
        row = [i] + [0] * m
        x = a[i - 1]
        for j in range(1, m + 1):
            y = b[j - 1]
            best = before[j - 1] + (x != y)
            if before[j] + 1 < best:
                best = before[j] + 1
            if row[j - 1] + 1 < best:
                best = row[j - 1] + 1
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and older[j - 2] + 1 < best:
                best = older[j - 2] + 1
            row[j] = best
        if min(row) > most:
            return most + 1
    return min(row[m], most + 1)
