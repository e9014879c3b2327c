"""Forms of text that operators of this subpackage compare: which characters look alike, and a loose folding.

Tables of more than a few dozen entries are built from the Unicode database by rule; the short ones are fixed values.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of other scripts that look like a Latin letter in common fonts.
LOOKALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "І": "I", "Ј": "J", "Ѕ": "S", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ё": "Ë", "Ї": "Ï",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ё": "ë", "ї": "ï",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ρ": "p",
    # Armenian, Latin and marks
    "օ": "o", "հ": "h", "ɑ": "a", "’": "'", "ʼ": "'", "‐": "-",
}

# Cyrillic letters in Latin writing.
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "j",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f",
    "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
    "і": "i", "ї": "i", "є": "e", "ґ": "g",
}

_PLAIN_TAGS = {"<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>", "<isolated>", "<final>", "<initial>", "<medial>"}
_MULTI = [*range(0xFB00, 0xFB07), *range(0x2024, 0x2027), *range(0x0132, 0x0134), *range(0x2160, 0x2180)]


@lru_cache
def invisible() -> str:
    """Characters that take no room on the page: format characters, soft hyphen, variation selectors."""
    out = [chr(c) for c in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cf" and not 0xE0000 <= c < 0xE0080]
    return "".join(out) + "͏ᅟᅠ឴឵ㅤ" + "".join(map(chr, range(0xFE00, 0xFE10)))


@lru_cache
def single_forms() -> dict[str, str]:
    """One character for one: compatibility forms that look like their plain form, all spaces, look-alike letters."""
    out = {}
    for c in range(0x80, sys.maxunicode + 1):
        ch = chr(c)
        tag = unicodedata.decomposition(ch).split(" ")[0]
        plain = unicodedata.normalize("NFKC", ch) if tag in _PLAIN_TAGS else ch
        if unicodedata.category(ch) == "Zs" or ch in "  \x85":
            plain = " "
        if len(plain) == 1 and plain != ch:
            out[ch] = LOOKALIKES.get(plain, plain)
    out |= {"\t": " ", "\n": " ", "\r": " ", "\x0b": " ", "\x0c": " "}
    return out | LOOKALIKES


@lru_cache
def multi_forms() -> dict[str, str]:
    """One character for several: Latin ligatures, leader dots, digraphs and Roman numerals of one character."""
    forms = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in _MULTI}
    return {a: b for a, b in forms.items() if len(b) > 1}


@lru_cache
def bare_letters() -> dict[str, str]:
    """Latin letters without their accents, by rule, and the few that have no decomposition."""
    out = {}
    for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        plain = unicodedata.normalize("NFD", chr(c))
        if plain[0].isascii() and len(plain) > 1:
            out[chr(c)] = plain[0]
    return out | {"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ı": "i", "ð": "d", "Ð": "D"}


@lru_cache
def python_forms() -> dict[int, str]:
    """All forms in one table for ``str.translate``: visible look, invisible characters dropped."""
    out = {ord(a): b for a, b in (single_forms() | multi_forms()).items()}
    return out | {ord(c): None for c in invisible()}


@lru_cache
def fold_forms() -> tuple[str, str]:
    """``from``, ``to`` for the JVM's translate: look, accents and case in one pass; what is dropped has no partner."""
    table = {}
    marks = [chr(c) for c in range(0x300, 0x370)]
    for a, b in single_forms().items():
        if ord(a) < 0x10000:
            table[a] = bare_letters().get(b, b).lower()[:1]
    for a, b in bare_letters().items():
        table[a] = b.lower()
    for c in [*range(0x41, 0x5B), *range(0x391, 0x3AA), *range(0x400, 0x430)]:
        table.setdefault(chr(c), chr(c).lower())
    gone = [c for c in invisible() if ord(c) < 0x10000] + marks
    keep = [a for a in table if a not in gone]
    return "".join(keep) + "".join(gone), "".join(table[a] for a in keep)


def loose(c: Column) -> Column:
    """A loose form, but for runs of spaces: look-alikes, accents and case don't matter. ASCII needs no long table."""
    ascii_form = F.translate(F.lower(c), "\t\n\x0b\x0c\r", "     ")
    return F.when(F.octet_length(c) == F.char_length(c), ascii_form).otherwise(F.translate(c, *fold_forms()))


@lru_cache
def _scripts() -> tuple[set[str], set[str]]:
    """Cyrillic letters that look like Latin ones, and those that don't."""
    alike = {c for c in LOOKALIKES if "CYRILLIC" in unicodedata.name(c, "")}
    every = {c for c in map(chr, range(0x400, 0x460)) if c.isalpha()}
    return alike, every - alike


@lru_cache
def _gone() -> dict[int, None]:
    return {ord(c): None for c in invisible()}


_CYRILLIC, _MARKS = re.compile("[\u0400-\u045f]"), re.compile("[\u0300-\u036f]+")
_LETTERS = [("ß", "ss"), ("ł", "l"), ("ø", "o"), ("đ", "d"), ("ı", "i")]
_ASCII_SPACES = {9: " ", 10: " ", 11: " ", 12: " ", 13: " "}


def latin(text: str) -> str:
    """Lower-case Latin writing without accents. Cyrillic words are transliterated; a letter of another script amid Latin
    ones, or a word of look-alikes only in a text without real Cyrillic, is taken for the letter it looks like."""
    if text.isascii():
        return text.translate(_ASCII_SPACES).lower()
    if _CYRILLIC.search(text):
        alike, real = _scripts()
        text = text.translate(_gone())
        truly = any(c in real for c in text)
        words, out = text.split(" "), []
        for w in words:
            has_latin = any(c.isalpha() and ord(c) < 0x250 for c in w)
            if any(c in real for c in w) or (truly and not has_latin):
                w = "".join(CYRILLIC.get(c.lower(), c) for c in w)
            out.append(w)
        text = " ".join(out)
    text = _MARKS.sub("", unicodedata.normalize("NFD", text.translate(python_forms()).lower()))
    for a, b in _LETTERS:
        if a in text:
            text = text.replace(a, b)
    return text


def phonetic(word: str) -> str:
    """Letters that writings of one name use for each other brought to one: c/k/q, v/w, i/y, ph/f, x/ks."""
    return (
        word.replace("ph", "f").replace("c", "k").replace("q", "k").replace("w", "v").replace("y", "i").replace("x", "ks")
    )


def deletions(word: str) -> list[str]:
    """The word and all words with one letter less: two words share one if they are one edit or swap apart."""
    return list({word, *(word[:i] + word[i + 1 :] for i in range(len(word)))})
