"""Text normalisation, substring patterns and location relevance."""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# A remote posting counts as relevant when its location names one of these.
RELEVANT_LOCATIONS = ["germany", "deutschland", "europe", "european", "eu", "emea", "worldwide", "anywhere"]


# Hangul syllables are composed by a rule of the Unicode standard, of so many leads, vowels and tails.
_HANGUL, _LEAD, _VOWEL, _TAIL = 0xAC00, 0x1100, 0x1161, 0x11A7
_LEADS, _VOWELS, _TAILS = 19, 21, 28


@functools.cache
def _decompositions() -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose decomposition without combining marks is one character or none, and those with several.

    Derived from the Unicode data; Hangul syllables follow from their code points.
    """
    short: dict[str, str] = {}
    long: dict[str, str] = {}
    for point in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= point < 0xE000 or _HANGUL <= point < _HANGUL + _LEADS * _VOWELS * _TAILS:
            continue
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(point)) if not unicodedata.combining(c))
        if plain != chr(point):
            (short if len(plain) < 2 else long)[chr(point)] = plain
    return short, long


def _character_class(characters: Iterable[str]) -> str:
    """Regex class of characters, as ranges."""
    ranges: list[list[int]] = []
    for point in sorted(map(ord, characters)):
        if ranges and ranges[-1][1] == point - 1:
            ranges[-1][1] = point
        else:
            ranges.append([point, point])
    return "[" + "".join(rf"\x{{{low:X}}}-\x{{{high:X}}}" for low, high in ranges) + "]"


def _spelled_out(text: Column) -> Column:
    """Characters that stand for several ones, taken apart one by one."""
    long = _decompositions()[1]
    # One literal, which Catalyst folds to a map.
    spelled = F.str_to_map(F.lit("\x02".join(f"{c}\x01{plain}" for c, plain in long.items())), F.lit("\x02"), F.lit("\x01"))

    def parts(first: int, n: int) -> Column:
        return F.array(*[F.lit(chr(first + i)) for i in range(n)])

    def apart(c: Column) -> Column:
        place = F.ascii(c) - _HANGUL
        tail = (place % _TAILS).cast("int")
        syllable = F.concat(
            F.get(parts(_LEAD, _LEADS), F.floor(place / (_VOWELS * _TAILS)).cast("int")),
            F.get(parts(_VOWEL, _VOWELS), F.floor(place % (_VOWELS * _TAILS) / _TAILS).cast("int")),
            F.when(tail == 0, F.lit("")).otherwise(F.get(parts(_TAIL, _TAILS), tail)),
        )
        inside = (place >= 0) & (place < _LEADS * _VOWELS * _TAILS)
        return F.when(inside, syllable).otherwise(F.coalesce(F.try_element_at(spelled, c), c))

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), apart), "")


def norm_text(text: Column) -> Column:
    """NFKD without combining marks, lower case, whitespace collapsed and trimmed; NULL becomes ''.

    Built of deterministic expressions, so filters pass it on their way to the scan. Only values with a non-ASCII
    character are looked up in the decompositions, and only those with a character that stands for several are taken apart.
    """
    short, long = _decompositions()
    filled = F.coalesce(text, F.lit(""))
    apart = F.when(
        filled.rlike(_character_class([*long, *map(chr, range(_HANGUL, _HANGUL + _LEADS * _VOWELS * _TAILS))])), _spelled_out(filled)
    ).otherwise(filled)
    # Characters beyond the replacements, the marks, are deleted.
    kept = [c for c, plain in short.items() if plain]
    gone = [c for c, plain in short.items() if not plain]
    plain = F.when(
        filled.rlike(r"[^\x00-\x7F]"), F.translate(apart, "".join([*kept, *gone]), "".join(short[c] for c in kept))
    ).otherwise(filled)
    return F.trim(F.regexp_replace(F.lower(plain), r"(?U)[\s\x1C-\x1F]+", " "))


def lower_trim(text: Column) -> Column:
    """Lower case, trimmed; NULL becomes ''."""
    return F.lower(F.trim(F.coalesce(text, F.lit(""))))


def blank_to_null(text: Column) -> Column:
    """'' counts as missing."""
    return F.nullif(text, F.lit(""))


def like_anywhere(text: Column, wanted: str) -> Column:
    """Case-insensitive substring match; % and _ in the wanted text stay wildcards.

    Without wildcards Catalyst turns the LIKE into a plain contains.
    """
    pattern = "%" + wanted.lower().replace("\\", "\\\\") + "%"
    return F.lower(text).like(pattern)


def is_relevant_location(location: Column) -> Column:
    """Blank, or naming one of the relevant areas anywhere in the text."""
    text = F.lower(F.coalesce(location, F.lit("")))
    relevant = F.trim(text) == ""
    for word in RELEVANT_LOCATIONS:
        relevant = relevant | text.contains(word)
    return relevant


def is_json_object(text: Column) -> Column:
    return F.coalesce(F.ltrim(text).startswith("{"), F.lit(False))
