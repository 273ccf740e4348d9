"""Text normalisation before the character n-grams: lowercase and accents off. All of it in the JVM."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from keysift.functions.chars import code_point_ranges

# Where Unicode's Hangul syllables lie, and the parts they are composed of.
HANGUL = (0xAC00, 0xD7A3)
LEADS, VOWELS, TAILS = 0x1100, 0x1161, 0x11A7
N_VOWELS, N_TAILS = 21, 28


def _decomposed(char: str) -> str:
    """Compatibility decomposition without combining marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))


@lru_cache
def _tables() -> tuple[str, str, dict[str, str]]:
    """From Python's Unicode tables: the characters that become one other, followed by those that vanish;
    the replacements in the same order; and those that become several. Hangul syllables are in none."""
    single, targets, removed, several = [], [], [], {}
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF or HANGUL[0] <= cp <= HANGUL[1]:
            continue
        char = chr(cp)
        plain = _decomposed(char)
        if plain == char:
            continue
        if len(plain) > 1:
            several[char] = plain
        elif plain:
            single.append(char)
            targets.append(plain)
        else:
            removed.append(char)
    return "".join(single + removed), "".join(targets), several


@lru_cache
def _several_class() -> str:
    return code_point_ranges(sorted(map(ord, _tables()[2])))


# Common characters that stay one: a fast first test before the long list of those that become several.
_STAY_ONE = r"\x00-\x{bb}\x{bf}-\x{131}\x{2010}\x{2012}-\x{2016}\x{2018}-\x{2023}"


def becomes_longer(text: Column) -> Column:
    """True for texts with a character that decomposes to several, such as a ligature, a fraction or a
    Hangul syllable. The long list is only tried on what is left without the usual alphabets."""
    rest = F.regexp_replace(text, f"[{_STAY_ONE}]+", "")
    syllables = code_point_ranges(list(range(HANGUL[0], HANGUL[1] + 1)))
    return (rest != "") & rest.rlike(f"[{syllables}{_several_class()}]")


def _part(first: int, count: int, index: Column) -> Column:
    """The character ``index`` places after code point ``first``, by its place in a string of them all."""
    return F.substring(F.lit("".join(chr(first + i) for i in range(count))), index + 1, F.lit(1))


def _spelled_out(char: Column) -> Column:
    """One character as what it decomposes to."""
    place = F.ascii(char) - HANGUL[0]
    tail = place % N_TAILS
    syllable = F.concat(
        _part(LEADS, 19, F.floor(place / (N_VOWELS * N_TAILS)).cast("int")),
        _part(VOWELS, N_VOWELS, F.floor(place % (N_VOWELS * N_TAILS) / N_TAILS).cast("int")),
        F.when(tail == 0, F.lit("")).otherwise(_part(TAILS, N_TAILS, tail)),
    )
    # One string literal, which becomes a map once per query. The separators are no character's target.
    pairs = "\x01".join(f"{char}\x02{plain}" for char, plain in _tables()[2].items())
    several = F.str_to_map(F.lit(pairs), F.lit("\x01"), F.lit("\x02"))
    return (
        F.when(char < F.lit("\xbc"), char)
        .when(char.between(F.lit(chr(HANGUL[0])), F.lit(chr(HANGUL[1]))), syllable)
        .when(char.rlike(f"[{_several_class()}]"), several[char])
        .otherwise(char)
    )


def strip_accents(text: Column, exact: bool = True) -> Column:
    """Decompose (NFKD) and drop combining marks.

    As marks are dropped, each character decomposes on its own. ``translate`` covers all that become one
    character or none. Texts with a character that becomes several are spelled out one by one. Without
    ``exact`` those characters stay.
    """
    source, targets, _ = _tables()
    plain = F.when(text.rlike("[^\\x00-\\x7f]"), F.translate(text, source, targets)).otherwise(text)
    if not exact:
        return plain
    chars = F.regexp_extract_all(plain, F.lit("(?s)."), F.lit(0))
    longer = F.array_join(F.transform(chars, _spelled_out), "")
    return F.when(becomes_longer(plain), longer).otherwise(plain)


def normalize_text(text: Column, exact: bool = True) -> Column:
    return strip_accents(F.lower(text), exact)
