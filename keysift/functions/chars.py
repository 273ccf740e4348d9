"""Character classes, as the inside of a regex bracket. Valid in Java and in RE2.

Engine shorthands (``\\s``, ``\\d``, POSIX names) are avoided: they differ between engines in what
they include beyond ASCII.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 special characters of the text profile (no quotes, no backslash).
SPECIAL = r"!@#$%^&*()_+=\[\]{}|;:,.<>?/~`\-"
# The special characters of the classifier profile, which also count quotes.
SPECIAL_WITH_QUOTES = SPECIAL + "'\""
# The characters Python's str.isspace accepts.
WHITESPACE = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# The same characters, as Java alone reads it and tests it twice as fast. (?U) extends \s to all of
# Unicode; it goes first in a pattern.
SPACES = r"(?U)[\s\x1c-\x1f]+"
# Code points that make a text binary wherever they occur.
BINARY = r"\x00-\x08\x0e-\x1f\x7f\x{100}-\x{10ffff}"
# Of the code points left, those that Python counts as printable.
PRINTABLE = r" -~\x{a1}-\x{ac}\x{ae}-\x{ff}"

# Each class by name; anything in none of them is "other".
CLASSES = {"upper": "A-Z", "lower": "a-z", "digit": "0-9", "special": SPECIAL}
# The complement of the classes, spelled out: Java tests a negated list of ranges far more slowly.
OTHER = r"\x00-\x20\"'\\\x7f-\x{10ffff}"


# Common characters outside a Unicode class, in plain ranges that a regex tests fast.
NEVER_UPPER = r"\x00-@\[-\x{bf}\x{df}-\x{ff}"
NEVER_DIGIT = r"\x00-/:-\x{b1}\x{b4}-\x{b8}\x{ba}-\x{65f}"


@lru_cache
def unicode_digits() -> str:
    """Bracket contents matching what ``str.isdigit`` accepts: decimals and other digit forms."""
    extra = [
        cp
        for cp in range(sys.maxunicode + 1)
        if chr(cp).isdigit() and unicodedata.category(chr(cp)) != "Nd"
    ]
    return r"\p{Nd}" + code_point_ranges(extra)


def code_point_ranges(code_points: list[int]) -> str:
    """Bracket contents matching the given ascending code points."""
    ranges: list[list[int]] = []
    for cp in code_points:
        if ranges and ranges[-1][1] == cp - 1:
            ranges[-1][1] = cp
        else:
            ranges.append([cp, cp])
    return "".join(f"\\x{{{first:x}}}-\\x{{{last:x}}}" for first, last in ranges)


def count_in(text: Column, bracket: str, never: str | None = None) -> Column:
    """Number of characters of ``text`` in a class, by removing runs of all others.

    ``never`` is a cheap class known to be outside; it goes first, leaving little to test."""
    if never is not None:
        text = F.regexp_replace(text, f"[{never}]+", "")
    return F.length(F.regexp_replace(text, f"[^{bracket}]+", ""))


def strip(text: Column) -> Column:
    """``str.strip``: Unicode whitespace off both ends (SQL ``trim`` only takes spaces)."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def char_class(char: Column) -> Column:
    """Class name of a one-character string."""
    result = F.when(char.isNull(), F.lit(None).cast("string"))
    for name, bracket in CLASSES.items():
        result = result.when(char.rlike(f"^[{bracket}]$"), F.lit(name))
    return result.otherwise(F.lit("other"))
