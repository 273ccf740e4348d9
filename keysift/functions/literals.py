"""Literals that any match of a regex must hold, found from the pattern alone.

``required(pattern)`` gives strings of which every match holds at least one, once the text is lowercased:
a text that holds none of them needs no regex. Where a part of a pattern is unknown here, it is taken to
match anything; where nothing certain is left, there are no literals.

The parse tree is that of Python's ``re``, whose syntax the rules are written in. What Java reads
otherwise (nested or intersected classes, octal escapes, patterns with free spacing) has no literals.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

try:
    from re import _constants as names
    from re import _parser as parser
except ImportError:  # a Python that keeps its parser elsewhere: patterns then have no literals
    names = parser = None

#: Strings that a part may match, at most; beyond that it is unknown.
MOST = 24
#: Literals longer than this tell no more texts apart.
LONGEST = 40
# What Java folds to these letters, beyond upper and lower case, as it stands in a lowercased text.
FOLDED = {"s": ("s", "ſ"), "i": ("i", "ı", "i̇")}

# Exact: all strings that a part can match, or None. Held: strings of which one is in any match, or None.
Strings = frozenset[str]


def _shortened(found: Iterable[str]) -> Strings:
    """Without strings that hold another one: those are found with it."""
    kept: list[str] = []
    for text in sorted(set(found), key=lambda s: (len(s), s)):
        if not any(k in text for k in kept):
            kept.append(text)
    return frozenset(kept)


def _better(a: Strings | None, b: Strings | None) -> Strings | None:
    """Of two sets of literals, the one that lets fewer texts through, judged by its shortest."""

    def worth(found: Strings) -> tuple[int, int]:
        return min(min(map(len, found)), LONGEST), -len(found)

    candidates = [found for found in (a, b) if found and "" not in found]
    return max(candidates, key=worth, default=None)


def _letter(code: int, ignore_case: bool, all_unicode: bool) -> Strings | None:
    """How one character can stand in a lowercased text; None where lowercasing is not plain."""
    if code >= 0x80:
        return None
    letter = chr(code).lower()
    return frozenset(FOLDED.get(letter, (letter,))) if ignore_case and all_unicode else frozenset([letter])


def _class(items: list, ignore_case: bool, all_unicode: bool) -> Strings | None:
    found: set[str] = set()
    for kind, value in items:
        if kind is names.LITERAL:
            codes = [value]
        elif kind is names.RANGE and value[1] - value[0] < MOST:
            codes = range(value[0], value[1] + 1)
        else:
            return None
        for code in codes:
            letters = _letter(code, ignore_case, all_unicode)
            if letters is None:
                return None
            found |= letters
    return frozenset(found) if 0 < len(found) <= MOST else None


def _both(exact: Strings | None, held: Strings | None) -> Strings | None:
    return _better(_shortened(exact) if exact else None, held)


def _sequence(parts, ignore_case: bool, all_unicode: bool) -> tuple[Strings | None, Strings | None]:
    """Exact and held strings of parts one after the other: products of neighbours that are exact."""
    run: Strings = frozenset([""])
    held: Strings | None = None
    known = True
    for part in parts:
        exact, inside = _part(part, ignore_case, all_unicode)
        held = _better(held, inside)
        if exact is not None and len(run) * len(exact) <= MOST and max(map(len, run)) <= LONGEST:
            run = frozenset(a + b for a in run for b in exact)
            continue
        held = _better(held, _shortened(run))
        known = False
        run = exact if exact is not None else frozenset([""])
    if known:
        return run, held
    return None, _better(held, _shortened(run))


def _part(part, ignore_case: bool, all_unicode: bool) -> tuple[Strings | None, Strings | None]:
    kind, value = part
    if kind is names.LITERAL:
        return _letter(value, ignore_case, all_unicode), None
    if kind is names.IN:
        return _class(value, ignore_case, all_unicode), None
    if kind in (names.AT, names.ASSERT, names.ASSERT_NOT):
        return frozenset([""]), None
    if kind is names.SUBPATTERN:
        _, on, off, inner = value
        ignore_case = (ignore_case or bool(on & re.IGNORECASE)) and not off & re.IGNORECASE
        return _sequence(inner, ignore_case, all_unicode)
    if kind is names.ATOMIC_GROUP:
        return _sequence(value, ignore_case, all_unicode)
    if kind is names.BRANCH:
        branches = [_sequence(branch, ignore_case, all_unicode) for branch in value[1]]
        exact = [e for e, _ in branches]
        together = frozenset().union(*exact) if all(e is not None for e in exact) else None
        held = [_both(e, h) for e, h in branches]
        all_held = _shortened(frozenset().union(*held)) if all(held) else None
        return (together if together is None or len(together) <= MOST else None), all_held
    if kind in (names.MAX_REPEAT, names.MIN_REPEAT, names.POSSESSIVE_REPEAT):
        least, most, inner = value
        exact, held = _sequence(inner, ignore_case, all_unicode)
        if exact is not None and (least, most) == (0, 1):
            return exact | {""}, None
        if exact is not None and least == most and len(exact) ** max(least, 1) <= MOST and least <= LONGEST:
            whole = frozenset([""])
            for _ in range(least):
                whole = frozenset(a + b for a in whole for b in exact)
            return whole, None
        if least == 0:
            return None, None
        # At least so many in a row, if only one string can be repeated.
        if exact is not None and len(exact) == 1:
            (one,) = exact
            return None, _better(frozenset([one * min(least, LONGEST)]), held)
        return None, _both(exact, held)
    return None, None


# Escapes with digits, vertical space, quoted spans, classes inside classes: Java and Python differ on them.
_READ_OTHERWISE = re.compile(r"\\[0-9QEv]|\[\^?\]?[^\]\\]*(?:\\.[^\]\\]*)*\[|&&")


@lru_cache(maxsize=4096)
def required(pattern: str, ignore_case: bool = False, all_unicode: bool = True, free_spacing: bool = False) -> tuple[str, ...]:
    """Strings of which any match holds at least one, up to case; none if nothing is certain."""
    if parser is None or free_spacing or _READ_OTHERWISE.search(pattern):
        return ()
    try:
        tree = parser.parse(pattern, re.IGNORECASE if ignore_case else 0)
    except (re.error, RecursionError, OverflowError):
        return ()
    if tree.state.flags & (re.VERBOSE | re.LOCALE):
        return ()
    exact, held = _sequence(tree, bool(tree.state.flags & re.IGNORECASE), all_unicode)
    found = _both(exact, held)
    if not found:
        return ()
    return tuple(sorted({text[:LONGEST] for text in found}))


def holds_any(lowered: Column, literals: Iterable[str]) -> Column:
    """Whether a lowercased text holds one of the literals; each is looked for once."""
    found = F.lit(False)
    for literal in sorted(_shortened(literals), key=lambda s: (-len(s), s)):
        found = found | lowered.contains(F.lit(literal))
    return found
