"""License scans by template matching.

A template is a license text with markup: words that must stand as they are, optional regions in
``[ ]`` (nested if need be), and replaceable regions ``{n}`` of up to n words. It compiles to a token
automaton: states joined by steps on one word, on any word, or on nothing. A text carries a
license where some run of its words leads from the first state to the last.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator, Mapping
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysift.llm.common import small_batches

# What a word is, after A-Z are lowered.
TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The base phrases and their labels.
PHRASES = {
    "cc-by": "cc by",
    "gpl": "general public license",
    "reserved": "all rights reserved",
}
# Templates in lower-case words. [ ] optional, {n} up to n words of any kind.
# Labels ending in ``-text`` are the whole wording of a licence, those ending in ``-notice`` the whole
# notice its publisher gives; what ``SHORT`` names is less.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license [version] 2 0 [the license]",
    "bsd": "redistribution and use in source and binary forms with or without modification "
    "are permitted provided that the following conditions are met",
    "bsd-2-clause-text": "redistribution and use in source and binary forms with or without modification "
    "are permitted provided that the following conditions are met [1] redistributions of source code "
    "must retain the above copyright notice this list of conditions and the following disclaimer [2] "
    "redistributions in binary form must reproduce the above copyright notice this list of conditions "
    "and the following disclaimer in the documentation and or other materials provided with the "
    "distribution this "
    "software is provided by {8} as is and any express or implied warranties including but not limited "
    "to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
    "in no event shall {8} be liable for any direct indirect incidental special exemplary or "
    "consequential damages including but not limited to procurement of substitute goods or services "
    "loss of use data or profits or business interruption however caused and on any theory of "
    "liability whether in contract strict liability or tort including negligence or otherwise arising "
    "in any way out of the use of this software even if advised of the possibility of such damage",
    "bsd-3-clause-text": "redistribution and use in source and binary forms with or without modification "
    "are permitted provided that the following conditions are met [1] redistributions of source code "
    "must retain the above copyright notice this list of conditions and the following disclaimer [2] "
    "redistributions in binary form must reproduce the above copyright notice this list of conditions "
    "and the following disclaimer in the documentation and or other materials provided with the "
    "distribution [3] neither the name of {10} nor the names of {3} contributors may be used to endorse "
    "or promote products derived from this software without specific prior written permission this "
    "software is provided by {8} as is and any express or implied warranties including but not limited "
    "to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
    "in no event shall {8} be liable for any direct indirect incidental special exemplary or "
    "consequential damages including but not limited to procurement of substitute goods or services "
    "loss of use data or profits or business interruption however caused and on any theory of "
    "liability whether in contract strict liability or tort including negligence or otherwise arising "
    "in any way out of the use of this software even if advised of the possibility of such damage",
    "cc-by-4.0": "[this {3} is] licensed under [a] [the] [creative commons] "
    "[attribution] cc by 4 0 [international]",
    "cc-by-nc-4.0": "[this {3} is] licensed under [a] [the] cc by nc 4 0 [international]",
    "cc-by-sa-4.0": "[this {3} is] licensed under [a] [the] cc by sa 4 0 [international]",
    "copyright": "copyright [c] {8} all rights reserved",
    "gpl-any": "licensed under the [terms of the] [gnu] general public license",
    "gpl-2.0": "licensed under the [terms of the] gnu general public license "
    "[as published by the free software foundation] [either] version 2 [or later]",
    "gpl-3.0": "licensed under the [terms of the] gnu general public license "
    "[as published by the free software foundation] [either] version 3 [or later]",
    "lgpl": "licensed under the [terms of the] gnu lesser general public license",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this "
    "software and associated documentation files {4} to deal in {2} software without restriction",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this "
    "software and associated documentation files the software to deal in the software without "
    "restriction including without limitation the rights to use copy modify merge publish distribute "
    "sublicense and or sell copies of the software and to permit persons to whom the software is "
    "furnished to do so subject to the following conditions the above copyright notice and this "
    "permission notice [including the next paragraph] shall be included in all copies or substantial "
    "portions of the software the software is provided as is without warranty of any kind express or "
    "implied including but not limited to the warranties of merchantability fitness for a particular "
    "purpose and noninfringement in no event shall the {8} be liable for any claim damages or other "
    "liability whether in an action of contract tort or otherwise arising from out of or in connection "
    "with the software or the use or other dealings in the software",
    "gpl-2.0-notice": "redistribute it and or modify it under the terms of the gnu general public "
    "license as published by the free software foundation either version 2 of the license "
    "or [at your option] any later version",
    "gpl-3.0-notice": "redistribute it and or modify it under the terms of the gnu general public "
    "license as published by the free software foundation either version 3 of the license "
    "or [at your option] any later version",
    "lgpl-2.1-notice": "redistribute it and or modify it under the terms of the gnu lesser general public "
    "license as published by the free software foundation either version 2 1 of the license "
    "or [at your option] any later version",
    "lgpl-3.0-notice": "redistribute it and or modify it under the terms of the gnu lesser general public "
    "license as published by the free software foundation either version 3 of the license "
    "or [at your option] any later version",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license "
    "[v] {1} 2 0",
    "apache-2.0-notice": "licensed under the apache license version 2 0 the license you may not use this "
    "file except in compliance with the license you may obtain a copy of the license at {1} www apache "
    "org licenses license 2 0 unless required by applicable law or agreed to in writing software "
    "distributed under the license is distributed on an as is basis without warranties or conditions "
    "of any kind either express or implied see the license for the specific language governing "
    "permissions and limitations under the license",
    "mpl-2.0-notice": "this source code form is subject to the terms of the mozilla public license v 2 0 "
    "if a copy of the mpl was not distributed with this file you can obtain one at {1} mozilla org mpl 2 0",
}
# Opening clauses and short notices: they name a licence and do not state it.
SHORT = frozenset(
    "apache-2.0 bsd cc-by-4.0 cc-by-nc-4.0 cc-by-sa-4.0 copyright gpl-any gpl-2.0 gpl-3.0 lgpl mit mpl-2.0".split()
)

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Automaton(NamedTuple):
    """``steps[state][word]`` and ``any_word[state]`` name the next state, ``free[state]`` those
    reached without a word."""

    steps: list[dict[str, int]]
    any_word: list[int | None]
    free: list[list[int]]
    last: int


def parse(template: str) -> list:
    """Words as strings, replaceable regions as numbers, optional regions as lists."""
    stack: list[list] = [[]]
    for piece in re.findall(r"\[|\]|\{\d+\}|[^\s\[\]{}]+", template):
        if piece == "[":
            stack.append([])
        elif piece == "]":
            if len(stack) == 1:
                raise ValueError(f"] without [ in template: {template}")
            done = stack.pop()
            stack[-1].append(done)
        elif piece[0] == "{":
            stack[-1].append(int(piece[1:-1]))
        else:
            stack[-1].append(piece)
    if len(stack) != 1:
        raise ValueError(f"[ without ] in template: {template}")
    return stack[0]


def compile_template(template: str) -> Automaton:
    """The automaton of a template, which must hold a word that is not optional."""
    parts = parse(template)
    if not any(isinstance(part, str) for part in parts):
        raise ValueError(f"template without mandatory words: {template!r}")
    made = Automaton([{}], [None], [[]], 0)

    def state() -> int:
        made.steps.append({})
        made.any_word.append(None)
        made.free.append([])
        return len(made.steps) - 1

    def chain(at: int, parts: list) -> int:
        for part in parts:
            if isinstance(part, str):
                after = state()
                made.steps[at][part] = after
                at = after
            elif isinstance(part, int):
                skips = [at]
                for _ in range(part):
                    after = state()
                    made.any_word[at] = after
                    at = after
                    skips.append(at)
                after = state()
                for skip in skips:
                    made.free[skip].append(after)
                at = after
            else:
                inner = state()
                made.free[at].append(inner)
                end = chain(inner, part)
                after = state()
                made.free[at].append(after)
                made.free[end].append(after)
                at = after
        return at

    return made._replace(last=chain(0, parts))


def closure(automaton: Automaton, states: set[int]) -> set[int]:
    """All states reached from some without a word."""
    todo, found = list(states), set(states)
    while todo:
        for after in automaton.free[todo.pop()]:
            if after not in found:
                found.add(after)
                todo.append(after)
    return found


def first_words(automaton: Automaton) -> set[str] | None:
    """Words a match can begin with; None if any word can."""
    states = closure(automaton, {0})
    if any(automaton.any_word[s] is not None for s in states):
        return None
    return {word for s in states for word in automaton.steps[s]}


def match_end(automaton: Automaton, words: list[str], start: int) -> int | None:
    """Where the longest match from ``start`` ends, or None."""
    states, best = closure(automaton, {0}), None
    at = start
    while True:
        if automaton.last in states:
            best = at
        if at == len(words):
            return best
        word, after = words[at], set()
        for s in states:
            if word in automaton.steps[s]:
                after.add(automaton.steps[s][word])
            if automaton.any_word[s] is not None:
                after.add(automaton.any_word[s])
        if not after:
            return best
        states = closure(automaton, after)
        at += 1


def tokens(text: str | None) -> list[str]:
    return re.findall(TOKEN, (text or "").translate(LOWER))


class Scanner:
    """All places where the templates of a set match."""

    def __init__(self, templates: Mapping[str, str]):
        self.automata = {label: compile_template(t) for label, t in templates.items()}
        self.by_first: dict[str, list[str]] = {}
        self.always: list[str] = []
        for label, automaton in self.automata.items():
            firsts = first_words(automaton)
            if firsts is None:
                self.always.append(label)
            for word in firsts or ():
                self.by_first.setdefault(word, []).append(label)

    def places(self, words: list[str]) -> Iterator[tuple[str, int, int]]:
        """``(label, first word, end)`` of the longest match from each word, in order of words."""
        get, always = self.by_first.get, self.always
        for at, word in enumerate(words):
            for label in (*get(word, ()), *always):
                end = match_end(self.automata[label], words, at)
                if end is not None and end > at:
                    yield label, at, end


RESULT = (
    "n_words long, phrases array<struct<label:string,start:int,end:int>>, "
    "licenses array<struct<label:string,start:int,end:int>>"
)


def scan(
    docs: DataFrame,
    *,
    text: str = "text",
    phrases: Mapping[str, str] = PHRASES,
    templates: Mapping[str, str] = TEMPLATES,
    out: str = "scan",
) -> DataFrame:
    """Rows of ``docs`` with a struct column ``out``: ``n_words``, ``phrases`` and ``licenses``.

    Both lists hold ``(label, start, end)`` in words, in order: every place of a phrase, and the
    longest match of a template from each word it can begin at. A null text is empty and has none. A
    column named ``out`` is replaced. Each row is scanned by itself, in time linear in its words for
    a given set of templates; repeated rows, ties and an empty table need no rule of their own.
    """
    small_batches(docs)
    found_phrases, found_templates = dict(phrases), dict(templates)

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        base, own = Scanner(found_phrases), Scanner(found_templates)
        for texts in batches:
            rows = []
            for value in texts:
                words = tokens(value)
                rows.append((len(words), list(base.places(words)), list(own.places(words))))
            yield pd.DataFrame(rows, columns=["n_words", "phrases", "licenses"])

    return docs.withColumn(out, run(F.col(text)))


def joined(labels: Column) -> Column:
    """Distinct labels, sorted, comma-joined."""
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def score(phrases: Column, licenses: Column, short: Collection[str] = SHORT) -> Column:
    """1 where a whole text or notice matches, 0.75 where only ``short`` ones do, 0.5 where only a phrase
    does, else 0."""
    partly = F.when(F.size(phrases) > 0, F.lit(0.5)).otherwise(F.lit(0.0))
    named = F.when(F.size(licenses) > 0, F.lit(0.75)).otherwise(partly)
    stated = F.exists(licenses["label"], lambda label: ~label.isin(sorted(short)))
    return F.when(stated, F.lit(1.0)).otherwise(named)
