"""Benchmark decontamination: CGK embedding, bit-sampling LSH, edit verification.

The CGK random walk reads a sequence of words and at each step writes the word it stands on, then
stays or moves on by one, as a random bit of that word at that step says. Two sequences at a small
edit distance fall back into step after each edit, so what they write differs in few places: edit
distance becomes Hamming distance. Each repetition samples a few steps of the walk; an item
and a window that wrote the same words at these steps are candidates. Every place of every text
begins a window. The steps are looked at one after the other, and a window is dropped as soon as no
item goes on like it, which gives the same candidates as comparing whole samples. Each candidate
is verified by the exact edit distance between the item and the best run of words around the window.

The share of steps that survive falls with the length of the walk. Long items are therefore indexed as
stretches of at most ``stretch`` words, each with walks of its own: if a tenth of an item's words is
edited, some stretch has a tenth of its own words edited or fewer, so an item is found at least as
surely as one of that length.

Texts are scanned in place, without an exchange. The benchmark comes in blocks of bounded size, each
sent to all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysift.llm.common import forget, small_batches

# Scripts written without spaces: kana, Han, Thai, Lao, Burmese and Khmer, with their vowel signs.
UNSPACED = (
    r"\u0e01-\u0e3a\u0e40-\u0e4e\u0e81-\u0ece\u0edc-\u0edf\u1000-\u103f\u1050-\u108f\u1780-\u17d3"
    r"\u3005-\u3007\u3041-\u3096\u309d-\u309f\u30a1-\u30fa\u30fc-\u30ff\u31f0-\u31ff\u3400-\u4dbf"
    r"\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
)
# Letters and digits make words, each character of those scripts one; case and punctuation do not count.
TOKEN = rf"[{UNSPACED}]|[^\W_{UNSPACED}]+"
SPACED_TOKEN = r"[^\W_]+"
BLOCK_WORDS = 2_000_000


class Cgk(NamedTuple):
    """``percent`` of an item's words may be edited. ``repetitions`` samples of ``samples`` steps each:
    if a share q of the steps survives the edits, a window is found with probability
    1 - (1 - q^samples)^repetitions. The target is 0.99 for items of every length with all the edits
    allowed; q falls with length, so it is held by the walks of stretches of ``stretch`` words at most.
    Items of under ``least`` words, and those no edit is allowed in, are matched word for word."""

    percent: int = 10
    repetitions: int = 20
    samples: int = 5
    least: int = 8
    seed: int = 11
    stretch: int = 60


def words_of(text: str | None) -> list[str]:
    import re

    text = (text or "").lower()
    # The same words, found faster, where a text has none of those scripts.
    return re.findall(TOKEN if re.search(r"[\u0e01-\U0003ffff]", text) else SPACED_TOKEN, text)


def scrambled(values, salt: int):
    """Random 64 bits per value and salt (numpy)."""
    import numpy as np

    values = values + np.uint64((salt * 0x9E3779B97F4A7C15) % 2**64)
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def best_run(item: list[int], run: list[int]) -> tuple[int, int]:
    """Least edit distance of ``item`` to any part of ``run``, and where the leftmost such part ends.

    Bit-parallel: bit i of the vectors tells how row i + 1 of the table differs from row i.
    """
    m = len(item)
    where: dict[int, int] = {}
    for i, word in enumerate(item):
        where[word] = where.get(word, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for at, word in enumerate(run, 1):
        equal = where.get(word, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up = minus | ~(horizontal | plus) & full
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) & full
        down = (down << 1) & full
        plus = down | ~(vertical | up) & full
        minus = up & vertical
        if score < best:
            best, end = score, at
    return best, end


class Index(NamedTuple):
    """Items as word numbers, and per repetition the samples of their walks.

    Word 0 stands for every word that no item has: it equals no item's word, so distances to items
    stay as they are. A table holds its salt, its second step, and groups of stretches of like length:
    ``(anchor, steps)`` to sampled words to item numbers and offsets in the item. The walk starts
    ``anchor`` words into the stretch, so that no edit can spoil the first sample of every table.

    Items matched word for word are paths from node 0: ``(node, word)`` to the next node, and the items
    that end at a node.
    """

    numbers: dict[str, int]
    ids: list[int]
    items: list[list[int]]
    tables: list[tuple]
    paths: dict[tuple[int, int], int]
    ends: dict[int, list[int]]


def length_class(n: int) -> int:
    """Items of like length share the steps they are sampled at: powers of 1.25."""
    return math.floor(math.log(n, 1.25))


def stretches(item: list[int], most: int) -> Iterator[tuple[int, list[int]]]:
    """``(offset, words)`` of the fewest parts of like length with ``most`` words at most."""
    count = -(-len(item) // most)
    for k in range(count):
        first, last = k * len(item) // count, (k + 1) * len(item) // count
        yield first, item[first:last]


def build(items: list[tuple[int, str]], params: Cgk) -> Index:
    import numpy as np

    index = Index({}, [], [], [], {}, {})
    for item_id, text in items:
        words = words_of(text)
        if words:
            index.ids.append(item_id)
            numbers = index.numbers
            index.items.append([numbers.setdefault(w, len(numbers) + 1) for w in words])
    parts = []
    for number, item in enumerate(index.items):
        if len(item) >= params.least and len(item) * params.percent >= 100:
            parts += [(number, *part) for part in stretches(item, params.stretch)]
            continue
        node = 0
        for word in item:
            node = index.paths.setdefault((node, word), len(index.paths) + 1)
        index.ends.setdefault(node, []).append(number)
    classes = sorted({length_class(len(words)) for _, _, words in parts})
    random = np.random.default_rng(params.seed)
    for table in range(params.repetitions):
        share = random.random() / 2 if table else 0.0
        second = int(random.integers(1, 5))
        salt = int(random.integers(1, 2**31))
        shapes = {}
        for size in classes:
            least = max(params.least, int(1.25**size))
            anchor = int(share * least)
            reach = max(second + 2, int(1.4 * (least - anchor)))
            later = second + 1 + random.random(max(0, params.samples - 2)) * (reach - second - 1)
            shapes[size] = anchor, (0, second, *sorted({int(step) for step in later}))
        steps = max((steps[-1] for _, steps in shapes.values()), default=0)
        every = np.arange(len(index.numbers) + 1)
        moves = [bit(every, step, salt).tolist() for step in range(steps)]
        groups: dict[tuple, dict[tuple, list[tuple[int, int]]]] = {}
        for number, offset, words in parts:
            shape = shapes[length_class(len(words))]
            wrote = walk(words[shape[0] :], shape[1], moves)
            if wrote is not None:
                groups.setdefault(shape, {}).setdefault(wrote, []).append((number, offset))
        index.tables.append((salt, second, groups))
    return index


def bit(words, step: int, salt: int):
    """Whether the walk moves on from each word at a step (numpy)."""
    import numpy as np

    block = scrambled(words.astype(np.uint64), salt + step // 64)
    return ((block >> np.uint64(step % 64)) & np.uint64(1)).astype(np.int64)


def walk(words: list[int], steps: tuple[int, ...], moves: list[list[int]]) -> tuple | None:
    """What the walk over ``words`` writes at the given steps; None if it runs out before."""
    wrote, at, last = [], 0, 0
    for step in steps:
        for k in range(last, step):
            if at >= len(words):
                return None
            at += moves[k][words[at]]
        last = step
        if at >= len(words):
            return None
        wrote.append(words[at])
    return tuple(wrote)


class Members:
    """A set of integers that tests whole arrays (numpy): a bit map of a hash of each, then the sorted
    values."""

    BITS = 18

    def __init__(self, values):
        import numpy as np

        self.values = np.unique(values)
        self.marks = np.zeros(1 << self.BITS, bool)
        self.marks[self._slots(self.values)] = True

    def _slots(self, values):
        import numpy as np

        product = values.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (product >> np.uint64(64 - self.BITS)).view(np.int64)

    def among(self, values):
        """Positions of those in the set."""
        import numpy as np

        maybe = np.flatnonzero(self.marks.take(self._slots(values)))
        found = np.searchsorted(self.values, values.take(maybe))
        found = np.minimum(found, len(self.values) - 1)
        return maybe[self.values.take(found) == values.take(maybe)]


class Finder:
    """Candidates and verified matches in word numbers of many texts, one after the other (numpy).

    Sampled words are kept as one integer, each step's word appended as a digit to base ``n``. It may
    wrap around; what meets by chance is rejected by the exact distance.
    """

    def __init__(self, index: Index, params: Cgk):
        import numpy as np

        self.index, self.params = index, params
        self.n = np.int64(len(index.numbers) + 1)
        self.reach = 0
        every = np.arange(self.n)
        self.tables = []
        for salt, second, groups in index.tables:
            moves = [bit(every, k, salt) for k in range(second)]
            begins, pairs, by_shape = np.zeros(self.n, bool), [], []
            for (anchor, steps), group in groups.items():
                wrote = np.array(list(group), np.int64)
                begins[wrote[:, 0]] = True
                codes = [wrote[:, 0]]
                for k in range(1, wrote.shape[1]):
                    codes.append(codes[-1] * self.n + wrote[:, k])
                pairs.append(codes[1])
                items: dict[int, list[tuple[int, int]]] = {}
                for code, own in zip(codes[-1].tolist(), group.values()):
                    items.setdefault(code, []).extend(own)
                by_shape.append((anchor, steps, [Members(code) for code in codes[1:]], items))
                self.reach = max(self.reach, steps[-1])
            if pairs:
                pairs = Members(np.concatenate(pairs))
                self.tables.append((salt, second, moves, begins, pairs, by_shape))
        paths = sorted((node * int(self.n) + word, after) for (node, word), after in index.paths.items())
        self.paths, self.after = np.array(paths, np.int64).reshape(-1, 2).T
        self.firsts = np.zeros(self.n, bool)
        self.firsts[[word for node, word in index.paths if not node]] = True
        self.whole = np.zeros(len(index.paths) + 1, bool)
        self.whole[list(index.ends)] = True

    def exact(self, numbers, ends) -> Iterator[tuple[int, int, int]]:
        """``(item, row, end)`` of items that stand in a text word for word, the first place of each."""
        import numpy as np

        start = np.flatnonzero(self.firsts.take(numbers))
        limit = ends.take(np.searchsorted(ends, start, side="right"))
        node, at = np.zeros_like(start), start
        while len(start):
            inside = at < limit
            start, limit, node, at = start[inside], limit[inside], node[inside], at[inside]
            code = node * self.n + numbers.take(at)
            place = np.minimum(np.searchsorted(self.paths, code), len(self.paths) - 1)
            own = self.paths.take(place) == code
            start, limit, at = start[own], limit[own], at[own] + 1
            node = self.after.take(place[own])
            done = np.flatnonzero(self.whole.take(node))
            rows = np.searchsorted(ends, start[done], side="right")
            _, first = np.unique(rows * len(self.whole) + node[done], return_index=True)
            for k in first.tolist():
                for number in self.index.ends[int(node[done[k]])]:
                    yield number, int(rows[k]), int(at[done[k]])

    def candidates(self, numbers) -> set[tuple[int, int, int]]:
        """``(item, place, start)``: the walk starts at ``start``, and but for edits before it the
        item's first word stands at ``place``."""
        import numpy as np

        found: set[tuple[int, int, int]] = set()
        numbers = np.concatenate([numbers, np.zeros(self.reach + 1, np.int64)])
        for salt, second, moves, begins, pairs, by_shape in self.tables:
            start = np.flatnonzero(begins.take(numbers))
            word = numbers.take(start)
            code, at = word * self.n, start
            for step in range(second):
                at = at + moves[step].take(word)
                word = numbers.take(at)
            code = code + word
            hit = pairs.among(code)
            start, at, code = start[hit], at[hit], code[hit]
            for anchor, steps, members, items in by_shape:
                for begin, key in self._follow(numbers, start, at, code, salt, steps, members):
                    for number, offset in items[key]:
                        found.add((number, begin - anchor - offset, begin))
        return found

    def _follow(self, numbers, start, at, code, salt, steps, members):
        """``(start, sampled words)`` of walks, from the second step on, that go on like some item."""
        for k, step in enumerate(steps[1:], 1):
            if k > 1:
                for walked in range(steps[k - 1], step):
                    at = at + bit(numbers.take(at), walked, salt)
                code = code * self.n + numbers.take(at)
            own = members[k - 1].among(code)
            start, at, code = start[own], at[own], code[own]
            if not len(start):
                break
        return zip(start.tolist(), code.tolist())

    def matches(self, numbers, ends) -> list[list[tuple[int, int, int]]]:
        """Per text, ``(item, end, distance)``: of each item found the best run, the first of equals.

        ``ends`` are the ends of the texts in ``numbers``."""
        import numpy as np

        results: list[dict[int, tuple[int, int]]] = [{} for _ in ends]
        if len(numbers) == 0 or not self.index.items:
            return [[] for _ in ends]
        for number, row, end in self.exact(numbers, ends):
            results[row][number] = end - (int(ends[row - 1]) if row else 0), 0
        found = sorted(self.candidates(numbers))
        rows = np.searchsorted(ends, [begin for _, _, begin in found], side="right").tolist()
        done: dict[tuple[int, int], int] = {}
        for (number, place, _), row in zip(found, rows):
            # Candidates of one place lie close together: one look covers them.
            if place <= done.get((number, row), -(10**12)):
                continue
            item = self.index.items[number]
            allowed = len(item) * self.params.percent // 100
            slack = max(allowed, 2)
            low, high = (ends[row - 1] if row else 0), ends[row]
            first = max(low, place - slack)
            last = min(high, place + 2 * slack + len(item) + allowed)
            done[number, row] = place + slack
            distance, end = best_run(item, numbers[first:last].tolist())
            best = results[row]
            if distance <= allowed and (number not in best or distance < best[number][1]):
                best[number] = (int(first - low) + end, distance)
        return [[(number, *best[number]) for number in sorted(best)] for best in results]


def blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """The items with an id and a text, ``BLOCK_WORDS`` words or one item at a time."""
    block: list[tuple[int, str]] = []
    size = 0
    items = benchmark.select(F.col(item_id).alias("id"), F.col(text).alias("text")).dropna()
    for row in items.toLocalIterator():
        n = len(words_of(row.text))
        if block and size + n > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((row.id, row.text))
        size += n
    if block:
        yield block


MATCHES = "array<struct<item_id:long,end_word:int,n_words:int,distance:int>>"


def with_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    params: Cgk = Cgk(),
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    out: str = "matches",
) -> DataFrame:
    """Rows of ``docs`` with an array ``out``: the items a text holds, at ``percent`` edits or fewer.

    Items of under ``least`` words must stand word for word. Per item the end of the best run of words (words from 0, end exclusive), the item's length and the
    edit distance in words. Null and empty texts and items match nothing, items without an id are left
    out, repeated items are matched each. A column named ``out`` is replaced. Without rows or items
    there are no matches. Each row is judged by itself.
    """
    small_batches(docs)
    result = F.array().cast(MATCHES)
    sc = docs.sparkSession.sparkContext
    for block in blocks(benchmark, item_id, item_text):
        result = F.concat(result, _matcher(sc.broadcast(tuple(build(block, params))), params)(F.col(text)))
    return docs.withColumn(out, result)


def _matcher(shared, params: Cgk):
    @F.pandas_udf(MATCHES)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        forget()
        index = Index(*shared.value)
        finder, number = Finder(index, params), index.numbers.get
        for texts in batches:
            rows = []
            for first in range(0, len(texts), 1000):
                words = [words_of(text) for text in texts.iloc[first : first + 1000]]
                numbers = np.array([number(w, 0) for each in words for w in each], np.int64)
                ends = np.cumsum([len(each) for each in words])
                for found in finder.matches(numbers, ends):
                    rows.append([(index.ids[i], end, len(index.items[i]), d) for i, end, d in found])
            yield pd.Series(rows)

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, params: Cgk = Cgk(), **names) -> DataFrame:
    """``(doc_id, item_id, end_word, n_words, distance)``, a row per document and item it holds."""
    doc_id = names.pop("doc_id", "doc_id")
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(names.get("text", "text")).alias("text"))
    names["text"] = "text"
    found = with_matches(slim, benchmark, params, **names)
    return found.select("doc_id", F.explode("matches").alias("match")).select("doc_id", "match.*")


def clean(docs: DataFrame, benchmark: DataFrame, params: Cgk = Cgk(), **names) -> DataFrame:
    """Rows of ``docs`` that hold no item; columns unchanged."""
    holder = "clean_row"
    text = names.pop("text", "text")
    packed = docs.select(F.struct(*docs.columns).alias(holder), F.col(text).alias("clean_text"))
    found = with_matches(packed, benchmark, params, text="clean_text", out="clean_found", **names)
    return found.where(F.size("clean_found") == 0).select(f"{holder}.*")
