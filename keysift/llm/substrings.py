"""Passages that repeat across documents, by level-wise doubling.

A window is a run of words of one document; it repeats if the same words in the same order stand in a
document of another text. Lengths double: 25 words, 50, 100 and so on. Windows that repeat at one length
alone are extended to twice that length, until no candidates survive.

* **25 words.** Of all windows of 25 words inside one of 50, the one with the smallest hash leads; the
  leftmost, where several are equal. Equal windows of 50 words have the same leader at the same place, so
  only leaders are compared, a thirteenth of all windows, and no repeat is missed.
* **50 words.** All windows of 50 words whose leader repeats are compared, by 128 bits of hash. Those
  that also start in a document with a smaller id are what ``without_repeats`` removes, wherever they lie:
  longer repeats hold nothing that these do not cover.
* **100 words and more.** These levels only say how long repeats are. Leaders of 50 words are extended from
  their first word, as long as all windows of 50 words on the way repeat. Every stretch of 100 words that
  repeats so holds such a start in its first half, so a repeat of 50 words more than a length is found there.

A text with several ids is searched once, under its smallest id. Each of its other copies is a repeat from
its first word to its last, if it has a whole window.

Hot passages: a batch of texts compares its own windows first. Of those it finds equal, only the one with
the smallest id is compared further; of the others, all is known. So the windows of one passage that meet
in a task are as many as there are batches, not documents.

Null texts are empty. Rows without an id neither lend nor lose words. Rows of one id do not repeat each
other; rows equal in id and text get equal results. Ids are integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from keysift.llm.common import SPACE, fresh, small_batches, stored, whole

LEAST = 50
#: Odd numbers: bases of the two polynomials over the hashes of words.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
SALTS = 16
#: What is known of a window inside its batch.
OPEN, SHARED, KNOWN = 0, 1, 2

FOUND = "h long, g long, doc long, text long, place long, spread long"
COVERED = (
    "doc long, text long, spans array<struct<start:int,end:int>>, "
    "samples array<struct<place:int,hashes:array<long>>>"
)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(whole(text), SPACE), "")


def _marked(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(doc, t1, t2, text, row)``: 128 bits that name the text, and all columns of the row in one."""
    value = whole(F.col(text))
    return docs.select(
        F.col(doc_id).cast("long").alias("doc"),
        F.xxhash64(value).alias("t1"),
        F.xxhash64(F.lit(BASES[1] >> 1), value).alias("t2"),
        value.alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
    )


def _hashed(text: Column) -> Column:
    return F.transform(words_of(text), lambda word: F.xxhash64(word))


# Inside tasks: all texts of a batch as one array of word hashes


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base % 2**64), np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out, out=out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def window_hashes(words: np.ndarray, length: int, base: int) -> np.ndarray:
    """A hash of ``length`` words from each place on, for uint64 hashes of words."""
    n = len(words)
    if n < length:
        return np.empty(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * _powers(base, n), out=sums[1:])
    back = _powers(pow(base, -1, 2**64), n - length + 1)
    return _mixed((sums[length:] - sums[: n - length + 1]) * back)


def leaders(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each place, where the smallest of ``width`` hashes from there on stands; leftmost of equals."""
    if len(hashes) < width:
        return np.empty(0, np.int64)
    low = np.uint64(31)
    least = ((hashes >> low) << low) | np.arange(len(hashes), dtype=np.uint64)
    wide = 1
    while wide < width:
        step = min(wide, width - wide)
        least = np.minimum(least[:-step], least[step:])
        wide += step
    return (least & np.uint64(2**31 - 1)).astype(np.int64)


def _inside(ends: np.ndarray, n: int, length: int) -> np.ndarray:
    """Which of the first ``n`` places start a window of ``length`` words that ends in its own text."""
    return np.arange(length, n + length) <= ends[:n]


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of lists, and where each list starts in them, with the end of the last."""
    starts = np.asarray(lists.offsets, np.int64)
    return np.asarray(lists.values)[starts[0] : starts[-1]], starts - starts[0]


def compared(h: np.ndarray, g: np.ndarray, doc: np.ndarray, text: np.ndarray) -> np.ndarray:
    """What a batch knows of its windows: ``OPEN``; ``SHARED``, the smallest id of those equal in several
    texts; ``KNOWN``, any other of those. A text's own repeats are no others."""
    known = np.zeros(len(h), np.int32)
    if not len(h):
        return known
    order = np.lexsort((text, doc, g, h))
    h, g, doc, text = h[order], g[order], doc[order], text[order]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])])
    size = np.diff(np.r_[first, len(h)])
    other = (doc != np.repeat(doc[first], size)) | (text != np.repeat(text[first], size))
    several = np.repeat(np.logical_or.reduceat(other, first), size)
    known[order] = np.where(several, np.where(doc != np.repeat(doc[first], size), KNOWN, SHARED), OPEN)
    return known


def _table(h, g, doc, text, place) -> pa.RecordBatch:
    known = compared(h, g, doc, text)
    # What is known needs no company: a number of its own sends it to any task.
    spread = _mixed(h ^ text.view(np.uint64) ^ (place.astype(np.uint64) * np.uint64(BASES[0])))
    spread = np.where(known == KNOWN, spread | np.uint64(1), np.uint64(0))
    columns = [h.view(np.int64), g.view(np.int64), doc, text, place * 4 + known, spread.view(np.int64)]
    names = [column.split()[0] for column in FOUND.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=names)


def _half_windows(half: int):
    """Leaders of ``half`` words in batches of ``(t1, t2, words)``; a text's copies in a batch count once."""

    def run(batches):
        for batch in batches:
            once = np.unique(np.asarray(batch.column("t1")), return_index=True)[1]
            batch = batch.take(pa.array(once))
            words, starts = _flat(batch.column("words"))
            words = words.view(np.uint64)
            t1, t2 = np.asarray(batch.column("t1")), np.asarray(batch.column("t2"))
            hashes = window_hashes(words, half, BASES[0])
            lead = leaders(hashes, half + 1)
            ends = np.repeat(starts[1:], np.diff(starts))
            at = np.unique(lead[_inside(ends, len(lead), 2 * half)])
            own = np.searchsorted(starts, at, "right") - 1
            zero = np.zeros(len(at), np.uint64)
            yield _table(hashes[at], zero, t1[own], t2[own], at - starts[own])

    return run


def _whole_windows(half: int):
    """Windows of twice ``half`` words whose leader is one of ``places``, of ``(doc, t1, words, places)``."""

    def run(batches):
        for batch in batches:
            words, starts = _flat(batch.column("words"))
            words = words.view(np.uint64)
            places, lists = _flat(batch.column("places"))
            alive = np.zeros(len(words) + 1, bool)
            alive[places + np.repeat(starts[:-1], np.diff(lists))] = True
            lead = leaders(window_hashes(words, half, BASES[0]), half + 1)
            ends = np.repeat(starts[1:], np.diff(starts))
            at = np.flatnonzero(_inside(ends, len(lead), 2 * half) & alive[lead])
            own = np.searchsorted(starts, at, "right") - 1
            doc, t1 = np.asarray(batch.column("doc"))[own], np.asarray(batch.column("t1"))[own]
            h, g = (window_hashes(words, 2 * half, base)[at] for base in BASES)
            yield _table(h, g, doc, t1, at - starts[own])

    return run


def merged(places: np.ndarray, length: int) -> list[dict]:
    """Windows of ``length`` words, by ascending places, as stretches that do not touch."""
    if not len(places):
        return []
    new = np.flatnonzero(np.diff(places) > length) + 1
    starts, ends = places[np.r_[0, new]], places[np.r_[new - 1, len(places) - 1]] + length
    return [{"start": int(a), "end": int(b)} for a, b in zip(starts, ends)]


def samples_of(places: np.ndarray, h: np.ndarray, length: int) -> list[dict]:
    """Starts to extend, of the ascending places of windows that repeat and their hashes: leaders of runs
    of places, each with the hashes of 2, 4, 8 ... times ``length`` words from there, within its run."""
    if not len(places):
        return []
    run = np.r_[0, np.cumsum(np.diff(places) != 1)]
    lead = leaders(h, length + 1)
    at = np.unique(lead[run[: len(lead)] == run[length : length + len(lead)]])
    last = np.searchsorted(run, run[at], "right") - 1
    hashes: list[list[int]] = [[] for _ in at]
    level, width = h, length
    while len(level) > width:
        # Of a run's place, the hash of twice the words is that of both halves.
        level = _mixed(level[: len(level) - width] * np.uint64(BASES[0]) + _mixed(level[width:]))
        fits = np.flatnonzero(at + 2 * width - length <= last)
        if not len(fits):
            break
        for k, x in zip(fits, level[at[fits]].view(np.int64).tolist()):
            hashes[k].append(x)
        width *= 2
    return [{"place": int(p), "hashes": x} for p, x in zip(places[at], hashes) if x]


def _covered(length: int):
    """Per text, what it loses and which starts to extend, of ``(doc, text, windows)``."""
    types = {"spans": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))}
    types["samples"] = pa.list_(pa.struct([("place", pa.int32()), ("hashes", pa.list_(pa.int64()))]))

    def run(batches):
        for batch in batches:
            flat, starts = _flat_structs(batch.column("windows"))
            out: dict[str, list] = {"spans": [], "samples": []}
            for a, b in zip(starts[:-1], starts[1:]):
                order = a + np.argsort(flat["place"][a:b])
                place = flat["place"][order].astype(np.int64)
                out["spans"].append(merged(place[flat["loses"][order]], length))
                out["samples"].append(samples_of(place, flat["h"][order].view(np.uint64), length))
            columns = [batch.column("doc"), batch.column("text")]
            columns += [pa.array(out[c], types[c]) for c in types]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "text", *types])

    return run


def _flat_structs(lists: pa.ListArray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    starts = np.asarray(lists.offsets, np.int64)
    values = lists.values
    fields = {f.name: values.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(values.type)}
    return {k: x[starts[0] : starts[-1]] for k, x in fields.items()}, starts - starts[0]


# The levels


def _repeated(found: DataFrame) -> DataFrame:
    """``(h, doc, text, place, loses)`` of windows that repeat, of rows as ``FOUND``: ``loses`` where it also
    starts in a document with a smaller id."""
    same = W.partitionBy("h", "g", "spread")
    known = F.col("place") % 4
    compared_all = found.select(
        "h",
        "doc",
        "text",
        F.shiftright("place", 2).cast("int").alias("place"),
        known.alias("known"),
        ((known == KNOWN) | (F.min("doc").over(same) < F.col("doc"))).alias("loses"),
        ((known > OPEN) | (F.min("text").over(same) < F.max("text").over(same))).alias("repeats"),
    )
    return compared_all.where("repeats").drop("known", "repeats")


def covered(marked: DataFrame, least: int = LEAST) -> DataFrame:
    """``COVERED``: per text under its smallest id, the words that it loses and the starts to extend.

    ``marked`` is as ``_marked`` returns. Stored: the levels above and the texts themselves read it.
    """
    half = least // 2
    long_enough = marked.where(F.col("doc").isNotNull() & (F.length("text") >= 2 * least - 1))
    words = long_enough.select("t1", "t2", _hashed(F.col("text")).alias("words"))
    leading = _repeated(words.mapInArrow(_half_windows(half), FOUND))
    places = leading.groupBy(F.col("doc").alias("t1"), F.col("text").alias("t2")).agg(
        F.collect_set("place").alias("places")
    )
    texts = long_enough.groupBy("t1", "t2").agg(F.min("doc").alias("doc"), F.first("text").alias("text"))
    candidates = texts.join(places, ["t1", "t2"]).select(
        "doc", "t1", _hashed(F.col("text")).alias("words"), "places"
    )
    windows = _repeated(candidates.mapInArrow(_whole_windows(half), FOUND))
    listed = windows.groupBy("doc", "text").agg(
        F.collect_list(F.struct("place", "h", "loses")).alias("windows")
    )
    return stored(listed.mapInArrow(_covered(least), COVERED), "substrings-50")


def extended(found: DataFrame, least: int = LEAST) -> DataFrame:
    """``(doc, text, longest)``: for texts of ``covered``, the greatest length at which a window repeats.

    One round per length, on those that the one before left, until no candidates survive.
    """
    alive = found.select("doc", "text", F.explode("samples").alias("sample")).select(
        "doc", "text", F.col("sample.hashes").alias("hashes")
    )
    longest = found.select("doc", "text", F.lit(least).cast("long").alias("longest"))
    level, length = 0, 2 * least
    while True:
        hashed = alive.where(F.size("hashes") > level).withColumn("h", F.col("hashes")[level])
        several = hashed.groupBy("h").agg(F.min("text").alias("lo"), F.max("text").alias("hi"))
        several = several.where("lo < hi").select("h")
        alive = stored(hashed.join(several, "h", "left_semi").drop("h"), f"substrings-{length}")
        if alive.isEmpty():
            break
        repeated = alive.select("doc", "text", F.lit(length).cast("long").alias("longest"))
        longest = longest.union(repeated.distinct())
        level, length = level + 1, 2 * length
    return longest.groupBy("doc", "text").agg(F.max("longest").alias("longest"))


def with_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, out: str = "repeats"
) -> DataFrame:
    """``docs`` with a struct ``out``: ``n_words``, ``longest``, ``removed`` and ``kept``.

    ``removed`` lists stretches of words, from 0, end exclusive, covered by windows of ``least`` words that
    also start in a document with a smaller id; ``kept`` is the rest, joined by one space. ``longest`` is
    the greatest of ``least``, twice, four times ... as many words at which a window of the row repeats
    elsewhere, for later copies of a text the number of its words, 0 without repeats. ``least`` is even.
    """
    if least < 2 or least % 2:
        raise ValueError("least must be an even number of words")
    small_batches(docs)
    out = fresh(docs, out)
    marked = _marked(docs, doc_id, text)
    found = covered(marked, least)
    lost = found.join(extended(found, least), ["doc", "text"]).select(
        "doc", F.col("text").alias("t1"), "spans", "longest", F.lit(False).alias("copy")
    )
    ids = marked.where("doc IS NOT NULL").select("doc", "t1", "t2").distinct()
    copied = ids.groupBy("t1", "t2").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    # A text of very many copies: its first id is looked up in several tasks.
    salted = copied.where("first < last").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    )
    copies = (
        ids.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int"))
        .join(salted, ["t1", "t2", "salt"])
        .where("doc > first")
        .select(
            "doc",
            "t1",
            F.array().cast("array<struct<start:int,end:int>>").alias("spans"),
            F.lit(0).cast("long").alias("longest"),
            F.lit(True).alias("copy"),
        )
    )
    words = words_of(F.col("text"))
    joined = marked.join(lost.unionByName(copies), ["doc", "t1"], "left")
    joined = joined.select("row", words.alias("words"), "spans", "longest", "copy")
    n = F.size("words")
    everything = F.coalesce("copy", F.lit(False)) & (n >= least)
    spans = F.when(
        everything, F.array(F.struct(F.lit(0).alias("start"), n.alias("end")))
    ).otherwise(F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")))
    joined = joined.withColumn("removed", spans)
    edges = F.arrays_zip(
        F.concat(F.array(F.lit(0)), F.col("removed.end")).alias("start"),
        F.concat(F.col("removed.start"), F.array(n)).alias("end"),
    )
    kept = F.flatten(F.transform(edges, lambda e: F.slice("words", e["start"] + 1, e["end"] - e["start"])))
    result = F.struct(
        n.cast("long").alias("n_words"),
        F.when(everything, n.cast("long")).otherwise(F.coalesce("longest", F.lit(0))).alias("longest"),
        "removed",
        F.array_join(kept, " ").alias("kept"),
    )
    return joined.select("row", result.alias("result")).select("row.*", F.col("result").alias(out))


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with all words removed that an earlier document holds in a passage of ``least`` words. Texts
    that lose nothing stay as they are, spaces included."""
    found = with_repeats(docs, doc_id, text, least)
    repeats = F.col(f"`{found.columns[-1]}`")
    shorter = F.when(F.size(repeats["removed"]) > 0, repeats["kept"]).otherwise(F.col(f"`{text}`"))
    return found.withColumn(text, shorter).drop(found.columns[-1])
