"""Personal data, and the terms that give it away.

Base spans are found by pattern: email and network addresses, card and phone numbers. Their values
are the protected entities. How strongly a term t reveals an entity c is estimated from the corpus,
by how often t stands within ``reach`` characters of c among all its occurrences:

    disclosure(c, t) = PMI(c; t) / IC(c) = 1 - log p(c | t) / log p(c)

It is 1 where t never occurs without c, as telling as c itself, and 0 where t tells nothing. A term
whose disclosure reaches ``generalise`` is replaced by its kind wherever it stands, one that reaches
``remove`` is removed. A term counts for an entity only if it stands in ``support`` different
surroundings of it: mirrored pages are one surrounding, however many there are. Every word can be a
term, short ones and those with digits too, but for words that overlap a base span.

Everything is DataFrame expressions. Spans, surroundings and the corpus counts of all terms come from
scans of the texts; the places of the terms found are joined to the texts, which exchanges them.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysift.functions.spans import spans
from keysift.llm.common import SPACE, WORD, row_key, stored, whole

KINDS = ("email", "ip", "card", "phone")
TERM = "term"

# The base patterns. Possessive and anchored forms of the stated ones, with the same matches: no run
# of characters is tried again from inside, and no repetition recurses, however long the text.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A character every match holds, to pass over texts without it.
NEEDED = {"email": "@", "ip": ".", "card": "", "phone": "+"}
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
PUNCTUATION = ".,;:!?()[]{}\"'`|*#$%&<>_~=+-/\\"
# Marks words that overlap a base span: a noncharacter, which no text should hold.
HIDDEN = "\uffff"
BROADCAST_ROWS = 100_000


class Disclosure(NamedTuple):
    reach: int = 80
    support: int = 3
    generalise: float = 0.93
    remove: float = 0.98


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def valid(kind: str, value: Column) -> Column:
    """What a match of a kind must hold besides its pattern."""
    if kind == "ip":
        return value.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return F.length(digits(value)).between(13, 19) & F.call_function("luhn_check", digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def with_base_spans(docs: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: structs ``(start, end, type, match)`` by kind, then start, in code points."""
    none = F.array().cast("array<string>")
    kept = docs.columns
    matches, gaps = {}, {}
    for kind, pattern in PATTERNS.items():
        found = F.regexp_extract_all(F.col(text), F.lit(pattern), 0)
        if NEEDED[kind]:
            found = F.when(F.contains(F.col(text), F.lit(NEEDED[kind])), found).otherwise(none)
        matches[f"pii_{kind}"] = found
        split = F.split(F.col(text), pattern, -1)
        gaps[f"pii_{kind}_gaps"] = F.when(F.size(f"pii_{kind}") > 0, split).otherwise(none)
    rows = docs.withColumns(matches).withColumns(gaps)

    def valid_spans(kind: str) -> Column:
        found = spans(F.col(f"pii_{kind}"), F.col(f"pii_{kind}_gaps"), F.lit(kind))
        return F.filter(found, lambda s: valid(kind, s["match"]))

    each = [valid_spans(kind) for kind in PATTERNS]
    return rows.withColumn(out, F.concat(*each)).select(*kept, out)


def terms_of(text: Column) -> Column:
    """Words without the punctuation around them, lowered; may hold empty strings."""
    return F.transform(F.split(text, SPACE, -1), lambda w: F.lower(F.btrim(w, F.lit(PUNCTUATION))))


def masked(text: Column, base: Column) -> Column:
    """The text with each character of a base span replaced by ``HIDDEN``."""
    begin = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))

    def step(state: Column, s: Column) -> Column:
        before = F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        blank = F.repeat(F.lit(HIDDEN), F.greatest(s["end"] - F.greatest(s["start"], state["at"]), F.lit(0)))
        return F.when(s["end"] <= state["at"], state).otherwise(
            F.struct(F.concat(state["done"], before, blank).alias("done"), s["end"].alias("at"))
        )

    end = F.aggregate(F.sort_array(base), begin, step)
    return F.concat(end["done"], F.substring(text, end["at"] + 1, F.length(text) - end["at"]))


def surroundings(found: DataFrame, reach: int) -> DataFrame:
    """``(kind, value, place, term)``: words wholly within ``reach`` characters of a base span.

    ``place`` identifies the surrounding text. All words but those that overlap a base span are terms,
    of any length and with digits or at signs.
    """
    found = found.select(masked(F.col("pii_text"), F.col("pii_spans")).alias("pii_text"), "pii_spans")
    each = found.select("pii_text", F.explode("pii_spans").alias("s"))
    left_start = F.greatest(F.col("s.start") - reach, F.lit(0))
    sides = each.select(
        F.col("s.type").alias("kind"),
        F.col("s.match").alias("value"),
        (F.col("s.start") > reach).alias("cut"),
        F.substring("pii_text", left_start + 1, F.col("s.start") - left_start).alias("left"),
        F.substring("pii_text", F.col("s.end") + 1, F.lit(reach + 1)).alias("right"),
    )
    left = F.when(F.col("cut"), F.regexp_replace("left", f"^{WORD}", "")).otherwise(F.col("left"))
    right = F.when(
        F.length("right") > reach, F.regexp_replace("right", f"{WORD}$", "")
    ).otherwise(F.col("right"))
    around = sides.select("kind", "value", F.concat_ws(" ", left, right).alias("around"))
    term = F.explode(terms_of(F.col("around")))
    rows = around.select("kind", "value", F.xxhash64("around").alias("place"), term.alias("term"))
    return rows.where((F.col("term") != "") & ~F.contains(F.col("term"), F.lit(HIDDEN)))


def disclosive_terms(found: DataFrame, docs: DataFrame, params: Disclosure) -> DataFrame:
    """``(term, disclosure, action)`` for terms that give some entity away.

    ``found`` has ``(pii_text, pii_spans)``, ``docs`` ``pii_text``. Counts are of occurrences, over all
    texts, combined per task before they are exchanged; common terms meet as one partial count per
    task.
    """
    near = surroundings(found, params.reach)
    by_place = near.groupBy("kind", "value", "term", "place").agg(F.count("*").alias("n"))
    pairs = by_place.groupBy("kind", "value", "term").agg(
        F.sum("n").alias("n_both"), F.count("*").alias("places")
    )
    pairs = pairs.where(F.col("places") >= params.support)
    entities = found.select(F.explode("pii_spans").alias("s")).groupBy("s.type", "s.match")
    entities = entities.agg(F.count("*").alias("n_entity"))
    entities = entities.select(
        F.col("type").alias("kind"), F.col("match").alias("value"), "n_entity"
    )
    words = docs.select(F.explode(terms_of(F.col("pii_text"))).alias("term")).where("term <> ''")
    counts = stored(words.groupBy("term").agg(F.count("*").alias("n_term")), "pii-terms")
    n_all = counts.agg(F.sum("n_term")).first()[0] or 0
    given = F.least(F.lit(1.0), F.col("n_both") / F.col("n_term"))
    share = F.col("n_entity") / (F.lit(n_all) + F.col("n_entity"))
    disclosure = F.lit(1.0) - F.log(given) / F.log(share)
    scored = (
        pairs.join(counts, "term")
        .join(entities, ["kind", "value"])
        .groupBy("term")
        .agg(F.max(disclosure).alias("disclosure"))
        .where(F.col("disclosure") >= params.generalise)
    )
    action = F.when(F.col("disclosure") >= params.remove, F.lit("remove")).otherwise(
        F.lit("generalise")
    )
    return scored.select("term", "disclosure", action.alias("action"))


def term_places(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``(pii_key, pii_terms)``: per text that holds some of the terms, its spans of them.

    Distinct words are joined with the terms; only texts with a hit are looked at again, for places.
    Terms, and the keys of those texts, are broadcast up to ``BROADCAST_ROWS``, by count; beyond, both
    sides are exchanged.
    """
    small = terms.count() <= BROADCAST_ROWS
    words = docs.select(
        "pii_key", F.explode(F.array_distinct(terms_of(F.col("pii_text")))).alias("term")
    )
    hits = words.join(F.broadcast(terms) if small else terms, "term")
    # A text has far fewer telling terms than words, and each is named once.
    per_text = stored(
        hits.groupBy("pii_key").agg(
            F.map_from_entries(F.collect_set(F.struct("term", "action"))).alias("pii_actions")
        ),
        "pii-hits",
    )
    keys = per_text.select("pii_key")
    few = per_text.count() <= BROADCAST_ROWS
    rows = docs.join(F.broadcast(keys) if few else keys, "pii_key", "left_semi")
    rows = rows.dropDuplicates(["pii_key"]).join(per_text, "pii_key")
    rows = rows.withColumn("pii_words", F.regexp_extract_all("pii_text", F.lit(WORD), 0))
    rows = rows.withColumn("pii_gaps", F.split("pii_text", WORD, -1))
    rows = rows.withColumn("pii_all", spans(F.col("pii_words"), F.col("pii_gaps"), F.lit(TERM)))

    def trimmed(s: Column) -> Column:
        core = F.btrim(s["match"], F.lit(PUNCTUATION))
        start = s["start"] + F.length(s["match"]) - F.length(F.ltrim(s["match"], F.lit(PUNCTUATION)))
        return F.struct(
            start.alias("start"),
            (start + F.length(core)).alias("end"),
            s["type"].alias("type"),
            core.alias("match"),
        )

    cores = F.transform("pii_all", trimmed)
    named = F.filter(cores, lambda s: F.map_contains_key("pii_actions", F.lower(s["match"])))
    return rows.select("pii_key", named.alias("pii_terms"), "pii_actions")


def find(
    docs: DataFrame,
    params: Disclosure = Disclosure(),
    *,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``text``, ``base``, ``terms`` and ``sanitised``.

    ``base`` holds ``(start, end, type, match)`` per kind, then start, ``terms`` the spans of disclosive
    terms that touch no base span. ``sanitised`` is the text with base spans and generalised terms
    replaced by their kind in brackets, and removed terms gone. A null text is empty. Null ids and
    repeated rows are kept as they are, and each occurrence counts in the corpus. An empty table gives
    an empty one. Other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("pii_id"), whole(F.col(text)).alias("pii_text"))
    rows = rows.withColumn("pii_key", row_key(F.col("pii_id"), F.col("pii_text")))
    spanned = with_base_spans(rows, "pii_text", "pii_spans")
    found = spanned.where(F.size("pii_spans") > 0).select("pii_text", "pii_spans")
    found = stored(found, "pii-found")
    terms = stored(disclosive_terms(found, rows, params), "pii-disclosive")
    places = term_places(rows.select("pii_key", "pii_text"), terms)
    joined = spanned.join(places, "pii_key", "left")
    free = F.filter(
        F.coalesce("pii_terms", F.array().cast("array<struct<start:int,end:int,type:string,match:string>>")),
        lambda t: ~F.exists(
            "pii_spans", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])
        ),
    )
    result = joined.withColumn("terms", free)
    return result.select(
        F.col("pii_id").alias("doc_id"),
        F.col("pii_text").alias("text"),
        F.col("pii_spans").alias("base"),
        "terms",
        sanitised("pii_text", "pii_spans", "terms", "pii_actions").alias("sanitised"),
    )


def sanitised(text: str, base: str, terms: str, actions: str) -> Column:
    """The text with spans replaced, from left to right; what overlaps an earlier span is cut."""
    ordered = F.sort_array(F.concat(F.col(base), F.col(terms)))
    begin = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))

    def step(state: Column, s: Column) -> Column:
        gone = (s["type"] == TERM) & (F.col(actions)[F.lower(s["match"])] == "remove")
        label = F.when(gone, F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["type"]), F.lit("]")))
        before = F.substring(F.col(text), state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        return F.when(s["end"] <= state["at"], state).otherwise(
            F.struct(F.concat(state["done"], before, label).alias("done"), s["end"].alias("at"))
        )

    end = F.aggregate(ordered, begin, step)
    return F.concat(
        end["done"], F.substring(F.col(text), end["at"] + 1, F.length(text) - end["at"])
    )


def listed(spans_: Column) -> Column:
    """``kind:start:end`` per span, comma-joined."""
    return F.array_join(
        F.transform(spans_, lambda s: F.concat_ws(":", s["type"], s["start"], s["end"])), ","
    )
