"""Quality rules: a table of thresholds, compiled into one projection without user functions.

``RULES`` has a row per rule: name, numerator, denominator, least and greatest ratio, and the
denominator from which the rule holds, as a ratio over a few words or lines says little. Measures
are computed inside each row; texts are never regrouped.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysift.llm.common import SPACE, WORD, fresh, whole

SYMBOLS = "#*$%&|<>"
WINDOW = 5

# The most frequent function words of the languages covered.
STOP_WORDS = (
    "the of and to in is that it for was on as with by at from this be or an are a "
    "der die das und den von zu mit für auf ist im nicht ein eine als auch des dem sich "
    "le la les de des et en un une du que est dans pour pas au il elle qui sur "
    "el los las y por con no una su para al del se lo como más o"
).split()


class Rule(NamedTuple):
    name: str
    numerator: str
    denominator: str | None
    least: float | None
    most: float | None
    since: int = 0


RULES = (
    Rule("length", "n_words", None, 10, None),
    Rule("repeated words", "n_repeat_words", "n_words", None, 0.2),
    Rule("word length", "word_chars", "n_words", 2, 15),
    Rule("symbols", "n_symbols", "word_chars", None, 0.05),
    Rule("stop words", "n_stop_words", "n_words", 0.02, None, 30),
    Rule("repeated lines", "n_dup_lines", "n_lines", None, 0.3, 8),
    Rule("capitals", "n_upper", "word_chars", None, 0.5),
)


def _measures(docs: DataFrame, text: str) -> DataFrame:
    """Adds the measures. Steps are projections of their own where a later one indexes into an
    array: inside a lambda an array expression would be computed again for every element."""
    t = whole(F.col(text))
    words = docs.withColumn("q_text", t).withColumn("q_words", F.regexp_extract_all(t, F.lit(WORD), 0))
    hashes = words.withColumns(
        {
            "n_words": F.size("q_words").cast("long"),
            "word_chars": F.length(F.regexp_replace("q_text", SPACE, "")).cast("long"),
            "n_symbols": (
                F.length("q_text") - F.length(F.translate("q_text", SYMBOLS, ""))
            ).cast("long"),
            "n_upper": (
                F.length("q_text") - F.length(F.translate("q_text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
            ).cast("long"),
            "q_lines": F.filter(F.split("q_text", "\n", -1), lambda x: x.rlike(WORD)),
            "n_stop_words": F.size(
                F.filter("q_words", lambda x: F.lower(x).isin(STOP_WORDS))
            ).cast("long"),
            "q_hashes": F.transform("q_words", lambda x: F.xxhash64(x)),
        }
    )
    windows = hashes.withColumns(
        {
            "n_lines": F.size("q_lines").cast("long"),
            "n_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"),
            "q_windows": F.slice(
                F.transform(
                    "q_hashes",
                    lambda x, i: F.xxhash64(
                        x, *[F.get(F.col("q_hashes"), i + k) for k in range(1, WINDOW)]
                    ),
                ),
                1,
                F.greatest(F.size("q_hashes") - (WINDOW - 1), F.lit(0)),
            ),
        }
    )
    repeats = F.size(F.array_distinct("q_windows")) < F.size("q_windows")
    placed = windows.withColumn(
        "q_sorted",
        F.when(
            repeats,
            F.sort_array(F.transform("q_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    found = placed.withColumn(
        "q_found",
        F.sort_array(
            F.transform(
                F.filter(
                    "q_sorted",
                    lambda x, k: (x["h"] == F.get(F.col("q_sorted"), k - 1)["h"])
                    | (x["h"] == F.get(F.col("q_sorted"), k + 1)["h"]),
                ),
                lambda x: x["i"],
            )
        ),
    )
    covered = F.aggregate(
        F.transform(
            "q_found",
            lambda p, k: F.least(
                F.lit(WINDOW), F.coalesce(F.get(F.col("q_found"), k + 1) - p, F.lit(WINDOW))
            ),
        ),
        F.lit(0),
        lambda total, x: total + x,
    )
    return found.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))


def broken(rule: Rule) -> Column:
    """Whether a row breaks a rule. A ratio over nothing counts as one over 1."""
    value = F.col(rule.numerator)
    against = F.greatest(F.col(rule.denominator), F.lit(1)) if rule.denominator else F.lit(1)
    low = F.lit(False) if rule.least is None else value < against * F.lit(float(rule.least))
    high = F.lit(False) if rule.most is None else value > against * F.lit(float(rule.most))
    return (low | high) & (against >= rule.since)


def rate(docs: DataFrame, *, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Rows of ``docs`` with the measures, ``broken`` (names of broken rules) and ``kept``.

    Measures: ``n_words``, ``word_chars``, ``n_symbols``, ``n_upper``, ``n_lines`` (with a word),
    ``n_dup_lines``, ``n_stop_words``, ``n_repeat_words``. A null text counts as an empty one, which
    breaks the length rule. Columns of ``docs`` by these names are replaced, all others stay. Rows do
    not depend on each other, so repeated rows and an empty table need no rule of their own. Windows
    are compared by 64 bits of a hash of their words' hashes.
    """
    outputs = ["n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines"]
    outputs += ["n_stop_words", "n_repeat_words", "broken", "kept"]
    kept = [c for c in docs.columns if c.lower() not in outputs]
    # Inner columns begin with q_; those of the input that do step aside meanwhile.
    aside = {c: fresh(docs, f"kept_{i}") for i, c in enumerate(kept) if c.lower().startswith("q_")}
    measured = _measures(docs.select(*[F.col(c).alias(aside.get(c, c)) for c in kept]), aside.get(text, text))
    names = F.array_compact(F.array(*[F.when(broken(r), F.lit(r.name)) for r in rules]))
    judged = measured.withColumn("broken", names).withColumn("kept", F.size("broken") == 0)
    return judged.select(*[F.col(aside.get(c, c)).alias(c) for c in kept], *outputs)
