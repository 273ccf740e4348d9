"""Credential detection over a text table: rules first, an optional score second.

Detection is one projection per row. It needs no shuffle, so it runs the same on a batch table and
on a stream, and a table of any size is one pass over its text column.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysift.functions.spans import SPAN_TYPE, spans
from keysift.operators.keyed import unused
from keysift.operators.rules import Rule, as_rules, check_rules

RESULT_COLUMNS = ["has_credential", "confidence", "matches", "match_positions"]
LISTS_TYPE = "array<array<string>>"
POSITION_TYPE = "array<struct<start:int,end:int,type:string>>"

# A scorer adds a DOUBLE column ``confidence`` computed from the column ``score_text``.
Scorer = Callable[[DataFrame], DataFrame]


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def matches_any_rule(text: Column, rules=None) -> Column:
    """True where at least one rule matches. Literal tests run first, a regex only where they hold; rules
    with the same literals share one test.

    The lowercased text is bound to a lambda variable: a filter would otherwise compute it again for
    every literal.
    """
    by_literals: dict[tuple[str, ...], list[Rule]] = {}
    for rule in as_rules(rules):
        by_literals.setdefault(rule.literals(), []).append(rule)

    def any_match(lowered: Column) -> Column:
        groups = by_literals.values()
        return _any(
            [
                group[0].may_match(lowered) & _any([text.rlike(r.java_pattern()) for r in group])
                for group in groups
            ]
        )

    return F.exists(F.array(F.lower(text)), any_match)


def _scan(df: DataFrame, text: str, rules: list[Rule]) -> tuple[DataFrame, str, str]:
    """``df`` with two more columns, and their names: whether any rule matches, and all matches.

    The first does not depend on the spans: a filter on it stays a cheap test next to the scan, and a
    result without positions never computes them. Each step is its own projection, so that no regex
    runs twice on a text.
    """
    check_rules(df.sparkSession, rules)
    hit, found, gaps, located = (unused(df, name) for name in ("_hit", "_found", "_gaps", "_spans"))
    hits = df.withColumn(hit, matches_any_rule(F.col(text), rules))
    patterns = [rule.java_pattern() for rule in rules]
    extracted = F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in patterns])
    hits = hits.withColumn(found, F.when(F.col(hit), extracted.cast(LISTS_TYPE)))
    between = [
        F.when(F.size(F.get(found, F.lit(i))) > 0, F.split(text, p, -1)) for i, p in enumerate(patterns)
    ]
    split = hits.withColumn(gaps, F.when(F.col(hit), F.array(*between).cast(LISTS_TYPE)))
    names = F.array(*[F.lit(rule.name) for rule in rules]).cast("array<string>")
    placed = F.transform(
        found, lambda matches, i: spans(matches, F.get(gaps, i), F.get(names, i))
    )
    # Where the optimizer copies this into a filter, a text without a match costs one test.
    everything = F.when(F.col(hit), F.flatten(placed))
    scanned = split.select(
        *df.columns,
        F.coalesce(hit, F.lit(False)).alias(hit),
        F.coalesce(everything, F.array().cast(SPAN_TYPE)).alias(located),
    )
    return scanned, hit, located


def match_spans(df: DataFrame, text: str = "text", rules=None) -> DataFrame:
    """One row per match, next to the input columns: ``rule_order, start, end, type, match``.

    All matches of all rules; rules may overlap. Texts without a match are filtered out by the scan
    before any span is computed.
    """
    rules = as_rules(rules)
    names = F.array(*[F.lit(rule.name) for rule in rules])
    scanned, hit, located = _scan(df, text, rules)
    span = unused(df, "span")
    # Each hit has spans. The outer form keeps the optimizer from adding a test of their number.
    exploded = scanned.where(F.col(hit)).select(*df.columns, F.explode_outer(located).alias(span))
    return exploded.select(
        *df.columns,
        (F.array_position(names, F.col(f"{span}.type")) - 1).cast("int").alias("rule_order"),
        f"{span}.*",
    )


def rule_stats(df: DataFrame, key: str, text: str = "text", rules=None) -> DataFrame:
    """Per rule that matches: ``(type, matches, texts)``, all matches and the keys of rows with one."""
    found = match_spans(df.select(key, text), text, rules)
    return found.groupBy("type").agg(
        F.count("*").alias("matches"), F.count_distinct(key).alias("texts")
    )


def mask_flagged(df: DataFrame, text: str = "text", rules=None, out: str = "masked") -> DataFrame:
    """Add ``out``: the text with what each rule matches replaced by the rule's name in brackets.

    Rules apply one after the other. A text without a match stays as it is and costs one test.
    """
    rules = as_rules(rules)
    check_rules(df.sparkSession, rules)
    masked = F.col(text)
    for rule in rules:
        name = f"[{rule.name}]".replace("\\", r"\\").replace("$", r"\$")
        masked = F.regexp_replace(masked, rule.java_pattern(), name)
    hit = matches_any_rule(F.col(text), rules)
    return df.withColumn(out, F.when(hit, masked).otherwise(F.col(text)))


def _with_result(df: DataFrame, columns: list[str], located: str, has: Column, matches: Column) -> DataFrame:
    positions = F.transform(located, lambda s: F.struct(s["start"], s["end"], s["type"]))
    return df.select(
        *columns,
        has.alias("has_credential"),
        "confidence",
        matches.alias("matches"),
        positions.cast(POSITION_TYPE).alias("match_positions"),
    )


def detect(
    df: DataFrame,
    text: str = "text",
    rules=None,
    score: Scorer | None = None,
    threshold: float = 0.7,
) -> DataFrame:
    """Add ``has_credential, confidence, matches, match_positions`` to every row.

    ``match_positions`` lists the rule matches in rule order, then by position. A rule match decides
    with confidence 1. Only texts without one reach ``score``; without a scorer they get confidence
    0. A text at or above the threshold is itself the match. Columns of the input by the names of the
    results are replaced.

    ``text_chars``, the length of the raw text, is there for scorers that treat long texts apart: a
    filter on it reaches the scan, so no text is searched twice.
    """
    taken = {name.lower() for name in [*RESULT_COLUMNS, "score_text", "text_chars"]} - {text.lower()}
    df = df.select(*[c for c in df.columns if c.lower() not in taken])
    measured = df if score is None else df.withColumn("text_chars", F.length(text))
    found, hit_name, located = _scan(measured, text, as_rules(rules))
    hit = F.col(hit_name)
    rule_matches = F.col(f"{located}.match")
    if score is None:
        decided = found.withColumn("confidence", hit.cast("int").cast("double"))
        return _with_result(decided, df.columns, located, hit, rule_matches)

    scored = score(found.withColumn("score_text", F.when(~hit, F.col(text))))
    confidence = F.when(hit, F.lit(1.0)).otherwise(F.coalesce("confidence", F.lit(0.0)))
    decided = scored.withColumn("confidence", confidence)
    over = F.col("confidence") >= F.lit(threshold)
    matches = (
        F.when(hit, rule_matches)
        .when(over, F.array(F.col(text)))
        .otherwise(F.array().cast("array<string>"))
    )
    return _with_result(decided, df.columns, located, hit | over, matches)


def result_json(detected: DataFrame, text: str = "text") -> DataFrame:
    """Each detection result as one JSON object with its text added."""
    return detected.select(F.to_json(F.struct(F.col(text).alias("text"), *RESULT_COLUMNS)).alias("value"))
