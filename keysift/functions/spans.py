"""Where a pattern matches inside a text, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN_TYPE = "array<struct<start:int,end:int,type:string,match:string>>"


def running_sum(values: Column, count: Column) -> Column:
    """Inclusive prefix sums of an int array of ``count`` values, one or more.

    Each round adds the value ``2^round`` places to the left, so k values take log2(k) rounds.
    Summing a slice per element would take k*k steps on texts with many matches.
    """
    rounds = F.sequence(F.lit(0), F.floor(F.log2(count)).cast("int"))
    return F.aggregate(
        rounds,
        values,
        lambda sums, round_: F.transform(
            sums,
            lambda value, i: value
            + F.coalesce(F.get(sums, i - F.pow(F.lit(2), round_).cast("int")), F.lit(0)),
        ),
    )


def spans(matches: Column, gaps: Column, rule: Column) -> Column:
    """Half-open code point spans of the matches of one rule, in text order.

    ``matches`` are the matched strings and ``gaps`` what splitting the text at the same pattern
    leaves, one more than there are matches: gap, match, gap, ... spell out the text.
    """
    aligned = F.size(gaps) == F.size(matches) + 1
    steps = F.zip_with(
        F.slice(gaps, 1, F.size(matches)),
        matches,
        lambda gap, match: F.length(gap) + F.length(match),
    )
    found = F.zip_with(
        running_sum(steps, F.size(matches)),
        matches,
        lambda end, match: F.struct(
            (end - F.length(match)).alias("start"),
            end.alias("end"),
            rule.alias("type"),
            match.alias("match"),
        ),
    )
    message = F.concat(F.lit("rule with empty matches, which have no span: "), rule)
    return (
        F.when(F.size(matches) == 0, F.array().cast(SPAN_TYPE))
        .when(aligned, found)
        .otherwise(F.raise_error(message).cast(SPAN_TYPE))
    )
