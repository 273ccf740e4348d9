"""Profile operators: a text table in, the same table with profile columns out.

Each step is its own projection, so that a count used by several columns is computed once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysift.functions import profile


def with_char_counts(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumns(profile.char_counts(F.col(text)))


def with_profile(df: DataFrame, text: str = "text") -> DataFrame:
    """Counts, ratios, flags and transitions as typed columns."""
    counts = profile.char_counts(F.col(text))
    counted = df.withColumns(
        {**counts, "transitions": profile.transitions(F.col(text)), **profile.shape_flags(F.col(text))}
    )
    ratios = profile.char_ratios({name: F.col(name) for name in counts})
    rate = profile.transition_rate(F.col("transitions"), F.col("length"))
    return counted.withColumns({**ratios, "transition_rate": rate})


def with_feature_string(df: DataFrame, text: str = "text", output: str = "features") -> DataFrame:
    """The rendered profile next to the input columns, nothing else."""
    kept = [F.col(name).alias(f"_in_{name}") for name in df.columns]
    profiled = with_profile(df.select(*kept, F.col(text).alias("_text")), "_text")
    names = {name for line in profile.LAYOUT for name in line}
    rendered = profile.render_profile({name: F.col(name) for name in names})
    back = [F.col(f"_in_{name}").alias(name) for name in df.columns]
    return profiled.select(*back, rendered.alias(output))


def with_classifier_features(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumns(profile.classifier_features(F.col(text)))
