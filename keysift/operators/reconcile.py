"""Evaluation of predictions and labels that lie in separate tables, matched by a key.

Both sides are aggregated by key before they meet, so a key with very many rows is one row in the join. A
key that is missing on one side, stands in several rows, or whose rows disagree is counted, never dropped
unseen. Null keys match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _binary(value: Column, name: str) -> Column:
    """0 or 1 of a number or boolean; null stays null, anything else fails the job."""
    number = value.cast("double")
    message = F.concat(F.lit(f"{name} is not 0 or 1: "), number.cast("string"))
    known = F.when(number.isin(0.0, 1.0), number.cast("int"))
    return known.when(number.isNotNull(), F.raise_error(message).cast("int"))


def _per_key(rows: DataFrame, key: str, value: str, score: str | None = None) -> DataFrame:
    """``(key, n, value, agrees, score)``: rows of a key, their value, and whether all have it."""
    of = _binary(F.col(f"`{value}`"), value)
    best = F.max(F.col(f"`{score}`").cast("double")) if score else F.lit(None).cast("double")
    grouped = rows.select(F.col(f"`{key}`").alias("key"), of.alias("value"), *([F.col(f"`{score}`")] if score else []))
    return grouped.groupBy("key").agg(
        F.count("*").alias("n"),
        F.min("value").alias("value"),
        ((F.min("value") == F.max("value")) & (F.count("value") == F.count("*"))).alias("agrees"),
        best.alias("score"),
    )


def reconciled(
    predictions: DataFrame,
    labels: DataFrame,
    key: str,
    prediction: str = "has_credential",
    confidence: str = "confidence",
    label: str = "label",
) -> DataFrame:
    """One row per key of either table: ``key``, rows on each side ``n_predictions`` and ``n_labels``,
    ``label``, ``prediction`` and ``confidence`` where all rows of the key agree, and ``status``: matched,
    conflicting, predicted only, labelled only, or no key. The confidence is the largest of a key.

    A null prediction or label is unknown, so a key with one is conflicting.
    """
    left = _per_key(predictions, key, prediction, confidence).alias("p")
    right = _per_key(labels, key, label).alias("l")
    both = left.join(right, F.col("p.key") == F.col("l.key"), "full")
    status = (
        F.when(F.coalesce("p.key", "l.key").isNull(), "no key")
        .when(F.col("l.n").isNull(), "predicted only")
        .when(F.col("p.n").isNull(), "labelled only")
        .when(F.coalesce(F.col("p.agrees"), F.lit(False)) & F.coalesce(F.col("l.agrees"), F.lit(False)), "matched")
        .otherwise("conflicting")
    )
    return both.select(
        F.coalesce("p.key", "l.key").alias("key"),
        F.coalesce("p.n", F.lit(0)).alias("n_predictions"),
        F.coalesce("l.n", F.lit(0)).alias("n_labels"),
        F.when(F.col("l.agrees"), F.col("l.value")).alias("label"),
        F.when(F.col("p.agrees"), F.col("p.value")).alias("prediction"),
        F.col("p.score").alias("confidence"),
        status.alias("status"),
    )


def matched(rows: DataFrame) -> DataFrame:
    """``(key, label, prediction, confidence)`` of the keys of ``reconciled`` that match: what the
    evaluation takes."""
    return rows.where("status = 'matched'").select("key", "label", "prediction", "confidence")


def reconciliation(rows: DataFrame) -> DataFrame:
    """One row: the confusion matrix of the matched keys, how many keys have each status, how many stand
    in several rows of a table, and how many rows of each have no key."""
    status, found = F.col("status"), F.col("status") == "matched"
    cells = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}

    def count(condition: Column) -> Column:
        return F.count_if(F.coalesce(condition, F.lit(False)))

    def keyless(side: str) -> Column:
        return F.coalesce(F.sum(F.when(status == "no key", F.col(side))), F.lit(0))

    return rows.agg(
        *[count(found & (F.col("label") == t) & (F.col("prediction") == p)).alias(c) for c, (t, p) in cells.items()],
        count(found).alias("matched"),
        count(status == "conflicting").alias("conflicting"),
        count(status == "predicted only").alias("predicted_only"),
        count(status == "labelled only").alias("labelled_only"),
        count((status != "no key") & (F.col("n_predictions") > 1)).alias("repeated_predictions"),
        count((status != "no key") & (F.col("n_labels") > 1)).alias("repeated_labels"),
        keyless("n_predictions").alias("predictions_without_key"),
        keyless("n_labels").alias("labels_without_key"),
    )
