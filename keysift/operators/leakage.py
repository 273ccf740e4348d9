"""Leakage audit of a split: texts of the test part that also stand in the training part.

Texts are compared by content: lower case, accents off, runs of white space as one space, none at the
ends. Equal texts are one class, told by 128 bits of hash, with its counts per part and label; pairs are
never listed, so a text that makes up a third of the table is one row from the first aggregation on.
A null text is unknown and equals no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysift.functions.chars import SPACES, strip
from keysift.functions.normalize import normalize_text
from keysift.operators.keyed import lookup, stored, unused, without

TRAIN, TEST = "train", "test"


def content_key(text: Column) -> Column:
    """Digest of what a text says, however it is set; null for null."""
    return F.md5(strip(F.regexp_replace(normalize_text(text), SPACES, " ")))


def text_classes(split: DataFrame, text: str = "text", label: str = "label", part: str = "split") -> DataFrame:
    """Per class of equal texts, ``(content, n, n_train, n_test, train_0, train_1, test_0, test_1)``.

    Rows of another part count in ``n`` only, rows of another label in no count by label.
    """
    where = {name: F.col(f"`{part}`") == name for name in (TRAIN, TEST)}
    counts = [F.count_if(F.coalesce(hit, F.lit(False))).alias(f"n_{name}") for name, hit in where.items()]
    counts += [
        F.count_if(F.coalesce(hit & (F.col(f"`{label}`") == value), F.lit(False))).alias(f"{name}_{value}")
        for name, hit in where.items()
        for value in (0, 1)
    ]
    keyed = split.where(F.col(f"`{text}`").isNotNull())
    return keyed.groupBy(content_key(F.col(f"`{text}`")).alias("content")).agg(
        F.count("*").alias("n"), *counts
    )


IN_BOTH = "n_train > 0 AND n_test > 0"


def leaks(classes: DataFrame) -> DataFrame:
    """The classes that are in both parts, and ``conflict``: whether their labels differ there."""
    return _with_conflict(classes).where(IN_BOTH)


def _with_conflict(classes: DataFrame) -> DataFrame:
    ones, zeros = F.col("train_1") + F.col("test_1"), F.col("train_0") + F.col("test_0")
    return classes.withColumn("conflict", (ones > 0) & (zeros > 0))


def leaked_rows(
    split: DataFrame, text: str = "text", label: str = "label", part: str = "split", side: str = TEST
) -> DataFrame:
    """The rows of one part whose text is in the other, next to ``leak``: a struct of the class's
    ``n_train``, ``n_test``, how many rows of the other part have the ``same_label`` or an ``other_label``,
    and ``conflict``. Labels that are neither 0 nor 1 are no label: both numbers are null."""
    if side not in (TRAIN, TEST):
        raise ValueError("side must be 'train' or 'test'")
    other = TRAIN if side == TEST else TEST
    found = stored(_with_conflict(text_classes(split, text, label, part)), "text-classes")
    out, value = unused(split, "leak"), F.col("row")[label]
    same = F.when(value == 1, F.col(f"{other}_1")).when(value == 0, F.col(f"{other}_0"))
    opposite = F.when(value == 1, F.col(f"{other}_0")).when(value == 0, F.col(f"{other}_1"))
    rows = split.where(F.col(f"`{part}`") == side).select(
        F.struct(*[F.col(f"`{c}`") for c in split.columns]).alias("row"),
        content_key(F.col(f"`{text}`")).alias("content"),
    )
    leak = F.struct(
        "n_train", "n_test", same.alias("same_label"), opposite.alias("other_label"), "conflict"
    )
    joined = lookup(rows, found, "content", "n", F.expr(IN_BOTH)).select("row", leak.alias("leak"))
    return joined.select("row.*", F.col("leak").alias(out))


def leakage_summary(classes: DataFrame) -> DataFrame:
    """One row per label: ``label``, rows in the test part, how many of them have their text in the
    training part, how many of those only under the other label, and the share that leaks."""
    values = [
        F.struct(
            F.lit(value).alias("label"),
            F.col(f"test_{value}").alias("n"),
            F.when(F.col("n_train") > 0, F.col(f"test_{value}")).otherwise(0).alias("leaked"),
            F.when(
                (F.col(f"train_{value}") == 0) & (F.col(f"train_{1 - value}") > 0), F.col(f"test_{value}")
            )
            .otherwise(0)
            .alias("contradicted"),
        )
        for value in (0, 1)
    ]
    rows = classes.select(F.inline(F.array(*values))).groupBy("label")
    summed = rows.agg(*[F.sum(c).alias(f"n_{c}" if c != "n" else "n_test") for c in ("n", "leaked", "contradicted")])
    return summed.withColumn("share", F.try_divide("n_leaked", "n_test"))


def without_leaks(
    split: DataFrame, text: str = "text", label: str = "label", part: str = "split", drop: str = TRAIN
) -> DataFrame:
    """``split`` without the rows of part ``drop`` whose text is in the other part; null texts stay."""
    if drop not in (TRAIN, TEST):
        raise ValueError("drop must be 'train' or 'test'")
    found = stored(text_classes(split, text, label, part), "text-classes")
    dropped = F.coalesce(F.col(f"`{part}`") == drop, F.lit(False)) & F.col(f"`{text}`").isNotNull()
    rows = split.where(dropped).select(
        F.struct(*[F.col(f"`{c}`") for c in split.columns]).alias("row"),
        content_key(F.col(f"`{text}`")).alias("content"),
    )
    kept = without(rows, found, "content", "n", F.expr(IN_BOTH)).select("row.*")
    return split.where(~dropped).unionByName(kept)
