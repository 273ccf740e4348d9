"""Exact stratified train/test split without sorting a class in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keysift.operators.keyed import unused
from keysift.session import ensure_checkpoint_dir


def _hash(key: str, seed: int) -> Column:
    """A null key is one key, as any other value is."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))


def _test_quotas(sizes: DataFrame, label: str, test_size: float) -> DataFrame:
    """Test rows per class: ``ceil(test_size * n)`` shared in proportion, by largest remainder.

    ``sizes`` has one row per class, so two at most.
    """
    everything = Window.partitionBy()
    shared = sizes.withColumn("total", F.sum("size").over(everything)).withColumn(
        "wanted", F.ceil(F.lit(float(test_size)) * F.col("total"))
    )
    shared = shared.withColumn("share", F.col("wanted") * (F.col("size") / F.col("total")))
    shared = shared.withColumn("whole", F.floor("share"))
    by_remainder = Window.orderBy(F.desc(F.col("share") - F.col("whole")), label)
    left_over = F.col("wanted") - F.sum("whole").over(everything)
    extra = (F.row_number().over(by_remainder) <= left_over).cast("int")
    return shared.select(label, (F.col("whole") + extra).alias("quota"))


def test_thresholds(
    df: DataFrame, key: str, label: str = "label", test_size: float = 0.2, seed: int = 42
) -> DataFrame:
    """Per class, the largest key hash that still goes to the test set: ``(label, cut)``.

    A histogram over the first four hex digits of the hash finds the one bucket the cut lies in, and
    only that bucket, a 65536th of the class, is ranked.
    """
    keys = df.where(F.col(label).isin(0, 1)).select(label, _hash(key, seed).alias("hash"))
    keys = keys.withColumn("bucket", F.substring("hash", 1, 4))
    ensure_checkpoint_dir(df.sparkSession)
    # Two classes and 65536 buckets at most. Stored, as sizes and edges both read it.
    histogram = keys.groupBy(label, "bucket").agg(F.count("*").alias("n")).checkpoint()
    quotas = _test_quotas(
        histogram.groupBy(label).agg(F.sum("n").alias("size")), label, test_size
    )
    upto = F.sum("n").over(Window.partitionBy(label).orderBy("bucket"))
    # Two rows at most, as the label is 0 or 1.
    edges = (
        histogram.withColumn("upto", upto)
        .join(F.broadcast(quotas), label)
        .where((F.col("upto") >= F.col("quota")) & (F.col("upto") - F.col("n") < F.col("quota")))
        .select(label, "bucket", (F.col("quota") - F.col("upto") + F.col("n")).alias("need"))
    )
    ordered = Window.partitionBy(label).orderBy("hash")
    return (
        keys.join(F.broadcast(edges), [label, "bucket"])
        .groupBy(label, "hash", "need")
        .agg(F.count("*").alias("n"))
        .withColumn("upto", F.sum("n").over(ordered))
        .where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
        .select(label, F.col("hash").alias("cut"))
    )


# Not a test, whatever a test runner makes of the name.
test_thresholds.__test__ = False


def stratified_split(
    df: DataFrame, key: str, label: str = "label", test_size: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add or replace ``split``: ``train`` or ``test``, with both classes in proportion and exact sizes.

    ``label`` is 0 or 1; a row with any other label gets a null. ``key`` identifies a row: rows that
    share one stay together, which is the only way the sizes can be off. The order is that of a
    seeded hash of the key, so the split does not depend on partitions.

    Finding the thresholds reads the key and label columns only, and the split itself is a map over
    the table. The histogram is computed at once, the rest when the result is read.
    """
    cut, part = unused(df, "cut"), "split"
    cuts = test_thresholds(df, key, label, test_size, seed).withColumnRenamed("cut", cut)
    in_test = F.coalesce(_hash(key, seed) <= F.col(cut), F.lit(False))
    side = F.when(F.col(label).isin(0, 1), F.when(in_test, F.lit("test")).otherwise(F.lit("train")))
    kept = [c for c in df.columns if c.lower() != part]
    # Two rows at most, as the label is 0 or 1.
    return df.join(F.broadcast(cuts), label, "left").select(*kept, side.alias(part))
