import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from keysift.operators.detect import detect
from keysift.operators.split import stratified_split
from keysift.operators.synth import NEGATIVE_TEMPLATES, negative_examples, positive_examples
from keysift.session import scratch_path
from keysift.sources.files import read_split, write_split


def expected_test_ids(labels, share, seed):
    """Rank each class by hash and take its part of the test rows, by largest remainder."""
    wanted = math.ceil(share * len(labels))
    sizes = {c: sum(1 for v in labels.values() if v == c) for c in set(labels.values())}
    exact = {c: wanted * (n / len(labels)) for c, n in sizes.items()}
    quota = {c: math.floor(v) for c, v in exact.items()}
    order = sorted(sizes, key=lambda c: (-(exact[c] - quota[c]), c))
    for c in order[: wanted - sum(quota.values())]:
        quota[c] += 1
    chosen = set()
    for c in sizes:
        ids = [i for i, v in labels.items() if v == c]
        ids.sort(key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())
        chosen.update(ids[: quota[c]])
    return chosen


@pytest.mark.parametrize("size, positives, share", [(6, 3, 0.2), (400, 200, 0.2), (997, 13, 0.3), (5, 5, 0.2), (1, 1, 0.2), (3000, 1, 0.01)])
def test_split(spark, size, positives, share):
    labels = {i: int(i < positives) for i in range(size)}
    df = spark.createDataFrame(list(labels.items()), "id LONG, label INT").repartition(3)
    rows = stratified_split(df, "id", test_size=share, seed=7).collect()
    assert len(rows) == size
    chosen = {r.id for r in rows if r.split == "test"}
    assert chosen == expected_test_ids(labels, share, 7)
    assert len(chosen) == math.ceil(share * size)


def test_split_of_reported_size(spark):
    df = spark.range(400).withColumn("label", (F.col("id") % 2).cast("int"))
    counts = stratified_split(df, "id").groupBy("split", "label").count().collect()
    assert {(r.split, r.label): r["count"] for r in counts} == {
        ("test", 0): 40, ("test", 1): 40, ("train", 0): 160, ("train", 1): 160,
    }


def test_rows_of_one_key_stay_together(spark):
    """A third of all rows share a key."""
    df = spark.range(900).select(
        F.when(F.col("id") < 300, -1).otherwise(F.col("id")).alias("id"), F.lit(1).alias("label")
    )
    rows = stratified_split(df, "id").collect()
    assert len({r.split for r in rows if r.id == -1}) == 1
    assert len(rows) == 900 and 180 <= sum(r.split == "test" for r in rows) <= 480


def test_split_of_nothing(spark):
    assert stratified_split(spark.createDataFrame([], "id LONG, label INT"), "id").count() == 0


def test_split_leaves_unlabelled_rows(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, None), (4, 7)], "id LONG, label INT")
    rows = {r.id: r.split for r in stratified_split(df, "id").collect()}
    assert rows[3] is None and rows[4] is None and {rows[1], rows[2]} == {"test", "train"}


def test_split_roundtrip(spark):
    df = spark.range(50).withColumn("label", (F.col("id") % 2).cast("int"))
    path = scratch_path(spark, "split")
    split = stratified_split(df, "id")
    write_split(split, path)
    assert sorted(read_split(spark, path).collect()) == sorted(split.collect())


POSITIVE = [
    r'api_key="[A-Za-z0-9]{32}"',
    r"password=[A-Za-z0-9!@#$%^&*]{16}",
    r"AKIA[A-Z0-9]{16}",
    r"eyJ0eXAiOiJKV1QiLCJhbGciOiJIUzI1NiJ9\.[A-Za-z0-9_-]{32}\.[A-Za-z0-9_-]{32}",
    r'access_token="[A-Za-z0-9]{40}"',
]


def test_positive_examples(spark):
    rows = positive_examples(spark.range(1000), "id").collect()
    shapes = [next(i for i, p in enumerate(POSITIVE) if re.fullmatch(p, r.text)) for r in rows]
    assert all(150 < shapes.count(i) < 250 for i in range(5))
    assert len({r.text for r in rows}) == 1000
    assert {(r.is_credential, r.source) for r in rows} == {(True, "synthetic")}


def test_negative_examples(spark):
    rows = negative_examples(spark.range(2000), "id").collect()
    seen = set()
    for row in rows:
        for i, template in enumerate(NEGATIVE_TEMPLATES):
            fixed = [p for p in template if isinstance(p, str)]
            if row.text.startswith(fixed[0]) and row.text.endswith(fixed[-1] if len(template) != 2 else ""):
                seen.add(i)
                ranges = [p for p in template if not isinstance(p, str)]
                if ranges:
                    number = int(re.search(r"\d+", row.text).group())
                    assert ranges[0][0] <= number <= ranges[0][1]
    assert seen == set(range(9))


def test_synthetic_rows_do_not_depend_on_partitions(spark):
    one = {r.id: r.text for r in positive_examples(spark.range(0, 50, 1, 1), "id").collect()}
    many = {r.id: r.text for r in positive_examples(spark.range(0, 50, 1, 7), "id").collect()}
    other = {r.id: r.text for r in positive_examples(spark.range(50), "id", seed=1).collect()}
    assert one == many and one != other


def test_rules_tell_synthetic_classes_apart(spark):
    ids = spark.range(500)
    assert detect(positive_examples(ids, "id")).where("NOT has_credential").count() == 0
    assert detect(negative_examples(ids, "id")).where("has_credential").count() == 0


def test_null_keys_are_one_key(spark):
    rows = [(None if i < 40 else i, i % 2) for i in range(100)]
    split = stratified_split(spark.createDataFrame(rows, "k LONG, label INT"), "k").collect()
    assert {r.split for r in split} == {"train", "test"}
    assert len({r.split for r in split if r.k is None and r.label == 0}) == 1
