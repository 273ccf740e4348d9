import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from keysift.operators import evaluate as ev
from keysift.operators.reconcile import matched, reconciled, reconciliation


def brute(predictions, labels):
    sides = [defaultdict(list), defaultdict(list)]
    for side, rows in zip(sides, (predictions, labels)):
        for key, value, *_ in rows:
            side[key].append(value)
    lost = [len(side.pop(None, [])) for side in sides]
    found = dict.fromkeys(("tn", "fp", "fn", "tp", "matched", "conflicting", "predicted_only", "labelled_only"), 0)
    for key in {*sides[0], *sides[1]}:
        p, y = sides[0].get(key), sides[1].get(key)
        if y is None:
            found["predicted_only"] += 1
        elif p is None:
            found["labelled_only"] += 1
        elif None in p or None in y or len(set(p)) > 1 or len(set(y)) > 1:
            found["conflicting"] += 1
        else:
            found["matched"] += 1
            found[["tn", "fp", "fn", "tp"][2 * int(y[0]) + int(p[0])]] += 1
    for name, side in zip(("predictions", "labels"), sides):
        found[f"repeated_{name}"] = sum(len(v) > 1 for v in side.values())
    found["predictions_without_key"], found["labels_without_key"] = lost
    return found


def tables(spark, predictions, labels):
    return (
        spark.createDataFrame(predictions, "id long, has_credential boolean, confidence double").repartition(3),
        spark.createDataFrame(labels, "id long, label int").repartition(3),
    )


@pytest.mark.parametrize("seed", range(3))
def test_reconciliation_equals_brute_force(spark, seed):
    chosen = random.Random(seed)
    keys = [*range(80), None]
    predictions = [(chosen.choice(keys), chosen.random() < 0.4, chosen.random()) for _ in range(90)]
    labels = [(chosen.choice([*keys, *range(100, 120)]), chosen.choice([0, 1, 1])) for _ in range(90)]
    # One key has a third of all rows, on both sides.
    predictions += [(7, True, 0.5)] * 60 + [(81, None, None), (82, False, None)]
    labels += [(7, 1)] * 60 + [(81, 1), (82, 0), (83, None)]
    found = reconciliation(reconciled(*tables(spark, predictions, labels), "id")).first().asDict()
    assert found == brute(predictions, labels)
    assert found["matched"] == sum(found[c] for c in ("tn", "fp", "fn", "tp"))


def test_matched_keys_are_evaluated(spark):
    predictions = [(1, True, 0.9), (1, True, 0.8), (2, False, 0.1), (3, True, 0.7), (4, True, 0.9), (5, True, 1.0)]
    labels = [(1, 1), (2, 1), (3, 0), (4, 1), (4, 0)]
    rows = reconciled(*tables(spark, predictions, labels), "id")
    assert {r.key: r.status for r in rows.collect()} == {
        1: "matched", 2: "matched", 3: "matched", 4: "conflicting", 5: "predicted only",
    }
    pairs = matched(rows)
    assert sorted(map(tuple, pairs.collect())) == [(1, 1, 1, 0.9), (2, 1, 0, 0.1), (3, 0, 1, 0.7)]
    counts = ev.score_counts(pairs, "label", "prediction", "confidence")
    assert {(r.label, r.prediction): r.n for r in ev.confusion(counts).collect()} == {
        (0, 0): 0, (0, 1): 1, (1, 0): 1, (1, 1): 1,
    }


def test_names_bad_values_and_nothing(spark):
    predictions, labels = tables(spark, [(1, True, 0.5)], [(1, 1)])
    names = ("key", "n", "value", "agrees", "score", "status", "label", "prediction")
    clashing = predictions.withColumns({c: F.lit(c) for c in names})
    rows = reconciled(clashing, labels.withColumns({c: F.lit(c) for c in names if c != "label"}), "id")
    assert [tuple(r) for r in rows.collect()] == [(1, 1, 1, 1, 1, 0.5, "matched")]
    none = reconciliation(reconciled(predictions.limit(0), labels.limit(0), "id")).first()
    assert set(none.asDict().values()) == {0}
    with pytest.raises(Exception, match="label is not 0 or 1"):
        reconciled(predictions, labels.withColumn("label", F.lit(2)), "id").collect()
