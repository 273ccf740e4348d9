import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from keysift.functions import gramcounts
from keysift.functions.grams import join_words, raw_grams, word_grams
from keysift.operators.vectorize import VectorizerParams, fit_vocabulary, gram_counts, vectorizer, with_features

TEXTS = [
    "ab ab cab",
    "",
    None,
    "  \t ",
    "a",
    "😀 x😀y \x00 z\x00",
    "日本語 テキスト",
    "x" * 50 + " " + "yz" * 30,
    "a b a b",
]


def some_texts(seed):
    rng = random.Random(seed)
    return ["".join(rng.choices("abé 😀\x00", k=rng.randrange(40))) for _ in range(60)]


def listed(spark, texts, largest, mode):
    """Per text, what the lists of grams as strings hold."""
    if mode == "raw":
        grams = raw_grams(F.col("text"), 1, largest)
    else:
        grams = word_grams(F.col("text"), largest)
    rows = spark.createDataFrame(list(enumerate(texts)), "id LONG, text STRING")
    found = {row.id: row.grams for row in rows.select("id", grams.alias("grams")).collect()}
    return [Counter(found[i] or []) for i in range(len(texts))]


def joined(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id LONG, text STRING")
    return [row.text for row in rows.select("id", join_words("text").alias("text")).orderBy("id").collect()]


@pytest.mark.parametrize("largest", [1, 2, 3, 25])
def test_corpus_counts_are_those_of_the_listed_grams(spark, largest):
    texts = joined(spark, [t for t in TEXTS if t is not None] + some_texts(1))
    grams, tf, df = gramcounts.corpus_counts(texts, largest)
    expected = listed(spark, texts, largest, "tfidf")
    assert len(grams) == len(set(grams))
    assert dict(zip(grams, tf.tolist())) == dict(sum(expected, Counter()))
    assert dict(zip(grams, df.tolist())) == dict(Counter(g for counts in expected for g in counts))


@pytest.mark.parametrize("mode", ["tfidf", "raw"])
@pytest.mark.parametrize("dense", [True, False])
def test_counts_per_text_are_those_of_the_listed_grams(spark, monkeypatch, mode, dense):
    monkeypatch.setattr(gramcounts, "CHUNK_CHARS", 100)
    if not dense:
        monkeypatch.setattr(gramcounts, "DENSE_STEPS", 0)
    texts = [t or "" for t in TEXTS] + some_texts(2)
    if mode == "tfidf":
        texts = joined(spark, texts)
    vocabulary = ["a", " ", "ab", "a b", "b ", " a", "😀", "x😀", "\x00", "zzz", "語 ", "yzy", "yzyz", "é😀"]
    found = gramcounts.counts_per_text(texts, gramcounts.Vocabulary.of(vocabulary), 3, mode != "raw")
    ends, places, counts = found
    assert len(ends) == len(texts)
    starts = np.concatenate([[0], ends[:-1]])
    for start, end, expected in zip(starts, ends, listed(spark, texts, 3, mode)):
        assert sorted(places[start:end]) == places[start:end].tolist()
        own = {vocabulary[i]: n for i, n in zip(places[start:end], counts[start:end])}
        assert own == {g: n for g, n in expected.items() if g in vocabulary}


def test_long_texts_count_as_short_ones(spark, texts):
    rows = texts(TEXTS + some_texts(3))
    whole = {tuple(row) for row in gram_counts(rows).collect()}
    assert whole == {tuple(row) for row in gram_counts(rows, piece_chars=5).collect()}
    model = vectorizer(fit_vocabulary(rows, VectorizerParams(min_df=1, max_df=1.0)))
    for mode in ("tfidf", "raw"):
        vectors = [
            {row.id: row.features for row in with_features(rows, model, mode=mode, piece_chars=size).collect()}
            for size in (1000, 5)
        ]
        assert vectors[0].keys() == vectors[1].keys()
        for key, vector in vectors[0].items():
            assert np.allclose(vector.toArray(), vectors[1][key].toArray())


def test_memory_of_vectors_does_not_grow_with_the_texts_of_a_batch():
    vocabulary = gramcounts.Vocabulary.of(["a", "ab", " b"])
    peaks = []
    for n in (50, 500):
        texts = ["ab" * 2000 + " "] * n
        tracemalloc.start()
        ends, places, counts = gramcounts.counts_per_text(texts, vocabulary, 3, True)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert len(ends) == n and places.tolist() == [0, 1] * n and counts.tolist() == [2000, 2000] * n
    assert peaks[1] < 1.5 * peaks[0]
