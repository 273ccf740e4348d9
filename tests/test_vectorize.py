import math
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from keysift.functions.normalize import normalize_text, strip_accents
from keysift.operators.vectorize import (
    VectorizerParams,
    fit_vocabulary,
    gram_counts,
    grams_of,
    vector_weights,
    vectorizer,
    with_features,
)
from keysift.session import scratch_path
from keysift.sources import artifacts
from tests.samples import FLAGGED, HARMLESS, random_texts

LATIN = "abcdeABCDE  \t\n\u00a0\u2003éÉçãñß😀π=:0129"
SAMPLES = [*FLAGGED, *HARMLESS, *random_texts(300, seed=3, pool=LATIN, longest=60)]


def plain(text):
    parts = unicodedata.normalize("NFKD", text.lower())
    return "".join(c for c in parts if not unicodedata.combining(c))


def word_grams(text, largest):
    grams = []
    for word in plain(text).split():
        padded = f" {word} "
        for n in range(1, largest + 1):
            grams += [padded[i : i + n] for i in range(len(padded) - n + 1)]
    return grams


def raw_grams(text, largest):
    return [text[i : i + n] for n in range(1, largest + 1) for i in range(len(text) - n + 1)]


def fitted(samples, largest=3, min_df=2, max_df=0.95, max_features=1500):
    tf, df = Counter(), Counter()
    for text in samples:
        grams = word_grams(text, largest)
        tf.update(grams)
        df.update(set(grams))
    kept = [g for g in tf if min_df <= df[g] <= max_df * len(samples)]
    top = sorted(sorted(kept, key=lambda g: (-tf[g], g))[:max_features])
    return {g: (i, df[g], tf[g], math.log((1 + len(samples)) / (1 + df[g])) + 1) for i, g in enumerate(top)}


@pytest.mark.parametrize("largest", [1, 2, 3, 5])
def test_word_grams(texts, largest):
    params = VectorizerParams(ngram_max=largest)
    rows = texts(SAMPLES).select("text", grams_of(F.col("text"), params).alias("g")).collect()
    for row in rows:
        assert Counter(row.g) == Counter(word_grams(row.text, largest)), repr(row.text)


def test_raw_grams(texts):
    samples = SAMPLES + random_texts(200)
    rows = texts(samples).select("text", grams_of(F.col("text"), VectorizerParams(), "raw").alias("g")).collect()
    for row in rows:
        assert Counter(row.g) == Counter(raw_grams(row.text, 3)), repr(row.text)


def test_accents_native(spark):
    # Letters newer than the Unicode version of Python may be lowercased by Spark.
    known = [chr(cp) for cp in range(0x20, 0x2000) if unicodedata.category(chr(cp)) != "Cn"]
    letters = [c for c in known if len(plain(c)) <= 1]
    df = spark.createDataFrame([(c, f"x{c}y") for c in letters], "c STRING, text STRING")
    for row in df.select("c", strip_accents(F.lower("text")).alias("s")).collect():
        assert row.s == plain(f"x{row.c}y"), hex(ord(row.c))


def test_accents_exact(texts):
    samples = random_texts(300) + ["ﬁ½가…①𝔸ẞ", "plain", "é", ""]
    rows = texts([*samples, None]).select("text", normalize_text(F.col("text"), exact=True).alias("s")).collect()
    for row in rows:
        assert row.s == (None if row.text is None else plain(row.text))


def test_exact_covers_every_character(spark):
    letters = [chr(cp) for cp in range(0x80, 0x30000) if not 0xD800 <= cp <= 0xDFFF and plain(chr(cp)) != chr(cp)]
    df = spark.createDataFrame([(f"a{c}b",) for c in letters], "text STRING")
    rows = df.select("text", strip_accents(F.col("text"), exact=True).alias("s")).collect()
    expected = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    assert [r.text for r in rows if r.s != expected(r.text)] == []


@pytest.mark.parametrize("piece_chars", [1, 2, 7, 50, 250_000])
def test_gram_counts(texts, piece_chars):
    """The counts do not depend on the pieces a text is cut into."""
    tf, df = Counter(), Counter()
    for text in SAMPLES:
        tf.update(word_grams(text, 3))
        df.update(set(word_grams(text, 3)))
    rows = gram_counts(texts([*SAMPLES, None]), piece_chars=piece_chars).collect()
    assert {r.gram: (r.tf, r.df) for r in rows} == {g: (tf[g], df[g]) for g in tf}


@pytest.mark.parametrize("params", [VectorizerParams(), VectorizerParams(2, 5, 0.5, 60)])
def test_fit(texts, params):
    expected = fitted(SAMPLES, params.ngram_max, params.min_df, params.max_df, params.max_features)
    for partitions in (1, 8):
        rows = fit_vocabulary(texts([*SAMPLES, None], partitions), params).collect()
        found = {r.gram: (r.idx, r.df, r.tf, r.idf) for r in rows}
        assert found.keys() == expected.keys()
        for gram, values in expected.items():
            assert found[gram] == pytest.approx(values)


def weights(df, model, **kwargs):
    found = {}
    for row in vector_weights(with_features(df, model, **kwargs), ["id"]).collect():
        found.setdefault(row.id, {})[row.idx] = row.weight
    return found


def test_transform(texts):
    vocabulary = fitted(SAMPLES)
    train = texts(SAMPLES)
    unseen = SAMPLES[::3] + ["never seen ÀÉ", "", "zzzz"]
    found = weights(texts([*unseen, None]), vectorizer(fit_vocabulary(train)))
    for i, text in enumerate(unseen):
        counts = Counter(g for g in word_grams(text, 3) if g in vocabulary)
        raw = {vocabulary[g][0]: n * vocabulary[g][3] for g, n in counts.items()}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        assert found.get(i, {}) == pytest.approx({k: w / norm for k, w in raw.items()}), repr(text)
    assert len(unseen) not in found


def test_transform_raw(texts):
    vocabulary = fitted(SAMPLES)
    found = weights(texts(SAMPLES), vectorizer(fit_vocabulary(texts(SAMPLES)), "raw"), mode="raw")
    for i, text in enumerate(SAMPLES):
        counts = Counter(g for g in raw_grams(text, 3) if g in vocabulary)
        norm = math.sqrt(sum(n * n for n in counts.values()))
        expected = {vocabulary[g][0]: n / norm * vocabulary[g][3] for g, n in counts.items()}
        assert found.get(i, {}) == pytest.approx(expected), repr(text)


@pytest.mark.parametrize("mode", ["tfidf", "raw"])
def test_transform_of_pieces(texts, mode):
    model = vectorizer(fit_vocabulary(texts(SAMPLES)), mode)
    df = texts([*SAMPLES, None])
    whole = weights(df, model, mode=mode)
    for piece_chars in (1, 5, 30):
        cut = weights(df, model, mode=mode, piece_chars=piece_chars)
        assert cut.keys() == whole.keys()
        assert all(cut[i] == pytest.approx(whole[i]) for i in whole)
    kept = with_features(df, model, mode=mode, piece_chars=5).select("id", "text")
    assert set(kept.collect()) == set(df.collect())


def test_one_gram_in_every_document(texts):
    """A gram that dominates the corpus is dropped by max_df and counted right before that."""
    df = texts(["aaaa"] * 500 + ["b"] * 3)
    counts = {r.gram: (r.tf, r.df) for r in gram_counts(df).collect()}
    assert counts["a"] == (2000, 500) and counts[" "] == (1006, 503)
    assert "a" not in {r.gram for r in fit_vocabulary(df, VectorizerParams(max_df=0.9)).collect()}


def test_long_text(texts):
    text = "word " * 40_000
    vectors = with_features(texts([text, "word"]), vectorizer(fit_vocabulary(texts([text, "word", "x"]))))
    assert vectors.count() == 2


def test_empty_vocabulary_is_an_error(texts):
    with pytest.raises(ValueError, match="empty"):
        vectorizer(fit_vocabulary(texts(["ab"])))


def test_vocabulary_json(spark, texts):
    params = VectorizerParams(max_features=40)
    vocabulary = fit_vocabulary(texts(SAMPLES), params)
    path = scratch_path(spark, "vocabulary")
    artifacts.write_vocabulary(vocabulary, path, params, "some_vectorizer")
    read, read_params = artifacts.read_vocabulary(spark, path)
    assert read_params == params
    expected = {r.gram: (r.idx, r.idf) for r in vocabulary.collect()}
    assert {r.gram: (r.idx, r.idf) for r in read.collect()} == expected
    assert artifacts.read_vocabulary(spark, path + "-none") is None


def test_every_code_point_decomposes_in_the_jvm(spark):
    """All of Unicode, 64 characters a row, as Python decomposes them; no row goes to Python."""
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    rows = ["|".join(map(chr, points[i : i + 64])) for i in range(0, len(points), 64)]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, text string").repartition(8)
    stripped = df.select("id", strip_accents(F.col("text")).alias("s"))
    assert "Python" not in stripped._jdf.queryExecution().executedPlan().toString()
    for row in stripped.collect():
        decomposed = unicodedata.normalize("NFKD", rows[row.id])
        assert row.s == "".join(c for c in decomposed if not unicodedata.combining(c))


def test_fit_stays_in_the_jvm(spark, texts):
    grams = gram_counts(texts(["Ação ﬁle 한글", "açao"]))
    assert "Python" not in grams._jdf.queryExecution().executedPlan().toString()
